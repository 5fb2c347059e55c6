"""A part of the registered queries beside their SQL twins; ``python -m checks.compare`` runs all."""

import pytest

import checks.all  # noqa: F401
from checks.compare import compare, duck
from checks.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.01"
CHOSEN = ["b1_basic_info", "b12_column_views_derived", "c4_missing_row_distribution", "c5_missing_cooccurrence",
          "d1_numeric_summary_gappy", "d4_distribution_class_events", "d5_drop_monotonic", "d7_redundant_098",
          "e2_top5_categories", "f2_feature_similarity_gappy", "f5_target_spearman_nulls", "f7_cat_impact_leak",
          "g6_bivariate_classification", "h4_vocab_diversity_pages", "h6_text_quality", "i8_drift_report",
          "j8_kpss_test_monthly", "j10_seasonal_decompose_monthly", "j13_first_gaps", "j23_fill_gaps",
          "k3_duplicate_rows", "k4_prepare_features", "l6_label_encode", "l10_tfidf_features"]


@pytest.mark.parametrize("name", CHOSEN)
def test_equal_to_sql(spark, name):
    assert compare(spark, duck(FOLDER), name, FOLDER) == ""


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
