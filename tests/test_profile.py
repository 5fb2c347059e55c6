import pytest
from pyspark.sql import functions as F

from plumbline.config import thresholds
from plumbline.operators.profile import ColumnFacts, Profile, named_like_identifier


def role(**facts):
    base = dict(name="x", kind="numeric", n_rows=1000, n=1000, n_distinct=100, integral=True, min=0.0, max=100.0)
    p = Profile.__new__(Profile)
    p.numeric_measures = facts.pop("numeric_measures", False)
    return p._role(ColumnFacts(**{**base, **facts}))


TEXT = dict(kind="string", integral=False, words=1.0, length=5.0, words_std=0.5, address=0.0, coordinate=0.0)


@pytest.mark.parametrize("facts, want", [
    (dict(n_distinct=960), ("identifier", "B4")),
    (dict(n_distinct=959), ("entity_key", "B5")),
    (dict(n_distinct=960, integral=False, numeric_measures=True), ("numeric", "default")),
    (dict(n_distinct=501), ("entity_key", "B5")),
    (dict(n_distinct=500), ("numeric", "default")),
    (dict(n_distinct=51, p5_nonzero=100.5), ("categorical", "B6")),
    (dict(n_distinct=50, p5_nonzero=100.5), ("numeric", "default")),
    (dict(n_distinct=51, p5_nonzero=100.0), ("numeric", "default")),
    (dict(n_distinct=30), ("categorical", "B9")),
    (dict(n_distinct=31), ("numeric", "default")),
    (dict(n_distinct=11, max=10.0), ("numeric", "B9")),
    (dict(n_distinct=3, integral=False), ("numeric", "default")),
    (dict(TEXT, n_distinct=20), ("categorical", "default")),
    (dict(TEXT, n_distinct=21), ("entity_key", "B8")),
    (dict(TEXT, n_distinct=950), ("categorical", "default")),
    (dict(TEXT, n_distinct=300, address=0.71), ("entity_key", "B7")),
    (dict(TEXT, n_distinct=300, words=3.5), ("free_text", "B8")),
    (dict(TEXT, n_distinct=300, length=21.0), ("free_text", "B8")),
    (dict(TEXT, n_distinct=701, length=16.0), ("free_text", "B8")),
    (dict(TEXT, n_distinct=700, length=16.0), ("entity_key", "B8")),
    (dict(TEXT, n_distinct=801, length=30.0, words=4.0), ("entity_key", "B8")),
    (dict(TEXT, n_distinct=801, length=30.0, words=4.0, words_std=3.0), ("free_text", "B8")),
    (dict(TEXT, n_distinct=300, length=25.0, coordinate=0.8), ("identifier", "B10")),
    (dict(n_distinct=100, name="zip code"), ("identifier", "B11")),
    (dict(n_distinct=0, n=0, min=None, max=None), ("numeric", "B9")),
])
def test_role_edges(facts, want):
    assert role(**facts) == want


@pytest.mark.parametrize("name, want", [
    ("user_id", True), ("ID", True), ("valid", False), ("zipcode", True), ("region code", True), ("x_Cd", True),
    ("order-no", True), ("number of x", True), ("identity", False), ("my id", True), ("paid", False)])
def test_identifier_names(name, want):
    assert named_like_identifier(name) is want


def test_profile_of_an_odd_table(spark):
    df = spark.createDataFrame([(1, float("nan"), None, True, [1]), (2, 2.5, None, False, [2])],
                               "a int, b double, c string, d boolean, e array<int>")
    p = Profile(df)
    assert p.roles["e"] == ("unsupported", "type")
    assert p.facts["b"].n == 1 and p.facts["c"].n_distinct == 0
    assert p.roles["c"] == ("categorical", "default")


def test_empty_table(spark):
    p = Profile(spark.createDataFrame([], "a int, b string"))
    assert p.n_rows == 0 and set(p.roles) == {"a", "b"}


def test_missing_target_is_refused(spark):
    with pytest.raises(ValueError):
        Profile(spark.range(3), "nope")


def test_thresholds():
    assert thresholds("Finance").correlation == 0.95 and thresholds("unknown") == thresholds("standard")


def test_profile_does_not_depend_on_partitions(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("m"), F.rand(3).alias("r"))
    assert Profile(df.repartition(1)).roles == Profile(df.repartition(9)).roles


def test_report_has_severe_rows_and_missing_ranking(spark):
    from plumbline.plans.full_report import full_report
    df = spark.createDataFrame([(i, None if i == 3 else float(i % 5), None if i < 6 else float(i * i % 7)) for i in range(30)],
                               "id long, x double, y double")
    report = full_report(df, row_key="id")
    assert [r["column"] for r in report["missing_ranking"].collect()] == ["y", "x"]
    assert "severe_rows" in report and report["severe_rows"].columns == ["id", "missing_pct"]


def test_codes_are_settled_by_counts(spark, monkeypatch):
    import numpy as np

    from plumbline.operators import profile
    rng = np.random.default_rng(5)
    n = 2000
    columns = {
        "low": rng.integers(1, 90, n), "high": rng.integers(200, 900, n), "mixed": rng.integers(0, 900, n),
        "few_low": np.where(np.arange(n) < 50, 7, rng.integers(101, 300, n)),
        "edge": np.where(np.arange(n) < 100, np.arange(n) % 60 + 41, 101 + np.arange(n) % 60),     # its 5 % lies between 100 and 101
        "zeros": np.where(np.arange(n) % 3 == 0, 0, rng.integers(150, 400, n))}
    df = spark.createDataFrame(list(zip(*(c.tolist() for c in columns.values()), strict=True)), list(columns))
    asked, exact = [], profile.exact_quantiles
    monkeypatch.setattr(profile, "exact_quantiles", lambda df, of, *a, **k: asked.extend(of) or exact(df, of, *a, **k))
    p = Profile(df)
    for c, x in columns.items():
        above = np.quantile(x[x != 0], 0.05) > 100
        assert (p.roles[c][1] == "B6") == above, c
    assert asked == ["edge"]                 # the others need no pass of their own
    shown = {r["column"]: r["p5_nonzero"] for r in profile.columns_by_rule(p, "B6").collect()}
    assert shown == pytest.approx({c: np.quantile(columns[c][columns[c] != 0], 0.05) for c in shown})


def test_few_ranks_travel_to_the_pairs(spark, monkeypatch):
    import pandas as pd

    from plumbline.operators import association as a
    rows = [(i % 7 if i % 5 else None, (i * i) % 101, float((i * 37) % 211)) for i in range(500)]
    df = spark.createDataFrame(rows, "few int, more int, y double")
    joins, split = [], a.split_join
    monkeypatch.setattr(a, "split_join", lambda *args, **k: joins.append(args[2]) or split(*args, **k))
    want = pd.DataFrame(rows, columns=["few", "more", "y"]).corr("spearman")["y"]
    for most, shuffled in ((100_000, 0), (0, 2)):
        monkeypatch.setattr(a, "BROADCAST_RANKS", most)
        joins.clear()
        got = {r["column"]: r["spearman"] for r in a.target_spearman(a.Target(df, "y"), ["few", "more"]).collect()}
        assert got == pytest.approx({"few": want["few"], "more": want["more"]}) and len(joins) == shuffled
