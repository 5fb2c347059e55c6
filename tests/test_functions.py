import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions.skew import heavy_keys, split_join
from plumbline.functions import ordered, quantiles
from plumbline.functions.frequency import digest, distinct_counts
from plumbline.functions.gram import pair_sums, pearson_pairs
from plumbline.functions.words import STRIP, tokens
from plumbline.ml.features import duplicate_rows
from plumbline.operators.missing import missing_cooccurrence
from plumbline.operators.numeric import monotonic_increasing

RNG = np.random.default_rng(5)
PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.fixture(scope="module")
def mixed(spark):
    n = 3000
    pdf = pd.DataFrame({
        "smooth": RNG.normal(size=n), "tied": RNG.integers(0, 3, n).astype(float),
        "hot": np.where(RNG.random(n) < 0.4, 7.0, RNG.exponential(size=n)),
        "gappy": np.where(RNG.random(n) < 0.3, np.nan, RNG.random(n)), "empty": np.full(n, np.nan)})
    df = spark.createDataFrame(pdf)
    df = df.select(*[F.nanvl(c, F.lit(None)).alias(c) for c in df.columns])
    return pdf, df.repartition(7)


@pytest.mark.parametrize("settings", [{}, {"direct_cells": 10, "accuracy": 20, "finish_rows": 50},
                                      {"direct_cells": 10, "accuracy": 1000, "finish_rows": 100000},
                                      {"direct_cells": 10, "accuracy": 5, "finish_rows": 1}])
def test_exact_quantiles_equal_numpy(mixed, settings):
    pdf, df = mixed
    got = quantiles.exact_quantiles(df, {c: F.col(c) for c in pdf}, PROBS, **settings)
    for c in pdf:
        x = pdf[c].dropna().to_numpy()
        if not len(x):
            assert got[c] == [None] * len(PROBS)
        else:
            np.testing.assert_allclose(got[c], np.quantile(x, PROBS), rtol=1e-12)


def test_quantiles_of_many_columns_take_two_passes(spark, monkeypatch):
    """One sketch and one count for all columns and probabilities, whatever their number."""
    calls = []
    count = quantiles._narrow
    monkeypatch.setattr(quantiles, "_narrow", lambda staged, plans, rows: (calls.append(len(plans)), count(staged, plans, rows)))
    df = spark.range(20_000).select(*[F.pmod(F.xxhash64(F.lit(i), "id"), F.lit(10 ** (i + 1))).cast("double").alias(f"c{i}") for i in range(6)])
    probs = [i / 10 for i in range(11)]
    got = quantiles.exact_quantiles(df, {c: F.col(c) for c in df.columns}, probs, 20_000, direct_cells=10, accuracy=1000)
    pdf = df.toPandas()
    for c in df.columns:
        np.testing.assert_allclose(got[c], np.quantile(pdf[c], probs), rtol=1e-12)
    assert len(calls) == 1


@pytest.mark.parametrize("finish_rows", [1, 1000])
def test_quantiles_with_infinities_and_nan(spark, finish_rows):
    x = np.concatenate([np.full(60, -np.inf), np.arange(100.0), np.full(70, np.inf), np.full(80, np.nan)])
    df = spark.createDataFrame(pd.DataFrame({"x": x})).repartition(3)
    probs = [10 / 309, 100 / 309, 200 / 309, 300 / 309]       # ranks 10, 100, 200 and 300
    got = quantiles._bracketed(df.select(F.col("x").alias("q0")), ["x"], [round(p * 309) / 309 for p in probs], 5, finish_rows)["x"]
    assert got[1] == 40.0 and np.isnan(got[3])


def hot_groups(spark, n=4000):
    key = np.where(RNG.random(n) < 0.5, "hot", RNG.integers(0, 50, n).astype(str))
    pdf = pd.DataFrame({"k": key, "o": RNG.permutation(n), "v": RNG.integers(1, 9, n)})
    return pdf, spark.createDataFrame(pdf)


def test_running_sums_with_a_hot_group(spark):
    pdf, df = hot_groups(spark)
    got = ordered.running_sums(df, ["k"], ["o"], {"before": F.col("v")}).toPandas()
    want = pdf.sort_values("o")
    want["before"] = want.groupby("k")["v"].cumsum() - want["v"]
    merged = got.merge(want, on=["k", "o"], suffixes=("", "_want"))
    assert len(merged) == len(pdf) and (merged["before"] == merged["before_want"]).all()


def test_running_sums_without_a_group(spark):
    df = spark.range(100).select((F.lit(99) - F.col("id")).alias("o"))
    got = ordered.with_position(df, [], ["o"]).toPandas()
    assert (got["pos"] == got["o"]).all()


def test_overlapped_windows_see_all_neighbours(spark):
    n = 500
    df = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("pos"), F.col("id").alias("y"))
    w = ordered.chunk_window(["k"])
    rows = ordered.overlapped(df, ["k"], before=3, after=2, rows=16)
    assert rows.groupBy("_chunk").count().agg(F.max("count")).first()[0] <= 16 + 5
    got = (rows.withColumn("s", F.sum("y").over(w.rowsBetween(-3, 2))).filter("_own")
           .orderBy("pos").toPandas())
    y = np.arange(n)
    want = [y[max(0, i - 3):i + 3].sum() for i in range(n)]
    assert len(got) == n and got["s"].tolist() == want


def test_order_statistics(spark):
    pdf, df = hot_groups(spark)
    counts = df.groupBy("k", "v").agg(F.count("*").alias("n"))
    got = ordered.order_statistics(counts, ["k"], "v", "n", {"m": 0.5, "q": 0.9}).toPandas().set_index("k")
    want = pdf.groupby("k")["v"].quantile([0.5, 0.9]).unstack()
    np.testing.assert_allclose(got.loc[want.index, "m"].astype(float), want[0.5])
    np.testing.assert_allclose(got.loc[want.index, "q"].astype(float), want[0.9])


@pytest.mark.parametrize("parts", [1, 9])
def test_pairwise_correlation_with_nulls_and_constants(spark, parts):
    n = 400
    pdf = pd.DataFrame({"a": RNG.normal(1e6, 1, n), "b": RNG.normal(size=n), "c": np.full(n, 0.1)})
    pdf["d"] = np.where(RNG.random(n) < 0.5, np.nan, pdf["a"] * 2 + RNG.normal(size=n))
    df = spark.createDataFrame(pdf).repartition(parts)
    df = df.select(*[F.nanvl(c, F.lit(None)).alias(c) for c in df.columns])
    means = {c: float(pdf[c].mean()) for c in pdf}
    got = {(r["col_a"], r["col_b"]): r["value"] for r in pearson_pairs(df, list(pdf), means).collect()}
    want = pdf.corr()
    assert len(got) == 6
    for (x, y), v in got.items():
        if "c" in (x, y):
            assert v is None
        else:
            assert v == pytest.approx(want.loc[x, y], abs=1e-9)


def test_distinct_counts_keep_types_apart(spark):
    df = spark.sql("SELECT * FROM VALUES (9007199254740993L, 'a', 0.0D, NULL), (9007199254740992L, 'A', -0.0D, NULL), "
                   "(NULL, NULL, 1.5D, NULL) AS t(big, s, d, nothing)").withColumn("nothing", F.col("nothing").cast("int"))
    got = {r["column"]: (r["n_distinct"], r["top_n"], r["n_present"]) for r in
           distinct_counts(df, df.columns).collect()}
    assert got == {"big": (2, 1, 2), "s": (2, 1, 2), "d": (2, 2, 3)}


def test_row_keys_tell_null_positions_apart(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', NULL), (NULL, 'a'), ('a', NULL), ('', 'a') AS t(x, y)")
    assert df.select(digest(F.col("x"), F.col("y")).alias("k")).distinct().count() == 3
    row = duplicate_rows(df).first()
    assert (row["n_rows"], row["n_repeats"]) == (4, 1)


def test_monotonic_across_partitions(spark):
    n = 5000
    df = spark.range(n).select("id", (F.col("id") * 2).alias("up"), F.floor(F.col("id") / 100).alias("steps"),
                               F.when(F.col("id") == 2500, 0).otherwise(F.col("id")).alias("dip"),
                               F.when(F.col("id") != 7, F.col("id")).alias("hole")).repartition(11)
    got = dict(monotonic_increasing(df, ["up", "steps", "dip", "hole"], "id").collect())
    assert got == {"up": True, "steps": True, "dip": False, "hole": False}


def test_token_rule(spark):
    row = spark.createDataFrame([("<b>Don't</b> stop-now, x1 Été! ok",)], "t string")
    assert row.select(tokens(F.col("t"))).first()[0] == ["été", "ok"]
    assert set(STRIP) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_heavy_keys_are_split_without_adaptive_execution(spark):
    """A third of the rows on one key, another third on null: no task of the join sees more than a part of them."""
    many = spark.range(60_000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 500)).alias("key"))
    one = many.select("key").distinct().where("key is not null and key != 'k7'").withColumn("v", F.length("key"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        for how in ("inner", "left", "left_semi", "left_anti"):
            got = split_join(many, one, ["key"], F.col("id"), how, rows_per_key=200)
            want = many.join(one, ["key"], how)
            assert got.columns == want.columns
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
            sizes = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
            # unsplit, 20,000 rows of a hot key meet in one partition
            assert how in ("left_semi", "left_anti") or sizes < 5000
    finally:
        for name in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert heavy_keys(many, ["key"], rows_per_key=50_000) is None


def test_gram_in_blocks(spark):
    rng = np.random.default_rng(5)
    p = 130                     # three blocks, the last one narrow
    x = rng.normal(size=(300, p))
    x[rng.random(x.shape) < 0.2] = np.nan
    names = [f"c{k}" for k in range(p)]
    df = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in r] for r in x], ", ".join(f"{c} double" for c in names))
    got = {(r.i, r.j): r for r in pair_sums(df.repartition(5), names, {}).collect()}
    assert len(got) == p * (p + 1) // 2
    m, z = ~np.isnan(x), np.nan_to_num(x)
    for (i, j), r in got.items():
        both = m[:, i] & m[:, j]
        want = [both.sum(), z[both, i].sum(), z[both, j].sum(), (z[both, i] ** 2).sum(), (z[both, j] ** 2).sum(), (z[:, i] * z[:, j]).sum()]
        assert np.allclose([r.n, r.sx, r.sy, r.sxx, r.syy, r.sxy], want), (i, j)


def test_missing_cooccurrence_of_many_columns(spark):
    rng = np.random.default_rng(6)
    p = 500
    null = rng.random((400, p)) < 0.3
    null[:, 7] = null[:, 450]
    null[:, 3] = False
    names = [f"c{k}" for k in range(p)]
    df = spark.createDataFrame([[None if v else 1 for v in r] for r in null.tolist()], ", ".join(f"{c} int" for c in names)).repartition(3)
    got = {(r.col_a, r.col_b): r.value for r in missing_cooccurrence(df, names).collect()}
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.corrcoef(null.T.astype(float))
    want = {(names[i], names[j]): r[i, j] for i in range(p) for j in range(i + 1, p) if abs(r[i, j]) >= 0.134111}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert got["c7", "c450"] == pytest.approx(1.0)
    assert missing_cooccurrence(df.limit(0), names[:3]).count() == 0


def test_term_counts_of_few_texts_at_a_time(spark):
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    from plumbline.plans import text_features as tf
    rng = np.random.default_rng(4)
    words = ["apple", "pear", "plum", "quince", "the", "of", "ab"]
    texts = [None, "", "plum", "the of", *(" ".join(rng.choice(words, rng.integers(0, 30))) for _ in range(1200))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    got = {r["id"]: {t["term"]: t["tf"] for t in r["terms"]} for r in tf.term_vectors(df, "id", "text").collect()}
    for i, text in enumerate(texts):
        kept = [w for w in (text or "").split() if w not in ("the", "of", "ab")]
        assert got[i] == Counter(kept + [f"{a} {b}" for a, b in zip(kept, kept[1:])])
    # weights are made for a bounded number of texts of an Arrow batch
    entry = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(1300)), pa.array([[{"term": "plum", "tf": 1}]] * 1300, entry)], ["key", "terms"])
    out = list(tf._weigh(pa.int64(), ["pear", "plum"], [0, 1], [1.0, 2.0])([batch]))
    assert max(b.num_rows for b in out) <= tf.TEXTS_AT_ONCE
    assert [k for b in out for k in b.column(0).to_pylist()] == list(range(1300))
    assert {w for b in out for w in b.column(3).to_pylist()} == {1.0}
