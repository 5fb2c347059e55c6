import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from plumbline.ml import boosting
from plumbline.ml import features as ft
from plumbline.ml import readiness as rd
from plumbline.ml import supervised as sv
from plumbline.ml import unsupervised as us
from plumbline.operators.association import Target
from plumbline.operators.profile import Profile
from plumbline.plans.full_report import Report
from plumbline.plans.preprocess import PreprocessPlan
from plumbline.sources import sink, tables

RNG = np.random.default_rng(3)


def test_folds_are_balanced_inside_a_hot_label(spark):
    df = spark.range(9000).select(F.col("id").alias(ft.ROW), F.when(F.col("id") % 3 < 2, "hot").otherwise(
        (F.col("id") % 30).cast("string")).alias("y"))
    folded = ft.assign_folds(df, 3, "y", rows_per_group=1000, n_rows=9000)
    counts = folded.groupBy("y", "fold").count().toPandas().pivot(index="y", columns="fold", values="count")
    assert (counts.max(axis=1) - counts.min(axis=1)).max() <= 9     # one per salt at most
    assert folded.count() == 9000


def test_folds_of_many_salts_differ_by_one_row(spark):
    df = spark.range(20_000).select(F.col("id").alias(ft.ROW), F.when(F.col("id") % 5 < 3, "a").when(F.col("id") % 5 < 4, "b").alias("y"))
    folded = ft.assign_folds(df, 3, "y", rows_per_group=700, n_rows=20_000)
    counts = folded.fillna("null", "y").groupBy("y", "fold").count().toPandas().pivot(index="y", columns="fold", values="count")
    assert counts.loc["a"].tolist() == [4000, 4000, 4000] and counts.loc["b"].tolist() == counts.loc["null"].tolist() == [1333, 1334, 1333]
    assert folded.columns == [ft.ROW, "y", "fold"]
    plain = ft.assign_folds(df, 3, None, rows_per_group=700, n_rows=20_000).groupBy("fold").count().toPandas()["count"]
    assert sorted(plain) == [6666, 6667, 6667]


def test_unseen_and_null_categories(spark):
    train = spark.createDataFrame([("b", 1.0), ("a", None), (None, 3.0)], "c string, x double")
    test = spark.createDataFrame([("z", None), ("a", 5.0), (None, 1.0)], "c string, x double")
    enc = ft.FeatureEncoder(["x"], ["c"]).fit(train)
    got = {tuple(r) for r in enc.transform(test).select("c", "x").collect()}
    # codes in sorted order: NA 0, a 1, b 2
    assert got == {(-1.0, 2.0), (1.0, 5.0), (0.0, 1.0)}


def test_codes_by_shuffle_equal_codes_by_broadcast(spark, monkeypatch):
    df = spark.range(300).select(F.col("id"), (F.col("id") % 37).cast("string").alias("c"))
    enc = ft.FeatureEncoder([], ["c"]).fit(df)
    a = enc.transform(df).orderBy("id").toPandas()
    monkeypatch.setattr(ft, "BROADCAST_CODES", 0)
    b = enc.transform(df).orderBy("id").toPandas()
    pd.testing.assert_frame_equal(a, b)


@pytest.mark.parametrize("n", [600, 14_000])
def test_isolation_forest_finds_planted_outliers(spark, n):
    x = RNG.normal(size=(n, 3))
    x[:5] = 8 + RNG.normal(size=(5, 3))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc"))).withColumn(ft.ROW, F.monotonically_increasing_id())
    scores = us.isolation_scores(df, list("abc"), [ft.ROW, "a"])
    got = scores.toPandas()
    assert len(got) == n and got[got["a"] > 5]["is_anomaly"].all()
    assert got[got["a"] > 5]["score"].max() < got[got["a"].abs() < 0.5]["score"].min()
    assert us.isolation_scores(df, list("abc"), [ft.ROW, "a"]).agg(F.sum("score")).first()[0] == pytest.approx(
        got["score"].sum())


def test_clusters(spark):
    x = np.vstack([RNG.normal(0, 0.2, (100, 2)), RNG.normal(6, 0.2, (100, 2)), RNG.normal((0, 8), 0.2, (100, 2))])
    df = ft.with_vector(spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"])), ["a", "b"])
    got = us.clustering_diagnostics(df).filter("is_best").first()
    assert got["k"] == 3 and got["silhouette"] > 0.9


def test_mean_path():
    assert us.mean_path(1) == 0 and us.mean_path(2) == 1 and us.mean_path(256) == pytest.approx(10.244, abs=1e-3)


def test_planted_leakage(spark):
    df = spark.range(400).select((F.col("id") % 2).alias("y"), (F.col("id") % 2 * 5 + F.rand(1) * 0.01).alias("copy"),
                                 F.rand(2).alias("r"), (F.col("id") % 4).cast("string").alias("cat"))
    p, found = Profile(df, "y", numeric_measures=True), rd.Findings()
    row = rd.leakage_checks(p, found).first()
    # a pure category is 1 - p away from the overall shares, here one half: not near 1
    assert row["leakage_risk"] == 40 and row["suspicious"] == "copy"
    assert {r[1] for r in found.rows} == {"penalty"}


def test_two_class_target_codes(spark):
    df = spark.createDataFrame([("no",), ("yes",), ("yes",), (None,)], "y string")
    t = Target(df, "y")
    got = dict(t.with_numeric("c").select("y", "c").distinct().collect())
    assert got == {"no": 0.0, "yes": 1.0, None: None} and not t.arbitrary_codes


def test_readiness_scores_are_clamped():
    f = rd.Findings(trainability=-30)
    assert f.score() == 50
    f.leakage_risk = 100
    assert f.score() == 33
    assert [rd.score_tier(s) for s in (80, 79, 60, 59)] == ["good", "fair", "fair", "poor"]


def test_learning_dynamics_flags(spark):
    folds = spark.createDataFrame([(1, 0.9, 3, 0.1, 0.3, 0.001), (2, 0.5, 9, 0.1, 0.9, 0.002)],
                                  "fold int, score double, best_iteration int, train_loss double, val_loss double, "
                                  "improvement double")
    d = sv.learning_dynamics(folds).first()
    assert d["overfitting"] and d["underfitting"] and d["loss_floors_differ"] and d["unstable"]


def test_boosted_trees_learn_a_rule(spark):
    df = spark.range(600).select((F.rand(1)).alias("a"), F.rand(2).alias("b"), F.col("id"))
    df = df.withColumn("y", F.when(F.col("a") > 0.5, "up").otherwise("down")).drop("id")
    p = Profile(df, "y", numeric_measures=True)
    out = sv.baseline_probe(p, "classification", rd.Findings(), rounds=5)
    assert out["dynamics"].first()["mean_score"] > 0.95
    assert out["curves"].groupBy("fold").count().count() == 3


def test_many_classes_are_learned_like_few(spark):
    df = ft.with_vector(spark.range(900).select((F.col("id") % 24).cast("double").alias(sv.LABEL),
                                                (F.col("id") % 24 + 0.0).alias("x"), (F.col("id") % 7 == 0).alias("_val")), ["x"])
    fit = sv.boosted_fit(df, "classification", 24, rounds=3)
    assert fit["score"] > 0.9 and len(fit["val"]) == 3


def test_score_is_that_of_the_truncated_model(spark):
    df = spark.range(400).select(F.rand(1).alias("x"), (F.rand(2) > 0.5).cast("double").alias(sv.LABEL), (F.col("id") % 4 == 0).alias("_val"))
    data = ft.with_vector(df, ["x"])
    fit = sv.boosted_fit(data, "classification", 2, rounds=200)     # noise: the first rounds are the best
    assert fit["rounds"] < 200 and len(fit["val"]) == fit["best"] + 1 + sv.PATIENCE
    train = data.filter("not _val").withColumn("_one", F.col(sv.LABEL))
    model = GBTClassifier(featuresCol="features", labelCol="_one", maxIter=fit["best"] + 1, stepSize=0.1, maxDepth=5,
                             maxBins=64, seed=42).fit(train)
    assert fit["score"] == pytest.approx(sv.balanced_accuracy(model.transform(data.filter("_val"))).first()[0])


def test_boosting_goes_on_like_one_fit(spark):
    df = spark.range(500).select(F.rand(1).alias("x"), F.rand(2).alias("z"), (F.col("id") % 4 == 0).alias("_val"))
    data = ft.with_vector(df.withColumn(sv.LABEL, F.col("x") * F.col("x") + 0.1 * F.col("z")), ["x", "z"]).repartition(3).cache()
    grown = sv.Boosting(data, "regression", 0)
    grown.advance(3)
    grown.advance(4)
    assert grown.rounds == 7
    whole = GBTRegressor(labelCol=sv.LABEL, maxIter=7, stepSize=0.1, maxDepth=5, maxBins=64, seed=42).fit(data.filter("not _val"))
    for part, got in (("_val", grown.val_losses), ("not _val", grown.train_losses)):
        assert got == pytest.approx(whole.evaluateEachIteration(data.filter(part), "squared"))
    kept = GBTRegressor(labelCol=sv.LABEL, maxIter=int(np.argmin(grown.val_losses)) + 1, stepSize=0.1, maxDepth=5, maxBins=64,
                        seed=42).fit(data.filter("not _val"))
    want = sorted(r["prediction"] for r in kept.transform(data.filter("_val")).collect())
    assert sorted(r["prediction"] for r in grown.predictions().filter("_val").collect()) == pytest.approx(want)


def test_a_round_is_one_job_a_level(spark):
    df = spark.range(2000).select(F.rand(1).alias("x"), F.rand(2).alias("z"), (F.col("id") % 4 == 0).alias("_val"))
    model = sv.Boosting(ft.with_vector(df.withColumn(sv.LABEL, F.sin(9 * F.col("x")) + F.col("z")), ["x", "z"]), "regression", 0)
    sc = spark.sparkContext
    sc.setJobGroup("rounds", "rounds")
    model.advance(6)
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("rounds")) <= 6 * 5 + 6


def test_sums_by_shuffle_and_in_slices_grow_the_same_trees(spark, monkeypatch):
    df = spark.range(600).select((F.col("id") % 3).cast("double").alias(sv.LABEL), (F.rand(3) + F.col("id") % 3).alias("x"),
                                 F.rand(4).alias("z"), (F.col("id") % 5 == 0).alias("_val"))
    data, losses = ft.with_vector(df, ["x", "z"]).cache(), []
    for size in (None, 1):
        if size:
            monkeypatch.setattr(boosting, "TASK_BYTES", size)
            monkeypatch.setattr(boosting, "DRIVER_BYTES", size)
        model = sv.Boosting(data, "classification", 3)
        model.advance(2)
        losses.append(model.train_losses + model.val_losses)
    assert losses[0] == pytest.approx(losses[1])


def repeated(spark):
    """200,000 rows of 400 distinct ones, the first of them a third of all."""
    return spark.range(200_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 400).cast("double").alias("a"))


def test_copies_are_drawn_one_by_one(spark):
    df = repeated(spark)
    ids = ft.with_row_ids(df).cache()
    assert ids.count() == ids.select(ft.ROW).distinct().count() == 200_000
    want = None
    for n in (1, 5, 9):
        got = ft.with_row_ids(df.repartition(n)).agg(F.sum(F.xxhash64("a", ft.ROW).cast("decimal(38,0)"))).first()[0]
        assert want in (None, got)
        want = got
    pool = us.pool_of(ids.select(ft.ROW, F.array("a").alias("x")), 12_800, 42)
    drawn = {r["x"][0]: r["n"] for r in pool.groupBy("x").agg(F.count("*").alias("n")).collect()}
    assert sum(drawn.values()) == 12_800 and len(drawn) == 400
    assert drawn[0.0] == pytest.approx(12_800 * 66_833 / 200_000, rel=0.06)
    for run in range(3):
        assert ft.subsample(ids, run).count() == pytest.approx(160_000, rel=0.01)
    folds = ft.assign_folds(ids, 3, None, rows_per_group=20_000, n_rows=200_000)
    sizes = [r["count"] for r in folds.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 10
    salts = ids.groupBy(F.pmod(F.xxhash64(F.lit(43), F.col(ft.ROW)), F.lit(10))).count().agg(F.max("count")).first()[0]
    assert salts < 1.1 * 20_000


def test_anomalies_do_not_depend_on_partitions(spark):
    df = spark.range(3000).select((F.col("id") * 7).alias("key"), F.rand(3).alias("a"), (F.rand(4) * F.rand(5)).alias("b")).cache()
    rows = []
    for n in (1, 5):
        scaled, columns = us.unlabeled_features(Profile(df.repartition(n), numeric_measures=True), "key")
        trees = us.isolation_trees(scaled, columns, trees=5)
        assert trees.groupby("tree").size().size == 5
        rows.append(sorted((r["key"], round(r["score"], 9)) for r in us.isolation_scores(scaled, columns, ["key"], trees=5).collect()))
    assert rows[0] == rows[1] and len(rows[0]) == 3000


def test_critical_table_stops_early(spark):
    p = Profile(spark.range(5).select("id", F.lit(1).alias("y")), "y")
    out = sv.labeled_diagnostics(p)
    assert out["status"].first()["status"] == "failed" or out["status"].first()["status"] == "critical"


def test_preprocess_plan_uses_training_facts(spark):
    df = spark.range(200).select(
        F.col("id"), F.when(F.col("id") % 10 != 0, F.col("id") % 60 + 0.5).alias("x"), F.lit(4).alias("flat"),
        F.when(F.col("id") % 9 != 0, F.element_at(F.array(F.lit("u"), F.lit("v")), (F.col("id") % 2 + 1).cast("int")))
        .alias("c"))
    plan = PreprocessPlan.fit(Profile(df))
    assert plan.drop == ["flat", "id"] and set(plan.medians) == {"x"} and set(plan.modes) == {"c"}
    test = spark.createDataFrame([(1, None, 4, None), (2, 3.0, 4, "new")], "id int, x double, flat int, c string")
    got = plan.transform(test).toPandas()
    assert list(got.columns) == ["x", "c"] and got["c"].tolist() == [
        {"u": 0, "v": 1}[plan.modes["c"]], -1] and got["x"].iloc[0] == plan.medians["x"]


def test_csv_falls_back_to_latin1(spark, tmp_path):
    (tmp_path / "utf.csv").write_bytes("a,b\n1,é\n".encode("utf-8"))
    (tmp_path / "latin.csv").write_bytes("a,b\n1,é\n".encode("latin-1"))
    for name in ("utf.csv", "latin.csv"):
        assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / name)).collect()] == [(1, "é")]


def test_sink_writes_nulls_for_endless_numbers(spark, tmp_path):
    df = spark.sql("SELECT 1 AS a, double('NaN') AS b, double('inf') AS c, 2.5D AS d")
    sink.write_report({"one": df}, str(tmp_path))
    assert '"b":null,"c":null,"d":2.5' in spark.read.text(str(tmp_path / "one")).first()[0]


def test_bad_input_is_refused(spark):
    for args in (("labeled", None), ("other", None), ("labeled", "nope")):
        with pytest.raises(ValueError):
            tables.validate_input(spark.range(2), *args)
    with pytest.raises(ValueError):
        tables.validate_input(spark.range(0))


def test_a_failing_section_is_recorded(spark):
    r = Report(spark)
    r.add("bad", lambda: 1 / 0)
    r.add("good", lambda: spark.range(1))
    r.add("none", lambda: None)
    assert {x["section"]: x["status"] for x in r.status.collect()} == {"bad": "error", "good": "ok", "none": "skipped"}


def test_score_distribution(spark):
    scores = [-0.5, -0.31, -0.31, 0.0, 0.49, 0.5, 0.7, -0.9, None, float("nan")]
    got = us.score_distribution(spark.createDataFrame([(x,) for x in scores], "score double"), 10).orderBy("bin").collect()
    assert [r["n"] for r in got] == [2, 2, 0, 0, 0, 1, 0, 0, 0, 3]
    assert [r["bin_start"] for r in got] == pytest.approx([i / 10 - 0.5 for i in range(10)])
    none = us.score_distribution(spark.createDataFrame([], "score double"), 10)
    assert none.count() == 10 and none.agg(F.sum("n")).first()[0] == 0


def test_chunks_walk_through_trees_like_single_rows():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    x[::17, 2] = np.nan
    for seed in range(4):
        tree = pd.DataFrame(us._grow(0, np.nan_to_num(x[:256]), np.random.default_rng(seed)), columns=us.NODE).sort_values("node")
        rows, want = tree.to_dict("records"), []
        for row in x:
            at = rows[0]
            while at["feature"] >= 0:
                at = rows[at["left"] if row[at["feature"]] <= at["threshold"] else at["right"]]
            want.append(at["length"])
        assert us._depths(us._flat(tree), x.ravel(), np.arange(300) * 4).tolist() == want
    lone = pd.DataFrame(us._grow(0, x[:1], rng), columns=us.NODE)
    assert (us._depths(us._flat(lone), x.ravel(), np.arange(300) * 4) == lone["length"][0]).all()


def test_row_ids_number_only_what_repeats(spark, monkeypatch):
    values = [1, 2, 3, 3, 3, 4, 4, None, None, 5] * 3 + list(range(100, 150))
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(5)
    found = []
    for most in (1_000_000, 2):          # hashes of repeated rows broadcast, or joined by shuffle
        monkeypatch.setattr(ft, "BROADCAST_HASHES", most)
        found.append(sorted(r[ft.ROW] for r in ft.with_row_ids(df).collect()))
    numbers = pd.Series(values).groupby(pd.Series(values), dropna=False).cumcount() + 1
    plain = spark.createDataFrame([(None if pd.isna(v) else int(v), int(n)) for v, n in zip(values, numbers)], "v int, n long")
    want = sorted(r[0] for r in plain.select(F.xxhash64(F.xxhash64("v"), "n")).collect())
    assert found == [want, want] and len(set(want)) == len(values)
    once = ft.with_row_ids(spark.range(1000))
    assert "Window" not in once._jdf.queryExecution().toString()


def test_kmeans_gets_vectors_that_it_may_keep(spark, monkeypatch):
    seen = []

    class Watched(us.KMeans):
        def fit(self, data):
            seen.append((data.columns, data.storageLevel.useMemory))
            return super().fit(data)

    monkeypatch.setattr(us, "KMeans", Watched)
    rows = spark.range(60).selectExpr("id AS _rid", "cast(id % 2 * 10 + id / 60 AS double) AS a")
    data = ft.with_vector(rows, ["a"]).select(ft.ROW, "features").persist()
    try:
        assert us.silhouette(data, 2) > 0.9
    finally:
        data.unpersist()
    assert seen == [(["features"], False)]


def test_rounds_in_one_task_equal_rounds_by_jobs(spark, monkeypatch):
    df = spark.range(1200).select((F.col("id") % 3).cast("double").alias(sv.LABEL), (F.rand(3) + F.col("id") % 3).alias("x"),
                                  F.rand(4).alias("z"), (F.col("id") % 5).cast("double").alias("c"), (F.col("id") % 5 == 0).alias("_val"))
    data, sc = ft.with_vector(df, ["x", "z", "c"]).repartition(4).cache(), spark.sparkContext
    monkeypatch.setattr(boosting, "CHUNK", 100)
    for classes in (3, 0):
        found = []
        for held in (False, True):
            model = sv.Boosting(data, "classification" if classes else "regression", classes)
            assert model.held
            model.held = held
            name = f"rounds {classes} {held}"
            sc.setJobGroup(name, name)
            model.run(7, 15, 3)
            sc.setLocalProperty("spark.jobGroup.id", None)
            assert model.rounds == 7 and (not held or len(sc.statusTracker().getJobIdsForGroup(name)) == 1)
            found.append((model.train_losses + model.val_losses, sorted(r["prediction"] for r in model.predictions(True).collect())))
        assert found[0][0] == pytest.approx(found[1][0]) and found[0][1] == pytest.approx(found[1][1])


def test_a_table_of_several_tasks_is_held_by_one_for_all_rounds(spark, monkeypatch):
    df = spark.range(3000).select((F.rand(3) + F.rand(4) > 1).cast("double").alias(sv.LABEL), F.rand(3).alias("x"), F.rand(4).alias("z"),
                                  (F.col("id") % 7).cast("double").alias("c"), (F.col("id") % 3 == 0).alias("_val"))
    data, sc, found = ft.with_vector(df, ["x", "z", "c"]).repartition(4).cache(), spark.sparkContext, []
    monkeypatch.setattr(boosting, "TASK_ROWS", 1000)
    for size in (boosting.HELD_BYTES, 1000):
        monkeypatch.setattr(boosting, "HELD_BYTES", size)
        model = sv.Boosting(data, "classification", 2)
        assert model.tasks == 3 and model.held == (size > 1000)
        sc.setJobGroup(f"several {size}", "rounds")
        model.run(5, 15, 3)
        sc.setLocalProperty("spark.jobGroup.id", None)
        assert not model.held or len(sc.statusTracker().getJobIdsForGroup(f"several {size}")) == 1
        found.append(model.train_losses + model.val_losses)
    assert found[0] == pytest.approx(found[1])


def test_joint_histograms_give_those_of_each_feature():
    rng, bins = np.random.default_rng(6), [64, 5, 3, 64, 64, 25]
    x, y = np.stack([rng.integers(0, b, 5000) for b in bins]).astype(np.uint8), rng.integers(0, 2, 5000).astype(float)
    batch = [boosting._block(False, x[:, a:a + 700], y[a:a + 700], np.zeros((1, len(y[a:a + 700]))), []) for a in range(0, 5000, 700)]
    groups = boosting.joined(bins, boosting.JOINT_ROWS)
    assert sorted(sum(groups, [])) == list(range(6)) and len(groups) < 6 and len(boosting.joined(bins, 10)) == 6
    held = boosting._Held(batch, bins, [1], groups)
    held._residuals(0, True)
    counts, sums, squares = held._sums(1, 0, True).reshape(3, -1)
    t = np.where(y == 1, 1.0, -1.0)
    assert counts.tolist() == squares.tolist() == np.concatenate([np.bincount(x[j], minlength=b) for j, b in enumerate(bins)]).tolist()
    assert sums.tolist() == np.concatenate([np.bincount(x[j], t, b) for j, b in enumerate(bins)]).tolist()
