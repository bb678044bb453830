import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from drawlens.ml import models
from drawlens.operators import features


def frame_of(spark, n=300, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    x[0] = 9
    y = (x[:, 0] + rng.normal(size=n) > 1).astype(int)
    return x, y, spark.createDataFrame(pd.DataFrame({"member_id": [f"M{i}" for i in range(n)], "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y}))


def test_scores(spark):
    x, y, df = frame_of(spark)
    v = F.array("a", "b", "c")
    d = df.select(models.fit_ellipsoid(df, v, 3).distance(v).alias("d")).toPandas().d.to_numpy()
    c = x - x.mean(axis=0)
    assert np.allclose(d, np.sqrt(np.einsum("ij,jk,ik->i", c, np.linalg.inv(np.cov(x.T)), c)))
    forest = models.fit_forest(df, v, "member_id", trees=30)
    s = df.select("member_id", forest.score(v).alias("s")).toPandas().set_index("member_id").s
    assert s.idxmax() == "M0" and ((s > 0) & (s < 1)).all()
    again = models.fit_forest(df.repartition(7), v, "member_id", trees=30)
    assert np.allclose(df.select(again.score(v).alias("s")).toPandas().s, s.to_numpy())
    p = df.select(models.fit_logit(df, v, "y").probability(v).alias("p")).toPandas().p.to_numpy()
    assert p[y == 1].mean() > p[y == 0].mean() + 0.2


def test_centres_and_axes(spark):
    _, _, df = frame_of(spark)
    v = F.array("a", "b", "c")
    centres = models.fit_centres(df, v, 2, tries=2)
    got = df.select(centres.cluster(v).alias("k"), centres.distance(v).alias("d")).toPandas()
    assert set(got.k) == {0, 1} and (got.d >= 0).all()
    axes = models.fit_axes(df, v, 2)
    assert all(max(a, key=abs) > 0 for a in axes.loadings)


def test_singular_covariance_and_folds(spark):
    _, y, df = frame_of(spark)
    v = F.array("a", F.col("a") * 2, F.lit(1.0))
    d = df.select(models.fit_ellipsoid(df, v, 3).distance(v).alias("d")).toPandas().d
    assert np.isfinite(d).all()
    out = models.out_of_fold(df, ["a", "b", "c"], "y", "member_id", 2).toPandas()
    assert sorted(out.member_id) == sorted(f"M{i}" for i in range(len(y))) and out.supervised_score_eval.between(0, 1).all()
    split = models.test_split(df, "y", "member_id").groupBy("y").agg(F.count("*").alias("n"), F.sum("is_test").alias("t")).collect()
    assert all(r.t == int(r.n * 0.3 + 0.5) for r in split)


def test_folds_are_exact_within_classes(spark):
    for positives, k in ((2, 2), (14, 5), (3, 3)):
        assert models.fold_count(positives) == k
        rows = [(f"M{i:04}", int(i < positives)) for i in range(230)]
        got = models.folds(spark.createDataFrame(rows, "member_id string, y int").repartition(7), "y", "member_id", k).collect()
        for y in (0, 1):
            sizes = [sum(r.fold == f and r.y == y for r in got) for f in range(k)]
            assert max(sizes) - min(sizes) <= 1 and sum(sizes) == sum(r[1] == y for r in rows)
        again = models.folds(spark.createDataFrame(rows[::-1], "member_id string, y int"), "y", "member_id", k).collect()
        assert {(r.member_id, r.fold) for r in got} == {(r.member_id, r.fold) for r in again}


def test_every_row_has_an_evaluation_score(spark):
    _, y, df = frame_of(spark, 120)
    out = models.evaluation_scores(df, ["a", "b", "c"], "y", "member_id").toPandas()
    assert sorted(out.member_id) == sorted(f"M{i}" for i in range(120)) and out.supervised_score_eval.between(0, 1).all() and out.is_test.sum() == sum(int((y == v).sum() * 0.3 + 0.5) for v in (0, 1))
    found = models.comparison_models(df, ["a", "b", "c"], "y", "member_id", trees=10).toPandas()
    assert len(found) == 9 and found.groupby("model").members.sum().eq(120).all() and found.recall.dropna().between(0, 1).all()


def test_frames_hold_no_infinities(spark):
    rows = [("a", float("inf"), float("-inf")), ("b", float("nan"), None), ("c", 3.0, 2.0)]
    got = features.model_frame(spark.createDataFrame(rows, "member_id string, total_staked double, avg_gini double")).orderBy("member_id").collect()
    assert [(r.total_staked, r.avg_gini) for r in got[:2]] == [(0.0, 0.0)] * 2 and np.isclose(got[2].total_staked, np.log(4)) and got[2].avg_gini == 2.0


def test_runs_of_k_means_take_no_more_tasks_than_their_bytes(spark):
    frame = spark.range(0, 400, 1, 64).select((F.col("id") % 4).cast("double").alias("a"), (F.col("id") % 2).cast("double").alias("b"))
    spark.sparkContext.setJobGroup("k-means", "")
    try:
        centres = models.fit_centres(frame, F.array("a", "b"), tries=2)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert np.allclose(centres.points, [(0, 0), (1, 1), (2, 0), (3, 1)])
    tracker = spark.sparkContext.statusTracker()
    stages = {i for j in tracker.getJobIdsForGroup("k-means") for i in tracker.getJobInfo(j).stageIds}
    tasks = [tracker.getStageInfo(i).numTasks for i in stages if tracker.getStageInfo(i)]
    assert len(tasks) > 4 and sum(n >= 64 for n in tasks) == 1  # the one that stores the vectors


def test_models_are_fitted_to_stored_rows(spark, sf_dir):
    from drawlens.plans import queries

    frame, _ = queries._frame(spark, sf_dir)
    assert all("/frame-" in path for path in frame.inputFiles())


def jobs_of(spark, group, run):
    spark.sparkContext.setJobGroup(group, "")
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_logits_are_at_the_minimum_after_few_passes(spark):
    x, y, df = frame_of(spark)
    x = np.column_stack((x, x[:, 0] * 3 + x[:, 1] * 1e-3))  # two columns that are nearly one
    df = df.withColumn("d", F.col("a") * 3 + F.col("b") * 1e-3)
    model, jobs = jobs_of(spark, "logit", lambda: models.fit_logit(df, F.array("a", "b", "c", "d"), "y"))
    w, z = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (1 - y).sum()), x @ model.weights + model.intercept
    miss = w * (1 / (1 + np.exp(-z)) - y)
    assert np.abs(x.T @ miss + np.array(model.weights) / 0.1).max() < 1e-7 and abs(miss.sum()) < 1e-7
    assert jobs <= 40


def test_models_of_all_folds_share_their_passes(spark):
    _, y, df = frame_of(spark, 120)
    out, jobs = jobs_of(spark, "folds", lambda: models.evaluation_scores(df, ["a", "b", "c"], "y", "member_id"))
    assert jobs <= 80 and out.count() == 120
    rows = models.folds(df, "y", "member_id", 3).toPandas()
    got = models.out_of_fold(df, ["a", "b", "c"], "y", "member_id", 3).toPandas().set_index("member_id").supervised_score_eval
    for i in range(3):  # as by a fit to each one's other folds alone
        rest = spark.createDataFrame(rows[rows.fold != i])
        scaler = models.fit_scaler(rest, ["a", "b", "c"])
        alone = spark.createDataFrame(rows[rows.fold == i]).select("member_id", models.fit_logit(rest, scaler.vector(), "y").probability(scaler.vector()).alias("p")).toPandas()
        assert np.allclose(got[alone.member_id], alone.p, atol=1e-9)


def test_scalers_of_parts_are_those_of_their_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(1e6, 1, (500, 2))
    rows = [(float(a), None if i % 3 else float(b), 0.1, None, i % 4) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, part int").repartition(5)
    found = models.fit_scalers(df, ["a", "b", "c", "d"], [F.lit(True), F.col("part") == 1, F.col("part") > 9])
    for scaler, mine in zip(found, (np.ones(500, bool), np.arange(500) % 4 == 1), strict=False):
        b = x[mine & (np.arange(500) % 3 == 0), 1]
        assert np.allclose(scaler.mean, (x[mine, 0].mean(), b.mean(), 0.1, 0), rtol=1e-13) and np.allclose(scaler.scale, (x[mine, 0].std(), b.std(), 1, 1), rtol=1e-9)
    assert found[2].mean == (0.0,) * 4 and found[2].scale == (1.0,) * 4


def test_rows_meet_trees_in_compiled_code(spark):
    _, _, df = frame_of(spark)
    found = models._candidates(df, F.array("a", "b", "c"), "member_id", 30, 0.1, 42)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and ") Generate explode" in plan
    few = {(r.member_id, r.tree) for r in found.collect()}
    every = df.select("member_id", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("t")).select("*", F.xxhash64("member_id", "t", F.lit(42)).alias("h")).collect()
    assert few == {(r.member_id, r.t) for r in every if r.h <= -(2**63) + 0.1 * 2**64} and 600 < len(few) < 1200


def test_an_audit_makes_its_draws_once(spark, sf_dir, monkeypatch):
    from drawlens.plans import queries

    names, keep = [], queries.stored
    monkeypatch.setattr(queries, "stored", lambda df, name: names.append(name) or keep(df, name))
    assert queries.QUERIES["recompute_audit"](spark, sf_dir).count() == 8 and names == ["marked"]
