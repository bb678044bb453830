import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from drawlens.functions import scalars
from drawlens.operators import checks, explore, metrics, ranking
from drawlens.operators import cohort as reports


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(1)
    return pd.DataFrame({"member_id": [f"M{i:04}" for i in range(400)], "risk_score": np.round(rng.uniform(0, 1, 400), 2), "label": (rng.uniform(0, 1, 400) < 0.1).astype(int), "draws_played": rng.integers(0, 30, 400)})


def test_ranks_match_pandas(spark, cohort):
    got = ranking.with_ranks(spark.createDataFrame(cohort), "risk_score").toPandas().sort_values("member_id")
    assert (got.risk_score_rank.to_numpy() == cohort.risk_score.rank(method="min", ascending=False).to_numpy()).all()
    assert np.allclose(got.risk_score_percentile, cohort.risk_score.rank(pct=True))


def test_tiers_and_queue(spark, cohort):
    df = ranking.with_tiers(spark.createDataFrame(cohort))
    p80, p95 = cohort.risk_score.quantile([0.8, 0.95])
    want = np.where(cohort.risk_score <= p80, "LOW", np.where(cohort.risk_score <= p95, "MEDIUM", "HIGH"))
    assert (df.toPandas().sort_values("member_id").risk_tier.to_numpy() == want).all()
    assert {r.risk_tier for r in ranking.tier_distribution(df.where("risk_tier = 'LOW'")).collect()} == {"LOW", "MEDIUM", "HIGH"}
    queue = ranking.alert_queue(df, 10, 10).collect()
    assert len(queue) == 10 and all(r.draws_played >= 10 for r in queue)


def test_capture_counts_ties_by_key(spark, cohort):
    got = metrics.capture_topk(spark.createDataFrame(cohort), ["risk_score"], "label", "member_id", (0.05, 0.2), (50, 5000)).toPandas()
    order = cohort.sort_values(["risk_score", "member_id"], ascending=[False, True])
    for r in got.itertuples():
        hit = order.head(r.k).label.sum()
        assert r.captured == hit and np.isclose(r.precision, hit / r.k) and np.isclose(r.lift, hit / r.k / cohort.label.mean())
    assert got.set_index("bucket").k["top_5000"] == 400


def test_no_positives_give_zero(spark, cohort):
    got = metrics.capture_topk(spark.createDataFrame(cohort.assign(label=0)), ["risk_score"], "label", "member_id").toPandas()
    assert (got.lift == 0).all() and (got.capture_rate == 0).all()
    assert not metrics.gate(spark.createDataFrame(got)).first().passed


def test_auc_ap_ks_with_ties(spark, cohort):
    r = metrics.ranking_metrics(spark.createDataFrame(cohort), "risk_score", "label").first()
    s, y = cohort.risk_score.to_numpy(), cohort.label.to_numpy()
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    cuts = np.unique(s)[::-1]
    precision, recall = np.array([y[s >= c].mean() for c in cuts]), np.array([y[s >= c].sum() / y.sum() for c in cuts])
    ap = (np.diff(np.concatenate(([0], recall))) * precision).sum()
    assert np.isclose(r.roc_auc, auc) and np.isclose(r.average_precision, ap)
    assert np.isclose(r.ks, max(abs((pos >= c).mean() - (neg >= c).mean()) for c in cuts))


def test_drift_distance(spark):
    a, b = np.arange(100.0), np.arange(100.0) + 10
    frames = [spark.createDataFrame(pd.DataFrame({"x": v})) for v in (a, b)]
    r = metrics.drift(*frames, ["x"]).first()
    assert np.isclose(r.wasserstein, 10) and np.isclose(r.ks, 0.1) and not r.drifted
    assert metrics.drift_summary(metrics.drift(frames[0], frames[1].select((F.col("x") + 500).alias("x")), ["x"])).first().drift_detected


def test_sample_keeps_positives(spark):
    df = spark.createDataFrame([(i, int(i < 5)) for i in range(20)], "id int, y int")
    got = explore.stratified_sample(df, "y", 6, F.col("id")).collect()
    assert sum(r.y for r in got) == 5 and len(got) == 6
    assert explore.stratified_sample(df, "y", 3, F.col("id")).agg(F.min("y")).first()[0] == 1


def test_sample_keeps_positives_beyond_its_size(spark):
    df = spark.createDataFrame([(i if i < 19 else None, int(i < 5)) for i in range(20)], "id int, y int")
    assert sorted(r.id for r in explore.stratified_sample(df, "y", 3, F.asc_nulls_last("id")).collect()) == [0, 1, 2, 3, 4]
    assert sorted(r.id for r in explore.stratified_sample(df, "y", 6, F.asc_nulls_last("id")).collect()) == [0, 1, 2, 3, 4, 5]


def test_scores_are_made_once(spark):
    from drawlens.operators import ranking

    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(x):
        made.add(1)
        return float(x % 50)

    rows = spark.range(100).select("id", score.asNondeterministic()("id").alias("s"))
    assert np.isclose(ranking.quantiles(rows, "s", {"a": 0.8}).first().a, 39.2) and made.value == 100
    ranked = ranking.with_ranks(rows, "s").collect()
    assert {r.s_rank for r in ranked} == set(range(1, 101, 2)) and made.value == 300  # for the ranks, and to bear them


def test_validation(spark):
    good = spark.createDataFrame([("A", 1, 1.0, 0.0, "[]", "2024-01-01")], "member_id string, draw_id long, total_bet_amount double, win_points double, bets string, ts string")
    assert checks.validate(good, ["DRAW_ID ", "member_id"], min_rows=1).where("passed").count() == 7
    for bad, name in ((good.drop("bets"), "required_columns"), (good.limit(0), "min_row_count"), (good.withColumn("bets", F.lit("{")), "bets_parse"), (good.withColumn("ts", F.lit("?")), "time_parses")):
        with pytest.raises(checks.ValidationError, match=name):
            checks.validate(bad, ["draw_id", "member_id"], min_rows=1)


def test_monitoring_goes_on_without_a_report(spark):
    a = spark.createDataFrame([(i, float(i), float(i % 5)) for i in range(200)], "id int, risk_score double, anomaly_score double")
    b = a.withColumn("risk_score", F.col("risk_score") + 90)
    assert metrics.score_columns(a, b) == ["risk_score", "anomaly_score"] and metrics.score_columns(a.withColumn("hybrid_score", F.lit(1)), b.withColumn("hybrid_score", F.lit(1))) == ["hybrid_score"]
    got = metrics.monitored({"prediction": lambda: metrics.prediction_drift(a, b), "features": lambda: spark.read.parquet("/no/such/place")})
    assert got["reports"]["prediction"]["drifted_columns"] == 1 and "features" in got["errors"] and got["overall_drift_detected"] and got["average_drift_share"] == 0.5
    with pytest.raises(ValueError):
        metrics.prediction_drift(a.select("id"), b.select("id"))
    found = {r.feature: r for r in metrics.drift(a, b, ["risk_score", "anomaly_score"]).collect()}
    assert np.isclose(found["risk_score"].wasserstein, 90) and np.isclose(found["risk_score"].ks, 0.45) and found["anomaly_score"].wasserstein == 0 and found["anomaly_score"].p_value == 1
    assert found["risk_score"].p_value < 1e-6


def test_quantiles_and_positions_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate((rng.integers(0, 9, 500).astype(float), rng.normal(size=333)))
    df = spark.createDataFrame([(i, float(v), int(i % 3 == 0)) for i, v in enumerate(x)] + [(-1, None, 0)], "id int, v double, g int").repartition(5)
    q = ranking.quantiles(df, "v", {"a": 0.0, "b": 0.333, "c": 0.5, "d": 0.95, "e": 1.0}).first()
    assert np.allclose([q.a, q.b, q.c, q.d, q.e], np.quantile(x, [0, 0.333, 0.5, 0.95, 1]))
    assert ranking.quantiles(df.limit(0), "v", {"a": 0.5}).first().a is None
    got = {r.id: r.position for r in ranking.positions(df, ["g"], [F.col("v"), F.col("id")]).collect()}
    rows = sorted(df.collect(), key=lambda r: (r.g, r.v is not None, r.v or 0, r.id))
    for g in (0, 1):
        assert [got[r.id] for r in rows if r.g == g] == list(range(sum(r.g == g for r in rows)))


def test_history_guard(spark):
    counters = spark.createDataFrame([("a", 9, 9), ("b", 3, 3)], "member_id string, raw_history_rows long, history_rows_used long")
    draws = spark.createDataFrame([("a", 7)], "member_id string, draws_played long")
    assert [r.enough_history for r in reports.enough_history(counters, draws).orderBy("member_id").collect()] == [True, False]
    with pytest.raises(reports.InsufficientHistory):
        reports.require_history(counters, draws)
    with pytest.raises(ValueError):
        scalars.binned(F.lit(1), [0, 1], ["a", "b"])
