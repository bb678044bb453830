import json
from datetime import datetime, timedelta

import numpy as np
import pytest

from drawlens.operators import checks, features
from drawlens.plans import rebuild, scoring
from drawlens.sources import tables


@pytest.fixture(scope="module")
def draws(spark):
    t0 = datetime(2024, 1, 1)
    rng = np.random.default_rng(3)
    rows = []
    for m in range(40):
        for i in range(12):
            bets = [(str((m + i * k) % 37), float(rng.integers(1, 9))) for k in range(1, 2 + (m + i) % 3)]
            rows.append((f"N{m:03}", m * 100 + i, t0 + timedelta(minutes=i * (m % 3 + 1)), str(m % 5), i // 5, bets, sum(b for _, b in bets), float(rng.integers(0, 9))))
    for m in range(9):
        for i in range(15):
            rows.append((f"F{m:03}", 9000 + m * 100 + i, t0 + timedelta(minutes=i), "F", i // 5, [("17", 45.0), ("18", 45.0 + m)], 90.0 + m, 81.0))
    kind = "member_id string, draw_id long, ts timestamp, ccs_id string, session_id long, bets array<struct<number:string,bet_amount:double>>, total_bet_amount double, win_points double"
    labels = [(f"F{m:03}", 9000 + m * 100 + (10 if m else 0)) for m in range(9)]  # F000's first draw: nothing before it
    return spark.createDataFrame(rows, kind), spark.createDataFrame(labels, "member_id string, draw_id long")


@pytest.fixture(scope="module")
def run(spark, draws, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rebuild"))
    return path, rebuild.rebuild(*draws, path, trees=10, queue=7)


def test_three_parts(spark, run):
    path, record = run
    scored = spark.read.parquet(f"{path}/scored").toPandas()
    assert record["members"] == len(scored) == 48 and record["positives"] == 8 and record["dropped_positives"] == 1
    assert np.allclose(scored.risk_score, 0.6 * scored.anomaly_score + 0.4 * scored.supervised_score)
    assert np.allclose(scored.risk_score_eval, 0.6 * scored.anomaly_score + 0.4 * scored.supervised_score_eval)
    assert (scored.risk_rank == scored.risk_score.rank(ascending=False, method="min")).all()
    for c in ("risk", "anomaly", "supervised"):
        assert np.allclose(scored[f"{c}_percentile"], scored[f"{c}_score"].rank(pct=True))
    p80, p95 = scored.risk_score.quantile([0.8, 0.95])
    assert [t for t in scored.risk_tier] == ["LOW" if s <= p80 else "MEDIUM" if s <= p95 else "HIGH" for s in scored.risk_score]
    assert record["tiers"] == scored.risk_tier.value_counts().to_dict()
    assert set(features.FEATURES) <= set(scored.columns) and set(scored.source) == {"precomputed"}
    assert json.load(open(f"{path}/evaluation.json"))["members"] == 48


def test_coordinates_are_principal_axes(spark, run):
    path, _ = run
    scored = spark.read.parquet(f"{path}/scored").toPandas()
    for prefix, columns, logs in (("style_pc", features.STYLE, features.LOG_STYLE), ("pc", features.FEATURES, features.LOG_FEATURES)):
        x = np.column_stack([np.log1p(np.maximum(scored[c], 0)) if c in logs else scored[c] for c in columns]).astype(float)
        mean, sd = x.mean(axis=0), x.std(axis=0)
        x = (x - mean) / np.where(sd > 1e-9 * abs(mean), sd, 1)
        variance = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:2]
        got = scored[[f"{prefix}1", f"{prefix}2"]].to_numpy()
        assert np.allclose(got.var(axis=0, ddof=1), variance), prefix
        assert abs(np.corrcoef(got.T)[0, 1]) < 1e-6


def test_reports(spark, run):
    path, record = run
    scored = spark.read.parquet(f"{path}/scored").toPandas()
    read = lambda name: spark.read.option("header", True).option("inferSchema", True).csv(f"{path}/{name}").toPandas()
    queue = read("queue")
    assert list(queue.columns) == list(rebuild.QUEUE)
    assert list(queue.member_id) == list(scored.sort_values(["risk_score", "member_id"], ascending=[False, True]).member_id[:7])
    captured = read("capture")
    assert set(captured.score_type) == set(rebuild.CAPTURED) and len(captured) == len(record["capture"])
    top = scored.sort_values(["risk_score_eval", "member_id"], ascending=[False, True])
    for r in captured[captured.score_type == "combined_oos"].itertuples():
        assert r.captured == top.event_fraud_flag[: r.k].sum()
    weights = read("importance")
    assert set(weights.feature) == set(features.FEATURES) and weights.importance.is_monotonic_decreasing
    told = read("dictionary")
    assert set(told.feature) == set(scored.columns) and told.description.notna().all()


def test_refit_of_a_stored_cohort(spark, run, tmp_path):
    path, _ = run
    stored = spark.read.parquet(f"{path}/scored")
    bundle = rebuild.refit(stored, trees=10)
    frame = stored.toPandas()
    assert np.allclose([bundle.quantiles["p80"], bundle.quantiles["p95"]], frame.risk_score.quantile([0.8, 0.95]))
    again = scoring.score(stored, bundle).toPandas().set_index("member_id")
    same = frame.set_index("member_id").loc[again.index]
    for c in ("mahalanobis_distance", "supervised_score", "style_pc1", "style_pc2", "pc1"):
        assert np.allclose(again[c], same[c], atol=1e-4), c
    bundle.save(spark, str(tmp_path / "b.json"))
    loaded = scoring.Bundle.load(spark, str(tmp_path / "b.json"))
    assert loaded.style == bundle.style and loaded.axes == bundle.axes


def test_bundle_without_axes(spark, run, tmp_path):
    """Bundles stored before axes were kept, and members without the style columns, are scored without coordinates."""
    path, _ = run
    from drawlens.sources.stages import read_json, write_json

    old = {k: v for k, v in read_json(spark, f"{path}/bundle.json").items() if k not in ("axes", "style")}
    write_json(spark, str(tmp_path / "old.json"), old)
    scored = scoring.score(spark.read.parquet(f"{path}/scored"), scoring.Bundle.load(spark, str(tmp_path / "old.json")))
    assert not {"pc1", "style_pc1"} & set(scored.columns) and scored.count() == 48


def test_recompute_audit(spark):
    rows = [(i, float(i), float(i % 3), 1.0, None if i % 2 else float(i), "x") for i in range(20)]
    now = spark.createDataFrame(rows, "id long, same double, other double, flat double, gaps double, name string")
    saved = spark.createDataFrame([(i, 2.0 * i + 1, float((i * 7) % 5), 1.0, float(i)) for i in range(5, 30)], "id long, same double, other double, flat double, gaps double")
    got = {r["column"]: r for r in checks.recompute_audit(now, saved, "id").collect()}
    assert set(got) == {"same", "other", "flat", "gaps"} and got["same"].rows == 15
    assert got["same"].corr == pytest.approx(1) and not got["same"].low and got["gaps"].corr == pytest.approx(1)
    assert got["flat"].corr is None and got["flat"].low and got["other"].low
    assert "other" not in {r["column"] for r in checks.recompute_audit(now, saved, "id", but=("other",)).collect()}
    empty = checks.recompute_audit(now.where("false"), saved, "id").collect()
    assert all(r.rows == 0 and r.low for r in empty) and checks.recompute_audit(now.select("id"), saved, "id").isEmpty()


def test_column_report(spark):
    df = spark.createDataFrame([(1, None, "a", [1]), (2, 3.0, None, None)], "Player_Id long, WIN_points double, `createdAt.$date` string, bets array<int>")
    got = {r.role: (r.column, r.type, r.filled) for r in tables.column_report(df).collect()}
    assert got == {"member": ("Player_Id", "bigint", 2), "time": ("createdAt.$date", "string", 1), "round": (None, None, 0), "outcome": ("WIN_points", "double", 1), "bets": ("bets", "array<int>", 1), "bet_codes": (None, None, 0)}


def test_scaler_of_a_constant_in_fractions(spark):
    from drawlens.ml import models

    df = spark.createDataFrame([(0.1 + 0.2, float(i), 0.0, 1e-12 * i) for i in range(50)], "same double, x double, zero double, small double").repartition(7)
    scaler = models.fit_scaler(df, df.columns)
    assert scaler.scale[0] == 1 and scaler.scale[2] == 1
    assert scaler.scale[1] == pytest.approx(np.std(np.arange(50))) and scaler.scale[3] == pytest.approx(1e-12 * np.std(np.arange(50)))
