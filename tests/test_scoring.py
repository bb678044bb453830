from datetime import datetime, timedelta

import pytest

from drawlens.operators import checks
from drawlens.plans import scoring
from drawlens.sources.stages import write_json
from drawlens.sources import tables


def test_train_score_lookup(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    bet = lambda m, i: [(str((m + i) % 37), float(1 + (m * 7 + i) % 5)) for _ in range(1)]
    rows = [(f"N{m:03}", m * 100 + i, t0 + timedelta(minutes=i * (m % 3 + 1)), str(m % 5), i // 5, bet(m, i), bet(m, i)[0][1], float((m + i) % 3)) for m in range(40) for i in range(12)]
    rows += [(f"F{m:03}", 9000 + m * 100 + i, t0 + timedelta(minutes=i), "F", i // 5, [("17", 45.0), ("18", 45.0)], 90.0, 81.0) for m in range(8) for i in range(20)]
    kind = "member_id string, draw_id long, ts timestamp, ccs_id string, session_id long, bets array<struct<number:string,bet_amount:double>>, total_bet_amount double, win_points double"
    raw = spark.createDataFrame(rows, kind)
    labels = spark.createDataFrame([(f"F{m:03}", 9000 + m * 100 + 15) for m in range(8)], "member_id string, draw_id long")
    facts = scoring.train(raw, labels, str(tmp_path / "run"), trees=10, min_rows=100)
    assert facts["members"] == 48 and facts["mode"] == "replay_eval" and facts["decision"]["metrics"]["lift"] >= 5
    bundle = scoring.Bundle.load(spark, str(tmp_path / "run" / "bundle.json"))
    again = scoring.score(scoring.prepare(raw, labels), bundle)
    stored = spark.read.parquet(str(tmp_path / "run" / "scored"))
    assert again.join(stored.withColumnRenamed("risk_score", "old"), "member_id").where("abs(risk_score - old) > 1e-9").count() == 0
    assert scoring.lookup(stored, " f001 ")["member_id"] == "F001" and scoring.lookup(stored, "zz")["status"] == "insufficient_data"
    assert not facts["decision"]["promoted"]  # 2 of 8 captured, so nothing is published
    write_json(spark, str(tmp_path / "run" / "current.json"), {"bundle": str(tmp_path / "run" / "bundle.json"), "scored": str(tmp_path / "run" / "scored")})
    published, manifest = scoring.current(spark, str(tmp_path / "run"))
    assert manifest["snapshot_status"] == "ready" and published.count() == 48
    write_json(spark, str(tmp_path / "bare" / "current.json"), {"bundle": "none", "scored": str(tmp_path / "nowhere")})
    empty, manifest = scoring.current(spark, str(tmp_path / "bare"))
    assert empty.count() == 0 and manifest["snapshot_status"] == "insufficient_data" and manifest["snapshot_reason"]
    with pytest.raises(FileNotFoundError):
        scoring.current(spark, str(tmp_path / "none"))
    with pytest.raises(checks.ValidationError):
        scoring.train(raw.limit(10), labels, str(tmp_path / "few"))
    assert stored.where("risk_score < 0 OR risk_score > 1.3").count() == 0


def test_streamed_activity_equals_batch(spark, sf_dir):
    from drawlens.streaming.activity import windowed_activity

    events = tables.table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    q = windowed_activity(stream).writeStream.outputMode("complete").format("memory").queryName("activity").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.start, r.user_id): r.rows for r in spark.table("activity").collect()}
    want = {(r.start, r.user_id): r.rows for r in windowed_activity(events).collect()}
    assert got == want and want
