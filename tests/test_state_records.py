import threading

import pytest
from pyspark.sql import functions as F

from drawlens.operators import features, history
from drawlens.operators.kept import Kept
from drawlens.plans import scoring
from drawlens.plans.queries import _marked, _members
from drawlens.sources import buckets, records, tables
from drawlens.sources.stages import entries, latest_json, publish_json, read_json, write_json


def test_batches_merge_into_one_pass(spark, tmp_path):
    rows = [(i % 7 if i % 11 else None, float(i % 5), f"v{i % (3 + i % 4)}" if i % 6 else None, i) for i in range(300)]
    df = spark.createDataFrame(rows, "who long, x double, v string, i long")
    state = Kept(str(tmp_path / "s"), ("who",), ("x",), ("i",), ("v", "x"))
    assert state.totals(spark) is None
    batches = [df.where(f"i % 4 = {b}") for b in range(4)]
    assert [state.absorb(batches[b], f"b{b}") for b in (0, 1, 1, 2)] == [True, True, False, True]
    before = sorted(map(str, state.totals(spark).collect()))
    assert not state.absorb(batches[2], "b2") and sorted(map(str, state.totals(spark).collect())) == before
    batches[3].groupBy("who").count().write.parquet(str(tmp_path / "s" / "values" / "b3"))  # a batch that broke off
    assert state.absorb(batches[3], "b3") and state.absorb(df.limit(0), "none")
    want = df.groupBy("who").agg(F.count("*").alias("rows"), F.sum("x").alias("sum_x"), F.min("i").alias("min_i"), F.max("i").alias("max_i"), F.count_distinct("v").alias("distinct_v"), F.count_distinct("x").alias("distinct_x"))
    got = state.totals(spark)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_totals_read_the_state_alone(spark, tmp_path):
    at = str(tmp_path / "input")
    spark.range(100).selectExpr("id % 3 AS g", "id AS x").write.parquet(at)
    state = Kept(str(tmp_path / "s"), ("g",), ("x",))
    state.absorb(spark.read.parquet(at), "one")
    assert {f.split("/")[-3] for f in state.totals(spark).inputFiles()} == {"totals"}


def test_staging_reads_its_input_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(f"m{i % 9}", i, [1, 2]) for i in range(50)] + [(None, 50, None)], "member_id string, i long, l array<int>").mapInArrow(count, "member_id string, i long, l array<int>")
    found = tables.stage(df, str(tmp_path / "w"), {str(tmp_path / "c"): "csv", str(tmp_path / "j"): "json"})
    assert found == {"rows": 51, "members": 9} and seen.value == 51
    assert spark.read.parquet(str(tmp_path / "w")).count() == 51 and spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 51 and spark.read.json(str(tmp_path / "j")).count() == 51
    with pytest.raises(tables.EmptyWindowError):
        tables.stage(df.where("i < 0"), str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).count() == 51  # what was there stays
    assert tables.stage(df.where("i < 10"), str(tmp_path / "w"))["rows"] == 10 and spark.read.parquet(str(tmp_path / "w")).count() == 10
    assert sorted(p.name for p in tmp_path.iterdir()) == ["c", "j", "w"]


def test_first_time_column_with_data(spark):
    df = spark.sql("SELECT 'a' AS member_id, CAST(NULL AS TIMESTAMP) AS t1, TIMESTAMP_NTZ '2024-01-02' AS t2, DATE '2024-02-01' AS t3")
    pick = lambda *c: tables.ingest_summary(df, list(c)).first()
    assert pick("none", "t1", "t2", "t3").time_column == "t2" and str(pick("t1", "t3", "t2").first_time) == "2024-02-01 00:00:00"
    assert pick("t1").time_column is None and pick("t1").rows == 1 and tables.ingest_summary(df.limit(0), ["t2"]).first().rows == 0


def test_publishing_is_never_missed(spark, tmp_path):
    at, found, stop = str(tmp_path / "current"), [], threading.Event()
    publish_json(spark, at, {"n": 0})

    def read():
        while not stop.is_set():
            found.append(latest_json(spark, at))

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(1, 31):
        publish_json(spark, at, {"n": n}, keep=2)
    stop.set()
    reader.join()
    numbers = [f["n"] for f in found]
    assert numbers == sorted(numbers) and len(numbers) > 5 and latest_json(spark, at) == {"n": 30}
    assert len(entries(spark, at)) == 2 and latest_json(spark, str(tmp_path / "none")) is None
    for n in range(3):
        write_json(spark, str(tmp_path / "x.json"), {"é": n})
        assert read_json(spark, str(tmp_path / "x.json")) == {"é": n}


def test_published_cohorts_are_whole(spark, tmp_path):
    at = str(tmp_path)
    bundle = scoring.Bundle((), (), scoring.models.Scaler((), (), ()), scoring.models.Forest(*[__import__("numpy").array([], dtype=object)] * 3, 1), scoring.models.Ellipsoid(*[__import__("numpy").zeros(0)] * 2), scoring.models.Centres(()), scoring.models.Logit((), 0.0), {})
    for n in (1, 2):
        spark.range(n).selectExpr("concat('m', id) AS member_id").write.mode("overwrite").parquet(f"{at}/scored")
        scoring.publish(spark, at, bundle)
        published, manifest = scoring.current(spark, at)
        assert published.count() == n and manifest["snapshot_status"] == "ready"
    spark.range(0).selectExpr("'x' AS member_id").write.mode("overwrite").parquet(f"{at}/scored")  # the next run's working copy
    assert scoring.current(spark, at)[0].count() == 2


def test_buckets_group_without_an_exchange(spark, sf_dir):
    rows = buckets.bucketed(_marked(spark, sf_dir), buckets=4)
    gaps = history.gaps_before_events(rows)
    assert "hashpartitioning(member_id" not in gaps._jdf.queryExecution().executedPlan().toString()
    kept = buckets.bucketed(gaps, buckets=4)
    for frame in (features.core_features(kept), features.session_features(kept), features.template_features(kept)):
        assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
    joined = features.core_features(kept).join(features.session_features(kept).hint("merge"), "member_id").join(features.template_features(kept).hint("merge"), "member_id")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()


def test_records_become_typed_columns(spark):
    texts = ['{"a": 1, "b": {"c": "x", "d.e": 2.5, "f": [1, 2]}}', '{"a": 2, "b": {"c": null}, "g": true}', "{broken", "", None, '{"a": "text"}', "[1]", '{"id": 9, "it\'s": 1}']
    df = spark.createDataFrame(list(enumerate(texts)), "id long, r string")
    out = records.typed(df.where("id NOT IN (5, 6)"), "r")
    kinds = dict(out.dtypes)
    assert set(kinds) == {"id", "a", "b.c", "b.d.e", "b.f", "g", "r.id", "it's"}
    assert kinds["a"] == "bigint" and kinds["b.c"] == "string" and kinds["g"] == "boolean" and kinds["b.f"] == "string"
    rows = {r[0]: r.asDict() for r in out.collect()}
    assert (rows[0]["a"], rows[0]["b.c"], float(rows[0]["b.d.e"]), rows[0]["b.f"]) == (1, "x", 2.5, "[1,2]")
    assert rows[1]["a"] == 2 and rows[1]["b.c"] is None and rows[1]["g"] is True and rows[7]["r.id"] == 9 and rows[7]["it's"] == 1
    assert all(rows[i]["a"] is None for i in (2, 3, 4))
    mixed = {r.id: r.a for r in records.typed(df.where("id IN (0, 5)"), "r").collect()}
    assert mixed == {0: "1", 5: '"text"'}
    assert records.typed(df.limit(0), "r").columns == ["id"] and records.leaves("OBJECT<`a,b`: BIGINT, c: OBJECT<d: ARRAY<OBJECT<x: STRING>>, e: DECIMAL(3,1)>>") == [(("a,b",), "BIGINT"), (("c", "d"), "ARRAY<OBJECT<x: STRING>>"), (("c", "e"), "DECIMAL(3,1)")]


def test_scorers_in_sql_are_those_of_the_frame(spark, sf_dir):
    members = _members(spark, sf_dir).cache()
    bundle = scoring.fit(members, trees=20)
    names = scoring.register(spark, bundle, "t_")
    frame = features.model_frame(members, bundle.log_columns, bundle.columns)
    frame.createOrReplaceTempView("t_frame")
    row = f"array({', '.join(bundle.columns)})"
    got = {r.member_id: r for r in spark.sql(f"SELECT member_id, {', '.join(f'{n}({row}) AS {n}' for n in names)}, t_risk_score(NULL) AS none, t_risk_score(transform({row}, x -> double('NaN'))) AS nan FROM t_frame").collect()}
    for r in scoring.score(members, bundle).collect():
        mine = got[r.member_id]
        assert mine.none is None and mine.nan is None
        assert all(abs(mine[f"t_{c}"] - r[c]) < 1e-9 for c in ("risk_score", "anomaly_score", "supervised_score", "iso_forest_score", "mahalanobis_distance"))
