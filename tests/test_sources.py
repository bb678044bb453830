from datetime import datetime

import pytest
from pyspark.sql import functions as F

from drawlens.sources import tables


@pytest.fixture
def days(spark):
    return spark.createDataFrame([("A", datetime(2024, 1, 1)), ("B", datetime(2024, 1, 2)), ("C", datetime(2024, 1, 3)), ("D", None)], "member_id string, trans_date timestamp")


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_window_is_half_open(days, kind):
    df = days.withColumn("trans_date", F.col("trans_date").cast(kind))
    assert [r.member_id for r in tables.in_window(df, "trans_date", datetime(2024, 1, 2), datetime(2024, 1, 3)).collect()] == ["B"]


def test_window_reaches_the_scan(spark, days, tmp_path, capsys):
    days.write.parquet(str(tmp_path / "d"))
    tables.in_window(spark.read.parquet(str(tmp_path / "d")), "trans_date", datetime(2024, 1, 2), None).explain("formatted")
    assert "GreaterThanOrEqual(trans_date" in capsys.readouterr().out


def test_strategies(spark, days):
    ids = spark.createDataFrame([(" b ",), ("zz",)], "id string")
    assert [r.member_id for r in tables.by_strategy(days, "member_list", {}, ids).collect()] == ["B"]
    now = datetime(2024, 1, 4)
    assert tables.by_strategy(days, "date_window", {"lookback_days": 2}, now=now).count() == 2
    for strategy, params in (("full_collection", {}), ("date_window", {}), ("member_list", {}), ("other", {})):
        with pytest.raises(ValueError):
            tables.by_strategy(days, strategy, params, now=now)
    with pytest.raises(TypeError):
        tables.in_window(days, "member_id", now, None)


def test_stage_refuses_empty_windows(days, tmp_path):
    assert tables.stage(days, str(tmp_path / "a")) == {"rows": 4, "members": 4}
    with pytest.raises(tables.EmptyWindowError):
        tables.stage(days.limit(0), str(tmp_path / "b"))
    assert not (tmp_path / "b").exists()


def test_labels_from_csv(spark, tmp_path):
    (tmp_path / "l.csv").write_text(" DATE ,DRAW_ID, Member_Id\n01/31/2024, 12 , gk00206537 \n")
    r = tables.read_labels(spark, str(tmp_path / "l.csv")).first()
    assert (r.member_id, r.draw_id, str(r.date)) == ("GK00206537", 12, "2024-01-31")


def test_shapes(spark):
    df = spark.createDataFrame([((1, (2, 3)), [1])], "a struct<x:int,y:struct<z:int,w:int>>, b array<int>")
    assert tables.flattened(df).columns == ["a.x", "a.y.z", "a.y.w", "b"]
    assert dict(tables.plain(df).dtypes) == {"a": "string", "b": "string"}
    assert tables.resolve_columns(df.withColumn("MemberName", F.lit(1)), ["member"]) == "MemberName"
    assert tables.conform(spark.createDataFrame([("x", "bad")], "member_id string, draw_id string")).first().draw_id is None


def test_bets_are_those_of_the_draws_in_tasks_of_their_number(spark, sf_dir):
    from drawlens.operators import explore

    held, flat = explore.bets_of(tables.draws(spark, sf_dir)), tables.bets(spark, sf_dir, per_task=100)
    assert held.exceptAll(flat).isEmpty() and flat.exceptAll(held).isEmpty()
    assert flat.rdd.getNumPartitions() >= flat.count() // 100


def test_buckets_grow_with_rows():
    from drawlens.sources import buckets

    assert [buckets.bucket_count(n) for n in (0, 2_000_000, 2_000_001, 54_000_000)] == [8, 8, 9, 216]
