from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from drawlens.functions import scalars as S
from drawlens.operators import explore
from drawlens.sources import tables


def people(spark):
    return spark.createDataFrame([("a", "x", 1), ("b", "a", 2), ("a", "a", 3), (None, "c", 4), ("d", None, 5), (None, None, 6)], "member_id string, gk_id string, n int")


def test_any_field_and_where_ids_are_found(spark):
    ids = spark.createDataFrame([("a",), ("a",), ("c",), ("x",), ("zz",), (None,)], "id string")
    fields = ["member_id", "username", "gk_id"]
    assert sorted(r.n for r in tables.of_any(people(spark), ids, fields).collect()) == [1, 2, 3, 4]
    got = {r.id: (r.field, r.rows) for r in tables.found_in(people(spark), ids, fields).collect()}
    assert got == {"a": ("member_id", 3), "c": ("gk_id", 1), "x": ("gk_id", 1), "zz": (None, 0)}
    assert tables.of_any(people(spark), ids, ["username"]).count() == 0 == tables.of_any(people(spark), ids.limit(0), fields).count()
    assert {(r.field, r.rows) for r in tables.found_in(people(spark).limit(0), ids, fields).collect()} == {(None, 0)}
    assert tables.found_in(people(spark), ids, ["username"]).where("rows = 0 AND field IS NULL").count() == 4


def test_any_field_is_looked_up_by_equality(spark, capsys):
    tables.of_any(people(spark), people(spark).select("gk_id"), ["member_id", "gk_id"]).explain()
    plan = capsys.readouterr().out
    assert "ExistenceJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_distinct_rows(spark):
    df = spark.createDataFrame([(1, "u", 3), (1, "u", 1), (None, "u", 2), (None, "u", 2), (2, None, 9)], "a int, b string, t int")
    assert sorted((r.a or 0, r.t) for r in explore.distinct_rows(df, ["a", "zz", "b"], [F.asc("t")]).collect()) == [(0, 2), (1, 1), (2, 9)]
    assert explore.distinct_rows(df, ["zz"]).count() == 4 and explore.distinct_rows(df, ["b"]).count() == 2
    assert explore.distinct_rows(df.limit(0), ["a"], [F.asc("t")]).count() == 0


def test_times_in_utc_in_any_session_zone(spark):
    rows = [("2024-01-02 03:04:05",), ("2024-01-02T03:04:05.5+05:30",), ("2024-01-02 03:04:05Z",), ("2024-01-02 03:04:05 UTC",), ("2024-01-02",), ("2024-01-02 03:04",), ("2024-01-02T03:04+01",), ("nonsense",), ("",), (None,)]
    df = spark.createDataFrame(rows, "t string").coalesce(1)
    base = int(datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc).timestamp() * 1e6)
    want = [base, base + 500_000 - 19_800_000_000, base, base, base - 11_045_000_000, base - 5_000_000, base - 3_605_000_000, None, None, None]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert [r[0] for r in df.select(S.micros(S.utc_time(F.col("t")))).collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_windows_with_offsets(spark):
    bound = datetime(2024, 1, 2, 5, 0, tzinfo=timezone(timedelta(hours=5)))  # midnight in UTC
    for kind in ("timestamp", "timestamp_ntz", "date"):
        df = spark.sql(f"SELECT id, CAST(concat('2024-01-0', id, ' 00:00:00') AS {kind}) AS t FROM range(1, 5)")
        assert [r.id for r in tables.in_window(df, "t", bound, bound + timedelta(days=2)).collect()] == [2, 3]


def test_signals_by_type(spark):
    cases = {
        "string": [("' Confirmed '", True), ("'1'", True), ("'pending'", False), ("'nan'", False), ("''", False), ("'\\tyes\\n'", True), ("NULL", None)],
        "array<int>": [("array(1)", True), ("array()", False), ("array(NULL)", True), ("NULL", None)],
        "map<string,int>": [("map()", False), ("map('a', 1)", True), ("NULL", None)],
        "double": [("double('NaN')", None), ("0.0", False), ("-0.0", False), ("2.5", True), ("NULL", None)],
        "int": [("0", False), ("7", True), ("NULL", None)], "boolean": [("true", True), ("false", False), ("NULL", None)],
        "binary": [("X''", False), ("X'00'", True)], "struct<a:int>": [("named_struct('a', NULL)", True), ("NULL", None)], "date": [("DATE'2024-01-01'", True), ("NULL", None)],
    }
    for kind, values in cases.items():
        for value, want in values:
            df = spark.sql(f"SELECT CAST({value} AS {kind}) AS v")
            assert df.select(S.signal(F.col("v"), df.schema["v"].dataType)).first()[0] is want, (kind, value)


def test_extract_report(spark):
    draws = spark.createDataFrame([("a", 1, datetime(2024, 1, 1), [1]), ("a", 1, datetime(2024, 1, 3), [1, 2]), ("b", 2, None, []), (None, 3, None, [4])], "member_id string, draw_id long, ts timestamp_ntz, bets array<int>")
    labels = spark.createDataFrame([("a", 1), ("a", 1), ("c", 9), (None, 3)], "member_id string, draw_id long")
    r = explore.extract_report(draws, labels).first()
    assert (r.rows, r.members, r.no_time, r.min_bets, r.median_bets, r.max_bets, r.empty_rows) == (4, 2, 2, 0, 1.0, 2, 1)
    assert (r.labels, r.labelled_members, r.matched_rows, r.first_time, r.last_time) == (4, 2, 2, datetime(2024, 1, 1), datetime(2024, 1, 3))
    r = explore.extract_report(draws.limit(0), labels).first()
    assert (r.rows, r.matched_rows, r.median_bets) == (0, 0, None)
