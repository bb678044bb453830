from datetime import datetime

from pyspark.sql import functions as F

from drawlens.functions import scalars as S
from drawlens.operators import features, history

T = lambda h: datetime(2024, 1, 1, h)
SCHEMA = "member_id string, draw_id long, ts timestamp"


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_cutoff_removes_the_event_and_what_follows(spark):
    draws = spark.createDataFrame([("A", 1, T(1)), ("A", 2, T(2)), ("A", 3, T(3)), ("B", 4, T(1)), ("C", 5, T(1))], SCHEMA)
    labels = spark.createDataFrame([("A", 2), ("C", 5)], "member_id string, draw_id long")
    out = history.before_events(history.with_event_label(draws, labels))
    assert rows_of(out, "member_id", "draw_id", "event_fraud_flag") == [("A", 1, 1), ("B", 4, 0)]
    assert history.loss_summary(history.with_event_label(draws, labels), out).first().asDict() == {"fraud_player_count": 2, "dropped_positive_count": 1}


def test_first_event_comes_from_one_row(spark):
    draws = spark.createDataFrame([("A", 9000, T(1)), ("A", 100, T(2))], SCHEMA).withColumn("event_label", F.lit(1))
    assert rows_of(history.first_events(draws), "first_ts", "first_draw_id") == [(T(1), 9000)]
    assert rows_of(history.first_match_independent(draws), "first_draw_id") == [(100,)]


def test_null_draws_match_null_labels(spark):
    draws = spark.createDataFrame([("A", None, T(1)), ("B", None, T(1))], SCHEMA)
    labels = spark.createDataFrame([("A", None)], "member_id string, draw_id long")
    assert rows_of(history.with_event_label(draws, labels), "member_id", "event_label") == [("A", 1), ("B", 0)]
    assert draws.select(S.event_key(F.col("draw_id"), F.col("member_id")).alias("k")).first().k == "<NA>|A"


def test_gaps_follow_time_then_draw(spark):
    draws = spark.createDataFrame([("A", 2, T(2)), ("A", 1, T(1)), ("A", 3, None)], SCHEMA)
    assert {r.draw_id: r.inter_draw_seconds for r in history.with_gaps(draws).collect()} == {1: None, 2: 3600.0, 3: None}


def test_normalise_raw_records(spark):
    raw = spark.createDataFrame([(" gk1 ", "12.0", '[{"number":"1","bet_amount":5}]', "x", "5", '{"$date": "2024-01-01T00:00:00Z"}')], "member_id string, draw_id string, bets string, win_points string, total_bet_amount string, createdAt string")
    r = history.with_draw_features(history.normalise(raw)).first()
    assert (r.member_id, r.draw_id, r.win_points, r.net_result, r.session_id, r.ts) == ("GK1", 12, 0.0, -5.0, 0, datetime(2024, 1, 1))


def test_member_features_of_one_row_and_of_none(spark):
    raw = spark.createDataFrame([("A", 1, T(1), "7", 3, [("1", 2.0)], 2.0, 4.0)], "member_id string, draw_id long, ts timestamp, ccs_id string, session_id long, bets array<struct<number:string,bet_amount:double>>, total_bet_amount double, win_points double")
    full = features.member_features(history.with_gaps(history.with_draw_features(raw)))
    r = full.first()
    assert (r.draws_played, r.stake_std, r.avg_inter_draw_seconds, r.max_template_reuse, r.ccs_player_count, r.win_rate) == (1, 0.0, 0.0, 1, 1, 1.0)
    assert len(features.FEATURES) == 41 and all(r[c] is not None for c in features.FEATURES)
    assert features.member_features(history.with_gaps(history.with_draw_features(raw.limit(0)))).count() == 0


def test_scalars(spark):
    df = spark.createDataFrame([("007a0", "NaN", "1.5", "yes", "00"), ("abc", "3.0", "2", "none", "x")], "d string, n string, w string, t string, p string")
    out = df.select(S.digits(F.col("d")), S.number(F.col("n")), S.whole(F.col("w")), S.truthy(F.col("t")), S.position_order(F.col("p"))).collect()
    assert [tuple(r) for r in out] == [("70", None, None, True, 37), (None, 3.0, 2, False, 999)]
