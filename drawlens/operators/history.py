"""From draw records to a leakage-free history: normalising, gaps, label match, cutoff."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlens.functions import bets as B
from drawlens.functions import scalars as S
from drawlens.operators.sequences import LARGE, along


def normalise(raw: DataFrame) -> DataFrame:
    """Typed draw records with ids in upper case, a UTC time ts, parsed bets and defaults for optional columns."""
    kinds = dict(raw.dtypes)
    get = lambda c, kind: F.col(c) if c in kinds else F.lit(None).cast(kind)
    parsed = B.parse_bets(F.col("bets")) if kinds["bets"] == "string" else F.col("bets")
    return raw.select(
        S.member_id(F.col("member_id")).alias("member_id"),
        S.whole(F.col("draw_id")).alias("draw_id"),
        S.first_time(raw).alias("ts"),
        get("ccs_id", "string").cast("string").alias("ccs_id"),
        F.coalesce(S.number(get("session_id", "long")).try_cast("long"), F.lit(0)).alias("session_id"),
        parsed.alias("bets"),
        S.or_zero(S.number(F.col("total_bet_amount"))).alias("total_bet_amount"),
        S.or_zero(S.number(F.col("win_points"))).alias("win_points"),
    )


def with_draw_features(draws: DataFrame) -> DataFrame:
    """Adds the in-draw features, net_result and bet_template to draws with typed bets."""
    staged = draws.withColumn("_all", B.amounts(F.col("bets"))).withColumn("_some", B.positive(F.col("_all")))
    staged = staged.withColumns({"_t": B.total(F.col("_all")), "_t_some": B.total(F.col("_some"))})
    staged = staged.withColumn("_mean", F.when(F.size("_some") > 0, F.col("_t_some") / F.size("_some")).otherwise(F.lit(0.0)))
    staged = staged.withColumns(B.draw_features(*map(F.col, ("_all", "_some", "_t", "_t_some", "_mean"))))
    return staged.withColumns({"net_result": F.col("win_points") - F.col("total_bet_amount"), "bet_template": B.template_key(F.col("bets"))}).drop("_all", "_some", "_t", "_t_some", "_mean")


def with_gaps(draws: DataFrame, large: int = LARGE) -> DataFrame:
    """Adds inter_draw_seconds: since the member's draw before, in order of (ts, draw_id)."""
    out = along(draws, ["member_id"], ["ts", "draw_id"], previous={"_before": "ts"}, large=large)
    return out.withColumn("inter_draw_seconds", S.seconds_between(F.col("ts"), F.col("_before"))).drop("_before")


def with_event_label(draws: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds event_label (0/1): whether (member_id, draw_id) is in labels; null draws match null draws."""
    keys = labels.select(F.col("member_id").alias("_m"), F.col("draw_id").alias("_d")).distinct().withColumn("_hit", F.lit(1))
    on = (F.col("member_id") == F.col("_m")) & F.col("draw_id").eqNullSafe(F.col("_d"))
    return draws.join(keys, on, "left").withColumn("event_label", F.coalesce("_hit", F.lit(0))).drop("_m", "_d", "_hit")


def first_events(labelled: DataFrame) -> DataFrame:
    """member_id, first_ts, first_draw_id of each member's first labelled draw; both from one row."""
    order = F.struct(F.col("ts").isNull(), "ts", F.col("draw_id").isNull(), "draw_id")
    first = labelled.where("event_label = 1").groupBy("member_id").agg(F.min_by(F.struct("ts", "draw_id"), order).alias("first"))
    return first.select("member_id", F.col("first.ts").alias("first_ts"), F.col("first.draw_id").alias("first_draw_id"))


def before_events(labelled: DataFrame) -> DataFrame:
    """Rows of members without an event, and of others those strictly before their first one. Adds event_fraud_flag."""
    first = first_events(labelled).withColumn("_is", F.lit(1))
    rows = labelled.join(first, "member_id", "left")
    before = F.when(F.col("first_ts").isNotNull(), F.col("ts") < F.col("first_ts")).otherwise(F.col("draw_id") < F.col("first_draw_id"))
    return rows.where(F.col("_is").isNull() | before).withColumn("event_fraud_flag", F.coalesce("_is", F.lit(0))).drop("first_ts", "first_draw_id", "_is")


def gaps_before_events(labelled: DataFrame, large: int = LARGE) -> DataFrame:
    """with_gaps and before_events in one pass: the member's first event is a value of the window that gives the gaps,
    so there is no join and one exchange by member."""
    event = F.when(F.col("event_label") == 1, F.struct(F.col("ts").isNull().alias("late"), F.col("ts").alias("ts"), F.col("draw_id").isNull().alias("none"), F.col("draw_id").alias("draw_id")))
    out = along(labelled, ["member_id"], ["ts", "draw_id"], previous={"_before": "ts"}, overall={"_event": (F.min, event)}, large=large)
    out = out.withColumns({"inter_draw_seconds": S.seconds_between(F.col("ts"), F.col("_before")), "event_fraud_flag": F.col("_event").isNotNull().cast("int")})
    before = F.when(F.col("_event.ts").isNotNull(), F.col("ts") < F.col("_event.ts")).otherwise(F.col("draw_id") < F.col("_event.draw_id"))
    return out.where(F.col("_event").isNull() | before).drop("_before", "_event")


def loss_summary(labelled: DataFrame, history: DataFrame) -> DataFrame:
    """One row: labelled members, and how many of them kept no history."""
    members = labelled.where("event_label = 1").select("member_id").distinct()
    kept = history.select("member_id").distinct().withColumn("_kept", F.lit(1))
    return members.join(kept, "member_id", "left").agg(F.count("*").alias("fraud_player_count"), F.count_if(F.col("_kept").isNull()).alias("dropped_positive_count"))


def first_match_independent(labelled: DataFrame) -> DataFrame:
    """The older rule for first events: smallest time and smallest draw on their own."""
    return labelled.where("event_label = 1").groupBy("member_id").agg(F.min("ts").alias("first_ts"), F.min("draw_id").alias("first_draw_id"))
