"""The member feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawlens.functions.scalars import finite, log_clip, ratio
from drawlens.operators.sequences import LARGE, distinct_counts, grouped_quantiles, large_groups, same

# Names and order of the model's features, the style features, and the columns on a log scale.
FEATURES = (
    "draws_played", "sessions_played", "active_days", "total_staked", "avg_stake_per_draw", "median_stake_per_draw", "stake_std",
    "max_stake_per_draw", "min_stake_per_draw", "avg_inter_draw_seconds", "std_inter_draw_seconds", "median_inter_draw_seconds",
    "min_inter_draw_seconds", "avg_nonzero_bets_per_draw", "median_nonzero_bets_per_draw", "avg_max_bet_share", "median_max_bet_share",
    "avg_bet_amount_std_in_draw", "avg_bet_amount_mean_in_draw", "avg_entropy", "entropy_std", "avg_gini", "gini_std", "avg_tiny_bet_ratio",
    "avg_position_coverage", "unique_templates", "avg_net_result", "median_net_result", "std_net_result", "total_net_result",
    "positive_draw_rate", "stake_cv", "template_reuse_ratio", "pnl_volatility", "win_rate", "draws_per_active_day", "avg_draws_per_session",
    "max_template_reuse", "ccs_player_count", "ccs_total_staked", "ccs_avg_bet",
)
STYLE = (
    "draws_played", "avg_stake_per_draw", "avg_nonzero_bets_per_draw", "avg_max_bet_share", "avg_entropy", "avg_gini", "avg_tiny_bet_ratio",
    "avg_position_coverage", "template_reuse_ratio", "max_template_reuse", "stake_cv", "avg_inter_draw_seconds", "positive_draw_rate",
)
LOG_FEATURES = (
    "total_staked", "avg_stake_per_draw", "median_stake_per_draw", "stake_std", "max_stake_per_draw", "stake_cv",
    "avg_bet_amount_std_in_draw", "avg_bet_amount_mean_in_draw", "std_net_result", "pnl_volatility",
)
LOG_STYLE = ("draws_played", "avg_stake_per_draw", "max_template_reuse", "avg_inter_draw_seconds")

#: What each statistic of a history column is called.
MEASURES = {
    "total_bet_amount": {"sum": "total_staked", "avg": "avg_stake_per_draw", "median": "median_stake_per_draw", "std": "stake_std", "max": "max_stake_per_draw", "min": "min_stake_per_draw"},
    "inter_draw_seconds": {"avg": "avg_inter_draw_seconds", "std": "std_inter_draw_seconds", "median": "median_inter_draw_seconds", "min": "min_inter_draw_seconds"},
    "nonzero_bets_per_draw": {"avg": "avg_nonzero_bets_per_draw", "median": "median_nonzero_bets_per_draw"},
    "max_bet_share_in_draw": {"avg": "avg_max_bet_share", "median": "median_max_bet_share"},
    "bet_amount_std_in_draw": {"avg": "avg_bet_amount_std_in_draw"},
    "bet_amount_mean_in_draw": {"avg": "avg_bet_amount_mean_in_draw"},
    "entropy_in_draw": {"avg": "avg_entropy", "std": "entropy_std"},
    "gini_in_draw": {"avg": "avg_gini", "std": "gini_std"},
    "tiny_bet_ratio_in_draw": {"avg": "avg_tiny_bet_ratio"},
    "position_coverage": {"avg": "avg_position_coverage"},
    "net_result": {"avg": "avg_net_result", "median": "median_net_result", "std": "std_net_result", "sum": "total_net_result"},
}
STATISTICS = {"sum": F.sum, "avg": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min}
DISTINCT = {"draws_played": "draw_id", "sessions_played": "session_id", "active_days": "_day", "unique_templates": "bet_template"}


def _sums(rows: DataFrame) -> list[Column]:
    """What is merged from partial results, so that no member's rows are held together."""
    return [
        *(F.coalesce(STATISTICS[s](c).cast("double"), F.lit(0.0)).alias(name) for c, names in MEASURES.items() for s, name in names.items() if s != "median"),
        F.avg(F.coalesce((F.col("net_result") > 0).cast("double"), F.lit(0.0))).alias("positive_draw_rate"),
        F.max("event_fraud_flag").alias("event_fraud_flag") if "event_fraud_flag" in rows.columns else F.lit(0).alias("event_fraud_flag"),
    ]


def _of_members(rows: DataFrame) -> DataFrame:
    """All in one grouping: for members whose rows (LARGE at most) a task may hold."""
    held = [F.coalesce(F.median(c).cast("double"), F.lit(0.0)).alias(names["median"]) for c, names in MEASURES.items() if "median" in names]
    sets = [F.size(F.collect_set(c)).cast("long").alias(n) for n, c in DISTINCT.items()]
    return rows.groupBy("member_id").agg(*sets, *held, *_sums(rows), F.mode("ccs_id", True).alias("primary_ccs_id"))


def _of_large_members(rows: DataFrame, large: int) -> DataFrame:
    """The same for members with more rows: medians by running counts, distinct values in two groupings."""
    medians = {names["median"]: (c, 0.5) for c, names in MEASURES.items() if "median" in names}
    out = rows.groupBy("member_id").agg(*_sums(rows)).join(grouped_quantiles(rows, ["member_id"], medians, large), "member_id", "left").fillna(0.0, list(medians))
    out = out.join(distinct_counts(rows, ["member_id"], DISTINCT), "member_id", "left")
    groups = rows.where("ccs_id IS NOT NULL").groupBy("member_id", "ccs_id").agg(F.count("*").alias("n"))
    return out.join(groups.groupBy("member_id").agg(F.min_by("ccs_id", F.struct(-F.col("n"), "ccs_id")).alias("primary_ccs_id")), "member_id", "left")


def core_features(history: DataFrame, large: int = LARGE) -> DataFrame:
    """Everything that grouping by member gives, with the ratios made of it. Members with more than `large` rows are
    grouped apart, in a way that holds none of them in one task."""
    rows, many = history.withColumn("_day", F.to_date("ts")), large_groups(history, ["member_id"], large)
    if many is None:
        out = _of_members(rows)
    else:
        few, much = (rows.join(many, same(["member_id"]), how) for how in ("left_anti", "left_semi"))
        out = _of_members(few).unionByName(_of_large_members(much, large))
    return out.withColumns(
        {
            "stake_cv": ratio(F.col("stake_std"), F.col("avg_stake_per_draw")),
            "template_reuse_ratio": F.when(F.col("draws_played") > 0, F.greatest(1 - F.col("unique_templates") / F.col("draws_played"), F.lit(0.0))).otherwise(0.0),
            "pnl_volatility": ratio(F.col("std_net_result"), F.col("avg_stake_per_draw")),
            "win_rate": F.col("positive_draw_rate"),
            "draws_per_active_day": ratio(F.col("draws_played"), F.col("active_days")),
        }
    )


def session_features(history: DataFrame) -> DataFrame:
    """member_id, avg_draws_per_session: mean over sessions of the distinct draws in each."""
    sessions = history.where("session_id IS NOT NULL").groupBy("member_id", "session_id").agg(F.countDistinct("draw_id").alias("n"))
    return sessions.groupBy("member_id").agg(F.avg("n").alias("avg_draws_per_session"))


def template_features(history: DataFrame) -> DataFrame:
    """member_id, max_template_reuse: how often the member's most frequent template occurs."""
    return history.where("bet_template IS NOT NULL").groupBy("member_id", "bet_template").count().groupBy("member_id").agg(F.max("count").alias("max_template_reuse"))


def ccs_features(history: DataFrame) -> DataFrame:
    """Per group: distinct members, total and mean stake, over all members (a group is never split)."""
    return history.where("ccs_id IS NOT NULL").groupBy("ccs_id").agg(
        F.countDistinct("member_id").alias("ccs_player_count"), F.coalesce(F.sum("total_bet_amount"), F.lit(0.0)).alias("ccs_total_staked"), F.coalesce(F.avg("total_bet_amount"), F.lit(0.0)).alias("ccs_avg_bet")
    )


def member_features(history: DataFrame, large: int = LARGE) -> DataFrame:
    """The 41 features with member_id, primary_ccs_id and event_fraud_flag.

    The first three groupings share one exchange by member; groups join by their id, small side first if Spark
    finds it small.
    """
    out = core_features(history, large).join(session_features(history), "member_id", "left").join(template_features(history), "member_id", "left")
    out = out.join(ccs_features(history).withColumnRenamed("ccs_id", "primary_ccs_id"), "primary_ccs_id", "left")
    filled = {"avg_draws_per_session": 1.0, "max_template_reuse": 1, "ccs_player_count": 0, "ccs_total_staked": 0.0, "ccs_avg_bet": 0.0}
    return out.fillna(filled).select("member_id", "primary_ccs_id", "event_fraud_flag", *FEATURES)


def model_value(c: str, log_columns: tuple[str, ...]) -> Column:
    """A feature as the models see it: a double without nulls, on a log scale if it is one of log_columns."""
    return log_clip(F.col(c)) if c in log_columns else F.coalesce(finite(F.col(c)), F.lit(0.0))


def model_frame(features: DataFrame, log_columns: tuple[str, ...] = LOG_FEATURES, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """member_id, event_fraud_flag and those of the columns that exist, as doubles without nulls, some on a log scale."""
    there = [c for c in columns if c in features.columns]
    keep = [c for c in ("member_id", "event_fraud_flag") if c in features.columns]
    return features.select(*keep, *(model_value(c, log_columns).alias(c) for c in there))


def scaled(frame: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """Columns less their mean over their population deviation (1 if that is 0)."""
    there = [c for c in columns if c in frame.columns]
    stats = frame.agg(*(F.avg(c).alias(f"m_{c}") for c in there), *(F.stddev_pop(c).alias(f"s_{c}") for c in there)).first()
    value = lambda c: ((F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0)).alias(c)
    return frame.select(*(c for c in frame.columns if c not in there), *map(value, there))
