"""Reports on a scored cohort: counters, history guards, tiers against labels, winners, shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlens.operators.ranking import quantiles, tier_distribution, with_ranks


class InsufficientHistory(ValueError):
    """Raised with the number of members whose history is too short to score."""


def member_counters(labelled: DataFrame, usable: DataFrame) -> DataFrame:
    """For each member: raw_history_rows, matched_event_rows and event_fraud_flag of labelled rows, and
    history_rows_used; a counter without rows is 0."""
    raw = labelled.groupBy("member_id").agg(F.count("*").alias("raw_history_rows"), F.sum(F.col("event_label").cast("long")).alias("matched_event_rows"), F.max(F.col("event_label").cast("int")).alias("event_fraud_flag"))
    used = usable.groupBy("member_id").agg(F.count("*").alias("history_rows_used"))
    return raw.join(used, "member_id", "left").fillna(0)


def enough_history(counters: DataFrame, draws: DataFrame, min_rows: int = 5, min_draws: int = 5) -> DataFrame:
    """counters with draws_played of draws (member_id, draws_played) and enough_history."""
    out = counters.join(draws.select("member_id", "draws_played"), "member_id", "left").fillna({"draws_played": 0})
    return out.withColumn("enough_history", (F.col("raw_history_rows") >= min_rows) & (F.col("draws_played") >= min_draws))


def require_history(counters: DataFrame, draws: DataFrame, min_rows: int = 5, min_draws: int = 5) -> DataFrame:
    """The same, but raises if a member's history is too short."""
    out = enough_history(counters, draws, min_rows, min_draws)
    short = out.where("NOT enough_history").count()
    if short:
        raise InsufficientHistory(f"{short} members have fewer than {min_rows} rows or {min_draws} draws")
    return out


def rate_by_tier(tiered: DataFrame, label: str) -> DataFrame:
    """For each tier: members, positives and their rate."""
    return tiered.groupBy("risk_tier").agg(F.count("*").alias("members"), F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)).alias("positives"), F.avg(F.col(label).cast("double")).alias("rate"))


def method_winner(scored: DataFrame, hybrid: str, others: list[str], label: str, shares: tuple[float, ...] = (0.05, 0.10, 0.20)) -> DataFrame:
    """For each share the positives at or above each score's own quantile, and HYBRID if the first score has no fewer
    than any other, else SINGLE."""
    scores = [hybrid, *others]
    cuts = {s: quantiles(scored, s, {f"q{i}": 1 - p for i, p in enumerate(shares)}).first() for s in scores}
    hits = lambda s, i: F.count_if((F.col(label) == 1) & (F.col(s) >= F.lit(cuts[s][f"q{i}"])))
    rows = [F.struct(F.lit(p).alias("share"), *(hits(s, i).alias(s) for s in scores)) for i, p in enumerate(shares)]
    out = scored.agg(F.array(*rows).alias("r")).select(F.inline("r"))
    return out.withColumn("winner", F.when(F.col(hybrid) >= F.greatest(*others) if len(others) > 1 else F.col(hybrid) >= F.col(others[0]), "HYBRID").otherwise("SINGLE"))


def label_percentiles(scored: DataFrame, score: str, label: str, key: str = "member_id") -> DataFrame:
    """For each positive: its score, the share of the cohort strictly below it, and whether that is below a half."""
    n = scored.where(F.col(score).isNotNull()).count()
    ranked = with_ranks(scored.select(key, score, label), score).where(F.col(label) == 1)
    # peers share one percentile, the mean of their ranks; what lies below is the smallest rank less one
    peers = scored.groupBy(F.col(score).alias("_s")).agg(F.count("*").alias("_k"))
    out = ranked.join(peers, F.col(score) == F.col("_s"))
    below = (F.lit(n) - F.col(f"{score}_rank") - F.col("_k") + 1) / F.lit(n)
    return out.select(key, score, below.alias("below"), (below < 0.5).alias("low"))


def contribution_shares(scored: DataFrame, weights: dict[str, float], total: str) -> DataFrame:
    """Adds <component>_share: the part of the total that each weighted component makes, to three places."""
    return scored.withColumns({f"{c}_share": F.round(F.try_divide(F.lit(w) * F.col(c), F.nullif(F.col(total), F.lit(0.0))), 3) for c, w in weights.items()})


def high_unlabelled(tiered: DataFrame, label: str, tier: str = "HIGH") -> DataFrame:
    """Members of a tier without a positive label."""
    return tiered.where((F.col("risk_tier") == tier) & (F.coalesce(F.col(label), F.lit(0)) == 0))


def matching_ids(df: DataFrame, part: str, key: str = "member_id") -> DataFrame:
    """Rows whose id contains a text, whatever its case and outer blanks."""
    return df.where(F.contains(F.col(key), F.lit(part.strip().upper())))


def without(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """df without those of the columns that it has."""
    return df.drop(*columns)


def cohort_summary(tiered: DataFrame, score: str, label: str) -> DataFrame:
    """One row: mode, members, positives, members of each tier, mean, median and 95 % quantile of the score."""
    q = quantiles(tiered, score, {"median": 0.5, "p95": 0.95}).first()
    tiers = {r.risk_tier: r.members for r in tier_distribution(tiered).collect()}
    out = tiered.agg(F.count("*").alias("members"), F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)).alias("positives"), F.avg(score).alias("mean_score"))
    mode = F.when(F.col("positives") > 0, "replay_eval").otherwise("live_unlabelled")
    return out.select(mode.alias("mode"), "*", *(F.lit(tiers[t]).cast("long").alias(t.lower()) for t in ("LOW", "MEDIUM", "HIGH")), F.lit(q["median"]).alias("median_score"), F.lit(q.p95).alias("p95_score"))


def spread_ratio(df: DataFrame, column: str, label: str) -> DataFrame:
    """One row: the column's deviation among positives and among negatives, and their ratio."""
    side = lambda v: F.stddev_samp(F.when(F.col(label) == v, F.col(column)))
    out = df.agg(side(1).alias("std_positive"), side(0).alias("std_negative"))
    return out.withColumn("ratio", F.try_divide("std_positive", F.nullif("std_negative", F.lit(0.0))))


def metric_regression(now: DataFrame, stored: DataFrame, key: list[str], metrics: list[str], tolerance: float = 0.02) -> DataFrame:
    """For each key and metric: the value now, the stored one, and whether it fell by no more than the tolerance."""
    tall = lambda df, name: df.select(*key, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics))).alias("m")).select(*key, "m.*")
    met = tall(now, "value").join(tall(stored, "stored"), [*key, "metric"])
    return met.withColumn("passed", F.col("value") >= F.col("stored") - F.lit(tolerance))
