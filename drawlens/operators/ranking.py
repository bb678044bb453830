"""Ranks, percentiles, tiers and queues over a scored cohort.

Global ranks need no single task: scores are first counted by distinct value, and running counts over the distinct
values come from range partitions (see running_counts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from drawlens.functions.scalars import tier
from drawlens.sources.stages import stored


def running_counts(groups: DataFrame, by: Column, sums: dict[str, str], ranges: int = 200, within: tuple[str, ...] = ()) -> DataFrame:
    """Adds, for each new: old in sums, the sum of old over the rows strictly before in order of by (and with the same
    values of within, which may take few values).

    groups has one row per value of by (and within). The values are cut in ranges by approximate quantiles; sums of
    whole ranges (a few rows) are accumulated in one task, and rows within a range in one task each.
    """
    if within:
        cuts = groups.groupBy(*within).agg(F.percentile_approx(by, [i / ranges for i in range(1, ranges)], 10_000).alias("_bounds"))
        rows = groups.withColumn("_by", by).join(F.broadcast(cuts), list(within))  # one row for each value of within
        rows = rows.withColumn("_part", F.size(F.filter("_bounds", lambda b: b <= F.col("_by")))).drop("_bounds")
        totals = rows.groupBy(*within, "_part").agg(*(F.sum(old).alias(f"_t_{new}") for new, old in sums.items()))
        before = W.partitionBy(*within).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
        totals = totals.select(*within, "_part", *(F.coalesce(F.sum(f"_t_{new}").over(before), F.lit(0)).alias(f"_t_{new}") for new in sums))
        inside = W.partitionBy(*within, "_part").orderBy("_by").rowsBetween(W.unboundedPreceding, -1)
        rows = rows.withColumns({new: F.coalesce(F.sum(old).over(inside), F.lit(0)) for new, old in sums.items()}).join(F.broadcast(totals), [*within, "_part"])
        return rows.withColumns({new: F.col(new) + F.col(f"_t_{new}") for new in sums}).drop("_part", "_by", *(f"_t_{new}" for new in sums))
    bounds = groups.agg(F.percentile_approx(by, [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
    bounds = sorted(set(bounds))
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= by)) if bounds else F.lit(0)
    rows = groups.withColumn("_part", part)
    totals = rows.groupBy("_part").agg(*(F.sum(old).alias(f"_t_{new}") for new, old in sums.items()))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("_part", *(F.coalesce(F.sum(f"_t_{new}").over(before), F.lit(0)).alias(f"_t_{new}") for new in sums))
    inside = W.partitionBy("_part").orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({new: F.coalesce(F.sum(old).over(inside), F.lit(0)) for new, old in sums.items()}).join(F.broadcast(totals), "_part")
    return rows.withColumns({new: F.col(new) + F.col(f"_t_{new}") for new in sums}).drop("_part", *(f"_t_{new}" for new in sums))


def with_ranks(scored: DataFrame, score: str) -> DataFrame:
    """Adds <score>_rank (descending, ties share the smallest) and <score>_percentile (ascending, ties share the mean);
    both null for a null score."""
    by = -F.col("_score")
    # stored, as it is read for the ranges' bounds, their sums, the number of all and the rows
    values = stored(scored.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("_score")).agg(F.count("*").alias("_peers")), "values")
    n = F.lit(values.agg(F.sum("_peers")).first()[0] or 0)
    placed = running_counts(values, by, {"_above": "_peers"})
    placed = placed.select("_score", (F.col("_above") + 1).alias(f"{score}_rank"), ((n - F.col("_above") - F.col("_peers") + 1 + (F.col("_peers") - 1) / 2) / n).alias(f"{score}_percentile"))
    return scored.join(placed, F.col(score).cast("double") == F.col("_score"), "left").drop("_score")


def quantiles(scored: DataFrame, score: str, points: dict[str, float]) -> DataFrame:
    """One row: exact quantiles with linear interpolation (null for an empty column).

    Each is read off the counts of distinct values below, so no task holds all values.
    """
    x = F.col(score).cast("double")
    values = stored(scored.where(x.isNotNull() & ~F.isnan(x)).groupBy(x.alias("_v")).agg(F.count("*").alias("_k")), "values")
    placed = running_counts(values, F.col("_v"), {"_before": "_k"})
    n = values.agg(F.sum("_k")).first()[0] or 0

    def at(rank: int) -> Column:
        return F.max(F.when((F.col("_before") <= rank) & (F.col("_before") + F.col("_k") > rank), F.col("_v")))

    found = []
    for name, p in points.items():
        place = p * (n - 1)
        low = min(max(int(place), 0), max(n - 1, 0))
        found.append((at(low) + (at(min(low + 1, max(n - 1, 0))) - at(low)) * F.lit(float(place - low))).alias(name))
    return placed.agg(*found)


def positions(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Adds position (from 0) in the given order among the rows with the same values of by.

    Rows are range-partitioned by both and counted by partition and group, so no group has to fit in one task.
    """
    rows = stored(df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("_at", 33)
    starts = rows.groupBy(*by, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row for each partition of a group
    starts = starts.select(*(F.col(c).alias(f"_b_{c}") for c in by), "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    met = [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in by]
    out = rows.withColumn("_p", part).join(starts, [*met, F.col("_p") == F.col("_part")]).withColumn("position", F.col("_at") + F.col("_shift"))
    return out.select(*df.columns, "position")


def with_tiers(scored: DataFrame, score: str = "risk_score", p80: float = 0.80, p95: float = 0.95) -> DataFrame:
    """Adds risk_tier from the cohort's own quantiles."""
    q = quantiles(scored, score, {"a": p80, "b": p95}).first()
    return scored.withColumn("risk_tier", F.when(F.col(score).isNotNull(), tier(F.col(score), F.lit(q.a), F.lit(q.b))))


def tier_distribution(scored: DataFrame) -> DataFrame:
    """Members by tier, with a row for each tier."""
    tiers = scored.sparkSession.createDataFrame([("LOW",), ("MEDIUM",), ("HIGH",)], "risk_tier string")
    return tiers.join(scored.groupBy("risk_tier").count(), "risk_tier", "left").select("risk_tier", F.coalesce("count", F.lit(0)).alias("members"))


def alert_queue(scored: DataFrame, size: int = 50, min_draws: int | None = None, score: str = "risk_score", key: str = "member_id") -> DataFrame:
    """The highest scores, ties by id; with min_draws only of members with so many draws, if draws_played exists."""
    if min_draws is not None and "draws_played" in scored.columns:
        scored = scored.where(F.col("draws_played") >= min_draws)
    return scored.orderBy(F.desc_nulls_last(score), key).limit(size)


def eligible(scored: DataFrame, rows: int = 5, draws: int = 5) -> DataFrame:
    return scored.where((F.col("raw_rows") >= rows) & (F.col("draws_played") >= draws))


def top_per_key(df: DataFrame, key: list[str], order: list[Column], n: int = 1) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def profile_of(cohort: DataFrame, key: str, who: str, columns: list[str]) -> DataFrame:
    """For one member and each column: value, share of the cohort strictly below, share at or below, rank from the top."""
    me = cohort.where(F.col(key) == who).limit(1).select(*(F.col(c).cast("double").alias(c) for c in columns)).first()
    if me is None:
        return cohort.sparkSession.createDataFrame([], "feature string, value double, below double, at_or_below double, rank long")
    stats = [
        F.struct(F.lit(c).alias("feature"), F.lit(me[c]).alias("value"), F.avg((F.col(c) < me[c]).cast("double")).alias("below"), F.avg((F.col(c) <= me[c]).cast("double")).alias("at_or_below"), (F.count_if(F.col(c) > me[c]) + 1).alias("rank"))
        for c in columns if me[c] is not None
    ]
    return cohort.agg(F.array(*stats).alias("rows")).select(F.inline("rows"))


def nearest_peers(cohort: DataFrame, key: str, who, columns: list[str], limit: int = 8) -> DataFrame:
    """The members nearest to one member by Euclidean distance; one scan, the member's row as literals."""
    me = cohort.where(F.col(key) == who).limit(1).first()
    if me is None:
        return cohort.limit(0).withColumn("distance", F.lit(0.0))
    square = sum(((F.col(c).cast("double") - F.lit(float(me[c]))) ** 2 for c in columns), F.lit(0.0))
    return cohort.where(F.col(key) != who).withColumn("distance", F.sqrt(square)).orderBy("distance", key).limit(limit)
