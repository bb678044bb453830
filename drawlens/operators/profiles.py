"""Profiles of tables and groups: describe, coverage, cluster and style tables, bounded samples, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlens.functions.scalars import micros, ratio
from drawlens.operators.sequences import distinct_counts, grouped_quantiles


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each column: count, mean, std, min, quartiles and max, the quartiles interpolated as usual."""
    shares = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    q = grouped_quantiles(df, [], {f"{n}_{i}": (c, p) for i, c in enumerate(columns) for n, p in shares.items()}).first()
    plain = df.agg(*(f(c).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("count", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)))).first()
    number = lambda x: None if x is None else float(x)
    rows = [(c, plain[f"count_{i}"], *(number(plain[f"{n}_{i}"]) for n in ("mean", "std", "min")), *(q[f"{n}_{i}"] for n in shares), number(plain[f"max_{i}"])) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "feature string, count long, mean double, std double, min double, q25 double, median double, q75 double, max double")


def coverage(df: DataFrame, time: str, draw: str, member: str) -> DataFrame:
    """One row: rows, first and last time and hours between, draws with their smallest and largest id, members, those
    with one draw only, and those with the most."""
    per = df.groupBy(member).agg(F.count_distinct(draw).alias("d"))
    counts = per.groupBy("d").agg(F.count("*").alias("k"))
    players = counts.agg(F.sum("k").alias("members"), F.coalesce(F.sum(F.when(F.col("d") == 1, F.col("k"))), F.lit(0)).alias("members_with_one_draw"), F.max_by("k", "d").alias("members_with_most_draws")).first()
    out = df.agg(F.count("*").alias("rows"), F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.count_distinct(draw).alias("draws"), F.min(draw).alias("smallest_draw"), F.max(draw).alias("largest_draw"))
    hours = F.round((micros(F.col("last_time")) - micros(F.col("first_time"))) / 3.6e9, 4)
    return out.select("*", hours.alias("span_hours"), *(F.lit(players[c]).cast("long").alias(c) for c in ("members", "members_with_one_draw", "members_with_most_draws")))


def cluster_profile(df: DataFrame, cluster: str, label: str, means: dict[str, str]) -> DataFrame:
    """For each cluster: members, positives, the mean of each column under its new name, and the rate of positives."""
    out = df.groupBy(cluster).agg(F.count("*").alias("members"), F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)).alias("positives"), *(F.avg(c).alias(new) for new, c in means.items()))
    return out.withColumn("rate", ratio(F.col("positives"), F.col("members")))


def cluster_name(rate: Column, tiny: Column, reuse: Column, bet: Column, members: Column) -> Column:
    """A cluster's name by its first striking mean, with its size."""
    # fixed values: thresholds and names
    name = F.when(rate > 0.10, "High-Stake Volatile").when(tiny > 0.30, "Tiny-Bet Repeaters").when(reuse > 0.10, "Template Reusers").when(bet > 2000, "Mid-Stake Active").otherwise("Casual Low-Stake")
    return F.concat(name, F.lit(" (n="), members.cast("string"), F.lit(")"))


def full_timeline(history: DataFrame) -> DataFrame:
    """Descriptive means of each member over all its rows, without any cutoff."""
    means = {"avg_stake_per_draw": "total_bet_amount", "avg_nonzero_bets_per_draw": "nonzero_bets_per_draw", "avg_max_bet_share": "max_bet_share_in_draw", "avg_entropy": "entropy_in_draw", "avg_gini": "gini_in_draw", "avg_tiny_bet_ratio": "tiny_bet_ratio_in_draw", "avg_position_coverage": "position_coverage"}
    stake = F.coalesce(F.stddev_samp("total_bet_amount"), F.lit(0.0)) / F.greatest(F.avg("total_bet_amount"), F.lit(1e-9))
    out = history.groupBy("member_id").agg(F.count_distinct("draw_id").alias("draws_played"), *(F.avg(c).alias(new) for new, c in means.items()), stake.alias("stake_cv"), F.avg((F.col("net_result") > 0).cast("double")).alias("positive_draw_rate"), F.count("*").alias("rows"))
    reuse = history.groupBy("member_id", "bet_template").agg(F.count("*").alias("k")).groupBy("member_id").agg(F.count("*").alias("unique_templates"), F.max("k").alias("max_template_reuse"))
    out = out.join(reuse, "member_id", "left")
    return out.withColumn("template_reuse_ratio", F.greatest(1 - ratio(F.col("unique_templates"), F.col("rows")), F.lit(0.0)))


def style_table(labelled: DataFrame) -> DataFrame:
    """Each member's counts, sums, means and deviations with the label as number and as text; what is not finite is 0."""
    finite = lambda c: F.coalesce(F.when(F.abs(c) < float("inf"), c), F.lit(0.0))
    out = labelled.groupBy("member_id").agg(
        F.sum("total_bet_amount").alias("total_staked"), F.avg("total_bet_amount").alias("avg_total_bet_amount"), F.stddev_samp("total_bet_amount").alias("std_total_bet_amount"),
        F.avg("entropy_in_draw").alias("avg_entropy"), F.avg("tiny_bet_ratio_in_draw").alias("avg_tiny_bet_ratio"), F.sum("net_result").alias("total_net_result"), F.max("event_label").alias("fraud_flag"),
    )
    out = out.join(distinct_counts(labelled, ["member_id"], {"draws_played": "draw_id", "sessions_played": "session_id"}), "member_id", "left")
    doubles = [c for c, kind in out.dtypes if kind == "double"]
    return out.withColumns({c: finite(F.col(c)) for c in doubles} | {"fraud_label": F.when(F.col("fraud_flag") == 1, "fraud").otherwise("normal")})


def nonzero_bets(draws: DataFrame, members: DataFrame) -> DataFrame:
    """The positive bets (number, bet_amount) of each draw of the given members."""
    few = draws.join(members.select("member_id").distinct(), "member_id", "left_semi")
    return few.select("member_id", "draw_id", F.filter("bets", lambda b: b["bet_amount"] > 0).alias("nonzero"))


def random_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, the first by a hash of the id and the seed; a rerun gives the same rows."""
    return df.withColumn("_u", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))).orderBy("_u", key).limit(n).drop("_u")


def limited(df: DataFrame, n: int, where: str | None = None, order: list[Column] | None = None) -> DataFrame:
    """At most n rows that meet a condition, in order."""
    out = df.where(where) if where else df
    return (out.orderBy(*order) if order else out).limit(n)


def catalog_overview(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """For each table: rows (counted from file footers where the source has them) and its columns' names."""
    rows = [(name, df.count(), ",".join(sorted(df.columns))) for name, df in tables.items()]
    return spark.createDataFrame(rows, "table string, rows long, columns string")


def looked_up(df: DataFrame, on: str, dimension: DataFrame, key: str, name: str, new: str) -> DataFrame:
    """df with the dimension's name for each key, the smallest one if a key has several; null without a match."""
    once = dimension.groupBy(F.col(key).alias("_key")).agg(F.min(name).alias(new))
    return df.join(once, F.col(on) == F.col("_key"), "left").drop("_key")
