"""Validation of raw records, diagnosis of label matching, recompute audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawlens.functions.scalars import finite
from drawlens.operators.sequences import LARGE, along

REQUIRED = ("member_id", "draw_id", "total_bet_amount", "win_points", "bets")


class ValidationError(ValueError):
    """Raised with the names of failed checks."""


def validation_report(raw: DataFrame, label_columns: list[str], min_rows: int = 1000, time: str = "ts", sample: int = 100) -> DataFrame:
    """One row per check: name, passed. One pass for the counts; the JSON check looks at the first `sample` bets."""
    there = set(raw.columns)
    has = {c: c in there for c in (*REQUIRED, time)}
    count = lambda c: F.count_if(F.col(c).isNull()) if has.get(c) else F.lit(-1)
    when = F.count_if(F.try_to_timestamp(F.col(time).cast("string")).isNotNull()) if has[time] else F.lit(0)
    stats = raw.agg(F.count("*").alias("n"), count("member_id").alias("no_member"), count("draw_id").alias("no_draw"), when.alias("timed")).first()
    valid = True
    if has["bets"] and dict(raw.dtypes)["bets"] == "string":
        some = raw.where("bets IS NOT NULL").select("bets").limit(sample)
        valid = some.where(F.from_json("bets", "array<struct<number:string>>").isNull()).isEmpty()
    labels = {c.strip().lower() for c in label_columns}
    checks = [
        ("min_row_count", stats.n >= min_rows),
        ("required_columns", all(has[c] for c in REQUIRED)),
        ("member_id_not_null", stats.no_member == 0),
        ("draw_id_not_null", stats.no_draw == 0),
        ("bets_parse", bool(valid)),
        ("time_parses", stats.timed > 0),
        ("label_columns", {"draw_id", "member_id"} <= labels),
    ]
    return raw.sparkSession.createDataFrame(checks, "check string, passed boolean")


def validate(raw: DataFrame, label_columns: list[str], **options) -> DataFrame:
    report = validation_report(raw, label_columns, **options)
    failed = [r["check"] for r in report.where("NOT passed").collect()]
    if failed:
        raise ValidationError(", ".join(failed))
    return report


def null_shares(df: DataFrame) -> DataFrame:
    rows = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls"), F.avg(F.col(c).isNull().cast("double")).alias("share")) for c in df.columns]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def range_checks(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """For each named SQL condition the rows that break it."""
    rows = [F.struct(F.lit(name).alias("rule"), F.count_if(~F.coalesce(F.expr(rule), F.lit(False))).alias("broken")) for name, rule in rules.items()]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def diagnose_labels(labels: DataFrame, draws: DataFrame, large: int = LARGE) -> DataFrame:
    """Each label's status: matched with history before it, matched without, member known but draw not, draw known but
    member not, or neither; with the member's rows before the matched draw and from it on."""
    event = draws.select(F.col("member_id").alias("_m"), F.col("draw_id").alias("_d"), "ts").groupBy("_m", "_d").agg(F.min("ts").alias("event_ts"))
    out = labels.join(event, (F.col("member_id") == F.col("_m")) & (F.col("draw_id") == F.col("_d")), "left").drop("_m", "_d")
    out = out.select("member_id", "draw_id", "event_ts").distinct()
    # rows and events in one order of time, events first: the running count of rows at an event is what lies before it
    rows = draws.join(labels.select("member_id").distinct(), "member_id", "left_semi").select("member_id", F.col("ts").alias("_ts"), F.lit(1).alias("_row"), F.lit(None).cast("long").alias("draw_id"))
    marks = out.select("member_id", F.col("event_ts").alias("_ts"), F.lit(0).alias("_row"), F.col("draw_id").cast("long").alias("draw_id"))
    timed = F.when(F.col("_ts").isNotNull(), F.col("_row")).otherwise(0)
    placed = along(rows.unionByName(marks), ["member_id"], ["_ts", "_row"], running={"_upto": "_row"}, overall={"_all": (F.sum, F.col("_row")), "_timed": (F.sum, timed)}, large=large)
    counts = placed.where("_row = 0").select("member_id", "draw_id", F.when(F.col("_ts").isNotNull(), F.col("_upto")).otherwise(0).cast("long").alias("rows_before"), F.when(F.col("_ts").isNotNull(), F.col("_timed") - F.col("_upto")).otherwise(0).cast("long").alias("rows_after"), F.col("_all").alias("member_rows"))
    counts = counts.withColumnsRenamed({"member_id": "_m", "draw_id": "_l"})
    out = out.join(counts, (F.col("member_id") == F.col("_m")) & F.col("draw_id").eqNullSafe(F.col("_l")), "left").drop("_m", "_l").fillna({"rows_before": 0, "rows_after": 0, "member_rows": 0})
    known = draws.select(F.col("draw_id").alias("_d")).distinct().withColumn("_draw", F.lit(True))
    out = out.join(known, F.col("draw_id") == F.col("_d"), "left")
    status = (
        F.when(F.col("event_ts").isNotNull() & (F.col("rows_before") > 0), "matched_with_history")
        .when(F.col("event_ts").isNotNull(), "matched_no_history")
        .when(F.col("member_rows") > 0, "member_only")
        .when(F.col("_draw"), "draw_only")
        .otherwise("absent")
    )
    return out.select("member_id", "draw_id", "rows_before", "rows_after", status.alias("status"))


#: From best to worst; a member has its best label's status.
STATUSES = ("matched_with_history", "matched_no_history", "member_only", "draw_only", "absent")


def member_status(diagnosed: DataFrame) -> DataFrame:
    code = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    return diagnosed.groupBy("member_id").agg(F.element_at(F.array(*map(F.lit, STATUSES)), F.min(code).cast("int")).alias("status"))


def _correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation over the rows that have both values; null where one of them does not vary."""
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    varies = lambda x: F.stddev_pop(x) > 1e-9 * (1 + F.max(F.abs(x)))  # noqa: E731  rounding is no variation
    return F.when(varies(a) & varies(b), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def compare_frames(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """For each column of two tables joined by key: rows, largest and mean absolute difference, correlation."""
    met = a.select(key, *(F.col(c).cast("double").alias(f"a_{c}") for c in columns)).join(b.select(key, *(F.col(c).cast("double").alias(f"b_{c}") for c in columns)), key)
    rows = [F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.max(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))).alias("max_diff"), F.avg(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))).alias("mean_diff"), _correlation(F.col(f"a_{c}"), F.col(f"b_{c}")).alias("corr")) for c in columns]
    return met.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def recompute_audit(now: DataFrame, saved: DataFrame, key: str, but: tuple[str, ...] = (), least: float = 0.95) -> DataFrame:
    """Recomputed against saved: for each numeric column that both have (but key and `but`) the keys that both have,
    the correlation (null where either side does not vary) and low, true where it is under `least` in size or null.

    Keys are taken to be unique on both sides. All correlations come from one pass over the join."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    numeric = lambda df: {c for c, kind in df.dtypes if kind in kinds or kind.startswith("decimal")}
    shared = [c for c in now.columns if c in numeric(now) & numeric(saved) and c not in (key, *but)]
    if not shared:
        return now.sparkSession.createDataFrame([], "column string, rows long, corr double, low boolean")
    side = lambda df, s: df.select(F.col(key).alias(f"{s}_key"), *(finite(F.col(f"`{c}`")).alias(f"{s}_{i}") for i, c in enumerate(shared)))
    met = side(now, "a").join(side(saved, "b"), F.col("a_key") == F.col("b_key"))
    rows = [F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), _correlation(F.col(f"a_{i}"), F.col(f"b_{i}")).alias("corr")) for i, c in enumerate(shared)]
    out = met.agg(F.array(*rows).alias("r")).select(F.inline("r"))
    return out.withColumn("low", F.coalesce(F.abs("corr") < least, F.lit(True)))


def only_in_one(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one of the tables has, and which."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.join(right, key, "left_anti").withColumn("side", F.lit("a")).unionByName(right.join(left, key, "left_anti").withColumn("side", F.lit("b")))
