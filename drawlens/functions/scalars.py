"""Scalar expressions: ids, numbers, times, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Time columns in the order in which the first parsable one counts.
TIME_COLUMNS = ("trans_date", "createdAt", "updatedAt", "createdAt.$date", "updatedAt.$date", "trans_date.$date", "timestamp", "ts")


def member_id(c: Column) -> Column:
    return F.upper(F.trim(c.cast("string")))


def is_member_id(c: Column) -> Column:
    return c.rlike(r"^[A-Z0-9_-]{4,64}$")


def event_key(draw: Column, member: Column) -> Column:
    """draw|member; a null draw is the text <NA>, so null draws match each other."""
    return F.concat(F.coalesce(draw.cast("string"), F.lit("<NA>")), F.lit("|"), member)


def number(c: Column) -> Column:
    """To double; bad text and NaN become null."""
    d = c.cast("string").try_cast("double")
    return F.when(~F.isnan(d), d)


def whole(c: Column) -> Column:
    """To long through double; fractional values become null."""
    d = number(c)
    return F.when(d == F.floor(d), d.try_cast("long"))


def or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0))), F.lit(0.0))


def log_clip(c: Column) -> Column:
    """log(1 + x) of x not below 0; null, NaN and infinity give 0."""
    return F.coalesce(F.log1p(F.greatest(finite(c), F.lit(0.0))), F.lit(0.0))


def finite(c: Column) -> Column:
    """A number as double, null where it is null, NaN or infinite."""
    x = c.cast("double")
    return F.when(F.abs(F.nanvl(x, F.lit(float("inf")))) < float("inf"), x)


def binned(c: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the right-closed interval (edge, next edge] that holds a number; null outside of all."""
    if len(labels) != len(edges) - 1 or sorted(set(edges)) != list(edges):
        raise ValueError("edges must rise, with one label for each interval")
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for low, high, label in zip(edges, edges[1:], labels, strict=False):
        out = out.when((c > low) & (c <= high), label)
    return out


def percent(c: Column) -> Column:
    """0.123 as 12.3%."""
    return F.format_string("%.1f%%", c.cast("double") * 100)


def shown(c: Column, kind: str) -> Column:
    """A value as text: doubles with four places, N/A for null and NaN."""
    if kind in ("double", "float"):
        return F.when(c.isNull() | F.isnan(c), "N/A").otherwise(F.format_string("%.4f", c.cast("double")))
    return F.coalesce(c.cast("string"), F.lit("N/A"))


def unwrapped_time(c: Column) -> Column:
    """A timestamp from text, plain or as {"$date": ...}."""
    text = c.cast("string")
    return F.try_to_timestamp(F.coalesce(F.get_json_object(text, "$.$date"), F.get_json_object(text, "$['$date']"), text))


def first_time(df: DataFrame, candidates: tuple[str, ...] = TIME_COLUMNS) -> Column:
    """The first parsable time of the candidate columns that exist."""
    present = [F.col(f"`{c}`") for c in candidates if c in df.columns]
    parsed = [unwrapped_time(c) if dict(df.dtypes)[n] == "string" else c.cast("timestamp") for c, n in zip(present, [c for c in candidates if c in df.columns], strict=True)]
    return F.coalesce(*parsed) if parsed else F.lit(None).cast("timestamp")


def utc_time(c: Column) -> Column:
    """The moment that a text names, whatever the session's zone: one with an offset is converted, one without is in UTC,
    a day is its start; null where the text names none."""
    text = F.regexp_replace(F.trim(c.cast("string")), r"^(\S+[T ]\d{1,2}:\d{1,2})(?![:\d])", "$1:00")  # Spark reads zones after seconds only
    zoned = text.rlike(r"(?i):\d\d(\.\d+)?\s?(z|utc|gmt|[+-]\d\d(:?\d\d)?)$")
    day = text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$")
    return F.when(zoned, text).when(day, F.concat(text, F.lit(" 00:00:00Z"))).otherwise(F.concat(text, F.lit("Z"))).try_cast("timestamp")


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1_000_000.0)


def digits(c: Column) -> Column:
    """The digits of a text without leading zeros; null without any."""
    return F.nullif(F.regexp_replace(c.cast("string"), "[^0-9]", ""), F.lit("")).try_cast("decimal(38,0)").cast("string")


def truthy(c: Column) -> Column:
    """Whether a text signals a positive: not null, empty, or a word for no."""
    return F.coalesce(~F.lower(F.trim(c.cast("string"))).isin("", "0", "false", "no", "none", "nan", "null", "[]"), F.lit(False))


#: Texts that signal a positive. Fixed values.
SIGNALS = ("true", "yes", "1", "fraud", "confirmed")


def signal(c: Column, kind: T.DataType) -> Column:
    """Whether a value of that type signals a positive: a text that says so, a number other than zero, a container or
    bytes with content, any struct or time. Null and NaN give null."""
    if isinstance(kind, T.StringType):
        return F.lower(F.btrim(c, F.lit(" \t\r\n\x0b\x0c"))).isin(*SIGNALS)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.when(c.isNotNull(), F.size(c) > 0)
    if isinstance(kind, T.BinaryType):
        return F.length(c) > 0
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c != 0)
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return c.cast("boolean")
    return F.when(c.isNotNull(), F.lit(True))


def normalised(c: Column, low: Column, high: Column, top: float = 1.5) -> Column:
    """(c - low) / (high - low) within 0 and top; 0 where high <= low."""
    return F.when(high <= low, F.lit(0.0)).otherwise(F.least(F.greatest((c - low) / (high - low), F.lit(0.0)), F.lit(top)))


def tier(score: Column, p80: Column, p95: Column) -> Column:
    return F.when(score <= p80, "LOW").when(score <= p95, "MEDIUM").otherwise("HIGH")


def reliability(draws: Column, rows: Column) -> Column:
    return F.when((draws < 5) | (rows < 5), "low").when((draws < 20) | (rows < 20), "medium").otherwise("higher")


def recommendation(tier: Column, reliability: Column | None = None) -> Column:
    """What to do with a member of a tier; little history overrides the tier, some history softens HIGH."""
    # fixed values: the texts
    out = F.when(tier == "HIGH", "Investigate now").when(tier == "MEDIUM", "Monitor / secondary review").when(tier == "LOW", "Low priority").otherwise("Unassigned")
    if reliability is None:
        return out
    return F.when(reliability == "low", "Collect more history before escalation").when((reliability == "medium") & (tier == "HIGH"), "Investigate carefully (limited history)").otherwise(out)


def cache_bucket(ts: Column, seconds: int = 900) -> Column:
    return F.floor(F.unix_timestamp(ts.cast("timestamp")) / seconds)


def position_order(number: Column) -> Column:
    """Sort key of a wheel position: its number, 37 for 00, 999 for what is none."""
    return F.when(number == "00", 37).otherwise(F.coalesce(number.try_cast("int"), F.lit(999)))


def redacted(uri: Column) -> Column:
    return F.regexp_replace(uri, r"://[^/@]+@", "://***@")
