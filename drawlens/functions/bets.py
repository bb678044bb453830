"""Features of one draw's bets, as expressions over an array of (number, bet_amount).

All are built-in higher-order functions, so the nested column never leaves the JVM. An empty or null array gives 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POSITIONS = 38  # 0 to 36 and 00
BETS = "array<struct<number:string,bet_amount:string>>"
TYPED = "array<struct<number:string,bet_amount:double>>"


def parse_bets(text: Column) -> Column:
    """JSON text to typed bets; invalid text and null give an empty array, bad or missing amounts 0."""
    raw = F.coalesce(F.from_json(text, BETS), F.array().cast(BETS))
    return F.transform(raw, lambda b: F.struct(b["number"].alias("number"), F.coalesce(b["bet_amount"].try_cast("double"), F.lit(0.0)).alias("bet_amount")))


def amounts(bets: Column) -> Column:
    return F.transform(F.coalesce(bets, F.array().cast(TYPED)), lambda b: F.coalesce(b["bet_amount"], F.lit(0.0)))


def positive(values: Column) -> Column:
    return F.filter(values, lambda a: a > 0)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, total(values) / F.size(values)).otherwise(F.lit(0.0))


def spread(values: Column, m: Column | None = None) -> Column:
    """Population standard deviation; 0 for fewer than two values. m: their mean where it is at hand, as a column; an
    expression is evaluated anew for every value."""
    m = mean(values) if m is None else m
    squares = F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - m) * (x - m))
    return F.when(F.size(values) > 1, F.sqrt(squares / F.size(values))).otherwise(F.lit(0.0))


def entropy(values: Column, t: Column | None = None) -> Column:
    """Shannon entropy in bits of the shares of the positive values. t: their sum where it is at hand, as a column."""
    t = total(values) if t is None else t
    bits = F.aggregate(values, F.lit(0.0), lambda s, x: s - (x / t) * F.log2(x / t))
    return F.when(t > 0, bits + 0.0).otherwise(F.lit(0.0))


def gini(values: Column, t: Column | None = None) -> Column:
    """Gini coefficient of the positive values, not below 0. t: their sum where it is at hand, as a column."""
    n, t = F.size(values), total(values) if t is None else t
    ranked = F.transform(F.sort_array(values), lambda x, i: x * (i + 1))
    return F.when(t > 0, F.greatest(2 * total(ranked) / (n * t) - (n + 1) / n, F.lit(0.0))).otherwise(F.lit(0.0))


def template(bets: Column) -> Column:
    """Positive bets as an array sorted by (number, amount), amounts rounded to 6 places.

    A bet whose number is null has the number None; typed bets know no difference between null and absent.
    """
    typed = F.filter(F.coalesce(bets, F.array().cast(TYPED)), lambda b: b["bet_amount"] > 0)
    return F.sort_array(F.transform(typed, lambda b: F.struct(F.coalesce(b["number"], F.lit("None")).alias("number"), F.round(b["bet_amount"], 6).alias("bet_amount"))))


def template_key(bets: Column) -> Column:
    return F.to_json(template(bets))


def draw_features(values: Column, nonzero: Column, t: Column | None = None, t_some: Column | None = None, m: Column | None = None) -> dict[str, Column]:
    """values: all amounts; nonzero: the positive ones; t, t_some: their sums, m: the mean of the positive ones (columns
    made once, so that they are not built anew for each)."""
    n = F.size(nonzero)
    t = total(values) if t is None else t
    return {
        "bets_per_draw": F.size(values).cast("long"),
        "nonzero_bets_per_draw": n.cast("long"),
        "unique_positions_in_draw": n.cast("long"),
        "tiny_bet_ratio_in_draw": F.size(F.filter(nonzero, lambda a: a <= 1)) / F.greatest(n, F.lit(1)),
        "max_bet_share_in_draw": F.when(t > 0, F.array_max(values) / t).otherwise(F.lit(0.0)),
        "bet_amount_std_in_draw": spread(nonzero, m),
        "bet_amount_mean_in_draw": mean(nonzero) if m is None else m,
        "entropy_in_draw": entropy(nonzero, t_some),
        "gini_in_draw": gini(nonzero, t_some),
        "position_coverage": n / F.lit(POSITIONS),
    }


def explored_features(bets: Column, stake: Column) -> dict[str, Column]:
    """The exploratory variants: ratios over all bets and the recorded stake, null for draws without bets."""
    values = amounts(bets)
    n = F.size(values)
    some = n > 0
    return {
        "distinct_numbers_in_draw": F.size(F.array_distinct(F.transform(bets, lambda b: b["number"]))).cast("long"),
        "tiny_bets_per_draw": F.size(F.filter(values, lambda a: (a > 0) & (a <= 1))).cast("long"),
        "tiny_bet_ratio_all": F.when(some, F.size(F.filter(values, lambda a: (a > 0) & (a <= 1))) / n),
        "max_bet_amount_in_draw": F.array_max(values),
        "max_bet_share_of_stake": F.when(some & (stake > 0), F.array_max(values) / stake),
        "bet_amount_std_all": F.when(some, spread(values)),
    }
