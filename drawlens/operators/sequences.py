"""Values along ordered groups and exact quantiles of groups, whatever share of the rows one group has.

A group of more than `large` rows is cut in slices by quantiles of its order, of about `large` rows each. Windows run
inside slices, and what crosses a slice's edge (last values, counts, sums) is carried over with one row for each slice.
Without such groups the plan is the plain window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from drawlens.sources.stages import discard, stored

#: Rows that one task may order for one group; and quantiles that a slice's bounds are chosen from.
LARGE, GRID = 100_000, 1000


def large_groups(df: DataFrame, by: list[str], large: int = LARGE) -> DataFrame | None:
    """The keys of groups with more than `large` rows (columns _k_<key>, and _n), stored; None where there are none."""
    sizes = df.groupBy(*(F.col(c).alias(f"_k_{c}") for c in by)).agg(F.count("*").alias("_n"))
    found = stored(sizes.where(F.col("_n") > large), "large")
    if found.isEmpty():
        discard(found)
        return None
    return found


def same(by: list[str]) -> Column:
    """Condition of a join with large_groups."""
    out = F.lit(True)
    for c in by:
        out = out & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return out


def _sliced(df: DataFrame, by: list[str], order: str, many: DataFrame, large: int) -> DataFrame:
    """Adds _cuts (of large groups) and _slice. Rows of one value of order stay in one slice; nulls are in the last."""
    cuts = df.join(many, same(by), "left_semi").groupBy(*(F.col(c).alias(f"_k_{c}") for c in by)).agg(F.percentile_approx(order, [i / GRID for i in range(1, GRID)], 20 * GRID).alias("_cuts"))
    keys = [F.col(f"_k_{c}") for c in by]
    every = F.greatest(F.lit(1), F.floor(F.lit(GRID * large) / F.col("_n"))).cast("int")
    cuts = cuts.withColumnsRenamed({f"_k_{c}": f"_q_{c}" for c in by}).join(many, [F.col(f"_q_{c}").eqNullSafe(k) for c, k in zip(by, keys, strict=True)])
    cuts = cuts.select(*keys, F.array_distinct(F.filter(F.coalesce("_cuts", F.array()), lambda x, i: (i + 1) % every == 0)).alias("_cuts"))
    rows = df.join(cuts, same(by), "left").drop(*(f"_k_{c}" for c in by))
    place = F.when(F.col(order).isNull(), F.size("_cuts")).otherwise(F.size(F.filter("_cuts", lambda x: x <= F.col(order))))
    return rows.withColumn("_slice", F.when(F.col("_cuts").isNull(), 0).otherwise(place))


def along(df: DataFrame, by: list[str], order: list[str], previous: dict[str, str] | None = None, running: dict[str, str] | None = None, sequence: str | None = None, overall: dict[str, tuple[Callable, Column]] | None = None, large: int = LARGE) -> DataFrame:
    """Adds values along each group's rows in the given order (nulls last; the first of order is a number or a time).

    previous: new: column, its value in the row before; running: new: column, its sum up to this row; sequence: the
    name of the row's number from 1; overall: new: (F.min, F.max or F.sum, column), over the whole group.
    """
    previous, running, overall = previous or {}, running or {}, overall or {}
    many = large_groups(df, by, large)
    cut = ["_slice"] if many is not None else []
    rows = _sliced(df, by, order[0], many, large) if cut else df
    w = W.partitionBy(*by, *cut).orderBy(*map(F.asc_nulls_last, order))
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    new = {n: F.lag(c).over(w) for n, c in previous.items()} | {n: F.sum(c).over(upto) for n, c in running.items()}
    new |= {sequence: F.row_number().over(w).cast("long")} if sequence else {}
    new |= {n: f(c).over(W.partitionBy(*by, *cut)) for n, (f, c) in overall.items()}
    if not cut:
        return rows.withColumns(new)
    place = F.struct(*(x for c in order for x in (F.col(c).isNull(), F.col(c))))
    sums = [F.sum(c).alias(f"_s_{n}") for n, c in running.items()] + [f(c).alias(f"_o_{n}") for n, (f, c) in overall.items()]
    last = F.max_by(F.struct(F.lit(True), *previous.values()), place).alias("_last")
    edges = rows.where("_cuts IS NOT NULL").groupBy(*(F.col(c).alias(f"_k_{c}") for c in by), F.col("_slice").alias("_at")).agg(F.count("*").alias("_n"), last, *sums)
    group = W.partitionBy(*(f"_k_{c}" for c in by))
    before = group.orderBy("_at").rowsBetween(W.unboundedPreceding, -1)  # one row for each slice
    carried = {"_n": F.sum("_n").over(before), "_last": F.lag("_last").over(group.orderBy("_at"))}
    carried |= {f"_s_{n}": F.sum(f"_s_{n}").over(before) for n in running} | {f"_o_{n}": f(f"_o_{n}").over(group) for n, (f, _) in overall.items()}
    edges = edges.select(*(f"_k_{c}" for c in by), "_at", *(c.alias(n) for n, c in carried.items()))
    out = rows.withColumns(new | {"_first": F.row_number().over(w) == 1}).join(edges, same(by) & (F.col("_slice") == F.col("_at")), "left")
    whole = {n: F.when(F.col("_first") & F.col("_last").isNotNull(), F.col("_last")[c]).otherwise(F.col(n)) for n, c in previous.items()}
    # a sum is null where it has met no value so far
    whole |= {n: F.when(F.col(f"_s_{n}").isNull(), F.col(n)).otherwise(F.coalesce(F.col(n), F.lit(0)) + F.col(f"_s_{n}")) for n in running}
    whole |= {sequence: F.col(sequence) + F.coalesce("_n", F.lit(0))} if sequence else {}
    whole |= {n: F.when(F.col("_cuts").isNull(), F.col(n)).otherwise(F.col(f"_o_{n}")) for n in overall}
    return out.withColumns(whole).select(*df.columns, *(n for n in new if n not in df.columns))


def grouped_quantiles(df: DataFrame, by: list[str], points: dict[str, tuple[str, float]], large: int = LARGE) -> DataFrame:
    """For each group one exact quantile for each name: (column, share), with linear interpolation.

    Nulls and NaN count for nothing; a group without values of any column is left out. The columns' distinct values are
    counted first and then placed by running counts, so neither a group nor a column has to fit in one task.
    """
    columns = list(dict.fromkeys(c for c, _ in points.values()))
    tall = df.select(*by, F.explode(F.array(*(F.struct(F.lit(i).alias("_f"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)))).alias("_x"))
    counts = tall.select(*by, "_x.*").where("_v IS NOT NULL AND NOT isnan(_v)").groupBy(*by, "_f", "_v").agg(F.count("*").alias("_c"))
    placed = along(counts, [*by, "_f"], ["_v"], running={"_upto": "_c"}, overall={"_all": (F.sum, F.col("_c"))}, large=large)

    def at(i: int, rank: Column) -> Column:
        return F.max(F.when((F.col("_f") == i) & (F.col("_upto") - F.col("_c") <= rank) & (F.col("_upto") > rank), F.col("_v")))

    found = []
    for name, (c, share) in points.items():
        i, place = columns.index(c), F.lit(float(share)) * (F.col("_all") - 1)
        low = F.floor(place)
        part = F.max(F.when(F.col("_f") == i, place - low))
        least, most = at(i, low), at(i, F.least(low + 1, F.col("_all") - 1))
        found.append((least + (most - least) * part).alias(name))
    return placed.groupBy(*by).agg(*found)


def distinct_counts(df: DataFrame, by: list[str], names: dict[str, str]) -> DataFrame:
    """For each group the distinct values (without null) of each column, in two groupings for each, so no set is held."""
    out = None
    for name, c in names.items():
        n = df.groupBy(*by, F.col(c).alias("_d")).agg(F.lit(1)).groupBy(*by).agg(F.count("_d").alias(name))
        out = n if out is None else out.join(n, by, "left")
    return out
