"""Nearest peers of every member, exactly and without comparing all with all.

Members with equal values are one point, which keeps its first members only, as no peer list needs more. Points are
cut into cells of about equal size by halving along the widest column, on a bounded sample; each cell's box is then
taken over all its points. A first round looks for peers in a point's own cell, which bounds how far they can be; a
second looks in every other cell whose box is not further away than that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlens.operators.ranking import positions
from drawlens.sources.stages import discard, stored


class Cells:
    """Halvings of space: at each inner node a column and a value; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.nodes: list[tuple[int, float, int, int] | int] = []
        self.count = 0
        self._cut(sample, max(1, cells))

    def _cut(self, x: np.ndarray, cells: int) -> int:
        at = len(self.nodes)
        self.nodes.append(-1)
        if cells > 1 and len(x) > 1:
            spread = x.max(axis=0) - x.min(axis=0)
            for c in np.argsort(-spread, kind="stable").tolist():
                if not spread[c]:
                    break
                cut = float(np.median(x[:, c]))
                if cut == x[:, c].min():
                    cut = float(x[x[:, c] > cut, c].min())
                left = x[:, c] < cut
                if left.any():
                    self.nodes[at] = (c, cut, self._cut(x[left], cells // 2), self._cut(x[~left], cells - cells // 2))
                    return at
        self.nodes[at], self.count = self.count, self.count + 1
        return at

    def of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            inner = self.nodes[node]
            if isinstance(inner, int):
                out[rows] = inner
            elif len(rows):
                c, cut, a, b = inner
                left = x[rows, c] < cut
                todo += [(a, rows[left]), (b, rows[~left])]
        return out


def _matrix(values: pd.Series) -> np.ndarray:
    return np.array(values.tolist(), dtype=np.float64)


def nearest_of_all(cohort: DataFrame, key: str, columns: list[str], limit: int = 8, per_cell: int = 256, most_cells: int = 2**16, sample: int = 200_000, seed: int = 5) -> DataFrame:
    """key, peer, distance, place (from 1): for each member the `limit` members nearest by Euclidean distance, of equal
    distances those with the smaller keys.

    Members with a null or NaN value, or without a key, take no part; a key that repeats is a member each time, but no
    peer of itself. The cells are fitted on `sample` points and hold all of them; there are most_cells at most, whose
    boxes are broadcast. An empty cohort gives no rows.
    """
    spark = cohort.sparkSession
    number = lambda c: F.col(c).cast("double") + F.lit(0.0)  # noqa: E731  -0.0 and 0.0 are one point
    rows = cohort.where(F.col(key).isNotNull()).select(F.col(key).alias("_id"), F.array(*map(number, columns)).alias("_x")).where(~F.exists("_x", lambda v: v.isNull() | F.isnan(v)))
    rows = stored(rows, "members")
    # of equal members the first ones: a list of limit + 1 without itself has limit
    some = positions(rows.select("_x", "_id").distinct(), ["_x"], [F.col("_id")]).where(F.col("position") <= limit)
    points = some.groupBy("_x").agg(F.array_sort(F.collect_list("_id")).alias("_ids"))
    points = stored(points.withColumn("_p", F.monotonically_increasing_id()), "points")
    n = points.count()
    fit = _matrix(pd.Series([r[0] for r in points.select("_x", F.xxhash64("_x", F.lit(seed)).alias("u")).orderBy("u").limit(sample).collect()])) if n else np.zeros((0, len(columns)))
    cells = Cells(fit, min(most_cells, max(1, n // per_cell)))
    sent = spark.sparkContext.broadcast(cells)

    @F.pandas_udf("int")
    def cell_of(x: pd.Series) -> pd.Series:
        return pd.Series(sent.value.of(_matrix(x)) if len(x) else [], dtype="int32")

    placed = stored(points.withColumn("_cell", cell_of("_x")), "placed")
    boxes = placed.groupBy("_cell").agg(F.sum(F.size("_ids")).alias("held"), *(f(F.col("_x")[i]).alias(f"{f.__name__}{i}") for i in range(len(columns)) for f in (F.min, F.max))).collect()
    number_of = np.array([b["_cell"] for b in boxes], dtype=np.int32)
    low, high = (np.array([[b[f"{f}{i}"] for i in range(len(columns))] for b in boxes]).reshape(len(boxes), len(columns)) for f in ("min", "max"))
    box = spark.sparkContext.broadcast((number_of, low, high, np.array([b["held"] for b in boxes])))
    id_kind = dict(rows.dtypes)["_id"]

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """For each point of left that asks this cell its nearest members here (limit + 1, itself included)."""
        out = []
        if len(left) and len(right):
            theirs = _matrix(right["_y"])
            for at in range(0, len(left), 512):
                part = left.iloc[at : at + 512]
                mine = _matrix(part["_x"])
                d = np.sqrt(((mine[:, None, :] - theirs[None, :, :]) ** 2).sum(axis=2))
                reach = np.partition(d, min(limit, d.shape[1] - 1), axis=1)[:, min(limit, d.shape[1] - 1)]
                for p, row, r in zip(part["_p"].tolist(), d, reach, strict=True):
                    near = np.flatnonzero(row <= r)
                    found = sorted((row[j], i) for j in near.tolist() for i in right["_ids"].iloc[j])[: limit + 1]
                    out.append((p, [{"d": x, "id": i} for x, i in found]))
        return pd.DataFrame(out, columns=["_p", "_found"])

    kind = f"_p long, _found array<struct<d: double, id: {id_kind}>>"
    inside = placed.select("_cell", "_x", "_ids").toDF("_in", "_y", "_ids")

    def asked(questions: DataFrame) -> DataFrame:
        return questions.groupBy("_cell").cogroup(inside.groupBy("_in")).applyInPandas(search, kind)

    first = stored(asked(placed.select("_cell", "_p", "_x")), "first")

    @F.pandas_udf("array<int>")
    def also(x: pd.Series, cell: pd.Series, reach: pd.Series) -> pd.Series:
        numbers, low, high, held = box.value
        out = []
        x, cell, reach = (_matrix(x) if len(x) else np.zeros((0, low.shape[1]))), cell.to_numpy(), reach.to_numpy()
        for at in range(0, len(x), 256):
            here = x[at : at + 256, None, :]
            gap = np.maximum(np.maximum(low[None] - here, here - high[None]), 0)
            # rounded outward: a box that may hold an equally near member is looked into
            bound = reach[at : at + 256].copy()
            for k in np.flatnonzero(np.isinf(bound)).tolist():  # too few in its own cell: boxes that hold enough are no further than this
                far = np.sqrt((np.maximum(np.abs(here[k] - low), np.abs(here[k] - high)) ** 2).sum(axis=1))
                order = np.argsort(far)
                bound[k] = far[order][min(int(np.searchsorted(np.cumsum(held[order]), limit + 1)), len(order) - 1)] * (1 + 1e-12)
            may = np.sqrt((gap**2).sum(axis=2)) * (1 - 1e-12) <= bound[:, None]
            may &= numbers[None] != cell[at : at + 256, None]
            out += [numbers[m].tolist() for m in may]
        return pd.Series(out)

    reach = F.when(F.size("_found") > limit, F.element_at("_found", -1)["d"]).otherwise(F.lit(float("inf")))
    more = placed.join(first, "_p").select("_p", "_x", F.explode(also("_x", "_cell", reach)).alias("_cell"))
    both = first.unionByName(asked(more)).select("_p", F.explode("_found").alias("f"))
    # at most limit + 1 of each cell that was asked meet here
    best = both.groupBy("_p").agg(F.slice(F.array_sort(F.collect_list("f")), 1, limit + 1).alias("_found"))
    found = stored(points.select("_p", "_x").join(best, "_p").select("_x", "_found"), "found")
    discard(points, placed, first)
    own = rows.join(found, "_x").select("_id", F.slice(F.filter("_found", lambda f: f["id"] != F.col("_id")), 1, limit).alias("f"))
    return own.select(F.col("_id").alias(key), F.posexplode("f").alias("_at", "f")).select(key, F.col("f.id").alias("peer"), F.col("f.d").alias("distance"), (F.col("_at") + 1).alias("place"))

