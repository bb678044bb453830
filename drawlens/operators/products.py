"""Sums of products of columns: one pass over the rows gives all correlations and covariances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMS = ("n", "sa", "sb", "saa", "sbb", "sab")


def pair_sums(df: DataFrame, columns: list[str], at_once: int = 4096) -> DataFrame:
    """For each two columns (numbers i <= j): n, sums, squares and products over the rows where both are there.

    Values are taken less the column's mean, so that nothing is lost to large means. Each task adds matrices up to one
    of columns x columns numbers, whatever its rows; these are summed by pair. NaN counts as null.
    """
    numbers = df.select(*(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)))
    means = numbers.agg(*(F.avg(c) for c in numbers.columns)).first()
    centre = np.array([m or 0.0 for m in means])
    d = len(columns)
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, d, d))
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in part.columns], axis=1) - centre
                there = ~np.isnan(x)
                m, x = there.astype(np.float64), np.where(there, x, 0.0)
                total += np.stack((m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x))
        yield pa.record_batch([*(pa.array(u, pa.int32()) for u in upper), *(pa.array(total[k][upper]) for k in range(6))], names=["i", "j", *SUMS])

    found = numbers.mapInArrow(run, "i int, j int, " + ", ".join(f"{s} double" for s in SUMS))
    return found.groupBy("i", "j").agg(*(F.sum(s).alias(s) for s in SUMS))


def _product() -> Column:
    return F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")


def _names(columns: list[str], i: str) -> Column:
    return F.element_at(F.array(*map(F.lit, columns)), F.col(i) + 1)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, corr: Pearson's correlation of each two columns (and of each with itself) over rows where both are there;
    null where one of them does not vary there."""
    square = lambda s, ss: F.greatest(F.col(ss) - F.col(s) * F.col(s) / F.col("n"), F.lit(0.0))
    spread = F.sqrt(square("sa", "saa")) * F.sqrt(square("sb", "sbb"))
    # what is left of a constant column's squares is rounding
    varies = (square("sa", "saa") > 1e-13 * F.col("saa")) & (square("sb", "sbb") > 1e-13 * F.col("sbb"))
    corr = F.when((F.col("n") > 1) & varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _product() / spread)))
    return pair_sums(df, columns).select(_names(columns, "i").alias("a"), _names(columns, "j").alias("b"), corr.alias("corr"))


def covariances(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, n, cov: sample covariances of each two columns; null below two rows."""
    cov = F.when(F.col("n") > 1, _product() / (F.col("n") - 1))
    return pair_sums(df, columns).select(_names(columns, "i").alias("a"), _names(columns, "j").alias("b"), F.col("n").cast("long").alias("n"), cov.alias("cov"))


def covariance_matrix(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances, columns x columns numbers, on the driver; where there are none, zeros."""
    place = {c: i for i, c in enumerate(columns)}
    out = np.zeros((len(columns), len(columns)))
    for r in covariances(df, columns).collect():
        out[place[r.a], place[r.b]] = out[place[r.b], place[r.a]] = r.cov or 0.0
    means = df.agg(*(F.avg(F.col(c)) for c in columns)).first()
    return np.array([m or 0.0 for m in means]), out
