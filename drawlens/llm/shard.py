"""Sharding: a uniform shuffle with exact shard sizes (DataFrame functions only on the data).

Each map partition permutes its rows by a seeded hash and numbers them. How many of its rows go to each shard is
one row of a random matrix whose row sums are the partitions' sizes and whose column sums are the shards' sizes;
with the matrix drawn from the multivariate hypergeometric law every arrangement of rows over shards is equally
likely. The matrix has one row per map partition and one column per shard, as the sizes of map outputs have that
Spark's driver keeps for any exchange, and it alone is made on the driver, for any number of rows. After the exchange, rows are permuted
again within fine ranges of a second hash, so that a shard never has to fit in one task.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawlens.llm.common import forget, save, unused


def _stirling_error(n: np.ndarray) -> np.ndarray:
    """log n! less Stirling's formula, for n > 0."""
    few = np.minimum(n, 16.0)
    exact = np.array([math.lgamma(i + 1) - ((i + 0.5) * math.log(i) - i + 0.5 * math.log(2 * math.pi)) if i else 0.0 for i in range(17)])
    big = np.maximum(n, 16.0)
    return np.where(n <= 16, exact[few.astype(np.int64)], (1 / 12 - (1 / 360 - 1 / 1260 / big**2) / big**2) / big)


def _deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x log(x / mean) + mean - x without loss where both are large and close."""
    v = (x - mean) / (x + mean)
    near = (x - mean) * v + 2 * x * sum(v ** (2 * j + 1) / (2 * j + 1) for j in range(1, 9))
    with np.errstate(divide="ignore", invalid="ignore"):
        far = x * np.log(x / mean) + mean - x
    return np.where(np.abs(v) < 0.1, near, far)


def _log_binomial(x: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Of the binomial law, by Loader's saddle-point form, which keeps its accuracy for large counts."""
    inner = np.clip(x, 1, np.maximum(n - 1, 1))
    rest = np.maximum(n - inner, 1)
    body = _stirling_error(n) - _stirling_error(inner) - _stirling_error(rest) - _deviance(inner, n * p) - _deviance(rest, n * (1 - p)) + 0.5 * np.log(n / (2 * np.pi * inner * rest))
    return np.where(x == 0, n * np.log1p(-p), np.where(x == n, n * np.log(p), body))


def _large_hypergeometric(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """Exact draws by ratio of uniforms (Stadlober 1990) for any counts, all at once."""
    # the law stays when good and bad change places, and when the sample and what it leaves do
    less, m = np.minimum(good, bad).astype(float), np.minimum(sample, good + bad - sample).astype(float)
    total = (good + bad).astype(float)
    p, share = m / total, less / total
    middle, spread = m * share + 0.5, np.sqrt((total - m) / (total - 1) * m * share * (1 - share) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    log_law = lambda z, at: _log_binomial(z, less[at], p[at]) + _log_binomial(m[at] - z, total[at] - less[at], p[at])
    out, left = np.zeros(len(less)), np.flatnonzero((less > 0) & (m > 0))
    peak = np.zeros(len(less))
    peak[left] = log_law(np.floor((m[left] + 1) * ((less[left] + 1) / (total[left] + 2))), left)
    while len(left):
        x, y = 1 - rng.random(len(left)), rng.random(len(left))
        z = np.floor(middle[left] + width[left] * (y - 0.5) / x)
        inside = (z >= 0) & (z <= np.minimum(m, less)[left]) & (m[left] - z <= (total - less)[left])
        ok = np.zeros(len(left), bool)
        ok[inside] = 2 * np.log(x[inside]) <= log_law(z[inside], left[inside]) - peak[left[inside]]
        out[left[ok]] = z[ok]
        left = left[~ok]
    out = out.astype(np.int64)
    out = np.where(good > bad, np.minimum(sample, good + bad - sample) - out, out)  # of the good ones in the smaller sample
    return np.where(2 * sample > good + bad, good - out, out)


def hypergeometric(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, sample: np.ndarray, large: int = 10**9) -> np.ndarray:
    """How many good ones samples hold; numpy's own draws serve totals below `large`, their limit."""
    few = good + bad < large
    out = np.zeros(len(good), np.int64)
    out[few] = rng.hypergeometric(good[few], bad[few], sample[few])
    out[~few] = _large_hypergeometric(rng, good[~few], bad[~few], sample[~few])
    return out


def communication_matrix(rows: list[int], shards: list[int], seed: int, large: int = 10**9) -> np.ndarray:
    """Counts by partition and shard with the given sums, each arrangement equally likely.

    Partitions are halved again and again: how much of each shard lies in the first half of a group of partitions is
    hypergeometric given the group's own counts, and all groups of one level are drawn at once.
    """
    if sum(rows) != sum(shards):
        raise ValueError("the partitions' and the shards' sizes differ in sum")
    rng, levels = np.random.default_rng(seed), [np.array(rows, dtype=np.int64)]
    if not len(rows):
        return np.zeros((0, len(shards)), np.int64)
    while len(levels[-1]) > 1:
        sizes = np.append(levels[-1], np.zeros(len(levels[-1]) % 2, np.int64))
        levels.append(sizes[0::2] + sizes[1::2])
    counts = np.array([shards], dtype=np.int64)
    for sizes in levels[-2::-1]:
        want, left, first = sizes[0::2].copy(), counts.sum(axis=1), np.zeros_like(counts)
        for s in range(counts.shape[1]):
            first[:, s] = hypergeometric(rng, counts[:, s], left - counts[:, s], want, large)
            want, left = want - first[:, s], left - counts[:, s]
        counts = np.stack((first, counts - first), axis=1).reshape(-1, counts.shape[1])[: len(sizes)]
    return counts


def shuffle_shards(rows: DataFrame, n_shards: int = 24, seed: int = 11, per_range: int = 20_000) -> DataFrame:
    """Adds shard (0 to n_shards - 1; sizes differ by one row at most) and slot (gapless from 0 in each shard).

    All columns stay, whatever their names, but those named shard and slot are replaced. Rows are moved as rows:
    nulls, repeated rows and equal ids are like any others, and an empty table gives an empty result. With the same
    files and settings a rerun gives the same shards.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    rows = rows.drop("shard", "slot")
    spark = rows.sparkSession
    at, part, row, ends, fine, start, hashed = (unused(rows, c) for c in ("_at", "_part", "_row", "_ends", "_range", "_start", "_h"))
    local = rows.withColumn(hashed, F.xxhash64(*map(_quoted, rows.columns), F.lit(seed))).sortWithinPartitions(hashed).drop(hashed)
    local = save(local.withColumn(at, F.monotonically_increasing_id()), "permuted")
    placed = local.withColumn(part, F.shiftright(at, 33)).withColumn(row, F.col(at).bitwiseAND(2**33 - 1))
    sizes = placed.groupBy(part).count().orderBy(part).collect()  # one row per map partition
    total = sum(r["count"] for r in sizes)
    matrix = communication_matrix([r["count"] for r in sizes], [total // n_shards + (s < total % n_shards) for s in range(n_shards)], seed)
    schema = T.StructType([T.StructField(part, T.LongType()), T.StructField(ends, T.ArrayType(T.LongType()))])
    cuts = spark.createDataFrame([(r[part], e.tolist()) for r, e in zip(sizes, matrix.cumsum(axis=1), strict=True)], schema)
    # eight bytes for each partition and shard: as the matrix itself, so a broadcast moves no row
    sent = placed.join(F.broadcast(cuts), part).withColumn("shard", F.size(F.filter(ends, lambda e: e <= F.col(row))))
    ranges = max(1, -(-total // (n_shards * per_range)))
    sent = sent.withColumn(hashed, F.xxhash64(at, F.lit(seed + 1))).withColumn(fine, F.pmod(hashed, F.lit(ranges)))
    sent = save(sent.drop(part, row, ends), "sent")
    forget(local)
    counted = sent.groupBy("shard", fine).agg(F.count("*").alias(start))
    before = F.coalesce(F.sum(start).over(W.partitionBy("shard").orderBy(fine).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counted = counted.select("shard", fine, before.alias(start))
    out = sent.withColumn("slot", F.row_number().over(W.partitionBy("shard", fine).orderBy(hashed, at)) - 1)
    out = out.join(counted, ["shard", fine]).withColumn("slot", (F.col("slot") + F.col(start)).cast("long"))
    return out.select(*map(_quoted, rows.columns), F.col("shard").cast("int").alias("shard"), "slot")


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")
