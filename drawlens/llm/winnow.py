"""Document fingerprints by winnowing (Schleimer, Wilkerson & Aiken 2003).

Every k-gram of code points has a rolling hash; of each window of w consecutive k-grams the smallest hash is
chosen, the rightmost of equal ones, and kept with its position. Any passage of at least w + k - 1 code points
that two texts share gives both a common choice. A text shorter than a window has its smallest hash chosen, one
shorter than k counts as one gram.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, WINDOW = 24, 96
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n or more."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((BASE, pow(BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0], _powers[1]


def gram_hashes(codes: np.ndarray, k: int = K) -> np.ndarray:
    """A 32-bit hash of each k-gram of code points, from prefix sums of codes[i] * BASE**i."""
    up, down = _power_tables(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=sums[1:])
    k = min(k, len(codes))
    h = (sums[k:] - sums[: len(sums) - k]) * down[: len(codes) - k + 1]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) & np.uint64(0xFFFFFFFF)


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes and their positions, in order of position; none for an empty text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = gram_hashes(codes, k)
    # the smallest key has the smallest hash and, of equal ones, the largest position
    keys = (h << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
    if len(keys) <= window:
        chosen = keys.min(keepdims=True)
    else:
        blocks = -(-len(keys) // window)
        padded = np.full(blocks * window, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(keys)] = keys
        grid = padded.reshape(blocks, window)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()  # of a block's start up to here
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()  # from here to the block's end
        least = np.minimum(behind[: len(keys) - window + 1], ahead[window - 1 : len(keys)])
        chosen = least[np.concatenate(([True], least[1:] != least[:-1]))]
    return chosen >> np.uint64(32), (np.uint64(0xFFFFFFFF) - (chosen & np.uint64(0xFFFFFFFF))).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of chosen hashes; of two empty ones 1."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, hashes and positions (parallel arrays, by position).

    A null or empty text has empty arrays. Equal texts have equal results; repeated rows stay; an empty table gives
    an empty result; columns other than doc_id and text are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [winnow(t.as_py() or "", k, window) for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), pa.array([x.astype(np.int64) for x, _ in found], pa.list_(pa.int64())), pa.array([x for _, x in found], pa.list_(pa.int64()))], names=["doc_id", "hashes", "positions"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, hashes array<long>, positions array<long>")


class _Ranges:
    """Ranges of (at, h) in order, with a number for each; a range of one value only may have several numbers.

    at: bounds, as quantiles of the rows. A bound that several quantiles share is the id of many rows, which become
    ranges of their own, cut by the quantiles of their h; and a value of h that several of those share is the text of
    many rows, which may go to any of that range's numbers.
    """

    def __init__(self, at: list[int], within: dict[int, list[int]]):
        hot = {x: at.count(x) for x in set(at)}
        self.at = np.array(sorted({x for x in at} | {x + 1 for x in within if x < 2**63 - 1}), dtype=np.int64)
        self.cuts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.first, n = [0], 1
        for x in self.at.tolist():
            self.first.append(n)
            if x in within and hot.get(x, 0) > 1:
                h = sorted(within[x])
                cuts = np.array(sorted({y for v in set(h) for y in ((v, v + 1) if h.count(v) > 1 and v < 2**63 - 1 else (v,))}), dtype=np.int64)
                many = np.array([1] + [max(1, h.count(v)) for v in cuts.tolist()], dtype=np.int64)
                self.cuts[x] = cuts, np.concatenate(([0], np.cumsum(many)[:-1])), many
                n += int(many.sum())
            else:
                n += 1
        self.first = np.array(self.first, dtype=np.int64)

    def of(self, at: np.ndarray, h: np.ndarray, row: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.at, at, side="right")
        out = self.first[i]
        for x, (cuts, before, many) in self.cuts.items():
            mine = at == x
            if mine.any():
                j = np.searchsorted(cuts, h[mine], side="right")
                out[mine] += before[j] + row[mine] % many[j]
        return out.astype("int32")


def with_next(docs: DataFrame, run, schema: str, per_task: int = 3) -> DataFrame:
    """Applies run to the documents in ascending doc_id (null first, equal ids by a hash of the text), each range with
    the next range's first document, marked guest, after it; the first document of all follows the last.

    The text moves once, and the first ones of the ranges once more. Bounds are quantiles, so ranges are as many as the
    tasks (a few times). Rows of one id, or without any, are dealt out by their texts, and equal rows at will, as any
    of them is the others' next one; so no id and no text fills a task.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("at"), F.xxhash64("text").alias("h"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = tasks * per_task
    points = [i / parts for i in range(1, parts)]
    bounds = docs.agg(F.percentile_approx("at", points, 100 * parts)).first()[0] or []
    hot = sorted({x for x in bounds if bounds.count(x) > 1})  # ids of more than one range's rows: no more than ranges
    inner = docs.where(F.col("at").isin(hot)).groupBy("at").agg(F.percentile_approx("h", points, 10 * parts).alias("h")).collect() if hot else []
    thin = lambda h, n: h[:: max(1, parts // (n + 1))]  # noqa: E731  as many cuts as the id has ranges
    ranges = _Ranges(bounds, {r["at"]: thin(r["h"], bounds.count(r["at"])) for r in inner})

    @F.pandas_udf("int")
    def part_of(at: pd.Series, h: pd.Series, row: pd.Series) -> pd.Series:
        return pd.Series(ranges.of(at.to_numpy(), h.to_numpy(), row.to_numpy()))

    rows = docs.withColumn("part", part_of("at", "h", F.monotonically_increasing_id()))
    firsts = rows.groupBy("part").agg(F.min(F.struct("at", "h")).alias("key")).orderBy("part").collect()  # a row for each range
    owners = [(b.key["at"], b.key["h"], a["part"]) for a, b in zip(firsts, firsts[1:] + firsts[:1], strict=True)]
    heads = spark.createDataFrame(owners, "at long, h long, part int")
    texts = docs.join(F.broadcast(heads.select("at", "h").distinct()), ["at", "h"]).groupBy("at", "h").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    guests = texts.join(F.broadcast(heads), ["at", "h"])
    sent = rows.select("doc_id", "text", "at", "h", "part", F.lit(0).alias("guest")).unionByName(guests.select("doc_id", "text", F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("h"), "part", F.lit(1).alias("guest")))
    return sent.repartition(tasks, "part").sortWithinPartitions("part", "guest", "at", "h").mapInArrow(run, schema)


def _text_of(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex(" ", 4) if len(hashes) else ""


def edited_fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last half is the next document's start, as doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint (hashes in hexadecimal, by position), near_edited,
    near_next, and positions and edited_positions (of the hashes, in code points). A run of k + window - 1 code points
    that a text shares with another has a common hash at its place in both.

    Null texts count as empty. The only document of a table is its own next one. Rows that repeat a doc_id follow each
    other in order of a hash of their texts. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "positions", "edited_positions"]
        last, rows, done = None, [], None

        def pair(now: tuple, following: tuple) -> None:
            doc, text, own, at = now
            _, other, theirs, _ = following
            half = len(text) // 2
            edited = text[: len(text) - half] + other[:half]
            changed, places = winnow(edited, k, window)
            digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            rows.append((doc, len(text), digest, _text_of(own), _text_of(changed), likeness(own, changed), likeness(own, theirs), at, places))

        for batch in batches:
            for doc, text, guest, part in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "guest", "part")), strict=True):
                if guest and (done == part or last is None):
                    continue  # one guest is enough
                this = (doc, text or "", *winnow(text or "", k, window))
                if last is not None:
                    pair(last, this)
                last, done = (None, part) if guest else (this, None)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 9, kinds, strict=True)], names=names)
            rows.clear()

    return with_next(docs, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<long>, edited_positions array<long>")
