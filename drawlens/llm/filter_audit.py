"""Filter interaction audit: what each of five filters removes, in every order of applying them.

One scan over the Arrow buffers of whole texts gives each document a mask of the filters it fails: vectorised byte
classes, whose prefix sums at the documents' offsets count words, capitals, code points and symbols, and words as
hashes, sorted within each document and held against their bytes, for the distinct ones. The scan also gives a 128-bit
name of the text, by which the first document of equal texts is found over the whole table.

The masks are then counted by part (32 masks at most), and all orders are read off those counts: no document is looked
at again.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawlens.llm.common import bounded, forget, save

FILTERS = "ABCDE"
#: Byte classes: blank, capital, symbol, and the first byte of a code point.
BLANK, CAPITAL, SYMBOL, FIRST = 1, 2, 4, 8
_classes = np.zeros(256, np.uint8)
_classes[[0x20, *range(0x09, 0x0E)]] |= BLANK
_classes[ord("A") : ord("Z") + 1] |= CAPITAL
_classes[list(b"#$%&*|")] |= SYMBOL
_classes[[b for b in range(256) if b & 0xC0 != 0x80]] |= FIRST
#: Words of more bytes are hashed one by one.
LONG = 64
MULTIPLIER, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column's texts, one after the other, and n + 1 offsets; null texts are empty."""
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    if column.null_count:  # a null may still have bytes between its offsets
        gone = column.is_null().to_numpy(zero_copy_only=False)
        if (np.diff(at)[gone] > 0).any():
            keep = np.repeat(~gone, np.diff(at))
            at = np.concatenate(([0], np.cumsum(np.where(gone, 0, np.diff(at)))))
            data = data[keep]
    return data, at


def counts(flags: np.ndarray, at: np.ndarray, block: int = 1 << 22) -> np.ndarray:
    """How many flags are set between each two offsets, by prefix sums of blocks."""
    sums, before, end = np.zeros(len(at), np.int64), 0, len(flags)
    for low in range(0, end, block):
        prefix = np.cumsum(flags[low : low + block], dtype=np.int32)
        inside = np.flatnonzero((at > low) & (at <= low + len(prefix)))
        sums[inside] = before + prefix[at[inside] - low - 1]
        before += int(prefix[-1])
    sums[at >= end] = before
    return np.diff(sums)


def _lanes(padded: np.ndarray, starts: np.ndarray, lengths: np.ndarray, k: int) -> np.ndarray:
    """Bytes 8k to 8k + 7 of each word as a number, zeros behind its end. padded has eight more bytes than the text."""
    numbers = np.lib.stride_tricks.as_strided(padded[: len(padded) - 7].view(np.uint8), (len(padded) - 7, 8), (1, 1))
    taken = np.ascontiguousarray(numbers[np.minimum(starts + 8 * k, len(padded) - 8)]).view("<u8")[:, 0]
    left = np.clip(lengths - 8 * k, 0, 8).astype(np.uint64)
    keep = np.where(left == 8, ~np.uint64(0), (np.uint64(1) << (left * np.uint64(8))) - np.uint64(1))
    return taken & keep


def word_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    h = lengths.astype(np.uint64) * MULTIPLIER
    at = np.arange(len(starts))
    for k in range(-(-min(LONG, int(lengths.max(initial=0))) // 8)):
        at = at[lengths[at] > 8 * k]
        x = (h[at] ^ _lanes(padded, starts[at], lengths[at], k)) * SPREAD
        h[at] = (x ^ (x >> np.uint64(29))) * MULTIPLIER
    for i in np.flatnonzero(lengths > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + lengths[i]])
    return h


def distinct(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, owner: np.ndarray, n: int, hashes=word_hashes) -> np.ndarray:
    """Distinct words of each of n texts. Words are sorted by hash within their text; neighbours of one hash are held
    against each other byte by byte, and a text in which two of them differ is counted by its words themselves."""
    h = hashes(data, starts, lengths)
    order = np.lexsort((lengths, h, owner))
    o, s, w, h = owner[order], starts[order], lengths[order], h[order]
    twin = np.flatnonzero((o[1:] == o[:-1]) & (h[1:] == h[:-1]))
    same = w[twin] == w[twin + 1]
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    left, k = twin[same], 0
    broken = set(o[twin[~same]].tolist())
    short = left[w[left] <= LONG]
    while len(short):
        equal = _lanes(padded, s[short], w[short], k) == _lanes(padded, s[short + 1], w[short], k)
        broken.update(o[short[~equal]].tolist())
        k += 1
        short = short[w[short] > 8 * k]
    for i in left[w[left] > LONG].tolist():
        if not np.array_equal(data[s[i] : s[i] + w[i]], data[s[i + 1] : s[i + 1] + w[i]]):
            broken.add(int(o[i]))
    new = np.ones(len(order), bool)
    new[twin + 1] = False
    out = np.bincount(o[new], minlength=n)
    for i in broken:
        mine = np.flatnonzero(owner == i)
        out[i] = len({data[starts[j] : starts[j] + lengths[j]].tobytes() for j in mine.tolist()})
    return out


def scan(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text the mask of failed filters A to D (bit 0 to 3), and its 128-bit name as two longs."""
    data, at = text_buffers(column)
    kinds, n = _classes[data], len(at) - 1
    word = (kinds & BLANK) == 0
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = at[(at > 0) & (at < len(data))]
    begins[inner] = word[inner]  # a text's first byte starts a word whatever stands before it
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    ends[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) + 1 - starts
    words = counts(begins, at)
    owner = np.repeat(np.arange(n), words)
    different = distinct(data, starts, lengths, owner, n)
    capitals, symbols, points = (counts((kinds & kind) != 0, at) for kind in (CAPITAL, SYMBOL, FIRST))
    mask = (words < 200) * 1 + (100 * different < 50 * words) * 2 + (100 * capitals > 2 * points) * 4 + (symbols > 0) * 8
    names = np.array([divmod(xxhash.xxh3_128_intdigest(data[a:b]), 2**64) for a, b in itertools.pairwise(at.tolist())], np.uint64).reshape(-1, 2)
    return mask.astype(np.int32), names.view(np.int64)


def masks(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """doc_id, part, mask (bits 0 to 4: fails A to E), one row per document; and the stored stages that it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in bounded(whole)):
            mask, names = scan(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), batch.column("part"), pa.array(mask), pa.array(names[:, 0]), pa.array(names[:, 1])], names=["doc_id", "part", "mask", "h0", "h1"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    found = save(texts.mapInArrow(run, "doc_id long, part string, mask int, h0 long, h1 long"), "masks")
    # a text that stands once in the table needs no look at the others
    again = found.groupBy("h0", "h1").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = save(again, "again")  # so that a join of plain rows follows, which Spark can split where one text is very frequent
    copy = F.col("least").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("least")))
    return found.join(again, ["h0", "h1"], "left").select("doc_id", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask")), [found, again]


def _sum(where, what) -> Column:
    """Sum of a count over the masks (an array by mask) for which where(mask) holds."""
    return F.aggregate(F.transform("cells", lambda c, m: F.when(where(m), c[what]).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter_order and step, as the module says: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley.

    A part is a source; a null source is the part '', with a source of that name. Null texts are empty. Of rows with
    one doc_id none is a copy of another; a row without an id comes after all that have one, and is no copy of others
    without. A document with several labels is good (toxic) if one of them says so; labels without an id match none.
    Rows count each; other columns are ignored; an empty table gives no rows.
    """
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    n = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    masked, scanned = masks(docs)
    cells = masked.join(known, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), n("good", "good"), n("toxic", "toxic"))
    cells = save(cells, "cells")  # 32 rows a part at most
    forget(*scanned)
    parts = cells.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("by_mask"))  # 32 masks at most
    none = F.struct(*(F.lit(0).cast("long").alias(c) for c in ("n", "good", "toxic")))
    parts = parts.select("part", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda m: F.coalesce(F.get(F.map_values(F.map_filter("by_mask", lambda k, _: k == m)), F.lit(0)), none)).alias("cells"))
    orders = [F.struct(F.lit("".join(o)).alias("filter_order"), F.array(*(F.lit(1 << FILTERS.index(f)) for f in o)).alias("bits")) for o in itertools.permutations(FILTERS)]
    rows = parts.select("part", "cells", F.explode(F.array(*orders)).alias("o"))
    rows = rows.select("part", "cells", "o.*", F.posexplode("o.bits").alias("place", "bit"))
    rows = rows.withColumn("before", F.aggregate(F.slice("bits", F.lit(1), F.col("place")), F.lit(0), lambda a, b: a + b))
    fails = lambda m: m.bitwiseAND(F.col("bit")) != 0
    first = lambda m: fails(m) & (m.bitwiseAND(F.col("before")) == 0)
    # of the 120 orders, a filter comes first among k that fail in 120 / k
    orders_of = lambda m: F.get(F.array(*map(F.lit, (0, 120, 60, 40, 30, 24))), F.bit_count(m))
    share = F.aggregate(F.transform("cells", lambda c, m: F.when(fails(m), c["n"] * orders_of(m)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(
        "part",
        "filter_order",
        (F.col("place") + 1).alias("step"),
        _sum(lambda m: m.bitwiseAND(F.col("before").bitwiseOR(F.col("bit"))) == 0, "n").alias("kept"),
        _sum(first, "n").alias("removed"),
        _sum(lambda m: fails(m) & (m.bitwiseAND(F.col("before")) != 0), "n").alias("redundant"),
        _sum(lambda m: m == F.col("bit"), "n").alias("unique_fails"),
        _sum(first, "good").alias("good_lost"),
        _sum(first, "toxic").alias("toxic_lost"),
        share.alias("shapley"),
    )


AUDIT_SQL = r"""
    WITH docs AS (
        SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
    ), failed AS (
        SELECT doc_id, part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
               100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * len(text), regexp_matches(text, '[#$%&*|]'),
               doc_id > min(doc_id) OVER (PARTITION BY text)] AS f FROM docs
    ), known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
    cells AS (SELECT part, f, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM failed LEFT JOIN known USING (doc_id) GROUP BY part, f),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
    orders AS (
        SELECT a.l || b.l || c.l || d.l || e.l AS o FROM letters a, letters b, letters c, letters d, letters e
        WHERE a.l NOT IN (b.l, c.l, d.l, e.l) AND b.l NOT IN (c.l, d.l, e.l) AND c.l NOT IN (d.l, e.l) AND d.l <> e.l
    ), placed AS (
        SELECT o, s::INT AS s, ascii(o[s]) - 64 AS i, [ascii(x) - 64 FOR x IN string_split(o[1:(s - 1)], '') IF x <> ''] AS before FROM orders, range(1, 6) t(s)
    ), told AS (
        SELECT part, o, s, i, n, good, toxic, f[i] AS fails, len([x FOR x IN before IF f[x]]) > 0 AS gone, len([x FOR x IN f IF x]) AS k FROM cells, placed
    ), counted AS (
        SELECT part, o AS filter_order, s AS step, i, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
               coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND k = 1), 0)::BIGINT AS unique_fails,
               coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost
        FROM told GROUP BY part, o, s, i
    )
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, i)::BIGINT AS shapley FROM counted
"""
