"""Vector code compression: product codes with vantage-point trees over the entries of each part position.

A vector is cut into equal parts, and each part position has a codebook. Codebooks are refined in rounds: every part
goes to its nearest entry, and each entry becomes the mean of its parts, all in whole numbers. A round is one pass
over the table that gives a count and a sum for each entry; only the codebooks (parts x entries x components numbers)
pass through the driver.

The nearest entry is found in a vantage-point tree: an entry, the others split by their distance from it, and for each
half the range of those distances. By the triangle inequality a half can be left out if its range lies further from
the part's own distance than the best entry so far. Distances are square roots of whole numbers, so all bounds are
rounded outward; a half that may hold an equally near entry is visited, and entries are compared by their whole
squared distances, ties to the lower index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers of this size at most have squared distances of 64 components in 64 bits; larger ones are Python's own.
SAFE = 2**27
#: Relative errors of a conversion and a square root are below 2**-52 together.
DOWN, UP = 1 - 2.0**-50, 1 + 2.0**-50
#: Sums are sent in two parts, as decimals of 38 digits.
SPLIT = 10**30


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite values, in 64 bits where that is safe and else as Python's numbers."""
    x = np.floor(values.astype(np.float64) * scale)
    if not x.size or np.abs(x).max() <= SAFE:
        return x.astype(np.int64)
    return np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)


def squared(rows: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Whole squared distances of rows from one entry."""
    gap = rows - entry
    return (gap * gap).sum(axis=1) if rows.dtype != object else np.array([sum(int(x) ** 2 for x in r) for r in gap], dtype=object)


def roots(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(np.float64))


@dataclass
class Node:
    """An entry and what is left, split by distance from it: (least and greatest distance, rounded outward; node)."""

    entry: int
    halves: list[tuple[float, float, Node | list[int]]]


def tree(entries: np.ndarray, members: list[int] | None = None, leaf: int = 3) -> Node | list[int]:
    """A vantage-point tree over the members; few are a plain list."""
    members = list(range(len(entries))) if members is None else members
    if len(members) <= leaf:
        return members
    first, rest = members[0], np.array(members[1:])
    apart = squared(entries[rest], entries[first])
    order = sorted(range(len(rest)), key=lambda i: (apart[i], rest[i]))
    halves = []
    for part in (order[: len(order) // 2], order[len(order) // 2 :]):
        d = roots(np.array([apart[i] for i in part], dtype=apart.dtype))
        halves.append((float(d.min()) * DOWN, float(d.max()) * UP, tree(entries, sorted(int(rest[i]) for i in part), leaf)))
    return Node(first, halves)


class Searcher:
    """Nearest entries of one part position."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.top = entries, tree(entries)
        self.visited = 0

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the index of its nearest entry (ties: the lowest) and the squared distance."""
        entries = self.entries
        if rows.dtype != entries.dtype:
            rows, entries = rows.astype(object), entries.astype(object)
        best = np.full(len(rows), -1, np.int64)
        least = np.zeros(len(rows), rows.dtype)

        def meet(i: int, at: np.ndarray) -> np.ndarray:
            self.visited += len(at)
            square = squared(rows[at], entries[i])
            better = (best[at] < 0) | (square < least[at]) | ((square == least[at]) & (i < best[at]))
            won = at[better.astype(bool)]
            best[won], least[won] = i, square[better.astype(bool)]
            return square

        def visit(node: Node | list[int], at: np.ndarray) -> None:
            if not len(at):
                return
            if isinstance(node, list):
                for i in node:
                    meet(i, at)
                return
            d = roots(meet(node.entry, at))
            (_, inner, _), (outer, _, _) = node.halves
            near = d <= (inner + outer) / 2  # which half first; either order is right
            for first, second, which in ((node.halves[0], node.halves[1], near), (node.halves[1], node.halves[0], ~near)):
                for low, high, below in (first, second):
                    here, away = at[which], d[which]
                    reach = roots(least[here]) * UP
                    may = (away * UP + reach >= low) & (away * DOWN - reach <= high)
                    visit(below, here[may])

        if len(entries):
            visit(self.top, np.arange(len(rows)))
        return best, least


def _long(value: int) -> int | None:
    return int(value) if -(2**63) <= value < 2**63 else None


class Codebooks:
    """Entries by part position, with a tree over each."""

    def __init__(self, entries: list[np.ndarray]):
        self.entries = entries
        self.searchers = [Searcher(e) for e in entries]

    def assign(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows x parts) and squared distances summed over parts."""
        cut = np.split(rows, len(self.entries), axis=1)
        found = [s.nearest(np.ascontiguousarray(part)) for s, part in zip(self.searchers, cut, strict=True)]
        total = found[0][1]
        for _, square in found[1:]:
            total = total.astype(object) + square.astype(object) if object in (total.dtype, square.dtype) else total + square
        return np.stack([best for best, _ in found], axis=1), total

    def digest(self) -> str:
        numbers = ",".join(str(int(x)) for book in self.entries for entry in book for x in entry)
        return hashlib.sha256(numbers.encode()).hexdigest()


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and holds finite numbers only, as doubles."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.where(F.col(vector).isNotNull()).where(~F.exists(vector, odd))


def _rows(batch: pa.RecordBatch, width: int, scale: int, at_once: int = 4096) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The batch in runs of rows, each with its vectors' whole numbers."""
    for at in range(0, batch.num_rows, at_once):
        part = batch.slice(at, at_once)
        values = part.column("vector").flatten().to_numpy(zero_copy_only=False)
        yield part, whole(values.reshape(part.num_rows, width), scale)


def _sums(kept: DataFrame, books: Codebooks, scale: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Count and component sums of each part position and entry; parts x entries x components rows at most."""
    width = sum(book.shape[1] for book in books.entries)
    sent = kept.sparkSession.sparkContext.broadcast(books)  # parts x entries rows of a part's length
    kind = pa.decimal128(38, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import decimal

        books = sent.value
        totals: dict[tuple[int, int], list] = {}
        for batch in batches:
            for part, rows in _rows(batch, width, scale):
                codes, _ = books.assign(rows)
                for p, cut in enumerate(np.split(rows, len(books.entries), axis=1)):
                    for e in np.unique(codes[:, p]).tolist():
                        mine = cut[codes[:, p] == e]
                        seen = totals.setdefault((p, e), [0, [0] * cut.shape[1]])
                        seen[0] += len(mine)
                        seen[1] = [a + int(b) for a, b in zip(seen[1], mine.sum(axis=0), strict=True)]
        rows = [(p, e, j, n, *divmod(x, SPLIT)) for (p, e), (n, sums) in totals.items() for j, x in enumerate(sums)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        yield pa.record_batch([*(pa.array(c, pa.int32()) for c in columns[:3]), pa.array(columns[3], pa.int64()), *(pa.array([decimal.Decimal(x) for x in c], kind) for c in columns[4:])], names=["part", "entry", "j", "n", "high", "low"])

    found = kept.select("vector").mapInArrow(run, "part int, entry int, j int, n long, high decimal(38,0), low decimal(38,0)")
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in sorted(found.groupBy("part", "entry", "j").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).collect(), key=lambda r: (r.part, r.entry, r.j)):
        out.setdefault((r.part, r.entry), (r.n, []))[1].append(int(r.high) * SPLIT + int(r.low))
    return out


def _book(rows: list[list[int]]) -> np.ndarray:
    large = any(abs(x) > SAFE for r in rows for x in r)
    return np.array(rows, dtype=object if large else np.int64)


def fit(kept: DataFrame, parts: int, entries: int, rounds: int, scale: int) -> Codebooks | None:
    """Codebooks over all rows of kept (id, vector); None for an empty table."""
    first = kept.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).collect()
    if not first:
        return None
    width = len(first[0].vector)
    if not width or width % parts:
        raise ValueError(f"vectors of {width} components can't be cut in {parts} equal parts")
    start = whole(np.array([list(r.vector) for r in first], np.float64), scale)
    books = Codebooks([_book([[int(x) for x in r] for r in cut]) for cut in np.split(start, parts, axis=1)])
    for _ in range(rounds):
        sums = _sums(kept, books, scale)
        books = Codebooks([
            _book([[x // sums[p, e][0] for x in sums[p, e][1]] if (p, e) in sums else [int(x) for x in entry] for e, entry in enumerate(book)])
            for p, book in enumerate(books.entries)
        ])
    return books


def vector_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per usable vector: vec_id, code (two hex digits a part), error, label_error, codebooks_sha256.

    Needs the three columns named; others are ignored. Dropped are null vectors, those with null or non-finite
    components, and those whose length differs from the first one's (by id, then vector). Null ids come last where
    the first vectors are chosen, equal ids in order of their vectors; repeated rows count and come back each. Fewer
    rows than entries give smaller codebooks. Null labels are one label. An error that is more than a long is null.
    An empty table gives an empty result.
    """
    kept = usable(vectors, vector).select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).alias("label"))
    schema = f"id long, label {dict(kept.dtypes)['label']}, code string, error long"
    head = kept.orderBy(F.asc_nulls_last("id"), "vector").select(F.size("vector").alias("n")).first()
    if head is None:
        return _labelled(kept.sparkSession.createDataFrame([], schema), "")
    kept = kept.where(F.size("vector") == head.n)
    books = fit(kept, parts, entries, rounds, scale)
    sent = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        for batch in batches:
            for part, rows in _rows(batch, head.n, scale):
                codes, error = books.assign(rows)
                text = ["".join(f"{c:02x}" for c in r) for r in codes.tolist()]
                yield pa.record_batch([part.column("id"), part.column("label"), pa.array(text, pa.string()), pa.array([_long(x) for x in error.tolist()], pa.int64())], names=["id", "label", "code", "error"])

    return _labelled(kept.mapInArrow(run, schema), books.digest())


def _labelled(coded: DataFrame, digest: str) -> DataFrame:
    """Adds the errors summed over equal labels. A label may have any share of the rows: they are summed before they
    meet, and what joins them is one row for each label."""
    per = coded.groupBy(F.col("label").alias("_label")).agg(F.count("error").alias("_n"), F.count("*").alias("_all"), F.try_sum("error").alias("_sum"))
    total: Column = F.when(F.col("_n") == F.col("_all"), F.col("_sum")).alias("label_error")
    out = coded.join(per, F.col("label").eqNullSafe(F.col("_label")))
    return out.select(F.col("id").alias("vec_id"), "code", "error", total, F.lit(digest).alias("codebooks_sha256"))


def codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """vector_codes over embeddings in DuckDB's SQL, for finite vectors of one length and numbers of moderate size."""
    steps = [f"""
        kept AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), cut AS MATERIALIZED (
            SELECT vec_id, label, p, v[(p * len(v) // {parts} + 1):((p + 1) * len(v) // {parts})] AS x FROM kept, range({parts}) t(p)
        ), first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {entries}),
        book0 AS MATERIALIZED (SELECT p, e, x AS c FROM cut JOIN first USING (vec_id))"""]  # fmt: skip
    square = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for i in range(rounds + 1):
        steps.append(f"""near{i} AS MATERIALIZED (
            SELECT vec_id, label, p, any_value(x) AS x, min(struct_pack(d := {square}, e := e)) AS best FROM cut JOIN book{i} USING (p) GROUP BY vec_id, label, p)""")
        if i < rounds:
            steps.append(f"""mean{i} AS (
                SELECT p, e, list(m ORDER BY j) AS c FROM (
                    SELECT p, best.e AS e, j, (sum(x[j])::HUGEINT - ((sum(x[j])::HUGEINT % count(*)) + count(*)) % count(*)) // count(*) AS m FROM near{i}, range(1, len(x) + 1) t(j) GROUP BY p, best.e, j
                ) GROUP BY p, e
            ), book{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c)::BIGINT[] AS c FROM book{i} b LEFT JOIN mean{i} m USING (p, e))""")
    return "WITH " + ", ".join(steps) + f"""
        , coded AS (SELECT vec_id, label, string_agg(printf('%02x', best.e::INT), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id, label)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
               (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
        FROM coded"""  # fmt: skip
