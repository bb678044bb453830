"""Quality rules: repetition coverage.

Per document, words become numbers and each n-gram a rolling 64-bit hash (H(n, i) = H(n-1, i) * B + word[i+n-1]),
for all n-gram lengths in one sweep of numpy. An n-gram found before in the text marks its words; the share of the
text's characters inside marked words is the coverage for that n (the first occurrence is left out). For the short lengths the characters of the most
frequent n-gram count instead. Repeated lines are measured in the same way. Limits follow published rules for
web text (Rae et al. 2021).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: n-gram length: largest share of characters in its most frequent n-gram.
TOP_LIMITS = {2: 0.20, 3: 0.18, 4: 0.16}
#: n-gram length: largest share of characters inside n-grams that repeat an earlier one.
DUP_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of characters in lines equal to an earlier line.
LINE_LIMIT = 0.30

SPACE, SYMBOL, START = 1, 2, 3
CLASSES = np.full(256, START, dtype=np.uint8)
CLASSES[0x80:0xC0] = 0  # continuation bytes
CLASSES[[0x20, *range(0x09, 0x0E)]] = SPACE
CLASSES[[*b"#*$%&|<>"]] = SYMBOL
BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _covered(dup: np.ndarray, n: int, n_words: int) -> np.ndarray:
    """Which words lie in a marked n-gram."""
    edge = np.zeros(n_words + 1, dtype=np.int64)
    at = np.flatnonzero(dup)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def _lengths(text: bytes) -> Callable[[bytes], int]:
    """Counts the code points of parts of a UTF-8 text."""
    return len if text.isascii() else lambda part: len(part.decode("utf-8", "replace"))


def measure(text: bytes, window: int = 8, top: tuple[int, ...] = tuple(TOP_LIMITS), dup: tuple[int, ...] = tuple(DUP_LIMITS)) -> dict[str, float]:
    """All measures of one UTF-8 text; an empty text has zeros."""
    kinds = np.bincount(CLASSES[np.frombuffer(text, np.uint8)], minlength=4)
    words = text.split()
    out = {"n_words": len(words), "word_chars": int(kinds[SYMBOL] + kinds[START]), "n_symbols": int(kinds[SYMBOL]), "n_dup_lines": 0, "n_repeat_words": 0, "dup_line_share": 0.0}
    chars = _lengths(text)
    seen, line_chars = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            if not line or line.isspace():
                continue
            out["n_dup_lines"] += 1
            line_chars += chars(line)
        else:
            seen.add(line)
    out["dup_line_share"] = line_chars / max(1, chars(text))
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    lengths = np.fromiter(map(chars, words), np.int64, len(words))
    total, sums = max(1, int(lengths.sum())), np.concatenate(([0], np.cumsum(lengths)))
    token = _mix((ids + 1).astype(np.uint64) * BASE)
    h = token
    for n in range(1, max((window, *top, *dup)) + 1):
        if n > 1:
            h = h[:-1] * BASE + token[n - 1 :] if len(h) else h
        if not len(h) or n not in (window, *top, *dup):
            for key in [f"top_{n}"] * (n in top) + [f"dup_{n}"] * (n in dup):
                out[key] = 0.0
            continue
        _, first, back, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        if n in top:
            size = (sums[first + n] - sums[first]) * count
            out[f"top_{n}"] = min(1.0, float(size[count > 1].max(initial=0)) / total)
        if n in dup or n == window:
            twice, again = count[back] > 1, np.arange(len(h)) != first[back]
            if n in dup:
                out[f"dup_{n}"] = float(lengths[_covered(again, n, len(words))].sum()) / total if twice.any() else 0.0
            if n == window:
                out["n_repeat_words"] = int(_covered(twice, n, len(words)).sum()) if twice.any() else 0
    return out


def passes(m: dict[str, float], top: dict[int, float] = TOP_LIMITS, dup: dict[int, float] = DUP_LIMITS, lines: float = LINE_LIMIT) -> bool:
    return all(m[f"top_{n}"] <= x for n, x in top.items()) and all(m[f"dup_{n}"] <= x for n, x in dup.items()) and m["dup_line_share"] <= lines


def quality_rules(docs: DataFrame, top: dict[int, float] = TOP_LIMITS, dup: dict[int, float] = DUP_LIMITS, lines: float = LINE_LIMIT, min_words: int = 20, repeat_percent: int = 30, window: int = 8) -> DataFrame:
    """One row per document: doc_id, the base counts, every measure, base_failed and kept.

    Needs doc_id and text; other columns are ignored. A null or empty text has no words and fails the base rule.
    Texts are taken whole; characters are code points, whatever the script. Repeated rows give repeated results; an empty table gives an empty result.
    """
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    shares = ["dup_line_share", *(f"top_{n}" for n in top), *(f"dup_{n}" for n in dup)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t.as_py() or b"", window, tuple(top), tuple(dup)) for t in batch.column("text")]
            failed = [m["n_words"] < min_words or 100 * m["n_repeat_words"] > repeat_percent * m["n_words"] for m in rows]
            kept = [not f and passes(m, top, dup, lines) for f, m in zip(failed, rows, strict=True)]
            columns = [pa.array([m[c] for m in rows], pa.int64()) for c in longs] + [pa.array([m[c] for m in rows], pa.float64()) for c in shares]
            yield pa.record_batch([batch.column("doc_id"), *columns, pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())], names=["doc_id", *longs, *shares, "base_failed", "kept"])

    schema = "doc_id long, " + ", ".join([f"{c} long" for c in longs] + [f"{c} double" for c in shares]) + ", base_failed boolean, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)
