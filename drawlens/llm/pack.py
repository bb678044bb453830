"""Packing: concatenate and cut.

Pass 1 tokenizes once, in the order of the input partitions, and stores each document's ids with the number of
ids before it in its partition. The partitions' totals (one row each) give every partition its global offset.
Pass 2 reads the stored ids and cuts the one long stream of ids in windows of the sequence length; a document
that crosses a window's end is cut there, and each piece records where it lies. Nothing is shuffled.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from drawlens.llm.common import bounded, lean, save

#: White space other than the space and the line feed.
RARE = [chr(c) for c in (*range(0x09, 0x0A), *range(0x0B, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: A space between two characters that are no white space.
ALONE = re.compile(r"(?<=\S) (?=\S)")
SPACE = re.compile(r"\s")


class Encoder:
    """Ids of texts by the tokenizers library, exactly those of Tokenizer.encode(text, add_special_tokens=False).

    A byte-level BPE with the usual pattern never joins what stands on the two sides of a single space or line feed
    between other characters, so texts are cut there; the first `kept` different pieces, of `width` characters at most,
    are encoded once and stay, the others once in each batch. A text that holds the text of an added token is encoded as it is.
    Pieces without white space inside are encoded `joined` at a time, as that costs less than one by one: a token that
    starts with a space or a line feed is then the first of a piece.
    """

    def __init__(self, name: str, kept: int = 300_000, width: int = 48, joined: int = 32):
        import public_tokenizers as P
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core
        self.tokenizer = Tokenizer.from_file(P.path(f"{name}.json"))
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4"
        self.pieces: dict[str, bytes] = {}
        self.kept, self.width = kept, width
        self.joined = 1 if any(map(SPACE.search, self.added)) else joined  # no added token may arise between pieces
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # ids of tokens that start with a space or a line feed
        self.opens[[i for t, i in vocabulary.items() if t[:1] in ("\u0120", "\u010a")]] = True

    def _bytes(self, texts: list[str], at_once: int = 1000) -> list[bytes]:
        """at_once: how many encodings, each far larger than its ids, are held together."""
        parts = (self.tokenizer.encode_batch_fast(texts[i : i + at_once], add_special_tokens=False) for i in range(0, len(texts), at_once))
        return [np.array(e.ids, self.kind).tobytes() for part in parts for e in part]

    def _cut(self, text: str) -> tuple[str, list[str]]:
        """What is encoded as it is, and the pieces after it: one that starts with a line feed, or else one that a
        space comes before."""
        if any(t in text for t in self.added):
            return text, []
        if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or any(c in text for c in RARE) or text[:1] in (" ", "\n") or text[-1:] in (" ", "\n"):
            first, *rest = ALONE.split(text)
            return first, rest
        first, *rest = text.replace("\n", " \n").split(" ")
        return first, rest

    def _together(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces that start with their white space and hold no other, encoded side by side."""
        out, size = [], np.dtype(self.kind).itemsize
        runs = [pieces[i : i + self.joined] for i in range(0, len(pieces), self.joined)]
        for run, found in zip(runs, self._bytes(["".join(r) for r in runs], 64), strict=True):
            at = np.flatnonzero(self.opens[np.frombuffer(found, self.kind)])
            if len(at) != len(run):  # a vocabulary whose tokens do not show where a piece starts
                out += self._bytes(run)
                continue
            at = [*(at * size).tolist(), len(found)]
            out += [found[a:b] for a, b in itertools.pairwise(at)]
        return out

    def _encoded(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of each piece."""
        plain, other = [], []
        for p in pieces:
            (other if SPACE.search(p, 1) else plain).append(p)
        whole = lambda some: [p if p[0] == "\n" else " " + p for p in some]
        return dict(zip([*plain, *other], [*self._together(whole(plain)), *self._bytes(whole(other))], strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian numbers of self.kind."""
        cut = [self._cut(t) for t in texts]
        heads = self._bytes([first for first, _ in cut])
        pieces = pa.array([p for _, rest in cut for p in rest], pa.large_string()).dictionary_encode()
        different, seen = pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), self.pieces  # far cheaper than to_pylist
        new = self._encoded([p for p in different if p not in seen])
        ids = pa.array([seen[p] if p in seen else new[p] for p in different], pa.large_binary()).take(pieces.indices)
        for p in new:  # the frequent pieces come early, so those kept first stay
            if len(seen) >= self.kept:
                break
            if len(p) <= self.width:
                seen[p] = new[p]
        if not len(ids):
            return heads
        _, ends, values = ids.buffers()
        ends = np.frombuffer(ends, np.int64)[: len(ids) + 1][np.cumsum([0, *(len(rest) for _, rest in cut)])].tolist()
        return [head + values[a:b].to_pybytes() for head, (a, b) in zip(heads, itertools.pairwise(ends), strict=True)]


@functools.cache
def encoder(name: str) -> Encoder:
    """One for each Python worker, whose pieces serve all its tasks."""
    return Encoder(name)


def tokenize(docs: DataFrame, vocabulary: str = "byte_bpe_50k", end_id: int = 1) -> DataFrame:
    """doc_id, part, before (ids before it in its partition), doc_tokens, ids (little-endian unsigned 16- or 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = encoder(vocabulary), TaskContext.get().partitionId(), 0
        wide = encode.kind == "<u4" or end_id >= 65536
        end = np.array([end_id], "<u4" if wide else "<u2").tobytes()
        for batch in batches:
            for part_of in bounded(batch, 1_000_000):
                found = encode([t or "" for t in part_of.column("text").to_pylist()])
                if wide:
                    found = [b"\0" + np.frombuffer(x, encode.kind).astype("<u4").tobytes() for x in found]
                ids = [x + end for x in found]
                lengths = np.array([len(unpack(x)) for x in ids], np.int64)
                starts = before + np.cumsum(lengths) - lengths
                before += int(lengths.sum())
                yield pa.record_batch(
                    [part_of.column("doc_id"), pa.array([part] * len(ids), pa.int64()), pa.array(starts), pa.array(lengths), pa.array(ids, pa.binary())],
                    names=["doc_id", "part", "before", "doc_tokens", "ids"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, part long, before long, doc_tokens long, ids binary")


def unpack(ids: bytes) -> np.ndarray:
    """The unsigned 32-bit ids of a stored document (an odd length marks 32-bit storage)."""
    return np.frombuffer(ids, "<u4", offset=1) if len(ids) % 2 else np.frombuffer(ids, "<u2").astype("<u4")


def pack(docs: DataFrame, length: int = 2048, vocabulary: str = "byte_bpe_50k", end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and its ids.

    Needs doc_id and text. A null or empty text is the one end id. All sequences but the last are full, so padding
    is below one sequence for the whole corpus. Repeated rows are packed each on its own; an empty table gives
    no pieces. Very long texts become as many pieces as they need.
    """
    if length < 1:
        raise ValueError("length must be at least 1")
    stored = save(tokenize(docs, vocabulary, end_id), "tokens")
    totals = stored.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    first = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(totals.select("part", first.alias("first")))  # one row per input partition
    placed = stored.join(offsets, "part").select("doc_id", "doc_tokens", "ids", (F.col("first") + F.col("before")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, n, ids, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "ids", "at")), strict=True):
                tokens, start = unpack(ids), 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(n - start, length - offset)
                    rows.append((doc, start, size, n, sequence, offset, tokens[start : start + size].tobytes()))
                    start += size
            kinds = [pa.int64()] * 6 + [pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return placed.mapInArrow(lean(run), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def with_crc(pieces: DataFrame) -> DataFrame:
    """Replaces ids (little-endian unsigned 32-bit) by ids_crc32."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
