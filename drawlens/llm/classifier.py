"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Each byte has a learned vector; learned
filters slide over a chunk, and each filter's largest response stays. The mean and the largest response over all
chunks are combined into one probability. Training runs on the driver over a bounded sample of labelled rows
(max_rows), scoring on the executors over every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawlens.llm.common import give_back


@dataclass(frozen=True)
class Shape:
    chunk: int = 512
    overlap: int = 64
    width: int = 8
    stride: int = 4
    vector: int = 8
    filters: int = 32


def chunks(text: bytes, shape: Shape) -> np.ndarray:
    """Rows of bytes that cover the whole text, each starting overlap bytes before the last one's end; zeros fill up."""
    step = shape.chunk - shape.overlap
    n = max(1, -(-(len(text) - shape.overlap) // step))
    padded = np.zeros((n - 1) * step + shape.chunk, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, shape.chunk)[::step]


class Network:
    """Parameters and passes; the same code trains and scores."""

    def __init__(self, shape: Shape = Shape(), seed: int = 5):
        rng = np.random.default_rng(seed)
        self.shape = shape
        self.p = {
            "bytes": rng.normal(0, 0.5, (256, shape.vector)).astype(np.float32),
            "filters": rng.normal(0, (shape.width * shape.vector) ** -0.5, (shape.width * shape.vector, shape.filters)).astype(np.float32),
            "bias": np.zeros(shape.filters, np.float32),
            "mean": rng.normal(0, 0.1, shape.filters).astype(np.float32),
            "max": np.zeros(shape.filters, np.float32),
            "out": np.zeros(1, np.float32),
        }

    def windows(self, rows: np.ndarray) -> np.ndarray:
        """Byte numbers under each filter position: chunks x positions x width."""
        return np.lib.stride_tricks.sliding_window_view(rows, self.shape.width, axis=1)[:, :: self.shape.stride]

    def pool(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest response of each filter in each chunk, and where."""
        seen = self.windows(rows)
        columns = self.p["bytes"][rows]
        columns = np.lib.stride_tricks.sliding_window_view(columns, self.shape.width, axis=1)[:, :: self.shape.stride]  # chunk, position, vector, width
        flat = np.ascontiguousarray(columns.transpose(0, 1, 3, 2)).reshape(-1, self.shape.width * self.shape.vector)
        response = (flat @ self.p["filters"]).reshape(len(rows), seen.shape[1], -1)
        where = response.argmax(axis=1)
        return np.take_along_axis(response, where[:, None], axis=1)[:, 0], where

    def pool_all(self, rows: np.ndarray, at_once: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """pool() over any number of chunks, at_once at a time."""
        found = [self.pool(rows[i : i + at_once]) for i in range(0, len(rows), at_once)]
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    def combine(self, top: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        """Logits of n texts from their chunks' responses (owner: the text of each chunk, in order)."""
        act = np.tanh(top + self.p["bias"])
        starts = np.searchsorted(owner, np.arange(n))
        count = np.diff(np.append(starts, len(owner)))[:, None]
        mean, most = np.add.reduceat(act, starts, axis=0) / count, np.maximum.reduceat(act, starts, axis=0)
        return mean @ self.p["mean"] + most @ self.p["max"] + self.p["out"][0], act, mean, most, count

    def score(self, texts: list[bytes], at_once: int = 512) -> np.ndarray:
        """Probability of label 1 of each text."""
        if not texts:
            return np.zeros(0)
        rows = [chunks(t, self.shape) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(r) for r in rows])
        rows = np.concatenate(rows)
        top = self.pool_all(rows, at_once)[0]
        p = 1 / (1 + np.exp(-self.combine(top, owner, len(texts))[0].astype(np.float64).clip(-50, 50)))
        return p.round(5)  # sums of floats differ a little with the texts that happen to be scored together

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 14, batch: int = 32, rate: float = 0.01, least_steps: int = 700, seed: int = 3) -> Network:
        """Adam over the log loss with classes of equal weight. Each pass takes all chunks of every text. Few texts are
        passed over more often, until least_steps batches are through."""
        rng = np.random.default_rng(seed)
        labels = np.asarray(labels, np.float32)
        share = float(labels.mean()) if len(labels) else 0.5
        if not len(labels) or share in (0.0, 1.0):
            return self
        weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        all_rows, t = [chunks(x, self.shape) for x in texts], 0
        epochs = max(epochs, -(-least_steps // -(-len(texts) // batch)))
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), batch):
                ids, t = order[i : i + batch], t + 1
                picked = [all_rows[j] for j in ids]
                owner = np.repeat(np.arange(len(ids)), [len(r) for r in picked])
                grads = self.gradient(np.concatenate(picked), owner, labels[ids], weight[ids])
                now = rate * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs))
                for k, g in grads.items():
                    m = moment[k]
                    m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.999 * m[1] + 0.001 * g * g
                    self.p[k] -= (now * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
        return self

    def gradient(self, rows: np.ndarray, owner: np.ndarray, labels: np.ndarray, weight: np.ndarray, at_once: int = 512) -> dict[str, np.ndarray]:
        """Of the mean weighted log loss."""
        n = len(labels)
        top, where = self.pool_all(rows, at_once)
        logit, act, mean, most, count = self.combine(top, owner, n)
        d = weight * (1 / (1 + np.exp(-logit)) - labels) / n
        is_most = act == most[owner]
        starts = np.searchsorted(owner, np.arange(n))
        is_most = is_most / np.add.reduceat(is_most, starts, axis=0, dtype=np.int64)[owner]  # equal chunks share
        d_act = d[owner, None] * (self.p["mean"] / count[owner] + self.p["max"] * is_most)
        d_top = (d_act * (1 - act * act)).astype(np.float32)
        g_bytes, g_filters = np.zeros_like(self.p["bytes"]), np.zeros_like(self.p["filters"])
        for i in range(0, len(rows), at_once):
            part = slice(i, i + at_once)
            seen = self.windows(rows[part])[np.arange(len(rows[part]))[:, None], where[part]]  # chunk, filter, width
            vectors = self.p["bytes"][seen].reshape(len(seen), self.shape.filters, -1)
            np.add.at(g_bytes, seen.reshape(-1), (d_top[part, :, None] * self.p["filters"].T[None]).reshape(-1, self.shape.vector))
            g_filters += np.einsum("cf,cfv->vf", d_top[part], vectors)
        return {"bytes": g_bytes, "filters": g_filters, "bias": d_top.sum(axis=0), "mean": mean.T @ d, "max": most.T @ d, "out": np.array([d.sum()], np.float32)}


def fold(doc_id: Column, folds: int = 4) -> Column:
    """crc32 of the id's text, modulo folds (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", held_fold: int = 2, max_rows: int = 4000, max_bytes: int = 48_000_000, shape: Shape = Shape(), seed: int = 5, **fit) -> Network:
    """A network fitted on a bounded sample of labelled rows outside the held-out fold: the first max_rows by a hash
    of doc_id, without those whose whole texts would take the sample beyond max_bytes.

    The bounds limit what reaches the driver; the rows chosen depend on doc_id, seed and sizes only. Null labels and
    labels without a document are left out, and a text larger than what is left of the bound is passed over for
    smaller ones; if no text at all is within it, ValueError. Without both labels the network stays as it starts.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != held_fold))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias("label"))
    rows = rows.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    found = texts.join(F.broadcast(rows), "doc_id").withColumn("u", F.xxhash64("doc_id", F.lit(seed)))  # max_rows labels
    found = found.withColumn("size", F.octet_length("text")).withColumn("t", F.xxhash64("text")).dropDuplicates(["doc_id", "t"])
    order = ["u", "doc_id", "size", "t"]
    sizes = found.orderBy(*order).select(*order).limit(max_rows).collect()
    inside, total = [], 0
    for r in sizes:
        if total + r["size"] <= max_bytes:
            inside.append(r)
            total += r["size"]
    if not inside:
        if sizes:
            raise ValueError(f"none of {len(sizes)} labelled texts has {max_bytes} bytes or fewer")
        return Network(shape, seed)
    chosen = docs.sparkSession.createDataFrame(list({(r.doc_id, r.t) for r in inside}), "doc_id long, t long")  # max_rows at most
    taken = found.join(F.broadcast(chosen), ["doc_id", "t"]).select(*order, "text", "label").orderBy(*order).collect()
    return Network(shape, seed).fit([bytes(r.text) for r in taken], np.array([r.label for r in taken]), **fit)


def classify(docs: DataFrame, network: Network, threshold: float = 0.7, held_fold: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 if score >= threshold).

    Scores depend on the text alone. A null or empty text is one chunk of zero bytes. Repeated rows give repeated
    results; an empty table gives an empty result; columns other than doc_id and text are ignored.
    """
    return with_scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), network).select(
        "doc_id", (fold(F.col("doc_id")) == held_fold).alias("held_out"), F.col("score"), (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def with_scores(docs: DataFrame, network: Network, name: str = "score") -> DataFrame:
    """docs with the score of text in a column of that name; one that docs has is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(network)  # a few thousand numbers

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            found, part, size = [], [], 0
            for text in batch:
                part.append(bytes(text) if text is not None else b"")
                size += len(part[-1])
                if size > 1_000_000:
                    found.append(sent.value.score(part))
                    part, size = [], 0
            found.append(sent.value.score(part))
            yield pd.Series(np.concatenate(found))
        give_back()

    return docs.withColumn(name, score(F.col("text").cast("binary")))
