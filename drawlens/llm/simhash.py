"""SimHash near-duplicates by deletion variants.

Fingerprints are cut into segments. Two that differ in few bits have a segment that differs in one bit at most,
and then share that segment with one bit left out (a variant: segment, bit left out, the other bits). Variants
are the keys of an equality join; inside a key a breadth-first search over the Hamming distances gives a spanning
forest, so a key with m members gives m - 1 links at most, and connected components need no more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlens.llm.common import blocks_of, components, forget, lean, save, spanning_links, text_name, unused

SEED = 42
#: Rows of one key that a task holds; the members of a larger key meet in blocks of this many.
HELD = 4096


def shingle_hashes(text: bytes, n: int, distinct: bool = False) -> np.ndarray:
    """XXH64 of each n-word shingle (A-Z lower-cased, one space between words); of the whole sequence if shorter."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    m, digest = max(1, len(words) - n + 1), xxhash.xxh64_intdigest
    stops = ends[n - 1 :] if len(words) >= n else ends[-1:]
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:m].tolist(), stops.tolist(), strict=True)), np.uint64, m)
    return np.unique(h) if distinct else h


def fingerprint(h: np.ndarray, bits: int = 64) -> np.ndarray:
    """One unsigned 64-bit word for each 64 bits: a bit is 1 if set in over half of the hashes; zero without any."""
    words = np.zeros(bits // 64, np.uint64)
    for k in range(len(words) if len(h) else 0):
        if k:  # further words from a mixed hash
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(32))
        counts = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        words[k] = np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0]
    return words


def segments(bits: int, width: int, strided: int = 0) -> list[list[int]]:
    """Bit numbers of each segment: contiguous ones that cover all bits, then as many strided ones as asked for."""
    step = bits // width
    return [list(range(i, i + width)) for i in range(0, bits, width)] + [list(range(i, bits, step))[:width] for i in range(strided)]


def _variants(words: np.ndarray, cuts: list[list[int]]) -> np.ndarray:
    """Keys of each fingerprint (rows of 64-bit words), one row of keys for each: number of the variant, other bits."""
    keys = []
    for s, cut in enumerate(cuts):
        values = np.zeros(len(words), np.uint64)
        for j, bit in enumerate(cut):
            values |= ((words[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)) << np.uint64(j)
        for j in range(len(cut)):
            keys.append((values & ~(np.uint64(1) << np.uint64(j))) | (np.uint64(s * 64 + j) << np.uint64(40)))
    return np.stack(keys, axis=1).astype(np.int64)


def _forest(ids: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the members; near(i, others) says which of the others are linked to i."""
    edges, left, queue = [], np.arange(1, len(ids)), [0]
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
            continue
        i = queue.pop()
        hit = near(i, left)
        edges += [(int(ids[i]), int(ids[j])) for j in left[hit]]
        queue += left[hit].tolist()
        left = left[~hit]
    return edges


def _link(n_words: int, distance: int, held: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows (key, id, words) in order of key: links (a, b), and as they came the rows of keys over held."""

    def pairs(keys: np.ndarray, ids: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        lengths = np.diff(np.append(starts, len(keys)))
        out, few = [np.zeros((0, 2), np.int64)], np.repeat(lengths <= 48, lengths)
        for step in range(1, 48):
            i = np.flatnonzero(few[:-step] & (keys[step:] == keys[:-step]))
            if not len(i):
                break
            i = i[np.bitwise_count(words[i] ^ words[i + step]).sum(axis=1) <= distance]
            out.append(np.stack((ids[i], ids[i + step]), axis=1))
        for s, n in zip(starts[lengths > 48], lengths[lengths > 48], strict=True):
            w = words[s : s + n]
            found = _forest(ids[s : s + n], lambda i, left, w=w: np.bitwise_count(w[left] ^ w[i]).sum(axis=1) <= distance)
            out.append(np.array(found, np.int64).reshape(-1, 2))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "key", *(f"f{k}" for k in range(n_words))]
        wait, over, found, size = None, None, [], 0

        def rows(keys, ids, words):  # of a large key
            return pa.record_batch([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(keys), *(pa.array(words[:, k].astype(np.int64)) for k in range(n_words))], names=names)

        def links():
            e = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
            e = e[e[:, 0] != e[:, 1]]
            return pa.record_batch([pa.array(e[:, 0]), pa.array(e[:, 1]), *(pa.nulls(len(e), pa.int64()) for _ in range(n_words + 1))], names=names)

        for batch in batches:
            keys, ids = batch.column("key").to_numpy(), batch.column("id").to_numpy()
            words = np.stack([batch.column(f"f{k}").to_numpy().view(np.uint64) for k in range(n_words)], axis=1)
            if wait is not None:
                keys, ids, words = (np.concatenate(x) for x in zip(wait, (keys, ids, words), strict=True))
                wait = None
            if over is not None:
                n = int(np.searchsorted(keys, over, side="right"))
                if n:
                    yield rows(keys[:n], ids[:n], words[:n])
                keys, ids, words = keys[n:], ids[n:], words[n:]
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1], side="left"))
            if len(keys) - cut > held:
                over = keys[-1]
                yield rows(keys[cut:], ids[cut:], words[cut:])
            else:
                over, wait = None, (keys[cut:], ids[cut:], words[cut:])
            starts = np.flatnonzero(np.concatenate(([True], keys[1:cut] != keys[: max(0, cut - 1)]))) if cut else np.zeros(0, int)
            lengths = np.diff(np.append(starts, cut))
            for s, n in zip(starts[lengths > held], lengths[lengths > held], strict=True):
                yield rows(keys[s : s + n], ids[s : s + n], words[s : s + n])
            keep = np.repeat(lengths <= held, lengths)
            if keep.any():
                got = pairs(keys[:cut][keep], ids[:cut][keep], words[:cut][keep])
                found += got
                size += sum(map(len, got))
            if size > 100_000:
                yield links()
                found, size = [], 0
        if wait is not None:
            found += pairs(*wait)
        if found:
            yield links()

    return run


def links(prints: DataFrame, bits: int, cuts: list[list[int]], distance: int, held: int = HELD) -> DataFrame:
    """Links (a, b) that connect what the Hamming distance connects, stored (the caller forgets them).

    prints: id and the words f0, f1, ... of different fingerprints, one row each. Found are pairs within the
    distance that share a variant; with more segments than half the distance those are all pairs. A key with more
    than held members is dealt out in blocks, every two of which meet in one task, so no task holds a whole key.
    """
    n_words = bits // 64
    columns = [f"f{k}" for k in range(n_words)]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                words = np.stack([part.column(c).to_numpy().view(np.uint64) for c in columns], axis=1)
                keys = _variants(words, cuts)
                again = keys.shape[1]
                yield pa.record_batch([pa.array(keys.ravel()), pa.array(np.repeat(part.column("id").to_numpy(), again)), *(pa.array(np.repeat(words[:, k].view(np.int64), again)) for k in range(n_words))], names=["key", "id", *columns])

    kinds = ", ".join(f"{c} long" for c in columns)
    run, out = _link(n_words, distance, held), f"a long, b long, key long, {kinds}"
    # few rows come in and many go out: deal them over all tasks first, so that no task writes a large share
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = prints.select("id", *columns).repartition(tasks, "id").mapInArrow(lean(spread), f"key long, id long, {kinds}")
    found = save(rows.repartition("key").sortWithinPartitions("key").mapInArrow(lean(run), out), "links")
    large = found.where("key IS NOT NULL")
    blocks = save(large.groupBy("key").agg(F.ceil(F.count("*") * 2 / held).cast("int").alias("blocks")), "large")
    if not blocks.isEmpty():
        part = large.join(blocks, "key").withColumn("x", F.pmod(F.xxhash64("a"), "blocks").cast("int"))
        part = part.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        part = part.select(F.xxhash64("key", F.least("x", "y"), F.greatest("x", "y")).alias("key"), F.col("a").alias("id"), *columns)
        more = part.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_link(n_words, distance, 2**30)), out)
    else:
        more = found.limit(0)
    out = save(found.unionByName(more).where("key IS NULL").select("a", "b").distinct(), "linked")
    forget(found, blocks)
    return out


def simhash(docs: DataFrame, ngram: int = 3, distance: int = 3, held: int = HELD) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id.

    Fingerprints of 64 bits are linked when they differ in at most distance bits (all such pairs, found by
    distance // 2 + 1 segments), and component_id is the smallest doc_id of the linked documents. Null and empty
    texts have the fingerprint zero. Equal fingerprints are one vertex, so copies cost no pairs. Repeated rows give
    repeated results; other columns than doc_id and text are ignored; an empty table gives an empty result.
    """
    n = distance // 2 + 1
    edges = np.linspace(0, 64, n + 1).astype(int)
    cuts = [list(range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(shingle_hashes(t.as_py() or b"", ngram))[0] for t in batch.column("text")], np.uint64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "f0"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = save(rows.mapInArrow(lean(run), "doc_id long, f0 long"), "prints")
    classes = save(rows.groupBy("f0").agg(F.min("doc_id").alias("first")), "classes")
    linked = links(classes.select(F.col("f0").alias("id"), "f0"), 64, cuts, distance, held)
    found = components(linked)
    forget(linked)
    return label(rows, classes, found, ["f0"], F.col("f0")).select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def label(rows: DataFrame, classes: DataFrame, found: DataFrame, key: list[str], vertex) -> DataFrame:
    """Adds component_id, the smallest first of the linked classes, to rows (by key, null-free)."""
    named = classes.withColumn("id", vertex).join(found, "id", "left")
    least = named.where("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root", "left").select(*key, F.coalesce("component_id", "first").alias("component_id"))
    return rows.join(named, key)


def near_classes(docs: DataFrame, ngram: int = 5, similarity: float = 0.8, bits: int = 128, width: int = 16, strided: int = 4, distance: int = 36, held: int = HELD, block: int = 256, shingles: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, name of the text, class of equal words) and, of each class, its id and group, both stored.

    Groups are connected by a Jaccard similarity of at least `similarity` between sets of ngram-word shingles.
    Candidates are fingerprints of those sets that share a variant and differ in at most distance bits. At the
    defaults two texts of similarity s differ in each bit with probability p = acos(2s / (1 + s)) / pi, so one
    segment matches with (1 - p)**width + width * p * (1 - p)**(width - 1); twelve of them find 97 % of pairs at 0.8
    and 99 % at 0.85. Candidate groups are then compared exactly, in blocks of `block` texts and about
    `shingles` shingles, every two of which meet in one task; each task gives links that connect the similar pairs.

    Vertices are classes of texts with equal words, whatever the ids of their rows. Texts without words are one class.
    """
    n_words = bits // 64
    columns = [f"f{k}" for k in range(n_words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column("text")]
            whole = [b" ".join(t.lower().split()) for t in texts]
            names = [np.array([xxhash.xxh64_intdigest(w, s) for w in whole], np.uint64).view(np.int64) for s in (1, 2)]
            sets = [shingle_hashes(w, ngram, True) for w in whole]
            prints = np.array([fingerprint(h, bits) for h in sets], np.uint64).reshape(-1, n_words)
            yield pa.record_batch([batch.column("doc_id"), batch.column("name"), *map(pa.array, names), pa.array([len(h) for h in sets], pa.int64()), *(pa.array(np.ascontiguousarray(prints[:, k]).view(np.int64)) for k in range(n_words))], names=["doc_id", "name", "k0", "k1", "w", *columns])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_name(F.col("text")).alias("name"), F.col("text").cast("binary").alias("text"))
    rows = save(texts.mapInArrow(lean(run), "doc_id long, name decimal(38,0), k0 long, k1 long, w long, " + ", ".join(f"{c} long" for c in columns)), "prints")
    classes = rows.groupBy("k0", "k1", "w", *columns).agg(F.min("doc_id").alias("first"), F.min("name").alias("name"))
    classes = save(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    wide = links(classes.where("w > 0").select("id", *columns), bits, segments(bits, width, strided), distance, held)
    connected = components(wide)
    forget(wide)
    groups = save(connected.join(classes.select("id", "w", "name"), "id"), "groups")
    sizes = groups.groupBy("root").agg(blocks_of(F.count("*"), F.sum("w"), block, shingles).alias("blocks"))
    part = groups.join(sizes, "root").withColumn("x", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    part = part.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = part.select("id", "name", "root", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    once = texts.join(groups.select("name"), "name", "left_semi").groupBy("name").agg(F.first("text").alias("text"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets = None, [], []

        def flush() -> pa.RecordBatch:
            found = spanning_links(sets, np.array(ids), np.full(len(ids), 2), similarity)
            return pa.record_batch([pa.array([e[i] for e in found], pa.int64()) for i in range(2)], names=["a", "b"])

        for batch in batches:
            for root, x, y, doc, text in zip(*(batch.column(c).to_pylist() for c in ("root", "x", "y", "id", "text")), strict=True):
                if key != (root, x, y):
                    if len(ids) > 1:
                        yield flush()
                    key, ids, sets = (root, x, y), [], []
                ids.append(doc)
                sets.append(shingle_hashes(text or b"", ngram, True))
        if len(ids) > 1:
            yield flush()

    met = part.join(once, "name").repartition("root", "x", "y").sortWithinPartitions("root", "x", "y", "id")
    found = save(met.mapInArrow(lean(compare), "a long, b long"), "similar")
    alike = components(found)
    named = save(classes.select("id", "k0", "k1", "first").join(alike, "id", "left").select("id", "k0", "k1", "first", F.coalesce("root", "id").alias("root")), "named")
    forget(groups, found, classes)
    return rows, named


def near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """One row per document: doc_id, component_id (the smallest doc_id of its group).

    Groups are near_classes', whose settings these are. Texts without words are copies of each other, as are texts of
    equal words. Rows that share an id and differ in text belong each to its own text's group. Repeated rows give
    repeated results; a null doc_id stays null and stands for its group only if the whole group is null; an empty table
    gives an empty result; columns other than doc_id and text are ignored.
    """
    rows, named = near_classes(docs, **settings)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(named.join(least, "root").select("k0", "k1", "component_id"), ["k0", "k1"]).select("doc_id", "component_id")


def near_dedup(docs: DataFrame, **settings) -> DataFrame:
    """The first row of each group of near-duplicates, with all its columns.

    First is in order of doc_id, then of the text's name. Of repeated rows one stays. Rows without an id stay. Groups
    are near_classes', whose settings these are; texts without words are one group. Rows that share an id are judged
    each by its own text. An empty table stays empty.
    """
    rows, named = near_classes(docs, **settings)
    name, own, other = unused(docs, "_name"), unused(docs, "_n"), unused(docs, "_d")
    order = F.struct("doc_id", "name")
    members = rows.where("doc_id IS NOT NULL").join(named.select("k0", "k1", "root"), ["k0", "k1"]).groupBy("root", "doc_id", "name").agg(F.count("*").alias("n"))
    members = save(members, "members")
    firsts = members.groupBy("root").agg(F.min(order).alias("f"))
    members = members.join(firsts, "root").withColumn("is_first", F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("name") == F.col("f.name")))
    stays = save(members.select(F.col("doc_id").alias(other), F.col("name").alias(own), "n", "is_first").where("n > 1 OR NOT is_first"), "stays")
    forget(rows, named)
    same = F.col(name) == F.col(own), F.col("doc_id").cast("long").eqNullSafe(F.col(other))
    keyed = docs.withColumn(name, text_name(F.col("text")))
    alone = keyed.join(stays, list(same), "left_anti")
    repeated = stays.where("is_first")
    if repeated.isEmpty():
        return alone.select(*docs.columns)
    twins = keyed.join(repeated, list(same), "left_semi").groupBy(name, "doc_id").agg(F.first(F.struct(*docs.columns)).alias("row")).select("row.*")
    return alone.select(*docs.columns).unionByName(twins)
