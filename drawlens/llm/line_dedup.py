"""Line dedup: fuzzy lines by MinHash, in DataFrame functions alone.

A line's shingles are all its sequences of `size` characters; a line shorter than that is its own single shingle.

Candidates come from pairs of adjacent words, which stand for the shingles at less cost. A line's signature is the
smallest hash of its pairs under n_bands * rows masks, made as grouped minima, and lines with `rows` equal ones in a
row (a band) are candidates: two lines whose pairs have similarity s agree in a band with probability about s**rows.
Lines of few different words, or of long ones, have signatures of all their shingles in bands of their own, and those
with very few words those alone.

Candidates are compared by the exact Jaccard similarity of all their shingles, and connected components of the similar
ones keep the line that comes first in the corpus. Equal lines count as one line throughout.

Of a key's lines, all are compared with its first one, and in a key of more than `block` lines with one that shares
such keys with many. What is left are lines of a key in different components. Every two of those meet, in blocks of
CELL, as sketches of their shingles: where sketches differ in more bits than similar lines may differ in shingles, the
pair is not similar, so no similar pair is left out. The others are compared exactly, each line's nearest first, as
that joins most and so saves comparisons. Meetings of sketches grow with the square of the unlike lines of a key.

`rolling`, `shingle_set` and `band_keys` are the same method in numpy over all shingles; the query does not use them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawlens.llm.common import blocks_of, components, forget, save, text_key, unused

BLANK = " \t\r\x0b\x0c"
BASE = 0x9E3779B97F4A7C15
#: Characters of the lines of a block.
CHARS = 200_000
#: Characters a word, on average, above which word pairs do not stand for shingles.
LONG = 16
#: A line has keys of its word pairs from this many different words on, and keys of its shingles up to that many.
FEW = 6, 10
#: 64-bit words of a sketch, and lines of a block whose sketches are compared.
WORDS, CELL = 32, 512
MULTIPLIER = np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MULTIPLIER
    return x ^ (x >> np.uint64(29))


def _mask(i: int) -> int:
    """A fixed 64-bit number, as a long, for each i."""
    return int(_mix(np.array([(i + 1) * BASE % 2**64], np.uint64)).view(np.int64)[0])


def rolling(codes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` code points (there are none in fewer), from hashes of runs of 1, 2, 4, ..."""
    part, have, length = codes.astype(np.uint64) + np.uint64(1), None, 1
    done = 0
    while True:
        if size & length:
            if have is None:
                have = part
            else:
                n = max(0, len(codes) - done - length + 1)
                have = have[:n] * np.uint64(pow(BASE, length, 2**64)) + part[done : done + n]
            done += length
        if done == size:
            return _mix(have)
        n = max(0, len(codes) - 2 * length + 1)
        part = part[:n] * np.uint64(pow(BASE, length, 2**64)) + part[length : length + n]
        length *= 2


def shingle_set(line: str, size: int) -> np.ndarray:
    """The different shingles' hashes, in order."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.unique(rolling(codes, min(size, max(1, len(codes)))))


def lines_of(docs: DataFrame) -> DataFrame:
    """line (lower case, trimmed), h: the non-blank lines of documents that have an id."""
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.explode(F.split(F.lower("text"), "\n")).alias("line"))
    return rows.select(F.btrim("line", F.lit(BLANK)).alias("line")).where("line <> ''").withColumn("h", F.xxhash64("line"))


def _place(doc_id: Column, key: Column, pos: Column) -> Column:
    """The numbers (of the key the last 31 bits) as one, in their order; a decimal, as Spark aggregates those without
    sorting."""
    low = key.bitwiseAND(2**31 - 1) * F.lit(2**31) + pos
    return (doc_id.cast("decimal(19,0)") * F.lit(2**62).cast("decimal(19,0)") + low).cast("decimal(38,0)")


def band_keys(lines: list[str], size: int, n_bands: int, rows: int) -> np.ndarray:
    """lines x n_bands: the key of each band, 0 where the line has no shingle in the band's class. Lines shorter than
    a shingle have none, as no other line is like them."""
    keys = np.zeros((len(lines), n_bands), np.uint64)
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
    h = rolling(codes, size)
    owner = np.repeat(np.arange(len(lines)), lengths)[: len(h)]
    inside = owner == np.repeat(np.arange(len(lines)), lengths)[size - 1 :][: len(h)]
    h, owner = h[inside], owner[inside]
    band, low = ((h >> np.uint64(40)) * np.uint64(n_bands)) >> np.uint64(24), h.astype(np.uint32) & np.uint32(2**31 - 1)
    for b in range(n_bands):
        at = np.flatnonzero(band == b)
        if not len(at):
            continue
        who, value = owner[at], low[at]
        starts = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
        key = np.full(len(starts), b + 1, np.uint64)
        for i in range(rows):
            key = _mix(key * np.uint64(BASE) + np.minimum.reduceat(value ^ np.uint32(_mask(i) % 2**64 >> 33), starts).astype(np.uint64))
        keys[who[starts], b] = np.where(key == 0, np.uint64(1), key)
    return keys


def shingles(line: Column, size: int) -> Column:
    """Each sequence of `size` code points."""
    return F.regexp_extract_all(line, F.lit(rf"(?s)(?=([^\x{{DC00}}-\x{{DFFF}}].{{{size - 1}}}))"), F.lit(1))  # not from inside a surrogate pair


def _lines(docs: DataFrame) -> DataFrame:
    """at (place in the corpus: doc_id, text, line), t (the row's text_key), pos, h: a row for each non-blank line."""
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("doc_id"), F.col("text")).alias("t"), F.lower("text").alias("text"))
    lines = texts.select("doc_id", "t", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.btrim("line", F.lit(BLANK))).where("line <> ''")
    return lines.select(_place(F.col("doc_id"), F.col("t"), F.col("pos")).alias("at"), "t", "pos", F.xxhash64("line").alias("h"))


def signatures(docs: DataFrame, size: int, n_bands: int, rows: int) -> DataFrame:
    """h, w (characters), keys: the band keys of each different line, in one row for its word pairs and one for its
    shingles, where it has such keys. Lines shorter than a shingle have none, as no other line is like them."""
    few, many = FEW
    # posexplode_outer, as for posexplode Spark would add a filter that makes the parts twice
    lines = lines_of(docs).withColumn("w", F.length("line").cast("long")).where(F.col("w") >= size).withColumn("words", F.split("line", " ")).withColumn("n", F.size("words"))
    known = F.size(F.array_distinct(F.slice("words", 1, 2 * many)))  # up to `many`; all of a line's words only where these say too little
    lines = lines.withColumn("known", F.when((known > many) | (F.col("n") <= 2 * many), known).otherwise(F.size(F.array_distinct("words"))))
    every = F.when((F.col("known") <= many) | (F.col("w") > LONG * F.col("n")), F.concat("words", shingles(F.col("line"), size))).otherwise(F.col("words"))
    parts = lines.select("h", "w", "n", (F.col("known") >= few).alias("wide"), every.alias("parts"))
    parts = parts.select("h", "w", "n", "wide", "parts", F.posexplode_outer("parts").alias("i", "part"))
    pair = F.when(F.col("wide") & (F.col("i") < F.col("n") - 1), F.xxhash64("part", F.get("parts", F.col("i") + 1)))
    hashes = parts.select("h", "w", (F.col("i") >= F.col("n")).alias("every"), F.when(F.col("i") >= F.col("n"), F.xxhash64("part")).otherwise(pair).alias("x")).where("x IS NOT NULL")
    least = hashes.groupBy("h", "every").agg(F.max("w").alias("w"), *(F.min(F.col("x").bitwiseXOR(F.lit(_mask(i)))).alias(f"m{i}") for i in range(n_bands * rows)))
    return least.select("h", "w", F.array(*(F.xxhash64("every", F.lit(b), *(f"m{b * rows + i}" for i in range(rows))) for b in range(n_bands))).alias("keys"))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """h, line: the wanted lines (h, without repeats), each once.

    Lines are read from docs again. A broadcast bitmap of the wanted lines' hash remainders (64 bits a line, 8 MB at
    most) drops most lines that are not wanted before any moves; what it lets through is joined by the whole hash.
    """
    slots = 2 ** min(26, max(16, (64 * wanted.count()).bit_length()))
    slot = F.pmod("h", F.lit(slots))
    bucket, bit = F.shiftright(slot, 15).alias("bucket"), slot.bitwiseAND(2**15 - 1)
    bits = wanted.groupBy(bucket).agg(F.bitmap_construct_agg(bit).alias("bits"))  # slots / 2**15 rows of 4096 bytes
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    lines = lines_of(docs).withColumn("bucket", bucket).join(F.broadcast(bits), "bucket")
    lines = lines.where(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), bit.bitwiseAND(7).cast("int"))) != 0)
    return lines.select("h", "line").join(wanted, "h").dropDuplicates(["h"])  # Spark would move a semi-join before the bitmap


def _similar(pairs: DataFrame, texts: DataFrame, similarity: float, size: int, block: int) -> DataFrame:
    """a, b: the pairs of lines (x, y: their h, without repeats) that have at least that Jaccard similarity.

    The pairs of one x meet in groups of `block`, so that its shingles are made once a group.
    """
    pairs = pairs.join(texts.select(F.col("h").alias("y"), F.col("line").alias("other")), "y")
    tally = pairs.groupBy("x").agg(blocks_of(F.count("*"), F.sum(F.length("other")), block, CHARS).alias("blocks"))
    dealt = pairs.join(tally, "x").withColumn("part", F.pmod(F.xxhash64("y", "x"), "blocks"))
    firsts = dealt.select("x", "part").distinct().join(texts.withColumnRenamed("h", "x"), "x")
    # never null, as else Spark would make them once more to leave out nulls
    hashes = lambda line: F.coalesce(F.array_distinct(F.transform(shingles(F.col(line), size), lambda x: F.xxhash64(x))), F.array().cast("array<bigint>"))
    firsts = firsts.repartition("x", "part").select("x", "part", hashes("line").alias("s"))
    others = dealt.repartition("x", "part").select("x", "part", "y", hashes("other").alias("r"))
    n, m = F.size("s"), F.size("r")
    alike = (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-6) & (F.size(F.array_intersect("s", "r")) * (1 + similarity) >= similarity * (n + m) - 1e-6)
    return firsts.join(others, ["x", "part"]).where(alike).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _sketches(texts: DataFrame, size: int) -> DataFrame:
    """h, c (the number of shingles, repeats included), bits (a set of WORDS * 64 bits in which each shingle sets one),
    ones (how many are set). Every bit in which two sketches differ stands for a shingle that one line has and the
    other has not."""
    x = texts.select("h", F.explode_outer(shingles(F.col("line"), size)).alias("x")).select("h", F.xxhash64("x").alias("x"))
    x = x.select("h", F.shiftright("x", 6).bitwiseAND(WORDS - 1).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("x").bitwiseAND(63).cast("int")).alias("bit"))
    words = x.groupBy("h", "word").agg(F.count("*").alias("c"), F.bit_or("bit").alias("bits"))
    words = words.groupBy("h").agg(F.sum("c").alias("c"), F.sum(F.bit_count("bits")).alias("ones"), F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bits"))
    return words.withColumn("bits", F.array(*(F.coalesce(F.col("bits")[F.lit(i).cast("long")], F.lit(0).cast("long")) for i in range(WORDS))))


def _cells(rows: DataFrame) -> DataFrame:
    """rows (key, root, h, w, ...) with g, part: in each g, lines of part 0 meet those of part 1, and those of part 2
    each other, so that every two lines of a key with different roots meet once.

    Each key's lines outside its largest component are cut in blocks, which meet each other and that component's.
    """
    sizes = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("roots")).where("roots > 1")
    blocks = lambda n: F.ceil(n / CELL).cast("int")
    main = main.select("key", F.col("main.root").alias("main"), blocks(F.col("main.n")).alias("ours"), blocks(F.col("n") - F.col("main.n")).alias("others"))
    rows = rows.join(main, "key").withColumn("inside", F.col("root") == F.col("main"))
    rows = rows.withColumn("x", F.pmod(F.xxhash64("h"), F.when(F.col("inside"), F.col("ours")).otherwise(F.col("others"))).cast("int"))
    each = lambda n, cell: F.transform(F.sequence(F.lit(0), F.col(n) - 1), cell)
    cell = lambda i, j, part: F.struct(i.alias("i"), j.alias("j"), part.cast("int").alias("part"))
    mine = each("others", lambda k: cell(k, -1 - F.col("x"), F.lit(1)))
    met = each("others", lambda k: cell(F.least("x", k), F.greatest("x", k), F.when(k == F.col("x"), 2).when(k > F.col("x"), 0).otherwise(1)))
    rows = rows.withColumn("c", F.explode(F.when(F.col("inside"), mine).otherwise(F.concat(met, each("ours", lambda k: cell(F.col("x"), -1 - k, F.lit(0)))))))
    return rows.withColumns({"g": F.xxhash64("key", "c.i", "c.j"), "part": F.col("c.part")}).drop("c", "x", "inside", "main", "ours", "others")


def _close(rows: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """x, y, far (the part of their shingles in which they differ, by their sketches): the pairs of lines with different
    roots that share a key and that sketches don't show to be less similar."""
    sketched = _cells(rows).join(sketches, "h")
    a, b = (sketched.select(*(F.col(c).alias(f"{side}_{c}") for c in sketched.columns)) for side in "ab")
    both = lambda c: (F.col(f"a_{c}"), F.col(f"b_{c}"))
    equal = lambda c: both(c)[0] == both(c)[1]
    part, other = both("part")
    meet = equal("g") & ((part < other) | ((part == 2) & (other == 2) & (F.col("a_h") < F.col("b_h")))) & ~equal("root")
    n, m = both("c")
    few = lambda differ: differ * (1 + similarity) <= (1 - similarity) * (n + m) + 1e-6
    # functions of arrays, as one long sum over columns would make code too large to be compiled
    differ = F.aggregate(F.zip_with(*both("bits"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, x: total + x)
    may = few(F.abs(both("ones")[0] - both("ones")[1])) & few(differ)
    return a.join(b, meet & may).select(F.least("a_h", "b_h").alias("x"), F.greatest("a_h", "b_h").alias("y"), (differ / (n + m)).alias("far")).distinct()


def linked_lines(docs: DataFrame, signed: DataFrame, similarity: float, size: int, block: int) -> DataFrame:
    """id, root: the lines (their hash h) with near copies, and the smallest hash of their component."""
    keyed = signed.select("h", F.explode_outer("keys").alias("key"))
    tally = save(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("h").alias("rep"), F.max("h").alias("last")).where("n > 1"), "tally")
    many = save(keyed.join(tally.where("n > 2").drop("last"), "key"), "many")
    # a line that shares large keys with many others is likely to be near to more of them than any one
    large = many.where(F.col("n") > block)
    score = large.groupBy("h").agg(F.sum("n").alias("score"))
    best = save(large.join(score, "h").groupBy("key").agg(F.max(F.struct("score", "h"))["h"].alias("best")), "best")
    two = tally.where("n = 2").select(F.col("rep").alias("x"), F.col("last").alias("y"))
    met = two.unionByName(many.select(F.col("rep").alias("x"), F.col("h").alias("y"))).unionByName(large.join(best, "key").select(F.col("best").alias("x"), F.col("h").alias("y")))
    met = save(met.where("x <> y").distinct(), "met")
    texts = save(_texts(docs, met.select(F.explode(F.array("x", "y")).alias("h")).distinct()), "texts")
    links = save(_similar(met, texts, similarity, size, block), "similar")
    found = save(components(links), "components")
    forget(links, met, tally)
    left = many.join(best, "key", "left").where("h <> rep AND (best IS NULL OR h <> best)").drop("best").join(found.withColumnRenamed("id", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    several = left.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    left = save(left.join(several, "key").select("key", "h", "root"), "left")
    sketches = save(_sketches(texts.join(left.select("h").distinct(), "h"), size), "sketches")
    close = save(_close(left, sketches, similarity), "close")
    nearest = close.unionByName(close.select(F.col("y").alias("x"), F.col("x").alias("y"), "far")).groupBy("x").agg(F.min(F.struct("far", "y"))["y"].alias("y"))
    nearest = save(nearest.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "nearest")
    found = _joined(found, nearest, texts, similarity, size, block)
    rest = close.select("x", "y").join(nearest, ["x", "y"], "left_anti")
    for end in "xy":
        rest = rest.join(found.select(F.col("id").alias(end), F.col("root").alias(f"r{end}")), end, "left")
    rest = save(rest.where(F.coalesce("rx", "x") != F.coalesce("ry", "y")).select("x", "y"), "rest")
    found = _joined(found, rest, texts, similarity, size, block)
    forget(many, best, texts, left, sketches, close, nearest, rest)
    return found


def _joined(found: DataFrame, pairs: DataFrame, texts: DataFrame, similarity: float, size: int, block: int) -> DataFrame:
    """found (id, root), with components joined by the similar ones of the pairs (x, y)."""
    links = _similar(pairs, texts, similarity, size, block)
    for end in "ab":
        links = links.join(found.select(F.col("id").alias(end), F.col("root").alias(f"r{end}")), end, "left")
    links = save(links.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).distinct(), "similar")
    if links.isEmpty():
        forget(links)
        return found
    over = save(components(links), "components")
    upper = over.select(F.col("id").alias("root"), F.col("root").alias("upper"))
    both = found.join(upper, "root", "left").select("id", F.coalesce("upper", "root").alias("root"))
    both = save(both.unionByName(over.join(found, "id", "left_anti")), "components")
    forget(links, over, found)
    return both


def line_dedup(docs: DataFrame, similarity: float = 0.8, size: int = 12, n_bands: int = 6, rows: int = 3, block: int = 64, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with text rid of every line that is a copy or a near copy of an earlier one, and n_lines, n_dropped.

    Earlier means in order of doc_id, then of a hash of the text where rows share an id, then of place. Lines are
    compared trimmed and in lower case. Blank lines stay and count in n_lines. Rows without an id or text stay as they
    are (n_dropped 0). Rows of one id and one text count as one document; those of one id and different texts are
    different ones. Other columns pass through, but those named like the two counts (counts: their names) are replaced;
    an empty table gives an empty result.
    """
    docs = docs.drop(*counts)
    signed = save(signatures(docs, size, n_bands, rows), "signatures")
    found = linked_lines(docs, signed, similarity, size, block)
    forget(signed)
    lines = save(_lines(docs), "lines")
    classes = lines.groupBy("h").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    firsts = classes.join(found.withColumnRenamed("id", "h"), "h", "left").where("n > 1 OR root IS NOT NULL")
    firsts = save(firsts.select("h", "first", F.coalesce("root", "h").alias("root")), "firsts")
    forget(found)
    keep = firsts.groupBy("root").agg(F.min("first").alias("keep"))
    gone = lines.select("h", "at", "t", "pos").join(firsts.join(keep, "root").select("h", "keep"), "h").where("at <> keep")
    gone = save(gone.groupBy("t").agg(F.collect_set("pos").alias("_gone")), "gone")
    forget(lines, firsts)
    own, places = unused(docs, "_t"), unused(docs, "_gone")
    mine = F.when(F.col("doc_id").isNotNull(), text_key(F.col("doc_id"), F.col("text")))
    out = docs.join(gone.select(F.col("t").alias(own), F.col("_gone").alias(places)), mine == F.col(own), "left").drop(own)
    parts = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(places))
    text = F.when(F.col(places).isNull(), F.col("text")).otherwise(F.transform(F.array(parts), lambda p: F.array_join(F.transform(stay, lambda i: F.get(p, i)), "\n"))[0])
    n = [F.greatest(F.coalesce(F.size(x), F.lit(0)), F.lit(0)) for x in (parts, F.col(places))]
    return out.withColumns({"text": text} | dict(zip(counts, n, strict=True))).drop(places)
