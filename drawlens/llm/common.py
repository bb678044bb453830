"""What the operators share: stored stages, ranks over partitions, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def work_dir(spark: SparkSession) -> str:
    """The shared folder for stored stages: spark.checkpoint.dir, or one in the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir") + "/_stages"
    return base.rstrip("/") + "/drawlens"


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again.

    This cuts the lineage: a lost executor costs the tasks of the current stage only. forget() removes it.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes what save() wrote; only for frames that nothing lazy still reads."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Returns freed memory to the system. Spark keeps its Python workers, so what one stage leaves in their allocators
    comes on top of what the next one needs."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do so by themselves, or can't
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives memory back at the end of each task."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


def bounded(batch: pa.RecordBatch, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `size` bytes of text, so that long texts do not meet in one list."""
    start, seen = 0, 0
    for i, t in enumerate(batch.column("text")):
        seen += len(t.as_buffer() or b"") if t.is_valid else 0
        if seen >= size:
            yield batch.slice(start, i + 1 - start)
            start, seen = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def ranked(df: DataFrame, order: list[Column], totals: dict[str, str] | None = None) -> DataFrame:
    """Adds rank (from 0) in the given order and, for each new: old in totals, the sum of old over the rows before.

    Rows are range-partitioned and counted by partition, so no task holds more than its range; only one row
    per partition passes through a single task.
    """
    totals = totals or {}
    rows = save(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked"
    ).withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy("_part").agg(F.count("*").alias("_n"), *(F.sum(old).alias(f"_{new}") for new, old in totals.items()))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(
        "_part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ["_n", *(f"_{new}" for new in totals)])
    )
    before = W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    place = F.col("_at").bitwiseAND(2**33 - 1)  # in its partition
    out = rows.withColumns({"rank": place} | {new: F.coalesce(F.sum(old).over(before), F.lit(0)) for new, old in totals.items()}).join(parts, "_part")
    return out.withColumns(
        {"rank": F.col("rank") + F.col("_n0")} | {new: F.col(new) + F.col(f"_{new}0") for new in totals}
    ).drop("_at", "_part", "_n0", *(f"_{new}0" for new in totals))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b: any one orderable type): rows id, root, with root the smallest id.

    Alternates large-star and small-star steps (Kiveris et al. 2014, "Connected Components in MapReduce and
    Beyond"): the number of rounds grows with the logarithm of the size, not with the diameter. A vertex with very
    many neighbours is only ever the key of a pre-aggregated minimum and of a join that Spark may split.
    Null ends and loops are ignored; no edges give no rows. Vertices without edges are not returned.
    """

    def step(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        return pairs.join(least.select("u", F.least("u", "m").alias("m")), "u")

    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, last = save(now, "edges"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = step(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = step(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        after = save(small.where("u <> v").distinct(), "edges")
        forget(now)
        now = after
        seal = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("v", "u"), 20))).first()
        if seal == last:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        last = seal


def spanning_links(sets: list[np.ndarray], v: np.ndarray, part: np.ndarray, similarity: float, cells: int = 2**23) -> list[tuple[int, int]]:
    """Links (vertices) that connect all the pairs that meet and are similar.

    sets: sorted arrays without repeats; v: their vertices; part: members of part 0 meet those of part 1, those of
    part 2 each other. What every two sets have in common is counted by products of matrices of `cells` cells at most.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets])
    width = max(1, cells // n)
    if n == 2:
        both = np.full((2, 2), len(np.intersect1d(*sets, assume_unique=True)), np.float32)
    else:
        columns = np.unique(np.concatenate(sets), return_inverse=True)[1]
        owner, both = np.repeat(np.arange(n), sizes), np.zeros((n, n), np.float32)
        for low in range(0, int(columns.max(initial=-1)) + 1, width):
            here = (columns >= low) & (columns < low + width)
            grid = np.zeros((n, min(width, int(columns.max()) + 1 - low)), np.float32)
            grid[owner[here], columns[here] - low] = 1
            both += grid @ grid.T
    meets = (v[:, None] != v) & ((part[:, None] < part) | ((part[:, None] == 2) & (part == 2)))
    alike = meets & (both * (1 + similarity) >= similarity * (sizes[:, None] + sizes) - 1e-6) & (np.minimum(sizes[:, None], sizes) > 0)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(alike)), strict=True):
        a, b = root(int(v[i])), root(int(v[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(v[i]), int(v[j])))
    return out


def text_key(doc_id: Column, text: Column) -> Column:
    """A 64-bit name of a row's id and text: rows that share an id are told apart by their texts."""
    return F.xxhash64(doc_id.cast("long"), text)


def text_name(text: Column) -> Column:
    """A 126-bit name of a text (null: of none), as a decimal, which Spark aggregates without sorting."""
    low = F.xxhash64(F.lit(1), text).bitwiseAND(2**62 - 1)
    return (F.xxhash64(text).cast("decimal(19,0)") * F.lit(2**62).cast("decimal(19,0)") + low).cast("decimal(38,0)")


def blocks_of(n: Column, w: Column, block: int, most: int) -> Column:
    """How many blocks n members of size w together make, of about `block` members and of size `most` at most."""
    return F.ceil(F.greatest(n / block, w / most, F.lit(1))).cast("int")


def unused(df: DataFrame, name: str) -> str:
    """name, or a longer one if a column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
