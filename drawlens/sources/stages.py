"""Stored stages: what several actions read is computed once and outlives lost executors."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def stage_dir(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir, or one in the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir") + "/_stages"
    return base.rstrip("/") + "/drawlens-core"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again; it stays until discard() or until that is emptied."""
    path = f"{stage_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what stored() wrote; only for frames that nothing lazy still reads."""
    for df in frames:
        remove(df.sparkSession, df._stored_at)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _path(spark, path)
    fs.delete(at, True)


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _path(spark, path)
    return fs.exists(at)


def entries(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder but hidden ones; none where there is no folder."""
    fs, at = _path(spark, path)
    if not fs.exists(at):
        return []
    return [n for n in (s.getPath().getName() for s in fs.listStatus(at)) if not n.startswith(("_", "."))]


def move(spark: SparkSession, source: str, target: str) -> None:
    """Renames; what was at target is replaced in one step where the file system can do that."""
    jvm = spark._jvm
    of = jvm.org.apache.hadoop.fs.Path
    _, at = _path(spark, target)
    options = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri() if at.isAbsolute() and at.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(spark._jsc.hadoopConfiguration()), spark._jsc.hadoopConfiguration())
    context.rename(of(source), at, options)


def write_json(spark: SparkSession, path: str, value) -> None:
    """Writes beside the path first and then renames over it, in whatever file system the path names."""
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    fs, at = _path(spark, beside)
    out = fs.create(at, True)
    out.write(bytearray(json.dumps(value, default=str).encode()))
    out.close()
    move(spark, beside, path)


def publish_json(spark: SparkSession, folder: str, value, keep: int = 5) -> str:
    """Makes value the newest of a folder and gives its path. A new name each time and a rename into place: a reader
    finds the version before or this one, never none and never half of one. The `keep` newest ones stay."""
    last = max(entries(spark, folder), default="0")
    number = max(time.time_ns(), int(last.split("-")[0]) + 1)
    name = f"{number:020d}-{uuid.uuid4().hex}.json"
    fs, beside = _path(spark, f"{folder}/_{name}")
    out = fs.create(beside, False)
    out.write(bytearray(json.dumps(value, default=str).encode()))
    out.close()
    if not fs.rename(beside, _path(spark, f"{folder}/{name}")[1]):
        raise OSError(f"{folder}/{name} could not be written")
    for old in sorted(entries(spark, folder))[:-keep]:
        remove(spark, f"{folder}/{old}")
    return f"{folder}/{name}"


def latest_json(spark: SparkSession, folder: str, tries: int = 5):
    """The newest value of a folder, or None. One that is pruned while it is looked up has newer ones: look again."""
    for left in range(tries, 0, -1):
        names = entries(spark, folder)
        if not names:
            return None
        try:
            return read_json(spark, f"{folder}/{max(names)}")
        except Exception:
            if left == 1 or max(entries(spark, folder), default="") == max(names):
                raise
    return None


def read_json(spark: SparkSession, path: str):
    fs, at = _path(spark, path)
    stream = fs.open(at)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    finally:
        stream.close()
