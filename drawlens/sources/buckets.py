"""Histories stored by member: tables in buckets, which group and order by member without moving a row."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlens.sources.stages import stage_dir


def bucket_count(rows: int, per: int = 250_000, least: int = 8) -> int:
    """Buckets for so many rows: a bucket is sorted by one task, so their number grows with the rows."""
    return max(least, -(-rows // per))


def bucketed(df: DataFrame, by: str = "member_id", order: tuple[str, ...] = ("ts", "draw_id"), buckets: int = 64, name: str | None = None, path: str | None = None) -> DataFrame:
    """df as a table in `buckets` buckets of by, one file each and sorted by (by, order) inside.

    Without a name and a path these are new ones below the shared folder. Null keys are one more value.
    """
    spark = df.sparkSession
    name = name or f"drawlens_{uuid.uuid4().hex}"
    path = path or f"{stage_dir(spark)}/{name}"
    rows = df.repartition(buckets, F.col(by))  # the rows of a bucket in one task, so a bucket is one file
    rows.write.format("parquet").bucketBy(buckets, by).sortBy(by, *order).option("path", path).saveAsTable(name)
    return spark.table(name)


def drop(df_name: str, spark) -> None:
    """Drops a bucketed table; its files go with the folder."""
    spark.sql(f"DROP TABLE IF EXISTS `{df_name}`")
