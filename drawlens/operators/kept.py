"""Aggregates that are kept and merged: a batch is read once, and what it adds to the totals is stored.

For each batch there are its totals by group (rows, sums, extremes) and those values of distinct columns that no
batch before had. Totals of all batches merge into what one pass over all rows gives; distinct counts are exact, as a
value is stored in the first batch that has it only.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlens.sources.stages import entries, exists


@dataclass(frozen=True)
class Kept:
    """Where the state lies and what is kept: sums and extremes of columns, and counts of their distinct values."""

    path: str
    by: tuple[str, ...]
    sums: tuple[str, ...] = ()
    extremes: tuple[str, ...] = ()
    distinct: tuple[str, ...] = ()

    def _done(self, spark: SparkSession) -> list[str]:
        """Batches that are stored whole, by name; totals are written last, so their mark stands for both."""
        return sorted(b for b in entries(spark, f"{self.path}/totals") if exists(spark, f"{self.path}/totals/{b}/_SUCCESS"))

    def _read(self, spark: SparkSession, what: str, batches: Iterable[str]) -> DataFrame | None:
        paths = [f"{self.path}/{what}/{b}" for b in batches]
        return spark.read.parquet(*paths) if paths else None

    def _same(self, right: str) -> Column:
        out = F.lit(True)
        for c in (*self.by, "_name", "_value"):
            out = out & F.col(c).eqNullSafe(F.col(f"{right}{c}"))
        return out

    def absorb(self, rows: DataFrame, batch: str) -> bool:
        """Adds a batch; False, with nothing read, where it is there already. One that broke off is begun anew."""
        spark = rows.sparkSession
        done = self._done(spark)
        if batch in done:
            return False
        if self.distinct:
            tall = F.explode(F.array(*(F.struct(F.lit(c).alias("_name"), F.col(c).cast("string").alias("_value")) for c in self.distinct)))
            values = rows.select(*self.by, tall.alias("_v")).select(*self.by, "_v.*").where("_value IS NOT NULL").distinct()
            known = self._read(spark, "values", done)
            if known is not None:
                known = known.toDF(*(f"_known{c}" for c in known.columns))
                values = values.join(known, self._same("_known"), "left_anti")
            values.write.mode("overwrite").parquet(f"{self.path}/values/{batch}")
        stats = [F.count("*").alias("rows"), *(F.sum(c).alias(f"sum_{c}") for c in self.sums), *(f(c).alias(f"{f.__name__}_{c}") for c in self.extremes for f in (F.min, F.max))]
        rows.groupBy(*self.by).agg(*stats).write.mode("overwrite").parquet(f"{self.path}/totals/{batch}")
        return True

    def totals(self, spark: SparkSession) -> DataFrame | None:
        """by..., rows, sum_x, min_x, max_x, distinct_x over all batches; reads the state alone. None without batches."""
        done = self._done(spark)
        found = self._read(spark, "totals", done)
        if found is None:
            return None
        out = found.groupBy(*self.by).agg(
            F.sum("rows").alias("rows"), *(F.sum(f"sum_{c}").alias(f"sum_{c}") for c in self.sums), *(f(f"{f.__name__}_{c}").alias(f"{f.__name__}_{c}") for c in self.extremes for f in (F.min, F.max))
        )
        if not self.distinct:
            return out
        counts = self._read(spark, "values", done).groupBy(*(F.col(c).alias(f"_k_{c}") for c in self.by)).agg(*(F.count_if(F.col("_name") == c).alias(f"distinct_{c}") for c in self.distinct))
        same = F.lit(True)
        for c in self.by:
            same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        out = out.join(counts, same, "left").drop(*(f"_k_{c}" for c in self.by))
        return out.fillna(0, [f"distinct_{c}" for c in self.distinct])
