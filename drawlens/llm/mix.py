"""Mixing sources to target weights (DataFrame functions only).

Targets come from capped water-filling: every source gets the same level times its weight, sources above
max_epochs times their size stop there, and what they leave goes to the others by weight. With sources in order
of size per weight the level has a closed form, so no iteration is needed.

Documents then repeat: each source's rate splits in whole repetitions, which all its documents get, and a
fraction, for which documents are drawn without replacement in the order of a seeded hash until the wanted words
are reached (to within half a document). A source may hold any share of the rows: its cut is found by descending
through 4096-way ranges of the hash, each a pre-aggregated sum, so no task sees a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from drawlens.llm.common import WORD, forget, ranked, save

BITS, STEP = 60, 12
#: Order of drawing: hash of the id, hash of the text, place in the stored table.
KEYS = ("u", "v", "k")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, max_epochs: float) -> DataFrame:
    """source, source_size -> with target. sources has one row per source; weights repeat by code point, null last."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    named = ranked(sources.where("source IS NOT NULL"), [F.col("source")])
    n = named.count()
    named = named.unionByName(sources.where("source IS NULL").withColumn("rank", F.lit(n).cast("long")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    named = named.select("source", "source_size", weight.cast("long").alias("weight"), (max_epochs * F.col("source_size")).alias("cap"))
    totals = named.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    if totals.size is None:
        return named.select("source", "source_size", F.lit(0.0).alias("target"))
    goal = min(share, max_epochs) * totals.size
    named = ranked(named, [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()], {"caps": "cap", "weights": "weight"})
    named = named.withColumn("level", (goal - F.col("caps")) / (totals.weight - F.col("weights")))
    named = save(named, "levels")
    level = named.where("cap / weight >= level").agg(F.min_by("level", "rank")).first()[0]
    target = F.col("cap") if level is None else F.least(F.col("cap"), level * F.col("weight"))
    return named.select("source", "source_size", target.cast("double").alias("target"))


def _cuts(rows: DataFrame, goals: DataFrame, few: int) -> DataFrame:
    """source, key: the last (u, v, k) in hash order that gets the extra repetition.

    The cut is looked for among the ids' hashes u first, then, where rows share an id, among their texts' hashes v,
    and among equal rows by their place k in the stored table; so no id and no copy is too frequent to be cut through.
    """
    zero = [F.lit(0).cast("long").alias(c) for c in ("u0", "v0", "k0", "base")]
    at = save(goals.where("extra > 0").select("source", "extra", *zero), "cuts")

    def inside(key: str, shift: int) -> DataFrame:
        """The documents whose key starts, down to bit shift, as their source's cut does, all earlier keys being equal."""
        c = at.withColumnRenamed("source", "_s")
        found = rows.where("size > 0").join(c, F.col("source").eqNullSafe(F.col("_s"))).where(F.shiftright(key, shift) == F.shiftright(f"{key}0", shift))
        for earlier in KEYS[: KEYS.index(key)]:
            found = found.where(F.col(earlier) == F.col(f"{earlier}0"))
        return found

    done = False
    for key in KEYS:
        shift = BITS
        while shift > 0 and not done:
            shift -= STEP
            others = [f"{k}0" for k in KEYS if k != key]
            ranges = inside(key, shift + STEP).groupBy("source", "extra", "base", *others, F.shiftright(key, shift).alias("r")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
            before = F.coalesce(F.sum("size").over(W.partitionBy("source").orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("base")
            ranges = ranges.withColumn("before", before).where("before < extra AND extra <= before + size")
            ranges = ranges.select("source", "extra", *others, F.shiftleft("r", shift).alias(f"{key}0"), F.col("before").cast("long").alias("base"), "n")
            last, at = at, save(ranges, "cuts")
            forget(last)
            done = (at.agg(F.max("n")).first()[0] or 0) <= few
        if done:
            break
    w = W.partitionBy("source").orderBy(*KEYS).rowsBetween(W.unboundedPreceding, -1)
    last = inside(key, shift).withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0)) + F.col("base"))
    last = last.groupBy("source", "u0", "v0", "k0").agg(F.max(F.when(F.expr("before + size / 2 <= extra"), F.struct(*KEYS))).alias("key"))
    none = F.struct(F.col("u0").alias("u"), F.col("v0").alias("v"), (F.col("k0") - 1).alias("k"))
    out = save(last.select("source", F.coalesce("key", none).alias("key")), "cut")
    forget(at)
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 7, few: int = 20_000, through: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, source, size (words), source_size, target (of its source), repeats, taken.

    Needs doc_id, text and source; other columns are ignored. Null and empty texts have size 0, are never taken
    more often than their source's whole repetitions, and add nothing. A null source is a source, in last place.
    Rows count one by one, whether their doc_id is null or that of others. An empty table gives an empty result.
    few: how many documents of a source one task may order when it places the cut. through: columns of docs that come
    along, in a struct row.
    """
    hashed = lambda text: F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")
    u = hashed(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    row = [F.struct(*through).alias("row")] if through else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), u.alias("u"), hashed(F.coalesce(F.col("text"), F.lit(""))).alias("v"), *row)
    rows = save(rows.withColumn("k", F.monotonically_increasing_id()), "sizes")
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    goals = save(goals.withColumn("whole", whole.cast("long")).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size")), "goals")
    cuts = _cuts(rows, goals, few)
    met = save(goals.join(cuts.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"), "goals").withColumnRenamed("source", "_s")
    forget(goals, cuts)
    more = F.coalesce(((F.struct(*KEYS) <= F.col("key")) & (F.col("size") > 0) & (F.col("extra") > 0)).cast("long"), F.lit(0))
    out = rows.join(met, F.col("source").eqNullSafe(F.col("_s"))).withColumn("repeats", F.col("whole") + more)
    return out.select("doc_id", "source", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"), *(["row"] if through else []))
