"""The operators as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlens.llm.chat import chat_format
from drawlens.llm.classifier import classify, train
from drawlens.llm.filter_audit import AUDIT_SQL, filter_audit
from drawlens.llm.licenses import license_scan
from drawlens.llm.line_dedup import line_dedup
from drawlens.llm.mix import mix
from drawlens.llm.pack import pack, with_crc
from drawlens.llm.quality_rules import quality_rules
from drawlens.llm.secret_scan import secret_scan, with_digests
from drawlens.llm.shard import shuffle_shards
from drawlens.llm.simhash import simhash
from drawlens.llm.vector_codes import codes_sql, vector_codes
from drawlens.llm.winnow import edited_fingerprints


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(_table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(_table(spark, sf_dir, "documents"))
    base, own = F.transform("places", lambda p: p["label"]), F.transform("detections", lambda d: d["label"])
    place = F.transform("places", lambda p: p["first_word"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(place).alias("first_word"),
        F.array_max(place).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.coalesce(F.greatest(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.when(F.size("places") > 0, F.lit(0.85))), F.lit(0.0)).alias("score"),
    )


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_crc(pack(_table(spark, sf_dir, "documents")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash(_table(spark, sf_dir, "documents"))


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    return shuffle_shards(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return classify(docs, train(docs, _table(spark, sf_dir, "labels")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(_table(spark, sf_dir, "conversations"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(_table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digests(secret_scan(_table(spark, sf_dir, "documents")))


OPERATORS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mix, op2_quality_rules, op3_fingerprints, op4_license_scan, op5_pack, op6_simhash, op7_shard, op8_quality_classifier, op9_line_dedup, op10_chat_format, op11_vector_codes, op12_filter_audit, op13_secret_scan)
}

ORACLES: dict[str, str] = {
    "op11_vector_codes": codes_sql(),
    "op12_filter_audit": AUDIT_SQL,
    "op1_mix": r"""
        WITH sizes AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                   ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':7'), 1, 15))::BIGINT AS u,
                   ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS v
            FROM documents
        ), sources AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   list_extract([3, 1, 2], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT)::BIGINT AS weight
            FROM sizes GROUP BY source
        ), ordered AS (
            SELECT *, 2.0::DOUBLE * source_size AS cap,
                   coalesce(sum(2.0::DOUBLE * source_size) OVER before, 0) AS caps,
                   coalesce(sum(weight) OVER before, 0)::BIGINT AS weights,
                   row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST) AS rank
            FROM sources
            WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), levels AS (
            SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM sources)::DOUBLE - caps) / ((SELECT sum(weight) FROM sources)::BIGINT - weights) AS level FROM ordered
        ), goals AS (
            SELECT source, source_size, least(cap, (SELECT arg_min(level, rank) FROM levels WHERE cap / weight >= level) * weight) AS target FROM levels
        ), rates AS (
            SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM goals
        ), placed AS (
            SELECT s.doc_id, s.size, r.source_size, r.target, r.whole, r.target - r.whole * r.source_size AS extra,
                   coalesce(sum(CASE WHEN size > 0 THEN size ELSE 0 END) OVER (PARTITION BY s.source ORDER BY u, v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM sizes s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source
        )
        SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN size > 0 AND extra > 0 AND before + size / 2 <= extra THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM placed
    """,
}
