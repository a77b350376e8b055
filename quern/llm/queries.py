"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, linededup, lmscore, media, neardup, sharding, toxicity, warc
from .common import table


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.with_contamination(documents, table(spark, sf_dir, "benchmark")).drop("text")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_wav(table(spark, sf_dir, "documents"), "doc_id", "text")
    return media.wav_features(media.sniff_media(stored, "doc_id"), "doc_id")


CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text")
    )
    text_part = F.expr(f"array(cast(named_struct('type','text','text',text,'ref',null,'width',null,'height',null,'millis',null,'pages',null) as {chat.PART}))")
    return chat.read_chat(chat.format_chat(rows.unionByName(probe).withColumn("parts", text_part)))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(documents, toxicity.training_labels(table(spark, sf_dir, "labels")))
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(table(spark, sf_dir, "documents"), "doc_id", "text", word_bpe_path())


SHARDS = 40


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.byte_shards(table(spark, sf_dir, "documents"), "doc_id", "text", SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    return lmscore.scores(table(spark, sf_dir, "documents").select("doc_id", "text"), held_out)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_pages(table(spark, sf_dir, "pages"))
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(documents)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontam, op2_media, op3_chat, op4_toxicity, op5_bpe, op6_sharding, op7_lm_score, op8_minhash, op9_warc, op10_line_dedup)
}

ORACLE_SQL: dict[str, str] = {}
