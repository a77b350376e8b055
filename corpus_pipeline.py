"""From raw documents to token ids, in five stages.

Every stage takes what the one before kept, written as Parquet and read again. Rejected
documents are gone for good; all stages but the last return the columns of ``documents``.

Cases: null, empty and blank texts are no copies and stay; rows without an id are documents
of their own, whatever ids others have; rows equal in id and text become one; further
columns pass through, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, decontam, linededup, neardup, toxicity
from quern.llm.common import cut, table
from quern.llm.queries import word_bpe_path


def plainly_named(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that no operator uses, and the name of each column there."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for toxic go."""
    model = toxicity.fit(docs.select("doc_id", "text"), toxicity.training_labels(table(spark, sf_dir, "labels")))
    own, names = plainly_named(docs)
    return toxicity.score(own, model, names["text"]).where("predicted = 0").select(own.columns).toDF(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages leave the texts that share them; copies of whole texts are the next stage's matter.

    A text of which nothing is left goes; texts that were blank before stay.
    """
    own, names = plainly_named(docs)
    text = names["text"]
    done = linededup.dedup_lines(own, names["doc_id"], text, spare_copies=True)
    done = done.where((F.col("removed_words") == 0) | (F.trim(text) != ""))
    if count := names.get("n_chars"):
        done = done.withColumn(count, F.when(F.col("removed_words") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(count)))
    return done.select(own.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the least doc_id.

    Rows equal in id and text are one document. A row without an id goes if a linked one has an id.
    """
    found = neardup.near_duplicates(docs.select("doc_id", "text")).where(~F.col("kept")).select("doc_id", "text_hash")
    gone = cut(found.distinct().toDF("gone_id", "gone_hash"), "not-kept")
    own, names = plainly_named(docs)
    rows = own.withColumn("th", F.xxhash64(names["text"]))
    same = F.col(names["doc_id"]).cast("long").eqNullSafe(F.col("gone_id")) & (F.col("th") == F.col("gone_hash"))
    return rows.join(gone, same, "left_anti").dropDuplicates([names["doc_id"], "th"]).select(own.columns).toDF(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    own, names = plainly_named(docs)
    found = decontam.with_contamination(own, table(spark, sf_dir, "benchmark"), names["doc_id"], names["text"])
    return found.where(~F.col("contaminated")).select(own.columns).toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with digests of the ids and of the decoded text."""
    return bpe.encode_digest(docs.select("doc_id", "text"), "doc_id", "text", word_bpe_path(), with_ids=True)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("bpe", encode),
]

#: The stages learn, hash and encode: no SQL expresses them. ``tests/llm`` holds them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
