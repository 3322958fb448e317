"""A corpus pipeline: language ID, near-duplicates, decontamination, mixing, sharding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import decontaminate, langid, mixing, sharding, simhash
from loomline.llm.common import aside, remove, scratch, table

SHARDS = 24


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model recognises; those it rejects go, as do null texts and those without letters.

    Long texts are read whole; repeated rows share their fate, ties go as in the operator. All columns come back as they
    were, whatever their names; an empty table gives no rows.
    """
    own, back = aside(docs, ("lang_pred", "score", "rejected"))
    return langid.identify(own, langid.learn(docs)).where(~F.col("rejected")).select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

    Candidates are fingerprints of two-word shingles at most 7 of 64 bits apart; the similarity is verified on whole texts.

    Of a group the row with the least doc_id stays (null last, ties by text), so of repeated rows one; null and empty
    texts are one group, very long ones are hashed whole. All columns come back, whatever their names; an empty table gives no rows.
    """
    return simhash.one_of_each(docs, radius=7, segments=4, words=2, similarity=0.8, shingle=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks. Rows that share a doc_id are one document, those without one are known by their text.

    Null and empty texts stay, very long ones are searched whole, repeated rows share their fate; all columns stay, whatever
    their names; an empty table gives no rows.
    """
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row for every whole copy, and for a part of at least half a document.

    Documents without words stay once. A null source is a source; rows that tie in doc_id share their part. All columns
    come back, whatever their names; an empty table gives no rows.
    """
    own, back = aside(docs, ("size", "sources", "target", "source_size", "taken", "_copy"))
    mixed = mixing.mix_by_source(own)
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    return mixed.withColumn("_copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>")))).select(*back)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot there, which replace columns of these names; all others are kept.

    Repeated rows and null keys are rows like others; an empty table gives no rows.
    """
    return sharding.hypergeometric_shards(docs, SHARDS, ["doc_id"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mix),
    ("sharding", shards),
]

#: SQL can express neither the trained model nor the seeded draws; the tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's rows are written as Parquet to the shared folder and read again, and deleted when the next one's are there."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs, path = scratch(stage(spark, docs, sf_dir))
        if before:
            remove(spark, before)
        before = path
    return docs
