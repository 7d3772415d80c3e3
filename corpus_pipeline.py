"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlscan.llm import minhash, mixing, packing, quality_rules, secret_scan
from crawlscan.llm.common import Workspace, small


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null, empty and wordless texts fail the base rules; a null lang is a stratum of its own; repeated rows
    are judged alike; without labels the base rules alone apply.
    """
    return quality_rules.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each near-duplicate group (five-word shingles, 0.8).

    Texts without words and rows without doc_id are in no group and stay; rows that repeat a doc_id stay or
    go together.
    """
    gone = minhash.near_duplicates(docs).filter("NOT kept").select(F.col("doc_id").alias("gone_id")).distinct()
    gone = small(Workspace(spark, "pipeline").save(gone, "gone"))
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced and n_chars counted again (null for null texts)."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them.

    Documents without words are in no mix; a null source is one of its own, the last; equal rows at a
    source's cut share what is left.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and offset of every piece of every document; a null bin for a text without words."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near-duplicates", near_dedup),
    ("secret scan", secrets),
    ("source mixing", mix),
    ("best-fit packing", pack),
]

#: Signatures, packing and redaction have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn on ``documents``, each stored and read again.  An empty table gives no rows."""
    ws = Workspace(spark, "corpus")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = ws.save(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            ws.drop(f"stage{k - 1}")
    return docs
