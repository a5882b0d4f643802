"""The training-data pipeline over ``documents``: five stages, each written and read again.

quality rules -> exact duplicates -> near duplicates -> secrets masked -> packed sequences.
A stage gets what its predecessor kept and returns the columns of ``documents``; the last
one returns pieces of sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bin_slack import packed
from tidemark.llm.bin_slack_query import TOKENIZER, piece_rows
from tidemark.llm.blob_ledger import redacted, secrets
from tidemark.llm.blob_ledger_query import document_versions
from tidemark.llm.exact_runs import exact_duplicates
from tidemark.llm.near_forest import near_duplicates
from tidemark.llm.quality_ratio import PRIOR, judged
from tidemark.llm.quality_ratio_query import trusted_documents
from tidemark.session import scratch

MASK = "[secret]"


def as_edits(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("rev_id"), F.col("text").alias("diff"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. One without a text fails them, and one without an id cannot be named later: both go."""
    # The row travels as one struct, so no column of it can clash with the operator's.
    edits = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("rev_id"), F.col("text").alias("diff"), F.struct("*").alias("doc")
    )
    return judged(edits, trusted_documents(spark, sf_dir), prior=PRIOR).where("quality.kept").select("doc.*")


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    return docs.join(kept.where("kept").select(F.col("rev_id").alias("doc_id")), "doc_id", "left_semi").select(*docs.columns)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, and one row of a document that is repeated."""
    return _only(docs, exact_duplicates(as_edits(docs))).dropDuplicates(["doc_id"])


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return _only(docs, near_duplicates(as_edits(docs)))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked and their length counted anew."""
    found = secrets(document_versions(docs)).where(F.size("spans") > 0).select(F.col("rev_id").alias("id"), "spans").dropDuplicates(["id"])
    rows = docs.select(F.col("doc_id").alias("id"), F.struct("*").alias("doc")).join(found, "id", "left")
    text = redacted(F.col("doc.text"), F.col("spans"), MASK)
    new = {"text": text, "n_chars": F.when(F.col("spans").isNull(), F.col("doc.n_chars")).otherwise(F.char_length(text).cast("bigint"))}
    return rows.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 1,024 tokens."""
    return piece_rows(packed(as_edits(docs), public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("quality rules", keep_good),
    ("exact dedup", drop_exact),
    ("near dedup", drop_near),
    ("secret scans", mask_secrets),
    ("packing", pack),
]

#: Hash buckets, shingle links and tokenisation have no SQL here; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored as Parquet in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
