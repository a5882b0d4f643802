"""Small helpers that several operators of this folder share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EDIT_KEY = "rev_id"
EDIT_TEXT = "diff"


def edit_columns(edits: DataFrame, *more: str) -> DataFrame:
    """``(rev_id, diff, ...)`` only, so extra columns of any name cannot clash; a NULL text is empty."""
    return edits.select(
        F.col(EDIT_KEY).cast("bigint").alias(EDIT_KEY),
        F.coalesce(F.col(EDIT_TEXT).cast("string"), F.lit("")).alias(EDIT_TEXT),
        *more,
    )


def documents_as_edits(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """The ``documents`` table as edits: its id is the revision, its text the diff."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select(F.col("doc_id").alias(EDIT_KEY), F.col("text").alias(EDIT_TEXT), *more)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hex_sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
