"""Query op2: counts, n-gram ratio and verdict of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents_as_edits
from tidemark.llm.quality_ratio import PRIOR, judged


def trusted_documents(spark: SparkSession, sf: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return labels.where("quality = 1").select(F.col("doc_id").alias("rev_id"))


def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Base counts and the verdict of the n-gram ratio for each document."""
    found = judged(documents_as_edits(spark, sf), trusted_documents(spark, sf), prior=PRIOR)
    return found.select(F.col("rev_id").alias("doc_id"), "quality.*")


#: No SQL: the bucket hash has no counterpart in DuckDB. tests/llm compares with brute force.
Q = {"op2_quality_rules": (op2_quality_rules, None)}
