"""Query op6: near duplicates among whole document texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents_as_edits
from tidemark.llm.near_forest import near_duplicates


def op6_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Component of every document."""
    found = near_duplicates(documents_as_edits(spark, sf))
    return found.select(F.col("rev_id").alias("doc_id"), "n_shingles", "component_id", "kept")


#: No SQL: a self-join on shingles is too slow on whole tables. tests/llm compares with brute force.
Q = {"op6_minhash_near_dedup": (op6_minhash_near_dedup, None)}
