"""Query op8: repeated 200-byte stretches of whole document texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents_as_edits
from tidemark.llm.suffix_repeats import repeated_stretches


def op8_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes removed from each document, and the digest of the rest."""
    found = repeated_stretches(documents_as_edits(spark, sf))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        F.col("rev_id").alias("doc_id"),
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.coalesce(F.sha2("kept", 256), "text_sha256").alias("kept_sha256"),
    )


#: No SQL: every 200-byte string of every text. tests/llm compares with brute force.
Q = {"op8_suffix_array_dedup": (op8_suffix_array_dedup, None)}
