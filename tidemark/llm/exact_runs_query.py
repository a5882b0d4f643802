"""Query op5: exact duplicates of whole document texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents_as_edits
from tidemark.llm.exact_runs import exact_duplicates

SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
    sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
  first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS kept,
  text_sha256
FROM d
"""


def op5_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with the one that stays of its group of equal texts."""
    found = exact_duplicates(documents_as_edits(spark, sf))
    return found.select(F.col("rev_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


Q = {"op5_exact_dedup": (op5_exact_dedup, SQL)}
