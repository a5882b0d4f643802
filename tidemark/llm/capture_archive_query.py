"""Query op1: pages archived as WARC records and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.capture_archive import payloads, read_archive, write_archive

SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS newest FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN newest END AS refers_to
FROM m
"""


def op1_warc(spark: SparkSession, sf: str) -> DataFrame:
    """What a reader of the archives finds for each page."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    manifest = write_archive(pages.select(F.col("page_id").alias("offset"), F.col("html").alias("value")))
    found = payloads(read_archive(manifest, with_data=False))
    return found.select(F.col("offset").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


Q = {"op1_warc": (op1_warc, SQL)}
