"""Query op4: secrets of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.blob_ledger import RULES, secrets, spans_text


def document_versions(docs: DataFrame) -> DataFrame:
    """Documents as page versions: the source is the page, the id the version."""
    return docs.select(F.col("source").alias("title"), F.col("doc_id").alias("rev_id"), F.col("text").alias("diff"))


def op4_secret_scans(spark: SparkSession, sf: str) -> DataFrame:
    """Counts per kind and all spans of each document."""
    found = secrets(document_versions(spark.read.parquet(f"{sf}/documents.parquet")))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        F.col("rev_id").alias("doc_id"),
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(spans_text(F.col("spans")).cast("binary"), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


def _kind_sql(rank: int, rule) -> str:
    rx = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind,
    unnest(regexp_split_to_array(text, '{rx}')[:-2]) AS gap,
    unnest(regexp_extract_all(text, '{rx}', 0)) AS hit,
    unnest(regexp_extract_all(text, '{rx}', {rule.group})) AS value,
    generate_subscripts(regexp_extract_all(text, '{rx}', 0), 1) AS i
  FROM d"""


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
parts AS ({" UNION ALL ".join(_kind_sql(i, r) for i, r in enumerate(RULES))}),
placed AS (
  SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS stop FROM parts),
good AS (
  SELECT doc_id, rank, kind, CAST(stop - length(hit) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop
  FROM placed WHERE length(value) >= CASE rank {" ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(RULES))} END),
per AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM good GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (doc_id)
"""

Q = {"op4_secret_scans": (op4_secret_scans, SQL)}
