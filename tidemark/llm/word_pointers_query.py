"""Query op12: how the sources of each language differ in words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.word_pointers import divergence


def op12_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    """A language is a wiki here, a source a class of editors, a document an edit."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = divergence(docs.select(F.col("lang").alias("wiki"), F.col("source").alias("user_class"), F.col("text").alias("diff")))
    return found.select(F.col("wiki").alias("lang"), F.col("user_class").alias("source"), "part", "item", "value", "rank")


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
),
used AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
of_lang AS (SELECT lang, term, count(*) AS ln FROM used GROUP BY ALL HAVING count(DISTINCT doc) >= 3),
counts AS (SELECT u.lang, u.source, u.term, count(*) AS n FROM used u JOIN of_lang k USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, sum(ln) AS lsize, count(*) AS v FROM of_lang GROUP BY lang),
sizes AS (SELECT lang, source, sum(n) AS size FROM counts GROUP BY ALL),
groups AS (
  SELECT g.lang, g.source, coalesce(s.size, 0) AS size, coalesce(l.lsize, 0) AS lsize, coalesce(l.v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN sizes s USING (lang, source) LEFT JOIN langs l USING (lang)
),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.size + g.v) AS p,
         1 + 1000000000::HUGEINT * (k.ln + 1) // (g.lsize + g.v) AS q
  FROM groups g JOIN of_lang k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found
QUALIFY part = 'pair' OR rank <= 200
"""

Q = {"op12_source_divergence": (op12_source_divergence, SQL)}
