"""Query op13: embeddings as codes of four bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.active_lloyd import ROUNDS, compressed


def op13_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Code, errors and the digest of the codebooks for each usable embedding."""
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    found = compressed(vectors.select("vec_id", F.col("embedding").alias("vector"), "label"))
    digest = found.codebooks.digest() if found.codebooks else None
    return found.codes.select("vec_id", "code", "error", "label_error", F.lit(digest).cast("string").alias("codebooks_sha256"))


def _round(k: int) -> str:
    """Assignment k, and the entries after it."""
    return f"""
d{k} AS MATERIALIZED (
  SELECT x.r, x.part, e.entry, sum((x.x - e.c) * (x.x - e.c)) AS d
  FROM x JOIN e{k} e ON x.part = e.part AND x.pos = e.pos GROUP BY ALL
),
a{k} AS MATERIALIZED (SELECT r, part, min((d, entry)) AS best FROM d{k} GROUP BY ALL),
m{k} AS (
  SELECT x.part, a.best[2] AS entry, x.pos, CAST(floor(sum(x.x) / count(*)) AS BIGINT) AS c
  FROM x JOIN a{k} a ON x.r = a.r AND x.part = a.part GROUP BY ALL
),
e{k + 1} AS MATERIALIZED (SELECT e.part, e.entry, e.pos, coalesce(m.c, e.c) AS c FROM e{k} e LEFT JOIN m{k} m USING (part, entry, pos))"""


SQL = f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
),
c AS (SELECT r, unnest(embedding) AS c, unnest(range(len(embedding))) AS i, len(embedding) // 4 AS width FROM v),
x AS MATERIALIZED (SELECT r, i // width AS part, i % width AS pos, CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT) AS x FROM c),
e0 AS MATERIALIZED (SELECT part, r - 1 AS entry, pos, x AS c FROM x WHERE r <= 256),{",".join(_round(k) for k in range(ROUNDS + 1))},
codes AS (
  SELECT r, string_agg(lpad(lower(to_hex(best[2])), 2, '0'), '' ORDER BY part) AS code, CAST(sum(best[1]) AS BIGINT) AS error
  FROM a{ROUNDS} GROUP BY r
),
books AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) AS digest FROM e{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256
FROM v JOIN codes USING (r) CROSS JOIN books
"""

Q = {"op13_vector_codes": (op13_vector_codes, SQL)}
