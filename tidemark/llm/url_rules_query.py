"""Query op3: every page's address against four rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.url_rules import judged_addresses

#: The rules the task states: (host, path, verdict).
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
_FITS = " UNION ALL ".join(
    f"SELECT page_id, url, '{host}{path}' AS rule, '{verdict}' AS verdict FROM parts WHERE (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
    for host, path, verdict in RULES
)
SQL = f"""
WITH parts AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
best AS (
  SELECT url, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT url, rule, verdict FROM ({_FITS})) GROUP BY url)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b ON p.url = b.url
"""


def op3_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Rule and verdict of every page."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    found = judged_addresses(spark.read.parquet(f"{sf}/pages.parquet"), rules)
    return found.select("page_id", "address.*")


Q = {"op3_url_filters": (op3_url_filters, SQL)}
