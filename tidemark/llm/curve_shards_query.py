"""Query op7: documents in eight shards along a Hilbert curve."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents_as_edits
from tidemark.llm.curve_shards import LAW, hilbert_shards

DIMENSIONS = ("n_chars", "lang", "source")


def op7_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """Shard and slot of every document; row counts are at most one apart."""
    found = hilbert_shards(documents_as_edits(spark, sf, *DIMENSIONS), DIMENSIONS)
    return found.select(
        F.col("rev_id").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit(LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: No SQL: quantile cuts and the curve have no counterpart there. tests/llm checks the law and the curve.
Q = {"op7_sharding": (op7_sharding, None)}
