"""Query op10: documents packed into sequences of 1,024 tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bin_slack import packed
from tidemark.llm.common import documents_as_edits

TOKENIZER = "byte_bpe_50k.json"


def piece_rows(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        F.col("rev_id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Every piece with its place in a sequence."""
    return piece_rows(packed(documents_as_edits(spark, sf), public_tokenizers.path(TOKENIZER)))


#: No SQL: tokenising and packing have no counterpart there. tests/llm compares with direct encoding.
Q = {"op10_packing": (op10_packing, None)}
