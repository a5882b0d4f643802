"""Query op11: documents encoded with byte-level ranks and decoded again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents_as_edits
from tidemark.llm.word_exchange import coded_and_decoded

RANKS = "byte_bpe_50k.tiktoken"


def op11_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of each document and the bytes they decode to, as digests."""
    ranks = public_tokenizers.path(RANKS)
    # An array of numbers as text is "[1, 2, 3]".
    decimal = F.btrim(F.replace(F.col("ids").cast("string"), F.lit(","), F.lit("")), F.lit("[]"))
    found = coded_and_decoded(documents_as_edits(spark, sf), ranks, public_tokenizers.PATTERN)
    return found.select(
        F.col("rev_id").alias("doc_id"),
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: No SQL: tests/llm compares with the library.
Q = {"op11_byte_bpe": (op11_byte_bpe, None)}
