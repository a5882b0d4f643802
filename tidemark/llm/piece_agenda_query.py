"""Query op9: documents encoded with a merge-type sentencepiece model and decoded again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents_as_edits
from tidemark.llm.piece_agenda import encoded

MODEL = "piece_bpe_32k.model"


def op9_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    """Ids and decoded text of each document, as digests."""
    found = encoded(documents_as_edits(spark, sf), public_tokenizers.path(MODEL))
    return found.select(
        F.col("rev_id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


#: No SQL: tests/llm compares with the library.
Q = {"op9_sentencepiece": (op9_sentencepiece, None)}
