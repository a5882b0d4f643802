"""Reading and writing the tables the jobs exchange."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import configure


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table with zone-less timestamps read as UTC."""
    df = configure(spark).read.parquet(f"{folder}/{name}.parquet")
    return df.select(
        *[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes]
    )


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted cells, doubled quotes, line breaks inside cells."""
    df.write.csv(path, header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False,
                 ignoreTrailingWhiteSpace=False)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strings come back trimmed; an empty cell is an empty string."""
    df = spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', multiLine=True)
    return df.select(
        *[F.coalesce(F.trim(F.col(c), F.lit(" \t\r\n")), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    )


def write_report(df: DataFrame, path: str) -> None:
    """One JSON object per report row, nested structs included."""
    df.write.json(path, ignoreNullFields=False)


def load_prices(spark: SparkSession, path: str) -> DataFrame:
    """(model, input, output, retrieved_at) from a dated price file: USD per million tokens."""
    schema = "retrievedAt STRING, models MAP<STRING, STRUCT<input: DOUBLE, output: DOUBLE>>"
    df = spark.read.json(path, schema=schema, multiLine=True)
    return df.select("retrievedAt", F.explode("models").alias("model", "price")).select(
        "model", "price.input", "price.output", F.to_date("retrievedAt").alias("retrieved_at")
    )


def append_runs(rows: DataFrame, path: str) -> None:
    """Add answers to the run table; ``set`` and ``config`` are its partitions."""
    rows.write.mode("append").partitionBy("set", "config").parquet(path)


RUN_SCHEMA = (
    "rev_id BIGINT, revert BOOLEAN, p_revert DOUBLE, invalid STRING, raw STRING, latency_ms DOUBLE, "
    "tokens_in BIGINT, tokens_out BIGINT, model_version STRING, at TIMESTAMP, `set` STRING, config STRING"
)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).parquet(path)


def read_or_no_runs(spark: SparkSession, path: str) -> DataFrame:
    """The run table, empty where nothing was appended yet."""
    try:
        return read_runs(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RUN_SCHEMA)


def append_log(rows: DataFrame, path: str) -> None:
    """History and alert logs only grow."""
    rows.write.mode("append").parquet(path)


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, digest): content identity that ignores row order and file layout.

    Each row becomes SHA-256 of its JSON; all 256 bits are summed exactly, in parts of
    32, so the sums combine before the shuffle at any table size. The digest is
    the SHA-256 of the joined sums.
    """
    digest = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)") for i in range(8)]
    sums = [F.coalesce(F.sum(f"p{i}"), F.lit(0)).cast("string") for i in range(8)]
    return df.select(*[p.alias(f"p{i}") for i, p in enumerate(parts)]).agg(
        F.count("*").alias("rows"), F.sha2(F.concat_ws(",", *sums), 256).alias("digest")
    )


def freeze(df: DataFrame, path: str, **about: str) -> None:
    """Write a snapshot and, beside it, the manifest that identifies its content."""
    df.write.parquet(f"{path}/data")
    stored = df.sparkSession.read.parquet(f"{path}/data")
    manifest = fingerprint(stored)
    for key, value in about.items():
        manifest = manifest.withColumn(key, F.lit(value))
    manifest.coalesce(1).write.json(f"{path}/manifest")


def thaw(spark: SparkSession, path: str) -> DataFrame:
    """Read a snapshot; refuse one whose content no longer matches its manifest."""
    df = spark.read.parquet(f"{path}/data")
    want = spark.read.schema("rows BIGINT, digest STRING").json(f"{path}/manifest").first()
    have = fingerprint(df).first()
    if (want["rows"], want["digest"]) != (have["rows"], have["digest"]):
        raise ValueError(f"snapshot {path} does not match its manifest")
    return df
