"""Session defaults and the shared folder used for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
SCRATCH = "tidemark-scratch"


def configure(spark: SparkSession) -> SparkSession:
    """Pin what results depend on: every timestamp here is UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: the one the cluster names, else one in the warehouse."""
    sc = spark.sparkContext
    root = sc.getCheckpointDir() or spark.conf.get(CHECKPOINT_CONF, None)
    if root is None:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{SCRATCH}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for one intermediate table, below this application's part of the shared folder."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{SCRATCH}-{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; results that still read them go with them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from there.

    For results several later branches read: each would otherwise repeat the work,
    and lost executors would repeat it again.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
