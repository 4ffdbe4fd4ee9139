"""Intermediate results as tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; on a local master where it is unset (tests), one in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_steps"


def snapshot(df: DataFrame, **options) -> DataFrame:
    """``df`` written to the shared folder (with these options of the writer) and read again: its lineage ends there, and a lost executor costs a task."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lodeseam-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as the cluster has cores, if it is read in fewer: a small file may be a single split."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or df.rdd.getNumPartitions() > cores else df.repartition(cores)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for joins that grow with it: they are never broadcasts, which Spark would choose by the size of files, a small part of what they hold in memory."""
    return df.hint("merge")
