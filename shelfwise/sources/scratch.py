"""Shared scratch folder for written intermediates, stream checkpoints and results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``.

    A cluster names that folder; where it is unset, the warehouse folder, which
    executors share as well, takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/shelfwise-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the application's scratch folder."""
    return f"{scratch_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Remove what this application has written so far, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as parquet in the scratch folder and read it back.

    Used where a result is read several times, and where a small result meets a
    large table: a stored table has a known size, so Spark broadcasts it only if it
    is small enough and otherwise shuffles.
    """
    spark = df.sparkSession
    path = scratch_path(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
