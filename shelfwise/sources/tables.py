"""Table writers: layered tables, appends, snapshots and keyed upserts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "batch_id"


def publish_table(
    df: DataFrame, name: str, layer: str, comment: str, partitioned_by: Sequence[str] = ()
) -> DataFrame:
    """Replace table ``name``, record its layer and comment, and return the stored table."""
    spark = df.sparkSession
    df.write.mode("overwrite").format("parquet").partitionBy(*partitioned_by).saveAsTable(name)
    spark.sql("ALTER TABLE IDENTIFIER(:name) SET TBLPROPERTIES ('quality' = :layer)", {"name": name, "layer": layer})
    spark.sql("COMMENT ON TABLE IDENTIFIER(:name) IS :comment", {"name": name, "comment": comment})
    return spark.table(name)


def digests(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, rows, digest)``: how many rows a key has, and a sum over their hashes,
    which changes whenever a row is added, removed or altered."""
    hashed = F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(38,0)")
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.coalesce(F.sum(hashed), F.lit(0)).alias("digest"))


def replace_partitions(df: DataFrame, name: str, column: str, days: Sequence[date]) -> None:
    """Replace the partitions ``days`` of table ``name`` by the rows of ``df``, which has
    no others. Partitions that get no rows are dropped; no other file is touched."""
    spark = df.sparkSession
    ordered = df.select(*spark.table(name).columns)
    # Few rows of a partition lie in each task, so that every partition gets few files.
    dealt = ordered.repartition(column, F.pmod(F.xxhash64(*ordered.columns), F.lit(8)))
    mode = "spark.sql.sources.partitionOverwriteMode"  # inserts follow the session, not the writer
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        dealt.write.mode("overwrite").insertInto(name)
    finally:
        spark.conf.set(mode, before)
    left = {row[0] for row in df.select(column).distinct().collect()}
    for day in set(days) - left:
        spark.sql(f"ALTER TABLE IDENTIFIER(:name) DROP IF EXISTS PARTITION ({column} = DATE'{day}')", {"name": name})


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def latest_per_key(df: DataFrame, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """One row per key: the greatest by the ``newest`` columns.

    An aggregate, so copies of a key collapse before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    first = [*newest, *(c for c in rest if c not in newest)]
    best = df.groupBy(*keys).agg(F.max(F.struct(*first)).alias("best"))
    return best.select(*keys, *[F.col(f"best.{c}").alias(c) for c in rest]).select(*df.columns)


def read_existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The parquet table at ``path``, or None before its first write."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def upsert(new: DataFrame, path: str, keys: Sequence[str], newest: Sequence[str], batch_id: int) -> None:
    """Add a batch to the keyed table at ``path``, at the cost of the batch.

    A batch has a folder of its own, so no stored file is read or written again, and
    merging the same batch twice gives the same table. ``read_upserted`` picks the
    latest row per key; ``compact`` writes a table of only those.
    """
    latest_per_key(new, keys, newest).write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")


def read_upserted(spark: SparkSession, path: str, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """The latest row per key over all batches."""
    return latest_per_key(spark.read.parquet(path).drop(BATCH), keys, newest)


def compact(
    spark: SparkSession, path: str, into: str, keys: Sequence[str], newest: Sequence[str], batch_id: int
) -> None:
    """Write the latest rows of ``path`` to the new table ``into``, as one batch.

    ``batch_id`` is the last batch that ``path`` holds; later batches go to ``into``.
    The old table stays as it is, for readers that still use it.
    """
    stored = read_upserted(spark, path, keys, newest)
    stored.write.parquet(f"{into}/{BATCH}={batch_id}")
