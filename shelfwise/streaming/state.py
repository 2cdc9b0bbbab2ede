"""Batch functions that keep serving tables up to date from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators.ordering import running_total
from shelfwise.sources.tables import BATCH, latest_per_key, read_existing, upsert
from shelfwise.streaming.runs import BatchFunction

SCORE_KEYS = ["customer_id", "product_id", "score_type"]
SCORE_NEWEST = ["computed_at"]


def upsert_scores(path: str) -> BatchFunction:
    """Keep the latest score per customer, product and score type at ``path``."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        upsert(batch, path, SCORE_KEYS, SCORE_NEWEST, batch_id)

    return merge


def read_balances(spark: SparkSession, balances_path: str) -> DataFrame:
    """``(customer_id, balance)`` after the last batch."""
    latest = latest_per_key(spark.read.parquet(balances_path), ["customer_id"], [BATCH])
    return latest.select("customer_id", "balance")


def post_points(ledger_path: str, balances_path: str) -> BatchFunction:
    """Append points events with the balance after each, in arrival order of batches.

    Running sums inside a batch are ordinary windows; between batches one balance per
    customer and batch is kept. A batch starts from the balances of earlier batches
    only, so a repeated batch gives the same rows again.
    """

    def post(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        points = F.coalesce(F.col("points").cast("long"), F.lit(0).cast("long"))
        events = batch.withColumn("points", points).persist()
        stored = read_existing(spark, balances_path)
        if stored is None:
            kind = events.schema["customer_id"].dataType.simpleString()
            stored = spark.createDataFrame([], f"customer_id {kind}, balance bigint, {BATCH} bigint")
        earlier = latest_per_key(stored.where(F.col(BATCH) < batch_id), ["customer_id"], [BATCH])
        opening = earlier.select("customer_id", F.col("balance").alias("opening"))
        before = F.coalesce("opening", F.lit(0).cast("long"))

        running = running_total(events, ["customer_id"], ["created_at", "id"], "points", "balance_after")
        rows = running.join(opening, "customer_id", "left").withColumn(
            "balance_after", F.col("balance_after") + before
        )
        rows.drop("opening").write.mode("overwrite").parquet(f"{ledger_path}/{BATCH}={batch_id}")

        moved = events.groupBy("customer_id").agg(F.sum("points").alias("moved"))
        balances = moved.join(opening, "customer_id", "left").select(
            "customer_id", (before + F.col("moved")).alias("balance")
        )
        balances.write.mode("overwrite").parquet(f"{balances_path}/{BATCH}={batch_id}")
        events.unpersist()

    return post
