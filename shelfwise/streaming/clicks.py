"""Streams of clicks: ingest, duplicates, intent buckets and sessions.

Cleaning and enrichment are the batch function ``enrich_clicks``; it takes a stream
of clicks and a static catalogue as well.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions import rules
from shelfwise.functions.clock import AsOf, hours_between, instant
from shelfwise.operators.intent import RECENT_DAYS, rank_categories, recent_events
from shelfwise.sources.files import CSV_OPTIONS


def read_click_stream(
    spark: SparkSession, path: str, schema: str, fmt: str = "csv", files_per_batch: int | None = None
) -> DataFrame:
    """New files below ``path`` as a stream, at most ``files_per_batch`` at a time."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.options(**CSV_OPTIONS)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def dedupe_events(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop events whose id came before within ``delay``; state older than that goes.

    Events without an id cannot repeat one: all of them stay. They never reach the
    state, so they are no hot key there.
    """
    timed = stream.withWatermark("event_timestamp", delay)
    known = timed.where(F.col("event_id").isNotNull()).dropDuplicatesWithinWatermark(["event_id"])
    return known.unionByName(timed.where(F.col("event_id").isNull()))


def intent_buckets(
    enriched: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = "1 hour"
) -> DataFrame:
    """Weight sums per time bucket, customer and category.

    A boost relative to "now" cannot be kept up incrementally, so buckets hold plain
    weights and ``intent_from_buckets`` applies the boost when they are read.
    """
    categorised = enriched.where(F.col("resolved_category").isNotNull())
    bucket = F.window("event_timestamp", width, slide) if slide else F.window("event_timestamp", width)
    totals = (
        categorised.withWatermark("event_timestamp", delay)
        .groupBy(bucket.alias("bucket"), "customer_id", "resolved_category")
        .agg(
            F.sum(rules.event_weight(F.col("event_type"))).alias("weight"),
            F.count("*").alias("event_count"),
            F.max("event_timestamp").alias("latest_interaction"),
        )
    )
    return totals.select(
        F.col("bucket.start").alias("bucket_start"),
        F.col("bucket.end").alias("bucket_end"),
        "customer_id",
        "resolved_category",
        F.col("weight").cast("decimal(18,2)").alias("weight"),
        "event_count",
        "latest_interaction",
    )


def intent_from_buckets(
    buckets: DataFrame, as_of: AsOf = None, events: DataFrame | None = None, width: str = "1 hour"
) -> DataFrame:
    """Ranked intent from stored tumbling buckets of ``width``.

    A step of the boost, or the window's start, may lie inside a bucket. The events of
    those few buckets are scored one by one from ``events``, the stored enriched
    clicks; without them ``as_of`` must fall on a bucket's edge.
    """
    now = instant(as_of)
    steps = [now - F.make_dt_interval(hours=F.lit(hours)) for hours, _ in rules.RECENCY_STEPS]
    # Ages count in whole seconds, so an event less than a second past a step still counts as before it.
    edges = [*(F.date_trunc("second", step) for step in steps), F.date_sub(now, RECENT_DAYS).cast("timestamp")]

    def cut(start: Column, end: Column) -> Column:
        return reduce(lambda a, b: a | b, [(start < edge) & (edge < end) for edge in edges])

    inside = cut(F.col("bucket_start"), F.col("bucket_end"))
    whole = recent_events(buckets.where(~inside).withColumnRenamed("bucket_start", "event_timestamp"), as_of)
    parts = whole.select("customer_id", "resolved_category", "event_timestamp", "weight", "event_count", "latest_interaction")
    if events is not None:
        # The plain bound on time reaches the scan; the windows then pick the buckets.
        near = recent_events(events.where(F.col("resolved_category").isNotNull()), as_of)
        span = F.window("event_timestamp", width)
        timed = near.withColumn("span", span).where(cut(F.col("span.start"), F.col("span.end")))
        parts = parts.unionByName(
            timed.select(
                "customer_id",
                "resolved_category",
                "event_timestamp",
                rules.event_weight(F.col("event_type")).cast("decimal(18,2)").alias("weight"),
                F.lit(1).cast("long").alias("event_count"),
                F.col("event_timestamp").alias("latest_interaction"),
            )
        )
    boost = rules.recency_multiplier(hours_between(now, F.col("event_timestamp")))
    intent = parts.groupBy("customer_id", "resolved_category").agg(
        F.sum((F.col("weight").cast("decimal(14,2)") * boost).cast("decimal(16,2)"))
        .cast("decimal(18,2)")
        .alias("intent_score"),
        F.sum("event_count").alias("event_count"),
        F.max("latest_interaction").alias("latest_interaction"),
    )
    return rank_categories(intent)


def _sessions(enriched: DataFrame, gap: str) -> DataFrame:
    """Sessions split by a pause of ``gap``, of a batch or of a stream with a watermark."""
    kind = F.col("event_type")
    cart = F.struct("product_id", "event_timestamp", (kind == "add_to_cart").alias("added"))
    session = F.session_window("event_timestamp", gap)
    totals = enriched.groupBy(session.alias("session"), "customer_id").agg(
        F.max("event_timestamp").alias("last_activity_at"),
        F.count("*").alias("events"),
        F.sum(rules.event_weight(kind)).alias("score"),
        F.collect_set("resolved_category").alias("categories"),
        F.collect_set("product_id").alias("products"),
        F.collect_set(F.when(kind.isin("add_to_cart", "remove_from_cart"), cart)).alias("cart"),
    )

    def last(product: Column, added: bool) -> Column:
        same = F.filter("cart", lambda c: (c.product_id == product) & (c.added == F.lit(added)))
        return F.array_max(F.transform(same, lambda c: c.event_timestamp))

    # At the same moment an addition counts as the later one.
    held = F.filter("products", lambda p: last(p, True) >= F.coalesce(last(p, False), last(p, True)))
    return totals.select(
        "customer_id",
        F.col("session.start").alias("started_at"),
        "last_activity_at",
        "events",
        F.col("score").cast("decimal(18,2)").alias("score"),
        F.array_sort("categories").alias("categories_viewed"),
        F.array_sort("products").alias("products_viewed"),
        F.array_sort(held).alias("cart_items"),
    )


def stream_sessions(enriched: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions emitted once they can no longer grow; ``open_sessions`` has the others.

    With ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` set,
    as a session builder should, events of one session merge on each task before the
    shuffle, so a customer with most of the events does not send them all to one task.
    """
    return _sessions(enriched.withWatermark("event_timestamp", delay), gap)


def open_sessions(events: DataFrame, closed: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions still growing: of the stored clicks after each customer's last closed one.

    A customer's open session begins after all closed ones have ended, so the clicks
    later than the last closed click are exactly the open ones.
    """
    ended = closed.groupBy("customer_id").agg(F.max("last_activity_at").alias("ended_at"))
    later = F.col("ended_at").isNull() | (F.col("event_timestamp") > F.col("ended_at"))
    return _sessions(events.join(ended, "customer_id", "left").where(later).drop("ended_at"), gap)
