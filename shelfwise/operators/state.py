"""Rows of the serving tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import rules
from shelfwise.functions.clock import AsOf, instant
from shelfwise.operators.offers import live_offer_counts


def active_sessions(enriched: DataFrame) -> DataFrame:
    """One row per session: span, device, page, categories, products, cart and intent.

    Clicks without a session belong to none. Events first collapse to one row per
    session, category and product, with numbers and times only, which spreads a very
    long session over all tasks; only those rows meet by session. The customer, the
    device and the page are those of the session's last event. The cart holds what was
    added last and not removed since; at the same moment an addition counts as later.
    """
    clicks = enriched.where(F.col("session_id").isNotNull())
    kind, time = F.col("event_type"), F.col("event_timestamp")
    by_product = clicks.groupBy(
        "session_id", F.col("resolved_category").alias("category"), "product_id"
    ).agg(
        F.min(time).alias("started_at"),
        F.sum(rules.event_weight(kind)).alias("score"),
        F.max(F.when(kind == "add_to_cart", time)).alias("added_at"),
        F.max(F.when(kind == "remove_from_cart", time)).alias("removed_at"),
    )
    last = clicks.groupBy("session_id").agg(
        F.max(F.struct("event_timestamp", "event_id", "customer_id", "device_type", "page_url")).alias("last")
    )
    # One exchange on the session serves the windows, the grouping and the join below.
    by_session = by_product.repartition("session_id")
    total = F.sum("score").over(Window.partitionBy("session_id", "category"))
    product = Window.partitionBy("session_id", "product_id")
    added, removed = F.max("added_at").over(product), F.max("removed_at").over(product)
    scored = by_session.withColumns(
        {
            "score": total.cast("decimal(18,2)").cast("double"),
            "held": added >= F.coalesce(removed, added),
        }
    )
    whole = scored.groupBy("session_id").agg(
        F.min("started_at").alias("started_at"),
        F.array_sort(F.collect_set("category")).alias("categories_viewed"),
        F.array_sort(F.collect_set("product_id")).alias("products_viewed"),
        F.array_sort(F.collect_set(F.when(F.col("held"), F.col("product_id")))).alias("cart_items"),
        F.collect_set(F.when(F.col("category").isNotNull(), F.struct("category", "score"))).alias("scores"),
    )
    return whole.join(last, "session_id").select(
        "session_id",
        F.col("last.customer_id").alias("customer_id"),
        "started_at",
        F.col("last.event_timestamp").alias("last_activity_at"),
        F.col("last.device_type").alias("device_type"),
        F.col("last.page_url").alias("current_page"),
        "categories_viewed",
        "products_viewed",
        "cart_items",
        F.map_from_entries(F.array_sort("scores")).alias("session_intent"),
    )


def last_sessions(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("customer_id").agg(F.max("event_timestamp").alias("last_session_at"))


def customer_state(
    segments: DataFrame, intent: DataFrame, offers: DataFrame, clicks: DataFrame, as_of: AsOf = None
) -> DataFrame:
    """Snapshot per customer. Every side has one row per customer, so all joins share
    one partitioning. ``clicks`` needs only typed customer and time columns."""
    favourite = intent.where(F.col("category_rank") == 1).select(
        "customer_id", F.col("resolved_category").alias("top_category")
    )
    return (
        segments.select(
            "customer_id",
            "first_name",
            "last_name",
            "loyalty_tier",
            "loyalty_points",
            "lifetime_value",
            "segment",
            "churn_risk",
        )
        .join(favourite, "customer_id", "left")
        .join(live_offer_counts(offers, as_of), "customer_id", "left")
        .join(last_sessions(clicks), "customer_id", "left")
        .withColumn("active_offers_count", F.coalesce("active_offers_count", F.lit(0)))
        .withColumn("updated_at", instant(as_of))
    )
