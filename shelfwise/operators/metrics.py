"""Marketing metrics."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.rules import VIP_TIERS, exact_sum, ratio
from shelfwise.operators.enrich import EVENT_DAY
from shelfwise.operators.ordering import top_share

# Fixed value: a high-LTV shopper spends more than this. Segments use their own bound.
HIGH_LTV = 5000


def _by_value() -> list[Column]:
    return [F.desc_nulls_last("lifetime_value"), F.col("customer_id")]


def recent_interest(intent: DataFrame) -> DataFrame:
    """Each customer's strongest category now."""
    return intent.where(F.col("category_rank") == 1)


def high_ltv(segments: DataFrame, minimum: float = HIGH_LTV) -> DataFrame:
    return segments.where(F.col("lifetime_value") > minimum)


def top_fraction(segments: DataFrame, fraction: str = "0.10") -> DataFrame:
    """The top share of shoppers by lifetime value, rounded down, with their rank."""
    return top_share(segments, segments, F.lit(Decimal(fraction)), _by_value(), "ltv_rank", "lifetime_value")


def at_risk(segments: DataFrame) -> DataFrame:
    """Customers in the high churn band, whatever segment an earlier rule gave them."""
    return segments.where(F.col("churn_risk") == "High")


def vip(segments: DataFrame) -> DataFrame:
    """Customers of the two upper tiers, most valuable first."""
    return segments.where(F.col("loyalty_tier").isin(*VIP_TIERS)).orderBy(*_by_value())


def lapsed_browsers(
    segments: DataFrame, intent: DataFrame, category: str, days: int = 30, fraction: str = "0.10"
) -> DataFrame:
    """Shoppers who stopped buying but look at ``category``, most valuable first.

    At most ``fraction`` of all segment rows remain, counted before any filter.
    """
    lapsed = segments.where(F.col("days_since_last_purchase") > days)
    browsing = intent.where((F.col("resolved_category") == category) & (F.col("intent_score") > 0))
    found = lapsed.join(browsing, "customer_id").select(
        "customer_id",
        "first_name",
        "last_name",
        "lifetime_value",
        "days_since_last_purchase",
        F.col("intent_score").alias("category_interest"),
    )
    return top_share(found, segments, F.lit(Decimal(fraction)), _by_value(), "ltv_rank")


def segment_counts(segments: DataFrame) -> DataFrame:
    return segments.groupBy("segment").agg(F.count("*").alias("customers"))


def churn_bands(golden: DataFrame) -> DataFrame:
    """Customers and spend per churn band."""
    return golden.groupBy("churn_risk").agg(
        F.count("*").alias("customers"),
        F.sum("total_spend").alias("total_spend"),
        F.max("days_since_last_purchase").alias("longest_gap_days"),
    )


def add_to_cart_rate(enriched: DataFrame) -> DataFrame:
    """Cart additions per product view and category; null without views."""
    counts = enriched.groupBy("resolved_category").agg(
        F.count_if(F.col("event_type") == "add_to_cart").alias("add_to_carts"),
        F.count_if(F.col("event_type") == "product_view").alias("product_views"),
    )
    return counts.withColumn("add_to_cart_rate", ratio(F.col("add_to_carts"), F.col("product_views")))


def category_interest(intent: DataFrame) -> DataFrame:
    return intent.groupBy("resolved_category").agg(
        F.sum("intent_score").alias("total_interest"),
        F.count_distinct("customer_id").alias("unique_shoppers"),
    )


def trending(intent: DataFrame) -> DataFrame:
    """Categories by total interest, hottest first."""
    return category_interest(intent).orderBy(F.desc("total_interest"), "resolved_category")


def best_sellers(purchases: DataFrame, products: DataFrame) -> DataFrame:
    """Units, revenue and orders by product name, category and brand.

    Purchases collapse to one row per product before they meet the catalogue.
    """
    per_product = purchases.groupBy("product_id").agg(
        F.sum(F.col("quantity").cast("long")).alias("units"),
        exact_sum(F.col("total_amount")).alias("revenue"),
        F.count("*").alias("purchases"),
    )
    named = per_product.join(products.select("product_id", "product_name", "category", "brand"), "product_id")
    return named.groupBy("product_name", "category", "brand").agg(
        F.sum("units").alias("units_sold"),
        F.sum("revenue").alias("revenue"),
        F.sum("purchases").alias("purchases"),
    )


def session_summary(enriched: DataFrame) -> DataFrame:
    """Events, span, categories and dwell time per session."""
    first, last = F.min("event_timestamp"), F.max("event_timestamp")
    return enriched.groupBy("session_id", "customer_id").agg(
        F.count("*").alias("events"),
        first.alias("started_at"),
        last.alias("ended_at"),
        (F.unix_timestamp(last) - F.unix_timestamp(first)).alias("span_seconds"),
        F.count_distinct("resolved_category").alias("categories"),
        F.sum(F.col("time_on_page_seconds").cast("long")).alias("dwell_seconds"),
    )


def daily_reach(enriched: DataFrame) -> DataFrame:
    """``(event_day, resolved_category, sketch)``: mergeable sketches of the customers.

    For dashboards over changing windows: a stored day is never counted again. Events
    without a category are left out.
    """
    known = enriched.where(F.col("resolved_category").isNotNull() & F.col("customer_id").isNotNull())
    return known.groupBy(EVENT_DAY, "resolved_category").agg(F.hll_sketch_agg("customer_id", 14).alias("sketch"))


def reach_between(sketches: DataFrame, first: str, last: str) -> DataFrame:
    """``(resolved_category, about)``: distinct customers of the days, from sketches alone.

    The standard error of a sketch of this size is below 1 per cent.
    """
    days = sketches.where(F.col(EVENT_DAY).between(first, last))
    return days.groupBy("resolved_category").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("about"))
