"""Per-customer data behind the shopper portal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import text
from shelfwise.functions.clock import AsOf, instant, minutes_ago
from shelfwise.operators.enrich import enrich_clicks, event_time

# Categories every profile shows, and the length of the feed.
DEFAULT_CATEGORIES = ("Tops", "Activewear")
FEED_LENGTH = 7

# Fixed value: the sentences that describe a shopper to the style assistant.
PROFILE_CONTEXT = (
    "You are a personal style assistant for %s. "
    "They are a %s tier member who loves %s. "
    "They have %d points and live in %s, %s. "
    "Provide personalized, enthusiastic fashion advice. "
    "Keep responses concise (2-3 paragraphs max)."
)


def interest_profile(
    segments: DataFrame, intent: DataFrame, defaults: Sequence[str] = DEFAULT_CATEGORIES
) -> DataFrame:
    """Preferred and default categories of each customer, strongest intent first."""
    preferred = F.coalesce(
        text.json_strings(F.col("preferred_categories")), F.array().cast("array<string>")
    )
    shown = F.array_distinct(F.concat(preferred, F.array(*[F.lit(c) for c in defaults])))
    listed = segments.select("customer_id", F.posexplode(shown).alias("position", "category"))
    wanted = intent.select(
        "customer_id", F.col("resolved_category").alias("category"), "intent_score", "event_count"
    )
    zero = F.lit(0)
    best = Window.partitionBy("customer_id").orderBy(F.desc("intent_score"), "position")
    return (
        listed.join(wanted, ["customer_id", "category"], "left")
        .withColumn("intent_score", F.coalesce("intent_score", zero.cast("decimal(18,2)")))
        .withColumn("event_count", F.coalesce("event_count", zero.cast("long")))
        .withColumn("profile_rank", F.row_number().over(best))
        .drop("position")
    )


def action_text() -> Column:
    """One sentence per click event."""
    kind = F.col("event_type")
    product = F.coalesce(F.col("product_name"), F.lit("a product"))
    category = F.coalesce(F.col("resolved_category"), F.lit("a"))
    return (
        F.when(kind == "category_browse", F.format_string("Viewed %s category page", category))
        .when(kind == "product_view", F.format_string("Viewed %s", product))
        .when(kind == "search", F.format_string('Searched for "%s"', F.coalesce("search_term", F.lit(""))))
        .when(kind == "wishlist_add", F.format_string("Added %s to wishlist", product))
        .when(kind == "add_to_cart", F.format_string("Added %s to cart", product))
        .when(kind == "remove_from_cart", F.format_string("Removed %s from cart", product))
        .otherwise(F.format_string("Browsed %s page", F.coalesce("page_url", F.lit("a"))))
    )


def session_feed(clicks: DataFrame, products: DataFrame, as_of: AsOf = None, n: int = FEED_LENGTH) -> DataFrame:
    """The last ``n`` events of each customer, newest first, as sentences.

    Events are cut to ``n`` per customer before they meet the catalogue.
    """
    typed = clicks.withColumn("event_timestamp", event_time(clicks))
    valid = typed.where(F.col("customer_id").isNotNull() & F.col("event_timestamp").isNotNull())
    newest = Window.partitionBy("customer_id").orderBy(F.desc("event_timestamp"), F.desc("event_id"))
    last = valid.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= n)
    return enrich_clicks(last, products).select(
        "customer_id",
        "position",
        "event_id",
        "event_type",
        minutes_ago(F.col("event_timestamp"), instant(as_of)).alias("time"),
        action_text().alias("action"),
    )


def profile_context(segments: DataFrame) -> DataFrame:
    """The text that introduces a shopper to the style assistant."""
    loved = F.array_join(F.slice(text.json_strings(F.col("preferred_categories")), 1, 3), ", ")
    sentence = F.format_string(
        PROFILE_CONTEXT,
        F.col("first_name"),
        F.col("loyalty_tier"),
        loved,
        F.col("loyalty_points"),
        F.col("city"),
        F.col("state"),
    )
    label = text.customer_label(F.col("first_name"), F.col("last_name"), F.col("customer_id"))
    return segments.select("customer_id", label.alias("label"), sentence.alias("context"))
