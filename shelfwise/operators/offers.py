"""Personal offers."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import rules, text
from shelfwise.functions.clock import AsOf, instant, plus_hours
from shelfwise.sources.scratch import cut_lineage

# Offer templates in order, and the hours each type stays open.
TEMPLATES = [
    ("discount", "20% Off", 24),
    ("bonus_points", "500 Bonus Points", 12),
    ("early_access", "Early Access", 48),
    ("bundle", "Buy 2, Save 30%", 6),
]
OFFERED_CATEGORIES = 3
WIN_BACK = "Win-Back"
WIN_BACK_HOURS = 72
WIN_BACK_RELEVANCE = Decimal("0.99")

# Lowest and highest relevance of a category offer.
LOWEST = Decimal("0.82")
HIGHEST = Decimal("0.98")

# Columns of the offer table, after the slot in the basket.
OFFER_COLUMNS = [
    "customer_id",
    "slot",
    "offer_code",
    "product_id",
    "product_name",
    "category",
    "relevance_score",
    "offer_type",
    "offer_value",
    "reason",
    "expires_at",
    "is_active",
    "created_at",
    "served_at",
    "redeemed_at",
]


def _templates() -> Column:
    return F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), F.lit(value).alias("value"), F.lit(hours).alias("hours"))
            for kind, value, hours in TEMPLATES
        ]
    )


def _as_rows(df: DataFrame, hours: Column, as_of: AsOf) -> DataFrame:
    """Fill the bookkeeping columns of a new offer; without products it names none."""
    now = instant(as_of)
    never = F.lit(None).cast("timestamp")
    if "product_id" not in df.columns:
        df = df.withColumn("product_id", F.lit(None).cast("string"))
    return (
        df.withColumn("expires_at", plus_hours(now, hours))
        .withColumn("is_active", F.lit(True))
        .withColumn("created_at", now)
        .withColumn("served_at", never)
        .withColumn("redeemed_at", never)
        .select(*OFFER_COLUMNS)
    )


def _listed(segments: DataFrame) -> DataFrame:
    """A customer's first preferred categories with their positions."""
    preferred = F.slice(text.json_strings(F.col("preferred_categories")), 1, OFFERED_CATEGORIES)
    return segments.select("customer_id", F.posexplode(preferred).alias("position", "category"))


def offer_expiries(segments: DataFrame, as_of: AsOf = None) -> DataFrame:
    """``(customer_id, is_active, expires_at)`` of the whole basket.

    What counting live offers needs, without the join that only relevance needs.
    """
    template = F.element_at(_templates(), F.col("position") % len(TEMPLATES) + 1)
    now, active = instant(as_of), F.lit(True).alias("is_active")
    listed = _listed(segments).select(
        "customer_id", active, plus_hours(now, template["hours"]).alias("expires_at")
    )
    winback = segments.where(F.col("segment") == WIN_BACK).select(
        "customer_id", active, plus_hours(now, F.lit(WIN_BACK_HOURS)).alias("expires_at")
    )
    return listed.unionByName(winback)


def category_offers(
    segments: DataFrame, intent: DataFrame, as_of: AsOf = None, shelf: DataFrame | None = None
) -> DataFrame:
    """One offer for each of a customer's first three preferred categories.

    With ``shelf``, rows ``(category, product_id, product_rank)``, an offer names the
    category's best product.

    The i-th category takes the i-th template. Relevance rises with the customer's
    intent for the category; the expiry follows from the offer type.
    """
    listed = _listed(segments)
    wanted = intent.select("customer_id", F.col("resolved_category").alias("category"), "intent_score")
    matched = listed.join(wanted, ["customer_id", "category"], "left")

    template = F.element_at(_templates(), F.col("position") % len(TEMPLATES) + 1)
    full = F.least(F.coalesce(F.col("intent_score"), F.lit(0)).cast("decimal(18,2)"), F.lit(rules.FULL_INTENT))
    relevance = F.lit(LOWEST) + full * F.lit((HIGHEST - LOWEST) / rules.FULL_INTENT)
    code = F.concat_ws(
        "-",
        F.upper(F.left("category", F.lit(3))),
        F.upper(F.left(F.col("template.kind"), F.lit(4))),
        text.id_suffix(F.col("customer_id")),
    )
    rows = (
        matched.withColumn("template", template)
        .withColumn("slot", F.col("position") + 1)
        .withColumn("offer_code", code)
        .withColumn("product_name", F.format_string("Trending %s Collection", F.col("category")))
        .withColumn("relevance_score", F.round(relevance, 2).cast("double"))
        .withColumn("offer_type", F.col("template.kind"))
        .withColumn("offer_value", F.col("template.value"))
        .withColumn(
            "reason",
            F.format_string("Based on your recent browsing in %s and purchase history", F.col("category")),
        )
    )
    if shelf is not None:
        best = shelf.where(F.col("product_rank") == 1).select("category", F.col("product_id").cast("string"))
        # One row per category, stored so that its size is known.
        rows = rows.join(cut_lineage(best, "best"), "category", "left")
    return _as_rows(rows, F.col("template.hours"), as_of)


def winback_offers(segments: DataFrame, as_of: AsOf = None) -> DataFrame:
    """The offer that goes first for customers of the Win-Back segment."""
    reason = F.format_string(
        "It's been %d days — welcome back with this exclusive offer", F.col("days_since_last_purchase")
    )
    rows = (
        segments.where(F.col("segment") == WIN_BACK)
        .withColumn("slot", F.lit(0))
        .withColumn("offer_code", F.concat(F.lit("WINBACK-"), text.id_suffix(F.col("customer_id"))))
        .withColumn("product_name", F.lit("We Miss You!"))
        .withColumn("category", F.lit("All Categories"))
        .withColumn("relevance_score", F.lit(WIN_BACK_RELEVANCE).cast("double"))
        .withColumn("offer_type", F.lit("discount"))
        .withColumn("offer_value", F.lit("25% Off Everything"))
        .withColumn("reason", reason)
    )
    return _as_rows(rows, F.lit(WIN_BACK_HOURS), as_of)


def offers(
    segments: DataFrame, intent: DataFrame, as_of: AsOf = None, shelf: DataFrame | None = None
) -> DataFrame:
    """The whole basket; ``slot`` 0 is the win-back offer."""
    return winback_offers(segments, as_of).unionByName(category_offers(segments, intent, as_of, shelf))


def live_offers(all_offers: DataFrame, as_of: AsOf = None) -> DataFrame:
    """Active offers that have not expired, ranked per customer by relevance."""
    live = all_offers.where(F.col("is_active") & (F.col("expires_at") > instant(as_of)))
    best = Window.partitionBy("customer_id").orderBy(F.desc("relevance_score"), "slot", "offer_code")
    return live.withColumn("offer_rank", F.row_number().over(best))


def live_offer_counts(all_offers: DataFrame, as_of: AsOf = None) -> DataFrame:
    live = all_offers.where(F.col("is_active") & (F.col("expires_at") > instant(as_of)))
    return live.groupBy("customer_id").agg(F.count("*").cast("int").alias("active_offers_count"))
