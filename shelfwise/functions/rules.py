"""Business rules: event weights, recency, churn bands, segments, relevance."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points per click event. Types not listed score 0.
EVENT_WEIGHTS = {
    "add_to_cart": "3.0",
    "wishlist_add": "2.0",
    "search": "1.5",
    "product_view": "1.0",
    "category_browse": "0.5",
}

# Upper bound in hours (inclusive) -> multiplier. Older events keep 1.0.
RECENCY_STEPS = [(6, "2.0"), (12, "1.5"), (24, "1.2")]

# Churn bands and segment bounds.
CHURN_HIGH_DAYS = 60
CHURN_MEDIUM_DAYS = 30
WIN_BACK_DAYS = 30
WIN_BACK_LTV = 3000
VIP_DAYS = 14
VIP_TIERS = ("Platinum", "Gold")
RISING_STAR_INTENT = 15
FEW_ORDERS = 3

# The intent score and the rating that count as full marks.
FULL_INTENT = 20
FULL_RATING = 5


def _decimal(text: str) -> Column:
    return F.lit(Decimal(text))


def event_weight(event_type: Column) -> Column:
    """Points for one event. DECIMAL(2,1): sums stay exact whatever their order."""
    points = None
    for name, weight in EVENT_WEIGHTS.items():
        hit = event_type == name
        points = F.when(hit, _decimal(weight)) if points is None else points.when(hit, _decimal(weight))
    return points.otherwise(_decimal("0.0"))


def recency_multiplier(hours_ago: Column) -> Column:
    """Boost for recent events; an event ahead of ``as_of`` gets the top step."""
    boost = None
    for bound, factor in RECENCY_STEPS:
        hit = hours_ago <= bound
        boost = F.when(hit, _decimal(factor)) if boost is None else boost.when(hit, _decimal(factor))
    return boost.otherwise(_decimal("1.0"))


def churn_risk(days: Column) -> Column:
    """Band of days since the last purchase; never bought (null) counts as Low."""
    return (
        F.when(days > CHURN_HIGH_DAYS, "High")
        .when(days > CHURN_MEDIUM_DAYS, "Medium")
        .otherwise("Low")
    )


def segment(
    days: Column, lifetime_value: Column, tier: Column, intent: Column, churn: Column, orders: Column
) -> Column:
    """Marketing segment; the first rule that holds wins."""
    return (
        F.when((days > WIN_BACK_DAYS) & (lifetime_value > WIN_BACK_LTV), "Win-Back")
        .when(tier.isin(*VIP_TIERS) & (days <= VIP_DAYS), "VIP Active")
        .when((tier == "Silver") & (intent > RISING_STAR_INTENT), "Rising Star")
        .when(churn == "High", "At Risk")
        .when(days.isNull() | (orders <= FEW_ORDERS), "New & Engaged")
        .otherwise("Steady")
    )


def relevance(intent: Column, rating: Column) -> Column:
    """Intent share times rating share, at most 1, four places, exact decimals.

    Without a rating there is nothing to recommend on: 0.
    """
    scale = Decimal(1) / (FULL_INTENT * FULL_RATING)
    share = intent.cast("decimal(14,2)") * rating.cast("decimal(16,8)") * F.lit(scale)
    return F.least(_decimal("1.0000"), F.coalesce(F.round(share, 4), _decimal("0.0000"))).cast("decimal(18,4)")


def exact_sum(amount: Column) -> Column:
    """Sum of a two-place amount as a decimal, whatever the order of the rows.

    Whole cents add up as 64-bit integers, which stays in generated code.
    """
    cents = F.sum(F.rint(amount.cast("double") * 100).cast("bigint"))
    return (cents.cast("decimal(20,0)") * _decimal("0.01")).cast("decimal(20,2)")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as DOUBLE; null when there is nothing to divide by."""
    return F.try_divide(part.cast("double"), whole.cast("double"))
