"""Segment tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import rules
from shelfwise.operators.intent import engagement

# Columns of the segment table, in order.
SEGMENT_COLUMNS = [
    "customer_id",
    "first_name",
    "last_name",
    "loyalty_tier",
    "loyalty_points",
    "lifetime_value",
    "total_orders",
    "days_since_last_purchase",
    "churn_risk",
    "total_intent_score",
    "segment",
    "preferred_categories",
    "city",
    "state",
]


def segments(golden: DataFrame, intent: DataFrame) -> DataFrame:
    """One row per customer with the segment tag; carries no address or card digits."""
    engaged = golden.join(engagement(intent), "customer_id", "left")
    tag = rules.segment(
        F.col("days_since_last_purchase"),
        F.col("lifetime_value"),
        F.col("loyalty_tier"),
        F.col("total_intent_score"),
        F.col("churn_risk"),
        F.col("total_orders"),
    )
    return engaged.withColumn("segment", tag).select(*SEGMENT_COLUMNS)
