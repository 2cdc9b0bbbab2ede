"""Loyalty tiers and the points ledger."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import text
from shelfwise.operators.ordering import running_total

# Tiers in order with the points at their upper end.
TIERS = [("Bronze", 2000), ("Silver", 8000), ("Gold", 20000), ("Platinum", 50000)]
POINT_VALUE = Decimal("0.01")


def tier_progress(customers: DataFrame, mode: str = "upper") -> DataFrame:
    """Next tier, points to go, progress and the worth of the points.

    ``upper`` aims at the upper end of the next tier; ``entry`` at its entry, the
    upper end of the current tier.
    """
    if mode not in ("upper", "entry"):
        raise ValueError(f"mode must be 'upper' or 'entry', not {mode!r}")
    names = [name for name, _ in TIERS]
    following = [*names[1:], names[-1]]
    bounds = dict(TIERS)
    aims = [bounds[nxt if mode == "upper" else now] for now, nxt in zip(names, following)]
    aims[-1] = bounds[names[-1]]
    next_tier = F.create_map(*[F.lit(x) for pair in zip(names, following) for x in pair])
    target = F.create_map(*[F.lit(x) for pair in zip(names, aims) for x in pair])

    tier, points = F.col("loyalty_tier"), F.col("loyalty_points")
    top = names[-1]
    # points * 100 / target in whole numbers: the percentage rounded down.
    reached = F.floor(points.cast("long") * 100 / F.col("next_threshold")).cast("int")
    return (
        customers.select("customer_id", "loyalty_tier", "loyalty_points", "lifetime_value")
        .withColumn("next_tier", F.coalesce(F.try_element_at(next_tier, tier), F.lit(top)))
        .withColumn("next_threshold", F.coalesce(F.try_element_at(target, tier), F.lit(bounds[top])))
        .withColumn("points_to_next", F.greatest(F.lit(0), F.col("next_threshold") - points))
        .withColumn("progress_pct", F.when(tier == top, 100).otherwise(F.least(F.lit(100), reached)))
        .withColumn("points_value", (points.cast("decimal(16,0)") * F.lit(POINT_VALUE)).cast("decimal(18,2)"))
        .withColumn("points_text", text.thousands(points))
        .withColumn("points_value_text", F.concat(F.lit("Worth "), text.dollars(F.col("points_value"))))
        .withColumn("ltv_text", text.dollars(F.col("lifetime_value"), 0))
    )


def ledger_balance(points_events: DataFrame) -> DataFrame:
    """Ledger rows with the balance after each, in order of time and id.

    An event without points moves nothing: it counts as 0.
    """
    points = F.coalesce(F.col("points").cast("long"), F.lit(0).cast("long"))
    signed = points_events.withColumn("points", points)
    return running_total(signed, ["customer_id"], ["created_at", "id"], "points", "balance_after")


def current_balance(points_events: DataFrame) -> DataFrame:
    return points_events.groupBy("customer_id").agg(F.sum(F.col("points").cast("long")).alias("balance"))
