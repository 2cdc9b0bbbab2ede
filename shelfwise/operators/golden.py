"""Customer golden record."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from shelfwise.functions import rules
from shelfwise.functions.clock import AsOf, instant
from shelfwise.operators.quality import expect_or_drop, mask_pii

# Fixed value: name and condition of the customer rule.
CUSTOMER_RULES = {"valid_customer_id": "customer_id IS NOT NULL"}


def purchase_rollup(purchases: DataFrame) -> DataFrame:
    """Five purchase aggregates per customer.

    Amounts are summed exactly, so the result does not depend on task order.
    """
    amount = rules.exact_sum(F.col("total_amount"))
    return purchases.groupBy("customer_id").agg(
        F.count("*").alias("total_transactions"),
        amount.alias("total_spend"),
        rules.ratio(amount, F.count("total_amount")).alias("avg_order_value"),
        F.max("purchase_date").alias("most_recent_purchase"),
        F.count_distinct("product_id").alias("unique_products_purchased"),
    )


def golden_record(
    customers: DataFrame,
    purchases: DataFrame,
    as_of: AsOf = None,
    observation: Observation | str | None = None,
    rollup: DataFrame | None = None,
) -> DataFrame:
    """One masked row per customer with purchase aggregates and churn risk.

    Customers without purchases keep null aggregates. ``rollup`` holds the
    ``purchase_rollup`` where it is stored.
    """
    valid = expect_or_drop(mask_pii(customers), CUSTOMER_RULES, observation)
    # Shuffled: it grows with the customers, and its files are a fraction of what a broadcast holds.
    rolled = purchase_rollup(purchases) if rollup is None else rollup.hint("merge")
    joined = valid.join(rolled, "customer_id", "left")
    days = F.datediff(F.to_date(instant(as_of)), F.to_date("most_recent_purchase"))
    return joined.withColumn("days_since_last_purchase", days).withColumn(
        "churn_risk", rules.churn_risk(F.col("days_since_last_purchase"))
    )
