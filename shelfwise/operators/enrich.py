"""Clean clicks joined with the catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.operators.quality import expect_or_drop
from shelfwise.operators.skew import repeated, salted

# Names and conditions of the click rules.
CLICK_RULES = {
    "valid_customer": "customer_id IS NOT NULL",
    "valid_timestamp": "event_timestamp IS NOT NULL",
}

# Product column -> column of an enriched click.
CATALOGUE_COLUMNS = {
    "product_id": "product_id",
    "product_name": "product_name",
    "category": "product_category",
    "subcategory": "product_subcategory",
    "brand": "product_brand",
    "price": "product_price",
    "style_tags": "product_style_tags",
}

SPREAD = "null_spread"

#: The day that stored clicks are partitioned by; clicks without a time lie on ``NO_DAY``.
EVENT_DAY, NO_DAY = "event_day", "1900-01-01"


def catalogue_columns(products: DataFrame) -> DataFrame:
    """The product columns an enriched click carries, under their new names."""
    return products.select(*[F.col(old).alias(new) for old, new in CATALOGUE_COLUMNS.items()])


def event_time(df: DataFrame, column: str = "event_timestamp") -> Column:
    """Text that is not a time becomes null instead of an error."""
    if isinstance(df.schema[column].dataType, T.StringType):
        return F.try_to_timestamp(F.col(column))
    return F.col(column).cast("timestamp")


def with_event_day(clicks: DataFrame) -> DataFrame:
    """Clicks with the day that their table is stored by."""
    day = F.coalesce(event_time(clicks).cast("date"), F.lit(NO_DAY).cast("date"))
    return clicks.withColumn(EVENT_DAY, day)


def left_join_spread(
    left: DataFrame, right: DataFrame, key: str, spread_by: str, hot: Sequence = ()
) -> DataFrame:
    """Left join on ``key`` that does not send all null keys to one task.

    Many clicks have no product. The second key is a hash of the key, or of
    ``spread_by`` where the key is null; those rows match nothing and spread over all
    partitions. Whether the right side is broadcast stays Spark's choice from its
    size, and adaptive execution splits a hot key of a shuffled join. Where there is none,
    as in stateful streams, the rows of the ``hot`` keys are dealt into parts, and only
    those rows of the right side are repeated.
    """
    # Both sides hash the key, so they must hold it in one type.
    right = right.withColumn(key, F.col(key).cast(left.schema[key].dataType))
    spread = F.when(F.col(key).isNull(), F.xxhash64(spread_by)).otherwise(salted(F.col(key), hot, F.col(spread_by)))
    joined = left.withColumn(SPREAD, spread).join(repeated(right, key, hot, SPREAD), [key, SPREAD], "left")
    return joined.drop(SPREAD)


def enrich_clicks(
    clicks: DataFrame,
    products: DataFrame,
    observation: Observation | str | None = None,
    hot_products: Sequence = (),
) -> DataFrame:
    """Typed clicks with product columns and the category they resolve to.

    Works on a batch or on a stream. The rules look only at columns of the click,
    so they run before the join and reach the scan. ``hot_products`` are those that a
    stream must not gather in one task; ``heavy_hitters`` finds them in stored clicks.
    """
    typed = clicks.withColumn("event_timestamp", event_time(clicks))
    valid = expect_or_drop(typed, CLICK_RULES, observation)
    catalogue = catalogue_columns(products)
    if not clicks.isStreaming:  # it grows, and its files are a fraction of what a broadcast holds
        catalogue = catalogue.hint("merge")
    joined = left_join_spread(valid, catalogue, "product_id", "event_id", hot_products)
    return joined.withColumn(
        "resolved_category", F.coalesce(F.col("product_category"), F.col("category_browsed"))
    )
