"""The retail tables derived from the star-schema sample tables.

The samples hold no shop data, so their columns stand in for it: events are clicks,
parts are products, order lines are purchases. Every derivation is row by row over
the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# One clock for all tables: the sample events end the day before.
AS_OF = "2024-01-31 00:00:00"

# Days that move the last sample order to the last event day.
ORDER_SHIFT_DAYS = 8217

# The part types, used as categories.
CATEGORIES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")

# Market segment -> loyalty tier; others are Bronze.
TIERS = {"MACHINERY": "Silver", "HOUSEHOLD": "Gold", "FURNITURE": "Platinum"}

# Below this event value an error counts as a page view and a click as a search;
# from it on as a removal from the cart and as browsing a category.
BIG_EVENT = 10.0

NEW_ARRIVAL_SIZE = 5

EVENTS = (
    "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
)
PART = (
    "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE"
)
CUSTOMER = (
    "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"
)
ORDERS = (
    "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,"
    " o_orderdate TIMESTAMP, o_orderpriority STRING"
)
LINEITEM = (
    "l_orderkey BIGINT, l_partkey BIGINT, l_linenumber INT, l_quantity DOUBLE,"
    " l_extendedprice DOUBLE, l_returnflag STRING"
)
NATION = "n_nationkey INT, n_name STRING, n_regionkey INT"
REGION = "r_regionkey INT, r_name STRING"
EMBEDDINGS = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"


def read(spark: SparkSession, sf_dir: str, table: str, schema: str) -> DataFrame:
    """A sample table. Times are stored as UTC wall clock, so the session reads UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.schema(schema).parquet(f"{sf_dir}/{table}.parquet")


def _category(position: str) -> str:
    names = ", ".join(f"'{name}'" for name in CATEGORIES)
    return f"element_at(array({names}), cast(pmod({position}, {len(CATEGORIES)}) + 1 AS int))"


def clicks_from_events(events: DataFrame) -> DataFrame:
    """Events as clicks; works on a batch or on a stream."""
    kind = f"""CASE event_type
        WHEN 'purchase' THEN 'add_to_cart'
        WHEN 'signup' THEN 'wishlist_add'
        WHEN 'view' THEN 'product_view'
        WHEN 'click' THEN if(value >= {BIG_EVENT}, 'category_browse', 'search')
        ELSE if(value >= {BIG_EVENT}, 'remove_from_cart', 'page_view') END"""
    typed = events.selectExpr(
        "event_id",
        "user_id AS customer_id",
        "concat_ws('-', user_id, date_format(ts, 'yyyyMMdd')) AS session_id",
        "ts AS event_timestamp",
        f"{kind} AS event_type",
        "cast(get_json_object(props, '$.k') AS bigint) AS key",
        "CASE WHEN value < 2 THEN 'mobile' WHEN value < 20 THEN 'desktop' ELSE 'tablet' END AS device_type",
        "cast(floor(value) AS int) AS time_on_page_seconds",
    )
    return typed.selectExpr(
        "event_id",
        "customer_id",
        "session_id",
        "event_timestamp",
        "event_type",
        "concat('/', event_type, '/', key) AS page_url",
        "CASE WHEN event_type NOT IN ('page_view', 'category_browse') THEN key END AS product_id",
        f"CASE WHEN event_type = 'category_browse' THEN {_category('key')} END AS category_browsed",
        f"CASE WHEN event_type = 'search' THEN concat({_category('key')}, ' item ', key) END AS search_term",
        "device_type",
        "'direct' AS referrer",
        "time_on_page_seconds",
    )


def clickstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clicks_from_events(read(spark, sf_dir, "events", EVENTS))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part", PART).selectExpr(
        "p_partkey AS product_id",
        "p_name AS product_name",
        "p_type AS category",
        "split_part(p_name, ' ', 2) AS subcategory",
        "p_brand AS brand",
        "p_retailprice AS price",
        "concat('A ', p_name, ' in ', p_type, ' style by ', p_brand) AS description",
        "to_json(array(split_part(p_name, ' ', 1), if(p_size < 25, 'compact', 'roomy'))) AS style_tags",
        "split_part(p_name, ' ', 1) AS color",
        "to_json(array(cast(p_size AS string))) AS sizes_available",
        "cast(3 + cast(p_size % 41 AS decimal(3,0)) * 0.05BD AS double) AS rating",
        "p_size AS review_count",
        f"timestamp'{AS_OF}' - make_dt_interval(p_size) AS created_at",
        f"p_size <= {NEW_ARRIVAL_SIZE} AS is_new_arrival",
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read(spark, sf_dir, "customer", CUSTOMER)
    nation = read(spark, sf_dir, "nation", NATION)
    region = read(spark, sf_dir, "region", REGION)
    placed = customer.join(nation, F.expr("c_nationkey = n_nationkey"), "left").join(
        region, F.expr("n_regionkey = r_regionkey"), "left"
    )
    tiers = " ".join(f"WHEN '{market}' THEN '{tier}'" for market, tier in TIERS.items())
    liked = ", ".join(_category(f"c_nationkey + {step}") for step in (0, 2, 3))
    return placed.selectExpr(
        "c_custkey AS customer_id",
        "split_part(c_name, '#', 1) AS first_name",
        "split_part(c_name, '#', 2) AS last_name",
        "concat(split_part(c_name, '#', 2), '@example.com') AS email",
        f"CASE c_mktsegment {tiers} ELSE 'Bronze' END AS loyalty_tier",
        "cast(floor(greatest(c_acctbal, 0D) * 5) AS int) AS loyalty_points",
        f"to_json(array({liked})) AS preferred_categories",
        "n_name AS city",
        "r_name AS state",
        "c_acctbal AS lifetime_value",
        "cast(floor(greatest(c_acctbal, 0D) / 100) AS int) AS total_orders",
        "right(c_name, 4) AS credit_card_last4",
    )


SHIFTED_ORDER_DATE = f"o_orderdate + INTERVAL '{ORDER_SHIFT_DAYS}' DAY"


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders", ORDERS)
    lines = read(spark, sf_dir, "lineitem", LINEITEM)
    # Shuffled: orders grow, and their files are a fraction of what a broadcast holds.
    return lines.join(orders.hint("merge"), F.expr("l_orderkey = o_orderkey")).selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber) AS transaction_id",
        "o_custkey AS customer_id",
        "l_partkey AS product_id",
        f"{SHIFTED_ORDER_DATE} AS purchase_date",
        "cast(l_quantity AS int) AS quantity",
        "try_divide(l_extendedprice, l_quantity) AS unit_price",
        "l_extendedprice AS total_amount",
        "l_returnflag AS payment_method",
        "o_orderpriority AS channel",
    )


def points_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points earned per order, and spent, granted or expired on some of them."""
    earned = """named_struct('id', o_orderkey * 2, 'event_type', 'earn',
        'points', cast(floor(o_totalprice / 100) AS int))"""
    other = """CASE o_orderpriority
        WHEN '1-URGENT' THEN named_struct('id', o_orderkey * 2 + 1, 'event_type', 'redeem',
            'points', cast(-floor(o_totalprice / 400) AS int))
        WHEN '2-HIGH' THEN named_struct('id', o_orderkey * 2 + 1, 'event_type', 'bonus', 'points', 500)
        WHEN '5-LOW' THEN named_struct('id', o_orderkey * 2 + 1, 'event_type', 'expire', 'points', -50)
        END"""
    return read(spark, sf_dir, "orders", ORDERS).selectExpr(
        "o_custkey AS customer_id",
        "concat('order ', o_orderkey) AS reference_id",
        f"{SHIFTED_ORDER_DATE} AS created_at",
        f"inline(array_compact(array({earned}, {other})))",
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings", EMBEDDINGS)
