"""Explicit schemas of the input and state tables, as DDL."""

from __future__ import annotations

PRODUCTS = (
    "product_id STRING, product_name STRING, category STRING, subcategory STRING, brand STRING,"
    " price DOUBLE, description STRING, style_tags STRING, color STRING, sizes_available STRING,"
    " rating DOUBLE, review_count INT, created_at TIMESTAMP, is_new_arrival BOOLEAN"
)

CUSTOMERS = (
    "customer_id STRING, first_name STRING, last_name STRING, email STRING, age INT, gender STRING,"
    " loyalty_tier STRING, loyalty_points INT, signup_date TIMESTAMP, last_purchase_date TIMESTAMP,"
    " preferred_categories STRING, preferred_brands STRING, city STRING, state STRING,"
    " lifetime_value DOUBLE, total_orders INT, credit_card_last4 STRING, phone_masked STRING"
)

PURCHASES = (
    "transaction_id STRING, customer_id STRING, product_id STRING, purchase_date TIMESTAMP,"
    " quantity INT, unit_price DOUBLE, total_amount DOUBLE, payment_method STRING, channel STRING"
)

# Raw event time stays text: the cleaning step parses it and drops what does not parse.
CLICKSTREAM = (
    "event_id STRING, customer_id STRING, session_id STRING, event_timestamp STRING,"
    " event_type STRING, page_url STRING, product_id STRING, category_browsed STRING,"
    " search_term STRING, device_type STRING, referrer STRING, time_on_page_seconds INT"
)

OFFERS = (
    "customer_id STRING, slot INT, offer_code STRING, product_id STRING, product_name STRING,"
    " category STRING, relevance_score DOUBLE, offer_type STRING, offer_value STRING, reason STRING,"
    " expires_at TIMESTAMP, is_active BOOLEAN, created_at TIMESTAMP, served_at TIMESTAMP,"
    " redeemed_at TIMESTAMP"
)

RECOMMENDATION_SCORES = (
    "customer_id STRING, product_id STRING, score DOUBLE, score_type STRING, reasoning STRING,"
    " computed_at TIMESTAMP"
)

POINTS_EVENTS = (
    "id BIGINT, customer_id STRING, event_type STRING, points INT, description STRING,"
    " reference_id STRING, created_at TIMESTAMP"
)
