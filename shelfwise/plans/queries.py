"""The registered queries: every operator over the whole sample tables.

Each takes ``(spark, sf_dir)`` and returns a DataFrame with plain columns: decimals
as doubles, arrays and maps as text, so that results compare across engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from decimal import Decimal
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions import rules
from shelfwise.operators import (
    co_purchase,
    intent as intents,
    loyalty,
    metrics,
    offers as offering,
    portal,
    quality,
    recommend,
    similarity,
    state,
    text_index,
)
from shelfwise.operators.enrich import CLICK_RULES, EVENT_DAY, enrich_clicks, with_event_day
from shelfwise.plans.medallion import (
    CLICKSTREAM_FILE,
    CUSTOMERS_FILE,
    PRODUCTS_FILE,
    PURCHASES_FILE,
    Bronze,
    Medallion,
    open_layers,
    publish,
    read_bronze,
    refresh,
)
from shelfwise.operators.skew import heavy_hitters
from shelfwise.plans.recommendations import Recommendations
from shelfwise.sources import files, sample_tables
from shelfwise.sources.sample_tables import AS_OF
from shelfwise.sources.scratch import cut_lineage, scratch_path
from shelfwise.sources.tables import append_rows, read_upserted, replace_snapshot, upsert
from shelfwise.streaming import clicks as streams
from shelfwise.streaming.keyed_state import (
    keyed_state,
    live_sessions,
    points_with_openings,
    post_openings,
    read_sessions,
    store_sessions,
)
from shelfwise.streaming.runs import run_batches, run_to_files, run_updates
from shelfwise.streaming.state import SCORE_KEYS, SCORE_NEWEST, upsert_scores

Query = Callable[[SparkSession, str], DataFrame]

PROFILE_DEFAULTS = ("PROMO", "SMALL")
LAPSED_CATEGORY = "PROMO"
STREAM_DELAY = "1 hour"
VECTOR_LENGTH = 64
LEAST_COSINE = Decimal("0.15")
REACH_WINDOWS = (("2024-01-01", "2024-01-30"), ("2024-01-24", "2024-01-30"))


class SampleBronze:
    """The retail tables of one sample folder, each opened when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    @cached_property
    def clicks(self) -> DataFrame:
        return sample_tables.clickstream(self.spark, self.sf_dir)

    @cached_property
    def products(self) -> DataFrame:
        return sample_tables.products(self.spark, self.sf_dir)

    @cached_property
    def customers(self) -> DataFrame:
        return sample_tables.customers(self.spark, self.sf_dir)

    @cached_property
    def purchases(self) -> DataFrame:
        return sample_tables.purchases(self.spark, self.sf_dir)


class Samples(Medallion):
    """All layers over one sample folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(SampleBronze(spark, sf_dir), AS_OF)
        self.spark = spark
        self.sf_dir = sf_dir

    @property
    def clicks(self) -> DataFrame:
        return self.bronze.clicks

    @property
    def products(self) -> DataFrame:
        return self.bronze.products

    @property
    def customers(self) -> DataFrame:
        return self.bronze.customers

    @property
    def purchases(self) -> DataFrame:
        return self.bronze.purchases

    @cached_property
    def interests(self) -> DataFrame:
        return recommend.top_interests(self.intent, self.golden)

    @cached_property
    def offers(self) -> DataFrame:
        return offering.offers(self.segments, self.intent, AS_OF)

    def click_stream(self) -> DataFrame:
        # The pattern matches one file or a folder of that name; a plain path would
        # have to be a folder.
        path = f"{self.sf_dir}/event[s].parquet"
        raw = streams.read_click_stream(self.spark, path, sample_tables.EVENTS, "parquet")
        return sample_tables.clicks_from_events(raw)


def plain(df: DataFrame) -> DataFrame:
    decimals = {f.name: F.col(f.name).cast("double") for f in df.schema if isinstance(f.dataType, T.DecimalType)}
    return df.withColumns(decimals) if decimals else df


def joined_text(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), ",")


def _search_terms(s: Samples) -> DataFrame:
    terms = s.clicks.where(F.col("search_term").isNotNull()).select("search_term").distinct()
    return terms.select(
        F.col("search_term").alias("query_id"), F.col("search_term").alias("text"), F.lit(None).cast("string").alias("category")
    )


@contextmanager
def scratch_database(spark: SparkSession) -> Iterator[str]:
    """A database that is gone afterwards."""
    database = f"shelfwise_{uuid.uuid4().hex}"
    spark.sql("CREATE DATABASE IDENTIFIER(:name)", {"name": database})
    try:
        yield database
    finally:
        spark.sql("DROP DATABASE IDENTIFIER(:name) CASCADE", {"name": database})


REGISTRY: dict[str, Query] = {}


def query(function: Callable[[Samples], DataFrame]) -> Callable[[Samples], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(function(Samples(spark, sf_dir)))

    run.__name__ = function.__name__
    run.__doc__ = function.__doc__
    REGISTRY[function.__name__] = run
    return function


# Layers


@query
def enriched_clicks(s: Samples) -> DataFrame:
    return s.enriched.select(
        "event_id",
        "customer_id",
        "session_id",
        "event_timestamp",
        "event_type",
        "product_id",
        "product_name",
        "product_subcategory",
        "product_brand",
        "product_price",
        "product_style_tags",
        "category_browsed",
        "resolved_category",
    )


@query
def rule_violations(s: Samples) -> DataFrame:
    more = {"has_product": "product_id IS NOT NULL", "long_visit": "time_on_page_seconds >= 5"}
    return quality.rule_violations(s.clicks, {**CLICK_RULES, **more})


@query
def masked_customers(s: Samples) -> DataFrame:
    return quality.mask_pii(s.customers, marketer=True)


@query
def golden_record(s: Samples) -> DataFrame:
    return s.golden


@query
def churn_bands(s: Samples) -> DataFrame:
    return metrics.churn_bands(s.golden)


@query
def scored_events(s: Samples) -> DataFrame:
    scored = intents.score_events(intents.recent_events(s.enriched, AS_OF), AS_OF)
    return scored.select(
        "event_id", "resolved_category", "intent_weight", "recency_multiplier", "weighted_score"
    )


@query
def category_intent(s: Samples) -> DataFrame:
    return s.intent


@query
def category_intent_rolling(s: Samples) -> DataFrame:
    noon = "2024-01-30 12:00:00"
    return intents.category_intent(s.enriched, noon, window="rolling", until_now=True)


@query
def engagement(s: Samples) -> DataFrame:
    return intents.engagement(s.intent)


@query
def segments(s: Samples) -> DataFrame:
    return s.segments


@query
def segment_counts(s: Samples) -> DataFrame:
    return metrics.segment_counts(s.segments)


@query
def published_segments(s: Samples) -> DataFrame:
    """Every layer published as a table, then the segments read back by name."""
    with scratch_database(s.spark) as database:
        publish(s.bronze, database, AS_OF)
        return cut_lineage(open_layers(s.spark, database, AS_OF).segments, "segments")


@query
def refreshed_segments(s: Samples) -> DataFrame:
    """The layers published without the last day's clicks, then brought up to date."""
    earlier = s.clicks.where(F.col("event_timestamp") < F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 1 DAY"))
    with scratch_database(s.spark) as database:
        publish(Bronze(earlier, s.products, s.customers, s.purchases), database, AS_OF)
        refresh(s.bronze, database, AS_OF)
        return cut_lineage(open_layers(s.spark, database, AS_OF).segments, "segments")


@query
def click_days(s: Samples) -> DataFrame:
    """Rows of each published day, of the raw and of the enriched clicks."""
    with scratch_database(s.spark) as database:
        layers = publish(s.bronze, database, AS_OF)
        raw = layers.bronze.clicks.groupBy(EVENT_DAY).agg(F.count("*").alias("raw_rows"))
        clean = layers.enriched.groupBy(EVENT_DAY).agg(F.count("*").alias("enriched_rows"))
        return cut_lineage(raw.join(clean, EVENT_DAY, "left"), "days")


@query
def observed_rules(s: Samples) -> DataFrame:
    """Rows and broken rules counted while the clicks are enriched and stored."""
    seen = Observation("click_rules")
    enriched = enrich_clicks(s.clicks, s.products, seen)
    enriched.write.parquet(scratch_path(s.spark, "enriched"))
    counts = seen.get
    rows = [(counts["rows"], rule, counts[rule]) for rule in CLICK_RULES]
    return s.spark.createDataFrame(rows, "rows long, rule string, violations long")


# Marketing metrics


@query
def recent_interest(s: Samples) -> DataFrame:
    return metrics.recent_interest(s.intent)


@query
def high_ltv(s: Samples) -> DataFrame:
    return metrics.high_ltv(s.segments).select("customer_id", "lifetime_value", "segment")


@query
def top_fraction(s: Samples) -> DataFrame:
    s.settle("segments")
    return metrics.top_fraction(s.segments).select("ltv_rank", "customer_id", "lifetime_value", "segment")


@query
def category_reach(s: Samples) -> DataFrame:
    """Customers per category in two windows, from one set of stored daily sketches."""
    enriched = with_event_day(s.enriched)
    sketches = cut_lineage(metrics.daily_reach(enriched), "reach")
    found = None
    for first, last in REACH_WINDOWS:
        estimated = metrics.reach_between(sketches, first, last)
        seen = enriched.where(F.col(EVENT_DAY).between(first, last) & F.col("resolved_category").isNotNull())
        exact = seen.groupBy("resolved_category").agg(F.count_distinct("customer_id").alias("customers"))
        both = exact.join(estimated, "resolved_category").withColumn("first_day", F.lit(first))
        found = both if found is None else found.unionByName(both)
    near = F.abs(F.col("customers") - F.col("about")) <= 0.05 * F.col("customers")
    return found.select("first_day", "resolved_category", "customers", near.alias("within_5_percent"))


@query
def vip(s: Samples) -> DataFrame:
    return metrics.vip(s.segments).select("customer_id", "loyalty_tier", "lifetime_value")


@query
def at_risk(s: Samples) -> DataFrame:
    return metrics.at_risk(s.segments).select("customer_id", "churn_risk", "segment", "days_since_last_purchase")


@query
def lapsed_browsers(s: Samples) -> DataFrame:
    return metrics.lapsed_browsers(s.segments, s.intent, LAPSED_CATEGORY)


@query
def add_to_cart_rate(s: Samples) -> DataFrame:
    return metrics.add_to_cart_rate(s.enriched)


@query
def trending(s: Samples) -> DataFrame:
    return metrics.trending(s.intent)


@query
def best_sellers(s: Samples) -> DataFrame:
    return metrics.best_sellers(s.purchases, s.products)


@query
def session_summary(s: Samples) -> DataFrame:
    return metrics.session_summary(s.enriched)


# Recommendations


@query
def top_interests(s: Samples) -> DataFrame:
    return s.interests


@query
def ranked_products(s: Samples) -> DataFrame:
    return recommend.ranked_products(s.products)


@query
def content_scores(s: Samples) -> DataFrame:
    return recommend.content_scores(s.interests, s.products)


@query
def recommendation_shelf(s: Samples) -> DataFrame:
    shelf = recommend.recommendation_shelf(recommend.content_scores(s.interests, s.products))
    return shelf.select("customer_id", "slot", "product_id", "score", "price_text", "match_text")


@query
def trending_scores(s: Samples) -> DataFrame:
    s.settle("intent")
    return recommend.trending_scores(s.interests, s.intent, s.products)


@query
def last_purchase_companions(s: Samples) -> DataFrame:
    baskets = cut_lineage(recommend.purchase_baskets(s.purchases), "baskets")
    return recommend.last_purchase_companions(baskets)


@query
def co_purchase_pairs(s: Samples) -> DataFrame:
    """All pairs of products whose buyers' cosine is at least 0.15."""
    return co_purchase.co_purchase_pairs(s.purchases, LEAST_COSINE)


@query
def collaborative_scores(s: Samples) -> DataFrame:
    return recommend.collaborative_scores(s.purchases, s.products)


@query
def similar_text(s: Samples) -> DataFrame:
    found = similarity.similar_by_text(s.products, "roomy blue widget in promo style", k=20)
    return found.select("product_id", "product_name", "category", "similarity")


@query
def similar_text_filtered(s: Samples) -> DataFrame:
    filters = {"is_new_arrival": True, "category": "PROMO"}
    found = similarity.similar_by_text(s.products, "small red bolt", k=20, filters=filters)
    return found.select("product_id", "product_name", "category", "similarity")


@query
def indexed_text(s: Samples) -> DataFrame:
    """The first of the text searches from the stored index."""
    found = text_index.find_products(s.text_index, s.products, "roomy blue widget in promo style", 20)
    return found.select("product_id", "product_name", "category", "similarity")


@query
def indexed_text_filtered(s: Samples) -> DataFrame:
    filters = {"is_new_arrival": True, "category": "PROMO"}
    found = text_index.find_products(s.text_index, s.products, "small red bolt", 20, filters)
    return found.select("product_id", "product_name", "category", "similarity")


@query
def indexed_hits(s: Samples) -> DataFrame:
    """Every search term of the clicks, asked from the stored index."""
    hits = text_index.search(s.text_index, _search_terms(s), 5).drop("category")
    return similarity.with_hit_columns(hits, s.products)


@query
def one_customer_style(s: Samples) -> DataFrame:
    """Style recommendations of the customer with the smallest id."""
    first = s.customers.agg(F.min("customer_id")).first()[0]
    listed = joined_text(F.col("products.product_id")).alias("product_ids")
    return Recommendations(s, AS_OF).style(first).select("customer_id", "interest_rank", "category", listed)


@query
def style_hits(s: Samples) -> DataFrame:
    return similarity.style_hits(s.products).select("category", "hit_rank", "product_id", "similarity")


@query
def style_recommendations(s: Samples) -> DataFrame:
    basket = recommend.style_basket(s.interests, similarity.style_hits(s.products))
    listed = joined_text(F.col("products.product_id"))
    return basket.select("customer_id", "interest_rank", "category", listed.alias("product_ids"))


@query
def vibe_scores(s: Samples) -> DataFrame:
    return recommend.vibe_scores(s.interests, similarity.style_hits(s.products))


@query
def similar_vectors(s: Samples) -> DataFrame:
    vectors = sample_tables.embeddings(s.spark, s.sf_dir)
    found = similarity.nearest_vectors(vectors, similarity.label_centroids(vectors))
    return found.select("label", "hit_rank", "vec_id")


@query
def search_hits(s: Samples) -> DataFrame:
    """Products for every search term of the clicks, each term asked once."""
    return similarity.search_text(s.products, _search_terms(s), k=5)


@query
def vector_hits(s: Samples) -> DataFrame:
    """The products whose vectors are nearest to one vector, with all hit columns."""
    vectors = sample_tables.embeddings(s.spark, s.sf_dir)
    asked = [1.0 if i % 3 else -0.5 for i in range(VECTOR_LENGTH)]
    return similarity.with_products(similarity.nearest_to(vectors, asked, 20), s.products).select(
        "vec_id", "label", *similarity.HIT_COLUMNS
    )


@query
def one_customer(s: Samples) -> DataFrame:
    """Content scores of the customer with the smallest id, best first."""
    first = s.customers.agg(F.min("customer_id")).first()[0]
    scores = Recommendations(s, AS_OF).content_scores(first)
    return scores.select("customer_id", "product_id", "category", "score", "reasoning")


@query
def recommendation_scores(s: Samples) -> DataFrame:
    s.settle("intent")
    return Recommendations(s, AS_OF).scores().select(
        "customer_id", "product_id", "score", "score_type", "computed_at"
    )


# Loyalty, offers and the portal


@query
def tier_progress(s: Samples) -> DataFrame:
    return loyalty.tier_progress(s.customers)


@query
def ledger_balance(s: Samples) -> DataFrame:
    return loyalty.ledger_balance(sample_tables.points_events(s.spark, s.sf_dir))


@query
def current_balance(s: Samples) -> DataFrame:
    return loyalty.current_balance(sample_tables.points_events(s.spark, s.sf_dir))


def _offer_columns(df: DataFrame, *more: str) -> DataFrame:
    return df.select(
        "customer_id",
        "slot",
        "offer_code",
        "product_name",
        "category",
        "relevance_score",
        "offer_type",
        "offer_value",
        "reason",
        "expires_at",
        *more,
    )


@query
def offers(s: Samples) -> DataFrame:
    s.settle("intent")
    return _offer_columns(s.offers)


@query
def offers_with_products(s: Samples) -> DataFrame:
    """Category offers that name the best product of their category."""
    s.settle("intent")
    named = offering.offers(s.segments, s.intent, AS_OF, recommend.ranked_products(s.products))
    return named.select("customer_id", "slot", "category", "product_id")


@query
def winback_offers(s: Samples) -> DataFrame:
    return _offer_columns(offering.winback_offers(s.segments, AS_OF))


@query
def live_offers(s: Samples) -> DataFrame:
    """The basket 30 hours on, appended to a table in two writes and read back."""
    s.settle("intent", "segments")
    path = scratch_path(s.spark, "offers")
    append_rows(offering.winback_offers(s.segments, AS_OF), path)
    append_rows(offering.category_offers(s.segments, s.intent, AS_OF), path)
    stored = s.spark.read.parquet(path)
    return _offer_columns(offering.live_offers(stored, "2024-02-01 06:00:00"), "offer_rank")


@query
def interest_profile(s: Samples) -> DataFrame:
    s.settle("intent")
    return portal.interest_profile(s.segments, s.intent, PROFILE_DEFAULTS)


@query
def session_feed(s: Samples) -> DataFrame:
    return portal.session_feed(s.clicks, s.products, AS_OF)


@query
def profile_context(s: Samples) -> DataFrame:
    return portal.profile_context(s.segments)


# Serving tables


@query
def active_sessions(s: Samples) -> DataFrame:
    entry = F.transform(
        F.map_entries("session_intent"),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("decimal(18,2)").cast("string")),
    )
    return state.active_sessions(s.enriched).select(
        "session_id",
        "customer_id",
        "started_at",
        "last_activity_at",
        "device_type",
        "current_page",
        joined_text(F.col("categories_viewed")).alias("categories_viewed"),
        joined_text(F.col("products_viewed")).alias("products_viewed"),
        joined_text(F.col("cart_items")).alias("cart_items"),
        F.array_join(entry, ",").alias("session_intent"),
    )


@query
def customer_state(s: Samples) -> DataFrame:
    s.settle("intent", "segments")
    open_offers = offering.offer_expiries(s.segments, AS_OF)
    return state.customer_state(s.segments, s.intent, open_offers, s.clicks, AS_OF)


@query
def customer_snapshot(s: Samples) -> DataFrame:
    """The state of an earlier day replaced by today's, then read back."""
    s.settle("intent", "segments")
    path = scratch_path(s.spark, "customer-state")
    for day in ("2024-01-30 00:00:00", AS_OF):
        open_offers = offering.offer_expiries(s.segments, AS_OF)
        replace_snapshot(state.customer_state(s.segments, s.intent, open_offers, s.clicks, day), path)
    return s.spark.read.parquet(path).select("customer_id", "segment", "top_category", "updated_at")


def _event_scores(clicks: DataFrame) -> DataFrame:
    weight = rules.event_weight(F.col("event_type")).cast("double")
    return clicks.where(F.col("product_id").isNotNull()).select(
        "customer_id",
        "product_id",
        weight.alias("score"),
        F.lit("content_based").alias("score_type"),
        F.col("event_type").alias("reasoning"),
        F.col("event_timestamp").alias("computed_at"),
    )


@query
def score_upsert(s: Samples) -> DataFrame:
    """Two merges into one score table; the latest row per key stays."""
    path = scratch_path(s.spark, "scores")
    scores = _event_scores(s.clicks)
    viewed = F.col("reasoning") == "product_view"
    upsert(scores.where(viewed), path, SCORE_KEYS, SCORE_NEWEST, 0)
    upsert(scores.where(~viewed), path, SCORE_KEYS, SCORE_NEWEST, 1)
    return read_upserted(s.spark, path, SCORE_KEYS, SCORE_NEWEST)


# CSV in and out


@query
def products_csv(s: Samples) -> DataFrame:
    """The catalogue written as CSV and read back."""
    path = scratch_path(s.spark, "csv")
    files.write_csv(s.products, path)
    return files.read_products(s.spark, path)


@query
def segments_from_csv(s: Samples) -> DataFrame:
    """All four inputs written as CSV, then every layer from those files."""
    folder = scratch_path(s.spark, "csv")
    bronze = s.bronze
    nothing = F.lit(None).cast("string")
    # The files carry more profile columns than the samples have; order counts in CSV.
    customers = bronze.customers.select(
        "customer_id",
        "first_name",
        "last_name",
        "email",
        nothing.alias("age"),
        nothing.alias("gender"),
        "loyalty_tier",
        "loyalty_points",
        nothing.alias("signup_date"),
        nothing.alias("last_purchase_date"),
        "preferred_categories",
        nothing.alias("preferred_brands"),
        "city",
        "state",
        "lifetime_value",
        "total_orders",
        "credit_card_last4",
        nothing.alias("phone_masked"),
    )
    files.write_csv(bronze.clicks, f"{folder}/{CLICKSTREAM_FILE}")
    files.write_csv(bronze.products, f"{folder}/{PRODUCTS_FILE}")
    files.write_csv(customers, f"{folder}/{CUSTOMERS_FILE}")
    files.write_csv(bronze.purchases, f"{folder}/{PURCHASES_FILE}")
    return Medallion(read_bronze(s.spark, folder), AS_OF).segments


# Streams, run until the sample events are used up


@query
def stream_enriched(s: Samples) -> DataFrame:
    rows = enrich_clicks(s.click_stream(), s.products).select(
        "event_id", "customer_id", "event_timestamp", "event_type", "product_id", "resolved_category"
    )
    return run_to_files(rows, scratch_path(s.spark, "enriched"), scratch_path(s.spark, "stream"))


@query
def stream_dedupe(s: Samples) -> DataFrame:
    """Every event arrives twice; one of each stays."""
    twice = s.click_stream().unionByName(s.click_stream())
    rows = streams.dedupe_events(twice, STREAM_DELAY).select("event_id", "customer_id", "event_type")
    return run_to_files(rows, scratch_path(s.spark, "deduped"), scratch_path(s.spark, "stream"))


def _stream_buckets(s: Samples, width: str, slide: str | None = None) -> DataFrame:
    hot = heavy_hitters(s.clicks, "product_id")
    enriched = enrich_clicks(s.click_stream(), s.products, hot_products=hot)
    buckets = streams.intent_buckets(enriched, width, slide, STREAM_DELAY)
    keys = ["bucket_start", "customer_id", "resolved_category"]
    return run_updates(buckets, scratch_path(s.spark, "buckets"), scratch_path(s.spark, "stream"), keys)


@query
def stream_intent_buckets(s: Samples) -> DataFrame:
    return _stream_buckets(s, "1 hour")


@query
def stream_intent_sliding(s: Samples) -> DataFrame:
    return _stream_buckets(s, "6 hours", "2 hours").drop("latest_interaction")


@query
def stream_intent(s: Samples) -> DataFrame:
    """Ranked intent read from stored hourly buckets."""
    return streams.intent_from_buckets(_stream_buckets(s, "1 hour"), AS_OF)


@query
def stream_intent_half_past(s: Samples) -> DataFrame:
    """The same inside an hour: the buckets that a step cuts are scored by their clicks."""
    return streams.intent_from_buckets(_stream_buckets(s, "1 hour"), "2024-01-30 12:30:00", s.enriched)


def _session_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "customer_id",
        "started_at",
        "last_activity_at",
        "events",
        "score",
        joined_text(F.col("categories_viewed")).alias("categories_viewed"),
        joined_text(F.col("products_viewed")).alias("products_viewed"),
        joined_text(F.col("cart_items")).alias("cart_items"),
    )


@query
def stream_sessions(s: Samples) -> DataFrame:
    """Sessions that the stream has closed, and those still open in the stored clicks."""
    sessions = streams.stream_sessions(enrich_clicks(s.click_stream(), s.products), "6 hours", STREAM_DELAY)
    closed = run_to_files(sessions, scratch_path(s.spark, "sessions"), scratch_path(s.spark, "stream"))
    return _session_columns(closed.unionByName(streams.open_sessions(s.enriched, closed, "6 hours")))


@query
def stream_live_sessions(s: Samples) -> DataFrame:
    """The same sessions from keyed state, open ones included; no stored click is read."""
    path = scratch_path(s.spark, "sessions")
    sessions = live_sessions(enrich_clicks(s.click_stream(), s.products), 360, STREAM_DELAY)
    with keyed_state(s.spark):
        run_batches(sessions, store_sessions(path), scratch_path(s.spark, "stream"), "update")
    return _session_columns(read_sessions(s.spark, path))


@query
def stream_ledger(s: Samples) -> DataFrame:
    """Points for events as they stream in, with the balance after each."""
    clicks = s.click_stream()
    points = F.when(F.col("event_type") == "add_to_cart", 30).when(
        F.col("event_type") == "remove_from_cart", -10
    ).otherwise(1)
    events = clicks.select(
        F.col("event_id").alias("id"),
        "customer_id",
        "event_type",
        points.alias("points"),
        F.col("event_timestamp").alias("created_at"),
    )
    ledger, balances = scratch_path(s.spark, "ledger"), scratch_path(s.spark, "balances")
    with keyed_state(s.spark):
        posted = post_openings(ledger, balances)
        run_batches(points_with_openings(events), posted, scratch_path(s.spark, "stream"), "update")
    return s.spark.read.parquet(ledger).drop("batch_id")


@query
def stream_score_upsert(s: Samples) -> DataFrame:
    path = scratch_path(s.spark, "scores")
    run_batches(_event_scores(s.click_stream()), upsert_scores(path), scratch_path(s.spark, "stream"))
    return read_upserted(s.spark, path, SCORE_KEYS, SCORE_NEWEST)
