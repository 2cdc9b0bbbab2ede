"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import portal, similarity
from shelfwise.operators.enrich import enrich_clicks
from shelfwise.plans.queries import REGISTRY, Samples
from shelfwise.plans.recommendations import Recommendations
from shelfwise.sources import sample_tables
from tests import fixtures as fx
from tests.conftest import DATA

SF_DIR = f"{DATA}/sf0.001"
QUERIES = REGISTRY


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """Plan as for tables too large to broadcast."""
    settings = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for setting in settings:
        spark.conf.set(setting, "-1")
    yield
    for setting in settings:
        spark.conf.unset(setting)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream")))
def test_no_cross_joins_and_no_python_workers(spark, no_broadcast, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas"):
        assert banned not in text


@pytest.mark.parametrize("name", ["collaborative_scores", "recommendation_scores"])
def test_companions_are_not_broadcast_by_the_size_of_their_files(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    sides = [line for line in text.splitlines() if "BroadcastHashJoin" in line]
    assert not [line for line in sides if "product_id" in line or "rank" in line]


def test_orders_and_the_catalogue_are_not_broadcast_by_the_size_of_their_files(spark):
    samples = Samples(spark, SF_DIR)
    for rows, key in ((samples.purchases, "o_orderkey"), (samples.enriched, "product_id")):
        joins = [line for line in plan(rows).splitlines() if "Join" in line]
        assert [line for line in joins if key in line and "SortMergeJoin" in line] == joins


@pytest.mark.parametrize("name", ["indexed_hits", "search_hits"])
def test_hits_meet_a_catalogue_that_is_not_broadcast(spark, name):
    joins = [line for line in plan(QUERIES[name](spark, SF_DIR)).splitlines() if "Join" in line]
    assert "SortMergeJoin [product_id" in joins[0]


@pytest.mark.parametrize("name", ["similar_text", "style_hits", "search_hits"])
def test_texts_are_dealt_out_before_their_words(spark, monkeypatch, name):
    """By their number: one task reads a small file, however many products it holds."""
    monkeypatch.setattr(similarity, "TEXTS", 10)
    products = sample_tables.products(spark, SF_DIR).count()
    text = plan(QUERIES[name](spark, SF_DIR))
    exploded = re.findall(r"Generate explode\(.*?FileScan", text, re.S)
    catalogue = [part for part in exploded if "p_name" in part or "product_id" in part]
    assert catalogue
    for part in catalogue:
        assert re.search(rf"hashpartitioning\(product_id#\w+, {products // 10 + 1}\), REPARTITION_BY_NUM", part)


# A plan may gather everything in one task only for one row per task or per slice.
SINGLE_TASK = {"top_fraction", "lapsed_browsers", "vip", "trending", "similar_text", "similar_text_filtered"}


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream")))
def test_windows_are_partitioned(spark, no_broadcast, name):
    windows = re.findall(r"Window \[.*?\], \[(.*?)\]", plan(QUERIES[name](spark, SF_DIR)))
    unpartitioned = [w for w in windows if not w or "ASC" in w.split(",")[0] or "DESC" in w.split(",")[0]]
    assert len(unpartitioned) <= (1 if name in SINGLE_TASK else 0)


def test_recent_filter_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["category_intent"](spark, SF_DIR))
    scan = next(line for line in text.splitlines() if "events.parquet" in line)
    assert "GreaterThanOrEqual(ts,2024-01-29 00:00:00.0)" in scan and "IsNotNull(user_id)" in scan
    products = next(line for line in text.splitlines() if "part.parquet" in line)
    assert "ReadSchema: struct<p_partkey:bigint,p_type:string>" in products


def test_unused_joins_are_not_planned(spark):
    text = plan(QUERIES["top_interests"](spark, SF_DIR))
    assert "lineitem.parquet" not in text


def test_one_customer_filters_the_scan(spark):
    interests = QUERIES["recent_interest"](spark, SF_DIR).where(F.col("customer_id") == 7)
    assert re.search(r"Filter .*user_id#\d+L? = 7\)", plan(interests))


def test_interests_of_one_customer_filter_both_inputs(spark):
    found = Recommendations(Samples(spark, SF_DIR)).top_interests(7)
    assert len(re.findall(r" Filter .*(?:user_id|c_custkey)#\d+L? = 7\)", plan(found))) == 2


def test_feed_is_cut_before_its_shuffle(spark):
    clicks = sample_tables.clickstream(spark, SF_DIR)
    feed = portal.session_feed(clicks, sample_tables.products(spark, SF_DIR))
    assert re.search(r"WindowGroupLimit .* 7, Partial", plan(feed))


def test_stored_sides_are_broadcast_by_size(spark):
    for name in ("content_scores", "similar_vectors"):
        assert "BroadcastHashJoin" in plan(QUERIES[name](spark, SF_DIR))
    # The interests go from their own join straight to the shelf.
    text = plan(QUERIES["content_scores"](spark, SF_DIR))
    assert "hashpartitioning(category" not in text


def test_a_hot_product_is_split(spark, no_broadcast):
    """A shuffled join whose one key holds most rows still runs as several tasks."""
    clicks = spark.range(200_000).select(
        F.format_string("E%012d", "id").alias("event_id"),
        F.lit("C1").alias("customer_id"),
        F.lit("2026-03-05 06:00:00").cast("timestamp").alias("event_timestamp"),
        F.when(F.col("id") % 10 < 7, "P1").otherwise(F.concat(F.lit("P"), "id")).alias("product_id"),
        F.lit(None).cast("string").alias("category_browsed"),
    )
    products = fx.products(spark, [{"product_id": f"P{i}", "category": "Denim"} for i in range(50)])
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    for setting, value in settings.items():
        spark.conf.set(setting, value)
    try:
        enriched = enrich_clicks(clicks.repartition(20), products)
        assert enriched.where("resolved_category = 'Denim'").count() == 140_000 + sum(
            1 for i in range(50) if i % 10 >= 7
        )
        rows = enriched.select("event_id", "resolved_category")
        rows.collect()
        assert "skew=true" in plan(rows)
    finally:
        for setting in settings:
            spark.conf.unset(setting)


def _scans(text: str, table: str) -> list[str]:
    return [line for line in text.splitlines() if f"{table}.parquet" in line and "FileScan" in line]


def test_filters_reach_the_scored_products(spark):
    scans = _scans(plan(QUERIES["similar_text_filtered"](spark, SF_DIR)), "part")
    assert sum("EqualTo(p_type,PROMO)" in scan for scan in scans) >= 2


def test_scores_of_all_customers_read_the_customers_once(spark):
    assert len(_scans(plan(QUERIES["recommendation_scores"](spark, SF_DIR)), "customer")) == 1


def test_counting_offers_needs_no_intent(spark):
    state_plan = plan(QUERIES["customer_state"](spark, SF_DIR))
    assert state_plan.count("Generate ") <= 2 and "relevance" not in state_plan
