"""Hot products, sketches of customers and the bound on the top share."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfwise.functions.clock import instant
from shelfwise.operators import intent as intents
from shelfwise.operators import metrics, ordering, skew
from shelfwise.operators.enrich import enrich_clicks, with_event_day
from tests import fixtures as fx

SHOP = [{"product_id": f"P{i}", "product_name": f"N{i}", "category": "Denim"} for i in range(50)]


@pytest.fixture(scope="module")
def hot_clicks(spark, tmp_path_factory):
    """A third of the clicks on one product, a third without one."""
    path = str(tmp_path_factory.mktemp("hot") / "clicks")
    number = F.col("id") % 3
    product = F.when(number == 0, "P7").when(number == 1, F.concat(F.lit("P"), (F.col("id") % 50).cast("string")))
    spark.range(9000).select(
        F.col("id").cast("string").alias("event_id"),
        F.lit("C1").alias("customer_id"),
        F.lit("2026-03-05 06:00:00").alias("event_timestamp"),
        product.alias("product_id"),
        F.lit(None).cast("string").alias("category_browsed"),
    ).write.parquet(path)
    return spark.read.parquet(path)


def test_heavy_hitters(hot_clicks, spark):
    assert skew.heavy_hitters(hot_clicks, "product_id", 0.1) == ["P7"]
    assert skew.heavy_hitters(hot_clicks.limit(0), "product_id") == []
    assert skew.heavy_hitters(hot_clicks.where("product_id is null"), "product_id") == []


@pytest.mark.parametrize("streaming", [False, True])
def test_a_hot_product_runs_in_equal_shares(spark, hot_clicks, tmp_path, streaming):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
    }
    old = {k: spark.conf.get(k) for k in settings}
    products = fx.products(spark, SHOP)
    hot = skew.heavy_hitters(hot_clicks, "product_id")
    assert "P7" in hot
    sizes: list[int] = []

    def count(df, _=0):
        sizes.extend(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())

    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        if streaming:
            path = hot_clicks.inputFiles()[0].rsplit("/", 1)[0]
            stream = spark.readStream.schema(hot_clicks.schema).parquet(path)
            joined = enrich_clicks(stream, products, hot_products=hot)
            writer = joined.writeStream.foreachBatch(count).option("checkpointLocation", str(tmp_path))
            writer.trigger(availableNow=True).start().awaitTermination()
        else:
            count(enrich_clicks(hot_clicks, products, hot_products=hot))
        plain = enrich_clicks(hot_clicks, products)
        salted = enrich_clicks(hot_clicks, products, hot_products=hot)
        assert salted.columns == plain.columns
        assert salted.exceptAll(plain).count() == 0 and salted.count() == plain.count() == 9000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 9000
    assert max(sizes) < 2 * 9000 / 8


def test_top_share_leaves_out_what_cannot_be_in_it(spark):
    rows = spark.range(5000).select(
        F.col("id"), F.when(F.col("id") % 7 > 0, (F.col("id") * 7919 % 1000).cast("double")).alias("value")
    )
    order = [F.desc("value"), F.col("id")]
    for share in ("0.10", "0.5", "0.95", "0", "1"):
        limit = F.lit(share).cast("decimal(4,2)")
        plain = ordering.top_share(rows, rows, limit, order)
        quick = ordering.top_share(rows, rows, limit, order, by="value")
        assert sorted(quick.collect()) == sorted(plain.collect())
    assert ordering._likely_top(rows, "value", 500).count() < 900
    assert ordering.top_share(rows.limit(0), rows.limit(0), F.lit("0.10").cast("decimal(4,2)"), order, by="value").count() == 0


def test_reach_of_any_window_from_daily_sketches(spark):
    clicks = spark.range(20_000).select(
        F.concat(F.lit("C"), (F.col("id") * 31 % 6000).cast("string")).alias("customer_id"),
        F.timestamp_seconds(1772668800 + F.col("id") * 20).alias("event_timestamp"),
        F.when(F.col("id") % 5 > 0, F.concat(F.lit("K"), (F.col("id") % 3).cast("string"))).alias("resolved_category"),
    )
    days = with_event_day(clicks)
    sketches = metrics.daily_reach(days).cache()
    for first, last in (("2026-03-05", "2026-03-09"), ("2026-03-06", "2026-03-06")):
        exact = Counter()
        chosen = days.where(F.col("event_day").between(first, last) & F.col("resolved_category").isNotNull())
        for r in chosen.groupBy("resolved_category").agg(F.count_distinct("customer_id").alias("n")).collect():
            exact[r.resolved_category] = r.n
        found = {r.resolved_category: r.about for r in metrics.reach_between(sketches, first, last).collect()}
        assert found.keys() == exact.keys()
        assert all(abs(found[k] - n) <= 0.04 * n for k, n in exact.items())


def test_the_clock_stands_in_for_a_missing_moment(spark):
    now = instant(None)
    clicks = spark.range(6).select(
        F.lit("C1").alias("customer_id"),
        F.lit("product_view").alias("event_type"),
        F.lit("Denim").alias("resolved_category"),
        (now - F.make_dt_interval(hours=F.col("id").cast("int") * 20)).alias("event_timestamp"),
    )
    (row,) = intents.category_intent(clicks, window="rolling").collect()
    assert (row.event_count, float(row.intent_score)) == (3, 2.0 + 1.2 + 1.0)
    (again,) = intents.category_intent(clicks, spark.range(1).select(now).first()[0], window="rolling").collect()
    assert again.intent_score == row.intent_score
