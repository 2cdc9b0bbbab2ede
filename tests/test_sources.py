"""CSV, tables, upserts and the published layers."""

from __future__ import annotations

import csv

import pytest

from shelfwise.operators import recommend
from shelfwise.plans.medallion import (
    CLICKSTREAM_FILE,
    CUSTOMERS_FILE,
    PRODUCTS_FILE,
    PURCHASES_FILE,
    Bronze,
    open_layers,
    publish,
    read_bronze,
)
from shelfwise.plans.recommendations import Recommendations
from shelfwise.sources import files
from shelfwise.sources.scratch import scratch_path
from shelfwise.sources.tables import (
    append_rows,
    compact,
    latest_per_key,
    read_upserted,
    replace_snapshot,
    upsert,
)
from shelfwise.streaming.state import SCORE_KEYS, SCORE_NEWEST
from tests import fixtures as fx

TAGS = '["boho", "say ""hi""", "a,b"]'.replace('""', '\\"')


def _products(spark):
    return fx.products(
        spark,
        [
            {
                "product_id": "P1",
                "product_name": 'Jeans, "slim"',
                "category": "Denim",
                "price": 59.99,
                "style_tags": TAGS,
                "color": "Navy",
                "sizes_available": '["S", "M"]',
                "rating": 4.5,
                "review_count": 12,
                "created_at": fx.at("2026-03-01 08:00:00"),
                "is_new_arrival": True,
                "description": "Soft. Blue, wide",
            }
        ],
    )


def test_csv_round_trip_keeps_json_cells(spark, tmp_path):
    products = _products(spark)
    files.write_csv(products, str(tmp_path / "out"))
    back = files.read_products(spark, str(tmp_path / "out"))
    assert back.schema == products.schema
    assert back.collect() == products.collect()


def test_csv_with_doubled_quotes_does_not_shift_columns(spark, tmp_path):
    row = _products(spark).first().asDict()
    path = tmp_path / "products.csv"
    with open(path, "w", newline="") as out:
        writer = csv.DictWriter(out, fieldnames=list(row))
        writer.writeheader()
        writer.writerow({**row, "is_new_arrival": "True"})
    assert files.read_products(spark, str(path)).first().asDict() == row


def test_append_and_replace(spark, tmp_path):
    path = str(tmp_path / "rows")
    append_rows(spark.range(3), path)
    append_rows(spark.range(2), path)
    assert spark.read.parquet(path).count() == 5
    replace_snapshot(spark.range(1), path)
    assert spark.read.parquet(path).count() == 1


def _scores(spark, rows):
    full = [(c, p, s, k, "why", fx.at(f"2026-03-05 {h:02}:00:00")) for c, p, k, s, h in rows]
    return spark.createDataFrame(
        full,
        "customer_id string, product_id string, score double, score_type string, reasoning string,"
        " computed_at timestamp",
    )


def test_upsert_keeps_the_latest_row_per_key(spark, tmp_path):
    path = str(tmp_path / "scores")
    first = _scores(spark, [("C1", "P1", "trending", 0.1, 8), ("C2", "P1", "trending", 0.2, 9)])
    second = _scores(
        spark,
        [
            ("C1", "P1", "trending", 0.5, 10),
            ("C1", "P1", "trending", 0.4, 9),
            ("C2", "P1", "trending", 0.9, 7),
            ("C1", "P1", "vibe_match", 0.7, 6),
        ],
    )
    upsert(first, path, SCORE_KEYS, SCORE_NEWEST, 0)
    for _ in range(2):  # a repeated batch changes nothing
        upsert(second, path, SCORE_KEYS, SCORE_NEWEST, 1)
        rows = fx.dicts(read_upserted(spark, path, SCORE_KEYS, SCORE_NEWEST), "customer_id", "score_type")
        assert [(r["customer_id"], r["score_type"], r["score"]) for r in rows] == [
            ("C1", "trending", 0.5),
            ("C1", "vibe_match", 0.7),
            ("C2", "trending", 0.2),
        ]


def _files(path) -> dict[str, float]:
    return {str(f): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_upsert_leaves_stored_files_alone(spark, tmp_path):
    path = tmp_path / "scores"
    many = _scores(spark, [(f"C{i}", "P1", "trending", 0.1, 8) for i in range(200)])
    upsert(many, str(path), SCORE_KEYS, SCORE_NEWEST, 0)
    before = _files(path)
    upsert(_scores(spark, [("C7", "P1", "trending", 0.3, 9)]), str(path), SCORE_KEYS, SCORE_NEWEST, 1)
    assert before.items() < _files(path).items()
    table = read_upserted(spark, str(path), SCORE_KEYS, SCORE_NEWEST)
    assert table.count() == 200


def test_compacted_tables_go_on(spark, tmp_path):
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    for batch, score in enumerate([0.1, 0.2, 0.3]):
        upsert(_scores(spark, [("C1", "P1", "trending", score, 8 + batch)]), old, SCORE_KEYS, SCORE_NEWEST, batch)
    compact(spark, old, new, SCORE_KEYS, SCORE_NEWEST, 2)
    assert spark.read.parquet(new).count() == 1
    upsert(_scores(spark, [("C1", "P1", "trending", 0.9, 20)]), new, SCORE_KEYS, SCORE_NEWEST, 3)
    assert [r.score for r in read_upserted(spark, new, SCORE_KEYS, SCORE_NEWEST).collect()] == [0.9]
    assert [r.score for r in read_upserted(spark, old, SCORE_KEYS, SCORE_NEWEST).collect()] == [0.3]


def test_csv_columns_in_another_order_are_an_error(spark, tmp_path):
    path = tmp_path / "products.csv"
    names = _products(spark).columns
    path.write_text(",".join([names[1], names[0], *names[2:]]) + "\n" + ",".join(["x"] * len(names)) + "\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_products(spark, str(path)).collect()


def test_malformed_rows_are_reported(spark, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text("id,name\n1,a\nx,b\n3\n4,c,d\n")
    found = files.malformed_rows(spark, str(path), "id int, name string").collect()
    assert sorted(r.malformed_row for r in found) == ["3", "4,c,d", "x,b"]


def test_latest_per_key_keeps_columns(spark):
    rows = _scores(spark, [("C1", "P1", "trending", 0.1, 8), ("C1", "P1", "trending", 0.2, 8)])
    latest = latest_per_key(rows, SCORE_KEYS, ["computed_at"])
    assert latest.columns == rows.columns
    assert latest.first()["score"] == 0.2


def test_scratch_lies_in_the_shared_folder(spark):
    base, own = spark.conf.get("spark.checkpoint.dir"), spark.sparkContext.applicationId
    assert scratch_path(spark, "x").startswith(f"{base}/shelfwise-{own}/x-")

    class Session:
        sparkContext = spark.sparkContext

        class conf:
            @staticmethod
            def get(key, default=None):
                return {"spark.sql.warehouse.dir": "hdfs://host/warehouse"}.get(key, default)

    assert scratch_path(Session(), "x").startswith("hdfs://host/warehouse/_scratch/shelfwise-")

def test_published_layers(spark, tmp_path):
    products = _products(spark)
    customers = fx.customers(
        spark,
        [
            {"customer_id": "C1", "loyalty_tier": "Gold", "preferred_categories": '["Denim", "Tops"]', "lifetime_value": 10.0},
            {"customer_id": "C2", "loyalty_tier": "Bronze", "preferred_categories": '["Tops"]', "lifetime_value": 20.0},
        ],
    )
    purchases = fx.purchases(
        spark,
        [
            {
                "transaction_id": "T1",
                "customer_id": "C1",
                "product_id": "P1",
                "purchase_date": fx.at("2026-03-01 00:00:00"),
                "quantity": 1,
                "unit_price": 5.0,
                "total_amount": 5.0,
            }
        ],
    )
    clicks = fx.clicks(
        spark, [{"event_type": "add_to_cart", "event_timestamp": "2026-03-05 11:00:00", "product_id": "P1"}]
    )
    folder = str(tmp_path)
    for frame, name in [
        (clicks, CLICKSTREAM_FILE),
        (products, PRODUCTS_FILE),
        (customers, CUSTOMERS_FILE),
        (purchases, PURCHASES_FILE),
    ]:
        files.write_csv(frame, f"{folder}/{name}")

    bronze = read_bronze(spark, folder)
    assert isinstance(bronze, Bronze)
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    try:
        layers = publish(bronze, "shop", fx.AS_OF)
        tables = {r["tableName"] for r in spark.sql("SHOW TABLES IN shop").collect()}
        assert tables == {
            "bronze_clickstream",
            "bronze_products",
            "bronze_customers",
            "bronze_purchases",
            "silver_clickstream_enriched",
            "silver_customer_golden_record",
            "gold_category_intent_scores",
            "gold_high_value_segments",
            "gold_category_candidates",
            "bronze_click_days",
            "gold_text_words",
            "gold_text_heads",
            "gold_text_postings",
            "gold_text_products",
        }
        properties = spark.sql("SHOW TBLPROPERTIES shop.gold_high_value_segments ('quality')").first()
        assert properties["value"] == "gold"
        described = {r[0]: r[1] for r in spark.sql("DESCRIBE EXTENDED shop.bronze_products").collect()}
        assert described["Comment"] == "Raw product catalogue"

        found = {r["customer_id"]: r["segment"] for r in layers.segments.collect()}
        assert found == {"C1": "VIP Active", "C2": "New & Engaged"}
        scores = Recommendations(layers, fx.AS_OF).content_scores("C1").collect()
        assert [(r["product_id"], float(r["score"])) for r in scores] == [("P1", 0.27)]
        assert "credit_card_last4" not in layers.golden.columns
        opened = open_layers(spark, "spark_catalog.shop", fx.AS_OF)
        assert opened.segments.schema == layers.segments.schema
        interests = Recommendations(opened).top_interests().collect()
        assert [(r["customer_id"], r["category"]) for r in interests] == [("C1", "Denim"), ("C2", "Tops")]
        # A second run replaces every table.
        again = publish(bronze, "shop", fx.AS_OF)
        assert again.intent.count() == 1
        interests = recommend.top_interests(again.intent, again.golden)
        assert {r["category"] for r in interests.collect()} == {"Denim", "Tops"}
    finally:
        spark.sql("DROP DATABASE shop CASCADE")
