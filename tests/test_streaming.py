"""Streams against the batch operators, with late, repeated and replayed input."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from shelfwise import schemas
from shelfwise.operators.enrich import enrich_clicks
from shelfwise.operators.intent import category_intent
from shelfwise.sources.files import write_csv
from shelfwise.sources.tables import read_upserted
from shelfwise.streaming.clicks import (
    dedupe_events,
    intent_buckets,
    intent_from_buckets,
    open_sessions,
    read_click_stream,
    stream_sessions,
)
from shelfwise.streaming.runs import run_batches, run_to_files, run_updates
from shelfwise.streaming.state import SCORE_KEYS, SCORE_NEWEST, post_points, read_balances, upsert_scores
from tests import fixtures as fx

SHOP = [
    {"product_id": "P1", "product_name": "Jeans", "category": "Denim"},
    {"product_id": "P2", "product_name": "Boots", "category": "Shoes"},
]
KINDS = ["add_to_cart", "wishlist_add", "search", "product_view", "category_browse", "page_view"]


def _random_clicks(spark, n=300):
    picker = random.Random(4)
    rows = []
    for i in range(n):
        product = picker.choice(["P1", "P2", "P9", None])
        minute = i * 10
        rows.append(
            {
                "customer_id": f"C{picker.randrange(5)}",
                "event_type": picker.choice(KINDS),
                "product_id": product,
                "category_browsed": picker.choice(["Tops", None]),
                "event_timestamp": f"2026-03-0{3 + minute // 1440} {minute // 60 % 24:02}:{minute % 60:02}:00",
            }
        )
    # Far ahead, so that every window before it closes.
    rows.append({"event_type": "page_view", "category_browsed": "End", "event_timestamp": "2026-04-01 00:00:00"})
    return fx.clicks(spark, rows)


def _csv_stream(spark, tmp_path, frames):
    folder = str(tmp_path / "clicks")
    for i, frame in enumerate(frames):
        write_csv(frame.coalesce(1), f"{folder}/part={i}")
    return read_click_stream(spark, f"{folder}/part=*", schemas.CLICKSTREAM, files_per_batch=1)


BUCKET_KEYS = ["bucket_start", "customer_id", "resolved_category"]


@pytest.mark.parametrize("as_of", ["2026-03-05 01:00:00", "2026-03-05 01:30:00", "2026-03-05 00:12:34"])
def test_stored_buckets_give_the_batch_scores(spark, tmp_path, as_of):
    clicks, products = _random_clicks(spark), fx.products(spark, SHOP)
    halves = [clicks.where(f"event_timestamp {side} '2026-03-04 00:25:00'") for side in ("<", ">=")]
    stream = _csv_stream(spark, tmp_path, halves)
    enriched = enrich_clicks(clicks, products)
    buckets = intent_buckets(enrich_clicks(stream, products))
    buckets = run_updates(buckets, str(tmp_path / "out"), str(tmp_path / "check"), BUCKET_KEYS)
    order = ["customer_id", "category_rank"]
    found = fx.dicts(intent_from_buckets(buckets, as_of, enriched), *order)
    assert found == fx.dicts(category_intent(enriched, as_of), *order) and len(found) > 10


def test_late_events_are_dropped_and_earlier_ones_kept(spark, tmp_path):
    def one(time):
        return fx.clicks(spark, [{"event_type": "product_view", "category_browsed": "Tops", "event_timestamp": time}])

    times = [
        "2026-03-05 10:10:00",
        "2026-03-05 12:30:00",  # moves the watermark to 11:30
        "2026-03-05 11:40:00",  # late but inside the delay
        "2026-03-05 10:20:00",  # beyond the delay
        "2026-03-05 20:00:00",
    ]
    stream = _csv_stream(spark, tmp_path, [one(t) for t in times])
    buckets = run_to_files(
        intent_buckets(enrich_clicks(stream, fx.products(spark, SHOP))), str(tmp_path / "out"), str(tmp_path / "check")
    )
    rows = fx.dicts(buckets, "bucket_start")
    assert [(r["bucket_start"].hour, r["event_count"]) for r in rows] == [(10, 1), (11, 1), (12, 1)]


def test_repeated_events_are_dropped_across_batches(spark, tmp_path):
    clicks = _random_clicks(spark, 40).where("category_browsed IS NULL OR category_browsed <> 'End'")
    stream = _csv_stream(spark, tmp_path, [clicks, clicks.limit(10)])
    typed = stream.withColumn("event_timestamp", F.to_timestamp("event_timestamp"))
    rows = run_to_files(dedupe_events(typed, "12 hours"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert rows.count() == clicks.count() == rows.select("event_id").distinct().count()


def test_events_without_an_id_all_stay(spark, tmp_path):
    clicks = _random_clicks(spark, 10).withColumn("event_id", F.when(F.col("event_type") != "search", F.col("event_id")))
    stream = _csv_stream(spark, tmp_path, [clicks])
    typed = stream.withColumn("event_timestamp", F.to_timestamp("event_timestamp"))
    rows = run_to_files(dedupe_events(typed, "60 days"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert rows.count() == clicks.count()


def test_sessions_split_at_a_pause(spark, tmp_path):
    rows = [
        ("product_view", "P1", "2026-03-05 10:00:00"),
        ("add_to_cart", "P1", "2026-03-05 10:20:00"),
        ("add_to_cart", "P2", "2026-03-05 10:45:00"),
        ("remove_from_cart", "P2", "2026-03-05 10:46:00"),
        ("remove_from_cart", "P1", "2026-03-05 10:47:00"),
        ("add_to_cart", "P1", "2026-03-05 10:48:00"),
        ("product_view", "P2", "2026-03-05 11:30:00"),
        ("add_to_cart", "P2", "2026-03-06 00:00:00"),
        ("page_view", None, "2026-03-06 00:05:00"),
    ]
    clicks = fx.clicks(spark, [{"event_type": k, "product_id": p, "event_timestamp": t} for k, p, t in rows])
    stream = _csv_stream(spark, tmp_path, [clicks])
    enriched = enrich_clicks(clicks, fx.products(spark, SHOP))
    closed = run_to_files(
        stream_sessions(enrich_clicks(stream, fx.products(spark, SHOP))), str(tmp_path / "out"), str(tmp_path / "check")
    )
    first, second = fx.dicts(closed, "started_at")  # the last one is still open
    assert (first["events"], first["cart_items"], first["products_viewed"]) == (6, ["P1"], ["P1", "P2"])
    assert first["categories_viewed"] == ["Denim", "Shoes"] and float(first["score"]) == 10.0
    assert first["last_activity_at"] == fx.at("2026-03-05 10:48:00")
    assert second["events"] == 1
    (last,) = fx.dicts(open_sessions(enriched, closed), "started_at")
    assert (last["events"], last["cart_items"]) == (2, ["P2"])


def _points(spark, rows):
    return fx.points(
        spark,
        [{"id": i, "customer_id": c, "points": p, "created_at": fx.at(f"2026-03-05 {h:02}:00:00")} for i, c, p, h in rows],
    )


def test_balances_carry_over_and_survive_a_replay(spark, tmp_path):
    ledger, balances = str(tmp_path / "ledger"), str(tmp_path / "balances")
    post = post_points(ledger, balances)
    first = _points(spark, [(1, "C1", 100, 8), (2, "C1", -30, 9), (3, "C2", 5, 8)])
    second = _points(spark, [(4, "C1", 10, 10), (5, "C3", 7, 10), (6, "C1", -80, 11)])
    for batch, batch_id in [(first, 0), (first, 0), (second, 1), (second, 1)]:
        post(batch, batch_id)
    rows = fx.dicts(spark.read.parquet(ledger), "id")
    assert [r["balance_after"] for r in rows] == [100, 70, 5, 80, 7, 0]
    kept = {r["customer_id"]: r["balance"] for r in read_balances(spark, balances).collect()}
    assert kept == {"C1": 0, "C2": 5, "C3": 7}


def test_streamed_ledger_over_several_batches(spark, tmp_path):
    source = str(tmp_path / "points")
    parts = [
        [(1, "C1", 100, 8), (2, "C2", 50, 8)],
        [(3, "C1", -20, 9)],
        [(4, "C2", 1, 10), (5, "C1", 1, 11)],
    ]
    for i, rows in enumerate(parts):
        _points(spark, rows).coalesce(1).write.parquet(f"{source}/part={i}")
    stream = read_click_stream(spark, f"{source}/part=*", schemas.POINTS_EVENTS, "parquet", files_per_batch=1)
    ledger = str(tmp_path / "ledger")
    run_batches(stream, post_points(ledger, str(tmp_path / "balances")), str(tmp_path / "check"))
    rows = fx.dicts(spark.read.parquet(ledger), "id")
    assert [r["balance_after"] for r in rows] == [100, 50, 80, 51, 81]


def test_streamed_scores_keep_the_latest(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "scores")
    for i, (score, hour) in enumerate([(0.1, 8), (0.9, 10), (0.5, 9)]):
        spark.createDataFrame(
            [("C1", "P1", score, "trending", "why", fx.at(f"2026-03-05 {hour:02}:00:00"))],
            schemas.RECOMMENDATION_SCORES,
        ).coalesce(1).write.parquet(f"{source}/part={i}")
    stream = read_click_stream(spark, f"{source}/part=*", schemas.RECOMMENDATION_SCORES, "parquet", files_per_batch=1)
    run_batches(stream, upsert_scores(path), str(tmp_path / "check"))
    assert [r["score"] for r in read_upserted(spark, path, SCORE_KEYS, SCORE_NEWEST).collect()] == [0.9]
