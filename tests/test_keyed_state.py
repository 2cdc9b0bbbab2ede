"""Balances and live sessions kept in keyed state, over batches, restarts and late events."""

from __future__ import annotations

import random
from datetime import timedelta

import pandas as pd

from shelfwise import schemas
from shelfwise.operators.enrich import enrich_clicks
from shelfwise.streaming import clicks as streams
from shelfwise.streaming import keyed_state as keyed
from shelfwise.streaming.runs import run_batches
from shelfwise.streaming.state import read_balances
from tests import fixtures as fx

SHOP = [{"product_id": f"P{i}", "product_name": f"N{i}", "category": ["Denim", "Shoes"][i % 2]} for i in range(4)]


def _add_points(spark, folder: str, number: int, rows) -> None:
    events = [{"id": i, "customer_id": c, "points": p, "created_at": fx.at(f"2026-03-05 {h:02}:00:00")} for i, c, p, h in rows]
    fx.points(spark, events).coalesce(1).write.parquet(f"{folder}/part={number}")


def test_balances_start_from_a_table_and_go_on_after_a_restart(spark, tmp_path):
    source, ledger, balances, check = (str(tmp_path / n) for n in ("in", "ledger", "balances", "check"))
    stored = spark.createDataFrame([("C1", 1000), ("C9", 5)], "customer_id string, balance long")

    def run():
        stream = streams.read_click_stream(spark, f"{source}/part=*", schemas.POINTS_EVENTS, "parquet", files_per_batch=1)
        with keyed.keyed_state(spark):
            run_batches(keyed.points_with_openings(stream, stored), keyed.post_openings(ledger, balances), check, "update")

    _add_points(spark, source, 0, [(1, "C1", 100, 8), (2, "C1", -30, 9), (3, "C2", 5, 8), (4, None, 7, 8)])
    _add_points(spark, source, 1, [(5, "C2", 1, 7), (6, "C1", None, 10)])
    run()
    _add_points(spark, source, 2, [(7, "C1", 1, 11), (8, "C1", 1, 10), (9, None, 1, 9)])
    run()
    rows = {r.id: (r.customer_id, r.balance_after) for r in spark.read.parquet(ledger).collect()}
    assert rows == {
        1: ("C1", 1100), 2: ("C1", 1070), 3: ("C2", 5), 4: (None, 7), 5: ("C2", 6), 6: ("C1", 1070),
        7: ("C1", 1072), 8: ("C1", 1071), 9: (None, 8),
    }
    assert {r.customer_id: r.balance for r in read_balances(spark, balances).collect()} == {"C1": 1072, "C2": 6, None: 8}


def test_a_repeated_batch_gives_the_same_ledger(spark, tmp_path):
    """The second batch fails after its writes; the restart repeats it."""
    source, ledger, balances, check = (str(tmp_path / n) for n in ("in", "ledger", "balances", "check"))
    for number, points in enumerate((10, 20)):
        _add_points(spark, source, number, [(number, "C1", points, 8), (10 + number, "C1", 1, 9)])
    failed = []

    def fragile(batch, batch_id):
        keyed.post_openings(ledger, balances)(batch, batch_id)
        if batch_id == 1 and not failed:
            failed.append(batch_id)
            raise RuntimeError("lost")

    for _ in range(2):
        stream = streams.read_click_stream(spark, f"{source}/part=*", schemas.POINTS_EVENTS, "parquet", files_per_batch=1)
        try:
            with keyed.keyed_state(spark):
                run_batches(keyed.points_with_openings(stream), fragile, check, "update")
        except Exception as error:  # noqa: BLE001 - the stream wraps what its batch raised
            assert "lost" in str(error)
    assert failed == [1]
    assert {r.id: r.balance_after for r in spark.read.parquet(ledger).collect()} == {0: 10, 10: 11, 1: 31, 11: 32}


def test_later_batches_read_no_earlier_balances(spark, tmp_path):
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    for number in range(5):
        _add_points(spark, source, number, [(number, f"C{number % 2}", 1, 8)])
    reads = []

    def each(batch, batch_id):
        batch.write.format("noop").mode("overwrite").save()  # a batch's state must be committed
        reads.append(batch._jdf.queryExecution().executedPlan().toString().count("Scan"))

    stream = streams.read_click_stream(spark, f"{source}/part=*", schemas.POINTS_EVENTS, "parquet", files_per_batch=1)
    with keyed.keyed_state(spark):
        run_batches(keyed.points_with_openings(stream), each, check, "update")
    assert len(reads) == 5 and len(set(reads[1:])) == 1, "the same scans in every batch: its own rows"


def _clicks(spark, n: int, seed: int):
    rng = random.Random(seed)
    start = fx.at("2026-03-05 00:00:00")
    kinds = ["product_view", "add_to_cart", "remove_from_cart", "search", "page_view"]
    rows = [
        {
            "event_id": f"{seed}-{i}",
            "customer_id": rng.choice(["C1", "C1", "C2", "C3"]),
            "event_type": rng.choice(kinds),
            "product_id": rng.choice(["P0", "P1", "P2", "P3", None]),
            "category_browsed": rng.choice(["Tops", None]),
            "event_timestamp": str(start + timedelta(minutes=5 * rng.randrange(600))),
        }
        for i in range(n)
    ]
    return sorted(rows, key=lambda r: r["event_timestamp"])


def _sessions(rows):
    columns = ("customer_id", "started_at", "last_activity_at", "events", "score", "categories_viewed", "products_viewed", "cart_items")
    return sorted(str([r[c] for c in columns]) for r in rows.collect())


def _run_sessions(spark, source: str, path: str, check: str, delay: str):
    stream = streams.read_click_stream(spark, f"{source}/part=*", schemas.CLICKSTREAM, "parquet", files_per_batch=1)
    enriched = enrich_clicks(stream, fx.products(spark, SHOP))
    with keyed.keyed_state(spark):
        run_batches(keyed.live_sessions(enriched, 30, delay), keyed.store_sessions(path), check, "update")


def test_live_sessions_equal_the_batch_at_every_stop(spark, tmp_path):
    source, path, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    rows = _clicks(spark, 160, 3)
    # Parts overlap in time, so sessions grow and join across batches.
    parts = [rows[0:50] + rows[60:70], rows[50:60] + rows[70:120], rows[120:]]
    seen = []
    for number, part in enumerate(parts):
        seen += part
        fx.clicks(spark, part).coalesce(1).write.parquet(f"{source}/part={number}")
        _run_sessions(spark, source, path, check, "12 hours")
        expected = streams._sessions(enrich_clicks(fx.clicks(spark, seen), fx.products(spark, SHOP)), "30 minutes")
        assert _sessions(keyed.read_sessions(spark, path)) == _sessions(expected)
    stored = spark.read.parquet(path)
    assert stored.where("closed").count() > 5 and stored.where("not closed").count() > 5
    assert "clicks" not in "".join(keyed.read_sessions(spark, path).inputFiles())


def test_events_behind_the_watermark_are_dropped(spark, tmp_path):
    source, path, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    times = [["2026-03-05 10:00:00"], ["2026-03-06 10:00:00"], ["2026-03-05 10:05:00", "2026-03-06 10:10:00"]]
    for number, part in enumerate(times):
        rows = [{"event_id": f"{number}{i}", "event_type": "search", "event_timestamp": t} for i, t in enumerate(part)]
        fx.clicks(spark, rows).coalesce(1).write.parquet(f"{source}/part={number}")
        _run_sessions(spark, source, path, check, "1 hour")
    found = {(str(r.started_at), r.events, r.closed) for r in keyed.read_sessions(spark, path).collect()}
    assert found == {("2026-03-05 10:00:00", 1, True), ("2026-03-06 10:00:00", 2, False)}


def test_a_customer_has_one_timer_however_many_sessions():
    class Handle:
        timers: list[int] = []

        def getValueState(self, name, schema):
            return self

        def get(self):
            return None

        def update(self, value):
            pass

        def registerTimer(self, moment):
            self.timers.append(moment)

    hour = 3_600_000_000
    columns = ["at", "category", "product", "tenths", "move"]
    rows = pd.DataFrame([(n * hour, None, None, 10, 0) for n in (3, 1, 2)], columns=columns)
    sessions, handle = keyed.Sessions(hour // 2), Handle()
    sessions.init(handle)
    (told,) = sessions.handleInputRows(("C1",), iter([rows]), None)
    assert len(told) == 3 and handle.timers == [5_400_001]


def test_merging_sessions():
    def one(at, product=None, side=0):
        moves = {} if product is None else {product: [at, None] if side == 0 else [None, at]}
        return {"started": at, "last": at, "events": 1, "tenths": 10, "categories": [f"c{at}"], "products": [], "moves": moves}

    merged = keyed.merge_sessions([one(33, "p", 1), one(0), one(10, "p"), one(22), one(21)], 10)
    assert [(s["started"], s["last"], s["events"]) for s in merged] == [(0, 10, 2), (21, 22, 2), (33, 33, 1)]
    (joined,) = keyed.merge_sessions([*merged, one(15), one(25)], 10)
    assert (joined["events"], joined["tenths"], joined["moves"]) == (7, 70, {"p": [10, 33]})
