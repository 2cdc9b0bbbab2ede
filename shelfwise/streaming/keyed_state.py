"""Streams with state of their own per customer: points balances and live sessions.

A micro-batch reads its own rows and the state of the customers in them, however long the
stream has run. State is versioned with the stream's checkpoint, so a batch that is
repeated after a lost executor or a restart starts from the state it started from before
and gives the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelfwise.functions import rules
from shelfwise.operators.ordering import running_total
from shelfwise.sources.tables import BATCH
from shelfwise.streaming.runs import BatchFunction

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in the store that processors need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS_DB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


# Points balances


class Balances(StatefulProcessor):
    """Keeps a customer's balance and tells what it was before the batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.balance = handle.getValueState("balance", "balance bigint")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.balance.update((int(initialState["balance"].iloc[-1]),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        opening = self.balance.get()[0] if self.balance.exists() else 0
        moved = sum(int(part["moved"].sum()) for part in rows)
        self.balance.update((opening + moved,))
        yield pd.DataFrame({"customer_id": [key[0]], "opening": [opening], "balance": [opening + moved]})

    def close(self) -> None:
        pass


def _summed(batches):
    """Each customer's points in a part of the batch, so that a customer with most of the
    events sends few rows to the task that keeps the balance."""
    for batch in batches:
        yield batch.groupby("customer_id", as_index=False, dropna=False)["moved"].sum()


def points_with_openings(events: DataFrame, balances: DataFrame | None = None) -> DataFrame:
    """The stream's events, and a row per batch and customer with the ``opening`` balance.

    ``balances(customer_id, balance)`` are those the stream starts from, a stored table
    that is read once, by the first batch.
    """
    points = F.coalesce(F.col("points").cast("long"), F.lit(0).cast("long"))
    signed = events.withColumn("points", points)
    kind = events.schema["customer_id"].dataType.simpleString()
    moves = signed.select("customer_id", F.col("points").alias("moved"))
    moves = moves.mapInPandas(_summed, f"customer_id {kind}, moved bigint")
    first = None if balances is None else balances.select("customer_id", F.col("balance").cast("long")).groupBy("customer_id")
    openings = moves.groupBy("customer_id").transformWithStateInPandas(
        Balances(), f"customer_id {kind}, opening bigint, balance bigint", "Update", "None", first
    )
    return signed.unionByName(openings, allowMissingColumns=True)


def post_openings(ledger_path: str, balances_path: str) -> BatchFunction:
    """Append points events with the balance after each, in arrival order of batches.

    Sums inside the batch run on slices of the whole order; each begins at its
    customer's opening balance. Batches have folders of their own.
    """

    def post(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        known = rows.where("opening is not null").select(F.col("customer_id").alias("owner"), "opening", "balance")
        events = rows.where("opening is null").drop("opening", "balance")
        running = running_total(events, ["customer_id"], ["created_at", "id"], "points", "balance_after")
        posted = running.join(known, F.col("customer_id").eqNullSafe(F.col("owner")), "left")
        after = F.col("balance_after") + F.col("opening")
        posted.withColumn("balance_after", after).drop("owner", "opening", "balance").write.mode("overwrite").parquet(
            f"{ledger_path}/{BATCH}={batch_id}"
        )
        known.select(F.col("owner").alias("customer_id"), "balance").write.mode("overwrite").parquet(
            f"{balances_path}/{BATCH}={batch_id}"
        )
        rows.unpersist()

    return post


# Live sessions

SESSION_ROWS = (
    "started bigint, last bigint, events bigint, tenths bigint, categories array<string>,"
    " products array<string>, cart array<string>, closed boolean"
)


def merge_sessions(sessions: list[dict], gap: int) -> list[dict]:
    """Sessions of one customer, joined where no more than ``gap`` lies between them, as
    Spark's session windows do."""
    merged: list[dict] = []
    for session in sorted(sessions, key=lambda s: (s["started"], s["last"])):
        if merged and session["started"] <= merged[-1]["last"] + gap:
            held = merged[-1]
            held["last"] = max(held["last"], session["last"])
            held["events"] += session["events"]
            held["tenths"] += session["tenths"]
            for name in ("categories", "products"):
                held[name] = sorted({*held[name], *session[name]})
            for product, moves in session["moves"].items():
                known = held["moves"].get(product, [None, None])
                held["moves"][product] = [max((m for m in pair if m is not None), default=None) for pair in zip(known, moves)]
        else:
            merged.append(session)
    return merged


def sessions_of(rows: pd.DataFrame, gap: int) -> list[dict]:
    """The sessions of one customer's events; moves are the last addition to the cart and
    the last removal of each product."""
    found: list[dict] = []
    columns = [rows[c].tolist() for c in ("at", "category", "product", "tenths", "move")]
    # Plain values: most customers have a few events, for which a frame's own steps cost most.
    for at, category, product, tenths, move in sorted(zip(*columns), key=lambda row: row[0]):
        if not found or at - found[-1]["last"] > gap:
            found.append({"started": at, "last": at, "events": 0, "tenths": 0, "categories": set(), "products": set(), "moves": {}})
        held = found[-1]
        held["last"] = at
        held["events"] += 1
        held["tenths"] += tenths
        if isinstance(category, str):
            held["categories"].add(category)
        if isinstance(product, str):
            held["products"].add(product)
            if move:
                held["moves"].setdefault(product, [None, None])[0 if move == 1 else 1] = at
    for held in found:
        held["categories"], held["products"] = sorted(held["categories"]), sorted(held["products"])
    return found


class Sessions(StatefulProcessor):
    """Keeps a customer's open sessions, tells them anew in every batch that has events
    of the customer, and closes them by timer once no event can extend them.

    A customer has one timer, for the session that ends first. When it fires, all sessions
    that are over are closed, and the next one sets it again."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "sessions string")

    def _rows(self, key, sessions: list[dict], over: list[dict] = ()) -> pd.DataFrame:
        """The closed sessions and the open ones, or a row that says there are none. At the
        same moment an addition to the cart counts as the later one."""
        rows = [
            (
                key[0], s["started"], s["last"], s["events"], s["tenths"], s["categories"], s["products"],
                sorted(p for p, (added, removed) in s["moves"].items() if added is not None and (removed is None or added >= removed)),
                closed,
            )
            for part, closed in ((over, True), (sessions, False))
            for s in part
        ]
        if not sessions:
            rows.append((key[0], *[None] * 7, False))
        columns = ["customer_id", *(c.split()[0] for c in SESSION_ROWS.split(", "))]
        return pd.DataFrame(rows, columns=columns, dtype=object)

    def _held(self) -> list[dict]:
        stored = self.open.get()
        return json.loads(stored[0]) if stored else []

    def _wake(self, sessions: list[dict]) -> None:
        first = min(s["last"] for s in sessions)
        self.handle.registerTimer((first + self.gap) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        before = min((s["last"] for s in held), default=None)
        for part in rows:
            held = merge_sessions(held + sessions_of(part, self.gap), self.gap)
        self.open.update((json.dumps(held),))
        # A timer that is early finds nothing over, or less, and is set again.
        if before is None or min(s["last"] for s in held) < before:
            self._wake(held)
        yield self._rows(key, held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        if not held:
            return
        moment = timerValues.getCurrentWatermarkInMs() * 1000
        over = [s for s in held if s["last"] + self.gap < moment]
        left = [s for s in held if s["last"] + self.gap >= moment]
        if left:
            self._wake(left)
        if not over:
            return
        if left:
            self.open.update((json.dumps(left),))
        else:
            self.open.clear()
        yield self._rows(key, left, over)

    def close(self) -> None:
        pass


def live_sessions(enriched: DataFrame, gap_minutes: int = 30, delay: str = "1 hour") -> DataFrame:
    """A stream's sessions as they grow: in each batch the open ones of the customers in
    it, and those that the watermark has closed. Events later than ``delay`` are dropped.

    A row without ``started_at`` says that its customer has no open session any more.
    ``read_sessions`` gives the sessions as they stand.
    """
    kind = F.col("event_type")
    customer = enriched.schema["customer_id"].dataType.simpleString()
    product = enriched.schema["product_id"].dataType.simpleString()
    events = enriched.withWatermark("event_timestamp", delay).select(
        "customer_id",
        "event_timestamp",
        F.unix_micros("event_timestamp").alias("at"),
        F.col("resolved_category").alias("category"),
        F.col("product_id").cast("string").alias("product"),
        (rules.event_weight(kind) * 10).cast("long").alias("tenths"),
        F.when(kind == "add_to_cart", 1).when(kind == "remove_from_cart", -1).otherwise(0).alias("move"),
    )
    found = events.groupBy("customer_id").transformWithStateInPandas(
        Sessions(gap_minutes * 60_000_000), f"customer_id {customer}, {SESSION_ROWS}", "Update", "EventTime"
    )
    return found.select(
        "customer_id",
        F.timestamp_micros("started").alias("started_at"),
        F.timestamp_micros("last").alias("last_activity_at"),
        "events",
        (F.col("tenths") / 10).cast("decimal(18,2)").alias("score"),
        F.array_sort("categories").alias("categories_viewed"),
        F.array_sort(F.col("products").cast(f"array<{product}>")).alias("products_viewed"),
        F.array_sort(F.col("cart").cast(f"array<{product}>")).alias("cart_items"),
        "closed",
    )


def store_sessions(path: str) -> BatchFunction:
    """Write each batch's session rows into a folder of its own below ``path``."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    return store


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """The closed sessions, and the open ones as of each customer's last batch."""
    rows = spark.read.parquet(path)
    last = rows.groupBy(F.col("customer_id").alias("owner")).agg(F.max(BATCH).alias("last_batch"))
    latest = F.col("customer_id").eqNullSafe(F.col("owner")) & (F.col(BATCH) == F.col("last_batch"))
    open_rows = rows.where("not closed").join(last, latest).where("started_at is not null")
    return rows.where("closed").unionByName(open_rows.select(*rows.columns)).drop(BATCH)
