"""Bronze, silver and gold tables."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.clock import AsOf
from shelfwise.operators.enrich import EVENT_DAY, enrich_clicks, with_event_day
from shelfwise.operators.golden import golden_record, purchase_rollup
from shelfwise.operators.intent import category_intent
from shelfwise.operators.recommend import category_candidates
from shelfwise.operators.segments import segments
from shelfwise.operators.similarity import catalogue_words, style_hits
from shelfwise.operators.text_index import TextIndex, build_index, open_index, publish_index, store_index
from shelfwise.sources import files
from shelfwise.sources.scratch import cut_lineage
from shelfwise.sources.tables import digests, publish_table, replace_partitions

# Names of the input files.
CLICKSTREAM_FILE = "clickstream_events.csv"
PRODUCTS_FILE = "products_catalog.csv"
CUSTOMERS_FILE = "customer_profiles.csv"
PURCHASES_FILE = "purchase_history.csv"

# Names of the published tables.
CLICKS_TABLE = "bronze_clickstream"
PRODUCTS_TABLE = "bronze_products"
CUSTOMERS_TABLE = "bronze_customers"
PURCHASES_TABLE = "bronze_purchases"
ENRICHED_TABLE = "silver_clickstream_enriched"
GOLDEN_TABLE = "silver_customer_golden_record"
INTENT_TABLE = "gold_category_intent_scores"
SEGMENTS_TABLE = "gold_high_value_segments"
CANDIDATES_TABLE = "gold_category_candidates"
DAYS_TABLE = "bronze_click_days"
ROLLUP_TABLE = "silver_purchase_rollup"
HITS_TABLE = "gold_style_hits"

COMMENTS = {
    CLICKS_TABLE: "Raw click events",
    PRODUCTS_TABLE: "Raw product catalogue",
    CUSTOMERS_TABLE: "Raw customer profiles",
    PURCHASES_TABLE: "Raw purchase history",
    ENRICHED_TABLE: "Typed click events with product columns",
    GOLDEN_TABLE: "One masked row per customer with purchase aggregates",
    INTENT_TABLE: "Recent interest per customer and category",
    SEGMENTS_TABLE: "Customer segments",
    CANDIDATES_TABLE: "Products to recommend per category",
    DAYS_TABLE: "Rows and digest of each day's clicks",
    ROLLUP_TABLE: "Purchase aggregates per customer",
    HITS_TABLE: "Products in the style of their category",
}


@dataclass(frozen=True)
class Bronze:
    clicks: DataFrame
    products: DataFrame
    customers: DataFrame
    purchases: DataFrame


class Medallion:
    """Silver and gold over ``bronze``: plans that run when something reads them."""

    def __init__(self, bronze: Bronze, as_of: AsOf = None, window: str = "calendar"):
        self.bronze = bronze
        self.as_of = as_of
        self.window = window

    @cached_property
    def enriched(self) -> DataFrame:
        return enrich_clicks(self.bronze.clicks, self.bronze.products)

    @cached_property
    def rollup(self) -> DataFrame:
        """What the golden records tell of purchases; changes with those alone."""
        return purchase_rollup(self.bronze.purchases)

    @cached_property
    def golden(self) -> DataFrame:
        return golden_record(self.bronze.customers, self.bronze.purchases, self.as_of, rollup=self.rollup)

    @cached_property
    def intent(self) -> DataFrame:
        return category_intent(self.enriched, self.as_of, self.window)

    @cached_property
    def segments(self) -> DataFrame:
        return segments(self.golden, self.intent)

    @cached_property
    def hits(self) -> DataFrame:
        """The style hits of every category; they change with the catalogue alone."""
        return style_hits(self.bronze.products)

    @cached_property
    def candidates(self) -> DataFrame:
        """Products that recommendations choose from, a few per category."""
        return category_candidates(self.bronze.products, self.intent, self.hits)

    @cached_property
    def text_index(self) -> TextIndex:
        """The catalogue's text index; stored when first asked for."""
        return store_index(build_index(self.bronze.products))

    def settle(self, *names: str) -> Medallion:
        """Write the named layers to the scratch folder and go on from there.

        For plans that read a layer several times: the clicks are scored once, and
        later joins know real sizes. Published layers do not need it.
        """
        for name in names:
            setattr(self, name, cut_lineage(getattr(self, name), name))
        return self


def read_bronze(spark: SparkSession, folder: str) -> Bronze:
    """The four CSV inputs of a folder."""
    return Bronze(
        clicks=files.read_clickstream(spark, f"{folder}/{CLICKSTREAM_FILE}"),
        products=files.read_products(spark, f"{folder}/{PRODUCTS_FILE}"),
        customers=files.read_customers(spark, f"{folder}/{CUSTOMERS_FILE}"),
        purchases=files.read_purchases(spark, f"{folder}/{PURCHASES_FILE}"),
    )


def _at_once(*steps: Callable[[], object]) -> list:
    """Run steps that do not need each other side by side; Spark shares out the cores."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [running.result() for running in [pool.submit(step) for step in steps]]


class _Tables:
    """The published tables of one database."""

    def __init__(self, database: str):
        self.database = database

    def name(self, table: str) -> str:
        return f"{self.database}.{table}"

    def has(self, table: str) -> bool:
        """False for a table that an earlier release, or a refresh that failed, did not write."""
        return SparkSession.active().catalog.tableExists(self.name(table))

    def drop(self, table: str) -> None:
        """Before what it is derived from is replaced: should that or the rest of a refresh
        fail, the next one finds it missing."""
        SparkSession.active().sql("DROP TABLE IF EXISTS IDENTIFIER(:name)", {"name": self.name(table)})

    def store(self, df: DataFrame, table: str, layer: str) -> DataFrame:
        by = [EVENT_DAY] if table in (CLICKS_TABLE, ENRICHED_TABLE) else []
        return publish_table(df, self.name(table), layer, COMMENTS[table], by)

    def store_catalogue(self, products: DataFrame) -> tuple[TextIndex, DataFrame]:
        """The catalogue's text index and style hits, from words that are counted once."""
        counted = catalogue_words(products)
        index, hits = _at_once(
            lambda: publish_index(build_index(products, counted), self.database),
            lambda: self.store(style_hits(products, counted=counted), HITS_TABLE, "gold"),
        )
        return index, hits

    def store_derived(self, layers: Medallion) -> None:
        """The layers that depend on the whole of others or on the clock."""

        def golden() -> None:
            layers.golden = self.store(layers.golden, GOLDEN_TABLE, "silver")

        def intent() -> None:
            layers.intent = self.store(layers.intent, INTENT_TABLE, "gold")

        def segment() -> None:
            layers.segments = self.store(layers.segments, SEGMENTS_TABLE, "gold")

        def candidates() -> None:
            layers.candidates = self.store(layers.candidates, CANDIDATES_TABLE, "gold")

        _at_once(golden, intent)
        _at_once(segment, candidates)


def publish(bronze: Bronze, database: str, as_of: AsOf = None, window: str = "calendar") -> Medallion:
    """Write every layer as a table; each later layer reads the stored one before it.

    Clicks are stored by day, and the days' digests beside them, for ``refresh``.
    """
    tables = _Tables(database)
    clicks, products, customers, purchases = _at_once(
        lambda: tables.store(with_event_day(bronze.clicks), CLICKS_TABLE, "bronze"),
        lambda: tables.store(bronze.products, PRODUCTS_TABLE, "bronze"),
        lambda: tables.store(bronze.customers, CUSTOMERS_TABLE, "bronze"),
        lambda: tables.store(bronze.purchases, PURCHASES_TABLE, "bronze"),
    )
    layers = Medallion(Bronze(clicks, products, customers, purchases), as_of, window)
    layers.enriched, (layers.text_index, layers.hits), layers.rollup, _ = _at_once(
        lambda: tables.store(layers.enriched, ENRICHED_TABLE, "silver"),
        lambda: tables.store_catalogue(products),
        lambda: tables.store(layers.rollup, ROLLUP_TABLE, "silver"),
        lambda: tables.store(digests(clicks, [EVENT_DAY]), DAYS_TABLE, "bronze"),
    )
    tables.store_derived(layers)
    return layers


def _changed(new: DataFrame, stored: DataFrame) -> bool:
    return digests(new.select(*stored.columns)).first() != digests(stored).first()


def refresh(bronze: Bronze, database: str, as_of: AsOf = None, window: str = "calendar") -> tuple[Medallion, list[date]]:
    """Bring the tables that ``publish`` wrote up to date, and tell which days changed.

    Only days whose clicks differ from the stored ones are written again, in the click
    tables; the other days' files stay. A changed catalogue is replaced with its text
    index and style hits, and then all days are enriched again; changed purchases are
    replaced with their aggregates. What depends on the clock is replaced.
    """
    spark, tables = bronze.clicks.sparkSession, _Tables(database)
    layers = open_layers(spark, database, as_of)
    layers.window = window
    clicks = with_event_day(bronze.clicks).select(*layers.bronze.clicks.columns)
    old = layers.bronze
    days, new_products, new_customers, new_purchases = _at_once(
        lambda: cut_lineage(digests(clicks, [EVENT_DAY]), "days"),
        lambda: _changed(bronze.products, old.products),
        lambda: _changed(bronze.customers, old.customers),
        lambda: _changed(bronze.purchases, old.purchases),
    )
    stored = spark.table(tables.name(DAYS_TABLE)).withColumnsRenamed({"rows": "old_rows", "digest": "old_digest"})
    same = F.col("rows").eqNullSafe(F.col("old_rows")) & F.col("digest").eqNullSafe(F.col("old_digest"))
    changed = sorted(row[0] for row in days.join(stored, EVENT_DAY, "full").where(~same).select(EVENT_DAY).collect())
    if changed:
        replace_partitions(clicks.where(F.col(EVENT_DAY).isin(changed)), tables.name(CLICKS_TABLE), EVENT_DAY, changed)
        days.write.mode("overwrite").insertInto(tables.name(DAYS_TABLE))
    again = changed
    if new_products:
        tables.drop(HITS_TABLE)
        tables.store(bronze.products, PRODUCTS_TABLE, "bronze")
        again = sorted(row[0] for row in days.select(EVENT_DAY).collect())
    if new_customers:
        tables.store(bronze.customers, CUSTOMERS_TABLE, "bronze")
    if new_purchases:
        tables.drop(ROLLUP_TABLE)
        tables.store(bronze.purchases, PURCHASES_TABLE, "bronze")
    names = (CLICKS_TABLE, PRODUCTS_TABLE, CUSTOMERS_TABLE, PURCHASES_TABLE)
    for name in (*names, ENRICHED_TABLE, DAYS_TABLE):
        spark.catalog.refreshTable(tables.name(name))
    fresh = Medallion(Bronze(*(spark.table(tables.name(name)) for name in names)), as_of, window)
    if again:
        part = fresh.bronze.clicks.where(F.col(EVENT_DAY).isin(list(again)))
        replace_partitions(enrich_clicks(part, fresh.bronze.products), tables.name(ENRICHED_TABLE), EVENT_DAY, again)
        spark.catalog.refreshTable(tables.name(ENRICHED_TABLE))
    fresh.enriched, fresh.text_index = spark.table(tables.name(ENRICHED_TABLE)), layers.text_index
    if new_products or not tables.has(HITS_TABLE):
        fresh.text_index, fresh.hits = tables.store_catalogue(fresh.bronze.products)
    else:
        fresh.hits = layers.hits
    if new_purchases or not tables.has(ROLLUP_TABLE):
        fresh.rollup = tables.store(fresh.rollup, ROLLUP_TABLE, "silver")
    else:
        fresh.rollup = layers.rollup
    tables.store_derived(fresh)
    return fresh, changed


def open_layers(spark: SparkSession, database: str, as_of: AsOf = None) -> Medallion:
    """The layers published in ``database`` (``catalog.database`` works as well)."""

    def table(name: str) -> DataFrame:
        return spark.table(f"{database}.{name}")

    layers = Medallion(
        Bronze(table(CLICKS_TABLE), table(PRODUCTS_TABLE), table(CUSTOMERS_TABLE), table(PURCHASES_TABLE)), as_of
    )
    layers.enriched = table(ENRICHED_TABLE)
    layers.golden = table(GOLDEN_TABLE)
    layers.intent = table(INTENT_TABLE)
    layers.segments = table(SEGMENTS_TABLE)
    layers.candidates = table(CANDIDATES_TABLE)
    layers.text_index = open_index(spark, database)
    # An earlier release, or a refresh that failed, did not write these: they are then computed.
    for layer, name in (("rollup", ROLLUP_TABLE), ("hits", HITS_TABLE)):
        if spark.catalog.tableExists(f"{database}.{name}"):
            setattr(layers, layer, table(name))
    return layers
