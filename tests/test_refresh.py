"""Publishing by day and bringing published tables up to date."""

from __future__ import annotations

from datetime import date

import pytest

from shelfwise.operators import similarity
from shelfwise.operators.enrich import with_event_day
from shelfwise.plans import medallion
from shelfwise.plans.queries import scratch_database
from shelfwise.sources.tables import digests
from tests import fixtures as fx

PRODUCTS = [{"product_id": "P1", "product_name": "Jeans", "category": "Denim", "price": 50.0}]


def _clicks(*more):
    rows = [
        {"event_timestamp": "2026-03-03 06:00:00", "event_type": "product_view", "product_id": "P1"},
        {"event_timestamp": "2026-03-04 06:00:00", "event_type": "search", "category_browsed": "Tops"},
        {"event_timestamp": "2026-03-04 07:00:00", "event_type": "search", "category_browsed": "Tops", "customer_id": "C2"},
        {"event_timestamp": "2026-03-02 06:00:00", "event_type": "search", "customer_id": None},
        {"event_timestamp": "not a time", "event_type": "search"},
    ]
    return [{"event_id": f"R{i}", **row} for i, row in enumerate([*rows, *more])]


def _bronze(spark, clicks, products=PRODUCTS):
    return medallion.Bronze(
        fx.clicks(spark, clicks),
        fx.products(spark, products),
        fx.customers(spark, [{"customer_id": "C1"}, {"customer_id": "C2"}]),
        fx.purchases(spark, []),
    )


def _files(layers):
    names = {}
    for layer in ("clicks", "enriched"):
        table = layers.bronze.clicks if layer == "clicks" else layers.enriched
        names[layer] = {f.rsplit("/", 2)[1].removeprefix("event_day="): f for f in table.inputFiles()}
    return names


def _rows(df):
    return sorted(map(str, (r.asDict() for r in df.collect())))


LAYERS = ("enriched", "golden", "intent", "segments", "candidates")


@pytest.mark.parametrize(
    "change, days",
    [
        ([{"event_timestamp": "2026-03-05 06:00:00", "event_type": "add_to_cart", "product_id": "P1"}], [date(2026, 3, 5)]),
        ([{"event_timestamp": "2026-03-04 09:00:00", "event_type": "search", "category_browsed": "Hats"}], [date(2026, 3, 4)]),
        ([], []),
    ],
)
def test_only_changed_days_are_written(spark, change, days):
    with scratch_database(spark) as database, scratch_database(spark) as other:
        before = _files(medallion.publish(_bronze(spark, _clicks()), database, fx.AS_OF))
        layers, changed = medallion.refresh(_bronze(spark, _clicks(*change)), database, fx.AS_OF)
        assert changed == days
        after = _files(medallion.open_layers(spark, database, fx.AS_OF))
        for layer in before:
            for day, file in before[layer].items():
                assert (after[layer][day] == file) == (day not in map(str, days)), (layer, day)
            assert set(map(str, days)) <= set(after[layer])
        whole = medallion.publish(_bronze(spark, _clicks(*change)), other, fx.AS_OF)
        for name in LAYERS:
            assert _rows(getattr(layers, name)) == _rows(getattr(whole, name)), name
        assert _rows(layers.bronze.clicks) == _rows(whole.bronze.clicks)


def test_days_that_lose_their_rows_go(spark):
    with scratch_database(spark) as database:
        medallion.publish(_bronze(spark, _clicks()), database, fx.AS_OF)
        left = [r for r in _clicks() if not r["event_timestamp"].startswith("2026-03-04")]
        layers, changed = medallion.refresh(_bronze(spark, left), database, fx.AS_OF)
        assert changed == [date(2026, 3, 4)]
        assert sorted(str(r[0]) for r in layers.enriched.select("event_day").distinct().collect()) == ["2026-03-03"]
        assert layers.bronze.clicks.count() == len(left)
        assert medallion.refresh(_bronze(spark, left), database, fx.AS_OF)[1] == []


def test_a_changed_catalogue_enriches_every_day_again(spark):
    renamed = [{**PRODUCTS[0], "category": "Jeans"}]
    with scratch_database(spark) as database:
        medallion.publish(_bronze(spark, _clicks()), database, fx.AS_OF)
        layers, changed = medallion.refresh(_bronze(spark, _clicks(), renamed), database, fx.AS_OF)
        assert changed == []
        assert {r.resolved_category for r in layers.enriched.collect()} == {"Jeans", "Tops"}


def test_recent_clicks_read_recent_days(spark):
    with scratch_database(spark) as database:
        layers = medallion.publish(_bronze(spark, _clicks()), database, fx.AS_OF)
        fresh = medallion.Medallion(layers.bronze, fx.AS_OF)
        fresh.enriched = layers.enriched
        plan = fresh.intent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_day" in plan and "2026-03-03" in plan


def test_digests_tell_repeated_rows(spark):
    one = with_event_day(fx.clicks(spark, _clicks()))
    assert digests(one).first() != digests(one.union(one)).first()
    assert digests(one).first() == digests(one.repartition(5)).first()
    assert digests(one.limit(0)).first().rows == 0


def test_what_the_clock_does_not_change_is_kept(spark):
    """Style hits change with the catalogue alone, purchase aggregates with purchases alone."""
    sold = {"transaction_id": "T1", "customer_id": "C1", "product_id": "P1", "total_amount": 50.0}
    before = _bronze(spark, _clicks())
    bought = medallion.Bronze(before.clicks, before.products, before.customers, fx.purchases(spark, [sold]))
    renamed = _bronze(spark, _clicks(), [{**PRODUCTS[0], "category": "Jeans"}])
    with scratch_database(spark) as database, scratch_database(spark) as other:
        medallion.publish(before, database, fx.AS_OF)

        def files():
            return [sorted(spark.table(f"{database}.{name}").inputFiles()) for name in (medallion.HITS_TABLE, medallion.ROLLUP_TABLE)]

        hits, rollup = files()
        later = [{"event_timestamp": "2026-03-05 06:00:00", "event_type": "search"}]
        medallion.refresh(_bronze(spark, _clicks(*later)), database, fx.AS_OF)
        assert files() == [hits, rollup]
        layers, _ = medallion.refresh(bought, database, fx.AS_OF)
        assert files()[0] == hits and files()[1] != rollup
        assert {r.customer_id: r.total_transactions for r in layers.golden.collect()} == {"C1": 1, "C2": None}
        rollup = files()[1]
        both = medallion.Bronze(before.clicks, renamed.products, before.customers, bought.purchases)
        layers, _ = medallion.refresh(both, database, fx.AS_OF)
        assert files()[0] != hits and files()[1] == rollup
        whole = medallion.publish(both, other, fx.AS_OF)
        for name in LAYERS:
            assert _rows(getattr(layers, name)) == _rows(getattr(whole, name)), name


def test_tables_of_an_earlier_release_are_topped_up(spark):
    with scratch_database(spark) as database:
        medallion.publish(_bronze(spark, _clicks()), database, fx.AS_OF)
        for table in (medallion.HITS_TABLE, medallion.ROLLUP_TABLE):
            spark.sql(f"DROP TABLE {database}.{table}")
        whole = _rows(medallion.open_layers(spark, database, fx.AS_OF).candidates)
        layers, _ = medallion.refresh(_bronze(spark, _clicks()), database, fx.AS_OF)
        assert _rows(layers.candidates) == whole
        assert layers.rollup.count() == 0 and spark.table(f"{database}.{medallion.HITS_TABLE}").count() == 1


def test_style_hits_need_not_take_texts_apart_again(spark):
    products = fx.products(
        spark,
        [{"product_id": f"P{i}", "product_name": f"jeans {i % 3} style", "category": "Denim" if i % 2 else "Tops"} for i in range(9)],
    )
    plain = similarity.style_hits(products)
    stored = similarity.style_hits(products, counted=similarity.catalogue_words(products))
    assert "explode" in plain._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in stored._jdf.queryExecution().executedPlan().toString()
    assert _rows(stored) == _rows(plain)


def test_a_refresh_that_failed_leaves_nothing_stale(spark, monkeypatch):
    """The new purchases are stored, their aggregates are not; the next refresh makes up for it."""
    before = _bronze(spark, _clicks())
    sold = {"transaction_id": "T1", "customer_id": "C1", "product_id": "P1", "total_amount": 50.0}
    bought = medallion.Bronze(before.clicks, before.products, before.customers, fx.purchases(spark, [sold]))
    store = medallion._Tables.store

    def failing(tables, df, table, layer):
        if table == medallion.ROLLUP_TABLE:
            raise OSError("no room")
        return store(tables, df, table, layer)

    with scratch_database(spark) as database:
        medallion.publish(before, database, fx.AS_OF)
        with monkeypatch.context() as patch:
            patch.setattr(medallion._Tables, "store", failing)
            with pytest.raises(OSError):
                medallion.refresh(bought, database, fx.AS_OF)
        layers, _ = medallion.refresh(bought, database, fx.AS_OF)
        assert {r.customer_id: r.total_transactions for r in layers.golden.collect()} == {"C1": 1, "C2": None}
