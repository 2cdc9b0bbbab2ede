"""Co-purchase pairs against counting every pair of every basket."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from decimal import Decimal
from itertools import combinations

import pytest

from shelfwise.operators import co_purchase


def plain(rows, least: str, least_buyers: int):
    buyers, baskets = defaultdict(set), defaultdict(set)
    for customer, product in rows:
        if customer is not None and product is not None:
            buyers[product].add(customer)
            baskets[customer].add(product)
    shared = Counter(pair for basket in baskets.values() for pair in combinations(sorted(basket), 2))
    found = set()
    for (a, b), n in shared.items():
        sizes = len(buyers[a]) * len(buyers[b])
        if Decimal(n * n) >= Decimal(least) ** 2 * sizes and min(len(buyers[a]), len(buyers[b])) >= least_buyers:
            found.add((a, b, n, round(n / sizes**0.5, 6)))
    return found


def shopping(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for customer in range(80):
        favourite = rng.randrange(6)
        for _ in range(rng.randint(1, 8)):
            rows.append((f"C{customer}", f"P{favourite * 5 + rng.randrange(5) if rng.random() < 0.7 else rng.randrange(40)}"))
    rows += [("huge", f"P{i}") for i in range(40)] + [(f"C{i}", "best") for i in range(70)]
    return rows + rows[:30] + [(None, "P1"), ("C1", None), (None, None)]


@pytest.mark.parametrize("least, least_buyers", [("0.15", 2), ("0.5", 2), ("0.6", 5), ("1", 1)])
def test_pairs_equal_counting_every_basket(spark, least, least_buyers):
    rows = shopping(4) + [("twin", "T1"), ("twin", "T2")]
    table = spark.createDataFrame(rows, "customer_id string, product_id string").repartition(3)
    found = {tuple(r) for r in co_purchase.co_purchase_pairs(table, Decimal(least), least_buyers).collect()}
    assert found == plain(rows, least, least_buyers)
    assert found


def test_sets_are_checked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(co_purchase, "PART", 7)
    rows = shopping(9)
    table = spark.createDataFrame(rows, "customer_id string, product_id string")
    found = {tuple(r) for r in co_purchase.co_purchase_pairs(table, Decimal("0.3")).collect()}
    assert found == plain(rows, "0.3", 2)


@pytest.mark.parametrize("light, part", [(0, 3), (4, 5), (7, 4096)])
@pytest.mark.parametrize("least", ["0.2", "0.45"])
def test_customers_with_more_products_than_a_list_holds(spark, monkeypatch, light, part, least):
    monkeypatch.setattr(co_purchase, "LIGHT", light)
    monkeypatch.setattr(co_purchase, "PART", part)
    rows = shopping(light)
    table = spark.createDataFrame(rows, "customer_id string, product_id string")
    found = {tuple(r) for r in co_purchase.co_purchase_pairs(table, Decimal(least)).collect()}
    assert found == plain(rows, least, 2)
    assert found


def test_only_pairs_that_reach_the_cosine_are_stored(spark, monkeypatch):
    """Without huge baskets a pair that shares a buyer or two never leaves its task."""
    rng = random.Random(5)
    rows = [(f"C{c}", f"P{p}") for c in range(300) for p in rng.sample(range(200), 20)]
    table = spark.createDataFrame(rows, "customer_id string, product_id string")
    stored = []
    write = co_purchase.cut_lineage

    def counted(df, purpose):
        written = write(df, purpose)
        if purpose == "candidates":
            stored.append(written.count())
        return written

    monkeypatch.setattr(co_purchase, "cut_lineage", counted)
    found = co_purchase.co_purchase_pairs(table, Decimal("0.2")).count()
    assert 0 < found and stored == [found]


def test_a_huge_basket_is_not_paired_with_itself(spark):
    """Thousands of products in one basket, each with a few other buyers of its own."""
    rows = [("huge", f"P{i}") for i in range(1500)] + [(f"C{i}-{j}", f"P{i}") for i in range(1500) for j in range(5)]
    table = spark.createDataFrame(rows, "customer_id string, product_id string")
    joined = []
    write = co_purchase.cut_lineage

    def counted(df, purpose):
        stored = write(df, purpose)
        if purpose == "candidates":
            joined.append(stored.count())
        return stored

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(co_purchase, "cut_lineage", counted)
        assert co_purchase.co_purchase_pairs(table, Decimal("0.5")).count() == 0
    assert joined == [0], "the shared buyer lies outside every prefix"


def test_nothing_bought(spark):
    table = spark.createDataFrame([], "customer_id string, product_id string")
    assert co_purchase.co_purchase_pairs(table, Decimal("0.5")).count() == 0
    with pytest.raises(ValueError):
        co_purchase.co_purchase_pairs(table, Decimal(0))
