"""Every registered query against the same query in DuckDB."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_points
from shelfwise.plans.oracle import RESULTS, oracle
from shelfwise.plans.queries import REGISTRY
from tests.compare import connect, difference
from tests.conftest import DATA

SF_DIR = os.environ.get("CHECK_SF_DIR", f"{DATA}/sf0.01")
QUERIES = REGISTRY
SQL = {name: oracle(name) for name in RESULTS}
#: Queries that promise an order, beside the rows.
ORDERED = ("vip", "trending", "similar_text", "similar_text_filtered", "indexed_text", "indexed_text_filtered", "one_customer")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, SF_DIR), duck, SQL[name], ordered=name in ORDERED) is None


def test_all_queries_are_entry_points():
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(SQL) <= set(entry_points.oracle_sql())


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_has_rows_and_a_stable_schema(spark):
    first, second = entry_points.entry(spark), entry_points.entry(spark)
    assert first.schema == second.schema
    assert first.count() > 0
