"""Compare a Spark result with the same query in DuckDB, value by value."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        if os.path.exists(path):
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return connection


def _value(value):
    if value is None:
        return ("", "")
    if isinstance(value, bool):
        return ("b", str(value))
    if isinstance(value, (int, float, decimal.Decimal)):
        return ("n", repr(float(value) + 0.0))
    if isinstance(value, datetime.datetime):
        return ("t", value.replace(tzinfo=None).isoformat())
    return ("s", str(value))


def _rows(columns, rows, ordered):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    values = [tuple(_value(row[i]) for i in order) for row in rows]
    return values if ordered else sorted(values)


def difference(df, connection, sql: str, ordered: bool = False) -> str | None:
    """What differs first, or None. ``ordered`` compares the order of the rows too."""
    cursor = connection.execute(sql)
    expected_columns = [d[0] for d in cursor.description]
    if sorted(df.columns) != sorted(expected_columns):
        return f"columns {sorted(df.columns)} != {sorted(expected_columns)}"
    expected = _rows(expected_columns, cursor.fetchall(), ordered)
    actual = _rows(df.columns, [tuple(row) for row in df.collect()], ordered)
    if not expected:
        return "the SQL gives no rows"
    if len(actual) != len(expected):
        return f"{len(actual)} rows != {len(expected)}"
    for mine, theirs in zip(actual, expected):
        if mine != theirs:
            return f"first difference in {sorted(df.columns)}:\n  {mine}\n  {theirs}"
    return None
