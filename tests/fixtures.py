"""Hand-written rows in the shape of the input tables."""

from __future__ import annotations

from datetime import datetime

from shelfwise import schemas

AS_OF = "2026-03-05 12:00:00"


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def _rows(spark, schema, rows):
    frame = spark.createDataFrame([], schema)
    names = frame.columns
    return spark.createDataFrame([tuple(row.get(n) for n in names) for row in rows], schema)


def products(spark, rows):
    base = {"brand": "B", "subcategory": "S", "color": "Black", "description": "", "style_tags": "[]"}
    return _rows(spark, schemas.PRODUCTS, [{**base, **r} for r in rows])


def customers(spark, rows):
    base = {"first_name": "Ann", "last_name": "Lee", "email": "a@example.com", "credit_card_last4": "0042"}
    return _rows(spark, schemas.CUSTOMERS, [{**base, **r} for r in rows])


def purchases(spark, rows):
    return _rows(spark, schemas.PURCHASES, rows)


def clicks(spark, rows):
    numbered = [{"event_id": f"E{i:03}", "customer_id": "C1", "session_id": "S1", **r} for i, r in enumerate(rows)]
    return _rows(spark, schemas.CLICKSTREAM, numbered)


def points(spark, rows):
    return _rows(spark, schemas.POINTS_EVENTS, rows)


def dicts(df, *order):
    return [row.asDict() for row in df.orderBy(*order).collect()]
