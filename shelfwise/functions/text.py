"""Text and array helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_strings(text: Column) -> Column:
    """JSON text -> array of strings; malformed text -> null."""
    return F.from_json(text, "array<string>")


def display_name(first: Column, last: Column) -> Column:
    return F.concat_ws(" ", first, last)


def customer_label(first: Column, last: Column, customer_id: Column) -> Column:
    return F.format_string("%s (%s)", display_name(first, last), customer_id.cast("string"))


def id_suffix(customer_id: Column, length: int = 4) -> Column:
    return F.right(customer_id.cast("string"), F.lit(length))


def dollars(amount: Column, places: int = 2) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount.cast("decimal(18,2)"), places))


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def percent(share: Column) -> Column:
    """0.94 -> 94%."""
    return F.concat(F.round(share * 100, 0).cast("int").cast("string"), F.lit("%"))


def one_decimal(number: Column) -> Column:
    return F.round(number, 1).cast("decimal(18,1)").cast("string")


def words(text: Column) -> Column:
    """Lower-case alphanumeric words of the whole text, in order, repeats kept."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")
