"""Rows carried whole, whatever their columns are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW, KEY = "whole_row", "row_key"


def whole_row() -> Column:
    """A struct of all columns; ``select(f"{ROW}.*")`` gives them back as they were."""
    return F.struct("*").alias(ROW)


def row_key() -> Column:
    """A key of 128 bits that rows share only if all their columns are alike."""
    return F.md5(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).alias(KEY)


def back(rows: DataFrame) -> DataFrame:
    return rows.select(f"{ROW}.*")
