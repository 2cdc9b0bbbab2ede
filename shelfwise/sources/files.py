"""CSV and parquet scans with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise import schemas

# Cells hold JSON arrays, so quotes inside a cell are doubled; without ``escape``
# the reader would shift the columns behind such a cell. Columns go by position, so
# a header that does not name them in the schema's order is an error.
CSV_OPTIONS = {
    "header": "true",
    "enforceSchema": "false",
    "escape": '"',
    "timestampFormat": "yyyy-MM-dd HH:mm:ss",
}
MALFORMED = "malformed_row"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)


def malformed_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows with too few or too many cells, or with cells of another type, and their raw
    text as ``malformed_row``; ``read_csv`` reads such cells as null."""
    reader = spark.read.schema(f"{schema}, {MALFORMED} string").options(**CSV_OPTIONS)
    rows = reader.option("enforceSchema", "true").option("columnNameOfCorruptRecord", MALFORMED).csv(path)
    return rows.where(F.col(MALFORMED).isNotNull())


def read_products(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.PRODUCTS)


def read_customers(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.CUSTOMERS)


def read_purchases(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.PURCHASES)


def read_clickstream(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.CLICKSTREAM)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)
