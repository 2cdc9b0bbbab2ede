"""Hot keys of joins, found by a mergeable sketch and spread over several tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that a sketch can name, counters it keeps, and parts that a hot key is spread over.
MOST_KEYS, COUNTERS, PARTS = 32, 4096, 32
#: A key with this share of the rows would hold up a join.
HOT_SHARE = 0.02


def heavy_hitters(df: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """Keys with about ``share`` of all rows or more, the most frequent first, at most
    ``MOST_KEYS``. Rows without a key name none."""
    known = F.col(key).isNotNull()
    sketch = F.call_function("approx_top_k", F.col(key), F.lit(MOST_KEYS), F.lit(COUNTERS))
    found = df.where(known).select(F.col(key)).agg(sketch.alias("top"), F.count("*").alias("n")).first()
    return [entry["item"] for entry in found.top or [] if entry["count"] >= share * found.n]


def salted(key: Column, hot: Sequence, spread_by: Column) -> Column:
    """A second join key for the side with many rows: a part of a hot key, else its hash."""
    part = F.pmod(F.xxhash64(spread_by), F.lit(PARTS))
    return F.when(key.isin(list(hot)), part).otherwise(F.xxhash64(key)) if hot else F.xxhash64(key)


def repeated(df: DataFrame, key: str, hot: Sequence, name: str) -> DataFrame:
    """The other side: its hot rows once for every part, all others once."""
    every = F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))
    once = F.array(F.xxhash64(key))
    parts = F.when(F.col(key).isin(list(hot)), every).otherwise(once) if hot else once
    return df.withColumn(name, F.explode(parts))
