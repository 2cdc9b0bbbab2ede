"""Row numbers and running totals that no single task has to hold.

A window without a partition key, or over one customer who owns a third of the
rows, would sort everything in one task. Here the rows are range-partitioned by
the full order, written once so that slice numbers stay fixed if an executor is
lost, numbered inside each slice, and shifted by what lies in earlier slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.sources.scratch import cut_lineage

SLICE = "order_slice"
#: How far a quantile sketch's rank may be off, twice over.
SKETCH_MARGIN = 0.04


def _slices(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    ranged = df.repartitionByRange(*order).withColumn(SLICE, F.spark_partition_id())
    return cut_lineage(ranged, "slices")


def _shifts(sliced: DataFrame) -> DataFrame:
    """Rows before each slice; one row per slice, at most spark.sql.shuffle.partitions."""
    earlier = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sliced.groupBy(SLICE).agg(F.count("*").alias("n"))
    return sizes.select(SLICE, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))


def _numbered(sliced: DataFrame, order: Sequence[Column | str], out: str, limit: Column | None) -> DataFrame:
    """Ranks within slices, shifted. Slices that begin past ``limit`` go before the sort."""
    placed = sliced.join(F.broadcast(_shifts(sliced)), SLICE)
    if limit is not None:
        placed = placed.where(F.col("shift") < limit)
    local = F.row_number().over(Window.partitionBy(SLICE).orderBy(*order))
    return placed.withColumn(out, local + F.col("shift")).drop(SLICE, "shift")


def global_rank(df: DataFrame, order: Sequence[Column | str], out: str = "rank") -> DataFrame:
    """1, 2, 3, … over the whole table. ``order`` should end in a unique column."""
    return _numbered(_slices(df, order), order, out, None)


def _likely_top(df: DataFrame, by: str, limit: int) -> DataFrame:
    """The rows from a bound on, below which none of the ``limit`` greatest values lies.

    A mergeable quantile sketch gives the bound, a count makes sure of it.
    """
    value = F.col(by).cast("double")
    found = df.agg(F.count(by).alias("n"), F.kll_sketch_agg_double(value).alias("sketch")).first()
    rank = 1 - limit / found.n - SKETCH_MARGIN if found.n else 0.0
    if rank <= 0:
        return df
    sketch = F.lit(bytes(found.sketch))
    bound = df.sparkSession.range(1).select(F.kll_sketch_get_quantile_double(sketch, F.lit(rank))).first()[0]
    above = df.where(value >= bound)
    return above if above.count() >= limit else df


def top_share(
    df: DataFrame, of: DataFrame, share: Column, order: Sequence[Column | str], out: str = "rank", by: str | None = None
) -> DataFrame:
    """The first ``floor(share * rows of 'of')`` rows of ``df`` by ``order``.

    ``by`` names the column that ``order`` begins with, descending, nulls last: rows that
    cannot be among the first are then left out before anything is sorted. That reads
    ``df`` three times, so it pays for stored tables.
    """
    if by is not None:
        limit = int(of.select(F.floor(F.count("*") * share)).first()[0])
        top = _likely_top(df, by, limit)
        return _numbered(_slices(top, order), order, out, F.lit(limit)).where(F.col(out) <= limit)
    sliced = _slices(df, order)
    counted = sliced if of is df else of  # the stored slices know their rows already
    limit = counted.select(F.floor(F.count("*") * share)).scalar()
    return _numbered(sliced, order, out, limit).where(F.col(out) <= limit)


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: str, out: str
) -> DataFrame:
    """Sum of ``value`` from the key's first row to this one, in ``order``."""
    sliced = _slices(df, [*keys, *order])
    within = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.withColumn(out, F.sum(value).over(within))
    # Slices follow the keys, so a key needs a shift only where it crosses into a
    # further slice: fewer shifts than slices.
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy(*keys, SLICE).agg(F.sum(value).alias("total"))
    shift = (
        totals.withColumn("shift", F.sum("total").over(before))
        .where(F.col("shift").isNotNull())
        .drop("total")
    )
    rows, moved = local.alias("rows"), F.broadcast(shift).alias("moved")
    same = F.lit(True)
    for column in [*keys, SLICE]:
        same = same & F.col(f"rows.{column}").eqNullSafe(F.col(f"moved.{column}"))
    total = F.col(f"rows.{out}") + F.coalesce(F.col("moved.shift"), F.lit(0))
    kept = [F.col(f"rows.{c}") for c in df.columns]
    return rows.join(moved, same, "left").select(*kept, total.alias(out))
