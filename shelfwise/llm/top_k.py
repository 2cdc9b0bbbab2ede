"""Exact top-k search by inner product over vectors sorted by length.

Vectors are integers. They are rotated by the singular vectors of all of them, so that
the first coordinates carry most of a product. A query block meets a lot in a task of
bounded size and goes through it step by step, the longest vectors first: once the query's length times the longest vector
left cannot reach the query's k-th best score, the rest is skipped; before that, the
product of the first rotated coordinates plus the product of the remaining lengths (the
Cauchy-Schwarz bound) decides which vectors get an exact product. The k-th best score
starts from the products with the longest vectors of all, a bounded set that the
queries take along.

Lots are cut from the order by length, each a stretch of it, so a query meets only the
lots whose longest vector can still reach its k-th best score. Queries are put in blocks
by the length of vector that they need: a block that needs long ones skips all lots after
those, and vectors are copied only for the blocks that can use them.

Vectors that are null or hold null or non-finite components take no part. Shorter
vectors count as filled up with zeros. Scores are exact; one that fits no long is an
error that tells the ids. Equal scores go to the smaller id. Repeated
rows are candidates each, but ask once; rows of one query id ask together. Rows that
carry the query's own id are never its candidates. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.whole_numbers import floors, matrix, products
from shelfwise.sources.scratch import cut_lineage

#: Vectors of a lot, of a query block, of a step within a lot, and of the starting set.
LOT, QUERY_BLOCK, STEP, LONGEST = 32_768, 2_048, 2_048, 1_024
#: Bands of lengths; each is dealt into as many lots as it needs.
MOST_BANDS = 1_024
#: Rotated coordinates in the first partial product, as a share of all.
LEADING = 0.25


def rotation(vectors: DataFrame, dimensions: int) -> np.ndarray:
    """The right singular vectors of all vectors, strongest first.

    They are the eigenvectors of the sum of outer products, which each task adds up
    for its rows; the driver adds as many matrices as there are tasks, pairwise sums
    being done by Spark.
    """

    def gram(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimensions, dimensions))
        for batch in batches:
            some = matrix(batch.column("vector"), dimensions).astype(float)
            total += some.T @ some
        place = np.arange(dimensions * dimensions)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total.ravel())], names=["place", "value"])

    sums = vectors.select("vector").mapInArrow(gram, "place long, value double")
    entries = sums.groupBy("place").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(dimensions * dimensions)
    for entry in entries:
        total[entry.place] = entry.value
    square = total.reshape(dimensions, dimensions)
    return np.linalg.eigh((square + square.T) / 2)[1][:, ::-1]


class Best:
    """The k best ``(score, smaller id)`` of each query of a block."""

    def __init__(self, count: int, k: int):
        self.k = k
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(count)]
        self.least = np.full(count, -np.inf)

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        heap = self.heaps[query]
        for score, vec_id in zip(scores.tolist(), ids.tolist()):
            entry = (score, -vec_id)
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
        if len(heap) == self.k:
            self.least[query] = max(self.least[query], heap[0][0])


def search_lot(
    queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray,
    basis: np.ndarray, least: np.ndarray, k: int,
) -> Best:
    """The k best of a lot for each query; ``least`` are scores known to be reached."""
    best = Best(len(queries), k)
    best.least = np.maximum(best.least, least)
    lengths = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
    order = np.lexsort((ids, -lengths))
    vectors, ids, lengths = vectors[order], ids[order], lengths[order]
    lead = max(1, math.ceil(basis.shape[1] * LEADING))
    turned = queries.astype(float) @ basis
    rest = np.sqrt((turned[:, lead:] ** 2).sum(axis=1))
    query_lengths = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
    for start in range(0, len(vectors), STEP):
        some, names = vectors[start : start + STEP], ids[start : start + STEP]
        # Rounding is far below half a unit per product of this size.
        slack = 1e-9 * (query_lengths * lengths[start]) + 1e-6
        open_ = np.flatnonzero(query_lengths * lengths[start] + slack >= best.least)
        if not len(open_):
            break
        spun = some @ basis
        bound = turned[open_, :lead] @ spun[:, :lead].T
        bound += rest[open_, None] * np.sqrt((spun[:, lead:] ** 2).sum(axis=1))[None, :]
        near = bound + slack[open_, None] >= best.least[open_, None]
        wanted = np.flatnonzero(near.any(axis=1))
        if not len(wanted):
            continue
        for part in range(0, len(wanted), 256):
            at = wanted[part : part + 256]
            scores = products(queries[open_[at]], some, query_ids[open_[at]], names)
            for row, query in zip(range(len(at)), open_[at]):
                fits = near[at[row]] & (scores[row] >= best.least[query]) & (names != query_ids[query])
                found = np.flatnonzero(fits)
                if len(found) > k:
                    # The k best and all that tie with the last of them.
                    line = np.partition(scores[row][found], len(found) - k)[len(found) - k]
                    found = found[scores[row][found] >= line]
                if len(found):
                    best.add(query, names[found], scores[row][found])
    return best


def _banded(table: DataFrame, column: str, rows: int, most: int) -> DataFrame:
    """``table`` stored with ``band``: stretches of about ``most`` rows in the order of
    ``column``, between approximate quantiles."""
    count = min(max(1, math.ceil(rows / most)), MOST_BANDS)
    shares = [i / count for i in range(1, count)]
    bounds = sorted(set(table.approxQuantile(column, shares, 0.1 / count))) if shares else []
    if not bounds:
        return table.withColumn("band", F.lit(0).cast("long"))
    cut = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol=column, outputCol="band")
    return cut_lineage(cut.transform(table).withColumn("band", F.col("band").cast("long")), "bands")


def _parts(rows: int, most: int) -> int:
    """Lots of a band, several where it holds many rows or one hot vector."""
    return max(1, math.ceil(rows / (2 * most)))


def _numbered(table: DataFrame, places: list[tuple[int, int, int, int]], own: str, other: str) -> DataFrame:
    """``table`` dealt into the lots of its bands, once for each lot of the other side that
    its band meets: these are the first ones in their order."""
    bands = table.sparkSession.createDataFrame(places, "band long, first long, parts long, meets long")
    part = F.pmod(F.xxhash64("vec_id", "vector"), F.col("parts"))
    met = F.explode(F.sequence(F.lit(0).cast("long"), F.col("meets") - 1))
    placed = table.join(bands.where("meets > 0"), "band").withColumn(own, F.col("first") + part)
    return placed.withColumn(other, met).drop("band", "first", "parts", "meets")


def meetings(tops: list[tuple], lows: list[tuple], lot: int, block: int) -> tuple[list[tuple], list[tuple]]:
    """Places ``(band, first lot, lots, lots met on the other side)`` of both sides' bands.

    ``tops`` has ``(band, rows, greatest length)`` of the vectors' bands, ``lows`` has
    ``(band, rows, least length needed)`` of the queries'. Vectors' lots are numbered from
    the longest down, queries' from those that need least up. So whatever a band meets
    are the first lots of the other side.
    """
    tops, lows = sorted(tops, key=lambda band: -band[2]), sorted(lows, key=lambda band: band[2])
    lot_parts, block_parts = [_parts(n, lot) for _, n, _ in tops], [_parts(n, block) for _, n, _ in lows]
    lots, blocks = np.append(0, np.cumsum(lot_parts)), np.append(0, np.cumsum(block_parts))
    reach = np.searchsorted([-top for _, _, top in tops], [-low for _, _, low in lows], side="right")
    reached = np.searchsorted([low for _, _, low in lows], [top for _, _, top in tops], side="right")
    vectors = [(band, int(lots[i]), lot_parts[i], int(blocks[reached[i]])) for i, (band, _, _) in enumerate(tops)]
    queries = [(band, int(blocks[i]), block_parts[i], int(lots[reach[i]])) for i, (band, _, _) in enumerate(lows)]
    return vectors, queries


def top_k(vectors: DataFrame, queries: DataFrame, k: int, scale: float) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best of ``vectors(vec_id, embedding)``
    for each row of ``queries(vec_id, embedding)``, all if there are fewer."""

    def whole(table: DataFrame) -> DataFrame:
        vec_id = F.col("vec_id").cast("long")
        chosen = table.select(vec_id.alias("vec_id"), floors(F.col("embedding"), scale, vec_id).alias("vector"))
        length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x))
        return chosen.where("vector is not null and vec_id is not null").withColumn("length", length)

    stored = cut_lineage(whole(vectors), "vectors")
    asked = cut_lineage(whole(queries).distinct(), "queries")
    sizes = stored.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    asked_sizes = asked.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    dimensions = max(sizes.d or 1, asked_sizes.d or 1, 1)
    basis = rotation(stored, dimensions)
    longest = stored.orderBy(F.desc("length"), "vec_id").limit(LONGEST).collect()
    start_ids = np.array([row.vec_id for row in longest], np.int64)
    start = matrix(pa.array([row.vector for row in longest], pa.list_(pa.int64())), dimensions)

    def needs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The score that each query is sure to reach k times, and the length it takes."""
        for batch in batches:
            for first in range(0, batch.num_rows, QUERY_BLOCK):
                some = batch.slice(first, QUERY_BLOCK)
                ids = some.column("vec_id").to_numpy()
                least = _least(matrix(some.column("vector"), dimensions), ids, start, start_ids, k)
                length = np.maximum(some.column("length").to_numpy(), 1e-9)
                # A little less than needed, for rounding.
                need = np.maximum(least / length * (1 - 1e-9) - 1e-6, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, pa.array(least), pa.array(need)], names=[*some.schema.names, "least", "need"]
                )

    needing = asked.mapInArrow(needs, "vec_id long, vector array<bigint>, length double, least double, need double")
    needing = cut_lineage(needing, "needing")
    lot_size = min(LOT, max(STEP, math.ceil(sizes.n / _cores(stored))))
    lots = _banded(stored, "length", sizes.n, lot_size)
    blocks = _banded(needing, "need", asked_sizes.n, QUERY_BLOCK)
    # A row per band, one for some thousands of vectors or queries.
    tops = lots.groupBy("band").agg(F.count("*").alias("n"), F.max("length").alias("top")).collect()
    lows = blocks.groupBy("band").agg(F.count("*").alias("n"), F.min("need").alias("low")).collect()
    places = meetings([tuple(r) for r in tops], [tuple(r) for r in lows], lot_size, QUERY_BLOCK)
    lots = _numbered(lots.select("vec_id", "vector", "band"), places[0], "lot", "block")
    blocks = _numbered(blocks.select("vec_id", "vector", "least", "band"), places[1], "block", "lot")

    def search(key: tuple, asked: pa.Table, lot: pa.Table) -> pa.Table:
        if not asked.num_rows or not lot.num_rows:
            return pa.table({n: pa.array([], t) for n, t in _FOUND})
        query_ids = asked.column("vec_id").to_numpy()
        wanted, some = matrix(asked.column("vector"), dimensions), matrix(lot.column("vector"), dimensions)
        least = asked.column("least").to_numpy()
        best = search_lot(wanted, query_ids, some, lot.column("vec_id").to_numpy(), basis, least, k)
        rows = [(int(q), score, -name) for q, heap in zip(query_ids, best.heaps) for score, name in heap]
        columns = list(zip(*rows)) or [[], [], []]
        return pa.table({n: pa.array(c, t) for (n, t), c in zip(_FOUND, columns)})

    met = blocks.groupBy("block", "lot").cogroup(lots.groupBy("block", "lot"))
    found = met.applyInArrow(search, "query_id long, score long, vec_id long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


_FOUND = [("query_id", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64())]


def _cores(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def _least(
    wanted: np.ndarray, query_ids: np.ndarray, start: np.ndarray, start_ids: np.ndarray, k: int
) -> np.ndarray:
    """A score each query is sure to reach k times: its k-th best with the starting set."""
    least = np.full(len(wanted), -np.inf)
    if len(start_ids) <= k:
        return least
    scores = products(wanted, start, query_ids, start_ids).astype(float)
    scores[query_ids[:, None] == start_ids[None, :]] = -np.inf
    return np.partition(scores, len(start_ids) - k, axis=1)[:, len(start_ids) - k]
