"""Hard negatives by inner product, found through summaries of vector segments.

Vectors are cut into ``SEGMENTS`` segments of equal length L, and each segment's mean and
deviation are stored with the vector. Within a segment the product of two vectors is L
times the product of the means, plus or minus at most L times the product of the
deviations (Cauchy-Schwarz on what is left of the means). Summed over the segments these
are bounds on the score. A search first bounds by one segment that is the whole vector,
then by four, then by all sixteen, each time only the pairs that the bounds before could
not decide, and computes exact scores for those left.

There are two searches over the same lots. The first finds each anchor's positives: the
best rows of its label. The second finds, for every positive, the best rows of other
labels whose score lies within a share of the positive's, ``low`` to ``high`` per cent.
Anchors meet vectors in tasks of bounded size: lots of vectors are dealt by hash, so that
a hot label or a hot vector spreads over all of them, and a task gives back the k best
of its lot for each question.

Vectors that are null or hold null or non-finite components take no part, nor do rows
without a label or an id. Shorter vectors count as filled up with zeros. Scores are exact;
one that fits no long is an error that tells the ids. Equal scores go to the smaller id.
Repeated rows are candidates each, but ask once; rows that carry the anchor's own id are
never its positives or negatives. Equal positives get the same negatives. A negative
positive score has no negatives, since the shares then bound nothing. Empty tables give
no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.whole_numbers import floors, matrix, products
from shelfwise.sources.scratch import cut_lineage

#: Segments of a stored summary, and how many are taken as one at each level.
SEGMENTS, LEVELS = 16, (16, 4, 1)
#: Vectors of a lot, of a block of anchors, and of a step within a lot.
LOT, BLOCK, STEP = 32_768, 4_096, 2_048
LONGS = np.iinfo(np.int64)


def summaries(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean and the deviation of each segment; the last ones may be filled up with zeros."""
    rows, dimensions = vectors.shape
    length = max(1, math.ceil(dimensions / SEGMENTS))
    filled = np.zeros((rows, SEGMENTS * length))
    filled[:, :dimensions] = vectors
    segments = filled.reshape(rows, SEGMENTS, length)
    means = segments.mean(axis=2)
    return means, np.sqrt(((segments - means[:, :, None]) ** 2).mean(axis=2))


def coarser(means: np.ndarray, deviations: np.ndarray, together: int) -> tuple[np.ndarray, np.ndarray]:
    """The summaries of so many neighbouring segments taken as one."""
    grouped = means.reshape(len(means), -1, together)
    mean = grouped.mean(axis=2)
    inside = (deviations.reshape(grouped.shape) ** 2).mean(axis=2)
    return mean, np.sqrt(inside + ((grouped - mean[:, :, None]) ** 2).mean(axis=2))


@dataclass
class Vectors:
    """Rows of a task with their summaries at each level, scaled by the segment's length."""

    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]
    lengths: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, labels: np.ndarray, dimensions: int) -> Vectors:
        rows = matrix(table.column("vector"), dimensions)
        means, deviations = (
            table.column(n).combine_chunks().flatten().to_numpy().reshape(-1, SEGMENTS) for n in ("means", "deviations")
        )
        length = max(1, math.ceil(dimensions / SEGMENTS))
        levels = []
        for together in LEVELS:
            scale = math.sqrt(length * together)
            levels.append(tuple(scale * part for part in coarser(means, deviations, together)))
        lengths = np.sqrt((rows.astype(float) ** 2).sum(axis=1))
        return cls(table.column("vec_id").to_numpy(), labels, rows, levels, lengths)

    def at(self, index) -> Vectors:
        levels = [(means[index], deviations[index]) for means, deviations in self.levels]
        return Vectors(self.ids[index], self.labels[index], self.rows[index], levels, self.lengths[index])


class Questions:
    """Per question an anchor, the lowest and highest score wanted, and the k best so far."""

    def __init__(self, anchors: int, owner: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        order = np.argsort(owner, kind="stable")
        self.place, self.owner, self.low, self.high, self.k = order, owner[order], low[order], high[order], k
        #: The score that is needed, and the id to stay below at that very score.
        self.least, self.before = self.low.copy(), np.full(len(owner), LONGS.max)
        self.found = [np.zeros(0, np.int64) for _ in range(3)]  # question, score, id
        starts = np.searchsorted(self.owner, np.arange(anchors + 1))
        self.number = np.arange(len(owner)) - starts[self.owner]
        self.rounds = int(self.number.max()) + 1 if len(owner) else 0
        self.anchors = anchors

    def reach(self) -> tuple[np.ndarray, np.ndarray]:
        """The scores between which anything can still matter to each anchor. Without a
        bound that is everything, scores that fit no long included: they are errors."""
        low, high = np.full(self.anchors, np.inf), np.full(self.anchors, -np.inf)
        np.minimum.at(low, self.owner, np.where(self.least == LONGS.min, -np.inf, self.least.astype(float)))
        np.maximum.at(high, self.owner, np.where(self.high == LONGS.max, np.inf, self.high.astype(float)))
        return low, high

    def offer(self, rows: np.ndarray, scores: np.ndarray, near: np.ndarray, ids: np.ndarray) -> None:
        """Take over what of the scores of the anchors ``rows`` is among their k best."""
        position = np.full(self.anchors, -1)
        position[rows] = np.arange(len(rows))
        parts = [self.found]
        for number in range(self.rounds):
            asked = np.flatnonzero((self.number == number) & (position[self.owner] >= 0))
            if not len(asked):
                continue
            at = position[self.owner[asked]]
            some = scores[at]
            fits = near[at] & (some >= self.least[asked, None]) & (some <= self.high[asked, None])
            if some.shape[1] > self.k:
                kept = np.where(fits, some, LONGS.min)
                line = np.partition(kept, -self.k, axis=1)[:, -self.k]
                fits &= kept >= line[:, None]
            a, b = np.nonzero(fits)
            question, score, vec_id = asked[a], some[a, b], ids[b]
            new = (score > self.least[question]) | (vec_id < self.before[question])
            parts.append([x[new] for x in (question, score, vec_id)])
        question, score, vec_id = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((vec_id, -score, question))
        question, score, vec_id = question[order], score[order], vec_id[order]
        rank = np.arange(len(question)) - np.searchsorted(question, question)
        best = rank < self.k
        self.found = [x[best] for x in (question, score, vec_id)]
        last = rank == self.k - 1
        self.least[question[last]], self.before[question[last]] = score[last], vec_id[last]

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        question, score, vec_id = self.found
        return self.place[question], score, vec_id


def search(anchors: Vectors, questions: Questions, lot: Vectors, same_label: bool) -> int:
    """Put every question to a lot; gives the number of exact scores that were needed."""
    lot = lot.at(np.lexsort((lot.ids, -lot.lengths)))
    exact = 0
    for start in range(0, len(lot.ids), STEP):
        some = lot.at(slice(start, start + STEP))
        low, high = questions.reach()
        near = (anchors.labels[:, None] == some.labels[None, :]) == same_label
        near &= anchors.ids[:, None] != some.ids[None, :]
        rows, columns = _open(near)
        for (means, deviations), (others, their_deviations) in zip(anchors.levels, some.levels):
            if not len(rows):
                break
            middle = means[rows] @ others[columns].T
            spread = deviations[rows] @ their_deviations[columns].T
            # Rounding is far below a billionth of the lengths' product.
            spread += 1e-9 * anchors.lengths[rows, None] * some.lengths[columns][None, :] + 1e-6
            undecided = (middle + spread >= low[rows, None]) & (middle - spread <= high[rows, None])
            near[np.ix_(rows, columns)] &= undecided
            rows, columns = _open(near)
        for part in range(0, len(rows), 512):
            at = rows[part : part + 512]
            scores = products(anchors.rows[at], some.rows[columns], anchors.ids[at], some.ids[columns])
            questions.offer(at, scores, near[np.ix_(at, columns)], some.ids[columns])
            exact += scores.size
    return exact


def _open(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))


def _codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Labels of any type as numbers, equal ones alike."""
    whole = pa.chunked_array([chunk for c in columns for chunk in c.chunks], columns[0].type)
    codes = whole.combine_chunks().dictionary_encode().indices.to_numpy()
    return np.split(codes, np.cumsum([len(c) for c in columns])[:-1])


_FOUND = {"anchor_no": pa.int64(), "low": pa.int64(), "high": pa.int64(), "score": pa.int64(), "vec_id": pa.int64()}


def _task(dimensions: int, k: int, same_label: bool):
    def run(key: tuple, asking: pa.Table, lot: pa.Table) -> pa.Table:
        empty = pa.table({n: pa.array([], t) for n, t in _FOUND.items()})
        if not asking.num_rows or not lot.num_rows:
            return empty
        codes = _codes(asking.column("label"), lot.column("label"))
        anchors, vectors = Vectors.of(asking, codes[0], dimensions), Vectors.of(lot, codes[1], dimensions)
        ranges = asking.column("ranges").to_pylist()
        numbers = asking.column("anchor_no").to_numpy()
        labels = np.unique(codes[0]).tolist() if same_label else [None]
        tables = [empty]
        for label in labels:  # a label's anchors meet only that label's vectors
            own = np.arange(len(numbers)) if label is None else np.flatnonzero(codes[0] == label)
            others = vectors if label is None else vectors.at(codes[1] == label)
            asked = [(i, r["low"], r["high"]) for i, a in enumerate(own) for r in ranges[a]]
            if not len(others.ids) or not asked:
                continue
            owner, low, high = (np.array(x, np.int64) for x in zip(*asked))
            questions = Questions(len(own), owner, low, high, k)
            search(anchors.at(own), questions, others, same_label)
            question, score, vec_id = questions.results()
            columns = [numbers[own[owner[question]]], low[question], high[question], score, vec_id]
            tables.append(pa.table([pa.array(c, t) for c, t in zip(columns, _FOUND.values())], names=list(_FOUND)))
        return pa.concat_tables(tables)

    return run


def _summarised(dimensions: int):
    """Adds the segments' means and deviations."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                some = batch.slice(start, 4096)
                columns = [some.column(n) for n in some.schema.names]
                rows = matrix(some.column("vector"), dimensions).astype(float)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), SEGMENTS) for x in summaries(rows)]
                names = [*some.schema.names, "means", "deviations"]
                yield pa.RecordBatch.from_arrays([*columns, *(x.cast(pa.list_(pa.float64())) for x in lists)], names=names)

    return run


def _dealt(asking: DataFrame, stored: DataFrame, lots: int, blocks: int):
    """Blocks of anchors beside lots of vectors, every block once with every lot."""

    def numbers(count: int):
        return F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))

    spread = stored.withColumn("lot", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(lots)))
    spread = spread.withColumn("block", F.explode(numbers(blocks)))
    dealt = asking.withColumn("block", F.pmod(F.col("anchor_no"), F.lit(blocks)))
    dealt = dealt.withColumn("lot", F.explode(numbers(lots)))
    return dealt.groupBy("block", "lot").cogroup(spread.groupBy("block", "lot"))


def mine(
    vectors: DataFrame, anchors: DataFrame, scale: float, positives: int = 5, negatives: int = 5,
    low: int = 80, high: int = 100,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``vectors`` and ``anchors`` have ``(vec_id, embedding, label)``. For each of an
    anchor's best ``positives`` rows of its label come the best ``negatives`` rows of
    other labels with ``low * positive_score <= 100 * score <= high * positive_score``.
    """

    def whole(table: DataFrame) -> DataFrame:
        vec_id = F.col("vec_id").cast("long")
        chosen = table.select(vec_id.alias("vec_id"), "label", floors(F.col("embedding"), scale, vec_id).alias("vector"))
        return chosen.where("vec_id is not null and label is not null and vector is not null")

    chosen, asked = whole(vectors), whole(anchors)
    sizes = [t.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first() for t in (chosen, asked)]
    dimensions = max(1, *(size.d or 0 for size in sizes))
    kind = chosen.schema["label"].dataType.simpleString()
    summarised = f"vec_id long, label {kind}, vector array<bigint>, means array<double>, deviations array<double>"
    stored = cut_lineage(chosen.mapInArrow(_summarised(dimensions), summarised), "vectors")
    asked = asked.withColumn("label", F.col("label").cast(kind)).distinct()
    numbered = asked.mapInArrow(_summarised(dimensions), summarised).withColumn("anchor_no", F.monotonically_increasing_id())
    asked = cut_lineage(numbered, "anchors")  # written, so that the numbers stay

    cores = stored.sparkSession.sparkContext.defaultParallelism
    lots = max(1, math.ceil(sizes[0].n / LOT), min(cores, sizes[0].n // STEP))
    blocks = max(1, math.ceil(sizes[1].n / BLOCK))
    schema = ", ".join(f"{n} long" for n in _FOUND)

    def best(asking: DataFrame, k: int, same_label: bool) -> DataFrame:
        met = _dealt(asking, stored, lots, blocks)
        found = met.applyInArrow(_task(dimensions, k, same_label), schema)
        order = Window.partitionBy("anchor_no", "low", "high").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def span(least, most):
        return F.struct(least.cast("long").alias("low"), most.cast("long").alias("high"))

    anything = F.array(span(F.lit(int(LONGS.min)), F.lit(int(LONGS.max))))
    nearest = best(asked.withColumn("ranges", anything), positives, True)
    nearest = cut_lineage(nearest.select("anchor_no", F.col("vec_id").alias("positive_id"), "score"), "positives")

    wide = F.col("score").cast("decimal(20,0)")
    bounds = [F.ceil(wide * F.lit(low) / 100), F.floor(wide * F.lit(high) / 100)]
    wanted = nearest.withColumns({"low": bounds[0].cast("long"), "high": bounds[1].cast("long")}).where("low <= high")
    ranges = wanted.groupBy("anchor_no").agg(F.collect_set(span(F.col("low"), F.col("high"))).alias("ranges"))
    hard = best(asked.join(ranges, "anchor_no"), negatives, False)
    return (
        wanted.join(hard.withColumnRenamed("score", "negative_score"), ["anchor_no", "low", "high"])
        .join(asked.select("anchor_no", F.col("vec_id").alias("anchor_id")), "anchor_no")
        .select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"),
            F.col("score").alias("positive_score"), "negative_score",
        )
    )
