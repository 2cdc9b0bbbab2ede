"""How far the vocabulary of each source lies from the other sources of its language.

Terms are counted per language and source in the tasks that read the texts. A language
keeps the terms of at least ``least_documents`` of its documents (rows). Each group (a
language's source) and each language gives every kept term of its vocabulary V the share
``p = 1 + floor(UNITS * (count + SMOOTH) / (N + SMOOTH * V))``, N being its counts of kept
terms together. Pairs of sources are compared by ``sum |p - q|`` over V.

The vocabulary is put in an order that brings equal counts together: by the counts in
the language's largest sources, the smallest of those first, then by the language's own
count. In that order a group's shares form runs of one value, most of them the share of a
term that it does not have. Slices of the order are run-length encoded group by group,
and the sum of a pair is taken run by run: where the runs of both overlap, the difference
once, times the length. Sources meet in blocks of ``BLOCK`` for each slice of ``SLICE``
terms, so a task holds two blocks of one slice however large the language or a source is.

All sums and shares are whole numbers. Null texts, languages and sources count as empty.
A group without terms is a group, and a language without kept terms has distance 0
between its sources. Ties go to the smaller item in UTF-8. Repeated rows count as often
as they stand. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.operators.ordering import running_total
from shelfwise.sources.scratch import cut_lineage

LEAST_DOCUMENTS, TERMS_SHOWN = 30, 50
UNITS, SMOOTH = 1_000_000_000, 5
#: Terms of a slice, sources of a block, largest sources in the order, counts held by a task.
SLICE, BLOCK, LEADING, HELD = 16_384, 64, 8, 800_000
#: Counts below this times ``UNITS`` fit a long.
SMALL = 9_000_000_000

#: Bytes that part terms become spaces, capitals become small; letters and all bytes of
#: characters beyond ASCII stay.
_TERM_BYTES = bytes(
    b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def terms(text: str) -> list[bytes]:
    """The terms of a text: runs of letters and of characters beyond ASCII, A-Z lowered."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(lang, source, term, n, documents)``, as often as the task's memory of
    ``HELD`` terms is full. A group's own row has no term."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def emptied() -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, documents) in groups.items():
            size = len(counts) + 1
            columns = [
                pa.repeat(pa.scalar(lang, pa.string()), size),
                pa.repeat(pa.scalar(source, pa.string()), size),
                pa.array([None, *counts], pa.binary()),
                pa.array([0, *counts.values()], pa.int64()),
                pa.array([0, *map(documents.__getitem__, counts)], pa.int64()),
            ]
            batch = pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "documents"])
            for start in range(0, batch.num_rows, 10_000):
                yield batch.slice(start, 10_000)
        groups.clear()

    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            some = batch.slice(start, 64)
            for lang, source, text in zip(*(some.column(c).to_pylist() for c in ("lang", "source", "text"))):
                counts, documents = groups.setdefault((lang, source), (Counter(), Counter()))
                words = terms(text)
                counts.update(words)
                documents.update(set(words))
            if sum(len(counts) + 1 for counts, _ in groups.values()) > HELD:
                yield from emptied()
    yield from emptied()


def count_terms(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, documents)`` over ``docs(text, lang, source)``; the row
    with a null term stands for the group itself."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    parts = docs.select(*columns).mapInArrow(_counted, "lang string, source string, term binary, n long, documents long")
    parts = parts.withColumn("term", F.col("term").cast("string"))
    # The tasks have added up already: dealing their rows out first saves adding again before the shuffle.
    keys = ["lang", "source", "term"]
    return parts.repartition(*keys).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(UNITS * (count + SMOOTH) / (total + SMOOTH * kept))``, in whole numbers;
    null where nothing is kept."""
    below = F.nullif(total + kept * F.lit(SMOOTH).cast("long"), F.lit(0).cast("long"))
    small = F.call_function("div", (count + SMOOTH) * F.lit(UNITS).cast("long"), below)
    wide = ((count.cast("decimal(20,0)") + F.lit(SMOOTH)) * F.lit(UNITS)).cast("decimal(37,0)")
    large = F.call_function("div", wide, below.cast("decimal(37,0)")).cast("long")
    return F.when(count < SMALL, small).otherwise(large) + 1


def _placed(kept: DataFrame, counts: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, term, place)``: each language's kept terms, equal counts side by side."""
    by_size = Window.partitionBy("lang").orderBy(F.desc("total"), "source")
    leading = groups.withColumn("lead", F.row_number().over(by_size)).where(F.col("lead") <= LEADING)
    lead_counts = counts.join(leading.select("lang", "source", "lead"), ["lang", "source"])
    count_in = [F.coalesce(F.sum(F.when(F.col("lead") == i, F.col("n"))), F.lit(0)) for i in range(LEADING, 0, -1)]
    vectors = lead_counts.groupBy("lang", "term").agg(F.array(*count_in).alias("vector"))
    ordered = kept.join(vectors, ["lang", "term"], "left").select("lang", "term", "vector", "n", F.lit(1).alias("one"))
    placed = running_total(ordered, ["lang"], ["vector", "n", "term"], "one", "place")
    return placed.select("lang", "term", (F.col("place") - 1).alias("place"))


def run_lengths(places: np.ndarray, shares: np.ndarray, absent: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends and values of the runs of ``size`` places, of which ``places`` hold
    ``shares`` and the others ``absent``."""
    column = np.full(size, absent, np.int64)
    column[places] = shares
    last = np.flatnonzero(np.append(column[1:] != column[:-1], True)) if size else np.zeros(0, np.int64)
    return last + 1, column[last]


def _encoded(key: tuple, group: pa.Table) -> pa.Table:
    """One group's runs in one slice."""
    found = {n: group.column(n).to_numpy() for n in ("at", "p")}
    known = found["at"] >= 0
    size, absent = group.column("size")[0].as_py(), group.column("absent")[0].as_py()
    ends, values = run_lengths(found["at"][known], found["p"][known], absent, size)
    lists = [pa.array([x.tolist()], pa.list_(t)) for x, t in ((ends, pa.int32()), (values, pa.int64()))]
    first = [group.column(n).slice(0, 1).combine_chunks() for n in ("lang", "slice", "source")]
    return pa.table([*first, *lists], names=["lang", "slice", "source", "ends", "shares"])


def overlap_distance(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Sum of ``|p - q|`` over all places, each overlap of two runs taken once."""
    ends = np.sort(np.concatenate([a[0], b[0]]))
    lengths = np.diff(ends, prepend=0)
    p = a[1][np.searchsorted(a[0], ends)]
    q = b[1][np.searchsorted(b[0], ends)]
    return int((np.abs(p - q) * lengths).sum())


def _met(key: tuple, cell: pa.Table) -> pa.Table:
    """Distances of the pairs of two blocks in one slice, both ways."""
    names, blocks = cell.column("source").to_pylist(), cell.column("block").to_pylist()
    runs = [
        (np.asarray(ends, np.int64), np.asarray(shares, np.int64))
        for ends, shares in zip(cell.column("ends").to_pylist(), cell.column("shares").to_pylist())
    ]
    lang, _, low, high = (part.as_py() for part in key)
    rows = []
    for i, first in enumerate(names):
        for j, second in enumerate(names):
            if blocks[i] == low and blocks[j] == high and (low < high or first < second):
                distance = overlap_distance(runs[i], runs[j])
                rows += [(lang, first, second, distance), (lang, second, first, distance)]
    columns = list(zip(*rows)) or [[], [], [], []]
    kinds = [("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())]
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], names=[n for n, _ in kinds])


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` of every ordered pair of a language's sources.

    ``shares`` has ``(lang, source, place, p)`` of the terms that a group has.
    """
    empty = share(F.lit(0), F.col("total"), F.col("kept"))
    ranked = groups.withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    numbered = cut_lineage(ranked.withColumn("block", F.floor(F.col("number") / BLOCK)), "numbered")
    blocks = numbered.groupBy("lang").agg(F.max("block").alias("last_block"))
    # Every group has a row in every slice, so that a slice without its terms is one run.
    slices = F.sequence(F.lit(0).cast("long"), F.floor((F.col("kept") - 1) / SLICE))
    spans = numbered.where("kept > 0").select("lang", "source", "kept", empty.alias("absent"), F.explode(slices).alias("slice"))
    size = F.least(F.lit(SLICE).cast("long"), F.col("kept") - F.col("slice") * SLICE).cast("long")
    bare = spans.select("lang", "source", "slice", size.alias("size"), "absent", F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("p"))
    known = shares.join(numbered.select("lang", "source", "kept", empty.alias("absent")), ["lang", "source"])
    known = known.withColumn("slice", F.floor(F.col("place") / SLICE)).select(
        "lang", "source", "slice", size.alias("size"), "absent", (F.col("place") % SLICE).cast("long").alias("at"), "p"
    )
    runs = bare.unionByName(known).groupBy("lang", "slice", "source").applyInArrow(
        _encoded, "lang string, slice long, source string, ends array<int>, shares array<long>"
    )
    runs = cut_lineage(runs, "runs")
    placed = runs.join(numbered.select("lang", "source", "block"), ["lang", "source"]).join(blocks, "lang")
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last_block"))))
    cells = met.select(
        "lang", "slice", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"),
        "source", "block", "ends", "shares",
    )
    parts = cells.groupBy("lang", "slice", "a", "b").applyInArrow(_met, "lang string, source string, item string, value long")
    sums = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # Languages without kept terms have pairs at distance 0.
    bare_groups = numbered.where("kept = 0").select("lang", "source")
    others = bare_groups.withColumnRenamed("source", "item")
    without = bare_groups.join(others, "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    return sums.unionByName(without)


def audit(
    docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, terms_shown: int = TERMS_SHOWN
) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of every group of ``docs(text, lang,
    source)``: its distances to the other sources of its language (``pair``), and the
    terms it has more of than its language, the ``terms_shown`` first (``term``)."""
    counted = cut_lineage(count_terms(docs), "counts")
    by_language = counted.where("term is not null").groupBy("lang", "term").agg(
        F.sum("n").alias("n"), F.sum("documents").alias("documents")
    )
    kept = cut_lineage(by_language.where(F.col("documents") >= least_documents).select("lang", "term", "n"), "kept")
    counts = counted.where("term is not null").select("lang", "source", "term", "n").join(
        kept.select("lang", "term", F.col("n").alias("lang_n")), ["lang", "term"]
    )
    counts = cut_lineage(counts, "kept_counts")
    languages = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("kept"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counted.where("term is null").select("lang", "source")
    groups = groups.join(totals, ["lang", "source"], "left").join(languages, "lang", "left")
    groups = cut_lineage(groups.fillna(0, ["total", "lang_total", "kept"]), "groups")

    shared = counts.join(groups, ["lang", "source"])
    shared = shared.withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))
    places = _placed(kept, counts, groups)
    shares = shared.select("lang", "source", "term", "p").join(places, ["lang", "term"]).drop("term")
    pairs = _pairs(groups, shares).withColumn("part", F.lit("pair"))

    more = F.col("p") - share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    above = shared.withColumn("value", more).where("value > 0").select(
        "lang", "source", F.col("term").alias("item"), "value", F.lit("term").alias("part")
    )
    best = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = [df.withColumn("rank", F.row_number().over(best)) for df in (pairs, above)]
    both = ranked[0].unionByName(ranked[1].where(F.col("rank") <= terms_shown))
    return both.select("lang", "source", "part", "item", "value", "rank")
