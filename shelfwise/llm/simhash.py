"""Near duplicates by SimHash fingerprints, found at the anchors of a covering code.

A document's fingerprint has 64 bits, one for each bit position that is set in more
than half of its shingles' hashes. Fingerprints within ``max_distance`` bits are
linked, and components of links are groups of near duplicates.

A fingerprint is cut into three words. If two fingerprints differ in 4 bits, one of
the words differs in 1 bit at most, so both meet at an anchor of that word
(``covering.py``): a fingerprint goes to every anchor within the covering radius plus
that slack, five or six for each word, and is compared there with those whose nearest
anchor it is. Equal fingerprints go as one, so a group of copies costs as much as one
document. Anchors that gather very many fingerprints are split into lots. An anchor
returns a spanning forest of its links, never all pairs.

Null and empty texts, and texts without words, have the fingerprint zero and are
linked like any other. Rows without an id get a fingerprint and a component, and name
no component. Repeated rows stay in ``near_duplicates``; ``keep_one`` leaves one row of
each group, whatever ids its rows have. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.components import connected_components
from shelfwise.llm.covering import anchors
from shelfwise.llm.whole_rows import KEY, back, row_key, whole_row
from shelfwise.sources.scratch import cut_lineage

SEED = 42
SHINGLE, MAX_DISTANCE = 4, 4
#: First bit and bits of a fingerprint's words.
WORDS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints at one anchor beyond which it is split into lots.
SPLIT_AT = 20_000
#: Tasks that the fingerprints of one component are spread over.
SALTS = 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a text."""
    words = text.encode().lower().split() if text else []  # ASCII letters and spaces only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    last = ends[shingle - 1 :].tolist() or [len(line)]
    first = [0, *(ends + 1).tolist()][: len(last)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(first, last)), np.uint64, len(last))
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 65536):
        some = hashes[start : start + 65536].astype("<u8")
        bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << bit for bit in np.flatnonzero(2 * counts > len(hashes)).tolist())


def _fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        found = np.fromiter((fingerprint(text.as_py()) for text in texts), np.uint64, len(texts))
        yield pa.array(found.view(np.int64))


def fingerprints(text: str) -> Column:
    """The fingerprint of a text column as a signed long of the same bits."""
    return F.arrow_udf(_fingerprints, "long")(F.col(text).cast("string"))


def _spread(slack: int):
    """A function from fingerprints to ``(anchor, fingerprint, home)``; the number of
    the word stands above the anchor's bits."""
    schema = pa.schema([("anchor", pa.int64()), ("fp", pa.int64()), ("home", pa.bool_())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("fp").to_numpy(zero_copy_only=False)
            for number, (shift, bits) in enumerate(WORDS):
                words = (prints.view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
                index, anchor, home = anchors(words, slack)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((number << 23) | anchor), pa.array(prints[index]), pa.array(home)], schema=schema
                )

    return run


def forest(prints: np.ndarray, home: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(member, least member)`` that join whatever lies within ``distance``
    of a home fingerprint."""
    order = np.argsort(prints, kind="stable")
    prints, home = prints[order], home[order]
    label = np.arange(len(prints))
    bits = prints.view(np.uint64)
    at = np.flatnonzero(home)
    step = max(1, (1 << 20) // max(1, len(prints)))
    for start in range(0, len(at), step):
        some = at[start : start + step]
        near = np.bitwise_count(bits[some, None] ^ bits[None, :]) <= distance
        for row in near[near.sum(axis=1) > 1]:
            labels = np.unique(label[row])
            if len(labels) > 1:
                label[np.isin(label, labels)] = labels[0]
    moved = np.flatnonzero(label != np.arange(len(label)))
    return prints[moved], prints[label[moved]]


def _compare(distance: int):
    """Links of fingerprints that come sorted by anchor and lot."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def joined(held: list[tuple]) -> pa.RecordBatch:
        prints, home = (np.concatenate(part) for part in zip(*held))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(prints, home, distance)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        current = None
        for batch in batches:
            columns = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
            keys = np.stack([columns["anchor"], columns["lot"]])
            borders = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for start, end in zip([0, *borders], [*borders, batch.num_rows]):
                if start == end:
                    continue
                key = tuple(keys[:, start])
                if key != current and held:
                    yield joined(held)
                    held = []
                current = key
                held.append((columns["fp"][start:end], columns["home"][start:end]))
        if held:
            yield joined(held)

    return run


def links(prints: DataFrame, max_distance: int = MAX_DISTANCE, split_at: int = SPLIT_AT) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all pairs of the distinct
    fingerprints ``fp`` within ``max_distance`` bits."""
    slack = max_distance // len(WORDS)
    spread = prints.select("fp").mapInArrow(_spread(slack), "anchor long, fp long, home boolean")
    crowded = spread.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > split_at)
    lots = F.ceil(F.col("n") / split_at).alias("lots")
    placed = spread.join(cut_lineage(crowded.select("anchor", lots), "crowded"), "anchor", "left")
    placed = placed.withColumn("lots", F.coalesce("lots", F.lit(1)))
    placed = placed.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)))
    own = F.pmod(F.xxhash64("fp"), F.col("lots")) == F.col("lot")
    placed = placed.select("anchor", "lot", "fp", (F.col("home") & own).alias("home"))
    dealt = placed.repartition("anchor", "lot").sortWithinPartitions("anchor", "lot")
    return dealt.mapInArrow(_compare(max_distance), "a long, b long")


def _by_group(prints: DataFrame, least: str, max_distance: int) -> DataFrame:
    """``(fp, first)`` of the distinct fingerprints ``prints(fp, <least>)``: the least
    value, nulls apart, of the component."""
    groups = cut_lineage(connected_components(links(prints, max_distance)), "groups")
    linked = groups.join(prints, groups.node == prints.fp).select("fp", "root", least)
    # A component with very many fingerprints meets its first row in several tasks.
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    first = linked.groupBy("root").agg(F.min(least).alias("first")).withColumn("salt", F.explode(salts))
    salted = linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    by_print = salted.join(first, ["root", "salt"]).select("fp", "first")
    return prints.join(by_print, "fp", "left").select("fp", F.coalesce("first", least).alias("first"))


def near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row; ``component_id`` is the smallest id
    of the row's component."""
    texts = docs.select(F.col("doc_id").cast("long"), fingerprints("text").alias("fp"))
    marked = cut_lineage(texts, "fingerprints")
    prints = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    components = _by_group(prints, "least_id", max_distance).withColumnRenamed("first", "component_id")
    return marked.join(components, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """The rows of ``docs``, as they are, one of each group.

    The row with the smallest id stays, one without an id only where no row of the group
    has one. Among rows of one id the key of the whole row decides, and of rows that are
    alike in every column one stays.
    """
    keyed = docs.select(whole_row(), row_key())
    unnamed, doc_id = F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").cast("long").alias("doc_id")
    marked = docs.select(fingerprints("text").alias("fp"), row_key(), unnamed, doc_id)
    marked = cut_lineage(marked.select("fp", F.struct("unnamed", "doc_id", KEY).alias("place")), "fingerprints")
    rows = cut_lineage(marked.groupBy("fp", "place").agg(F.count("*").alias("n")), "rows")
    prints = cut_lineage(rows.groupBy("fp").agg(F.min("place").alias("least")), "distinct")
    stays = _by_group(prints, "least", max_distance).select(f"first.{KEY}").distinct().withColumn("stays", F.lit(True))
    odd = rows.select(f"place.{KEY}", "n").join(stays, KEY, "left")
    odd = cut_lineage(odd.where("stays is null or n > 1"), "odd")
    kept = keyed.join(odd.where("stays is null"), KEY, "left_anti")
    repeated = odd.where("stays").select(KEY)
    if not repeated.isEmpty():
        once = kept.join(repeated, KEY, "left_semi").dropDuplicates([KEY])
        kept = kept.join(repeated, KEY, "left_anti").unionByName(once)
    return back(kept)
