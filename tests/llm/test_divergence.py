"""The divergence audit against plain counting, and its runs on their own."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, value long"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows: list[tuple], least: int, shown: int) -> set[tuple]:
    docs = [(lang or "", source or "", text or "") for _, text, lang, source, *_ in rows]
    counts: dict = {}
    documents: Counter = Counter()
    for lang, source, text in docs:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        words = TERM.findall(lowered)
        counts.setdefault((lang, source), Counter()).update(words)
        documents.update((lang, word) for word in set(words))
    found = set()
    for lang in {lang for lang, _ in counts}:
        kept = sorted(word for (of, word), n in documents.items() if of == lang and n >= least)
        own = {source: c for (of, source), c in counts.items() if of == lang}

        def shares(count):
            total = sum(count[word] for word in kept) + 5 * len(kept)
            return {word: 1 + 10**9 * (count[word] + 5) // total for word in kept}

        q = shares(sum(own.values(), Counter()))
        p = {source: shares(count) for source, count in own.items()}
        for source in own:
            pairs = [(sum(abs(p[source][w] - p[o][w]) for w in kept), o) for o in own if o != source]
            above = [(p[source][w] - q[w], w) for w in kept if own[source][w] and p[source][w] > q[w]]
            for part, items, limit in (("pair", pairs, len(pairs)), ("term", above, shown)):
                ordered = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:limit]
                found |= {(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(ordered)}
    return found


def corpus() -> list[tuple]:
    rng = random.Random(12)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(60)]
    words += ["Été", "日本", "ÀÉ", "é_x", "tie", "TIE", "K"]  # the Kelvin sign stays as it is
    rows = []
    for i in range(400):
        lang, source = rng.choice(["en", "en", "fr", None]), rng.choice(["s1", "s2", "s3", "é", None])
        text = " ".join(rng.choices(words, k=rng.randint(0, 30), weights=range(1, len(words) + 1)))
        rows.append((i, text, lang, source, "x", 1))
    rows += [(None, None, "en", "silent", "x", 1), (1, "", "xx", "a", "x", 1), (1, "one", "xx", "b", "x", 1)]
    rows += [(2, "!!! 123", "xx", None, "x", 1), (3, "alone", "yy", "only", "x", 1), rows[0], rows[0], rows[7]]
    rows += [(900, "wak " * 20_000, "en", "s1", "x", 1)]
    return rows


@pytest.mark.parametrize("slice_, block, held, leading", [(16_384, 64, 800_000, 8), (7, 2, 50, 2)])
def test_audit_equals_plain_counting(spark, monkeypatch, slice_, block, held, leading):
    for name, value in (("SLICE", slice_), ("BLOCK", block), ("HELD", held), ("LEADING", leading)):
        monkeypatch.setattr(divergence, name, value)
    rows = corpus()
    found = divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(3), 5, 6).collect()
    assert len(found) == len(set(found))
    assert {tuple(r) for r in found} == plain(rows, 5, 6)


def test_no_documents(spark, no_documents):
    assert divergence.audit(no_documents).collect() == []


def test_languages_without_kept_terms_are_at_distance_zero(spark):
    rows = [(1, "a", "en", "s1"), (2, "b", "en", "s2"), (3, None, None, None)]
    found = divergence.audit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert sorted(map(tuple, found.collect())) == [("en", "s1", "pair", "s2", 0, 1), ("en", "s2", "pair", "s1", 0, 1)]


def test_shares_beyond_longs(spark):
    rows = [(10**13, 10**14, 10**6), (8_999_999_999, 10**12, 3), (0, 0, 1), (2**62, 2**62, 1)]
    table = spark.createDataFrame(rows, "n long, total long, kept long")
    found = table.select(divergence.share(F.col("n"), F.col("total"), F.col("kept")).alias("p")).collect()
    assert [r.p for r in found] == [1 + 10**9 * (n + 5) // (total + 5 * kept) for n, total, kept in rows]


def test_runs_and_their_overlaps():
    rng = np.random.default_rng(3)
    for size in (1, 5, 400):
        columns = []
        for _ in range(2):
            places = np.flatnonzero(rng.random(size) < 0.4)
            shares = rng.integers(1, 4, len(places))
            whole = np.full(size, 2)
            whole[places] = shares
            ends, values = divergence.run_lengths(places, shares, 2, size)
            assert np.repeat(values, np.diff(ends, prepend=0)).tolist() == whole.tolist()
            assert (values[1:] != values[:-1]).all()
            columns.append((whole, (ends, values)))
        (a, runs_a), (b, runs_b) = columns
        assert divergence.overlap_distance(runs_a, runs_b) == np.abs(a - b).sum()


def test_the_order_brings_equal_counts_together(spark):
    """Terms of one vector of counts are neighbours, so that they share a run in every group."""
    rows = [(i, f"{'xyz'[i % 3]}{'ab'[j % 2]}{j}", "en", f"s{i % 3}") for i in range(30) for j in range(20)]
    rows = [(i, text.translate(str.maketrans("0123456789", "qrstuvwxyz")), lang, source) for i, text, lang, source in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    counts = divergence.count_terms(docs).where("term is not null")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    placed = {r.term: r.place for r in divergence._placed(kept, counts, groups).collect()}
    assert sorted(placed.values()) == list(range(len(placed)))
    own = {r.term: r.source for r in counts.collect()}
    ordered = [own[term] for term in sorted(placed, key=placed.get)]
    assert sum(a != b for a, b in zip(ordered, ordered[1:])) == 2, "one run for each source's terms"
