"""The stored text index against scoring every product."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import similarity, text_index
from tests import fixtures as fx

WORDS = [f"word{i}" for i in range(40)]


def _catalogue(spark, n: int, seed: int = 1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = rng.choices(WORDS, k=rng.randint(0, 9), weights=[60 / (j + 1) for j in range(40)])
        rows.append(
            {
                "product_id": f"P{rng.randrange(10**6):06}-{i}",
                "product_name": rng.choice(["jeans", "shirt", None]),
                "category": rng.choice(["Denim", "Shoes", "Tops", "", None]),
                "description": " ".join(text + ["common"] * (rng.random() < 0.9)),
                "brand": None,
                "is_new_arrival": rng.random() < 0.3,
            }
        )
    rows += [{**rows[3], "product_id": f"Z{i}"} for i in range(30)] + [{**rows[5], "product_id": None}]
    return fx.products(spark, rows)


@pytest.fixture(scope="module")
def small_blocks():
    patch = pytest.MonkeyPatch()
    patch.setattr(text_index, "FIRST_BLOCK", 4)
    patch.setattr(text_index, "CHUNK", 8)
    yield
    patch.undo()


@pytest.fixture(scope="module")
def catalogue(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("catalogue") / "products")
    _catalogue(spark, 400).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def index(small_blocks, catalogue):
    return text_index.store_index(text_index.build_index(catalogue))


def _queries(spark, n: int):
    rng = random.Random(7)
    rows = [(f"q{i}", " ".join(rng.choices(WORDS + ["jeans", "unheard"], k=rng.randint(1, 5))), rng.choice([None, None, "Denim", "", "Hats"]))
            for i in range(n)]
    rows += [("common", "common", None), ("both", "common word39 common", None), ("none", "unheard of", None), ("blank", " ! ", None)]
    return spark.createDataFrame(rows, "query_id string, text string, category string")


def _hits(df):
    return sorted((r.query_id, r.hit_rank, r.product_id, r.similarity) for r in df.collect())


def test_search_equals_scoring_everything(spark, index, catalogue):
    asked = _queries(spark, 60)
    found = _hits(text_index.search(index, asked, 3))
    assert found == _hits(similarity.search_text(catalogue, asked, 3))
    assert len(found) > 100


def test_filters_pick_candidates_before_ranking(spark, index, catalogue):
    asked = _queries(spark, 30)
    allowed = catalogue.where("is_new_arrival").select("product_id")
    expected = similarity.search_text(catalogue, asked, 4, {"is_new_arrival": True})
    assert _hits(text_index.search(index, asked, 4, allowed)) == _hits(expected)


def test_joins_replace_long_lists(spark, index, catalogue, monkeypatch):
    monkeypatch.setattr(text_index, "MOST_LISTED", 2)
    asked = _queries(spark, 20)
    assert _hits(text_index.search(index, asked, 3)) == _hits(similarity.search_text(catalogue, asked, 3))


@pytest.mark.parametrize("text", ["word0 jeans, word7!", "word39", "nothing known", ""])
@pytest.mark.parametrize("filters", [None, {"category": "Denim"}, {"is_new_arrival": True, "category": "Shoes"}])
def test_one_search_equals_the_unindexed_one(index, catalogue, text, filters):
    expected = similarity.similar_by_text(catalogue.where("product_id is not null"), text, 12, filters).collect()
    found = text_index.find_products(index, catalogue.where("product_id is not null"), text, 12, filters).collect()
    shown = [[(r.product_id, r.similarity, r.category) for r in rows] for rows in (found, expected)]
    assert shown[0] == shown[1]


@pytest.mark.parametrize("new_arrivals", [True, False])
def test_style_lookups_equal_style_hits(spark, index, catalogue, new_arrivals):
    known = catalogue.where("product_id is not null")
    categories = spark.createDataFrame([("Denim",), ("Tops",), (None,), ("Hats",)], "category string")
    found = text_index.style_lookups(index, known, categories, 5, new_arrivals)
    hits = similarity.style_hits(known, 5, new_arrivals).where("category in ('Denim', 'Tops')")
    shown = [sorted((r.category, r.hit_rank, r.product_id, r.similarity) for r in t.collect()) for t in (found, hits)]
    assert shown[0] == shown[1] and len(shown[0]) == 10


def test_blocks_that_cannot_matter_are_skipped(spark, index):
    asked = spark.createDataFrame([("q", "word39 common", None)], "query_id string, text string, category string")
    plan = text_index.plan_search(index, asked, 3)
    read = {(r.word, r.shelf, r.block) for r in plan.needed.collect()}
    every = {(r.word, r.shelf, r.block) for r in plan.terms.collect()}
    assert read < every
    sizes = [t.where("word = 'common'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for t in (plan.terms, plan.needed)]
    assert sizes[0] - sizes[1] > 200, "most postings of a word that nearly every product has stay unread"


def test_many_searches_of_one_common_word_stay_linear(spark, small_blocks):
    """What is read grows with the searches, not with searches times products."""
    read = {}
    for n in (300, 1200):
        rows = [{"product_id": f"P{i:05}", "category": "Tops", "description": "common " + f"rare{i % 50} " * (1 + i % 3)} for i in range(n)]
        rows += [{"product_id": "X", "category": "Tops", "description": "other"}]
        index = text_index.store_index(text_index.build_index(fx.products(spark, rows)))
        asked = spark.range(500).select(F.col("id").alias("query_id"), F.lit("common").alias("text"), F.lit(None).cast("string").alias("category"))
        read[n] = text_index.plan_search(index, asked, 3).needed.agg(F.sum("n")).first()[0]
    assert read[1200] <= 1.2 * read[300]


def test_a_search_reads_its_words_only(index, spark):
    asked = spark.createDataFrame([("q", "word5", None)], "query_id string, text string, category string")
    plan = text_index.plan_search(index, asked, 3).postings._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(word, [word5])]" in plan or "EqualTo(word,word5)" in plan


def test_an_empty_catalogue_has_an_empty_index(spark, catalogue):
    index = text_index.store_index(text_index.build_index(catalogue.limit(0)))
    assert text_index.search(index, _queries(spark, 3), 3).collect() == []
    assert text_index.find_products(index, catalogue.limit(0), "jeans").collect() == []


def test_blocks_double():
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    places = [1, 128, 129, 384, 385, 896, 897]
    found = spark.createDataFrame([(p,) for p in places], "place long").select(text_index.block_of(F.col("place")).alias("b"))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(text_index, "FIRST_BLOCK", 128)
        found = spark.createDataFrame([(p,) for p in places], "place long").select(text_index.block_of(F.col("place")).alias("b"))
    assert [r.b for r in found.collect()] == [0, 0, 1, 1, 2, 2, 3]
