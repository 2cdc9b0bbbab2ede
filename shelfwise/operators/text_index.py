"""A stored text index over the catalogue, and searches that read little of it.

A posting is a product with its impact on a word: the word's TF-IDF weight in the
product, the product's text brought to length 1. The postings of a word within a category
(a shelf) are stored in blocks by descending impact. Block 0 holds ``FIRST_BLOCK``
postings and each further one twice as many as the one before, so a word has few blocks
however many products have it; long blocks are stored in chunks. ``heads`` holds the
greatest impact of each block, its least product id, and the least one near that impact.

A search first adds up block 0 of each of its words. The k-th best of these sums is a
score that k products reach at least. Words are then taken from the heaviest down. A
product is found through the first of its words in that order, so a block matters only if
its greatest impact, with the best that all lighter words could add, reaches that score.
Light words whose sum cannot are never read (MaxScore), and of others only the head of
the list. The products found are scored exactly from ``products``, which has each
product's impacts. Results equal those of scoring everything.

Products without an id are left out, products without text are in no posting. Products
without a category lie on a shelf of their own, which only searches of the whole
catalogue read. Ties go to the smaller product id. An empty catalogue has an empty index.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.operators.ordering import running_total
from shelfwise.operators.similarity import (
    HIT_COLUMNS,
    SIMILARITY_PLACES,
    STYLE_QUERY,
    catalogue_words,
    corpus,
    matches,
    unit_queries,
    word_counts,
)
from shelfwise.sources.scratch import cut_lineage
from shelfwise.sources.tables import publish_table

FIRST_BLOCK, CHUNK = 128, 4096
#: Words, and products, that a search names in its filters instead of joining them.
MOST_LISTED = 512
#: Sums of the same numbers in another order differ by less than this.
SLACK = 1e-12
#: Impacts this near a block's greatest count for its ``top_id``. From ``HEAVY`` on, a
#: word's impacts that lie further apart give scores that differ in the places kept.
NEAR, HEAVY = 1e-5, 0.2

# Names of the published tables.
INDEX_TABLES = {
    "words": "gold_text_words",
    "heads": "gold_text_heads",
    "postings": "gold_text_postings",
    "products": "gold_text_products",
}


@dataclass(frozen=True)
class TextIndex:
    """``words(word, idf, total)``, ``heads(word, shelf, block, most, first_id, top_id, n)``,
    ``postings(word, shelf, block, chunk, entries)``, ``products(product_id, impacts)``."""

    words: DataFrame
    heads: DataFrame
    postings: DataFrame
    products: DataFrame


def shelf_of(category: Column) -> Column:
    """A category's name in the index; no category is not the empty one."""
    return F.coalesce(F.concat(F.lit("="), category.cast("string")), F.lit(""))


def block_of(place: Column) -> Column:
    """The block of the posting at ``place``, counted from 1."""
    return F.floor(F.log2(F.floor((place - 1) / FIRST_BLOCK) + 1)).cast("int")


def build_index(products: DataFrame, counted: DataFrame | None = None) -> TextIndex:
    """The index of a catalogue. Its tables are plans over stored steps.

    ``counted``: the ``catalogue_words``, if they are stored already.
    """
    total = corpus(products, F.col("category")).count()
    counted = catalogue_words(products) if counted is None else counted
    idf = F.log((F.lit(float(total)) + 1) / (F.count("*") + 1)).alias("idf")
    known = cut_lineage(counted.groupBy("word").agg(idf).withColumn("total", F.lit(total).cast("long")), "words")

    weighed = counted.join(known.where("idf > 0"), "word").withColumn("weight", F.col("times") * F.col("idf"))
    weights = F.array_sort(F.collect_list(F.struct("word", "weight")))
    listed = weighed.groupBy("product_id", "block").agg(weights.alias("weights"))
    length = F.sqrt(F.aggregate("weights", F.lit(0.0), lambda total, w: total + w.weight * w.weight))
    impacts = F.transform("weights", lambda w: F.struct(w.word.alias("word"), (w.weight / F.col("length")).alias("impact")))
    described = listed.withColumn("length", length).select("product_id", "block", F.map_from_entries(impacts).alias("impacts"))
    described = cut_lineage(described, "impacts")

    entries = described.select("product_id", shelf_of(F.col("block")).alias("shelf"), F.explode("impacts").alias("word", "impact"))
    order = [F.desc("impact"), F.col("product_id")]
    ranked = running_total(entries.withColumn("one", F.lit(1)), ["word", "shelf"], order, "one", "place")
    placed = ranked.select(
        "word", "shelf", block_of(F.col("place")).alias("block"), F.floor((F.col("place") - 1) / CHUNK).alias("chunk"),
        "product_id", "impact",
    )
    chunks = placed.groupBy("word", "shelf", "block", "chunk").agg(
        F.collect_list(F.struct("product_id", "impact")).alias("entries"),
        F.max("impact").alias("most"),
        F.min("product_id").alias("first_id"),
        F.count("*").alias("n"),
    )
    top = F.filter("entries", lambda entry: entry.impact >= F.col("most") - NEAR)
    stored = cut_lineage(chunks.withColumn("top_id", F.array_min(top.getField("product_id"))), "postings")
    block = Window.partitionBy("word", "shelf", "block")
    narrow = stored.drop("entries").withColumn("greatest", F.max("most").over(block))
    heads = narrow.groupBy("word", "shelf", "block").agg(
        F.max("most").alias("most"),
        F.min("first_id").alias("first_id"),
        F.min(F.when(F.col("most") >= F.col("greatest") - NEAR, F.col("top_id"))).alias("top_id"),
        F.sum("n").alias("n"),
    )
    postings = stored.select("word", "shelf", "block", "chunk", "entries")
    return TextIndex(known, heads, postings, described.select("product_id", "impacts"))


def _sorted(index: TextIndex) -> TextIndex:
    """Rows in the order in which searches look for them, for statistics that skip."""
    by_word = {name: getattr(index, name).repartitionByRange("word").sortWithinPartitions("word") for name in ("words", "heads")}
    postings = index.postings.repartitionByRange("word", "shelf", "block").sortWithinPartitions("word", "shelf", "block")
    products = index.products.repartitionByRange("product_id").sortWithinPartitions("product_id")
    return TextIndex(**by_word, postings=postings, products=products)


def store_index(index: TextIndex) -> TextIndex:
    """The index written to the scratch folder."""
    ordered = _sorted(index)
    return TextIndex(**{f.name: cut_lineage(getattr(ordered, f.name), f"text_{f.name}") for f in fields(TextIndex)})


def publish_index(index: TextIndex, database: str) -> TextIndex:
    """The index written as tables of ``database``."""
    ordered = _sorted(index)
    return TextIndex(
        **{
            name: publish_table(getattr(ordered, name), f"{database}.{table}", "gold", f"Text index: {name}")
            for name, table in INDEX_TABLES.items()
        }
    )


def open_index(spark: SparkSession, database: str) -> TextIndex:
    return TextIndex(**{name: spark.table(f"{database}.{table}") for name, table in INDEX_TABLES.items()})


def _among(table: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """``table`` with the rows whose ``column`` is among the ``wanted``, distinct values.

    A few are named in a filter, which reaches the scan and skips what lies between them.
    """
    few = wanted.limit(MOST_LISTED + 1).collect()
    if len(few) <= MOST_LISTED:
        return table.where(F.col(column).isin([row[0] for row in few]))
    return table.join(wanted, column, "left_semi")


def _reaches(bound: Column, product_id: Column) -> Column:
    """Whether a score up to ``bound`` of a product from ``product_id`` on can be among the k best."""
    score = F.round(bound + SLACK, SIMILARITY_PLACES)
    sure = F.col("least")
    return sure.isNull() | (score > sure) | ((score == sure) & (product_id <= F.col("least_id")))


def _entries(terms: DataFrame, postings: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """The postings of the terms' blocks, of the allowed products."""
    found = terms.join(postings.drop("chunk"), ["word", "shelf", "block"]).select("*", F.inline("entries")).drop("entries")
    return found if allowed is None else found.join(allowed, "product_id", "left_semi")


@dataclass(frozen=True)
class Plan:
    """What a search decided to read: all ``terms`` (a row per query, word, shelf and
    block) and the ``needed`` ones; ``weights(query_id, weights)`` of the queries."""

    terms: DataFrame
    needed: DataFrame
    weights: DataFrame
    postings: DataFrame


def plan_search(index: TextIndex, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> Plan:
    """Which blocks the queries ``(query_id, text, category)`` must read."""
    asked = cut_lineage(word_counts(queries, ["query_id", "category"], F.col("text")), "asked_words")
    wanted = asked.select("word").distinct()
    known = _among(index.words, "word", wanted)
    marked = asked.join(known.select("word", F.lit(True).alias("known")), "word", "left")
    total = F.coalesce(index.words.select(F.max("total")).scalar(), F.lit(0))
    unit = unit_queries(marked.withColumn("known", F.coalesce("known", F.lit(False))), known.where("idf > 0"), total, "query_id")
    unit = cut_lineage(unit.where("asked > 0").select("query_id", "category", "word", "asked"), "asked")
    heads, postings = (_among(t, "word", wanted) for t in (index.heads, index.postings))

    terms = unit.join(heads, "word").where(F.col("category").isNull() | (F.col("shelf") == shelf_of(F.col("category"))))
    # What the lighter words of a query can add on this shelf: their first blocks' heads.
    lighter = Window.partitionBy("query_id", "shelf").orderBy(F.desc("asked"), "word", "block").rowsBetween(1, Window.unboundedFollowing)
    rest = F.coalesce(F.sum(F.when(F.col("block") == 0, F.col("asked") * F.col("most"))).over(lighter), F.lit(0.0))
    terms = cut_lineage(terms.withColumn("rest", rest), "terms")

    first = _entries(terms.where("block = 0"), postings.where("block = 0"), allowed)
    sums = first.groupBy("query_id", "product_id").agg(F.sum(F.col("asked") * F.col("impact")).alias("sum"))
    sums = sums.withColumn("least", F.round(F.col("sum") - SLACK, SIMILARITY_PLACES))
    best = Window.partitionBy("query_id").orderBy(F.desc("least"), "product_id")
    sure = sums.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).where(F.col("place") == k)
    sure = cut_lineage(sure.select("query_id", "least", F.col("product_id").alias("least_id")), "sure")
    least_id = F.when(F.col("asked") >= HEAVY, F.col("top_id")).otherwise(F.col("first_id"))
    reach = _reaches(F.col("asked") * F.col("most") + F.col("rest"), least_id)
    needed = terms.join(sure, "query_id", "left").where(reach)
    weights = unit.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "asked"))).alias("weights"))
    return Plan(terms, needed, weights, postings)


def search(index: TextIndex, queries: DataFrame, k: int = 5, allowed: DataFrame | None = None) -> DataFrame:
    """``(query_id, category, hit_rank, product_id, similarity)``: the ``k`` products most
    like each query ``(query_id, text, category)``, of those that share a word with it.

    A category narrows its query, null asks the whole catalogue. ``allowed`` holds the
    ``product_id`` of the only products that may be found.
    """
    plan = plan_search(index, queries, k, allowed)
    found = _entries(plan.needed, plan.postings, allowed)
    found = found.where(_reaches(F.col("asked") * F.col("impact") + F.col("rest"), F.col("product_id")))
    candidates = cut_lineage(found.select("query_id", "category", "product_id").distinct(), "candidates")
    described = _among(index.products, "product_id", candidates.select("product_id").distinct())
    scored = candidates.join(described, "product_id").join(plan.weights, "query_id")
    shared = F.aggregate(
        F.map_entries("weights"),
        F.lit(0.0),
        lambda total, w: total + w.value * F.coalesce(F.try_element_at("impacts", w.key), F.lit(0.0)),
    )
    scored = scored.select("query_id", "category", "product_id", F.round(shared, SIMILARITY_PLACES).alias("similarity"))
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "product_id")
    return scored.withColumn("hit_rank", F.row_number().over(best)).where(F.col("hit_rank") <= k)


def find_products(
    index: TextIndex, products: DataFrame, query_text: str, k: int = 5, filters: Mapping[str, object] | None = None
) -> DataFrame:
    """The ``k`` products most like a free-text query, after the attribute filters.

    The products that share no word with it follow in the order of their ids, at
    similarity 0.
    """
    filters = dict(filters or {})
    category = F.lit(filters.get("category")).cast("string")
    asked = products.sparkSession.range(1).select("id", F.lit(query_text).alias("text"), category.alias("category"))
    others = {column: value for column, value in filters.items() if column != "category"}
    candidates = products.where(matches(filters))
    allowed = candidates.select("product_id") if others else None
    hits = cut_lineage(
        search(index, asked.withColumnRenamed("id", "query_id"), k, allowed).select("product_id", "similarity"), "hits"
    )
    columns = candidates.select(*HIT_COLUMNS)
    found = _among(columns, "product_id", hits.select("product_id")).join(hits, "product_id")
    missing = k - hits.count()
    if missing > 0:
        rest = columns.join(hits, "product_id", "left_anti").orderBy("product_id").limit(missing)
        found = found.unionByName(rest.withColumn("similarity", F.lit(0.0)))
    return found.orderBy(F.desc("similarity"), "product_id").limit(k)


def style_lookups(
    index: TextIndex, products: DataFrame, categories: DataFrame, k: int = 5, new_arrivals: bool = True
) -> DataFrame:
    """The style hits of the given ``categories(category)`` only; as ``style_hits``."""
    few = categories.where("category is not null").distinct()
    columns = products.select(*HIT_COLUMNS, F.coalesce("is_new_arrival", F.lit(False)).alias("is_new"))
    shelf = cut_lineage(_among(columns, "category", few), "shelf")
    if new_arrivals:
        some = F.max("is_new").over(Window.partitionBy("category"))
        shelf = shelf.withColumn("some", some).where(F.col("is_new") | ~F.col("some")).drop("some")
    asked = few.select(F.col("category").alias("query_id"), F.format_string(STYLE_QUERY, "category").alias("text"), "category")
    hits = search(index, asked, k, shelf.select("product_id")).select("product_id", "similarity")
    both = shelf.drop("is_new").join(hits, "product_id", "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    best = Window.partitionBy("category").orderBy(F.desc("similarity"), "product_id")
    return both.withColumn("hit_rank", F.row_number().over(best)).where(F.col("hit_rank") <= k)

