"""Ranking products by text or vector similarity.

The embedding model behind the original lookup is not public, so text is compared
by TF-IDF cosine over all words of a product. Every query is tied to one block (a
category or label), so the work grows with the products, never with pairs of them.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.text import words
from shelfwise.functions.vectors import along, unit
from shelfwise.sources.scratch import cut_lineage

# Columns returned for a hit, and the query built from a category.
HIT_COLUMNS = [
    "product_id",
    "product_name",
    "category",
    "subcategory",
    "brand",
    "price",
    "style_tags",
    "color",
    "rating",
    "description",
]
STYLE_QUERY = "%s style trending fashion"

PRODUCT_TEXT = ("product_name", "category", "subcategory", "brand", "description", "style_tags", "color")
SIMILARITY_PLACES = 6
#: Texts whose words a task counts.
TEXTS = 1 << 14


def matches(filters: Mapping[str, object] | None) -> Column:
    """Conjunction of column = value, applied before ranking."""
    condition = F.lit(True)
    for column, value in (filters or {}).items():
        condition = condition & (F.col(column) == F.lit(value))
    return condition


def word_counts(df: DataFrame, keys: Sequence[str], text: Column, tasks: int | None = None) -> DataFrame:
    """How often each word occurs under ``keys``.

    With ``tasks`` the texts are dealt out by the first key before they are taken apart: a
    small file that one task reads may hold millions of them, and their words are then
    counted where they lie.
    """
    texts = df.select(*keys, text.alias("text"))
    dealt = texts if tasks is None else texts.repartition(tasks, keys[0])
    return dealt.select(*keys, F.explode(words(F.col("text"))).alias("word")).groupBy(*keys, "word").agg(
        F.count("*").alias("times")
    )


def text_tasks(texts: int) -> int:
    """Tasks that so many texts are dealt to. Their bytes tell little: files and shuffles of
    a catalogue compress well, and its words take many times their size."""
    return texts // TEXTS + 1


def corpus(products: DataFrame, block: Column) -> DataFrame:
    """(product_id, block, text): all descriptive text of each product."""
    known = products.where(F.col("product_id").isNotNull())
    return known.select("product_id", block.alias("block"), F.concat_ws(" ", *PRODUCT_TEXT).alias("text"))


def catalogue_words(products: DataFrame) -> DataFrame:
    """``(product_id, block, word, times)`` of a catalogue by category, stored: its index and
    its style hits then need not take the texts apart again."""
    texts = corpus(products, F.col("category"))
    counted = word_counts(texts, ["product_id", "block"], F.col("text"), text_tasks(texts.count()))
    return cut_lineage(counted, "word_counts")


def vocabulary(text_words: DataFrame, total: Column) -> DataFrame:
    """``(word, idf)`` of all words."""
    # Reading ``times`` here lets both uses of the words share one shuffle.
    products = F.count_if(F.col("times") > 0)
    return text_words.groupBy("word").agg(F.log((total + 1) / (products + 1)).alias("idf"))


def word_weights(text_words: DataFrame, total: Column) -> DataFrame:
    """``(word, idf)`` of the words that tell products apart.

    A word every product has weighs nothing and is left out, and with it the only
    words that all products share.
    """
    return vocabulary(text_words, total).where(F.col("idf") > 0)


def unit_queries(query_words: DataFrame, idf: DataFrame, total: Column, key: str) -> DataFrame:
    """Query words with their weights, each query of length 1.

    A word no product has still counts towards the length. So does none that all
    products have: its weight is 0, and it is told from an unknown one by ``known``.
    """
    weight = F.col("times") * F.coalesce(F.col("idf"), F.when(F.col("known"), 0.0).otherwise(F.log(total + 1)))
    length = F.sqrt(F.sum(F.col("asked") ** 2).over(Window.partitionBy(key)))
    weighed = query_words.join(idf, "word", "left").withColumn("asked", weight)
    return weighed.withColumn("asked", F.try_divide(F.col("asked"), length))


def text_similarity(
    texts: DataFrame, queries: DataFrame, catalogue: DataFrame | None = None, counted: DataFrame | None = None
) -> DataFrame:
    """Cosine of each text with the query of its block.

    ``queries`` holds one (block, text) row per block. Word weights come from
    ``catalogue``, of which ``texts`` may be a part. A text without common words
    scores 0. ``counted`` holds the catalogue's word counts where they are stored.
    """
    catalogue = texts if catalogue is None else catalogue
    count = catalogue.count()
    total, tasks = F.lit(count), text_tasks(count)
    known_words = word_counts(catalogue, ["product_id", "block"], F.col("text"), tasks) if counted is None else counted
    text_words = known_words if catalogue is texts else word_counts(texts, ["product_id", "block"], F.col("text"), tasks)
    # Stored, as the queries and the texts both need it: the words are counted once for it.
    known = cut_lineage(vocabulary(known_words, total), "vocabulary")
    idf = known.where(F.col("idf") > 0)
    asked = _mark_known(word_counts(queries, ["block"], F.col("text")), known)
    unit = unit_queries(asked, idf, total, "block").select("block", "word", "asked")

    weight = F.col("times") * F.col("idf")
    shared = F.coalesce(F.sum(weight * F.col("asked")), F.lit(0.0))
    similarity = F.try_divide(shared, F.sqrt(F.sum(weight**2)))
    # The queries are stored, so that few of them are sent to the words, not the words to them.
    matched = text_words.join(idf, "word").join(cut_lineage(unit, "asked"), ["block", "word"], "left")
    scored = matched.groupBy("product_id").agg(similarity.alias("similarity"))
    return scored.withColumn("similarity", F.round("similarity", SIMILARITY_PLACES))


def _mark_known(query_words: DataFrame, text_words: DataFrame) -> DataFrame:
    """Query words with ``known``: whether any product has the word."""
    known = text_words.select("word").distinct().withColumn("known", F.lit(True))
    return query_words.join(known, "word", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def search_text(
    products: DataFrame, queries: DataFrame, k: int = 5, filters: Mapping[str, object] | None = None
) -> DataFrame:
    """The ``k`` products most like each query, of those that share a word with it.

    ``queries`` has rows ``(query_id, text, category)``; a category narrows its query,
    null asks the whole catalogue. Filters pick the candidates before any is scored.
    Only words that tell products apart bring products and queries together.
    """
    catalogue = corpus(products, F.col("category"))
    count = catalogue.count()
    total, tasks = F.lit(count), text_tasks(count)
    known_words = word_counts(catalogue, ["product_id", "block"], F.col("text"), tasks)
    candidates = products.where(matches(filters))
    some_words = known_words
    if filters:
        some_words = word_counts(corpus(candidates, F.col("category")), ["product_id", "block"], F.col("text"), tasks)
    idf = word_weights(known_words, total)
    asked = word_counts(queries, ["query_id", "category"], F.col("text"))
    unit = unit_queries(_mark_known(asked, known_words), idf, total, "query_id").where(F.col("asked") > 0)

    weighed = some_words.join(idf, "word").withColumn("weight", F.col("times") * F.col("idf"))
    lengths = weighed.groupBy("product_id").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("length"))
    wanted = F.col("category").isNull() | (F.col("category") == F.col("block"))
    asked_words = cut_lineage(unit.select("query_id", "category", "word", "asked"), "asked")
    shared = (
        weighed.select("product_id", "block", "word", "weight")
        .join(asked_words, "word")
        .where(wanted)
        .groupBy("query_id", "product_id")
        .agg(F.sum(F.col("weight") * F.col("asked")).alias("shared"))
    )
    similarity = F.round(F.col("shared") / F.col("length"), SIMILARITY_PLACES)
    scored = shared.join(lengths, "product_id").withColumn("similarity", similarity)
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "product_id")
    ranked = scored.withColumn("hit_rank", F.row_number().over(best)).where(F.col("hit_rank") <= k)
    return with_hit_columns(ranked.select("query_id", "hit_rank", "product_id", "similarity"), products)


def with_hit_columns(hits: DataFrame, products: DataFrame) -> DataFrame:
    """Hits with the columns of their products.

    The catalogue is shuffled: its files are a fraction of what a broadcast holds.
    """
    return hits.join(products.select(*HIT_COLUMNS).hint("merge"), "product_id")


def _with_similarity(products: DataFrame, similarity: DataFrame) -> DataFrame:
    joined = products.join(similarity, "product_id", "left")
    return joined.withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))


def similar_by_text(
    products: DataFrame, query_text: str, k: int = 5, filters: Mapping[str, object] | None = None
) -> DataFrame:
    """The ``k`` products most like a free-text query, after the attribute filters.

    Word weights come from the whole catalogue; the filters only pick candidates.
    """
    everything = F.lit("all")
    asked = products.sparkSession.range(1).select(everything.alias("block"), F.lit(query_text).alias("text"))
    candidates = products.where(matches(filters))
    texts = corpus(candidates, everything)
    similarity = text_similarity(texts, asked, corpus(products, everything) if filters else None)
    found = _with_similarity(candidates.select(*HIT_COLUMNS), similarity)
    return found.orderBy(F.desc("similarity"), "product_id").limit(k)


def style_queries(products: DataFrame) -> DataFrame:
    """One query text per category."""
    named = products.where(F.col("category").isNotNull())
    return named.select(F.col("category").alias("block")).distinct().select(
        "block", F.format_string(STYLE_QUERY, F.col("block")).alias("text")
    )


def style_hits(
    products: DataFrame, k: int = 5, new_arrivals: bool = True, counted: DataFrame | None = None
) -> DataFrame:
    """The ``k`` best products per category for the category's style query.

    With ``new_arrivals`` only those are ranked, except in categories that have
    none: there the whole category is. The query depends on the category alone, so
    each is answered once for all customers. ``counted``: the ``catalogue_words``, if stored.
    """
    similarity = text_similarity(corpus(products, F.col("category")), style_queries(products), counted=counted)
    scored = _with_similarity(products.select(*HIT_COLUMNS, "is_new_arrival"), similarity)
    is_new = F.coalesce(F.col("is_new_arrival"), F.lit(False))
    # Ranking new arrivals first and dropping older products behind any of them is
    # the same as asking again without the filter where nothing was found.
    first = [is_new.desc()] if new_arrivals else []
    best = Window.partitionBy("category").orderBy(*first, F.desc("similarity"), "product_id")
    ranked = scored.withColumn("hit_rank", F.row_number().over(best)).where(F.col("hit_rank") <= k)
    if not new_arrivals:
        return ranked
    any_new = F.max(is_new).over(Window.partitionBy("category"))
    return ranked.withColumn("any_new", any_new).where(is_new | ~F.col("any_new")).drop("any_new")


def label_centroids(vectors: DataFrame) -> DataFrame:
    """The mean vector of each label: one query per label, named like it."""
    mean = Summarizer.mean(array_to_vector(F.col("embedding")))
    centres = vectors.groupBy("label").agg(vector_to_array(mean).alias("query"))
    return centres.withColumn("query_id", F.col("label"))


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` vectors of a label nearest to each of the label's queries.

    ``queries`` holds rows ``(query_id, label, query)``; only ``k`` rows per query and
    task reach the ranking. The queries are brought to length 1 and stored first: that
    is done once for each, and the vectors are not shuffled to them unless the queries
    really are too large to broadcast.
    """
    ready = queries.select("query_id", "label", unit(F.col("query")).alias("query"))
    scored = vectors.join(cut_lineage(ready, "queries"), "label").select(
        "query_id", "label", "vec_id", along(F.col("embedding"), F.col("query")).alias("similarity")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return scored.withColumn("hit_rank", F.row_number().over(order)).where(F.col("hit_rank") <= k)


def nearest_to(
    vectors: DataFrame, query: Sequence[float], k: int = 5, filters: Mapping[str, object] | None = None
) -> DataFrame:
    """The ``k`` vectors nearest to one given vector, after the attribute filters."""
    length = math.sqrt(math.fsum(float(x) ** 2 for x in query))
    asked = F.array(*[F.lit(float(x) / length if length else None).cast("double") for x in query])
    scored = vectors.where(matches(filters)).withColumn("similarity", along(F.col("embedding"), asked))
    return scored.orderBy(F.desc("similarity"), "vec_id").limit(k)


def with_products(hits: DataFrame, products: DataFrame) -> DataFrame:
    """Vector hits with the columns of the product each vector describes."""
    named = products.select(*HIT_COLUMNS)
    return hits.join(named, F.col("vec_id") == F.col("product_id"))
