"""Product recommendations for all customers at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import rules, text
from shelfwise.functions.clock import AsOf, instant
from shelfwise.operators.metrics import category_interest
from shelfwise.operators.ordering import running_total
from shelfwise.sources.scratch import cut_lineage

# Interests per customer, products per category, shelf size.
INTERESTS = 3
PRODUCTS_PER_CATEGORY = 10
SHELF_SIZE = 9

SCORE_COLUMNS = [
    "customer_id",
    "product_id",
    "product_name",
    "category",
    "price",
    "rating",
    "is_new_arrival",
    "score",
    "score_type",
    "reasoning",
]


def top_interests(intent: DataFrame, golden: DataFrame, n: int = INTERESTS) -> DataFrame:
    """Up to ``n`` categories per customer.

    A customer without any intent row gets the first ``n`` preferred categories with
    score 0. One full join serves both cases: where it finds no intent, the category
    is null and the profile fills in.
    """
    strongest = intent.where(F.col("category_rank") <= n).select(
        "customer_id",
        F.col("resolved_category").alias("category"),
        "intent_score",
        "event_count",
        "latest_interaction",
        F.col("category_rank").alias("interest_rank"),
    )
    profile = golden.select(
        "customer_id", F.slice(text.json_strings(F.col("preferred_categories")), 1, n).alias("preferred")
    )
    fields = ["category", "intent_score", "event_count", "latest_interaction", "interest_rank"]
    types = {f: strongest.schema[f].dataType for f in fields}
    seen = F.struct(*fields)
    cold = F.transform(
        F.col("preferred"),
        lambda category, position: F.struct(
            category.alias("category"),
            F.lit(0).cast(types["intent_score"]).alias("intent_score"),
            F.lit(0).cast(types["event_count"]).alias("event_count"),
            F.lit(None).cast(types["latest_interaction"]).alias("latest_interaction"),
            (position + 1).cast(types["interest_rank"]).alias("interest_rank"),
        ),
    )
    both = strongest.join(profile, "customer_id", "full")
    picked = F.when(F.col("category").isNull(), cold).otherwise(F.array(seen))
    return both.select("customer_id", F.inline(picked))


def ranked_products(products: DataFrame, n: int = PRODUCTS_PER_CATEGORY) -> DataFrame:
    """The ``n`` best products per category by rating, then number of reviews."""
    best = Window.partitionBy("category").orderBy(F.desc("rating"), F.desc("review_count"), "product_id")
    return (
        products.select(
            "product_id", "product_name", "category", "price", "rating", "review_count", "is_new_arrival"
        )
        .withColumn("product_rank", F.row_number().over(best))
        .where(F.col("product_rank") <= n)
    )


def content_scores(interests: DataFrame, products: DataFrame) -> DataFrame:
    """Score every customer's interests against the best products of each category.

    The shelf is stored first: with its real size known it is broadcast, and the
    interests need no shuffle on a few, possibly hot, categories.
    """
    offered = interests.join(cut_lineage(ranked_products(products), "shelf"), "category")
    return (
        offered.withColumn("score", rules.relevance(F.col("intent_score"), F.col("rating")))
        .withColumn("score_type", F.lit("content_based"))
        .withColumn("reasoning", content_reasoning())
        .select(*SCORE_COLUMNS)
    )


def category_heat(intent: DataFrame) -> DataFrame:
    """``(category, heat)``: the share of the hottest category's interest, in the units
    that ``relevance`` takes."""
    heat = category_interest(intent)
    hottest = heat.select(F.max("total_interest")).scalar()
    share = rules.ratio(F.col("total_interest"), hottest).cast("decimal(18,8)") * rules.FULL_INTENT
    return heat.select(
        F.col("resolved_category").alias("category"), F.round(share, 2).cast("decimal(18,2)").alias("heat")
    )


CANDIDATE_COLUMNS = ["category", "product_id", "product_name", "price", "rating", "is_new_arrival"]


def category_candidates(products: DataFrame, intent: DataFrame, hits: DataFrame) -> DataFrame:
    """The few products of each category that scores are made of, one small table.

    ``kind`` tells the best products (with their category's ``heat``) from the style
    hits (with their ``similarity``).
    """
    shelf = ranked_products(products).join(category_heat(intent), "category", "left")
    best = shelf.select(
        *CANDIDATE_COLUMNS, F.lit("shelf").alias("kind"), "heat", F.lit(None).cast("decimal(18,4)").alias("similarity")
    )
    style = hits.where(F.col("category").isNotNull()).select(
        *CANDIDATE_COLUMNS,
        F.lit("style").alias("kind"),
        F.lit(None).cast("decimal(18,2)").alias("heat"),
        F.col("similarity").cast("decimal(18,4)").alias("similarity"),
    )
    return best.unionByName(style)


def candidate_scores(interests: DataFrame, candidates: DataFrame) -> DataFrame:
    """Content, trending and vibe scores of every customer, from one join."""
    intent, rating = F.col("intent_score"), F.col("rating")
    shelf, style = F.col("kind") == "shelf", F.col("kind") == "style"

    def scored(applies: Column, score: Column, kind: str, reasoning: Column) -> Column:
        entry = F.struct(score.alias("score"), F.lit(kind).alias("score_type"), reasoning.alias("reasoning"))
        return F.when(applies, entry)

    category = F.col("category")
    entries = F.array(
        scored(shelf, rules.relevance(intent, rating), "content_based", content_reasoning()),
        scored(
            shelf & F.col("heat").isNotNull(),
            rules.relevance(F.col("heat"), rating),
            "trending",
            F.concat(F.lit("Trending in "), category),
        ),
        scored(style, F.col("similarity"), "vibe_match", F.concat(F.lit("Matches the style of "), category)),
    )
    wanted = interests.select("customer_id", "category", "intent_score")
    matched = wanted.join(candidates, "category")
    return matched.select(
        "customer_id", *CANDIDATE_COLUMNS, F.inline(F.array_compact(entries))
    ).select(*SCORE_COLUMNS)


def content_reasoning() -> Column:
    rating = F.col("rating").cast("double").cast("string")
    return F.concat(
        F.lit("High intent ("),
        text.one_decimal(F.col("intent_score")),
        F.lit(") in "),
        F.col("category"),
        F.lit(" + product rating "),
        F.coalesce(rating, F.lit("none")),
    )


def trending_scores(interests: DataFrame, intent: DataFrame, products: DataFrame) -> DataFrame:
    """Best products of a customer's categories, scored by how hot the category is.

    The score is the category's share of the hottest category's interest times the
    rating share.
    """
    shares = category_heat(intent)
    shelf = ranked_products(products).join(shares, "category")
    scored = shelf.withColumn("score", rules.relevance(F.col("heat"), F.col("rating"))).withColumn(
        "reasoning", F.concat(F.lit("Trending in "), F.col("category"))
    )
    shown = scored.withColumn("score_type", F.lit("trending")).select(*SCORE_COLUMNS[1:])
    wanted = interests.select("customer_id", "category")
    return wanted.join(cut_lineage(shown, "shelf"), "category").select(*SCORE_COLUMNS)


def style_recommendations(interests: DataFrame, hits: DataFrame) -> DataFrame:
    """The style hits of each of a customer's categories, one row per product."""
    wanted = interests.select("customer_id", "category", "intent_score", "interest_rank")
    return wanted.join(cut_lineage(hits, "hits"), "category")


def style_basket(interests: DataFrame, hits: DataFrame) -> DataFrame:
    """Per customer and category the hits as one array, best first."""
    rows = style_recommendations(interests, hits)
    hit = F.struct("hit_rank", "product_id", "product_name", "price", "similarity")
    return rows.groupBy("customer_id", "interest_rank", "category").agg(
        F.array_sort(F.collect_list(hit)).alias("products")
    )


def vibe_scores(interests: DataFrame, hits: DataFrame) -> DataFrame:
    """Style hits as scores: the score is the similarity."""
    return (
        style_recommendations(interests, hits)
        .withColumn("score", F.col("similarity").cast("decimal(18,4)"))
        .withColumn("score_type", F.lit("vibe_match"))
        .withColumn("reasoning", F.concat(F.lit("Matches the style of "), F.col("category")))
        .select(*SCORE_COLUMNS)
    )


def purchase_baskets(purchases: DataFrame) -> DataFrame:
    """One row per customer and product with the time it was last bought."""
    return (
        purchases.where(F.col("product_id").isNotNull())
        .groupBy("customer_id", "product_id")
        .agg(F.max("purchase_date").alias("last_bought"))
    )


def latest_products(baskets: DataFrame) -> DataFrame:
    """The product each customer bought last; greatest id among equal times."""
    return baskets.where(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        F.max(F.struct("last_bought", "product_id"))["product_id"].alias("anchor_id")
    )


def _ranked(bought: DataFrame, key: str) -> DataFrame:
    """``(key, product_id, co_buyers, companion_rank)``, the most bought first.

    Ranks run on slices of the whole order, so that one popular key's products are
    never ranked in one task.
    """
    counted = bought.groupBy(key, "product_id").agg(F.count("*").alias("co_buyers"))
    order = [F.desc("co_buyers"), F.col("product_id")]
    return running_total(counted.withColumn("one", F.lit(1)), [key], order, "one", "companion_rank").drop("one")


def ranked_companions(baskets: DataFrame, anchors: DataFrame) -> DataFrame:
    """All products bought by the customers whose last purchase was the anchor.

    Counting a basket against its one anchor needs one row per customer and product,
    so a customer with a huge basket costs its size and not its square.
    """
    pairs = baskets.join(anchors, "customer_id").where(F.col("product_id") != F.col("anchor_id"))
    buyers = anchors.groupBy("anchor_id").agg(F.count("*").alias("anchor_buyers"))
    return _ranked(pairs, "anchor_id").join(buyers, "anchor_id")


def last_purchase_companions(baskets: DataFrame, n: int = PRODUCTS_PER_CATEGORY) -> DataFrame:
    """The ``n`` best of ``ranked_companions`` for each anchor."""
    ranked = ranked_companions(baskets, latest_products(baskets))
    return ranked.where(F.col("companion_rank") <= n)


def _shuffled(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the input. Spark would broadcast it by the size
    of its files, or of those it is exploded from, and it is many times larger in memory."""
    return df.hint("merge")


#: The two groups of shoppers that a customer's last purchase puts them in, with the words of the reason.
SHOPPERS = {
    "product": "Bought by %d of %d shoppers with the same last purchase",
    "category": "Bought by %d of %d shoppers who last bought in the same category",
}


def _shopper_groups(baskets: DataFrame, products: DataFrame) -> DataFrame:
    """``(customer_id, basket_size, anchor_id, kind, key)``: each customer's groups."""
    sizes = baskets.groupBy("customer_id").agg(F.count("*").alias("basket_size"))
    categories = products.select(F.col("product_id").alias("anchor_id"), F.col("category").alias("anchor_category"))
    anchors = latest_products(baskets).join(_shuffled(sizes), "customer_id")
    anchors = anchors.join(_shuffled(categories), "anchor_id", "left")
    keys = {"product": F.col("anchor_id").cast("string"), "category": F.col("anchor_category").cast("string")}
    groups = F.array(*[F.struct(F.lit(kind).alias("kind"), key.alias("key")) for kind, key in keys.items()])
    return anchors.select("customer_id", "basket_size", "anchor_id", F.inline(groups)).where("key is not null")


def collaborative_scores(
    purchases: DataFrame, products: DataFrame, n: int = PRODUCTS_PER_CATEGORY
) -> DataFrame:
    """What others bought, that the customer does not own yet: ``n`` products or all.

    First come products bought by shoppers with the same last purchase, then those
    bought by shoppers whose last purchase lies in the same category. The score is the
    share of those shoppers who bought the product. Of a group's first ``2 n`` +
    ``basket_size`` products at least ``n`` are neither owned nor named already, so no
    longer list is kept or asked for. Small steps are written when this is called.
    """
    baskets = cut_lineage(purchase_baskets(purchases), "baskets")
    groups = cut_lineage(_shopper_groups(baskets, products), "groups")
    wanted = (F.lit(2 * n) + F.col("basket_size")).cast("long")
    sizes = groups.groupBy("kind", "key").agg(F.count("*").alias("shoppers"), F.max(wanted).alias("longest"))

    bought = baskets.select("customer_id", "product_id").join(_shuffled(groups), "customer_id")
    others = bought.where((F.col("kind") != "product") | (F.col("product_id") != F.col("anchor_id")))
    counted = others.groupBy("kind", "key", "product_id").agg(F.count("*").alias("co_buyers"))
    order = [F.desc("co_buyers"), F.col("product_id")]
    ranked = running_total(counted.withColumn("one", F.lit(1)), ["kind", "key"], order, "one", "rank").drop("one")
    ranked = ranked.join(_shuffled(sizes), ["kind", "key"]).where(F.col("rank") <= F.col("longest")).drop("longest")
    ranked = cut_lineage(ranked.withColumn("rank", F.col("rank").cast("long")), "companions")

    lengths = ranked.groupBy("kind", "key").agg(F.max("rank").alias("length"))
    ranks = F.sequence(F.lit(1).cast("long"), F.least(wanted, F.col("length")))
    asked = groups.join(_shuffled(lengths), ["kind", "key"])
    asked = asked.select("customer_id", "kind", "key", F.explode(ranks).alias("rank"))
    owned = baskets.select("customer_id", "product_id")
    found = asked.join(_shuffled(ranked), ["kind", "key", "rank"])
    found = found.join(_shuffled(owned), ["customer_id", "product_id"], "left_anti")
    place = F.struct((F.col("kind") != "product").alias("later"), "rank", "kind", "co_buyers", "shoppers")
    once = found.groupBy("customer_id", "product_id").agg(F.min(place).alias("place"))
    first = Window.partitionBy("customer_id").orderBy("place")
    offered = once.withColumn("slot", F.row_number().over(first)).where(F.col("slot") <= n)
    offered = offered.select("customer_id", "product_id", "place.kind", "place.co_buyers", "place.shoppers")

    score = F.round(rules.ratio(F.col("co_buyers"), F.col("shoppers")).cast("decimal(18,8)"), 4)
    words = F.when(F.col("kind") == "product", SHOPPERS["product"]).otherwise(SHOPPERS["category"])
    catalogue = products.select(
        "product_id", "product_name", "category", "price", "rating", "is_new_arrival"
    )
    return (
        offered.join(_shuffled(catalogue), "product_id")
        .withColumn("score", score.cast("decimal(18,4)"))
        .withColumn("score_type", F.lit("collaborative"))
        .withColumn("reasoning", F.call_function("format_string", words, F.col("co_buyers"), F.col("shoppers")))
        .select(*SCORE_COLUMNS)
    )


def recommendation_scores(*scores: DataFrame, as_of: AsOf = None) -> DataFrame:
    """Rows of the score table: any mix of score types, stamped with ``as_of``."""
    rows = None
    for part in scores:
        part = part.select(
            "customer_id", "product_id", F.col("score").cast("double").alias("score"), "score_type", "reasoning"
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows.withColumn("computed_at", instant(as_of))


def recommendation_shelf(scores: DataFrame, n: int = SHELF_SIZE) -> DataFrame:
    """The ``n`` best-scored products per customer, with display texts."""
    best = Window.partitionBy("customer_id").orderBy(F.desc("score"), F.desc("rating"), "product_id")
    shelf = scores.withColumn("slot", F.row_number().over(best)).where(F.col("slot") <= n)
    return shelf.withColumn("price_text", text.dollars(F.col("price"))).withColumn(
        "match_text", F.concat(text.percent(F.col("score")), F.lit(" match"))
    )
