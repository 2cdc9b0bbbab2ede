"""Products bought by the same customers: all pairs from a least cosine on, exactly.

A product is the set of its buyers. The cosine of two products is the number of buyers
they share over the root of the product of both numbers. Products are numbered by the size
of their sets, and a pair belongs to its smaller set, which must share the cosine times its
size at least.

Customers with up to ``LIGHT`` products send each of them the list of those numbered
behind it. The lists meet by the smaller set's number, are taken apart and counted there,
so that pairs themselves never travel: what is shuffled and stored grows with the
purchases.

Customers with more products are heavy. Ordered behind the light ones by the size of their
baskets, they are paired only where they stand within the first ``n - ceil(t n) + 1``
buyers of the smaller set and the first ``m - ceil(t^2 m) + 1`` of the larger one: two sets
that reach the cosine ``t`` share a buyer within these. Such a meeting, or a light buyer,
makes a candidate, and the heavy buyers that candidates share are counted from whole sets,
which are stored in parts of some thousand buyers, so that no task holds a bestseller's
buyers at once. Products with fewer buyers than ``least_buyers`` are not compared.

Purchases without a customer or a product tell nothing and are left out; buying twice
counts once. No purchases give no pairs.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.ordering import global_rank, running_total
from shelfwise.sources.scratch import cut_lineage

#: Heavy buyers in a stored part of a product's set.
PART = 4096
#: Products of a customer whose basket is held in one list.
LIGHT = 512
#: Pairs that a task counts, about.
PAIRS = 1 << 20


def _reaches(shared: Column, left: Column, right: Column, square: Decimal) -> Column:
    """Whether so many shared buyers make up the least cosine, in whole numbers."""
    wide = [c.cast("decimal(12,0)") for c in (left, right)]
    return (shared * shared).cast("decimal(24,0)") >= F.ceil(F.lit(square) * wide[0] * wide[1])


def _least(share: Decimal, size: Column) -> Column:
    return F.ceil(F.lit(share) * size.cast("decimal(12,0)")).cast("long")


def _light_lists(light: DataFrame) -> DataFrame:
    """``(number, asked, others)``: a basket's products with those numbered behind them."""
    product = F.struct("number", "asked")
    baskets = light.groupBy("customer_id").agg(F.array_sort(F.collect_list(product)).alias("basket"))
    numbers = F.col("basket").getField("number")
    each = baskets.select(numbers.alias("numbers"), F.posexplode("basket").alias("place", "product"))
    others = F.slice("numbers", F.col("place") + 2, F.lit(LIGHT))
    return each.where(F.size("numbers") > F.col("place") + 1).select("product.*", others.alias("others"))


def _heavy_lists(placed: DataFrame) -> DataFrame:
    """Meetings of two products at a heavy buyer within the prefixes of both, as lists
    of one product each."""
    left = placed.where("place <= first").select("customer_id", "number", "asked")
    right = placed.where("place <= other_first").select("customer_id", F.col("number").alias("other"))
    met = left.join(right.hint("merge"), "customer_id").where(F.col("number") < F.col("other"))
    return met.select("number", "asked", F.array("other").alias("others"))


def _heavy_shared(candidates: DataFrame, heavy: DataFrame) -> DataFrame:
    """``(number, other, heavy_shared)`` of the candidates, from whole sets."""
    largest = heavy.groupBy("number").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    part = F.pmod(F.xxhash64("customer_id"), F.lit(largest // PART + 1))
    parts = heavy.groupBy("number", part.alias("part")).agg(F.collect_list("customer_id").alias("buyers"))
    parts = cut_lineage(parts, "sets")
    others = parts.select(F.col("number").alias("other"), "part", F.col("buyers").alias("other_buyers"))
    checked = candidates.select("number", "other").join(parts.hint("merge"), "number").join(others.hint("merge"), ["other", "part"])
    shared = F.sum(F.size(F.array_intersect("buyers", "other_buyers"))).alias("heavy_shared")
    return checked.groupBy("number", "other").agg(shared)


def co_purchase_pairs(purchases: DataFrame, least_cosine: Decimal, least_buyers: int = 2) -> DataFrame:
    """``(product_id, other_id, co_buyers, cosine)``, ``product_id`` being the smaller id,
    of all pairs whose cosine is at least ``least_cosine``."""
    if not 0 < least_cosine <= 1:
        raise ValueError("the least cosine must lie above 0 and be at most 1")
    cosine, square = Decimal(least_cosine), Decimal(least_cosine) ** 2
    bought = purchases.select("customer_id", "product_id").where("customer_id is not null and product_id is not null")
    bought = cut_lineage(bought.distinct(), "buyers")
    sizes = bought.groupBy("product_id").agg(F.count("*").alias("n")).where(F.col("n") >= least_buyers)
    numbered = cut_lineage(global_rank(sizes, ["n", "product_id"], "number"), "numbers")

    baskets = bought.groupBy("customer_id").agg(F.count("*").alias("basket_size"))
    heavy_ones = cut_lineage(baskets.where(F.col("basket_size") > LIGHT), "heavy_customers")
    by_product = numbered.select("product_id", "n", "number").hint("merge")
    sets = bought.join(by_product, "product_id").join(heavy_ones, "customer_id", "left")
    heavy = cut_lineage(sets.where("basket_size is not null").select("customer_id", "number", "n", "basket_size"), "heavy")
    held = heavy.groupBy("number").agg(F.count("*").alias("heavy_buyers"))
    products = numbered.join(held, "number", "left").withColumn("heavy_buyers", F.coalesce("heavy_buyers", F.lit(0)))
    # So many light buyers the smaller set shares at least, if it shares all its heavy ones.
    asked = F.greatest(_least(cosine, F.col("n")) - F.col("heavy_buyers"), F.lit(0)).alias("asked")
    products = cut_lineage(products.select("product_id", "n", "number", "heavy_buyers", asked), "products")

    light = bought.join(products.select("product_id", "number", "asked").hint("merge"), "product_id")
    light = light.join(heavy_ones, "customer_id", "left_anti")
    lists = _light_lists(light.select("customer_id", "number", "asked")).withColumn("light", F.lit(1))
    ranked = running_total(heavy.withColumn("one", F.lit(1)), ["number"], ["basket_size", "customer_id"], "one", "rank")
    ranked = ranked.join(products.select("number", "heavy_buyers", "asked"), "number")
    place, n = F.col("n") - F.col("heavy_buyers") + F.col("rank"), F.col("n")
    ranked = ranked.withColumns({"place": place, "first": n - _least(cosine, n) + 1, "other_first": n - _least(square, n) + 1})
    lists = lists.unionByName(_heavy_lists(ranked).withColumn("light", F.lit(0)))

    of_light = baskets.where(F.col("basket_size") <= LIGHT)
    pairs = of_light.agg(F.sum(F.col("basket_size") * (F.col("basket_size") - 1) / 2)).first()[0] or 0
    tasks = max(int(pairs) // PAIRS + 1, purchases.sparkSession.sparkContext.defaultParallelism)
    met = lists.repartition(tasks, "number").select("number", "asked", "light", F.explode("others").alias("other"))
    # Counted where the lists met: the number alone has already brought a pair together.
    counted = met.groupBy("number", "asked", "other").agg(F.sum("light").alias("shared")).where("shared >= asked")
    counted = cut_lineage(counted.select("number", "other", "shared"), "counted")
    left = products.select("number", "product_id", "n", F.col("heavy_buyers").alias("heavy_left"))
    right = products.select(
        F.col("number").alias("other"), F.col("product_id").alias("other_id"), F.col("n").alias("m"), F.col("heavy_buyers").alias("heavy_right")
    )
    known = counted.join(left.hint("merge"), "number").join(right.hint("merge"), "other")
    unseen = F.least("heavy_left", "heavy_right")
    known = known.withColumn("unseen", unseen).where(_reaches(F.col("shared") + F.col("unseen"), F.col("n"), F.col("m"), square))
    candidates = cut_lineage(known.drop("heavy_left", "heavy_right"), "candidates")

    more = _heavy_shared(candidates.where("unseen > 0"), heavy)
    checked = candidates.join(more, ["number", "other"], "left")
    checked = checked.withColumn("co_buyers", F.col("shared") + F.coalesce("heavy_shared", F.lit(0)))
    sound = checked.where(_reaches(F.col("co_buyers"), F.col("n"), F.col("m"), square))
    return sound.select(
        F.least("product_id", "other_id").alias("product_id"),
        F.greatest("product_id", "other_id").alias("other_id"),
        "co_buyers",
        F.round(F.col("co_buyers") / F.sqrt(F.col("n") * F.col("m")), 6).alias("cosine"),
    )
