"""Recommendations over the layered tables, for all customers or for one.

For one customer the filter goes onto the inputs: Catalyst carries it on through
windows and aggregates to the scans, but not through the full join of interests.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.clock import AsOf
from shelfwise.operators import recommend, similarity, text_index
from shelfwise.plans.medallion import Medallion
from shelfwise.sources.scratch import cut_lineage


def _only(df: DataFrame, customer_id: object | None) -> DataFrame:
    return df if customer_id is None else df.where(F.col("customer_id") == F.lit(customer_id))


@dataclass(frozen=True)
class Recommendations:
    layers: Medallion
    as_of: AsOf = None

    def _interests(self, customer_id: object | None, n: int = recommend.INTERESTS) -> DataFrame:
        return recommend.top_interests(
            _only(self.layers.intent, customer_id), _only(self.layers.golden, customer_id), n
        )

    def top_interests(self, customer_id: object | None = None, n: int = recommend.INTERESTS) -> DataFrame:
        return self._interests(customer_id, n).orderBy("customer_id", "interest_rank")

    def similar_products(self, query_text: str, k: int = 5, filters: dict | None = None) -> DataFrame:
        """From the catalogue's text index: reads the postings of the query's words."""
        return text_index.find_products(self.layers.text_index, self.layers.bronze.products, query_text, k, filters)

    def style(self, customer_id: object | None = None, new_arrivals: bool = True) -> DataFrame:
        """For one customer only the categories that interest them are looked up."""
        products = self.layers.bronze.products
        if customer_id is None:
            hits = similarity.style_hits(products, new_arrivals=new_arrivals)
            return recommend.style_basket(self._interests(None), hits)
        interests = cut_lineage(self._interests(customer_id), "interests")
        categories = interests.select("category")
        hits = text_index.style_lookups(self.layers.text_index, products, categories, new_arrivals=new_arrivals)
        return recommend.style_basket(interests, hits)

    def content_scores(self, customer_id: object | None = None) -> DataFrame:
        """From the candidates of the customers' categories, which published layers store."""
        shelf = self.layers.candidates.where(F.col("kind") == "shelf")
        scores = recommend.candidate_scores(self._interests(customer_id), shelf)
        content = scores.where(F.col("score_type") == "content_based")
        return content.orderBy("customer_id", F.desc("score"), "product_id")

    def scores(self) -> DataFrame:
        """Rows of the score table with all four score types."""
        self.layers.settle("candidates")
        products, purchases = self.layers.bronze.products, self.layers.bronze.purchases
        return recommend.recommendation_scores(
            recommend.candidate_scores(self._interests(None), self.layers.candidates),
            recommend.collaborative_scores(purchases, products),
            as_of=self.as_of,
        )
