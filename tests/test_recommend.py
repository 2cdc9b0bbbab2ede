"""Interests, recommendations, similarity, offers and portal rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfwise import schemas
from shelfwise.operators import loyalty, offers, portal, recommend, similarity, state
from shelfwise.operators.enrich import enrich_clicks
from shelfwise.plans.medallion import Bronze, Medallion
from shelfwise.plans.recommendations import Recommendations
from tests import fixtures as fx

INTENT = (
    "customer_id string, resolved_category string, intent_score decimal(18,2), event_count bigint,"
    " latest_interaction timestamp, category_rank int"
)
GOLDEN = "customer_id string, preferred_categories string"


def _intent(spark, rows):
    full = [(c, k, Decimal(s), 1, fx.at("2026-03-05 11:00:00"), rank) for c, k, s, rank in rows]
    return spark.createDataFrame(full, INTENT)


def _interests(spark):
    intent = _intent(
        spark,
        [("C1", "Denim", "12", 1), ("C1", "Tops", "3", 2), ("C1", "Shoes", "2", 3), ("C1", "Dresses", "1", 4)],
    )
    golden = spark.createDataFrame(
        [
            ("C1", '["Swimwear"]'),
            ("C2", '["Shoes", "Tops", "Denim", "Dresses"]'),
            ("C3", "not json"),
            ("C4", "[]"),
            ("C5", None),
            ("C6", '["Tops"]'),
        ],
        GOLDEN,
    )
    return recommend.top_interests(intent, golden)


def test_interests_fall_back_to_the_profile(spark):
    rows = _interests(spark).orderBy("customer_id", "interest_rank").collect()
    assert [(r["customer_id"], r["category"], float(r["intent_score"])) for r in rows] == [
        ("C1", "Denim", 12.0),
        ("C1", "Tops", 3.0),
        ("C1", "Shoes", 2.0),
        ("C2", "Shoes", 0.0),
        ("C2", "Tops", 0.0),
        ("C2", "Denim", 0.0),
        ("C6", "Tops", 0.0),
    ]
    assert all(r["latest_interaction"] is None and r["event_count"] == 0 for r in rows[3:])


def test_content_scores_take_the_best_ten_products(spark):
    products = fx.products(
        spark,
        [
            {
                "product_id": f"P{i:02}",
                "product_name": f"Jeans {i}",
                "category": "Denim",
                "price": 20.0,
                "rating": 4.5 if i < 11 else 4.9,
                "review_count": i,
            }
            for i in range(12)
        ],
    )
    scores = recommend.content_scores(_interests(spark), products)
    rows = fx.dicts(scores.where("customer_id = 'C1'"), F.desc("score"), "product_id")
    assert len(rows) == 10
    assert rows[0]["product_id"] == "P11" and rows[0]["score"] == Decimal("0.5880")
    assert {r["product_id"] for r in rows[1:]} == {f"P{i:02}" for i in range(2, 11)}
    assert rows[1]["score"] == Decimal("0.5400")
    assert rows[1]["reasoning"] == "High intent (12.0) in Denim + product rating 4.5"
    cold = scores.where("customer_id = 'C2'").select("score").distinct().collect()
    assert [r["score"] for r in cold] == [Decimal("0.0000")]

    shelf = fx.dicts(recommend.recommendation_shelf(scores).where("customer_id = 'C1'"), "slot")
    assert [r["slot"] for r in shelf] == list(range(1, 10))
    assert shelf[0]["price_text"] == "$20.00" and shelf[0]["match_text"] == "59% match"


def test_collaborative_scores_match_a_plain_loop(spark):
    picker = random.Random(5)
    rows = []
    for customer in range(30):
        for product in picker.sample(range(12), picker.randrange(1, 8)):
            when = f"2026-01-{picker.randrange(1, 29):02} 00:00:00"
            rows.append(
                {
                    "transaction_id": f"T{len(rows):03}",
                    "customer_id": f"C{customer:02}",
                    "product_id": f"P{product:02}",
                    "purchase_date": fx.at(when),
                }
            )
    products = fx.products(spark, [{"product_id": f"P{i:02}", "category": "Denim"} for i in range(12)])
    scored = recommend.collaborative_scores(fx.purchases(spark, rows + rows[:5]), products, n=4)
    found = {(r["customer_id"], r["product_id"]): r["score"] for r in scored.collect()}

    baskets, last = defaultdict(set), {}
    for r in rows:
        baskets[r["customer_id"]].add(r["product_id"])
        newest = (r["purchase_date"], r["product_id"])
        last[r["customer_id"]] = max(newest, last.get(r["customer_id"], newest))
    anchor = {c: p for c, (_, p) in last.items()}
    together, buyers = defaultdict(Counter), Counter(anchor.values())
    for c, basket in baskets.items():
        together[anchor[c]].update(basket - {anchor[c]})
    category = Counter(p for basket in baskets.values() for p in basket)
    expected, topped_up = {}, 0
    for c in baskets:
        named: set = set()
        for source, size in ((together[anchor[c]], buyers[anchor[c]]), (category, len(baskets))):
            topped_up += 0 < len(named) < 4
            new = ((p, n) for p, n in source.items() if p not in baskets[c] | named)
            for product, count in sorted(new, key=lambda p: (-p[1], p[0]))[: 4 - len(named)]:
                expected[c, product] = pytest.approx(round(count / size + 1e-12, 4))
                named.add(product)
    assert {k: float(v) for k, v in found.items()} == expected
    assert topped_up and len(expected) > 100


def _catalogue(spark):
    rows = []
    for i, (category, name, new) in enumerate(
        [
            ("Denim", "slim blue jeans", False),
            ("Denim", "wide black jeans style", True),
            ("Denim", "fashion jacket trending trending", False),
            ("Tops", "plain tee", False),
            ("Tops", "crop top style", False),
            ("Shoes", "running sneakers", True),
            ("Shoes", "black ankle boots", True),
        ]
    ):
        rows.append(
            {"product_id": f"P{i}", "product_name": name, "category": category, "is_new_arrival": new, "price": 1.0}
        )
    return fx.products(spark, rows), rows


def _plain_similarity(rows, query_of):
    """TF-IDF cosine in plain Python."""

    def words(text):
        return Counter(w for w in re.split("[^a-z0-9]+", text.lower()) if w)

    texts = {r["product_id"]: words(f"{r['product_name']} {r['category']} S B [] Black") for r in rows}
    spread = Counter(w for t in texts.values() for w in t)

    def weights(counts):
        return {w: n * math.log((len(texts) + 1) / (spread[w] + 1)) for w, n in counts.items()}

    found = {}
    for r in rows:
        mine, asked = weights(texts[r["product_id"]]), weights(words(query_of(r)))
        shared = sum(mine.get(w, 0) * x for w, x in asked.items())
        lengths = math.sqrt(sum(x * x for x in mine.values())) * math.sqrt(sum(x * x for x in asked.values()))
        found[r["product_id"]] = round(shared / lengths, 6) if lengths else 0.0
    return found


def test_text_similarity_matches_plain_python(spark):
    products, rows = _catalogue(spark)
    found = fx.dicts(similarity.similar_by_text(products, "Black jeans, wide!", k=7), "product_id")
    expected = _plain_similarity(rows, lambda r: "Black jeans, wide!")
    assert {r["product_id"]: r["similarity"] for r in found} == pytest.approx(expected)
    assert found[0].keys() == {*similarity.HIT_COLUMNS, "similarity"}

    new = similarity.similar_by_text(products, "ankle", k=5, filters={"is_new_arrival": True, "category": "Shoes"})
    assert [r["product_id"] for r in new.collect()] == ["P6", "P5"]


def test_style_hits_prefer_new_arrivals_where_there_are_any(spark):
    products, rows = _catalogue(spark)
    expected = _plain_similarity(rows, lambda r: f"{r['category']} style trending fashion")
    found = fx.dicts(similarity.style_hits(products, k=2), "category", "hit_rank")
    assert [(r["category"], r["product_id"]) for r in found] == [
        ("Denim", "P1"),
        ("Shoes", "P5" if expected["P5"] >= expected["P6"] else "P6"),
        ("Shoes", "P6" if expected["P5"] >= expected["P6"] else "P5"),
        ("Tops", "P4"),
        ("Tops", "P3"),
    ]
    everything = fx.dicts(similarity.style_hits(products, k=9, new_arrivals=False), "product_id")
    assert {r["product_id"]: r["similarity"] for r in everything} == pytest.approx(expected)


def test_products_without_rating_or_category(spark):
    products = fx.products(
        spark,
        [
            {"product_id": "P1", "product_name": "plain tee", "category": "Tops", "price": 1.0},
            {"product_id": "P2", "product_name": "odd one", "price": 1.0},
        ],
    )
    scores = fx.dicts(recommend.content_scores(_interests(spark), products), "customer_id")
    assert {(r["product_id"], r["score"]) for r in scores} == {("P1", Decimal("0.0000"))}
    assert scores[0]["reasoning"] == "High intent (3.0) in Tops + product rating none"
    hits = similarity.style_hits(products, new_arrivals=False).where("category IS NOT NULL").collect()
    assert [r["product_id"] for r in hits] == ["P1"]


def _types(schema):
    return [(field.name, field.dataType) for field in schema]


def test_serving_rows_have_the_declared_columns(spark):
    basket = offers.offers(_tagged(spark), _intent(spark, []), fx.AS_OF)
    assert _types(basket.schema) == _types(spark.createDataFrame([], schemas.OFFERS).schema)
    scored = recommend.content_scores(_interests(spark), _pair(spark))
    rows = recommend.recommendation_scores(scored, as_of=fx.AS_OF)
    assert _types(rows.schema) == _types(spark.createDataFrame([], schemas.RECOMMENDATION_SCORES).schema)


def test_nearest_vectors_match_plain_python(spark):
    picker = random.Random(9)
    rows = [(i, [picker.uniform(-1, 1) for _ in range(8)], i % 3) for i in range(60)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    query = [picker.uniform(-1, 1) for _ in range(8)]
    best = sorted((r for r in rows if r[2] == 1), key=lambda r: -cosine(r[1], query))[:4]
    assert [r["vec_id"] for r in similarity.nearest_to(vectors, query, 4, {"label": 1}).collect()] == [
        r[0] for r in best
    ]

    found = similarity.nearest_vectors(vectors, similarity.label_centroids(vectors), 3)
    for label in range(3):
        mine = [r for r in rows if r[2] == label]
        centre = [sum(r[1][d] for r in mine) / len(mine) for d in range(8)]
        expected = [r[0] for r in sorted(mine, key=lambda r: -cosine(r[1], centre))[:3]]
        assert [r["vec_id"] for r in fx.dicts(found.where(F.col("label") == label), "hit_rank")] == expected

    named = [("a", 0, query), ("b", 0, [-x for x in query])]
    asked = spark.createDataFrame(named, "query_id string, label int, query array<double>")
    both = similarity.nearest_vectors(vectors, asked, 2).collect()
    assert sorted((r["query_id"], r["hit_rank"]) for r in both) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]


def test_many_searches_at_once(spark):
    products, rows = _catalogue(spark)
    queries = [("q1", "black jeans, wide", None), ("q2", "black jeans, wide", "Shoes"), ("q3", "nothing", None), ("q4", "style", None)]
    asked = spark.createDataFrame(queries, "query_id string, text string, category string")
    found = similarity.search_text(products, asked, k=3)
    assert {*similarity.HIT_COLUMNS, "query_id", "hit_rank", "similarity"} == set(found.columns)
    hits = {(r["query_id"], r["product_id"]): r["similarity"] for r in found.collect()}
    category = {r["product_id"]: r["category"] for r in rows}
    expected = {}
    for query_id, words, only in queries:
        scores = _plain_similarity(rows, lambda r: words)
        best = sorted(((-s, p) for p, s in scores.items() if s > 0 and only in (None, category[p])))[:3]
        expected.update({(query_id, p): -s for s, p in best})
    assert hits == pytest.approx(expected) and ("q3", "P0") not in hits
    narrow = similarity.search_text(products, asked, k=3, filters={"is_new_arrival": True})
    assert {r["product_id"] for r in narrow.collect()} <= {"P1", "P5", "P6"}


@pytest.mark.parametrize(
    "tier, points, mode, expected",
    [
        ("Gold", 12450, "upper", ("Platinum", 37550, 24)),
        ("Silver", 5600, "upper", ("Gold", 14400, 28)),
        ("Gold", 9800, "upper", ("Platinum", 40200, 19)),
        ("Bronze", 1200, "upper", ("Silver", 6800, 15)),
        ("Platinum", 34200, "upper", ("Platinum", 15800, 100)),
        ("Platinum", 60000, "upper", ("Platinum", 0, 100)),
        ("Bronze", 1200, "entry", ("Silver", 800, 60)),
        ("Gold", 25000, "entry", ("Platinum", 0, 100)),
    ],
)
def test_tier_progress(spark, tier, points, mode, expected):
    customers = fx.customers(
        spark, [{"customer_id": "C1", "loyalty_tier": tier, "loyalty_points": points, "lifetime_value": 4820.5}]
    )
    row = loyalty.tier_progress(customers, mode).first()
    assert (row["next_tier"], row["points_to_next"], row["progress_pct"]) == expected
    assert row["points_value"] == Decimal(points) / 100
    if points == 12450:
        assert (row["points_text"], row["points_value_text"]) == ("12,450", "Worth $124.50")
        assert row["ltv_text"] == "$4,820"


def _tagged(spark):
    return spark.createDataFrame(
        [
            ("CUST-0042", "Sophia", "Martinez", "Gold", 12450, "VIP Active", 5, '["Denim","Shoes","Accessories"]'),
            ("CUST-0331", "Mateo", "Garcia", "Gold", 9800, "Win-Back", 38, '["Denim","Outerwear"]'),
        ],
        "customer_id string, first_name string, last_name string, loyalty_tier string, loyalty_points int,"
        " segment string, days_since_last_purchase int, preferred_categories string",
    ).selectExpr("*", "'Austin' AS city", "'TX' AS state", "cast(1.0 AS double) AS lifetime_value", "'Low' AS churn_risk")


def test_offer_basket(spark):
    intent = _intent(spark, [("CUST-0042", "Denim", "10", 1), ("CUST-0042", "Shoes", "40", 2)])
    basket = offers.offers(_tagged(spark), intent, fx.AS_OF)
    rows = fx.dicts(basket, "customer_id", "slot")
    assert [(r["slot"], r["offer_code"]) for r in rows] == [
        (1, "DEN-DISC-0042"),
        (2, "SHO-BONU-0042"),
        (3, "ACC-EARL-0042"),
        (0, "WINBACK-0331"),
        (1, "DEN-DISC-0331"),
        (2, "OUT-BONU-0331"),
    ]
    assert [r["relevance_score"] for r in rows] == [0.90, 0.98, 0.82, 0.99, 0.82, 0.82]
    assert rows[3]["reason"].startswith("It's been 38 days")
    assert rows[3]["expires_at"] == fx.at("2026-03-08 12:00:00")
    assert rows[0]["product_name"] == "Trending Denim Collection"

    later = offers.live_offers(basket, "2026-03-06 12:00:00")
    alive = fx.dicts(later, "customer_id", "offer_rank")
    assert [r["offer_code"] for r in alive] == ["ACC-EARL-0042", "WINBACK-0331"]
    counts = offers.live_offer_counts(basket, fx.AS_OF)
    assert {r["customer_id"]: r["active_offers_count"] for r in counts.collect()} == {"CUST-0042": 3, "CUST-0331": 3}


def test_profile_texts(spark):
    row = fx.dicts(portal.profile_context(_tagged(spark)), "customer_id")[0]
    assert row["label"] == "Sophia Martinez (CUST-0042)"
    assert row["context"].startswith(
        "You are a personal style assistant for Sophia. They are a Gold tier member who loves"
        " Denim, Shoes, Accessories. They have 12450 points and live in Austin, TX. "
    )


def test_interest_profile_adds_defaults_once(spark):
    tagged = _tagged(spark).withColumn("preferred_categories", F.lit('["Tops","Denim"]'))
    intent = _intent(spark, [("CUST-0042", "Activewear", "5", 1)])
    rows = fx.dicts(portal.interest_profile(tagged, intent).where("customer_id = 'CUST-0042'"), "profile_rank")
    assert [(r["category"], float(r["intent_score"])) for r in rows] == [("Activewear", 5.0), ("Tops", 0.0), ("Denim", 0.0)]


def _session_clicks(spark):
    kinds = [
        ("product_view", "P1", None),
        ("add_to_cart", "P1", None),
        ("add_to_cart", "P2", None),
        ("remove_from_cart", "P2", None),
        ("category_browse", None, "Tops"),
        ("search", None, None),
        ("wishlist_add", "P1", None),
        ("page_view", None, None),
    ]
    return fx.clicks(
        spark,
        [
            {
                "event_type": kind,
                "product_id": product,
                "category_browsed": category,
                "event_timestamp": f"2026-03-05 11:{30 + i}:00",
                "device_type": "mobile" if i < 7 else "desktop",
                "page_url": f"/{i}",
                "search_term": "black jeans" if kind == "search" else None,
            }
            for i, (kind, product, category) in enumerate(kinds)
        ],
    )


def _pair(spark):
    return fx.products(
        spark,
        [
            {"product_id": "P1", "product_name": "Jeans", "category": "Denim"},
            {"product_id": "P2", "product_name": "Boots", "category": "Shoes"},
        ],
    )


def test_session_state(spark):
    row = state.active_sessions(enrich_clicks(_session_clicks(spark), _pair(spark))).first()
    assert row["categories_viewed"] == ["Denim", "Shoes", "Tops"]
    assert row["products_viewed"] == ["P1", "P2"] and row["cart_items"] == ["P1"]
    assert row["session_intent"] == {"Denim": 6.0, "Shoes": 3.0, "Tops": 0.5}
    assert row["started_at"] == fx.at("2026-03-05 11:30:00")
    assert row["last_activity_at"] == fx.at("2026-03-05 11:37:00")
    assert (row["device_type"], row["current_page"]) == ("desktop", "/7")


def test_sessions_by_id_alone(spark):
    rows = [
        ("S1", "C1", "add_to_cart", "P1", "10:00"),
        ("S1", "C1", "remove_from_cart", "P1", "10:01"),
        ("S1", "C2", "product_view", "P1", "10:02"),
        ("S1", "C2", "add_to_cart", "P1", "10:03"),
        ("S2", "C1", "add_to_cart", "P2", "10:00"),
        ("S2", "C1", "remove_from_cart", "P2", "10:05"),
        (None, "C1", "add_to_cart", "P1", "11:00"),
        (None, "C2", "add_to_cart", "P1", "11:00"),
    ]
    clicks = fx.clicks(
        spark,
        [
            {"session_id": s, "customer_id": c, "event_type": k, "product_id": p, "event_timestamp": f"2026-03-05 {t}:00"}
            for s, c, k, p, t in rows
        ],
    )
    shared, other = fx.dicts(state.active_sessions(enrich_clicks(clicks, _pair(spark))), "session_id")
    assert (shared["session_id"], shared["customer_id"], shared["cart_items"]) == ("S1", "C2", ["P1"])
    assert shared["session_intent"] == {"Denim": 7.0}
    assert (other["session_id"], other["cart_items"]) == ("S2", [])


def test_keys_of_another_type_still_match(spark):
    clicks = fx.clicks(spark, [{"event_type": "product_view", "product_id": "7", "event_timestamp": "2026-03-05 10:00:00"}])
    products = fx.products(spark, [{"product_id": "7", "category": "Denim"}])
    numbered = products.withColumn("product_id", F.col("product_id").cast("bigint"))
    assert enrich_clicks(clicks, numbered).first()["resolved_category"] == "Denim"


def test_session_feed(spark):
    rows = fx.dicts(portal.session_feed(_session_clicks(spark), _pair(spark), fx.AS_OF), "position")
    assert [(r["time"], r["action"]) for r in rows] == [
        ("23 min ago", "Browsed /7 page"),
        ("24 min ago", "Added Jeans to wishlist"),
        ("25 min ago", 'Searched for "black jeans"'),
        ("26 min ago", "Viewed Tops category page"),
        ("27 min ago", "Removed Boots from cart"),
        ("28 min ago", "Added Boots to cart"),
        ("29 min ago", "Added Jeans to cart"),
    ]


def test_all_score_types_for_one_customer(spark):
    customers = fx.customers(
        spark, [{"customer_id": c, "preferred_categories": '["Denim"]', "loyalty_tier": "Gold"} for c in ("C1", "C2")]
    )
    purchases = fx.purchases(
        spark,
        [
            {"customer_id": c, "product_id": p, "purchase_date": fx.at(d), "total_amount": 1.0}
            for c, p, d in [
                ("C1", "P1", "2026-03-01 00:00:00"),
                ("C2", "P2", "2026-02-01 00:00:00"),
                ("C2", "P1", "2026-03-01 00:00:00"),
            ]
        ],
    )
    products = _pair(spark).withColumn("rating", F.lit(4.0)).withColumn("review_count", F.lit(3))
    layers = Medallion(Bronze(_session_clicks(spark), products, customers, purchases), fx.AS_OF)
    advice = Recommendations(layers, fx.AS_OF)
    scores = advice.scores()
    kinds = {r["score_type"] for r in scores.where("customer_id = 'C1'").collect()}
    assert kinds == {"content_based", "trending", "vibe_match", "collaborative"}
    keys = scores.groupBy("customer_id", "product_id", "score_type").count()
    assert keys.where("count > 1").count() == 0
    assert [r["category"] for r in advice.top_interests("C1").collect()] == ["Denim", "Shoes", "Tops"]
    basket = {r["category"]: len(r["products"]) for r in advice.style("C1").collect()}
    assert basket == {"Denim": 1, "Shoes": 1}
    assert {r["customer_id"] for r in advice.content_scores("C2").collect()} == {"C2"}
    assert advice.similar_products("jeans", k=1).first()["product_id"] == "P1"
