"""The same results as ANSI SQL over the sample tables, for checking."""

from __future__ import annotations

import re

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
CATS = "['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD']"

WEIGHT = """CASE event_type WHEN 'add_to_cart' THEN 3.0 WHEN 'wishlist_add' THEN 2.0 WHEN 'search' THEN 1.5
 WHEN 'product_view' THEN 1.0 WHEN 'category_browse' THEN 0.5 ELSE 0.0 END::DECIMAL(3,1)"""


def _boost(now: str, moment: str) -> str:
    age = f"(floor(epoch({now})) - floor(epoch({moment})))"
    return f"""CASE WHEN {age} <= 21600 THEN 2.0 WHEN {age} <= 43200 THEN 1.5
 WHEN {age} <= 86400 THEN 1.2 ELSE 1.0 END::DECIMAL(3,1)"""


def _intent(now: str, where: str) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY intent_score DESC, resolved_category)
 AS category_rank FROM (SELECT customer_id, resolved_category,
 sum({WEIGHT} * {_boost(now, 'event_timestamp')})::DECIMAL(18,2) AS intent_score, count(*) AS event_count,
 max(event_timestamp) AS latest_interaction FROM enriched
 WHERE resolved_category IS NOT NULL AND {where} GROUP BY 1, 2)"""


def _relevance(intent: str, rating: str) -> str:
    return f"least(1, round({intent}::DECIMAL(14,2) * {rating}::DECIMAL(16,8) * 0.01, 4))"


def _tfidf(texts: str, queries: str) -> str:
    """Cosine of (product_id, block, text) with one (block, text) query per block."""
    return f"""WITH tw AS (SELECT product_id, block, word, count(*) AS times FROM (SELECT product_id, block,
 unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS word FROM ({texts})) WHERE word <> '' GROUP BY 1, 2, 3),
 qw AS (SELECT block, word, count(*) AS times FROM (SELECT block,
 unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS word FROM ({queries})) WHERE word <> '' GROUP BY 1, 2),
 total AS (SELECT count(*)::DOUBLE AS n FROM products),
 idf AS (SELECT word, ln((max(n) + 1) / (count(*) + 1)) AS idf FROM tw, total GROUP BY 1),
 asked AS (SELECT q.block, q.word, q.times * coalesce(i.idf, ln(n + 1)) AS asked
 FROM qw q CROSS JOIN total LEFT JOIN idf i USING (word)),
 qn AS (SELECT block, sqrt(sum(asked * asked)) AS query_norm FROM asked GROUP BY 1),
 pt AS (SELECT t.product_id, t.block, coalesce(sum(t.times * i.idf * a.asked), 0) AS shared,
 sqrt(sum(t.times * i.idf * t.times * i.idf)) AS norm FROM tw t JOIN idf i USING (word)
 LEFT JOIN asked a ON a.block = t.block AND a.word = t.word GROUP BY 1, 2)
 SELECT product_id, round(shared / (norm * query_norm), 6) AS similarity FROM pt JOIN qn USING (block)"""


TEXT = "concat_ws(' ', product_name, category, subcategory, brand, description, style_tags, color)"

# Named steps; each may use the ones it mentions.
STEPS = {
    "clicks": f"""SELECT event_id, user_id AS customer_id, concat(user_id, '-', strftime(ts, '%Y%m%d')) AS session_id,
 ts AS event_timestamp, kind AS event_type, concat('/', kind, '/', k) AS page_url,
 CASE WHEN kind NOT IN ('page_view', 'category_browse') THEN k END AS product_id,
 CASE WHEN kind = 'category_browse' THEN {CATS}[k % 6 + 1] END AS category_browsed,
 CASE WHEN kind = 'search' THEN concat({CATS}[k % 6 + 1], ' item ', k) END AS search_term,
 CASE WHEN value < 2 THEN 'mobile' WHEN value < 20 THEN 'desktop' ELSE 'tablet' END AS device_type,
 floor(value)::INT AS time_on_page_seconds
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
 CASE WHEN event_type = 'purchase' THEN 'add_to_cart' WHEN event_type = 'signup' THEN 'wishlist_add'
 WHEN event_type = 'view' THEN 'product_view' WHEN event_type = 'click' AND value >= 10 THEN 'category_browse'
 WHEN event_type = 'click' THEN 'search' WHEN value >= 10 THEN 'remove_from_cart' ELSE 'page_view' END AS kind
 FROM events)""",
    "products": f"""SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category,
 split_part(p_name, ' ', 2) AS subcategory, p_brand AS brand, p_retailprice AS price,
 concat('A ', p_name, ' in ', p_type, ' style by ', p_brand) AS description,
 concat('["', split_part(p_name, ' ', 1), '","', CASE WHEN p_size < 25 THEN 'compact' ELSE 'roomy' END, '"]') AS style_tags,
 split_part(p_name, ' ', 1) AS color, concat('["', p_size, '"]') AS sizes_available,
 (3 + (p_size % 41) * 0.05)::DECIMAL(3,2) AS rating, p_size AS review_count,
 {AS_OF} - to_days(p_size) AS created_at, p_size <= 5 AS is_new_arrival FROM part""",
    "customers": f"""SELECT c_custkey AS customer_id, split_part(c_name, '#', 1) AS first_name,
 split_part(c_name, '#', 2) AS last_name, concat(split_part(c_name, '#', 2), '@example.com') AS email,
 CASE c_mktsegment WHEN 'MACHINERY' THEN 'Silver' WHEN 'HOUSEHOLD' THEN 'Gold' WHEN 'FURNITURE' THEN 'Platinum'
 ELSE 'Bronze' END AS loyalty_tier, floor(greatest(c_acctbal, 0) * 5)::INT AS loyalty_points,
 [{CATS}[c_nationkey % 6 + 1], {CATS}[(c_nationkey + 2) % 6 + 1], {CATS}[(c_nationkey + 3) % 6 + 1]] AS liked,
 n_name AS city, r_name AS state, c_acctbal AS lifetime_value,
 floor(greatest(c_acctbal, 0) / 100)::INT AS total_orders
 FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
    "purchases": """SELECT o_custkey AS customer_id, l_partkey AS product_id,
 o_orderdate + INTERVAL 8217 DAY AS purchase_date, l_quantity::INT AS quantity,
 l_extendedprice::DECIMAL(16,2) AS total_amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "points_events": """SELECT o_custkey AS customer_id, concat('order ', o_orderkey) AS reference_id,
 o_orderdate + INTERVAL 8217 DAY AS created_at, o_orderkey * 2 AS id, 'earn' AS event_type,
 floor(o_totalprice / 100)::BIGINT AS points FROM orders
 UNION ALL SELECT o_custkey, concat('order ', o_orderkey), o_orderdate + INTERVAL 8217 DAY, o_orderkey * 2 + 1,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'redeem' WHEN '2-HIGH' THEN 'bonus' ELSE 'expire' END,
 CASE o_orderpriority WHEN '1-URGENT' THEN -floor(o_totalprice / 400)::BIGINT WHEN '2-HIGH' THEN 500 ELSE -50 END
 FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')""",
    "enriched": """SELECT c.*, p.product_name, p.category AS product_category, p.subcategory AS product_subcategory,
 p.brand AS product_brand, p.price AS product_price, p.style_tags AS product_style_tags,
 coalesce(p.category, c.category_browsed) AS resolved_category
 FROM clicks c LEFT JOIN products p USING (product_id) WHERE customer_id IS NOT NULL AND event_timestamp IS NOT NULL""",
    "rollup_": """SELECT customer_id, count(*) AS total_transactions, sum(total_amount) AS total_spend,
 sum(total_amount)::DOUBLE / count(total_amount) AS avg_order_value, max(purchase_date) AS most_recent_purchase,
 count(DISTINCT product_id) AS unique_products_purchased FROM purchases GROUP BY 1""",
    "golden": f"""SELECT *, CASE WHEN days_since_last_purchase > 60 THEN 'High' WHEN days_since_last_purchase > 30
 THEN 'Medium' ELSE 'Low' END AS churn_risk FROM (SELECT c.*, r.* EXCLUDE (customer_id),
 date_diff('day', r.most_recent_purchase::DATE, {AS_OF}::DATE) AS days_since_last_purchase
 FROM customers c LEFT JOIN rollup_ r USING (customer_id))""",
    "intent": _intent(AS_OF, f"event_timestamp >= {AS_OF} - INTERVAL 2 DAY"),
    "engaged": """SELECT customer_id, sum(intent_score) AS total_intent_score, max(intent_score) AS top_category_score
 FROM intent GROUP BY 1""",
    "segments": """SELECT customer_id, first_name, last_name, loyalty_tier, loyalty_points, lifetime_value, total_orders,
 days_since_last_purchase, churn_risk, total_intent_score,
 CASE WHEN days_since_last_purchase > 30 AND lifetime_value > 3000 THEN 'Win-Back'
 WHEN loyalty_tier IN ('Platinum', 'Gold') AND days_since_last_purchase <= 14 THEN 'VIP Active'
 WHEN loyalty_tier = 'Silver' AND total_intent_score > 15 THEN 'Rising Star'
 WHEN churn_risk = 'High' THEN 'At Risk'
 WHEN days_since_last_purchase IS NULL OR total_orders <= 3 THEN 'New & Engaged' ELSE 'Steady' END AS segment,
 liked, city, state FROM golden LEFT JOIN engaged USING (customer_id)""",
    "interests": """SELECT customer_id, resolved_category AS category, intent_score, event_count, latest_interaction,
 category_rank AS interest_rank FROM intent WHERE category_rank <= 3
 UNION ALL SELECT customer_id, liked[pos], 0, 0, NULL, pos
 FROM golden CROSS JOIN (SELECT unnest([1, 2, 3]) AS pos)
 WHERE customer_id NOT IN (SELECT customer_id FROM intent)""",
    "shelf": """SELECT * FROM (SELECT product_id, product_name, category, price, rating, review_count, is_new_arrival,
 row_number() OVER (PARTITION BY category ORDER BY rating DESC, review_count DESC, product_id) AS product_rank
 FROM products) WHERE product_rank <= 10""",
    "content": f"""SELECT customer_id, product_id, product_name, category, price, rating, is_new_arrival,
 {_relevance('intent_score', 'rating')} AS score, 'content_based' AS score_type,
 concat('High intent (', round(intent_score, 1)::DECIMAL(18,1), ') in ', category, ' + product rating ', rating::DOUBLE)
 AS reasoning FROM interests JOIN shelf USING (category)""",
    "heat": """SELECT resolved_category AS category, sum(intent_score) AS total_interest,
 count(DISTINCT customer_id) AS unique_shoppers FROM intent GROUP BY 1""",
    "trendy": f"""SELECT customer_id, product_id, product_name, category, price, rating, is_new_arrival,
 {_relevance('warmth', 'rating')} AS score, 'trending' AS score_type, concat('Trending in ', category) AS reasoning
 FROM interests JOIN (SELECT category, round((total_interest::DOUBLE /
 (SELECT max(total_interest) FROM heat)::DOUBLE)::DECIMAL(18,8) * 20, 2)::DECIMAL(18,2) AS warmth FROM heat)
 USING (category) JOIN shelf USING (category)""",
    "baskets": """SELECT customer_id, product_id, max(purchase_date) AS last_bought FROM purchases GROUP BY 1, 2""",
    "anchors": """SELECT customer_id, product_id AS anchor_id FROM (SELECT *, row_number() OVER (PARTITION BY customer_id
 ORDER BY last_bought DESC, product_id DESC) AS rn FROM baskets) WHERE rn = 1""",
    "companions": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY co_buyers DESC, product_id)
 AS companion_rank FROM (SELECT anchor_id, product_id, count(*) AS co_buyers FROM baskets JOIN anchors USING (customer_id)
 WHERE product_id <> anchor_id GROUP BY 1, 2)) JOIN (SELECT anchor_id, count(*) AS anchor_buyers FROM anchors GROUP BY 1)
 USING (anchor_id)""",
    "direct": """SELECT * FROM (SELECT customer_id, c.product_id, co_buyers, anchor_buyers, row_number() OVER (PARTITION BY
 customer_id ORDER BY companion_rank) AS place FROM anchors JOIN companions c USING (anchor_id)
 WHERE NOT EXISTS (SELECT 1 FROM baskets b WHERE b.customer_id = anchors.customer_id AND b.product_id = c.product_id))
 WHERE place <= 10""",
    "placed": """SELECT customer_id, category AS anchor_category FROM anchors JOIN products ON product_id = anchor_id
 WHERE category IS NOT NULL""",
    "popular": """SELECT anchor_category, product_id, count(*) AS co_buyers,
 any_value(anchor_buyers) AS anchor_buyers FROM baskets JOIN placed USING (customer_id)
 JOIN (SELECT anchor_category, count(*) AS anchor_buyers FROM placed GROUP BY 1) USING (anchor_category) GROUP BY 1, 2""",
    "named": """SELECT customer_id, count(*) AS named FROM direct GROUP BY 1""",
    "indirect": """SELECT * EXCLUDE (named) FROM (SELECT customer_id, c.product_id, co_buyers, anchor_buyers,
 row_number() OVER (PARTITION BY customer_id ORDER BY co_buyers DESC, c.product_id) AS place
 FROM placed JOIN popular c USING (anchor_category)
 WHERE NOT EXISTS (SELECT 1 FROM baskets b WHERE b.customer_id = placed.customer_id AND b.product_id = c.product_id)
 AND NOT EXISTS (SELECT 1 FROM direct d WHERE d.customer_id = placed.customer_id AND d.product_id = c.product_id))
 LEFT JOIN named USING (customer_id) WHERE place <= 10 - coalesce(named, 0)""",
    "collab": """SELECT customer_id, p.product_id, product_name, category, price, rating, is_new_arrival,
 round((co_buyers::DOUBLE / anchor_buyers)::DECIMAL(18,8), 4) AS score, 'collaborative' AS score_type,
 concat('Bought by ', co_buyers, ' of ', anchor_buyers, why) AS reasoning
 FROM (SELECT *, ' shoppers with the same last purchase' AS why FROM direct UNION ALL
 SELECT *, ' shoppers who last bought in the same category' FROM indirect) JOIN products p USING (product_id)""",
    "style_similarity": _tfidf(
        f"SELECT product_id, category AS block, {TEXT} AS text FROM products",
        "SELECT DISTINCT category AS block, concat(category, ' style trending fashion') AS text FROM products",
    ),
    "hits": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY similarity DESC, product_id)
 AS hit_rank FROM (SELECT p.*, similarity, max(is_new_arrival::INT) OVER (PARTITION BY category) AS any_new
 FROM products p JOIN style_similarity USING (product_id)) WHERE is_new_arrival OR any_new = 0) WHERE hit_rank <= 5""",
    "vibes": """SELECT customer_id, product_id, product_name, category, price, rating, is_new_arrival,
 similarity::DECIMAL(18,4) AS score, 'vibe_match' AS score_type, concat('Matches the style of ', category) AS reasoning
 FROM interests JOIN hits USING (category)""",
    "winback": f"""SELECT customer_id, 0 AS slot, concat('WINBACK-', right(customer_id::VARCHAR, 4)) AS offer_code,
 'We Miss You!' AS product_name, 'All Categories' AS category, 0.99::DOUBLE AS relevance_score,
 'discount' AS offer_type, '25% Off Everything' AS offer_value,
 concat('It''s been ', days_since_last_purchase, ' days — welcome back with this exclusive offer') AS reason,
 {AS_OF} + INTERVAL 72 HOUR AS expires_at FROM segments WHERE segment = 'Win-Back'""",
    "offers": f"""SELECT * FROM winback UNION ALL SELECT s.customer_id, pos AS slot,
 concat(upper(left(liked[pos], 3)), '-', ['DISC', 'BONU', 'EARL'][pos], '-', right(s.customer_id::VARCHAR, 4)),
 concat('Trending ', liked[pos], ' Collection'), liked[pos],
 round(0.82 + least(coalesce(intent_score, 0), 20) * 0.008, 2)::DOUBLE,
 ['discount', 'bonus_points', 'early_access'][pos], ['20% Off', '500 Bonus Points', 'Early Access'][pos],
 concat('Based on your recent browsing in ', liked[pos], ' and purchase history'),
 {AS_OF} + to_hours([24, 12, 48][pos]) FROM segments s CROSS JOIN (SELECT unnest([1, 2, 3]) AS pos)
 LEFT JOIN (SELECT customer_id, resolved_category, intent_score FROM intent) i
 ON i.customer_id = s.customer_id AND i.resolved_category = liked[pos]""",
    "state": f"""SELECT customer_id, first_name, last_name, loyalty_tier, loyalty_points, lifetime_value, segment, churn_risk,
 top_category, coalesce(n, 0) AS active_offers_count, last_session_at, {AS_OF} AS updated_at FROM segments
 LEFT JOIN (SELECT customer_id, resolved_category AS top_category FROM intent WHERE category_rank = 1) USING (customer_id)
 LEFT JOIN (SELECT customer_id, count(*) AS n FROM offers WHERE expires_at > {AS_OF} GROUP BY 1) USING (customer_id)
 LEFT JOIN (SELECT customer_id, max(event_timestamp) AS last_session_at FROM clicks GROUP BY 1) USING (customer_id)""",
    "event_scores": f"""SELECT customer_id, product_id, {WEIGHT}::DOUBLE AS score, 'content_based' AS score_type,
 event_type AS reasoning, event_timestamp AS computed_at, event_id FROM clicks WHERE product_id IS NOT NULL""",
    "categorised": "SELECT * FROM enriched WHERE resolved_category IS NOT NULL",
    "buckets": f"""SELECT date_trunc('hour', event_timestamp) AS bucket_start,
 date_trunc('hour', event_timestamp) + INTERVAL 1 HOUR AS bucket_end, customer_id, resolved_category,
 sum({WEIGHT}) AS weight, count(*) AS event_count, max(event_timestamp) AS latest_interaction FROM categorised
 GROUP BY 1, 2, 3, 4""",
}

SCORE_OUT = "customer_id, product_id, product_name, category, price, rating::DOUBLE AS rating, is_new_arrival, score::DOUBLE AS score, score_type, reasoning"
LIKED = "concat('[\"', array_to_string(liked, '\",\"'), '\"]') AS preferred_categories"
INTENT_OUT = "customer_id, resolved_category, intent_score::DOUBLE AS intent_score, event_count, latest_interaction, category_rank"
SEGMENT_OUT = f"""* EXCLUDE (liked, total_intent_score), total_intent_score::DOUBLE AS total_intent_score, {LIKED}"""
LATEST = """SELECT customer_id, product_id, score, score_type, reasoning, computed_at FROM (SELECT *, row_number() OVER
 (PARTITION BY customer_id, product_id ORDER BY computed_at DESC, score DESC, reasoning DESC) AS rn FROM event_scores)
 WHERE rn = 1"""

HELD = """max(event_timestamp) FILTER (event_type = 'add_to_cart') >= coalesce(max(event_timestamp)
 FILTER (event_type = 'remove_from_cart'), max(event_timestamp) FILTER (event_type = 'add_to_cart'))"""

RESULTS = {
    "enriched_clicks": """SELECT event_id, customer_id, session_id, event_timestamp, event_type, product_id, product_name,
 product_subcategory, product_brand, product_price, product_style_tags, category_browsed, resolved_category FROM enriched""",
    "rule_violations": """SELECT (SELECT count(*) FROM clicks) AS rows, rule, violations FROM
 (SELECT 'valid_customer' AS rule, count(*) FILTER (customer_id IS NULL) AS violations FROM clicks
 UNION ALL SELECT 'valid_timestamp', count(*) FILTER (event_timestamp IS NULL) FROM clicks
 UNION ALL SELECT 'has_product', count(*) FILTER (product_id IS NULL) FROM clicks
 UNION ALL SELECT 'long_visit', count(*) FILTER (time_on_page_seconds < 5) FROM clicks)""",
    "masked_customers": f"SELECT * EXCLUDE (liked, email), {LIKED} FROM customers",
    "golden_record": f"""SELECT * EXCLUDE (liked, total_spend), total_spend::DOUBLE AS total_spend, {LIKED} FROM golden""",
    "churn_bands": """SELECT churn_risk, count(*) AS customers, sum(total_spend)::DOUBLE AS total_spend,
 max(days_since_last_purchase) AS longest_gap_days FROM golden GROUP BY 1""",
    "scored_events": f"""SELECT event_id, resolved_category, {WEIGHT}::DOUBLE AS intent_weight,
 {_boost(AS_OF, 'event_timestamp')}::DOUBLE AS recency_multiplier,
 ({WEIGHT} * {_boost(AS_OF, 'event_timestamp')})::DOUBLE AS weighted_score
 FROM enriched WHERE event_timestamp >= {AS_OF} - INTERVAL 2 DAY""",
    "category_intent": f"SELECT {INTENT_OUT} FROM intent",
    "category_intent_rolling": f"SELECT {INTENT_OUT} FROM ("
    + _intent(
        "TIMESTAMP '2024-01-30 12:00:00'",
        "event_timestamp BETWEEN TIMESTAMP '2024-01-28 12:00:00' AND TIMESTAMP '2024-01-30 12:00:00'",
    )
    + ")",
    "engagement": """SELECT customer_id, total_intent_score::DOUBLE AS total_intent_score,
 top_category_score::DOUBLE AS top_category_score FROM engaged""",
    "segments": f"SELECT {SEGMENT_OUT} FROM segments",
    "published_segments": f"SELECT {SEGMENT_OUT} FROM segments",
    "observed_rules": """SELECT (SELECT count(*) FROM clicks) AS rows, rule, violations FROM
 (SELECT 'valid_customer' AS rule, count(*) FILTER (customer_id IS NULL) AS violations FROM clicks
 UNION ALL SELECT 'valid_timestamp', count(*) FILTER (event_timestamp IS NULL) FROM clicks)""",
    "segment_counts": "SELECT segment, count(*) AS customers FROM segments GROUP BY 1",
    "recent_interest": f"SELECT {INTENT_OUT} FROM intent WHERE category_rank = 1",
    "high_ltv": "SELECT customer_id, lifetime_value, segment FROM segments WHERE lifetime_value > 5000",
    "top_fraction": """SELECT * FROM (SELECT row_number() OVER (ORDER BY lifetime_value DESC, customer_id) AS ltv_rank,
 customer_id, lifetime_value, segment FROM segments)
 WHERE ltv_rank <= (SELECT floor(count(*) * 0.10) FROM segments)""",
    "vip": """SELECT customer_id, loyalty_tier, lifetime_value FROM segments
 WHERE loyalty_tier IN ('Platinum', 'Gold') ORDER BY lifetime_value DESC, customer_id""",
    "at_risk": """SELECT customer_id, churn_risk, segment, days_since_last_purchase FROM segments
 WHERE churn_risk = 'High'""",
    "lapsed_browsers": """SELECT * FROM (SELECT customer_id, first_name, last_name, lifetime_value,
 days_since_last_purchase, intent_score::DOUBLE AS category_interest,
 row_number() OVER (ORDER BY lifetime_value DESC, customer_id) AS ltv_rank
 FROM segments JOIN intent USING (customer_id)
 WHERE days_since_last_purchase > 30 AND resolved_category = 'PROMO' AND intent_score > 0)
 WHERE ltv_rank <= (SELECT floor(count(*) * 0.10) FROM segments)""",
    "add_to_cart_rate": """SELECT *, CASE WHEN product_views > 0 THEN add_to_carts::DOUBLE / product_views END
 AS add_to_cart_rate FROM (SELECT resolved_category, count(*) FILTER (event_type = 'add_to_cart') AS add_to_carts,
 count(*) FILTER (event_type = 'product_view') AS product_views FROM enriched GROUP BY 1)""",
    "trending": """SELECT category AS resolved_category, total_interest::DOUBLE AS total_interest, unique_shoppers FROM heat
 ORDER BY total_interest DESC, resolved_category""",
    "best_sellers": """SELECT product_name, category, brand, sum(quantity)::BIGINT AS units_sold,
 sum(total_amount)::DOUBLE AS revenue, count(*)::BIGINT AS purchases
 FROM purchases JOIN products USING (product_id) GROUP BY 1, 2, 3""",
    "session_summary": """SELECT session_id, customer_id, count(*) AS events, min(event_timestamp) AS started_at,
 max(event_timestamp) AS ended_at,
 (floor(epoch(max(event_timestamp))) - floor(epoch(min(event_timestamp))))::BIGINT AS span_seconds,
 count(DISTINCT resolved_category) AS categories, sum(time_on_page_seconds)::BIGINT AS dwell_seconds
 FROM enriched GROUP BY 1, 2""",
    "top_interests": """SELECT customer_id, category, intent_score::DOUBLE AS intent_score, event_count,
 latest_interaction, interest_rank FROM interests""",
    "ranked_products": "SELECT * EXCLUDE (rating), rating::DOUBLE AS rating FROM shelf",
    "content_scores": f"SELECT {SCORE_OUT} FROM content",
    "one_customer": """SELECT customer_id, product_id, category, score::DOUBLE AS score, reasoning FROM content
 WHERE customer_id = (SELECT min(customer_id) FROM customers) ORDER BY customer_id, score DESC, product_id""",
    "recommendation_shelf": """SELECT customer_id, slot, product_id, score::DOUBLE AS score,
 concat('$', format('{:,.2f}', price)) AS price_text, concat(round(score * 100, 0)::INT, '% match') AS match_text
 FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, rating DESC, product_id) AS slot
 FROM content) WHERE slot <= 9""",
    "trending_scores": f"SELECT {SCORE_OUT} FROM trendy",
    "last_purchase_companions": """SELECT anchor_id, product_id, co_buyers, companion_rank, anchor_buyers
 FROM companions WHERE companion_rank <= 10""",
    "collaborative_scores": f"SELECT {SCORE_OUT} FROM collab",
    "similar_text": "SELECT product_id, product_name, category, similarity FROM products JOIN ("
    + _tfidf(
        f"SELECT product_id, 'all' AS block, {TEXT} AS text FROM products",
        "SELECT 'all' AS block, 'roomy blue widget in promo style' AS text",
    )
    + ") USING (product_id) ORDER BY similarity DESC, product_id LIMIT 20",
    "similar_text_filtered": "SELECT product_id, product_name, category, similarity FROM products JOIN ("
    + _tfidf(
        f"SELECT product_id, 'all' AS block, {TEXT} AS text FROM products",
        "SELECT 'all' AS block, 'small red bolt' AS text",
    )
    + """) USING (product_id) WHERE is_new_arrival AND category = 'PROMO'
 ORDER BY similarity DESC, product_id LIMIT 20""",
    "style_hits": "SELECT category, hit_rank, product_id, similarity FROM hits",
    "style_recommendations": """SELECT customer_id, interest_rank, category,
 string_agg(product_id::VARCHAR, ',' ORDER BY hit_rank) AS product_ids
 FROM interests JOIN hits USING (category) GROUP BY 1, 2, 3""",
    "vibe_scores": f"SELECT {SCORE_OUT} FROM vibes",
    "similar_vectors": """SELECT label, hit_rank, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label
 ORDER BY list_cosine_similarity(embedding::DOUBLE[], query) DESC, vec_id) AS hit_rank FROM embeddings JOIN
 (SELECT label, list(mean ORDER BY pos) AS query FROM (SELECT label, pos, avg(x::DOUBLE) AS mean FROM
 (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2)
 GROUP BY 1) USING (label)) WHERE hit_rank <= 5""",
    "search_hits": f"""WITH tw AS (SELECT product_id, word, count(*) AS times FROM (SELECT product_id,
 unnest(regexp_split_to_array(lower({TEXT}), '[^a-z0-9]+')) AS word FROM products) WHERE word <> '' GROUP BY 1, 2),
 qw AS (SELECT query_id, word, count(*) AS times FROM (SELECT DISTINCT search_term AS query_id,
 unnest(regexp_split_to_array(lower(search_term), '[^a-z0-9]+')) AS word FROM clicks WHERE search_term IS NOT NULL)
 WHERE word <> '' GROUP BY 1, 2),
 total AS (SELECT count(*)::DOUBLE AS n FROM products),
 idf AS (SELECT word, ln((max(n) + 1) / (count(*) + 1)) AS idf FROM tw, total GROUP BY 1),
 asked AS (SELECT query_id, word, q.times * coalesce(idf, ln(n + 1)) AS asked FROM qw q CROSS JOIN total LEFT JOIN idf USING (word)),
 qn AS (SELECT query_id, sqrt(sum(asked * asked)) AS query_norm FROM asked GROUP BY 1),
 pn AS (SELECT product_id, sqrt(sum(times * idf * times * idf)) AS norm FROM tw JOIN idf USING (word) GROUP BY 1),
 hit AS (SELECT query_id, product_id, sum(times * idf * asked) AS shared FROM tw JOIN idf USING (word)
 JOIN asked USING (word) GROUP BY 1, 2 HAVING shared > 0),
 ranked AS (SELECT query_id, product_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC,
 product_id) AS hit_rank FROM (SELECT query_id, product_id, round(shared / (norm * query_norm), 6) AS similarity
 FROM hit JOIN qn USING (query_id) JOIN pn USING (product_id)))
 SELECT query_id, hit_rank, similarity, product_id, product_name, category, subcategory, brand, price, style_tags, color,
 rating::DOUBLE AS rating, description FROM ranked JOIN products USING (product_id) WHERE hit_rank <= 5""",
    "vector_hits": """SELECT vec_id, label, product_id, product_name, category, subcategory, brand, price, style_tags,
 color, rating::DOUBLE AS rating, description FROM (SELECT vec_id, label FROM embeddings
 ORDER BY list_cosine_similarity(embedding::DOUBLE[], list_transform(range(64), lambda i: CASE WHEN i % 3 = 0 THEN -0.5
 ELSE 1.0 END)::DOUBLE[]) DESC, vec_id LIMIT 20) JOIN products ON product_id = vec_id""",
    "recommendation_scores": " UNION ALL ".join(
        f"SELECT customer_id, product_id, score::DOUBLE AS score, score_type, {AS_OF} AS computed_at FROM {part}"
        for part in ("content", "trendy", "vibes", "collab")
    ),
    "tier_progress": """SELECT customer_id, loyalty_tier, loyalty_points, lifetime_value, next_tier, next_threshold,
 greatest(0, next_threshold - loyalty_points) AS points_to_next,
 CASE WHEN loyalty_tier = 'Platinum' THEN 100
 ELSE least(100, floor(loyalty_points * 100 / next_threshold))::INT END AS progress_pct,
 (loyalty_points * 0.01)::DOUBLE AS points_value, format('{:,}', loyalty_points) AS points_text,
 concat('Worth $', format('{:,.2f}', loyalty_points * 0.01::DOUBLE)) AS points_value_text,
 concat('$', format('{:,.0f}', lifetime_value)) AS ltv_text FROM (SELECT *,
 CASE loyalty_tier WHEN 'Bronze' THEN 'Silver' WHEN 'Silver' THEN 'Gold' ELSE 'Platinum' END AS next_tier,
 CASE loyalty_tier WHEN 'Bronze' THEN 8000 WHEN 'Silver' THEN 20000 ELSE 50000 END AS next_threshold FROM customers)""",
    "ledger_balance": """SELECT *, sum(points) OVER (PARTITION BY customer_id ORDER BY created_at, id
 ROWS UNBOUNDED PRECEDING)::BIGINT AS balance_after FROM points_events""",
    "current_balance": "SELECT customer_id, sum(points)::BIGINT AS balance FROM points_events GROUP BY 1",
    "offers": "SELECT * FROM offers",
    "offers_with_products": """SELECT customer_id, slot, category, product_id::VARCHAR AS product_id FROM offers
 LEFT JOIN (SELECT category, product_id FROM shelf WHERE product_rank = 1) USING (category)""",
    "winback_offers": "SELECT * FROM winback",
    "live_offers": """SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY relevance_score DESC, slot, offer_code)
 AS offer_rank FROM offers WHERE expires_at > TIMESTAMP '2024-02-01 06:00:00'""",
    "interest_profile": """SELECT customer_id, category, intent_score::DOUBLE AS intent_score, event_count,
 row_number() OVER (PARTITION BY customer_id ORDER BY intent_score DESC, pos) AS profile_rank FROM
 (SELECT s.customer_id, s.category, pos, coalesce(intent_score, 0) AS intent_score, coalesce(event_count, 0) AS event_count
 FROM (SELECT customer_id, category, min(pos) AS pos FROM (SELECT customer_id,
 unnest(list_concat(liked, ['PROMO', 'SMALL'])) AS category, unnest([0, 1, 2, 3, 4]) AS pos FROM segments) GROUP BY 1, 2) s
 LEFT JOIN intent i ON i.customer_id = s.customer_id AND i.resolved_category = s.category)""",
    "session_feed": f"""SELECT customer_id, position, event_id, event_type, concat(floor((floor(epoch({AS_OF})) -
 floor(epoch(event_timestamp))) / 60)::BIGINT, ' min ago') AS time, CASE event_type
 WHEN 'category_browse' THEN concat('Viewed ', coalesce(resolved_category, 'a'), ' category page')
 WHEN 'product_view' THEN concat('Viewed ', coalesce(product_name, 'a product'))
 WHEN 'search' THEN concat('Searched for "', search_term, '"')
 WHEN 'wishlist_add' THEN concat('Added ', coalesce(product_name, 'a product'), ' to wishlist')
 WHEN 'add_to_cart' THEN concat('Added ', coalesce(product_name, 'a product'), ' to cart')
 WHEN 'remove_from_cart' THEN concat('Removed ', coalesce(product_name, 'a product'), ' from cart')
 ELSE concat('Browsed ', page_url, ' page') END AS action FROM (SELECT *, row_number() OVER (PARTITION BY customer_id
 ORDER BY event_timestamp DESC, event_id DESC) AS position FROM enriched) WHERE position <= 7""",
    "profile_context": """SELECT customer_id, concat(first_name, ' ', last_name, ' (', customer_id, ')') AS label,
 concat('You are a personal style assistant for ', first_name, '. They are a ', loyalty_tier, ' tier member who loves ',
 array_to_string(liked, ', '), '. They have ', loyalty_points, ' points and live in ', city, ', ', state,
 '. Provide personalized, enthusiastic fashion advice. Keep responses concise (2-3 paragraphs max).') AS context
 FROM segments""",
    "active_sessions": f"""SELECT session_id, customer_id, started_at, last_activity_at, device_type, current_page,
 coalesce(categories_viewed, '') AS categories_viewed, coalesce(products_viewed, '') AS products_viewed,
 coalesce(cart_items, '') AS cart_items, coalesce(session_intent, '') AS session_intent FROM
 (SELECT session_id, min(event_timestamp) AS started_at, max(event_timestamp) AS last_activity_at,
 string_agg(DISTINCT resolved_category, ',' ORDER BY resolved_category) AS categories_viewed FROM enriched
 WHERE session_id IS NOT NULL GROUP BY 1)
 JOIN (SELECT session_id, customer_id, device_type, page_url AS current_page FROM enriched
 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY event_timestamp DESC, event_id DESC) = 1) USING (session_id)
 LEFT JOIN (SELECT session_id, string_agg(product_id::VARCHAR, ',' ORDER BY product_id) AS products_viewed,
 string_agg(product_id::VARCHAR, ',' ORDER BY product_id) FILTER (held) AS cart_items FROM
 (SELECT session_id, product_id, {HELD} AS held FROM enriched WHERE product_id IS NOT NULL GROUP BY 1, 2)
 GROUP BY 1) USING (session_id)
 LEFT JOIN (SELECT session_id, string_agg(concat(resolved_category, '=', score::DECIMAL(18,2)), ','
 ORDER BY resolved_category) AS session_intent FROM (SELECT session_id, resolved_category, sum({WEIGHT}) AS score
 FROM categorised GROUP BY 1, 2) GROUP BY 1) USING (session_id)""",
    "customer_state": "SELECT * FROM state",
    "customer_snapshot": "SELECT customer_id, segment, top_category, updated_at FROM state",
    "score_upsert": LATEST,
    "products_csv": """SELECT * EXCLUDE (product_id, rating), product_id::VARCHAR AS product_id,
 rating::DOUBLE AS rating FROM products""",
    "segments_from_csv": f"""SELECT * EXCLUDE (customer_id), customer_id::VARCHAR AS customer_id
 FROM (SELECT {SEGMENT_OUT} FROM segments)""",
    "stream_enriched": """SELECT event_id, customer_id, event_timestamp, event_type, product_id, resolved_category
 FROM enriched""",
    "stream_dedupe": "SELECT event_id, customer_id, event_type FROM clicks",
    "stream_intent_buckets": "SELECT * EXCLUDE (weight), weight::DOUBLE AS weight FROM buckets",
    "stream_intent_sliding": f"""SELECT bucket_start, bucket_start + INTERVAL 6 HOUR AS bucket_end, customer_id,
 resolved_category, sum({WEIGHT})::DOUBLE AS weight, count(*) AS event_count FROM
 (SELECT *, time_bucket(INTERVAL 2 HOUR, event_timestamp) - to_hours(2 * step) AS bucket_start
 FROM categorised CROSS JOIN (SELECT unnest([0, 1, 2]) AS step)) GROUP BY 1, 2, 3, 4""",
    "stream_intent": f"SELECT {INTENT_OUT} FROM intent",
    "stream_intent_half_past": f"SELECT {INTENT_OUT} FROM ("
    + _intent("TIMESTAMP '2024-01-30 12:30:00'", "event_timestamp >= TIMESTAMP '2024-01-28 00:00:00'")
    + ")",
    "stream_sessions": f"""WITH numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY customer_id ORDER BY event_timestamp,
 event_id ROWS UNBOUNDED PRECEDING) AS nr FROM (SELECT *, CASE WHEN event_timestamp < lag(event_timestamp) OVER
 (PARTITION BY customer_id ORDER BY event_timestamp, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM enriched)),
 carts AS (SELECT customer_id, nr, string_agg(product_id::VARCHAR, ',' ORDER BY product_id) AS products,
 string_agg(product_id::VARCHAR, ',' ORDER BY product_id) FILTER (held) AS cart FROM
 (SELECT customer_id, nr, product_id, {HELD} AS held FROM numbered WHERE product_id IS NOT NULL GROUP BY 1, 2, 3)
 GROUP BY 1, 2)
 SELECT customer_id, min(event_timestamp) AS started_at, max(event_timestamp) AS last_activity_at, count(*) AS events,
 sum({WEIGHT})::DOUBLE AS score,
 coalesce(string_agg(DISTINCT resolved_category, ',' ORDER BY resolved_category), '') AS categories_viewed,
 coalesce(any_value(products), '') AS products_viewed, coalesce(any_value(cart), '') AS cart_items
 FROM numbered LEFT JOIN carts USING (customer_id, nr) GROUP BY customer_id, nr""",
    "stream_ledger": """SELECT event_id AS id, customer_id, event_type, points, event_timestamp AS created_at,
 sum(points) OVER (PARTITION BY customer_id ORDER BY event_timestamp, event_id ROWS UNBOUNDED PRECEDING)::BIGINT
 AS balance_after FROM (SELECT *, CASE event_type WHEN 'add_to_cart' THEN 30 WHEN 'remove_from_cart' THEN -10 ELSE 1 END
 ::BIGINT AS points FROM clicks)""",
    "stream_score_upsert": LATEST,
}


def _needed(sql: str) -> list[str]:
    """The steps a text uses, each after those it uses itself."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in STEPS:
            if name not in found and re.search(rf"(?:FROM|JOIN)\s+{name}\b", text):
                visit(STEPS[name])
                if name not in found:
                    found.append(name)

    visit(sql)
    return found


def oracle(name: str) -> str:
    result = RESULTS[name]
    steps = ", ".join(f"{step} AS ({STEPS[step]})" for step in _needed(result))
    return f"WITH {steps} SELECT * FROM ({result})" if steps else result

# Searches from the stored index give what the unindexed ones give.
RESULTS["indexed_text"] = RESULTS["similar_text"]
RESULTS["indexed_text_filtered"] = RESULTS["similar_text_filtered"]
RESULTS["indexed_hits"] = RESULTS["search_hits"]
RESULTS["one_customer_style"] = f"""SELECT * FROM ({RESULTS["style_recommendations"]})
 WHERE customer_id = (SELECT min(customer_id) FROM customers)"""
RESULTS["refreshed_segments"] = RESULTS["published_segments"]
RESULTS["co_purchase_pairs"] = """SELECT product_id, other_id, co_buyers,
 round(co_buyers / sqrt(a.n * b.n), 6) AS cosine FROM (SELECT x.product_id, y.product_id AS other_id, count(*) AS co_buyers
 FROM baskets x JOIN baskets y ON x.customer_id = y.customer_id AND x.product_id < y.product_id GROUP BY 1, 2)
 JOIN (SELECT product_id, count(*) AS n FROM baskets GROUP BY 1) a USING (product_id)
 JOIN (SELECT product_id AS other_id, count(*) AS n FROM baskets GROUP BY 1) b USING (other_id)
 WHERE 10000 * co_buyers * co_buyers >= 225 * a.n * b.n AND a.n >= 2 AND b.n >= 2"""
RESULTS["stream_live_sessions"] = RESULTS["stream_sessions"]
RESULTS["category_reach"] = " UNION ALL ".join(
    f"""SELECT '{first}' AS first_day, resolved_category, count(DISTINCT customer_id) AS customers, true AS within_5_percent
 FROM enriched WHERE resolved_category IS NOT NULL AND event_timestamp::DATE BETWEEN '{first}' AND '2024-01-30' GROUP BY 2"""
    for first in ("2024-01-01", "2024-01-24")
)
RESULTS["click_days"] = """SELECT event_timestamp::DATE AS event_day, count(*) AS raw_rows,
 nullif(count(*) FILTER (customer_id IS NOT NULL), 0) AS enriched_rows FROM clicks GROUP BY 1"""
