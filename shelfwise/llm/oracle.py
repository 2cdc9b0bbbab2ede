"""The registered queries as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from shelfwise.llm import host_rules, urls
from shelfwise.llm.divergence import LEAST_DOCUMENTS, SMOOTH, TERMS_SHOWN, UNITS
from shelfwise.llm.queries import (
    ANCHOR_STEP,
    BEST,
    LABELS,
    QUERY_STEP,
    RELABEL_STEP,
    SCORE_SHARES,
    URL_RULES,
    VECTOR_SCALE,
)

LLM_SQL: dict[str, str] = {}

LLM_SQL["op2_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS size
  FROM pages
), f AS (
  SELECT html, min(page_id) AS first_id FROM p WHERE size >= 100 GROUP BY html HAVING count(*) > 1
)
SELECT p.page_id, p.size AS payload_bytes, sha256(p.html) AS payload_digest,
  CASE WHEN f.first_id IS NOT NULL AND p.page_id IS DISTINCT FROM f.first_id
    THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id IS DISTINCT FROM f.first_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.html = f.html
"""

LLM_SQL["op3_chat"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL
  SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *,
    17 + length(role) + length(text)
      + length(regexp_replace(role || text, '[^<\[\\]', '', 'g')) AS size,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM t
), summed AS (
  SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY place) AS prefix FROM sized
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(prefix) FILTER (role = 'assistant' OR place = n)::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id
"""

LLM_SQL["op4_top_k"] = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({VECTOR_SCALE} * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % {QUERY_STEP} = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank,
    vec_id, score
  FROM s
)
SELECT * FROM r WHERE rank <= {BEST}
"""

LLM_SQL["op5_host_rules"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT row, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d
), lines AS (
  SELECT row, unnest(string_split(text, chr(10))) AS line FROM d
), dup AS (
  SELECT row, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row
), windows AS (
  SELECT row, start, words[start : start + {host_rules.WINDOW - 1}] AS words
  FROM (SELECT row, words, unnest(range(1, len(words) - {host_rules.WINDOW - 2})) AS start FROM w)
), often AS (
  SELECT row, start FROM (
    SELECT row, start, count(*) OVER (PARTITION BY row, words) AS n FROM windows
  ) WHERE n > 1
), covered AS (
  SELECT row, count(DISTINCT place) AS n_repeat_words
  FROM (SELECT row, unnest(range(start, start + {host_rules.WINDOW})) AS place FROM often) GROUP BY row
), m AS (
  SELECT d.row, doc_id, source, len(words) AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d JOIN w USING (row) LEFT JOIN dup USING (row) LEFT JOIN covered USING (row)
), b AS (
  SELECT *, n_words < {host_rules.LEAST_WORDS}
    OR 100 * n_repeat_words > {host_rules.MOST_REPEATED_PERCENT} * n_words AS base_failed FROM m
), h AS (
  SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (base_failed)::DOUBLE AS k
  FROM b WHERE source IS NOT NULL GROUP BY source
), s AS (
  SELECT sum(k) / sum(n) AS mean, sum(n) - sum(n * n) / sum(n) AS weight,
    sum(k * k / n) - sum(k) * sum(k) / sum(n)
      - (count(*) - 1) * (sum(k) / sum(n)) * (1 - sum(k) / sum(n)) AS between_hosts
  FROM h
), prior AS (
  SELECT mean, CASE WHEN between_hosts <= 0 OR weight <= 0 THEN {host_rules.NO_VARIANCE}
    ELSE greatest(mean * (1 - mean) * weight / between_hosts - 1, 1.0) END AS strength FROM s
), r AS (
  SELECT source, (k + mean * strength) / (n + strength) AS rate, n + strength + 1 AS below FROM h, prior
), v AS (
  SELECT source,
    round(rate - {host_rules.BOUND_DEVIATIONS} * sqrt(rate * (1 - rate) / below), 9)
      > {host_rules.MOST_FAILING} AS rejected FROM r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM b LEFT JOIN v USING (source)
"""


def _urls() -> str:
    rules = " ".join(
        f"WHEN (host = '{name}' OR host LIKE '%.{name}') AND starts_with(path, '/{start}') THEN '{rule}'"
        for rule in sorted(URL_RULES, key=lambda r: -len(r))
        for name, start in [rule.split("/", 1)]
    )
    decided = " ".join(f"WHEN '{rule}' THEN '{verdict}'" for rule, verdict in URL_RULES.items())
    two = ", ".join(f"'{s}'" for s in urls.SUFFIXES)
    levels = []
    for depth, level in enumerate(urls.LEVELS):
        above = urls.LEVELS[depth - 1] if depth else None
        prior = f"p_{above}.rate" if above else "whole.mean"
        source = f"JOIN p_{above} ON counted.{above} = p_{above}.name" if above else ", whole"
        keys = f"{level}, {above}" if above else level
        levels.append(f"""
c_{level} AS (
  SELECT counted.{level} AS name, n, k, {prior} AS prior
  FROM (SELECT {keys}, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k FROM hosts GROUP BY {keys} HAVING sum(n) > 0) counted {source}
), s_{level} AS (
  SELECT CASE WHEN beyond <= 0 THEN 1000.0
    ELSE round(least(greatest(pairs / beyond - 1, 1.0), 1000.0), 6) END AS strength
  FROM (
    SELECT sum(n * n * pow(k / n - prior, 2)) - sum(n * prior * (1 - prior)) AS beyond,
      sum(n * (n - 1) * prior * (1 - prior)) AS pairs FROM c_{level}
  )
), p_{level} AS (
  SELECT name, (k + strength * prior) / (n + strength) AS rate, n + strength + 1 AS below
  FROM c_{level}, s_{level}
), b_{level} AS (
  SELECT name, round(rate - {urls.BOUND_DEVIATIONS} * sqrt(rate * (1 - rate) / below), 9) > {urls.MOST_BAD} AS blocked
  FROM p_{level}
)""")
    return rf"""
WITH cut AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), ruled AS (
  SELECT *, CASE {rules} END AS rule FROM cut
), decided AS (
  SELECT *, CASE rule {decided} END AS decided FROM ruled
), counts AS (
  SELECT host, count(decided) AS n, count(*) FILTER (decided = 'block') AS k,
    string_split(host, '.') AS labels
  FROM decided GROUP BY host
), suffixed AS (
  SELECT *, CASE WHEN array_to_string(labels[-2:], '.') IN ({two}) THEN 2 ELSE 1 END AS size FROM counts
), hosts AS (
  SELECT host, n, k, array_to_string(labels[-size:], '.') AS suffix,
    array_to_string(labels[-(size + 1):], '.') AS domain FROM suffixed
), whole AS (
  SELECT (sum(k) + 1) / (sum(n) + 2) AS mean FROM hosts
), {",".join(levels)}
, verdicts AS (
  SELECT host, coalesce(b_host.blocked, b_domain.blocked, b_suffix.blocked, false) AS blocked
  FROM hosts LEFT JOIN b_host ON host = b_host.name LEFT JOIN b_domain ON domain = b_domain.name
    LEFT JOIN b_suffix ON suffix = b_suffix.name
)
SELECT page_id, host, path, rule,
  coalesce(decided, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM decided JOIN verdicts USING (host)
"""


LLM_SQL["op9_urls"] = _urls()

LLM_SQL["op11_hard_negatives"] = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % {RELABEL_STEP} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
    list_transform(embedding, lambda x: floor({VECTOR_SCALE} * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % {ANCHOR_STEP} = 0 AND a.vec_id <> c.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {BEST}
)
SELECT anchor_id, positive_id,
  (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id))::INT AS rank,
  s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT s.same AND {SCORE_SHARES[0]} * positive_score <= 100 * s.score
  AND 100 * s.score <= {SCORE_SHARES[1]} * positive_score
QUALIFY rank <= {BEST}
"""

_LETTERS = "".join(map(chr, range(65, 91)))
_GROUP = "PARTITION BY lang, source"
LLM_SQL["op12_divergence"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}') AS text
  FROM documents
), w AS (
  SELECT row, lang, source,
    unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (
  SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT row) >= {LEAST_DOCUMENTS}
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL
), s AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
    (1 + ({UNITS}::HUGEINT * (coalesce(n, 0) + {SMOOTH}))
      // (sum(coalesce(n, 0)) OVER ({_GROUP}) + {SMOOTH} * count(*) OVER ({_GROUP})))::BIGINT AS p
  FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)
), t AS (
  SELECT lang, term, sum(n) AS n FROM s GROUP BY ALL
), l AS (
  SELECT lang, term, (1 + ({UNITS}::HUGEINT * (n + {SMOOTH}))
      // (sum(n) OVER (PARTITION BY lang) + {SMOOTH} * count(*) OVER (PARTITION BY lang)))::BIGINT AS q
  FROM t
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), u AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM s JOIN l USING (lang, term) WHERE n > 0 AND p > q
), r AS (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM u
)
SELECT * FROM r WHERE part = 'pair' OR rank <= {TERMS_SHOWN}
"""
