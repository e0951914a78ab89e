"""DuckDB SQL that states what the queries of this subpackage return."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
_WORD = r"[^\x20\x09-\x0D]+"


def _low(column: str) -> str:
    return f"translate({column}, '{_UPPER}', '{_LOWER}')"


NEAR_DUPLICATES = f"""
WITH RECURSIVE
split AS (
  SELECT doc_id, regexp_extract_all({_low("coalesce(text, '')")}, '{_WORD}') AS w FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4])) END AS s
  FROM split
),
sized AS (SELECT doc_id, s, len(s) AS n FROM sets),
classes AS (SELECT min(doc_id) AS id, list_sort(s) AS s, any_value(n) AS n FROM sized WHERE n > 0 GROUP BY list_sort(s)),
members AS (SELECT doc_id, c.id FROM sized d JOIN classes c ON list_sort(d.s) = c.s WHERE d.n > 0),
shingles AS (SELECT id, n, unnest(s) AS g FROM classes),
links AS (
  SELECT a.id AS a, b.id AS b
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.id < b.id
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT id AS node, id AS goal FROM classes
  UNION
  SELECT r.node, w.b FROM reach r JOIN ways w ON r.goal = w.a
),
least_of AS (SELECT node, min(goal) AS component FROM reach GROUP BY node)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_shingles,
  CASE WHEN d.n = 0 THEN d.doc_id ELSE l.component END AS component_id,
  (CASE WHEN d.n = 0 THEN d.doc_id ELSE l.component END) = d.doc_id AS kept
FROM sized d LEFT JOIN members m ON m.doc_id = d.doc_id LEFT JOIN least_of l ON l.node = m.id
"""

_WORDS = f"regexp_extract_all(coalesce(text, ''), '{_WORD}')"

LINE_RULES = rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
),
measured AS (
  SELECT *, len(w) AS n,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    list_filter(l, lambda x: regexp_matches(x, '{_WORD}')) AS full_lines,
    CASE WHEN len(w) < 9 THEN [] ELSE list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')) END AS g,
    list_filter(l, lambda x: NOT (
      len(list_filter(regexp_split_to_array(x, '\s+'), lambda y: y IN ('|', '»', '›', '•', '·', '>'))) >= 2
      OR (regexp_matches(lower(x), 'all rights reserved|cookie policy|privacy policy|terms of service|terms of use|enable javascript|lorem ipsum|click here|read more|sign in|log in|subscribe to our|skip to content|share this|back to top')
          AND len(regexp_extract_all(x, '{_WORD}')) < 20)
      OR (len(regexp_extract_all(x, '{_WORD}')) > 0 AND NOT regexp_matches(x, '[.!?;:…。！？]["''”’»)\]]*\s*$'))
    )) AS good
  FROM base
),
places AS (
  SELECT row_key, unnest(g) AS g, unnest(range(1, len(g) + 1)) AS i
  FROM (SELECT row_number() OVER () AS row_key, * FROM measured) WHERE len(g) > 0
),
repeated AS (SELECT *, count(*) OVER (PARTITION BY row_key, g) AS c FROM places),
covered AS (SELECT row_key, count(DISTINCT i + o) AS n_repeat
  FROM repeated, (SELECT unnest(range(0, 8)) AS o) WHERE c > 1 GROUP BY row_key),
final AS (
  SELECT doc_id, n, word_chars, n_symbols, len(full_lines) - len(list_distinct(full_lines)) AS n_dup,
    coalesce(n_repeat, 0) AS n_repeat, len(l) AS n_lines, len(l) - len(good) AS n_removed,
    length(regexp_replace(array_to_string(good, chr(10)), '[\x20\x09-\x0D]+', '', 'g')) AS kept_chars
  FROM (SELECT row_number() OVER () AS row_key, * FROM measured) LEFT JOIN covered USING (row_key)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup AS BIGINT) AS n_dup_lines,
  CAST(n_repeat AS BIGINT) AS n_repeat_words,
  n < 20 OR 100 * n_repeat > 30 * n AS base_failed,
  NOT (n < 20 OR 100 * n_repeat > 30 * n) AND 100 * (word_chars - kept_chars) <= 50 * word_chars AS kept,
  CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, CAST(kept_chars AS BIGINT) AS kept_chars
FROM final
"""

URL_RULES = r"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
),
rules(rh, rp, v) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
),
best AS (
  SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) p
  JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY host, path
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (host, path)
"""

CHATS = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|turn|>') + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + 1
    + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length('<|end|>') + 1) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

LEAKS = f"""
WITH split AS (
  SELECT doc_id, row_number() OVER () AS k,
    regexp_extract_all({_low("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
),
items AS (
  SELECT item_id, regexp_extract_all({_low("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
),
windows AS (
  SELECT DISTINCT item_id, width, g FROM (
    SELECT item_id, least(len(w), 10) AS width,
      unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS g
    FROM items WHERE len(w) > 0)
),
widths AS (SELECT DISTINCT width FROM windows),
runs AS (
  SELECT k, width, i, array_to_string(w[i:i + width - 1], ' ') AS g
  FROM (SELECT k, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM split, widths WHERE len(w) >= width)
),
met AS (SELECT r.k, r.i, r.width, n.item_id FROM runs r JOIN windows n ON r.width = n.width AND r.g = n.g),
words_hit AS (
  SELECT k, count(DISTINCT p) AS n_hit
  FROM (SELECT k, unnest(range(i, i + width)) AS p FROM met) GROUP BY k
),
found AS (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS item FROM met WHERE item_id IS NOT NULL),
named AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM found GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM split LEFT JOIN words_hit USING (k) LEFT JOIN named USING (k)
"""


COLLOCATIONS = f"""
WITH
docs AS (SELECT coalesce(lang, 'und') AS lang, {_low("coalesce(text, '')")} AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM docs),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
leaves AS (SELECT lang, unnest(list_transform(range(1, len(w) + 1), lambda i: w[i:i + 2])) AS leaf FROM words),
totals AS (SELECT lang, count(*) AS n FROM leaves GROUP BY lang),
counts AS (
  SELECT lang, lang || chr(10) || array_to_string(leaf[1:d], ' ') AS key, any_value(leaf[1:d]) AS words, count(*) AS f
  FROM leaves CROSS JOIN (VALUES (1), (2), (3)) v(d) WHERE len(leaf) >= d GROUP BY lang, key
),
cands AS (SELECT lang, words, f AS a FROM counts WHERE len(words) >= 2 AND f >= 10),
parts AS (
  SELECT c.lang, c.words, c.a, v.k, c.lang || chr(10) || array_to_string(c.words[1:v.k], ' ') AS lw,
    c.lang || chr(10) || array_to_string(c.words[v.k + 1:3], ' ') AS rw
  FROM cands c CROSS JOIN (VALUES (1), (2)) v(k) WHERE v.k < len(c.words)
),
cuts AS (
  SELECT p.lang, p.words, p.a, p.k, l.f AS l, r.f AS r,
    CAST((CAST(p.a AS HUGEINT) * p.a * 1000000) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM parts p JOIN counts l ON l.key = p.lw JOIN counts r ON r.key = p.rw
),
weakest AS (
  SELECT lang, words, a, l, r, score FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1
),
inside AS (
  SELECT lang, key, max(a) AS outer_a FROM (
    SELECT lang, array_to_string(words[1:2], ' ') AS key, a FROM cands WHERE len(words) = 3
    UNION ALL SELECT lang, array_to_string(words[2:3], ' ') AS key, a FROM cands WHERE len(words) = 3
  ) GROUP BY lang, key
),
kept AS (
  SELECT w.* FROM weakest w LEFT JOIN inside i ON i.lang = w.lang AND i.key = array_to_string(w.words, ' ')
  WHERE i.outer_a IS NULL OR 100 * i.outer_a < 50 * w.a
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS rank
  FROM kept
)
SELECT k.lang, CAST(rank AS BIGINT) AS rank, array_to_string(words, ' ') AS phrase, CAST(a AS BIGINT) AS a,
  CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(t.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked k JOIN totals t ON t.lang = k.lang
WHERE rank <= 2000
"""


HARD_NEGATIVES = """
WITH
v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, e) = 1
),
anchors AS (SELECT * FROM v WHERE vec_id % 50 = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, x.vec_id, x.label,
    CAST(list_inner_product(a.e, x.e) AS BIGINT) AS s
  FROM anchors a JOIN v x ON x.vec_id <> a.vec_id
),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, s AS positive_score FROM scored WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.s DESC, n.vec_id) AS INTEGER) AS rank,
  n.vec_id AS negative_id, p.positive_score, n.s AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND n.label <> n.anchor_label
  AND 50 * p.positive_score <= 100 * n.s AND 100 * n.s <= 95 * p.positive_score
QUALIFY rank <= 3
"""
