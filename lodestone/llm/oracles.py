"""DuckDB SQL of the operators that SQL can express, over whole tables."""

from __future__ import annotations

_SPACE = r"[\x20\x09-\x0D]+"
_WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '')"

SUBSTRINGS = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
hit AS (SELECT doc_id, i FROM win SEMI JOIN (SELECT s FROM win GROUP BY s HAVING count(*) > 1) r ON win.s = r.s),
gone AS (SELECT doc_id, list(DISTINCT j) AS g FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(g), 0) AS n_removed, sha256(array_to_string(list_filter(w, lambda x, k: NOT coalesce(list_contains(g, k), false)), ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)"""

_CUT = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

DECONTAMINATE = f"""WITH d AS (SELECT doc_id, {_CUT} AS w FROM documents), b AS (SELECT item_id, {_CUT} AS w FROM benchmark),
known AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 9], ' ') AS s, least(len(w), 10) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM known),
win AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, win.n AS n FROM win JOIN known ON win.s = known.s AND win.n = known.n),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, cast(item_id AS string) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

LINES = """WITH l AS (SELECT doc_id, k, x, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS p, len(string_split_regex(x, '[ \\t]+')) >= 50 AS long FROM (
SELECT doc_id, k, trim(y[k], chr(32) || chr(9) || chr(13)) AS x FROM (SELECT doc_id, y, unnest(range(1, len(y) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS y FROM documents))) WHERE x <> ''),
two AS (SELECT a.doc_id, a.p, a.k AS k1, b.k AS k2, row_number() OVER (PARTITION BY a.x, b.x ORDER BY a.doc_id, a.p) > 1 AS later FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.p = a.p + 1),
one AS (SELECT doc_id, k, row_number() OVER (PARTITION BY x ORDER BY doc_id, p) > 1 AS later FROM l WHERE long),
gone AS (SELECT doc_id, list(DISTINCT k) AS g FROM (SELECT doc_id, k1 AS k FROM two WHERE later UNION ALL SELECT doc_id, k2 FROM two WHERE later UNION ALL SELECT doc_id, k FROM one WHERE later) GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_lines, coalesce(len(g), 0) AS n_removed, sha256(array_to_string(list_filter(string_split(text, chr(10)), lambda x, k: NOT coalesce(list_contains(g, k), false)), chr(10))) AS text_sha256
FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id) USING (doc_id) LEFT JOIN gone USING (doc_id)"""

_TERMS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"

SEARCH = f"""WITH d AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::bigint AS n FROM p GROUP BY doc_id), t AS (SELECT count(*) AS docs, sum(n)::bigint AS terms FROM n),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)))::bigint AS w FROM p, t WHERE term IN (SELECT term FROM i) GROUP BY term),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::bigint AS score FROM i JOIN w USING (term) JOIN p USING (term) JOIN n USING (doc_id), t GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0) WHERE rank <= 50"""

NEGATIVES = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::double)) AS v FROM embeddings
WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_inner_product(a.v, b.v)::bigint AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE label <> p.own AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3"""
