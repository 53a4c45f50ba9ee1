"""SQL twins of operators whose results SQL can express, written from the definitions alone."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANKS = "'[^\\x20\\x09-\\x0D]+'"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, ws, least(10, len(ws)) AS k FROM (SELECT item_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark) WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(ws[i : i + k - 1], ' ') AS w FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS i FROM b)),
dw AS (SELECT doc_id, i, k, array_to_string(ws[i : i + k - 1], ' ') AS w FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(ws) >= k)),
h AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, w)),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN it USING (doc_id)
"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {BLANKS}) AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
r AS (SELECT doc_id, i FROM w JOIN (SELECT h, min(doc_id) AS least FROM w GROUP BY 1) USING (h) WHERE least < doc_id),
p AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM r) GROUP BY 1),
k AS (SELECT doc_id, ws, coalesce(len(gone), 0) AS n_removed, CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i)) END AS kept FROM d LEFT JOIN p USING (doc_id))
SELECT doc_id, len(ws)::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, {BLANKS}) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + least(5, len(ws)) - 1], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT e.y, r.root FROM reach r JOIN e ON e.x = r.doc_id WHERE r.root < e.y)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(root) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

#: What SQL can say about language-model scores: the split, the counts and the base score.
BASE_SCORES = f"""
WITH z AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS z),
k AS (SELECT doc_id, {LOWER} AS t, hex(doc_id::VARCHAR) AS x FROM documents),
d AS (SELECT doc_id, list_append(regexp_extract_all(t, {BLANKS}), ' ') AS ws, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, z[(xor(c, b) & 255) + 1])), 4294967295) % 10 = 0 AS held_out FROM k, z),
w AS (SELECT doc_id, held_out, unnest(ws) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM w WHERE NOT held_out GROUP BY 1),
a AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)))), 6) + 0.0 AS base_score
FROM w LEFT JOIN c USING (w), a GROUP BY 1, 2
"""
