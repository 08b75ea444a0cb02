"""DuckDB SQL for the operators whose contract SQL can express."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWERED = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: repeated windows of 20 words
SUBSTRING_DEDUP = rf"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
windows AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS k FROM words, unnest(range(1, len(w) - 18)) AS t(s)),
again AS (SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, s + d AS p FROM again, unnest(range(0, 20)) AS t(d)),
single AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM words),
marked AS (SELECT s.doc_id, s.p, s.x, g.p IS NOT NULL AS cut FROM single s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.p = g.p)
SELECT d.doc_id, count(m.p) AS n_words, count(m.p) FILTER (WHERE m.cut) AS n_removed,
       sha256(coalesce(string_agg(m.x, ' ' ORDER BY m.p) FILTER (WHERE NOT m.cut), '')) AS kept_sha256
FROM words d LEFT JOIN marked m ON d.doc_id = m.doc_id GROUP BY d.doc_id"""

#: windows of 10 words of benchmark items
DECONTAMINATION = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '{_ALNUM}') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({_LOWERED}, '{_ALNUM}') AS w FROM benchmark),
wanted AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS k
           FROM items, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(s) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM wanted),
windows AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS k FROM docs, lengths, unnest(range(1, len(w) - n + 2)) AS t(s)),
hits AS (SELECT doc_id, windows.n, s, item_id FROM windows JOIN wanted ON windows.k = wanted.k AND windows.n = wanted.n),
places AS (SELECT doc_id, count(DISTINCT s + d) AS n_hit FROM hits, unnest(range(0, n)) AS t(d) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)"""

#: components of sets of 3-word shingles with a Jaccard similarity of 0.9 or more
JACCARD_JOIN = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '{_SPACED}') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 2], ' ') AS g FROM words, unnest(range(1, greatest(len(w) - 1, 2))) AS t(s) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * i >= 90 * (x.n + y.n - i)),
reach AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT links.b, reach.root FROM reach JOIN links ON reach.id = links.a AND reach.root < links.b),
least AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
SELECT words.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM words LEFT JOIN sizes USING (doc_id) JOIN least ON least.id = words.doc_id"""
