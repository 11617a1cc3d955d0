"""DuckDB SQL for the numbered operators that SQL can express."""

from __future__ import annotations

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP8 = """
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(url, '://(.*)$', 1, 's') ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^[^?#]*') AS rest FROM a),
c AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), '%(up)s', '%(low)s') AS host, regexp_extract(rest, '/.*$', 0, 's') AS path FROM b),
rules(verdict, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('allow', 'example.net', '/de/8'), ('block', 'org', '/es/')),
hit AS (SELECT c.page_id, c.host, c.path, r.host || r.path AS rule, r.verdict,
  row_number() OVER (PARTITION BY c.page_id, c.host, c.path ORDER BY length(r.host) DESC, length(r.path) DESC) AS k
  FROM (SELECT DISTINCT * FROM c) c JOIN rules r ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path))
SELECT c.page_id, c.host, c.path, hit.rule, coalesce(hit.verdict, 'allow') AS verdict
FROM c LEFT JOIN hit ON hit.k = 1 AND c.page_id IS NOT DISTINCT FROM hit.page_id AND c.host = hit.host AND c.path = hit.path
""" % {"up": UP, "low": LOW}

OP9 = r"""
WITH a AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t, text FROM documents),
b AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM a),
wins AS (SELECT rid, i, list_slice(w, i, i + 7) AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM b WHERE len(w) >= 8)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM wins) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM again) GROUP BY rid),
m AS (SELECT b.rid, doc_id, lang, text, t, w, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM b LEFT JOIN rep ON b.rid = rep.rid),
cls AS (SELECT rid, k, CAST(CASE k WHEN 0 THEN length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) WHEN 1 THEN length(regexp_replace(t, '[^\p{Ll}]+', '', 'g'))
  WHEN 2 THEN length(regexp_replace(t, '[^\p{Nd}]+', '', 'g')) WHEN 3 THEN length(regexp_replace(t, '[^\x20\x09-\x0D]+', '', 'g'))
  WHEN 4 THEN length(regexp_replace(t, '[^.,;:!?''\x22()-]+', '', 'g')) ELSE length(regexp_replace(t, '[\p{Lu}\p{Ll}\p{Nd}\x20\x09-\x0D.,;:!?''\x22()-]+', '', 'g')) END AS DOUBLE) AS c
  FROM m, (SELECT unnest(range(0, 6)) AS k)),
langs AS (SELECT lang FROM m WHERE lang IS NOT NULL AND text IS NOT NULL GROUP BY lang HAVING count(*) >= 0.01 * (SELECT count(*) FROM m WHERE lang IS NOT NULL AND text IS NOT NULL)),
qc AS (SELECT lang, k, s / greatest(1.0, sum(s) OVER (PARTITION BY lang)) AS q FROM (SELECT m.lang, k, sum(c) AS s FROM m JOIN langs ON m.lang = langs.lang JOIN cls ON cls.rid = m.rid WHERE m.text IS NOT NULL GROUP BY m.lang, k)),
x AS (SELECT rid, lang, text, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM m),
xl AS (SELECT x.lang, w, count(*) AS n FROM x JOIN langs ON x.lang = langs.lang WHERE text IS NOT NULL GROUP BY x.lang, w),
xp AS (SELECT lang, w, n / sum(n) OVER (PARTITION BY lang) AS p FROM xl),
qw AS (SELECT lang, w, p AS q FROM xp WHERE p >= 0.01),
qo AS (SELECT langs.lang, greatest(0.0, 1.0 - coalesce(sum(q), 0.0)) AS q FROM langs LEFT JOIN qw ON qw.lang = langs.lang GROUP BY langs.lang),
dw AS (SELECT rid, w, count(*) AS n FROM x WHERE w IN (SELECT w FROM qw) GROUP BY rid, w),
pw AS (SELECT m.rid, qw.lang, coalesce(dw.n, 0) / m.n_words AS p, qw.q FROM m JOIN qw ON m.n_words > 0 LEFT JOIN dw ON dw.rid = m.rid AND dw.w = qw.w),
pw2 AS (SELECT * FROM pw UNION ALL SELECT m.rid, qo.lang, greatest(0.0, 1.0 - coalesce(s.p, 0.0)), qo.q FROM m JOIN qo ON m.n_words > 0 LEFT JOIN (SELECT rid, lang, sum(p) AS p FROM pw GROUP BY rid, lang) s ON s.rid = m.rid AND s.lang = qo.lang),
pc AS (SELECT m.rid, qc.lang, cls.c / length(m.t) AS p, qc.q FROM m JOIN cls ON cls.rid = m.rid JOIN qc ON qc.k = cls.k WHERE m.n_words > 0),
js AS (SELECT rid, lang, sum(CASE WHEN p > 0 THEN 0.5 * p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(q / ((p + q) / 2)) ELSE 0 END) AS d
  FROM (SELECT * FROM pw2 UNION ALL SELECT * FROM pc) GROUP BY rid, lang),
near AS (SELECT rid, sqrt(greatest(0.0, min(d) / 2)) AS d FROM js GROUP BY rid),
f AS (SELECT m.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, near.d FROM m LEFT JOIN near ON near.rid = m.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(d, 6) AS distance,
  NOT base_failed AND NOT (n_words >= 50 AND coalesce(d > 0.27, false)) AS kept FROM f
"""

OP10 = r"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(translate(text, '%(up)s', '%(low)s'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, '%(up)s', '%(low)s'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, list_slice(w, i, i + n - 1) AS win FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, text, n, i, list_slice(w, i, i + n - 1) AS win FROM (SELECT doc_id, text, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN sizes ON len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.text, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
words AS (SELECT doc_id, text, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, text, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id, text),
items AS (SELECT doc_id, text, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id, text)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, CAST(coalesce(words.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items.items, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id IS NOT DISTINCT FROM words.doc_id AND d.text = words.text LEFT JOIN items ON d.doc_id IS NOT DISTINCT FROM items.doc_id AND d.text = items.text
""" % {"up": UP, "low": LOW}

OP5 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, coalesce(text, '') AS t FROM documents),
pats(rk, kind, p) AS (VALUES (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), (2, 'card', '[0-9]([\x20-]?[0-9])+'), (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')),
hits AS (SELECT rid, 0 AS rk, unnest(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS m, unnest(regexp_split_to_array(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS gap, generate_subscripts(regexp_split_to_array(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'), 1) AS i FROM d
  UNION ALL SELECT rid, 1, unnest(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)')), unnest(regexp_split_to_array(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)')), generate_subscripts(regexp_split_to_array(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), 1) FROM d
  UNION ALL SELECT rid, 2, unnest(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+')), unnest(regexp_split_to_array(t, '[0-9]([\x20-]?[0-9])+')), generate_subscripts(regexp_split_to_array(t, '[0-9]([\x20-]?[0-9])+'), 1) FROM d
  UNION ALL SELECT rid, 3, unnest(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]')), unnest(regexp_split_to_array(t, '\+[0-9][\x20().0-9-]+[0-9]')), generate_subscripts(regexp_split_to_array(t, '\+[0-9][\x20().0-9-]+[0-9]'), 1) FROM d),
ends AS (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS dg, sum(length(gap) + length(m)) OVER (PARTITION BY rid, rk ORDER BY i) AS e FROM hits WHERE m IS NOT NULL),
spans AS (SELECT rid, rk, CAST(e - length(m) AS BIGINT) AS a, CAST(e AS BIGINT) AS b, (SELECT kind FROM pats WHERE pats.rk = ends.rk) AS kind, (SELECT kind FROM pats WHERE pats.rk = ends.rk) || ' ' || lower(m) AS entity FROM ends
  WHERE rk = 0 OR (rk = 1 AND len(list_filter(string_split(m, '.'), lambda x: TRY_CAST(x AS HUGEINT) > 255)) = 0)
    OR (rk = 2 AND length(dg) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(dg) + 1), lambda k: CASE WHEN k % 2 = 1 THEN CAST(substr(reverse(dg), k, 1) AS INT) ELSE (CAST(substr(reverse(dg), k, 1) AS INT) * 2) // 10 + (CAST(substr(reverse(dg), k, 1) AS INT) * 2) % 10 END)) % 10 = 0)
    OR (rk = 3 AND length(dg) BETWEEN 9 AND 15)),
side AS (SELECT s.rid, entity, greatest(a - 60, 0) AS lo, substr(t, greatest(a - 60, 0) + 1, a - greatest(a - 60, 0)) AS piece, greatest(a - 60, 0) > 0 AS cut0, false AS cut1, row_number() OVER () AS sid FROM spans s JOIN d ON d.rid = s.rid
  UNION ALL SELECT s.rid, entity, b, substr(t, b + 1, least(b + 60, length(t)) - b), false, least(b + 60, length(t)) < length(t), -row_number() OVER () FROM spans s JOIN d ON d.rid = s.rid),
runs AS (SELECT sid, rid, entity, lo, length(piece) AS n, cut0, cut1, unnest(regexp_extract_all(piece, '\p{L}+')) AS m, unnest(regexp_split_to_array(piece, '\p{L}+')) AS gap, generate_subscripts(regexp_split_to_array(piece, '\p{L}+'), 1) AS i FROM side),
words AS (SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY sid ORDER BY i) AS BIGINT) AS e FROM runs WHERE m IS NOT NULL),
near AS (SELECT DISTINCT w.rid, entity, lo + e - length(m) AS a, lo + e AS b, lower(m) AS term FROM words w WHERE length(m) >= 4 AND NOT (cut0 AND e = length(m)) AND NOT (cut1 AND e = n)
  AND NOT EXISTS (SELECT 1 FROM spans x WHERE x.rid = w.rid AND lo + e - length(m) < x.b AND lo + e > x.a)),
texts AS (SELECT DISTINCT entity, term, d.text FROM near JOIN d ON d.rid = near.rid),
pair AS (SELECT entity, term, count(*) AS n_both FROM texts GROUP BY 1, 2 HAVING count(*) >= 3),
ent AS (SELECT entity, count(DISTINCT text) AS n_entity FROM texts GROUP BY 1),
seen AS (SELECT term, count(DISTINCT text) AS n_term FROM (SELECT text, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM documents) WHERE length(term) >= 4 AND term IN (SELECT term FROM pair) GROUP BY 1),
told AS (SELECT pair.entity, pair.term FROM pair JOIN ent ON ent.entity = pair.entity JOIN seen ON seen.term = pair.term WHERE n_both / n_term >= 0.5 AND log2((n_both / n_term) * (SELECT count(*) FROM documents) / n_entity) >= 3),
terms AS (SELECT DISTINCT near.rid, near.a, near.b FROM near JOIN told ON told.entity = near.entity AND told.term = near.term),
bs AS (SELECT rid, count(*) FILTER (rk = 0) AS n0, count(*) FILTER (rk = 1) AS n1, count(*) FILTER (rk = 2) AS n2, count(*) FILTER (rk = 3) AS n3, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY rk, a) AS w FROM spans GROUP BY 1),
ts AS (SELECT rid, string_agg('term:' || a || ':' || b, ',' ORDER BY a, b) AS w FROM terms GROUP BY 1)
SELECT doc_id, coalesce(n0, 0) AS n_email, coalesce(n1, 0) AS n_ip, coalesce(n2, 0) AS n_card, coalesce(n3, 0) AS n_phone, sha256(coalesce(bs.w, '')) AS base_sha256, concat_ws(',', bs.w, ts.w) AS spans
FROM d LEFT JOIN bs ON bs.rid = d.rid LEFT JOIN ts ON ts.rid = d.rid
"""

OP11 = r"""
WITH r AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT c, turn, sha256(length(role) || ':' || role || text) AS dig, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r),
t AS (SELECT c, dig, words, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, dig) AS rn FROM g),
v AS (SELECT c, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, z: xor(u >> 1, CASE WHEN u & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM t)),
seq AS (SELECT v.c, 0 AS part, rn, dig FROM v JOIN t ON t.c = v.c - v.c % 20 AND t.rn <= v.h UNION ALL SELECT v.c, 1, rn, dig FROM v JOIN t ON t.c = v.c AND t.rn > v.h),
k AS (SELECT v.c, coalesce(string_agg(dig, '' ORDER BY part, rn), '') AS key, count(dig) AS n FROM v LEFT JOIN seq ON seq.c = v.c GROUP BY v.c),
n AS (SELECT substr(key, 1, 64 * d) AS key, d, min(c) AS c, count(*) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = n), '')) AS ends
  FROM (SELECT c, key, n, unnest(range(0, n + 1)) AS d FROM k) GROUP BY ALL),
kids AS (SELECT substr(key, 1, 64 * (d - 1)) AS key, d - 1 AS d, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL),
w AS (SELECT dig, any_value(words) AS words FROM t GROUP BY dig),
own AS (SELECT n.*, coalesce(kids.n, 0) AS kids, CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END AS leaf, (n.n - 1) * coalesce(w.words, 0) AS saved
  FROM n LEFT JOIN kids ON kids.key = n.key AND kids.d = n.d LEFT JOIN w ON w.dig = right(n.key, 64)),
sub AS (SELECT substr(key, 1, 64 * a) AS key, a AS d, sum(leaf) AS leaves, sum(saved) AS saved FROM (SELECT key, leaf, saved, unnest(range(0, d + 1)) AS a FROM own) GROUP BY ALL)
SELECT own.c AS conv_id, own.d AS depth, up.c AS parent_conv_id, own.n AS n_convs, own.kids AS n_children, CAST(sub.leaves AS BIGINT) AS n_leaves,
  CAST(sub.saved AS BIGINT) AS saved_tokens, own.ends AS ends_sha256
FROM own JOIN sub ON sub.key = own.key AND sub.d = own.d LEFT JOIN n up ON up.d = own.d - 1 AND up.key = substr(own.key, 1, 64 * (own.d - 1))
"""

OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, '%(up)s', '%(low)s'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []) AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS big_n, CAST(sum(len(w)) AS BIGINT) AS big_l FROM d),
i AS (SELECT row_number() OVER () AS iid, item_id, regexp_extract_all(translate(text, '%(up)s', '%(low)s'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
it AS (SELECT iid, item_id, term, count(*) AS q FROM (SELECT iid, item_id, unnest(w) AS term FROM i) GROUP BY ALL),
x AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM it) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM x GROUP BY term),
wt AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM df, s),
y AS (SELECT rid, doc_id, x.term, wt.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))) AS v FROM x JOIN wt ON wt.term = x.term, s),
z AS (SELECT iid, item_id, rid, doc_id, CAST(sum(q * v) AS BIGINT) AS score FROM it JOIN y ON y.term = it.term GROUP BY ALL),
r AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM z WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
""" % {"up": UP, "low": LOW}

ORACLES = {"op5_personal_data": OP5, "op8_url_filter": OP8, "op9_quality_rules": OP9, "op10_decontamination": OP10, "op11_prefix_trie": OP11, "op12_lexical_search": OP12}
