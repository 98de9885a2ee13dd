"""DuckDB SQL for the llm queries that SQL can state."""

from itertools import permutations

_HOST = "CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END"
_PATH = "CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '(?s)^[^/?#]*([^?#]*)', 1) ELSE '' END"

#: Unsigned crc32 of the text {0}, bit by bit.
_CRC = "xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length({0})), lambda i: ascii(substr({0}, CAST(i AS INT) + 1, 1))::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda i: i::BIGINT)), lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))))"


def _hashed(*values: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')" for v in values) + ")"


_ROW = ("doc_id", "source", "lang", "n_chars")
_ORDERS = ", ".join(f"('{''.join(p)}')" for p in permutations("ABCDE"))

ORACLE: dict[str, str] = {
    "op1_url_filter": f"""
WITH rules(rh, rp, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
p AS (SELECT row_number() OVER () AS r, page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
m AS (SELECT r, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY r ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
      FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.r = m.r AND m.k = 1""",
    "op3_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
k AS (SELECT doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
f AS (SELECT k.doc_id, i, line, hot.key IS NOT NULL AND k.doc_id <> keeper AS gone FROM k LEFT JOIN hot ON k.key = hot.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM f GROUP BY doc_id""",
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, upper(sha1(h)) AS x, max(page_id) OVER (PARTITION BY h) AS keeper FROM p),
n AS (SELECT *, list_transform(range(40), lambda i: strpos('0123456789ABCDEF', substr(x, i + 1, 1)) - 1) AS v FROM d)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
         ((v[1 + (5 * j) // 4] * 16 + coalesce(v[2 + (5 * j) // 4], 0)) // (CAST(pow(2, 3 - (5 * j) % 4) AS BIGINT)) % 32), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to, true AS valid FROM n""",
    "op6_substring_dedup": r"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE doc_id IS NOT NULL),
e AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, regexp_extract_all(t, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS wb, length(regexp_extract(t, '^[\x20\x09-\x0D]*')) AS lead FROM d),
x AS (SELECT doc_id, ws, lead, unnest(range(len(ws))) AS i, unnest(ws) AS w, unnest(wb) AS b FROM e),
p AS (SELECT *, lead + coalesce(sum(length(b)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM x),
q AS (SELECT doc_id, i, a, lead(a + length(w), 50) OVER (PARTITION BY doc_id ORDER BY i) AS z, CASE WHEN i + 51 <= len(ws) THEN array_to_string(list_slice(ws, i + 1, i + 51), ' ') END AS key FROM p),
f AS (SELECT *, first_value(doc_id) OVER k AS fd, first_value(i) OVER k AS fi, first_value(a) OVER k AS fa FROM q WHERE key IS NOT NULL WINDOW k AS (PARTITION BY key ORDER BY doc_id, i)),
runs AS (SELECT doc_id, i AS word, i + 51 AS til, a, z, fd, fa, 1 AS kind FROM f WHERE doc_id <> fd OR i - fi >= 51),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS i FROM d),
o AS (SELECT *, coalesce(sum(length(line) + 1) OVER g, 0) AS off, coalesce(sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) OVER g, 0) AS word, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l
      WINDOW g AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS unit, off, length(line) AS n, len(ws) AS words, array_to_string(ws, ' ') AS key FROM o WHERE len(ws) > 0),
r AS (SELECT *, row_number() OVER k AS nth, first_value(doc_id) OVER k AS fd, first_value(off) OVER k AS fa FROM u WINDOW k AS (PARTITION BY key ORDER BY doc_id, unit)),
g AS (SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS island FROM r WHERE nth > 1),
lines AS (SELECT doc_id, min(word) AS word, min(word) + sum(words) AS til, min(off) AS a, max(off + n) AS z, arg_min(fd, unit) AS fd, arg_min(fa, unit) AS fa, 0 AS kind FROM g GROUP BY doc_id, island HAVING sum(words) > 50),
joint AS (SELECT * FROM runs UNION ALL SELECT * FROM lines),
m AS (SELECT *, max(til) OVER (PARTITION BY doc_id ORDER BY word, kind, til ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM joint),
s AS (SELECT *, sum(CASE WHEN word <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY word, kind, til ROWS UNBOUNDED PRECEDING) AS span FROM m)
SELECT doc_id, CAST(min(a) AS BIGINT) AS "start", CAST(max(z) AS BIGINT) AS "end", CAST(max(til) - min(word) AS BIGINT) AS words,
       arg_min(fd, word * 2 + kind) AS kept_doc_id, CAST(arg_min(fa, word * 2 + kind) AS BIGINT) AS kept_start FROM s GROUP BY doc_id, span""",
    "op8_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
c(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
m AS (SELECT a, min(b) AS component_id FROM c GROUP BY a),
n AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.k, 0) AS n_links, m.component_id, v.vec_id = m.component_id AS kept FROM v JOIN m ON v.vec_id = m.a LEFT JOIN n ON v.vec_id = n.a""",
    "op2_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))) END AS ss FROM w),
x AS (SELECT doc_id, len(ss) AS n, unnest(ss) AS shingle FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o WHERE 100 * k >= 80 * (na + nb - k)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT c.a, u.b FROM c JOIN u ON c.b = u.a)
SELECT s.doc_id, len(ss) AS n_shingles, m.component_id FROM s JOIN (SELECT a, min(b) AS component_id FROM c GROUP BY a) m ON s.doc_id = m.a""",
    "op11_merkle": f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, source, {_hashed(*_ROW, 'text')} AS leaf,
  CASE WHEN {_CRC.format("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_hashed(*_ROW, "replace(text, chr(10), '')")} ELSE {_hashed(*_ROW, 'text')} END AS seen FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM d),
t(s, h, j, n, x) AS (SELECT s, 0, i, n, leaf FROM o UNION ALL SELECT s, h + 1, j // 3, (max(n) + 2) // 3, sha256(string_agg(x, '' ORDER BY j)) FROM t WHERE n > 1 GROUP BY s, h, j // 3),
g AS (SELECT s, h AS height, x AS subroot FROM t WHERE n = 1),
u(h, j, n, x) AS (SELECT 0, s, (SELECT count(*) FROM g), subroot FROM g UNION ALL SELECT h + 1, j // 3, (max(n) + 2) // 3, sha256(string_agg(x, '' ORDER BY j)) FROM u WHERE n > 1 GROUP BY h, j // 3),
ls AS (SELECT s, h, j // 3 AS p, j, x FROM t WHERE n > 1), us AS (SELECT h, j // 3 AS p, j, x FROM u WHERE n > 1),
la AS (SELECT a.s, a.h, a.j, string_agg(CASE WHEN b.j < a.j THEN b.x END, '' ORDER BY b.j) AS l, string_agg(CASE WHEN b.j > a.j THEN b.x END, '' ORDER BY b.j) AS r FROM ls a JOIN ls b ON a.s = b.s AND a.h = b.h AND a.p = b.p GROUP BY ALL),
ua AS (SELECT a.h, a.j, string_agg(CASE WHEN b.j < a.j THEN b.x END, '' ORDER BY b.j) AS l, string_agg(CASE WHEN b.j > a.j THEN b.x END, '' ORDER BY b.j) AS r FROM us a JOIN us b ON a.h = b.h AND a.p = b.p GROUP BY ALL),
f(r, s, i, h, height, x, proof, upper) AS (SELECT o.r, o.s, o.i, 0, g.height, seen, '', false FROM o JOIN g ON o.s = g.s
  UNION ALL SELECT f.r, f.s, CASE WHEN f.h < f.height THEN f.i // 3 WHEN f.h = f.height AND NOT f.upper THEN f.s ELSE f.i // 3 END, CASE WHEN f.h = f.height AND NOT f.upper THEN 0 ELSE f.h + 1 END, f.height,
    CASE WHEN f.h = f.height AND NOT f.upper THEN f.x WHEN f.upper THEN sha256(coalesce(ua.l, '') || f.x || coalesce(ua.r, '')) ELSE sha256(coalesce(la.l, '') || f.x || coalesce(la.r, '')) END,
    f.proof || CASE WHEN f.h = f.height AND NOT f.upper THEN '' WHEN f.upper THEN coalesce(ua.l, '') || coalesce(ua.r, '') ELSE coalesce(la.l, '') || coalesce(la.r, '') END, f.upper OR f.h = f.height
  FROM f LEFT JOIN la ON NOT f.upper AND la.s = f.s AND la.h = f.h AND la.j = f.i LEFT JOIN ua ON f.upper AND ua.h = f.h AND ua.j = f.i WHERE NOT f.upper OR ua.h IS NOT NULL),
e AS (SELECT r, arg_max(x, h) AS folded_root, sha256(arg_max(proof, h)) AS proof_sha256 FROM f WHERE upper GROUP BY r), root AS (SELECT x AS root FROM u WHERE n = 1)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM o JOIN g USING (s) JOIN e USING (r), root""",
    "op13_filter_audit": rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
m AS (SELECT doc_id, part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'),
  coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails FROM w),
y AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN y USING (doc_id) GROUP BY part, fails),
o(filter_order) AS (VALUES {_ORDERS}),
s AS (SELECT filter_order, CAST(k AS INT) AS step, substr(filter_order, CAST(k AS INT), 1) AS f FROM o, range(1, 6) r(k)),
x AS (SELECT c.*, filter_order, step, f, fails[ascii(f) - 64] AS own, list_bool_or(list_transform(string_split(substr(filter_order, 1, step - 1), ''), lambda a: a <> '' AND fails[ascii(a) - 64])) AS gone FROM s, c),
z AS (SELECT part, filter_order, step, f, sum(CASE WHEN NOT own AND NOT coalesce(gone, false) THEN n ELSE 0 END) AS kept, sum(CASE WHEN own AND NOT coalesce(gone, false) THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN own AND coalesce(gone, false) THEN n ELSE 0 END) AS redundant, sum(CASE WHEN own AND len(list_filter(fails, lambda a: a)) = 1 THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN own AND NOT coalesce(gone, false) THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN own AND NOT coalesce(gone, false) THEN toxic ELSE 0 END) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM z""",
}
