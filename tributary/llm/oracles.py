"""SQL for the queries that SQL can express, by plain definitions over all rows."""

OP4 = """WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages),
m AS (SELECT d, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest, CASE WHEN last > page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN last > page_id THEN last END AS refers_to
FROM p LEFT JOIN m ON m.d = p.d AND p.n >= 1000"""

OP6 = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT r.doc_id, coalesce(max(n), 0) AS n_shingles, min(c) AS component_id, r.doc_id = min(c) AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""

OP8 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 200) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 99, 0))) AS i FROM d)),
x AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM p) WHERE k > 1),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 1 ELSE 0 END AS new FROM x)),
b AS (SELECT doc_id, span, min(i) AS a, max(i) + 100 AS z FROM g GROUP BY ALL),
q AS (SELECT b.doc_id, a, z, substr(h, CAST(2 * coalesce(lag(z) OVER o, 0) + 1 AS BIGINT), CAST(2 * (a - coalesce(lag(z) OVER o, 0)) AS BIGINT)) AS piece FROM b JOIN d ON d.doc_id = b.doc_id WINDOW o AS (PARTITION BY b.doc_id ORDER BY a)),
k AS (SELECT doc_id, string_agg(piece, '' ORDER BY a) AS kept, max(z) AS z, sum(z - a) AS removed, count(*) AS spans FROM q GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, CAST(2 * coalesce(z, 0) + 1 AS BIGINT)))) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""

OP11 = r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
g AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM d),
m AS (SELECT doc_id, 25 + (75 * n * nn) // ll AS m FROM d, g),
p AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term, nn),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, p.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN p ON p.term = q.term JOIN w ON w.term = p.term JOIN m ON m.doc_id = p.doc_id GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""

OP12 = r"""WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
f AS (SELECT doc_id, part, CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
 || CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM w),
b AS (SELECT doc_id, coalesce(max(CAST(quality = 1 AS INT)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INT)), 0) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN b ON b.doc_id = f.doc_id GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, '[' || substr(filter_order, 1, step) || ']' AS after, CASE WHEN step = 1 THEN '[^A-E]' ELSE '[' || substr(filter_order, 1, step - 1) || ']' END AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, own,
 coalesce(sum(n) FILTER (NOT regexp_matches(fails, after)), 0) AS kept, coalesce(sum(n) FILTER (contains(fails, own) AND NOT regexp_matches(fails, before)), 0) AS removed, coalesce(sum(n) FILTER (contains(fails, own) AND regexp_matches(fails, before)), 0) AS redundant,
 coalesce(sum(n) FILTER (fails = own), 0) AS unique_fails, coalesce(sum(good) FILTER (contains(fails, own) AND NOT regexp_matches(fails, before)), 0) AS good_lost, coalesce(sum(toxic) FILTER (contains(fails, own) AND NOT regexp_matches(fails, before)), 0) AS toxic_lost
 FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
 CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r"""

OP13 = r"""WITH w AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
p AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, host, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(p.n, 0) AS n_repeat_words,
 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w LEFT JOIN p ON p.doc_id = w.doc_id),
l AS (SELECT doc_id, host, trim(lower(regexp_replace(regexp_replace(x, '[\x20\x09\x0B-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g'))) AS x FROM (SELECT doc_id, host, unnest(ls) AS x FROM m)),
c AS (SELECT host, x, min(doc_id) AS first FROM l GROUP BY host, x HAVING count(DISTINCT doc_id) > 10),
r AS (SELECT doc_id, CAST(sum(len(string_split(l.x, ' '))) AS BIGINT) AS n FROM l JOIN c ON c.host = l.host AND c.x = l.x AND l.doc_id > c.first GROUP BY doc_id),
b AS (SELECT m.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT b.doc_id, n_words, word_chars, n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND n_words - coalesce(r.n, 0) >= 10 AND 100 * (n_words - coalesce(r.n, 0)) >= 50 * n_words AS kept, CASE WHEN base_failed THEN 0 ELSE coalesce(r.n, 0) END AS n_words_lost FROM b LEFT JOIN r ON r.doc_id = b.doc_id"""
