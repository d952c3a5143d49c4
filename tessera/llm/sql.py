"""DuckDB SQL for the queries that SQL can express."""

_OP3 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), r AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g
), c AS (
  SELECT doc_id, sum(least(3, coalesce(nxt - i, 3)))::BIGINT AS n FROM (
    SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r WHERE n > 1) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(l) AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: list_contains([STOP], lower(x)))) AS n_stop
  FROM d LEFT JOIN c ON d.doc_id = c.doc_id
), v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2 AND 20 AND n_symbols / n_words <= 0.25
       AND n_stop / n_words >= 0.02 AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.4) AS kept
FROM v
"""

_OP10 = r"""
WITH t AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL
  SELECT -1, i, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(i, r)
), e AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         length(replace(replace(coalesce(text, ''), '&', '&amp;'), '<|', '&lt;|')) AS n,
         lag(coalesce(role, '')) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before
  FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n + CASE WHEN before IS DISTINCT FROM role
           THEN length('<|im_start|>') + length(role) + 1 + length('<|im_end|>') + 1
           ELSE length('<|im_sep|>') END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


_OP4 = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents
), s AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100)
), r AS (
  SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM s) WHERE k > 1
), b AS (
  SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r
), sp AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS e
  FROM (SELECT *, sum(CASE WHEN p IS NULL OR i > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM b)
  GROUP BY doc_id, k
), pc AS (
  SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t FROM sp
  UNION ALL SELECT doc_id, max(e), NULL FROM sp GROUP BY doc_id
), kp AS (
  SELECT pc.doc_id, string_agg(substr(h, 2 * f + 1, 2 * (coalesce(t, n) - f)), '' ORDER BY f) AS h FROM pc JOIN d ON pc.doc_id = d.doc_id GROUP BY pc.doc_id
), m AS (
  SELECT doc_id, sum(e - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM sp GROUP BY doc_id
)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kp.h, d.h))) AS kept_sha256
FROM d LEFT JOIN m ON d.doc_id = m.doc_id LEFT JOIN kp ON d.doc_id = kp.doc_id
"""

_OP6 = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), o AS (
  SELECT doc_id, item_id, i, dw.n FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n
), h AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM o) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM o) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""

_OP8 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, least(len(w), 5) AS k, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id
), l AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, z.doc_id AS b, count(*) AS i FROM s x JOIN s z ON x.g = z.g AND x.k = z.k AND x.doc_id <> z.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)
), r(a, b) AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) c ON c.a = d.doc_id
"""

_OP7 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS kept FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN kept END AS refers_to
FROM m
"""

_OP12 = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t),
          regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id
), g AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails
), i AS (
  SELECT unnest([1, 2, 3, 4, 5]) AS i
), o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), s AS (
  SELECT o, i AS step, o[i] AS own, o[1:i - 1] AS before FROM o, i
), r AS (
  SELECT part, array_to_string(list_transform(o, lambda x: 'ABCDE'[x]), '') AS filter_order, step, own,
         list_bool_or(list_transform(before, lambda x: fails[x])) AS gone, fails[own] AS fail, len(list_filter(fails, lambda x: x)) AS n_fails, n, good, toxic
  FROM s, g
), k AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT coalesce(gone, false) AND NOT fail), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (NOT coalesce(gone, false) AND fail), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (gone AND fail), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fail AND n_fails = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (NOT coalesce(gone, false) AND fail), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (NOT coalesce(gone, false) AND fail), 0)::BIGINT AS toxic_lost
  FROM r GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM k
"""

_OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), w AS (
  SELECT i, lang, source, unnest(w) AS term FROM d
), k AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 3
), g AS (
  SELECT DISTINCT lang, source FROM d
), v AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang
), c AS (
  SELECT g.lang, g.source, k.term, k.n AS total FROM g JOIN k ON g.lang = k.lang
), n AS (
  SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL
), m AS (
  SELECT lang, source, sum(n)::HUGEINT AS n FROM n GROUP BY lang, source
), p AS (
  SELECT c.lang, c.source, c.term, coalesce(n.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(n.n, 0) + 1) // (coalesce(m.n, 0) + v.v) AS p, 1 + 1000000000::HUGEINT * (c.total + 1) // (v.n + v.v) AS q
  FROM c JOIN v ON c.lang = v.lang LEFT JOIN n ON n.lang = c.lang AND n.source = c.source AND n.term = c.term LEFT JOIN m ON m.lang = c.lang AND m.source = c.source
), pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), term AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM pair
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) FROM term
)
SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def _stop() -> str:
    from .quality import STOP_WORDS

    return ", ".join(f"'{w}'" for w in STOP_WORDS)


SQL = {
    "op3_quality": _OP3.replace("STOP", _stop()),
    "op4_repeats": _OP4,
    "op6_decontamination": _OP6,
    "op7_warc": _OP7,
    "op8_jaccard": _OP8,
    "op10_chat": _OP10,
    "op12_filter_audit": _OP12,
    "op13_divergence": _OP13,
}
