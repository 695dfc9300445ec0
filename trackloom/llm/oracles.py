"""SQL that gives the same rows as the queries, for DuckDB on the same tables."""

from __future__ import annotations

from trackloom.llm import licences
from trackloom.llm.mixing import MARGINS, OTHER, Targets

CHAT = """
WITH m AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS content, count(*) AS n_rows
  FROM conversations GROUP BY ALL),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM m WHERE speaker <> 'system'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, content) - 1 AS place FROM m),
s AS (
  SELECT m.*, p.perspective, place // 64 AS piece,
    CASE WHEN speaker = perspective THEN '<|im_start|>assistant' || chr(10)
         WHEN speaker = 'system' THEN '<|im_start|>system' || chr(10)
         ELSE '<|im_start|>user name=' || replace(replace(regexp_replace(speaker, '\\s', '_', 'g'), '<|', '< |'), '|>', '| >') || chr(10) END AS head,
    replace(replace(content, '<|', '< |'), '|>', '| >') || '<|im_end|>' AS body
  FROM n m JOIN p ON m.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (
  SELECT *, CAST(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, piece ORDER BY place) AS BIGINT) - length(body) - 1 AS pos
  FROM s)
SELECT conv_id, perspective, piece, CAST(count(*) AS BIGINT) AS n_messages, CAST(sum(n_rows) AS BIGINT) AS n_rows,
  string_agg(head || body || chr(10), '' ORDER BY place) AS text,
  coalesce(string_agg(pos || '-' || (pos + length(body)), ',' ORDER BY place) FILTER (speaker = perspective), '') AS mask,
  CAST(coalesce(sum(length(body)) FILTER (speaker = perspective), 0) AS BIGINT) AS n_trained
FROM o GROUP BY conv_id, perspective, piece
"""


def mixing(targets: Targets, rounds: int, seed: str) -> str:
    quoted = lambda m: ", ".join(f"'{x}'" for x in targets[m] if x != OTHER)
    goal = lambda m: "CASE " + " ".join(f"WHEN g_{m} = '{x}' THEN CAST({w!r} AS DOUBLE)" for x, w in sorted(targets[m].items())) + " ELSE CAST(0 AS DOUBLE) END"
    keys = ", ".join(f"g_{m}" for m in MARGINS)
    steps, at = [], "w0"
    for i in range(rounds):
        for m in MARGINS:
            own = f"sum(weight) OVER (PARTITION BY g_{m})"
            steps.append(f"{m[0]}{i} AS (SELECT {keys}, tokens, CASE WHEN {own} > 0 THEN weight * ({goal(m)}) / {own} ELSE 0 END AS weight FROM {at})")
            at = f"{m[0]}{i}"
    return f"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS tokens,
    CASE WHEN source IN ({quoted("source")}) THEN source ELSE '{OTHER}' END AS g_source,
    CASE WHEN lang IN ({quoted("lang")}) THEN lang ELSE '{OTHER}' END AS g_lang,
    CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN contains(text, ' | ') THEN 'table'
         WHEN length(text) < 1500 THEN 'short' ELSE 'long' END AS topic
  FROM documents),
e AS (SELECT * EXCLUDE (topic), CASE WHEN topic IN ({quoted("topic")}) THEN topic ELSE '{OTHER}' END AS g_topic FROM d),
c AS (SELECT {keys}, sum(tokens) AS tokens FROM e GROUP BY ALL),
w0 AS (SELECT {keys}, tokens, CAST(tokens AS DOUBLE) AS weight FROM c),
{", ".join(steps)},
f AS (SELECT {keys}, tokens, CASE WHEN tokens > 0 THEN CASE WHEN sum(weight) OVER () > 0 THEN weight / sum(weight) OVER () ELSE 0 END / tokens END AS factor FROM {at}),
q AS (SELECT {keys}, CASE WHEN tokens = 0 THEN 1 WHEN max(factor) OVER () > 0 THEN round(factor / max(factor) OVER (), 9) ELSE 1 END AS probability FROM f)
SELECT doc_id, {", ".join(f"e.g_{m} AS {m}_group" for m in MARGINS)}, tokens, probability,
  CAST(('0x' || substr(md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) < probability AS kept
FROM e JOIN q ON {" AND ".join(f"e.g_{m} = q.g_{m}" for m in MARGINS)}
"""


def licence_scan(templates: tuple[licences.Template, ...]) -> str:
    rows = ", ".join(f"({n}, {i}, '{w}', {i in licences.key_positions(t)})" for n, t in enumerate(templates) for i, w in enumerate(t.text.split()))
    heads = ", ".join(f"({n}, '{t.label}', {t.base}, {len(t.text.split())}, {len(licences.key_positions(t))}, CAST({1.0 if t.base else licences.SHARE} AS DOUBLE))" for n, t in enumerate(templates))
    return f"""
WITH tw AS (SELECT * FROM (VALUES {rows}) v(t, pos, word, mandatory)),
th AS (SELECT * FROM (VALUES {heads}) v(t, label, base, size, n_mandatory, least)),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM d),
df AS (SELECT word, count(DISTINCT doc_id) AS n FROM w WHERE word IN (SELECT word FROM tw) GROUP BY word),
lk AS (SELECT t, pos FROM tw LEFT JOIN df USING (word) WHERE mandatory QUALIFY row_number() OVER (PARTITION BY t ORDER BY coalesce(n, 0), pos) = 1),
m AS (SELECT doc_id, t, i - tw.pos AS start, count(*) AS equal, count(*) FILTER (mandatory) AS keys, bool_or(tw.pos = lk.pos) AS seen FROM w JOIN tw USING (word) JOIN lk USING (t) GROUP BY ALL HAVING seen),
p AS (SELECT *, equal / CAST(size AS DOUBLE) AS share, keys = n_mandatory AND equal / CAST(size AS DOUBLE) >= least AS holds FROM m JOIN th USING (t)),
s AS (SELECT doc_id, max(share) AS score, count(*) FILTER (holds AND base) AS n_base, min(start) FILTER (holds AND base) AS first_word, max(start) FILTER (holds AND base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (holds AND base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (holds) AS labels FROM p GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score FROM d LEFT JOIN s USING (doc_id)
"""


TOP_K = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""

SUBSTRINGS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM d WHERE n >= 50)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
g AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS step FROM w JOIN f USING (s) WHERE doc_id > first),
r AS (SELECT doc_id, p, sum(CASE WHEN step <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g),
x AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM r GROUP BY ALL),
k AS (SELECT doc_id, coalesce(lag(b) OVER o, 0) AS a, a AS b FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY a) UNION ALL SELECT doc_id, max(b), NULL FROM x GROUP BY doc_id),
t AS (SELECT k.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a) AS kept FROM k JOIN d USING (doc_id) GROUP BY k.doc_id),
y AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM x GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN y USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def spaced_seeds(span: int, least: int) -> str:
    """Matches by trying each mask of decontaminate as a join; sizes of items are those of the table."""
    from trackloom.llm.decontaminate import masks, misses

    words = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    joins = []
    for n in range(least, span + 1):
        for kept in masks(n):
            key = lambda x: "concat_ws(' ', " + ", ".join(f"{x}[{i + 1}]" for i in kept) + ")"  # noqa: E731, B023
            joins.append(f"SELECT d.doc_id, d.i, b.v, d.v AS own FROM (SELECT doc_id, i, v, {key('v')} AS k FROM dw WHERE len(v) = {n}) d JOIN (SELECT v, {key('v')} AS k FROM bw WHERE len(v) = {n}) b USING (k)")
    tolerated = "CASE " + " ".join(f"WHEN len(v) = {n} THEN {misses(n)}" for n in range(least, span + 1)) + " END"
    return f"""
WITH b AS (SELECT item_id, coalesce(regexp_extract_all({lower}, '{words}'), []) AS w FROM benchmark WHERE item_id IS NOT NULL),
bi AS (SELECT DISTINCT item_id, w[p : p + least(len(w), {span}) - 1] AS v FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {span}) + 2)) AS p FROM b WHERE len(w) >= {least})),
bw AS (SELECT v, min(item_id) AS item_id, count(*) AS n_items FROM bi GROUP BY v),
d AS (SELECT doc_id, coalesce(regexp_extract_all({lower}, '{words}'), []) AS w FROM documents),
z AS (SELECT DISTINCT len(v) AS z FROM bw),
dw AS (SELECT doc_id, p - 1 AS i, w[p : p + z - 1] AS v FROM (SELECT doc_id, w, z, unnest(range(1, len(w) - z + 2)) AS p FROM d, z WHERE len(w) >= z)),
c AS ({" UNION ".join(joins)}),
e AS (SELECT doc_id, i, v, list_sum(list_transform(range(1, len(v) + 1), lambda x: CAST(v[x] = own[x] AS INTEGER))) AS equal FROM c),
m AS (SELECT doc_id, i, len(v) AS size, min(item_id) AS item_id, sum(n_items) AS n_links, max(equal) AS equal FROM e JOIN bw USING (v) WHERE len(v) - equal <= {tolerated} GROUP BY ALL)
SELECT doc_id, min(item_id) AS item_id, count(*) AS n_windows, CAST(sum(n_links) AS BIGINT) AS n_links, min(i) AS first_word, max(i + size - 1) AS last_word, CAST(max(equal) AS BIGINT) AS equal_words FROM m GROUP BY doc_id
"""

LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: crc32 is not among DuckDB's functions: bit by bit over the digits of the id.
PREFIXES = """
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT DISTINCT conv_id AS c, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, n: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 6 AS h FROM o),
r AS (SELECT c, 0 AS part, p, role, text FROM k JOIN o ON conv_id = base AND p < h UNION ALL SELECT c, 1, p, role, text FROM k JOIN o ON conv_id = c AND p >= h),
d AS (SELECT c, row_number() OVER w AS depth, string_agg(md5(length(role) || role || text), '') OVER w AS path, length(text) AS chars FROM r WINDOW w AS (PARTITION BY c ORDER BY part, p)),
m AS (SELECT * FROM d UNION ALL SELECT c, 0, '', 0 FROM k),
g AS (SELECT depth, path, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, substr(path, 1, 32 * (depth - 1)) AS up FROM m GROUP BY depth, path),
kids AS (SELECT depth - 1 AS depth, up AS path, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY ALL),
t AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN kids USING (depth, path)),
a AS (SELECT unnest(range(0, depth + 1)) AS depth, path, n_children, (n_convs - 1) * chars AS saved FROM t),
s AS (SELECT depth, substr(path, 1, 32 * depth) AS path, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM a GROUP BY ALL),
z AS (SELECT c, max(depth) AS depth, arg_max(path, depth) AS path FROM m GROUP BY c),
e AS (SELECT depth, path, count(*) AS n_ends, sha256(string_agg(c, ',' ORDER BY c)) AS ends_sha256 FROM z GROUP BY ALL)
SELECT t.conv_id, t.depth, u.conv_id AS parent_conv_id, t.n_convs, t.n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM t JOIN s USING (depth, path) LEFT JOIN e USING (depth, path) LEFT JOIN t u ON u.depth = t.depth - 1 AND u.path = t.up
"""


def line_dedup(min_chars: int, min_docs: int) -> str:
    return f"""
WITH r AS (SELECT row_number() OVER () AS i, doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
l AS (SELECT i, doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS p FROM r),
k AS (SELECT *, {LOWER_SQL.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {min_chars} GROUP BY key HAVING count(DISTINCT i) >= {min_docs}),
g AS (SELECT i, doc_id, p, line, f.key IS NOT NULL AND doc_id IS DISTINCT FROM last AS lost FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT lost), '')) AS kept_sha256
FROM g GROUP BY i, doc_id
"""


def collocations(length: int, least: int, top: int, share: int) -> str:
    return f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex({LOWER_SQL.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]') AS pieces FROM documents),
w AS (SELECT lang, regexp_extract_all(unnest(pieces), '[^\\x20\\x09]+') AS w FROM d),
g AS (SELECT lang, n, array_to_string(w[i : i + n - 1], ' ') AS phrase FROM (SELECT lang, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, range(1, {length + 1}) v(n))),
f AS (SELECT lang, n, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {least}),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS (SELECT lang, n AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE n >= 2),
k AS (SELECT lang, size, phrase, a, k, array_to_string(w[1:k], ' ') AS p, array_to_string(w[k + 1 :], ' ') AS q FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
s AS (SELECT k.*, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * a) // (x.f + y.f) AS BIGINT) AS score FROM k JOIN f x ON x.lang = k.lang AND x.phrase = p JOIN f y ON y.lang = k.lang AND y.phrase = q),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM c, range(2, {length}) v(m) WHERE m < size) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, t.n, score
FROM b LEFT JOIN i USING (lang, phrase) JOIN t USING (lang) WHERE longer IS NULL OR 100 * longer < {share} * a QUALIFY rank <= {top}
"""
