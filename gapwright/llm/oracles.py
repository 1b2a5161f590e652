"""DuckDB texts of the queries that SQL can state."""

from __future__ import annotations

QUALITY = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
d AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS k FROM g) WHERE k > 1),
c AS (SELECT rid, count(DISTINCT i + o) AS n_repeat_words FROM d, (SELECT unnest([0, 1, 2]) AS o) GROUP BY rid),
m AS (SELECT t.rid, t.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
        length(text) - length(regexp_replace(text, '\p{L}+', '', 'g')) AS n_letters
      FROM t JOIN w USING (rid)),
r AS (SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
        len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, n_letters::BIGINT AS n_letters
      FROM m LEFT JOIN c USING (rid)),
f AS (SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
        + 8 * (2 * n_dup_lines > n_lines)::INT + 16 * (100 * n_letters < 50 * word_chars)::INT
        + 32 * (word_chars < 2 * n_words)::INT + 64 * (word_chars > 25 * n_words)::INT)::BIGINT AS failed FROM r)
SELECT *, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept FROM f
"""

NEAR = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS ss FROM w),
c AS MATERIALIZED (SELECT doc_id, len(ss) AS n, ss FROM s),
classes AS MATERIALIZED (SELECT min(doc_id) AS rep, n, md5(array_to_string(list_sort(ss), chr(10))) AS k FROM c WHERE n > 0 GROUP BY ALL),
x AS MATERIALIZED (SELECT rep, n, hash(unnest(ss)) AS g FROM (SELECT rep, classes.n, ss FROM classes JOIN c ON c.doc_id = rep)),
p AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * k >= 75 * (na + nb - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(id, r) AS (SELECT rep, rep FROM classes UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.r),
comp AS (SELECT id, min(r) AS comp FROM reach GROUP BY id)
SELECT c.doc_id, c.n::BIGINT AS n_shingles, coalesce(comp, c.doc_id) AS component_id, coalesce(comp, c.doc_id) = c.doc_id AS kept
FROM c LEFT JOIN classes ON classes.n = c.n AND k = md5(array_to_string(list_sort(ss), chr(10))) LEFT JOIN comp ON id = rep
"""

SHARDS = r"""
WITH tbl AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
crc AS (SELECT doc_id, len(h) // 2 + 1 AS size,
        xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(len(h) // 2),
            lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
            lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS text_crc32
      FROM b, tbl),
u AS (SELECT doc_id, s, 1.0::DOUBLE / -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || s), 1, 13))::BIGINT + 0.5::DOUBLE)
        / 4503599627370496) AS v
      FROM documents, (SELECT unnest(range(17)) AS s)),
p AS (SELECT doc_id, arg_max(s, v) FILTER (s < 16) AS shard, arg_max(s, v) AS grown_shard FROM u GROUP BY doc_id)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, grown_shard::INT AS grown_shard
FROM crc JOIN p USING (doc_id)
"""

LINES = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(r.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (r.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN r USING (key) GROUP BY doc_id
"""

#: near pairs as links at 80 %; no document is dropped
JOIN = NEAR.replace("100 * k >= 75 *", "100 * k >= 80 *").replace(", coalesce(comp, c.doc_id) = c.doc_id AS kept", "")

CRC = r"""tbl AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t)"""


def _crc(value: str) -> str:
    """CRC-32 of a SQL text value in DuckDB, with the table ``t`` of ``tbl`` in scope."""
    h = f"hex(encode({value}))"
    return f"""xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(len({h}) // 2),
            lambda i: ('0x' || substr({h}, 2 * i + 1, 2))::BIGINT), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])))"""


SPELLING = f"""
WITH RECURSIVE {CRC},
r AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS k
      FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')) AS w FROM documents)
      WHERE length(w) >= 6 GROUP BY ALL),
h AS (SELECT w, k, {_crc("coalesce(doc_id::VARCHAR, '') || ':' || w")} AS h FROM r, tbl),
d AS (SELECT CASE WHEN h % 199 = 0 THEN w[:(h % length(w))] || w[(h % length(w)) + 2:] ELSE w END AS w, k FROM h),
v AS MATERIALIZED (SELECT w, sum(k)::BIGINT AS n FROM d WHERE length(w) >= 6 GROUP BY w HAVING sum(k) >= 5),
x AS MATERIALIZED (SELECT w, n, w[:i] AS a, w[i + 2:] AS b FROM (SELECT w, n, unnest(range(length(w))) AS i FROM v)),
p AS (SELECT p.w, q.w AS o, q.n AS m FROM x p JOIN x q ON p.a = q.a AND p.b = q.b AND p.w <> q.w
      UNION SELECT x.w, v.w, v.n FROM x JOIN v ON v.w = a || b UNION SELECT v.w, x.w, x.n FROM x JOIN v ON v.w = a || b),
best AS (SELECT w, count(*) AS n_near, arg_min(o, struct_pack(a := -m, b := o)) AS o, max(m) AS m FROM p GROUP BY w),
f AS MATERIALIZED (SELECT v.w AS word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN o END AS form,
      CASE WHEN m >= 5 * v.n THEN m END AS form_n FROM v LEFT JOIN best USING (w)),
walk(word, aim, step) AS (SELECT word, form, 1 FROM f WHERE form IS NOT NULL
      UNION ALL SELECT walk.word, f.form, step + 1 FROM walk JOIN f ON f.word = walk.aim WHERE f.form IS NOT NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n
FROM f LEFT JOIN (SELECT word, arg_max(aim, step) AS root FROM walk GROUP BY word) USING (word)
"""

#: state after keeping a row, by initial; costs, edits and lines of the four states are one list, advanced row by row
_MOVE = """list_transform([0, 1, 2, 3], lambda r: list_min(
  [{'c': s[r + 1].c + 4, 'a': s[r + 1].a || 'D', 'l': s[r + 1].l}]
  || list_transform(list_filter(CASE WHEN x.f IN ('', 't') THEN [{'q': 0, 'i': 's', 'r': 1}, {'q': 0, 'i': 'u', 'r': 2}, {'q': 1, 'i': 'u', 'r': 2},
        {'q': 2, 'i': 'a', 'r': 3}, {'q': 3, 'i': 'u', 'r': 2}] ELSE [] END, lambda m: m.r = r AND m.i = x.role[1]),
     lambda m: {'c': s[m.q + 1].c + CASE WHEN x.f = 't' THEN 3 ELSE 0 END, 'a': s[m.q + 1].a || 'K', 'l': s[m.q + 1].l || chr(10) || x.role || ':' || x.text})
  || list_transform(list_filter(CASE WHEN x.f IN ('', 't') THEN [{'q': 0, 'r': 2}, {'q': 1, 'r': 2}, {'q': 2, 'r': 3}, {'q': 3, 'r': 2}] ELSE [] END, lambda m: m.r = r),
     lambda m: {'c': s[m.q + 1].c + CASE WHEN x.f = 't' THEN 6 ELSE 3 END, 'a': s[m.q + 1].a || 'R',
                'l': s[m.q + 1].l || chr(10) || CASE WHEN r = 2 THEN 'user:' ELSE 'assistant:' END || x.text})))"""


def _fill(s: str) -> str:
    """States ``s`` after any number of inserted turns."""
    put = lambda q, role: f"{{'c': {q}.c + 3, 'a': {q}.a || 'I', 'l': {q}.l || chr(10) || '{role}:'}}"
    u = f"list_min([{s}[3], {put(s + '[1]', 'user')}, {put(s + '[2]', 'user')}, {put(s + '[4]', 'user')}])"
    a = f"list_min([{s}[4], {put('z[1]', 'assistant')}])"
    v = f"list_min([z[1], {put(s + '[4]', 'user')}])"
    return f"list_transform([[{u}]], lambda z: [{s}[1], {s}[2], {v}, {a}])[1]"


REPAIR = f"""
WITH {CRC},
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations, tbl),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM o WHERE k <> 0),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM d),
g AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again,
        role[1] || lead(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM e),
f AS (SELECT *, CASE WHEN body = '' THEN 'b' WHEN again > 1 THEN 'd' WHEN body[-1] NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f FROM g),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate,
        count(*) FILTER (f = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
        list(struct_pack(f := f, role := role, text := text) ORDER BY i) AS rows FROM f GROUP BY conv_id),
s AS (SELECT conv_id, gaps, blank, duplicate, truncated, illegal, list_reduce([{{'s': [{{'c': 0::BIGINT, 'a': '', 'l': ''}}, {{'c': 1000000000::BIGINT, 'a': '', 'l': ''}},
          {{'c': 1000000000::BIGINT, 'a': '', 'l': ''}}, {{'c': 1000000000::BIGINT, 'a': '', 'l': ''}}], 'x': {{'f': '', 'role': '', 'text': ''}}}}]
          || list_transform(rows, lambda x: {{'s': NULL, 'x': x}}),
        lambda y, n: {{'s': list_transform([{_fill("y.s")}], lambda s: list_transform([n.x], lambda x: {_MOVE})[1])[1], 'x': n.x}}).s AS last FROM c),
z AS (SELECT *, list_transform([{_fill("last")}], lambda t: list_min([t[1], t[4]]))[1] AS b FROM s)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit,
  sha256(coalesce(b.l[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN z ON a.conv_id IS NOT DISTINCT FROM z.conv_id
"""

ORACLES: dict[str, str] = {"op11_conversation_repair": REPAIR, "op12_spelling_variants": SPELLING, "op13_ngram_join": JOIN, "op2_quality_rules": QUALITY, "op4_minhash_near_dedup": NEAR, "op6_sharding": SHARDS, "op9_line_dedup": LINES}
