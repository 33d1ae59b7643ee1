"""DuckDB SQL for the registered queries, written from their contracts."""

from __future__ import annotations

from inkwell.llm import quality, secrets, sharding, spans
from inkwell.llm.queries import FORGED, URL_RULES

WORD = r"[^\x20\x09-\x0D]+"


def _unit(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 13))::BIGINT"


OP2 = f"""
WITH RECURSIVE poly(i, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM poly WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM poly WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
scored AS (SELECT doc_id, s, {_unit("doc_id::VARCHAR", "s::VARCHAR")} AS u FROM d, range(25) r(s)),
best AS (SELECT doc_id, arg_min(s, (-u, s)) FILTER (s < 24) AS shard, arg_min(s, (-u, s)) AS grown FROM scored GROUP BY doc_id),
hexed AS (SELECT doc_id, t, hex(encode(t)) AS h FROM d),
blocks AS (SELECT least({sharding.MOST_BLOCKS}, greatest(1, ceil(count(*) / (24 * {sharding.BLOCK_ROWS}))))::BIGINT AS blocks FROM d),
summed AS (
  SELECT doc_id, length(h) // 2 + 8 AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
      lambda a, b: xor(a >> 8, tab[xor(a & 255, b) + 1])), 4294967295) AS crc
  FROM hexed, tab)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY {_unit("doc_id::VARCHAR", "'block'", "crc::VARCHAR")} % blocks, doc_id) - 1)::BIGINT AS slot, grown::INTEGER AS grown_shard
FROM summed JOIN best USING (doc_id), blocks
"""

_ESC = lambda c: rf"replace(replace({c}, '\', '\\'), '<|', '<\|')"
OP3 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '{FORGED}' FROM range(2) r(i))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>' || {_ESC("role")} || '<|im_sep|>' || {_ESC("text")} || '<|im_end|>' || chr(10)))::BIGINT AS formatted_chars,
  0::BIGINT AS n_attachments, 0::BIGINT AS attachment_tokens
FROM t GROUP BY conv_id
"""

_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
OP4 = rf"""
WITH r(verdict, h, p) AS (VALUES {_RULES}),
a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (
  SELECT page_id, translate(regexp_extract(rest, '\A([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '\A[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '\A[^?#]*\?([^#]*)', 1) AS query FROM a),
c AS (
  SELECT *, array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '\A(?:utm_[a-z]+|ref)='))), '&') AS q FROM b),
d AS (
  SELECT page_id, host, path, CASE WHEN host = '' THEN '' ELSE regexp_replace(host, '\A(?:www|m)\.', '') || regexp_replace(path, '/+\z', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS key FROM c),
l AS (SELECT key FROM d WHERE key <> '' GROUP BY key HAVING count(*) > 1),
m AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(r.verdict, length(h || p)) AS verdict
  FROM d JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT d.page_id, host, path, m.rule, coalesce(m.verdict, CASE WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM d LEFT JOIN l USING (key) LEFT JOIN m USING (page_id)
"""

_BUCKET = lambda v: f"(({v}) >> greatest(length(bin({v})) - 5, 0)::BIGINT) << greatest(length(bin({v})) - 5, 0)::BIGINT"


def _cutoff(i: int, r: quality.Rule) -> str:
    at = lambda p: f"min(b) FILTER (metric = {i} AND upto * 100 >= t * {p})"
    beyond = lambda p, name: f"greatest({at(p)} * {r.times + 1} - {at(50)} * {r.times}, 0) AS {name}{i}"
    return beyond(r.high, "h") + (f", {beyond(r.low, 'l')}" if r.low is not None else "")


_CUTOFFS = [f"{name}{i}" for i, r in enumerate(quality.RULES, 1) for name in ("h", "l") if name == "h" or r.low is not None]


def _averaged(c: str) -> str:
    return f"(f.n * f.{c} + {quality.PRIOR} * ((c.n * c.{c} + {quality.PRIOR} * w.{c}) // (c.n + {quality.PRIOR}))) // (f.n + {quality.PRIOR}) AS {c}"


OP5 = rf"""
WITH a AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
b AS (SELECT *, regexp_extract_all(t, '{WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ln FROM a),
g AS (SELECT doc_id, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS gram FROM (SELECT doc_id, w, unnest(range(len(w) - 2)) AS i FROM b WHERE len(w) > 2)),
s AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM s, range(3) r(k) GROUP BY doc_id),
c AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ln) AS n_lines FROM b LEFT JOIN rep USING (doc_id)),
d AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    coalesce(word_chars * 1000 // nullif(n_words, 0), 0) AS v1, coalesce(n_symbols * 1000 // nullif(word_chars, 0), 0) AS v2,
    coalesce(n_dup_lines * 1000 // nullif(n_lines, 0), 0) AS v3, coalesce(n_repeat_words * 1000 // nullif(n_words, 0), 0) AS v4 FROM c),
e AS (SELECT *, {_BUCKET("v1")} AS b1, {_BUCKET("v2")} AS b2, {_BUCKET("v3")} AS b3, {_BUCKET("v4")} AS b4 FROM d),
m AS (
  SELECT g, lang, source, metric, b, count(*) AS n
  FROM (SELECT g, CASE WHEN g < 3 THEN lang END AS lang, CASE WHEN g < 2 THEN source END AS source, unnest([1, 2, 3, 4]) AS metric, unnest([b1, b2, b3, b4]) AS b FROM e, range(1, 4) r(g) WHERE NOT base_failed) GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY g, lang, source, metric ORDER BY b) AS upto, sum(n) OVER (PARTITION BY g, lang, source, metric) AS t FROM m),
o AS (SELECT g, lang, source, max(t)::BIGINT AS n, {", ".join(_cutoff(i, r) for i, r in enumerate(quality.RULES, 1))} FROM u GROUP BY g, lang, source),
q AS (
  SELECT f.lang, f.source, {", ".join(_averaged(c) for c in _CUTOFFS)}
  FROM (SELECT * FROM o WHERE g = 1) f JOIN (SELECT * FROM o WHERE g = 2) c ON f.lang IS NOT DISTINCT FROM c.lang, (SELECT * FROM o WHERE g = 3) w)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce({" OR ".join(f"b{i} > h{i}" + (f" OR b{i} < l{i}" if r.low is not None else "") for i, r in enumerate(quality.RULES, 1))}, false) AS kept
FROM e LEFT JOIN q ON e.lang IS NOT DISTINCT FROM q.lang AND e.source IS NOT DISTINCT FROM q.source
"""


def _kind(rank: int, p: secrets.Pattern) -> str:
    rx = p.regex.replace("(?i:", "(?i:").replace("'", "''")
    return f"""
  SELECT doc_id, {rank} AS rank, '{p.kind}' AS kind, unnest(list_transform(range(1, len(whole) + 1), lambda i: {{
    'start': list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0),
    'n': length(whole[i]), 'part': length(part[i])}})) AS f, {p.least} AS least
  FROM (SELECT doc_id, string_split_regex(t, '{rx}') AS gap, regexp_extract_all(t, '{rx}') AS whole, regexp_extract_all(t, '{rx}', {p.group}) AS part FROM a)"""


OP9 = f"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_kind(i, p) for i, p in enumerate(secrets.BASE + secrets.MORE))}),
s AS (SELECT doc_id, rank, kind, f.start AS start, kind || ':' || f.start::BIGINT || ':' || (f.start + f.n)::BIGINT AS spelled FROM m WHERE f.part >= least),
g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(spelled, ',' ORDER BY start, rank) FILTER (rank < {len(secrets.BASE)}) AS base, string_agg(spelled, ',' ORDER BY start, rank) AS spans FROM s GROUP BY doc_id)
SELECT a.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM a LEFT JOIN g USING (doc_id)
"""


_TRIM = lambda c: f"trim({c}, chr(32) || chr(9) || chr(13) || chr(10))"
OP8 = rf"""
WITH l AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{spans.SENTENCE}') AS l FROM documents),
n AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS no FROM l),
w AS (SELECT doc_id, no, s, regexp_extract_all(s, '{spans.WORD}') AS w FROM n),
k AS (SELECT doc_id, no, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM w WHERE len(w) > {spans.LONG}),
c AS (
  SELECT *, sum(CASE WHEN (unicode(word) * 5 + length(word) * 11) % 16 < 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, no ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cuts FROM k),
p AS (
  SELECT doc_id, no, 0 AS sub, s AS part FROM w WHERE len(w) <= {spans.LONG}
  UNION ALL SELECT doc_id, no, coalesce(cuts, 0) AS sub, string_agg(word, '' ORDER BY k) AS part FROM c GROUP BY doc_id, no, coalesce(cuts, 0)),
s AS (SELECT doc_id, no, sub, {_TRIM("part")} AS s, row_number() OVER (PARTITION BY doc_id ORDER BY no, sub) - 1 AS i FROM p WHERE {_TRIM("part")} <> ''),
r AS (SELECT doc_id, i, [{', '.join(f'lead(s, {k}) OVER o' for k in range(spans.SIZE))}] AS run, lead(i, {spans.SIZE - 1}) OVER o AS last FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS k FROM r WHERE last IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + {spans.SIZE})) AS i FROM f WHERE k > 1),
t AS (
  SELECT p.doc_id, string_agg(part, '' ORDER BY p.no, p.sub) FILTER (g.i IS NULL) AS kept, count(s.i) AS n_sentences, count(g.i) AS n_removed
  FROM p LEFT JOIN s ON p.doc_id = s.doc_id AND p.no = s.no AND p.sub = s.sub LEFT JOIN g ON s.doc_id = g.doc_id AND s.i = g.i GROUP BY p.doc_id)
SELECT doc_id, coalesce(n_sentences, 0)::BIGINT AS n_sentences, coalesce(n_removed, 0)::BIGINT AS n_removed, length(coalesce(kept, ''))::BIGINT AS kept_chars, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN t USING (doc_id)
"""

OP10 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
h AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM h a JOIN h b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM o JOIN c cx ON cx.doc_id = x JOIN c cy ON cy.doc_id = y WHERE 100 * k >= 80 * (cx.n + cy.n - k)),
b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach(x, y) AS (SELECT x, y FROM b UNION SELECT reach.x, b.y FROM reach JOIN b ON reach.y = b.x)
SELECT doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id))::BIGINT AS component_id
FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS m FROM reach GROUP BY x) USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": OP2, "op3_chat": OP3, "op4_urls": OP4, "op5_quality": OP5, "op8_spans": OP8, "op9_secrets": OP9, "op10_jaccard": OP10}
