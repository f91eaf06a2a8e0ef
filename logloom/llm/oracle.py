"""DuckDB SQL of the queries that SQL can express, written from the query's definition."""

from __future__ import annotations

from logloom.llm import quality_rules as rules

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"

OP1 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), f AS (
  SELECT *,
    CASE WHEN role = 'system' THEN k = 1
         WHEN role = 'user' THEN k = 1 OR before IN ('system', 'assistant')
         WHEN role = 'assistant' THEN before = 'user' ELSE false END AS ok,
    length(text) + (length(text) - length(replace(text, '\', '')))
      + len(regexp_extract_all(text, '(<s>|</s>|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|\[ANSWER\]|\[TURN\]|\[/TURN\])')) AS body,
    CASE role WHEN 'system' THEN 7 + 8 + 2 WHEN 'user' THEN 6 + 7 + 2 WHEN 'assistant' THEN 8 + 4 + 2 END AS marks
  FROM o
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(body + marks))::BIGINT AS formatted_chars,
  bool_and(ok) AS valid,
  CASE WHEN NOT bool_and(ok) THEN 'invalid'
       ELSE CASE last(role ORDER BY k) WHEN 'system' THEN 'instructed' WHEN 'user' THEN 'asked' ELSE 'answered' END END AS final_state
FROM f GROUP BY conv_id
"""

_JUDGED = list(rules.JUDGED.items())
_PARTS = {"symbol_rate": ("n_symbols", "word_chars"), "repeat_rate": ("n_repeat_words", "n_words"), "dup_line_rate": ("n_dup_lines", "n_lines"), "upper_rate": ("n_upper", "word_chars"), "word_rate": ("word_chars", "n_words")}


def _quality_rules() -> str:
    rates = ", ".join(f"10000 * {a} // greatest({b}, 1) AS {k}" for k, (a, b) in _PARTS.items())
    pairs = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS stat, {k} AS v FROM r WHERE NOT base_failed" for k, _ in _JUDGED)
    widths = " ".join(f"WHEN '{k}' THEN {v}" for k, v in _JUDGED)

    def percentiles(name: str, keys: str) -> str:
        over = f"PARTITION BY {keys}stat"
        return f"""{name}_c AS (SELECT {keys}stat, bucket, count(*) AS n FROM b GROUP BY ALL),
{name}_s AS (SELECT *, sum(n) OVER ({over} ORDER BY bucket) AS seen, sum(n) OVER ({over}) AS total FROM {name}_c),
{name} AS (SELECT {keys}stat, max(total) AS total, min(bucket) FILTER (seen >= ceil(total * 10 / 100)) AS p10,
  min(bucket) FILTER (seen >= ceil(total * 50 / 100)) AS p50, min(bucket) FILTER (seen >= ceil(total * 90 / 100)) AS p90 FROM {name}_s GROUP BY ALL)"""

    picked = ", ".join(f"CASE WHEN g.total >= {rules.MIN_ROWS} THEN g.{p} WHEN l.total >= {rules.MIN_ROWS} THEN l.{p} ELSE a.{p} END AS {p}" for p in ("p10", "p50", "p90"))
    broken = " ".join(f"WHEN {k} < {k}_lo OR {k} > {k}_hi THEN '{k}'" for k, _ in _JUDGED)
    wide = ", ".join(f"max(low) FILTER (stat = '{k}') AS {k}_lo, max(high) FILTER (stat = '{k}') AS {k}_hi" for k, _ in _JUDGED)
    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, source, t, regexp_extract_all(t, '{_WORD}') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
s AS (SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{_SPACE}+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^{rules.SYMBOLS}]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  len(ls)::BIGINT AS n_lines, length(regexp_replace(t, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper, coalesce(cover.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cover ON cover.doc_id = w.doc_id),
r AS (SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed, {rates} FROM s),
v AS ({pairs}),
b AS (SELECT lang, source, stat, (v >> greatest(length(bin(v)) - {rules.SKETCH_BITS}, 0)::INTEGER) << greatest(length(bin(v)) - {rules.SKETCH_BITS}, 0)::INTEGER AS bucket FROM v),
{percentiles("g", "lang, source, ")},
{percentiles("l", "lang, ")},
{percentiles("a", "")},
q AS (SELECT g.lang, g.source, g.stat, {picked}
  FROM g JOIN l ON l.lang IS NOT DISTINCT FROM g.lang AND l.stat = g.stat JOIN a ON a.stat = g.stat),
f AS (SELECT lang, source, stat, p10 - greatest({rules.FENCE} * (p50 - p10), CASE stat {widths} END) AS low,
  p90 + greatest({rules.FENCE} * (p90 - p50), CASE stat {widths} END) AS high FROM q),
x AS (SELECT lang, source, {wide} FROM f GROUP BY ALL),
j AS (SELECT r.*, CASE WHEN base_failed THEN 'base' {broken} END AS failed_rule
  FROM r LEFT JOIN x ON x.lang IS NOT DISTINCT FROM r.lang AND x.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_rule IS NULL AS kept, failed_rule FROM j
"""


OP11 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest,
  max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM s
"""

OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS size, sum(lang_n) AS lang_total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
a AS (  -- every group and kept term of its language
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + v.size) AS p,
    1 + 1000000000::HUGEINT * (k.lang_n + 1) // (v.lang_total + v.size) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), f AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
  FROM a x JOIN a y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
u AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM a WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
WHERE part = 'pair' OR rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1, "op6_quality_rules": _quality_rules(), "op11_warc_archive": OP11, "op12_source_divergence": OP12}
