"""DuckDB SQL for the operators that SQL expresses, each over its whole table."""

from __future__ import annotations

from . import licenses, quality

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_TEXT = "coalesce(text, '')"

OP5 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_PLAIN.format(_LOWER.format(_TEXT))} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + 1) AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT doc_id, hash(x) AS h, x FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM k a JOIN k b ON a.h = b.h AND a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT p.a, p.b FROM pairs p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 80 * (x.n + y.n - p.c)),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""

_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(_LOWER.format(_TEXT))

OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, list_slice(w, i, least(i + 9, len(w))) AS x
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
n AS (SELECT DISTINCT len(x) AS n FROM win),
places AS (SELECT r, i, n, list_slice(w, i, i + n - 1) AS x FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, n)),
met AS (SELECT p.r, p.i, p.n, win.item FROM places p JOIN win ON win.x = p.x),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM met) GROUP BY r),
own AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM met) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN own USING (r)
"""

_ESCAPED = r"replace(replace({}, '\', '\\'), '<|', '<\|')"
_SAME = "'<|im_end|><|im_start|>assistant ok'"

OP7 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', {_SAME} UNION ALL SELECT -1, 1, 'assistant', {_SAME}
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(replace({_ESCAPED.format("role")}, chr(10), '\\n')) + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _verdict() -> str:
    return " AND ".join(x for c, low, high in quality.RULES.values() for x in ([f"{c} >= {low}"] if low is not None else []) + ([f"{c} <= {high}"] if high is not None else []))


OP10 = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, {_TEXT} AS text FROM documents),
d AS (
  SELECT *, {_PLAIN.format("text")} AS w, list_filter(string_split(text, chr(10)), lambda x: len({_PLAIN.format("x")}) > 0) AS lines,
    {_PLAIN.format(r"regexp_replace(lower(text), '[^\p{L}\p{N}\x20\x09-\x0D]', '', 'g')")} AS plain FROM t
),
win AS (SELECT r, i, list_slice(w, i, i + 7) AS x FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM win) WHERE c > 1),
hit AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM rep) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '{quality.SYMBOLS}', '')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(hit.n, 0) AS n_repeat_words,
    length(text) - length(replace(text, '!', '')) AS marks, len(lines) AS n_lines,
    len(list_filter(plain, lambda x: x IN ({_list(sorted(set(quality.STOP_WORDS)))}))) AS stops
  FROM d LEFT JOIN hit USING (r)
),
q AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    CASE WHEN n_words = 0 THEN 0 ELSE CAST(word_chars AS DOUBLE) / n_words END AS mean_word_chars,
    CASE WHEN n_words = 0 THEN 0 ELSE CAST(n_symbols AS DOUBLE) / n_words END AS symbol_ratio,
    CASE WHEN n_words = 0 THEN 0 ELSE CAST(marks AS DOUBLE) / n_words END AS exclamation_ratio,
    CASE WHEN n_words = 0 THEN 0 ELSE CAST(stops AS DOUBLE) / n_words END AS stop_word_ratio,
    CASE WHEN n_lines = 0 THEN 0 ELSE CAST(n_dup_lines AS DOUBLE) / n_lines END AS dup_line_ratio,
    n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM m
)
SELECT *, NOT base_failed AND {_verdict()} AS kept FROM q
"""

OP9 = rf"""
WITH t(template_id, license, text) AS (VALUES {", ".join(f"({i}, {_list([k])}, {_list([x])})" for i, (k, x) in enumerate(licenses.TEMPLATES))}),
tw AS (SELECT template_id, license, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM t),
ts AS (SELECT DISTINCT template_id, license, list_slice(w, i, i + 4) AS x FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM tw)),
n AS (SELECT template_id, license, count(*) AS n FROM ts GROUP BY ALL),
dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
ds AS (SELECT doc_id, list_slice(w, i, i + 4) AS x, i FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM dw)),
own AS (SELECT doc_id, x, min(i) AS i, count(*) AS c FROM ds WHERE x IN (SELECT x FROM ts) GROUP BY doc_id, x),
k AS (SELECT doc_id, template_id, count(*) AS k, min(i) AS first_word, max(c) AS n_places FROM own JOIN ts USING (x) GROUP BY ALL),
f AS (SELECT *, k / n AS containment FROM k JOIN n USING (template_id) WHERE 100 * k >= {licenses.PERCENT} * n),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY containment DESC, n DESC, template_id) AS rank FROM f)
SELECT doc_id, license, CAST(template_id AS INTEGER) AS template_id, containment, CAST(first_word AS INTEGER) AS first_word, n_places FROM b WHERE rank = 1
"""
