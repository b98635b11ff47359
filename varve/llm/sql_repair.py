"""DuckDB SQL of conversation repair: a list of the four states' cheapest (cost, audit) goes through each conversation's rows."""

from __future__ import annotations

from .repair import _AFTER, DELETE, INSERT, KEEP, NEEDS, REROLE, START, TRUNCATED, DONE

_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _more(state: int, price: str, letters: str) -> str:
    at = f"acc[{state + 1}]"
    return f"lpad((substr({at}, 1, 9)::INT + {price})::VARCHAR, 9, '0') || substr({at}, 10) || '{letters}'"


def _inserted(state: int):
    for k in range(3):
        yield k, state
        state = NEEDS[state][1]


def _layer(to: int) -> str:
    """The cheapest way to state ``to`` over one row x = [speaker, fault]."""
    late = f"CASE x[2] WHEN 't' THEN {TRUNCATED} ELSE 0 END"
    ways = []
    for state in range(4):
        for k, at in _inserted(state):
            if at == to:
                ways.append(_more(state, str(k * INSERT + DELETE), "I" * k + "D"))
            if NEEDS[at][1] == to:
                ways.append(f"CASE WHEN x[2] NOT IN ('b', 'd') THEN {_more(state, f'{k * INSERT + REROLE} + {late}', 'I' * k + 'R')} END")
            for (before, speaker), after in _AFTER.items():
                if before == at and after == to:
                    ways.append(f"CASE WHEN x[2] NOT IN ('b', 'd') AND x[1] = '{speaker}' THEN {_more(state, f'{k * INSERT + KEEP} + {late}', 'I' * k + 'K')} END")
    return f"list_min([{', '.join(ways)}])"


_ENDS = ", ".join(_more(state, str(k * INSERT), "I" * k) for state in range(4) for k, at in _inserted(state) if at in (START, DONE))

OP13 = f"""
WITH crc_table AS (
    SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))
), raw AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), hashed AS (
    SELECT *, xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: ord(k[i])::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS h FROM raw, crc_table
), damaged AS (
    SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(CASE h WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM hashed
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, rtrim(text, {_SPACES}) AS r,
        CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS speaker FROM damaged
), judged AS (
    SELECT *, CASE WHEN r = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(r, 1) IN ('.', '!', '?') THEN 'n' ELSE 't' END AS fault,
        lag(speaker) OVER (PARTITION BY conv_id ORDER BY i) || speaker AS pair FROM numbered
), talks AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
        count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
        list_reduce(list([speaker, fault, NULL, NULL]::VARCHAR[] ORDER BY i), lambda acc, x: [{", ".join(map(_layer, range(4)))}], ['000000000', NULL, NULL, NULL]::VARCHAR[]) AS acc
    FROM judged GROUP BY conv_id
), solved AS (
    SELECT *, substr(e, 1, 9)::BIGINT AS cost, substr(e, 10) AS audit FROM (SELECT *, list_min([{_ENDS}]) AS e FROM talks)
), letters AS (
    SELECT conv_id, j, audit[j] AS letter, length(replace(left(audit, j), 'I', '')) AS i FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM solved)
), placed AS (
    SELECT l.conv_id, l.j, l.letter, CASE l.letter WHEN 'I' THEN '' ELSE d.text END AS text, d.role, row_number() OVER w AS m, first_value(l.letter = 'K' AND d.speaker = 's') OVER w AS system_first
    FROM letters l LEFT JOIN judged d ON d.conv_id IS NOT DISTINCT FROM l.conv_id AND d.i = l.i WHERE l.letter <> 'D' WINDOW w AS (PARTITION BY l.conv_id ORDER BY l.j)
), texts AS (
    SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (m % 2 = 1) = system_first THEN 'assistant' ELSE 'user' END || ':' || text, chr(10) ORDER BY j) AS t FROM placed GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
    coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN texts x ON x.conv_id IS NOT DISTINCT FROM c.conv_id
"""
