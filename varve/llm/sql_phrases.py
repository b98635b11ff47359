"""DuckDB SQL of phrase mining, by counting every n-gram: a part is as frequent as its phrase at least."""

from __future__ import annotations

OP12 = r"""
WITH p AS (
    SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS w
    FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), t AS (
    SELECT lang, id, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM p WHERE len(w) > 0
), s AS (
    SELECT lang, w1, lead(w1, 1) OVER x AS w2, lead(w1, 2) OVER x AS w3, lead(w1, 3) OVER x AS w4, lead(w1, 4) OVER x AS w5 FROM t WINDOW x AS (PARTITION BY id ORDER BY i)
), g AS (
    SELECT lang, 1 AS k, w1 AS phrase, count(*) AS f FROM s GROUP BY ALL HAVING count(*) >= 100
    UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM s WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
    UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM s WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
    UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM s WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
    UNION ALL SELECT lang, 5, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5, count(*) FROM s WHERE w5 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
), totals AS (SELECT lang, count(*) AS n FROM t GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1),
x AS (
    SELECT c.lang, c.phrase, c.a, j, array_to_string(w[:j], ' ') AS lp, array_to_string(w[j + 1:], ' ') AS rp FROM c, range(1, 5) r(j) WHERE j < c.k
), scored AS (
    SELECT x.lang, x.phrase, x.a, lg.f AS l, rg.f AS r, n, ((1000::HUGEINT * x.a * n) // (lg.f::HUGEINT * rg.f))::BIGINT AS score,
        row_number() OVER (PARTITION BY x.lang, x.phrase ORDER BY (1000::HUGEINT * x.a * n) // (lg.f::HUGEINT * rg.f), j) AS first
    FROM x JOIN g lg ON lg.lang = x.lang AND lg.phrase = x.lp JOIN g rg ON rg.lang = x.lang AND rg.phrase = x.rp JOIN totals ON totals.lang = x.lang
), around AS (
    SELECT c.lang, array_to_string(list_slice(w, i, i + s - 1), ' ') AS phrase, max(a) AS longer FROM c, range(2, 5) r(s), range(1, 5) q(i) WHERE s < c.k AND i + s - 1 <= c.k GROUP BY ALL
), kept AS (
    SELECT s.* FROM scored s LEFT JOIN around o ON o.lang = s.lang AND o.phrase = s.phrase WHERE first = 1 AND (longer IS NULL OR 100 * longer < 100 * a)
)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
"""
