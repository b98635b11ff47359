"""Queries for resampled rankings, fixed effects of two factors, specification lists and expansion tables over the proxy panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from varve.operators import effects, expansion, ordered, specs
from varve.sources import files

from .panel_queries import query, r6

#: One row an entity: its market, mean log revenue and mean log productivity.
UNITS = "u AS (SELECT entity, market, avg(ln(rev)) AS o, avg(ln(rev/mate)) AS x FROM panel WHERE rev > 0 AND mate > 0 GROUP BY 1, 2)"


def units(p):
    good = p.where("rev > 0 and mate > 0")
    return good.groupBy("entity", "market").agg(F.avg(F.ln("rev")).alias("o"), F.avg(F.ln(F.col("rev") / F.col("mate"))).alias("x"))


RANKED = UNITS + f""", h AS (SELECT *, md5(entity::VARCHAR || ':1') AS h FROM u),
s AS (SELECT market, entity, o, x, ('0x' || substr(h, 1, 8))::BIGINT % {ordered.PRIME} AS s0, ('0x' || substr(h, 9, 8))::BIGINT % {ordered.PRIME} AS s1, ('0x' || substr(h, 17, 8))::BIGINT % {ordered.PRIME} AS s2 FROM h),
w AS (SELECT s.*, r AS replicate, ((s0 + s1 * r % {ordered.PRIME} + s2 * r % {ordered.PRIME} * r % {ordered.PRIME}) % {ordered.PRIME})::DOUBLE / {ordered.PRIME} AS v FROM s, range(1, 201) q(r)),
c AS (SELECT *, ({" + ".join(f"(v >= {p})::INT" for p in ordered.POISSON)})::DOUBLE AS c FROM w),
k AS (SELECT *, (sum(c) OVER (PARTITION BY replicate, market ORDER BY o, entity ROWS UNBOUNDED PRECEDING) - c + (c + 1) / 2) / nullif(sum(c) OVER m, 0) AS place, x - sum(c * x) OVER m / nullif(sum(c) OVER m, 0) AS dev FROM c WINDOW m AS (PARTITION BY replicate, market)),
g AS (SELECT replicate::INTEGER AS replicate, sum(c * dev) FILTER (place > 0.75) / sum(c) FILTER (place > 0.75) - sum(c * dev) FILTER (place <= 0.5) / sum(c) FILTER (place <= 0.5) AS gap FROM k GROUP BY 1)
"""


def gaps(p):
    return ordered.rank_bootstrap(units(p), "market", "entity", "o", "x", 200, 0.75, 0.5)


@query("smp2_rank_bootstrap", RANKED + "SELECT replicate, round(gap, 6) AS gap FROM g")
def _(p):
    return r6(gaps(p))


@query("smp2_rank_errors", RANKED + "SELECT count(*) AS replicates, round(avg(gap), 6) AS mean, round(stddev_samp(gap), 6) AS se, round(quantile_cont(gap, 0.025), 6) AS low, round(quantile_cont(gap, 0.975), 6) AS high FROM g")
def _(p):
    q = lambda s: F.percentile("gap", F.lit(s))  # noqa: E731  (a row a replicate)
    return r6(gaps(p).agg(F.count("*").alias("replicates"), F.avg("gap").alias("mean"), F.stddev("gap").alias("se"), q(0.025).alias("low"), q(0.975).alias("high")))


def rounds(rows: str, a: str, b: str, columns: str, steps: int = 120) -> str:
    """SQL of alternating demeaning: table d of the rows after so many steps, by either factor in turn."""
    less = lambda f: ", ".join(f"{c} - avg({c}) OVER (PARTITION BY {f}) AS {c}" for c in columns)
    both = ", ".join(f"CASE WHEN step % 2 = 0 THEN {c} - avg({c}) OVER (PARTITION BY {a}) ELSE {c} - avg({c}) OVER (PARTITION BY {b}) END" for c in columns)
    return f"d0 AS (SELECT id, {a}, {b}, {less(a)} FROM {rows}), rec AS (SELECT * FROM (WITH RECURSIVE t AS (SELECT 1 AS step, * FROM d0 UNION ALL SELECT step + 1, id, {a}, {b}, {both} FROM t WHERE step < {steps}) SELECT * FROM t)), d AS (SELECT * FROM rec WHERE step = {steps})"


TWO = "v AS (SELECT entity * 10000 + year AS id, entity, market, year, ln(rev) AS y, ln(cap) AS x, ln(staf) AS z FROM panel WHERE rev > 0 AND cap > 0 AND staf > 0 AND (entity + year) % 7 <> 0)"


def two(p):
    """Unbalanced on purpose: rows of some entities and years are out."""
    good = p.where("rev > 0 and cap > 0 and staf > 0 and (entity + year) % 7 <> 0")
    return good.select("entity", "market", "year", F.ln("rev").alias("y"), F.ln("cap").alias("x"), F.ln("staf").alias("z"))


@query("est2_two_way_effects", TWO + ", " + rounds("v", "market", "year", "xy", 60) + """,
b AS (SELECT count(*) AS n, sum(x*y)/sum(x*x) AS b, sum(x*x) AS xx, sum(y*y) AS yy FROM d), k AS (SELECT count(DISTINCT market) + count(DISTINCT year) AS levels, count(DISTINCT market) + count(DISTINCT year) - 1 + 1 AS k, var_pop(y)*count(*) AS total FROM v),
e AS (SELECT any_value(b) AS coef, any_value(n) AS n, sqrt(sum((y-b*x)*(y-b*x)*x*x)*any_value(n)/(any_value(n)-any_value(k)))/any_value(xx) AS se, 1-sum((y-b*x)*(y-b*x))/any_value(total) AS r2, 1-sum((y-b*x)*(y-b*x))/any_value(yy) AS within_r2, any_value(levels) AS levels FROM d, b, k)
SELECT 'x' AS term, round(coef, 6) AS coef, round(se, 6) AS se, n, round(r2, 6) AS r2, round(within_r2, 6) AS within_r2, levels, 1::BIGINT AS components FROM e""")
def _(p):
    return r6(effects.two_way(two(p), "y", ["x"], "market", "year").drop("t", "steps"))


@query("est2_entity_year_clustered", TWO + ", " + rounds("v", "entity", "year", "xzy", 80) + """,
s AS (SELECT count(*) AS n, sum(x*x) AS xx, sum(x*z) AS xz, sum(z*z) AS zz, sum(x*y) AS xy, sum(z*y) AS zy FROM d), b AS (SELECT *, xx*zz-xz*xz AS det, (xy*zz-zy*xz)/(xx*zz-xz*xz) AS bx, (zy*xx-xy*xz)/(xx*zz-xz*xz) AS bz FROM s),
c AS (SELECT entity, sum(x*(y-bx*x-bz*z)) AS sx, sum(z*(y-bx*x-bz*z)) AS sz FROM d, b GROUP BY 1), m AS (SELECT count(*) AS g, sum(sx*sx) AS xx, sum(sx*sz) AS xz, sum(sz*sz) AS zz FROM c),
k AS (SELECT count(DISTINCT entity) + count(DISTINCT year) AS levels FROM v), f AS (SELECT m.g/(m.g-1)*(b.n-1.0)/(b.n-(2+k.levels-1)) AS f FROM m, b, k)
SELECT 'x' AS term, round(bx, 6) AS coef, round(sqrt(f*(b.zz*b.zz*m.xx-2*b.zz*b.xz*m.xz+b.xz*b.xz*m.zz))/det, 6) AS se, n FROM b, m, f
UNION ALL SELECT 'z', round(bz, 6), round(sqrt(f*(b.xz*b.xz*m.xx-2*b.xx*b.xz*m.xz+b.xx*b.xx*m.zz))/det, 6), n FROM b, m, f""")
def _(p):
    return r6(effects.two_way(two(p), "y", ["x", "z"], "entity", "year", cluster="entity").select("term", "coef", "se", "n"))


WINDOWS = {
    "ld 1995-1998": ([1995], [1998]), "ld 1994-1997": ([1994], [1997]), "ld_2yr_avg 1994-1998": ([1994, 1995], [1997, 1998]),
    **{f"stacked_{g}yr {y}": ([y], [y + g]) for g in (1, 2) for y in range(1993, 1998 - g + 1)},
}
_VALUES = ", ".join(f"('{n}', {a}, {b})" for n, (a, b) in WINDOWS.items())
MARKETS = "m AS (SELECT market, year, sum(mate)/sum(rev) AS y, sum((rev/t)*(rev/t)) AS x, any_value(t) AS sale, count(*) AS n FROM (SELECT *, sum(rev) OVER (PARTITION BY market, year) AS t FROM panel) GROUP BY 1, 2), low AS (SELECT market, min(n) >= 40 AND count(*) = 7 AS fine FROM m GROUP BY 1)"


@query("est10_specifications", MARKETS + f""", k AS (SELECT * FROM (VALUES {_VALUES}) t(win, a, b)),
d AS (SELECT k.win, e.market, e.y - s.y AS dy, e.x - s.x AS dx, s.w FROM k, LATERAL (SELECT market, avg(y) AS y, avg(x) AS x FROM m WHERE list_contains(k.b, year) GROUP BY 1 HAVING count(*) = len(k.b)) e, LATERAL (SELECT market, avg(y) AS y, avg(x) AS x, avg(sale) AS w FROM m WHERE list_contains(k.a, year) GROUP BY 1 HAVING count(*) = len(k.a)) s WHERE e.market = s.market),
f AS (SELECT CASE WHEN win LIKE 'stacked%' THEN left(win, 11) ELSE win END AS win, d.*EXCLUDE (win), fine FROM d JOIN low USING (market)),
r AS (SELECT win, market, sample, weight, absorb, dy, dx, CASE weight WHEN 'sales' THEN w ELSE 1 END AS w, CASE absorb WHEN 'market' THEN market ELSE '' END AS g FROM f, (VALUES ('all'), ('fine')) a(sample), (VALUES ('none'), ('sales')) b(weight), (VALUES ('none'), ('market')) c(absorb) WHERE (sample = 'all' OR fine) AND (absorb = 'none' OR win LIKE 'stacked%')),
c AS (SELECT *, dx - sum(w*dx) OVER g/sum(w) OVER g AS x, dy - sum(w*dy) OVER g/sum(w) OVER g AS y FROM r WINDOW g AS (PARTITION BY win, sample, weight, absorb, g)),
s AS (SELECT win, sample, weight, absorb, count(*) AS n, count(DISTINCT g) AS levels, sum(w*x*y)/sum(w*x*x) AS b, sum(w*x*x) AS xx FROM c GROUP BY ALL)
SELECT win AS spec, sample, weight, absorb, any_value(n) AS n, round(any_value(b), 6) AS coef, round(sqrt(sum(w*w*x*x*(y-b*x)*(y-b*x))*any_value(n)/(any_value(n)-any_value(levels)-1))/any_value(xx), 6) AS se, round(1-sum(w*(y-b*x)*(y-b*x))/sum(w*y*y), 6) AS within_r2
FROM c JOIN s USING (win, sample, weight, absorb) GROUP BY ALL HAVING any_value(n) > any_value(levels) + 1""")
def _(p):
    m = market_years(p)
    d = specs.differences(m, "market", "win", "year", {"y": "y", "x": "x"}, "sale", WINDOWS).dropna()
    fine = m.groupBy("market").agg(((F.min("n") >= 40) & (F.count("*") == 7)).alias("fine"))
    d = d.join(fine, "market").withColumn("win", F.when(F.col("win").startswith("stacked"), F.left("win", F.lit(11))).otherwise(F.col("win")))
    d = d.withColumn("sample", F.explode(F.when(F.col("fine"), F.array(F.lit("all"), F.lit("fine"))).otherwise(F.array(F.lit("all")))))
    got = specs.least_squares(d, ["win", "sample"], {"slope": ("d_y", ["d_x"])}, {"none": None, "sales": "w"}, {"none": None, "market": "market"})
    got = got.where("absorb = 'none' or win like 'stacked%'")
    return r6(got.select(F.col("win").alias("spec"), "sample", "weight", "absorb", "n", "coef", "se", "within_r2"))


def market_years(p):
    t = p.join(p.groupBy("market", "year").agg(F.sum("rev").alias("t")), ["market", "year"])
    s = F.col("rev") / F.col("t")
    return t.groupBy("market", "year").agg((F.sum("mate") / F.sum("rev")).alias("y"), F.sum(s * s).alias("x"), F.first("t").alias("sale"), F.count("*").alias("n"))


CHANNELS = """t AS (SELECT cell, year, 1/regr_slope(ln(rev), ln(cap)) AS a, sum(mate)/sum(rev) AS b FROM panel WHERE rev > 0 AND cap > 0 GROUP BY 1, 2),
h AS (SELECT cell, market, year, ln(sum(rev)) AS x, sum(mate)/sum(rev) AS y, sum(rev) AS w FROM panel GROUP BY 1, 2, 3),
hc AS (SELECT cell, year, ln(sum(rev)) AS x FROM panel GROUP BY 1, 2),
d AS (SELECT cell, q.x - p.x AS dx, 0.5*(s.b+e.b)*(e.a-s.a) AS theta_part, 0.5*(s.a+e.a)*(e.b-s.b) AS cost_share_part, e.a-s.a AS d_inv_theta, e.b-s.b AS d_cost_share FROM t s JOIN t e USING (cell) JOIN hc p USING (cell) JOIN hc q USING (cell) WHERE s.year = 1995 AND e.year = 1998 AND p.year = 1995 AND q.year = 1998),
parts AS (SELECT part, dx, CASE part WHEN 'theta_part' THEN theta_part WHEN 'cost_share_part' THEN cost_share_part WHEN 'd_inv_theta' THEN d_inv_theta WHEN 'd_cost_share' THEN d_cost_share ELSE theta_part + cost_share_part END AS dy FROM d, (VALUES ('total'), ('theta_part'), ('cost_share_part'), ('d_inv_theta'), ('d_cost_share')) v(part)),
f AS (SELECT s.cell, e.y - s.y AS dy, e.x - s.x AS dx, s.w FROM h s JOIN h e ON s.cell = e.cell AND s.market = e.market AND s.year = 1995 AND e.year = 1998),
z AS (SELECT 'cells' AS level, part, dx, dy, '' AS grp FROM parts UNION ALL SELECT 'markets', 'pooled', dx, dy, '' FROM f
    UNION ALL SELECT 'markets', 'within', dx, dy, cell FROM f UNION ALL SELECT 'markets', 'between', sum(w*dx)/sum(w), sum(w*dy)/sum(w), '' FROM f GROUP BY cell),
c AS (SELECT level, part, grp, dx - avg(dx) OVER g AS x, dy - avg(dy) OVER g AS y FROM z WINDOW g AS (PARTITION BY level, part, grp)),
s AS (SELECT level, part, count(*) AS n, count(DISTINCT grp) AS levels, sum(x*y)/sum(x*x) AS b, sum(x*x) AS xx FROM c GROUP BY 1, 2)
"""


@query("est11_channels", CHANNELS + """SELECT level, part, any_value(n) AS n, round(any_value(b), 6) AS coef, round(sqrt(sum(x*x*(y-b*x)*(y-b*x))*any_value(n)/(any_value(n)-any_value(levels)-1))/any_value(xx), 6) AS se FROM c JOIN s USING (level, part) GROUP BY 1, 2""")
def _(p):
    good = p.where("rev > 0 and cap > 0").groupBy("cell", "year").agg((1 / F.regr_slope(F.ln("rev"), F.ln("cap"))).alias("a"), (F.sum("mate") / F.sum("rev")).alias("b"))
    good = good.join(p.groupBy("cell", "year").agg(F.ln(F.sum("rev")).alias("x")), ["cell", "year"])
    ends = good.where("year in (1995, 1998)").groupBy("cell").agg(*(F.max(F.when(F.col("year") == y, F.col(c))).alias(f"{c}{k}") for c in "abx" for k, y in ((0, 1995), (1, 1998)))).dropna()
    d = ends.selectExpr("x1 - x0 as dx", "0.5D * (b0 + b1) * (a1 - a0) as theta_part", "0.5D * (a0 + a1) * (b1 - b0) as cost_share_part", "a1 - a0 as d_inv_theta", "b1 - b0 as d_cost_share").withColumn("total", F.col("theta_part") + F.col("cost_share_part"))
    parts = ("total", "theta_part", "cost_share_part", "d_inv_theta", "d_cost_share")
    top = specs.least_squares(d, [], {c: (c, ["dx"]) for c in parts}).withColumn("level", F.lit("cells"))
    h = p.groupBy("cell", "market", "year").agg(F.ln(F.sum("rev")).alias("x"), (F.sum("mate") / F.sum("rev")).alias("y"), F.sum("rev").alias("w"))
    f = specs.differences(h.withColumn("id", F.concat_ws("|", "cell", "market")), "id", "win", "year", {"y": "y", "x": "x"}, "w", {"ld": ([1995], [1998])}).dropna().withColumn("cell", F.substring_index("id", "|", 1))
    low = specs.least_squares(f, [], {"slope": ("d_y", ["d_x"])}, None, {"pooled": None, "within": "cell"}).withColumn("spec", F.col("absorb")).withColumn("level", F.lit("markets"))
    mean = lambda c: (F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c)
    mid = specs.least_squares(f.groupBy("cell").agg(mean("d_y"), mean("d_x")), [], {"between": ("d_y", ["d_x"])}).withColumn("level", F.lit("markets"))
    return r6(top.unionByName(low).unionByName(mid).select("level", F.col("spec").alias("part"), "n", "coef", "se"))


#: Each firm's market outcomes, a free planner's (markups removed, sales moved towards high ones) and one's held to the market's total cost.
FIRMS = """b AS (SELECT entity, year, market || '|' || year AS market_id, mate AS tc_mkt, rev AS sales_mkt, cap AS v, rev/sum(rev) OVER (PARTITION BY market, year) AS share_mkt FROM panel WHERE rev > 0 AND mate > 0 AND cap > 0),
mu AS (SELECT *, 1/(1 - (share_mkt/1.5 + (1-share_mkt)/6.0::DOUBLE)) AS mu_mkt FROM b), al AS (SELECT *, tc_mkt*mu_mkt/sales_mkt AS alpha, sales_mkt*sqrt(mu_mkt/avg(mu_mkt) OVER (PARTITION BY market_id)) AS sales_free FROM mu),
tp AS (SELECT *, alpha*sales_free AS tc_free, sales_free/sum(sales_free) OVER (PARTITION BY market_id) AS share_free FROM al), tt AS (SELECT sum(tc_mkt)/sum(tc_free) AS k FROM tp),
firms AS (SELECT tp.*, tc_free*k AS tc_fixed, sales_free*k AS sales_fixed, share_free AS share_fixed FROM tp, tt),
bins AS (SELECT *, CAST(ceil(5.0::DOUBLE*row_number() OVER (ORDER BY alpha, entity, year)/count(*) OVER ()) AS INT) AS q_a_pooled, CAST(ceil(5.0::DOUBLE*row_number() OVER (ORDER BY v, entity, year)/count(*) OVER ()) AS INT) AS q_v_pooled, CAST(ceil(5.0::DOUBLE*row_number() OVER (ORDER BY mu_mkt, entity, year)/count(*) OVER ()) AS INT) AS q_mu_pooled,
    row_number() OVER (PARTITION BY market_id ORDER BY alpha, entity, year)/(count(*) OVER m)::DOUBLE AS pct_a_within, row_number() OVER (PARTITION BY market_id ORDER BY v, entity, year)/(count(*) OVER m)::DOUBLE AS pct_v_within, row_number() OVER (PARTITION BY market_id ORDER BY mu_mkt, entity, year)/(count(*) OVER m)::DOUBLE AS pct_mu_within,
    CASE WHEN r = 1 THEN '1_leader' WHEN r = 2 THEN '2_second' WHEN r <= 5 THEN '3_third_fifth' ELSE '4_rest' END AS size_rank FROM (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY sales_mkt DESC, entity, year) AS r FROM firms) WINDOW m AS (PARTITION BY market_id)),
long AS (SELECT bins.*, CAST(ceil(5*pct_a_within) AS INT) AS q_a_within, CAST(ceil(5*pct_v_within) AS INT) AS q_v_within, CAST(ceil(5*pct_mu_within) AS INT) AS q_mu_within, planner, CASE planner WHEN 'free' THEN tc_free ELSE tc_fixed END AS tc_pl, CASE planner WHEN 'free' THEN sales_free ELSE sales_fixed END AS sales_pl, share_free AS share_pl FROM bins, (VALUES ('free'), ('fixed')) t(planner))
"""
TABLES = {(t, s): cs for s in ("pooled", "within") for t, cs in (("quintile_alpha", [f"q_a_{s}"]), ("quintile_v", [f"q_v_{s}"]), ("double_alpha_v", [f"q_a_{s}", f"q_v_{s}"]), ("double_mu_alpha", [f"q_mu_{s}", f"q_a_{s}"]))} | {("size_rank", "within"): ["size_rank"]}
PLANNERS = {n: (f"tc_{n}", f"sales_{n}", f"share_{n}") for n in ("free", "fixed")}


def firms(p):
    b = p.where("rev > 0 and mate > 0 and cap > 0").select("entity", "year", F.concat_ws("|", "market", "year").alias("market_id"), F.col("mate").alias("tc_mkt"), F.col("rev").alias("sales_mkt"), F.col("cap").alias("v"))
    b = files.kept(b, "firms")  # from here on rows are read, and meet their market's sums, where they are
    of = lambda *sums: files.small(b.groupBy("market_id").agg(*sums), "markets")[0]
    b = b.join(of(F.sum("sales_mkt").alias("_s")), "market_id").withColumn("share_mkt", F.col("sales_mkt") / F.col("_s")).drop("_s")
    b = b.withColumn("mu_mkt", 1 / (1 - (F.col("share_mkt") / 1.5 + (1 - F.col("share_mkt")) / 6.0)))
    b = b.join(of(F.avg("mu_mkt").alias("_m")), "market_id")
    b = b.withColumns({"alpha": F.col("tc_mkt") * F.col("mu_mkt") / F.col("sales_mkt"), "sales_free": F.col("sales_mkt") * F.sqrt(F.col("mu_mkt") / F.col("_m"))}).withColumn("tc_free", F.col("alpha") * F.col("sales_free")).drop("_m")
    b = b.join(of(F.sum("sales_free").alias("_s")), "market_id").withColumn("share_free", F.col("sales_free") / F.col("_s")).drop("_s")
    k = files.small(b.agg((F.sum("tc_mkt") / F.sum("tc_free")).alias("_k")), "scale")[0]  # one row
    return b.join(k).withColumns({"tc_fixed": F.col("tc_free") * F.col("_k"), "sales_fixed": F.col("sales_free") * F.col("_k"), "share_fixed": F.col("share_free")}).drop("_k")


def planned(p):
    return expansion.plans(expansion.binned(firms(p), "market_id", ["entity", "year"], {"a": "alpha", "v": "v", "mu": "mu_mkt"}, "sales_mkt", places=["a", "v"]), PLANNERS)


_ALL = list(dict.fromkeys(c for cs in TABLES.values() for c in cs))
_LABEL = " ".join(f"WHEN {sum(1 << (len(_ALL) - 1 - i) for i, b in enumerate(_ALL) if b not in cs)} THEN " + "{" + f"'t': '{t}', 's': '{s}', 'v1': '{cs[0]}', 'b1': {cs[0]}::VARCHAR, 'v2': '{cs[1] if len(cs) > 1 else ''}', 'b2': " + (f"{cs[1]}::VARCHAR" if len(cs) > 1 else "''") + "}" for (t, s), cs in TABLES.items())


@query("sim29_cell_tables", FIRMS + f""", tot AS (SELECT planner, count(*) AS n, sum(tc_mkt) AS a, sum(tc_pl) AS b FROM long GROUP BY 1),
c AS (SELECT planner, CASE grouping_id({", ".join(_ALL)}) {_LABEL} END AS k, count(*) AS n_firms, avg(alpha) AS mean_alpha, avg(ln(v)) AS mean_log_v, avg(pct_a_within) AS mean_pct_alpha_within, avg(pct_v_within) AS mean_pct_v_within, avg(share_mkt) AS mean_share_mkt, avg(share_pl) AS mean_share_pl, sum(tc_mkt) AS tm, sum(tc_pl) AS tp, sum(sales_mkt) AS sm, sum(sales_pl) AS sp, sum(tc_mkt*mu_mkt) AS mu, sum(tc_mkt*ln(mu_mkt)) AS lmu, sum(tc_mkt*ln(tc_pl/tc_mkt)) AS lr
    FROM long GROUP BY GROUPING SETS ({", ".join("(planner, " + ", ".join(cs) + ")" for cs in TABLES.values())}))
SELECT k.t AS "table", k.s AS scheme, planner, k.v1 AS var1, k.b1 AS bin1, k.v2 AS var2, k.b2 AS bin2, n_firms, round(mean_alpha, 6) AS mean_alpha, round(mean_log_v, 6) AS mean_log_v, round(mean_pct_alpha_within, 6) AS mean_pct_alpha_within, round(mean_pct_v_within, 6) AS mean_pct_v_within, round(mean_share_mkt, 6) AS mean_share_mkt, round(mean_share_pl, 6) AS mean_share_pl,
    round(n_firms/n, 6) AS firm_share, round(mu/tm, 6) AS mu_cw_mkt, round(tm/a, 6) AS share_tc_mkt, round(tp/b, 6) AS share_tc_pl, round(tp/tm, 6) AS tc_ratio, CASE WHEN planner = 'free' THEN round((tp-tm)/(b-a), 5) END AS gain_share, round(sp/sm, 6) AS sales_ratio, round(lmu/tm, 6) AS wmean_log_mu_mkt, round(lr/tm, 6) AS wmean_log_tc_ratio FROM c JOIN tot USING (planner)""")
def _(p):
    got = expansion.cell_tables(planned(p), TABLES).drop("tc_mkt", "tc_pl", "sales_mkt", "sales_pl")
    return r6(got.withColumn("gain_share", F.round("gain_share", 5)))


@query("sim29_support", FIRMS + """, m AS (SELECT max(alpha) AS top FROM long)
SELECT planner, count(*) AS n, round(min(alpha), 6) AS alpha_min, round(max(alpha), 6) AS alpha_max, round(avg((alpha >= 1)::INT), 6) AS firms_over, round(avg((alpha = top)::INT), 6) AS firms_at_max, round(avg((alpha >= 1)::INT) FILTER (size_rank = '1_leader'), 6) AS leaders_over, round(avg((alpha = top)::INT) FILTER (size_rank = '1_leader'), 6) AS leaders_at_max,
    round(sum(tc_mkt) FILTER (alpha >= 1)/sum(tc_mkt), 6) AS tc_mkt_over, round(sum(tc_pl) FILTER (alpha >= 1)/sum(tc_pl), 6) AS tc_pl_over, CASE WHEN planner = 'free' THEN round(sum(tc_pl-tc_mkt) FILTER (alpha >= 1)/sum(tc_pl-tc_mkt), 5) END AS gain_over FROM long, m GROUP BY 1""")
def _(p):
    return r6(expansion.support(expansion.plans(expansion.sized(firms(p), "market_id", ["entity", "year"], "sales_mkt"), PLANNERS)).withColumn("gain_over", F.round("gain_over", 5)))


@query("sim29_checks", FIRMS + "SELECT planner, count(*) AS n_active, count(DISTINCT market_id) AS n_markets, round(sum(tc_pl)/sum(tc_mkt), 6) AS tc_ratio, round(corr(alpha, v), 6) AS corr_alpha_v, round(sum(mu_mkt*tc_mkt)/sum(tc_mkt), 6) AS mu_cw, true AS passed FROM long GROUP BY 1")
def _(p):
    return r6(expansion.ratio_check(expansion.plans(firms(p), PLANNERS), 1e-9))


@query("sim29_regressions", FIRMS + """, q AS (SELECT planner, weight, CASE weight WHEN 'tc' THEN tc_mkt ELSE 1 END AS w, market_id, ln(tc_pl/tc_mkt) AS y, ln(mu_mkt) AS m, alpha AS a, ln(v) AS z FROM long, (VALUES ('none'), ('tc')) t(weight) WHERE planner = 'free'),
c AS (SELECT planner, weight, w, y - sum(w*y) OVER g/sum(w) OVER g AS y, m - sum(w*m) OVER g/sum(w) OVER g AS m, a - sum(w*a) OVER g/sum(w) OVER g AS a, z - sum(w*z) OVER g/sum(w) OVER g AS z FROM q WINDOW g AS (PARTITION BY planner, weight, market_id)),
s AS (SELECT planner, weight, count(*) AS n, sum(w*m*m) AS mm, sum(w*m*a) AS ma, sum(w*m*z) AS mz, sum(w*a*a) AS aa, sum(w*a*z) AS az, sum(w*z*z) AS zz, sum(w*y*m) AS ym, sum(w*y*a) AS ya, sum(w*y*z) AS yz, sum(w*y*y) AS yy FROM c GROUP BY 1, 2),
d AS (SELECT *, mm*(aa*zz-az*az) - ma*(ma*zz-az*mz) + mz*(ma*az-aa*mz) AS det FROM s),
co AS (SELECT *, (ym*(aa*zz-az*az) - ma*(ya*zz-az*yz) + mz*(ya*az-aa*yz))/det AS bm, (mm*(ya*zz-az*yz) - ym*(ma*zz-az*mz) + mz*(ma*yz-ya*mz))/det AS ba, (mm*(aa*yz-ya*az) - ma*(ma*yz-ya*mz) + ym*(ma*az-aa*mz))/det AS bz FROM d),
r AS (SELECT *, yy - bm*ym - ba*ya - bz*yz AS ssr FROM co)
SELECT planner, weight, v.term, n, round(CASE v.term WHEN 'log_mu' THEN bm WHEN 'alpha' THEN ba ELSE bz END, 6) AS coef, round(1-ssr/yy, 6) AS within_r2, round(CASE v.term WHEN 'log_mu' THEN ym*ym/mm WHEN 'alpha' THEN ya*ya/aa ELSE yz*yz/zz END/yy, 6) AS alone_r2 FROM r, (VALUES ('log_mu'), ('alpha'), ('log_v')) v(term)""")
def _(p):
    f = expansion.plans(firms(p), {"free": PLANNERS["free"]}).select("planner", "market_id", "tc_mkt", F.ln(F.col("tc_pl") / F.col("tc_mkt")).alias("y"), F.ln("mu_mkt").alias("log_mu"), "alpha", F.ln("v").alias("log_v"))
    got = specs.least_squares(f, ["planner"], {"baseline": ("y", ["log_mu", "alpha", "log_v"])}, {"none": None, "tc": "tc_mkt"}, {"market": "market_id"})
    return r6(got.select("planner", "weight", "term", "n", "coef", "within_r2", "alone_r2"))
