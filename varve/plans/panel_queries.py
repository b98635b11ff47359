"""One query for each operator, keyed by its name in the inventory, over the proxy panel; floats are rounded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varve.operators import market, panel, quantiles, regress
from varve.sources.proxy import firm_years, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

PANEL = """WITH l AS (SELECT l_partkey, year(l_shipdate) AS year, sum(l_extendedprice*(1-l_discount)) AS rev, sum(l_quantity) AS cap, sum(l_extendedprice*l_tax) AS staf FROM lineitem GROUP BY 1, 2),
panel AS (SELECT l_partkey AS entity, CAST(year AS INTEGER) AS year, p_type AS cell, p_brand AS market, round(rev, 4) AS rev, round(cap*p_retailprice, 2) AS mate, round(staf, 4) AS staf, cap FROM l JOIN part ON l_partkey = p_partkey)
"""
KEYS = ["market", "year"]


def query(name: str, sql: str | None = None):
    def add(f: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(firm_years(spark, sf_dir))
        if sql:
            SQL[name] = PANEL + (", " + sql if sql.lstrip().split(" ", 1)[0].isidentifier() and " AS (" in sql.split("\n")[0][:40] else sql)
        return f

    return add


def r6(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query("src1_scan", "SELECT entity, year, rev FROM panel WHERE year >= 1998")
def _(p):
    return p.where("year >= 1998").select("entity", "year", "rev")


@query("prj5_conditional", "SELECT entity, year, CASE WHEN rev > 200000 THEN 'large' WHEN rev > 50000 THEN 'middle' ELSE 'small' END AS class FROM panel")
def _(p):
    return p.select("entity", "year", F.when(F.col("rev") > 200000, "large").when(F.col("rev") > 50000, "middle").otherwise("small").alias("class"))


@query("prj9_safe_log", "SELECT cell, sum(CASE WHEN staf > 0 THEN 0 ELSE 1 END)::BIGINT AS invalid, round(avg(CASE WHEN staf > 0 THEN ln(staf) END), 6) AS mean_ln FROM panel GROUP BY 1")
def _(p):
    return r6(p.groupBy("cell").agg(F.sum(F.when(F.col("staf") > 0, 0).otherwise(1)).alias("invalid"), F.avg(panel.safe_ln("staf")).alias("mean_ln")))


@query("flt5_band", "SELECT entity, year, round(mate/rev, 6) AS share FROM panel WHERE mate/rev BETWEEN 0.2 AND 0.8")
def _(p):
    return r6(p.select("entity", "year", (F.col("mate") / F.col("rev")).alias("share")).where("share between 0.2D and 0.8D"))


@query("flt7_waterfall", """s AS (SELECT 0 AS step, '' AS name, count(*) AS n_rows, count(DISTINCT entity) AS n_entities FROM panel
UNION ALL SELECT 1, 'positive', count(*), count(DISTINCT entity) FROM panel WHERE staf > 0
UNION ALL SELECT 2, 'recent', count(*), count(DISTINCT entity) FROM panel WHERE staf > 0 AND year >= 1997
UNION ALL SELECT 3, 'band', count(*), count(DISTINCT entity) FROM panel WHERE staf > 0 AND year >= 1997 AND mate < rev)
SELECT * FROM (SELECT *, lag(n_rows) OVER (ORDER BY step) - n_rows AS dropped FROM s) WHERE step > 0""")
def _(p):
    return panel.waterfall(p, [("positive", F.col("staf") > 0), ("recent", F.col("year") >= 1997), ("band", F.col("mate") < F.col("rev"))])


@query("jn4_full_outer", "SELECT entity, a.rev AS rev_a, b.rev AS rev_b FROM (SELECT entity, rev FROM panel WHERE year=1996) a FULL JOIN (SELECT entity, rev FROM panel WHERE year=1998) b USING (entity)")
def _(p):
    side = lambda y, n: p.where(f"year = {y}").select("entity", F.col("rev").alias(n))
    return side(1996, "rev_a").join(side(1998, "rev_b"), "entity", "full_outer")


@query("jn6_semi", "SELECT entity, year FROM panel WHERE entity IN (SELECT entity FROM panel WHERE year = 1995)")
def _(p):
    return p.select("entity", "year").join(p.where("year = 1995").select("entity"), "entity", "left_semi")


@query("jn7_anti", "SELECT entity, year FROM panel WHERE entity NOT IN (SELECT entity FROM panel WHERE year = 1995)")
def _(p):
    return p.select("entity", "year").join(p.where("year = 1995").select("entity"), "entity", "left_anti")


@query("jn9_fallback", """a AS (SELECT market, year, round(avg(cap), 6) AS price FROM panel GROUP BY 1, 2 HAVING count(*) >= 80), b AS (SELECT cell, round(avg(cap), 6) AS price FROM panel WHERE cell < 'PROMO' GROUP BY 1)
SELECT entity, year, coalesce(a.price, b.price, 1.0) AS price, CASE WHEN a.price IS NOT NULL THEN 1 WHEN b.price IS NOT NULL THEN 2 ELSE 3 END AS level FROM panel LEFT JOIN a USING (market, year) LEFT JOIN b USING (cell)""")
def _(p):
    a = p.groupBy(*KEYS).agg(F.round(F.avg("cap"), 6).alias("price"), F.count("*").alias("n")).where("n >= 80")
    b = p.where("cell < 'PROMO'").groupBy("cell").agg(F.round(F.avg("cap"), 6).alias("price"))
    c = p.select("year").distinct().withColumn("price", F.lit(1.0))
    return panel.lookup_with_fallback(p, [(a, KEYS), (b, ["cell"]), (c, ["year"])], "price").select("entity", "year", "price", "level")


@query("jn11_rolling", "SELECT cell, c.year AS centre, count(*) AS n, round(sum(rev), 4) AS rev FROM panel p JOIN (SELECT DISTINCT year FROM panel) c ON p.year BETWEEN c.year-2 AND c.year+2 GROUP BY 1, 2")
def _(p):
    return regress.rolling(p, 2).groupBy("cell", "centre").agg(F.count("*").alias("n"), F.round(F.sum("rev"), 4).alias("rev"))


@query("agg3_quantiles", "SELECT cell, round(quantile_cont(rev, 0.1), 4) AS p10, round(quantile_cont(rev, 0.5), 4) AS p50, round(quantile_cont(rev, 0.99), 4) AS p99 FROM panel GROUP BY 1")
def _(p):
    q = p.groupBy("cell").agg(F.percentile("rev", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.99))).alias("q"))
    return q.select("cell", *(F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("p10", "p50", "p99"))))


@query("agg4_hazen", """r AS (SELECT cell, rev, row_number() OVER (PARTITION BY cell ORDER BY rev) AS r, count(*) OVER (PARTITION BY cell) AS n FROM panel), h AS (SELECT *, greatest(1.0::DOUBLE, least(n::DOUBLE, n*0.05::DOUBLE+0.5)) AS h FROM r)
SELECT cell, round(max(CASE WHEN r=floor(h) THEN rev END) + (max(h)-floor(max(h)))*(max(CASE WHEN r=ceil(h) THEN rev END)-max(CASE WHEN r=floor(h) THEN rev END)), 4) AS q FROM h GROUP BY 1""")
def _(p):
    return quantiles.hazen(p, "rev", ["cell"], 0.05).select("cell", F.round("q", 4).alias("q"))


@query("agg5_averaged_quantile", """r AS (SELECT market, rev, row_number() OVER (PARTITION BY market ORDER BY rev) AS r, count(*) OVER (PARTITION BY market) AS n FROM panel)
SELECT market, round(avg(rev), 4) AS q FROM r WHERE r = (n*25)//100 + 1 OR ((n*25)%100 = 0 AND r = (n*25)//100) GROUP BY 1""")
def _(p):
    return quantiles.averaged(p, "rev", ["market"], 25).select("market", F.round("q", 4).alias("q"))


@query("agg7_weighted_quantile", """c AS (SELECT cell, rev, sum(cap) OVER (PARTITION BY cell ORDER BY rev RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)/sum(cap) OVER (PARTITION BY cell) AS c FROM panel)
SELECT cell, round(min(rev), 4) AS q FROM c WHERE c >= 0.9 - 1e-12 GROUP BY 1""")
def _(p):
    return quantiles.weighted(p, "rev", "cap", ["cell"], 0.9).select("cell", F.round("q", 4).alias("q"))


@query("agg9_weighted_moments", """m AS (SELECT cell, sum(cap*mate/rev)/sum(cap) AS m FROM panel GROUP BY 1)
SELECT cell, round(any_value(m), 6) AS mean, round(sum(cap*(mate/rev-m)*(mate/rev-m))/sum(cap), 6) AS variance FROM panel JOIN m USING (cell) GROUP BY 1""")
def _(p):
    x = p.select("cell", "cap", (F.col("mate") / F.col("rev")).alias("x"))
    x = x.join(x.groupBy("cell").agg((F.sum(F.col("cap") * F.col("x")) / F.sum("cap")).alias("m")), "cell")
    return r6(x.groupBy("cell").agg(F.max("m").alias("mean"), (F.sum(F.col("cap") * (F.col("x") - F.col("m")) ** 2) / F.sum("cap")).alias("variance")))


@query("agg15_spearman", """r AS (SELECT market, year, rank() OVER (PARTITION BY market, year ORDER BY rev) + (count(*) OVER (PARTITION BY market, year, rev)-1)/2.0 AS a, rank() OVER (PARTITION BY market, year ORDER BY cap) + (count(*) OVER (PARTITION BY market, year, cap)-1)/2.0 AS b FROM panel)
SELECT market, year, round(corr(a::DOUBLE, b::DOUBLE), 6) AS rho FROM r GROUP BY 1, 2""")
def _(p):
    ranks = p.select(*KEYS, market.average_rank_share("rev", KEYS).alias("a"), market.average_rank_share("cap", KEYS).alias("b"))
    return r6(ranks.groupBy(*KEYS).agg(F.corr("a", "b").alias("rho")))


@query("agg21_concentration", """r AS (SELECT market, year, rev, row_number() OVER (PARTITION BY market, year ORDER BY rev DESC, entity) AS rk, count(*) OVER (PARTITION BY market, year) AS n, rev/sum(rev) OVER (PARTITION BY market, year) AS s FROM panel)
SELECT market, year, count(*) AS n, round(sum(rev), 4) AS tot_sale, round(sum(CASE WHEN rk<=4 THEN s ELSE 0 END), 6) AS cr4, round(sum(CASE WHEN rk<=20 THEN s ELSE 0 END), 6) AS cr20, round(sum(CASE WHEN rk<=greatest(1, ceil(n*0.01::DOUBLE)) THEN s ELSE 0 END), 6) AS top1pct, round(sum(CASE WHEN rk<=greatest(1, ceil(n*0.05::DOUBLE)) THEN s ELSE 0 END), 6) AS top5pct, round(sum(s*s), 6) AS hhi FROM r GROUP BY 1, 2""")
def _(p):
    return r6(market.concentration(p, KEYS).withColumn("tot_sale", F.round("tot_sale", 4)))


@query("agg23_pooling", """m AS (SELECT market, year, count(*) AS n, sum(rev) AS tot, max(rev)/sum(rev) AS top FROM panel GROUP BY 1, 2), w AS (SELECT market, avg(n) AS n, avg(tot) AS tot, avg(top) AS top FROM m WHERE year BETWEEN 1996 AND 1999 GROUP BY 1)
SELECT round(sum(top*tot)/sum(tot), 6) AS top_share, round(sum(n), 6) AS firms FROM w""")
def _(p):
    m = p.where("year between 1996 and 1999").groupBy(*KEYS).agg(F.count("*").alias("n"), F.sum("rev").alias("tot"), (F.max("rev") / F.sum("rev")).alias("top"))
    w = m.groupBy("market").agg(F.avg("n").alias("n"), F.avg("tot").alias("tot"), F.avg("top").alias("top"))
    return r6(w.agg((F.sum(F.col("top") * F.col("tot")) / F.sum("tot")).alias("top_share"), F.sum("n").alias("firms")))


@query("agg25_modal", """c AS (SELECT cell, market, count(*) AS n FROM panel GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY n DESC, market) AS rk FROM c)
SELECT cell, market, n FROM k WHERE rk = 1""")
def _(p):
    return panel.first_by(p.groupBy("cell", "market").agg(F.count("*").alias("n")), ["cell"], F.desc("n"), F.col("market"))


@query("agg26_tail_index", """r AS (SELECT year, ln(rev) AS lx, row_number() OVER (PARTITION BY year ORDER BY rev DESC, entity) AS rk, count(*) OVER (PARTITION BY year) AS n FROM panel WHERE rev > 0), k AS (SELECT *, greatest(floor(n*0.05::DOUBLE), 20) AS k FROM r), t AS (SELECT *, min(lx) OVER (PARTITION BY year) AS low FROM k WHERE rk <= k)
SELECT year, count(*) AS k, round(-regr_slope(ln(rk-0.5), lx), 6) AS zipf, round(1/avg(CASE WHEN rk < k THEN lx-low END), 6) AS hill FROM t GROUP BY 1""")
def _(p):
    return r6(market.tail(p, ["year"], "rev", 0.05))


@query("agg29_rank_gap", """r AS (SELECT (rank() OVER (PARTITION BY market, year ORDER BY rev) + (count(*) OVER (PARTITION BY market, year, rev)-1)/2.0)/count(*) OVER (PARTITION BY market, year) AS pr, mate/rev - avg(mate/rev) OVER (PARTITION BY market, year) AS d FROM panel)
SELECT round(avg(CASE WHEN pr > 0.95 THEN d END) - avg(CASE WHEN pr <= 0.5 THEN d END), 6) AS gap FROM r""")
def _(p):
    return r6(market.rank_gap(p.withColumn("v", F.col("mate") / F.col("rev")), KEYS, "rev", "v", 0.95))


@query("agg30_profile", """r AS (SELECT greatest(1, least(20, ceil(20*(rank() OVER (PARTITION BY market ORDER BY rev) + (count(*) OVER (PARTITION BY market, rev)-1)/2.0)/count(*) OVER (PARTITION BY market))))::BIGINT AS bin, cap - avg(cap) OVER (PARTITION BY market) AS d FROM panel)
SELECT bin, count(*) AS n, round(avg(d), 6) AS mean FROM r GROUP BY 1""")
def _(p):
    b = F.greatest(F.lit(1), F.least(F.lit(20), F.ceil(20 * market.average_rank_share("rev", ["market"])))).cast("long")
    d = F.col("cap") - F.avg("cap").over(Window.partitionBy("market"))
    return r6(p.select(b.alias("bin"), d.alias("d")).groupBy("bin").agg(F.count("*").alias("n"), F.avg("d").alias("mean")))


@query("agg33_contingency", """c AS (SELECT cell, market, count(*) AS n FROM panel GROUP BY 1, 2), s AS (SELECT *, n/sum(n) OVER (PARTITION BY cell) AS share, row_number() OVER (PARTITION BY cell ORDER BY n DESC, market) AS rk FROM c)
SELECT cell, market, n, round(share, 6) AS share, rk::INTEGER AS rk FROM s WHERE rk <= 3""")
def _(p):
    w = Window.partitionBy("cell")
    c = p.groupBy("cell", "market").agg(F.count("*").alias("n"))
    return r6(c.withColumns({"share": F.col("n") / F.sum("n").over(w), "rk": F.row_number().over(w.orderBy(F.desc("n"), "market"))}).where("rk <= 3"))


@query("agg34_pivot", "SELECT market, round(sum(CASE WHEN year=1996 THEN rev END), 4) AS y1996, round(sum(CASE WHEN year=1997 THEN rev END), 4) AS y1997 FROM panel GROUP BY 1")
def _(p):
    return p.groupBy("market").pivot("year", [1996, 1997]).agg(F.round(F.sum("rev"), 4)).withColumnsRenamed({"1996": "y1996", "1997": "y1997"})


@query("agg45_ces", "SELECT market, year, round(ln(power(sum(power(rev, 0.8::DOUBLE)), 1.25::DOUBLE)), 6) AS ln_index FROM panel GROUP BY 1, 2")
def _(p):
    return r6(p.groupBy(*KEYS).agg(F.ln(F.pow(F.sum(F.pow("rev", F.lit(0.8))), F.lit(1.25))).alias("ln_index")))


@query("agg49_balanced", "SELECT entity, year, rev FROM panel WHERE entity IN (SELECT entity FROM panel GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT year) FROM panel))")
def _(p):
    years = F.broadcast(p.agg(F.countDistinct("year").alias("T")))
    full = p.groupBy("entity").agg(F.count("*").alias("n")).join(years).where("n = T").select("entity")
    return p.join(full, "entity", "left_semi").select("entity", "year", "rev")


@query("agg50_covariance_gap", "SELECT year, round(sum(cap*mate/rev)/sum(cap) - avg(mate/rev), 6) AS gap FROM panel GROUP BY 1")
def _(p):
    x = F.col("mate") / F.col("rev")
    return r6(p.groupBy("year").agg((F.sum(F.col("cap") * x) / F.sum("cap") - F.avg(x)).alias("gap")))


@query("win1_consecutive_lag", "SELECT entity, year, CASE WHEN lag(year) OVER w = year-1 THEN lag(rev) OVER w END AS l_rev FROM panel WINDOW w AS (PARTITION BY entity ORDER BY year)")
def _(p):
    return panel.consecutive_lag(p, ["rev"]).select("entity", "year", "l_rev")


@query("win2_flags", "SELECT entity, year, coalesce(lag(year) OVER w = year-1, false) AS has_prev, coalesce(lead(year) OVER w = year+1, false) AS has_next, count(*) OVER (PARTITION BY entity) AS n_periods FROM panel WINDOW w AS (PARTITION BY entity ORDER BY year)")
def _(p):
    return panel.panel_flags(p).select("entity", "year", "has_prev", "has_next", "n_periods")


@query("win7_average_rank", "SELECT entity, year, round((rank() OVER (PARTITION BY cell ORDER BY cap) + (count(*) OVER (PARTITION BY cell, cap)-1)/2.0)/count(*) OVER (PARTITION BY cell), 6) AS pr FROM panel")
def _(p):
    return r6(p.select("entity", "year", market.average_rank_share("cap", ["cell"]).alias("pr")))


@query("win10_demean", "SELECT entity, year, round(cap - avg(cap) OVER (PARTITION BY market, year), 6) AS d FROM panel")
def _(p):
    return r6(p.select("entity", "year", (F.col("cap") - F.avg("cap").over(Window.partitionBy(*KEYS))).alias("d")))


@query("win12_trim", """q AS (SELECT cell, quantile_cont(rev, 0.01) AS a, quantile_cont(rev, 0.99) AS b FROM panel GROUP BY 1)
SELECT entity, year, rev, round(a, 6) AS cut_low, round(b, 6) AS cut_high FROM panel JOIN q USING (cell) WHERE rev > a AND rev < b""")
def _(p):
    return r6(panel.trim_by(p, "rev", ["cell"], 0.01, 0.99).select("entity", "year", "rev", "cut_low", "cut_high"))


@query("win13_winsorize", """q AS (SELECT cell, quantile_cont(cap, 0.05) AS a, quantile_cont(cap, 0.95) AS b FROM panel GROUP BY 1)
SELECT entity, year, round(greatest(a, least(cap, b)), 6) AS cap_w FROM panel JOIN q USING (cell)""")
def _(p):
    return r6(panel.winsorize_by(p, "cap", ["cell"], 0.05, 0.95, "cap_w").select("entity", "year", "cap_w"))


@query("win18_moving_average", """y AS (SELECT cell, year, sum(cap) AS cap FROM panel GROUP BY 1, 2)
SELECT cell, year, round(CASE WHEN count(*) OVER w = 3 THEN avg(cap) OVER w END, 6) AS ma FROM y WINDOW w AS (PARTITION BY cell ORDER BY year ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def _(p):
    w = Window.partitionBy("cell").orderBy("year").rowsBetween(-1, 1)
    y = p.groupBy("cell", "year").agg(F.sum("cap").alias("cap"))
    return r6(y.select("cell", "year", F.when(F.count("*").over(w) == 3, F.avg("cap").over(w)).alias("ma")))


@query("win21_stacked_gaps", "SELECT a.market, a.year, round(ln(b.rev) - ln(a.rev), 6) AS d FROM (SELECT market, year, sum(rev) AS rev FROM panel GROUP BY 1, 2) a JOIN (SELECT market, year, sum(rev) AS rev FROM panel GROUP BY 1, 2) b ON a.market = b.market AND b.year = a.year + 3")
def _(p):
    m = p.groupBy(*KEYS).agg(F.sum("rev").alias("rev"))
    later = m.select("market", (F.col("year") - 3).alias("year"), F.col("rev").alias("later"))
    return r6(m.join(later, KEYS).select("market", "year", (F.ln("later") - F.ln("rev")).alias("d")))


@query("ord2_priority_dedup", "r AS (SELECT entity, year, rev, row_number() OVER (PARTITION BY entity ORDER BY rev DESC, year) AS rk FROM panel)\nSELECT entity, year, rev FROM r WHERE rk = 1")
def _(p):
    return panel.first_by(p.select("entity", "year", "rev"), ["entity"], F.desc("rev"), F.col("year"))


@query("est1_ols_hc1", """v AS (SELECT cell, ln(cap) AS x, ln(rev) AS y FROM panel WHERE cap > 0 AND rev > 0), f AS (SELECT cell, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS mx, regr_r2(y, x) AS r2 FROM v GROUP BY 1)
SELECT cell, count(*) AS n, round(any_value(b), 6) AS slope, round(any_value(a), 6) AS intercept, round(any_value(r2), 6) AS r2, round(sqrt(sum((y-a-b*x)*(y-a-b*x)*(x-mx)*(x-mx))*count(*)/(count(*)-2))/sum((x-mx)*(x-mx)), 6) AS se FROM v JOIN f USING (cell) GROUP BY 1""")
def _(p):
    return r6(regress.ols_hc1(p.select("cell", panel.safe_ln("cap").alias("x"), panel.safe_ln("rev").alias("y")), "y", "x", ["cell"]))


@query("est2_fixed_effects", """v AS (SELECT ln(cap) - avg(ln(cap)) OVER (PARTITION BY market, year) AS x, ln(rev) - avg(ln(rev)) OVER (PARTITION BY market, year) AS y FROM panel WHERE cap > 0 AND rev > 0)
SELECT count(*) AS n, round(sum(x*y)/sum(x*x), 6) AS slope FROM v""")
def _(p):
    return r6(regress.within_slope(p.select(*KEYS, panel.safe_ln("cap").alias("x"), panel.safe_ln("rev").alias("y")), "y", "x", KEYS))


@query("est8_rolling_iv", """g AS (SELECT cell, year, ln(rev) AS y, ln(mate) AS x, CASE WHEN lag(year) OVER w = year-1 THEN ln(lag(mate) OVER w) END AS z FROM panel WINDOW w AS (PARTITION BY entity ORDER BY year)),
k AS (SELECT g.cell, c.centre, y, x, z FROM g JOIN (SELECT unnest(range(1997, 2001)) AS centre) c ON g.year BETWEEN centre-2 AND centre+2 WHERE z IS NOT NULL),
d AS (SELECT cell, centre, y-avg(y) OVER w AS y, x-avg(x) OVER w AS x, z-avg(z) OVER w AS z FROM k WINDOW w AS (PARTITION BY cell, centre)),
b AS (SELECT cell, centre, sum(z*y)/sum(z*x) AS b, sum(z*x)/sum(z*z) AS p, sum(z*x) AS zx, sum(z*z) AS zz FROM d GROUP BY 1, 2),
e AS (SELECT cell, centre, count(*) AS n, round(any_value(b), 4) AS beta, round(sqrt(sum((y-b*x)*(y-b*x)*z*z))/abs(any_value(zx)), 4) AS se, round(any_value(p*zz)/sqrt(sum((x-p*z)*(x-p*z)*z*z)), 2) AS first_t FROM d JOIN b USING (cell, centre) GROUP BY 1, 2 HAVING count(*) >= 10)
SELECT cell, CAST(centre AS INTEGER) AS year, n, beta, se, first_t, false AS imputed FROM e UNION ALL SELECT cell, CAST(y.year AS INTEGER), n, beta, se, first_t, true FROM e, (SELECT unnest([1995, 1996]) AS year) y WHERE centre = 1997""")
def _(p):
    p = panel.consecutive_lag(p, ["mate"]).select("cell", "year", panel.safe_ln("rev").alias("y"), panel.safe_ln("mate").alias("x"), panel.safe_ln("l_mate").alias("z"))
    got = regress.rolling_iv(p, "y", "x", "z", "cell", 2, (1997, 2000), [1995, 1996], 10)
    return got.select("cell", "year", "n", F.round("beta", 4).alias("beta"), F.round("se", 4).alias("se"), F.round("first_t", 2).alias("first_t"), "imputed")


@query("est23_trend", "SELECT market, round(10*regr_slope(cap, year), 6) AS per_decade FROM panel GROUP BY 1")
def _(p):
    return r6(p.groupBy("market").agg((10 * F.regr_slope("cap", "year")).alias("per_decade")))


@query("sim21_sorted_arrangement", """a AS (SELECT market, year, entity, cap, row_number() OVER (PARTITION BY market, year ORDER BY cap, entity) AS rk FROM panel), v AS (SELECT market, year, rev, row_number() OVER (PARTITION BY market, year ORDER BY rev, entity) AS rk FROM panel)
SELECT market, year, entity, cap, rev FROM a JOIN v USING (market, year, rk)""")
def _(p):
    rank = lambda c: F.row_number().over(Window.partitionBy(*KEYS).orderBy(c, "entity")).alias("rk")
    return p.select(*KEYS, "entity", "cap", rank("cap")).join(p.select(*KEYS, "rev", rank("rev")), [*KEYS, "rk"]).drop("rk")


@query("sim22_harmonic_mean", "SELECT entity, year, round(1/avg(1/mate) OVER (PARTITION BY cell), 4) AS level FROM panel WHERE mate > 0")
def _(p):
    p = p.where("mate > 0").select("entity", "year", "cell", "mate")
    return p.join(p.groupBy("cell").agg((1 / F.avg(1 / F.col("mate"))).alias("m")), "cell").select("entity", "year", F.round("m", 4).alias("level"))


@query("smp1_entity_sample", "SELECT entity, year, rev FROM panel WHERE ('0x' || substr(md5(entity::VARCHAR || ':7'), 1, 8))::BIGINT % 10000 < 2500")
def _(p):
    """A quarter of the entities, by a seeded hash that any engine has."""
    return p.where(F.conv(F.substring(F.md5(F.concat(F.col("entity").cast("string"), F.lit(":7")).cast("binary")), 1, 8), 16, 10).cast("long") % 10000 < 2500).select("entity", "year", "rev")


QUERIES["agg1_orders"] = lambda spark, sf_dir: r6(table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"), F.round(F.sum("o_totalprice"), 2).alias("total")))
SQL["agg1_orders"] = "SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1"
