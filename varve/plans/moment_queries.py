"""Queries for aggregates, windows and estimators over the proxy panel, beyond those of ``panel_queries``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from varve.operators import market, moments, ordered, panel, quantiles, regress

from .panel_queries import KEYS, query, r6

LOGS = "v AS (SELECT entity, year, cell, market, cap, ln(cap) AS x, ln(rev) AS y FROM panel WHERE cap > 0 AND rev > 0)"


def logs(p):
    return p.select("entity", "year", "cell", "market", "cap", panel.safe_ln("cap").alias("x"), panel.safe_ln("rev").alias("y"))


@query("agg2_share", "SELECT year, round(avg(CASE WHEN mate > rev THEN 1.0::DOUBLE ELSE 0 END), 6) AS share FROM panel GROUP BY 1")
def _(p):
    return r6(p.groupBy("year").agg(F.avg((F.col("mate") > F.col("rev")).cast("double")).alias("share")))


@query("agg6_median", "SELECT market, round(median(rev), 6) AS med FROM panel GROUP BY 1")
def _(p):
    return p.groupBy("market").agg(F.round(F.median("rev"), 6).alias("med"))


@query("agg10_log_variance", LOGS + ", m AS (SELECT *, sum(cap*y) OVER (PARTITION BY cell)/sum(cap) OVER (PARTITION BY cell) AS m FROM v)\nSELECT cell, round(sum(cap*(y-m)*(y-m))/sum(cap), 6) AS variance, round(sqrt(sum(cap*(y-m)*(y-m))/sum(cap)), 6) AS sd FROM m GROUP BY 1")
def _(p):
    d = logs(p).withColumn("d", moments.demean("y", ["cell"], "cap"))
    variance = moments.weighted_mean(F.col("d") * F.col("d"), "cap")
    return r6(d.groupBy("cell").agg(variance.alias("variance"), F.sqrt(variance).alias("sd")))


@query("agg12_deviations", "SELECT cell, round(stddev_samp(cap), 6) AS sample, round(stddev_pop(cap), 6) AS population FROM panel GROUP BY 1")
def _(p):
    return r6(p.groupBy("cell").agg(F.stddev("cap").alias("sample"), F.stddev_pop("cap").alias("population")))


@query("agg13_pearson", "SELECT market, round(corr(rev, cap), 6) AS r FROM panel GROUP BY 1")
def _(p):
    return r6(p.groupBy("market").agg(F.corr("rev", "cap").alias("r")))


@query("agg14_weighted_correlation", LOGS + """, m AS (SELECT *, sum(cap*x) OVER (PARTITION BY cell)/sum(cap) OVER (PARTITION BY cell) AS mx, sum(cap*y) OVER (PARTITION BY cell)/sum(cap) OVER (PARTITION BY cell) AS my FROM v)
SELECT cell, round(sum(cap*(x-mx)*(y-my))/sqrt(sum(cap*(x-mx)*(x-mx))*sum(cap*(y-my)*(y-my))), 6) AS r FROM m GROUP BY 1""")
def _(p):
    return r6(moments.weighted_corr(logs(p), "x", "y", "cap", ["cell"], "r"))


@query("agg16_pooled_rank_correlation", """r AS (SELECT (rank() OVER (PARTITION BY market ORDER BY rev) + (count(*) OVER (PARTITION BY market, rev)-1)/2.0)/count(*) OVER (PARTITION BY market) AS a, (rank() OVER (PARTITION BY market ORDER BY cap) + (count(*) OVER (PARTITION BY market, cap)-1)/2.0)/count(*) OVER (PARTITION BY market) AS b FROM panel)
SELECT round(corr(a::DOUBLE, b::DOUBLE), 6) AS rho, round(2*sin(pi()*corr(a::DOUBLE, b::DOUBLE)/6), 6) AS copula FROM r""")
def _(p):
    rho = F.corr("a", "b")
    r = p.select(market.average_rank_share("rev", ["market"]).alias("a"), market.average_rank_share("cap", ["market"]).alias("b"))
    return r6(r.agg(rho.alias("rho"), (2 * F.sin(F.pi() * rho / 6)).alias("copula")))


@query("agg17_partial_correlation", "c AS (SELECT cell, corr(rev, mate) AS xy, corr(rev, cap) AS xz, corr(mate, cap) AS yz FROM panel GROUP BY 1)\nSELECT cell, round((xy-xz*yz)/sqrt((1-xz*xz)*(1-yz*yz)), 6) AS r FROM c")
def _(p):
    return r6(p.groupBy("cell").agg(moments.partial_corr("rev", "mate", "cap").alias("r")))


@query("agg24_window_means", "y AS (SELECT year, sum(cap*mate/rev)/sum(cap) AS m FROM panel GROUP BY 1)\nSELECT round(avg(CASE WHEN year BETWEEN 1995 AND 1997 THEN m END), 6) AS early, round(avg(CASE WHEN year BETWEEN 1998 AND 2001 THEN m END), 6) AS late FROM y")
def _(p):
    y = p.groupBy("year").agg(moments.weighted_mean(F.col("mate") / F.col("rev"), "cap").alias("m"))
    over = lambda a, b: F.avg(F.when(F.col("year").between(a, b), F.col("m")))
    return r6(y.agg(over(1995, 1997).alias("early"), over(1998, 2001).alias("late")))


@query("agg31_nodes", "q AS (SELECT cell, quantile_cont(cap, [0.05, 0.15, 0.25, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85, 0.95]) AS q FROM panel GROUP BY 1)\nSELECT cell, k::INTEGER AS k, round(q[k], 6) AS node FROM q, range(1, 11) t(k)")
def _(p):
    q = quantiles.linear(p, "cap", ["cell"], [(2 * k - 1) / 20 for k in range(1, 11)])
    q = q.select("cell", F.posexplode(F.array(*(f"q{i}" for i in range(10)))).alias("k", "node"))
    return r6(q.withColumn("k", F.col("k") + 1))


@query("agg35_masked", "SELECT cell, market, CASE WHEN count(*) >= 100 THEN round(avg(rev), 4) END AS mean FROM panel GROUP BY 1, 2")
def _(p):
    return p.groupBy("cell", "market").agg(F.when(F.count("*") >= 100, F.round(F.avg("rev"), 4)).alias("mean"))


@query("agg36_duplicate_keys", "SELECT cell, market, year, count(*) AS n FROM panel GROUP BY 1, 2, 3 HAVING count(*) > 1")
def _(p):
    return p.groupBy("cell", *KEYS).agg(F.count("*").alias("n")).where("n > 1")


@query("agg38_log_summary", LOGS + "\nSELECT year, count(*) AS n, round(avg(y), 6) AS mean, round(stddev_samp(y), 6) AS sd, round(quantile_cont(y, 0.1), 6) AS p10, round(quantile_cont(y, 0.5), 6) AS p50, round(quantile_cont(y, 0.9), 6) AS p90, round(quantile_cont(y, 0.99), 6) AS p99 FROM v GROUP BY 1")
def _(p):
    v = logs(p)
    q = quantiles.exact(v, {f"p{round(100 * a)}": ("y", a) for a in (0.1, 0.5, 0.9, 0.99)}, ["year"])
    return r6(v.groupBy("year").agg(F.count("y").alias("n"), F.avg("y").alias("mean"), F.stddev("y").alias("sd")).join(q, "year"))


@query("agg40_firm_means", LOGS + "\nSELECT market, entity, round(avg(y), 6) AS mean_ln, round(ln(avg(exp(y))), 6) AS ln_mean FROM v WHERE year BETWEEN 1996 AND 1999 GROUP BY 1, 2")
def _(p):
    return r6(logs(p).where("year between 1996 and 1999").groupBy("market", "entity").agg(F.avg("y").alias("mean_ln"), F.ln(F.avg(F.exp("y"))).alias("ln_mean")))


@query("agg43_cells", "b AS (SELECT year, CASE WHEN cap < 30 THEN 1 WHEN cap < 60 THEN 2 ELSE 3 END AS bin, rev, mate FROM panel)\nSELECT year, bin, count(*) AS n, round(sum(rev)/(SELECT sum(rev) FROM b), 6) AS sales_share, round(sum(mate)/(SELECT sum(mate) FROM b), 6) AS cost_share FROM b GROUP BY 1, 2")
def _(p):
    b = F.when(F.col("cap") < 30, 1).when(F.col("cap") < 60, 2).otherwise(3)
    cells = p.groupBy("year", b.alias("bin")).agg(F.count("*").alias("n"), F.sum("rev").alias("rev"), F.sum("mate").alias("mate"))
    total = cells.agg(F.sum("rev").alias("R"), F.sum("mate").alias("M"))  # one row
    return r6(cells.join(F.broadcast(total)).select("year", "bin", "n", (F.col("rev") / F.col("R")).alias("sales_share"), (F.col("mate") / F.col("M")).alias("cost_share")))


@query("agg47_markups", "SELECT year, round(sum(mate*(rev/mate))/sum(mate), 6) AS cost_weighted, round(sum(rev)/sum(mate), 6) AS accounting FROM panel WHERE mate > 0 GROUP BY 1")
def _(p):
    return r6(p.where("mate > 0").groupBy("year").agg(moments.weighted_mean(F.col("rev") / F.col("mate"), "mate").alias("cost_weighted"), F.try_divide(F.sum("rev"), F.sum("mate")).alias("accounting")))


@query("agg51_trend_split", "s AS (SELECT cell, regr_slope(cap, year) AS b, sum(rev) AS w FROM panel GROUP BY 1), t AS (SELECT regr_slope(cap, year) AS b FROM panel)\nSELECT round(sum(w*s.b)/sum(w), 6) AS within, round(any_value(t.b) - sum(w*s.b)/sum(w), 6) AS rest FROM s, t")
def _(p):
    s = p.groupBy("cell").agg(F.regr_slope("cap", "year").alias("b"), F.sum("rev").alias("w")).agg(moments.weighted_mean("b", "w").alias("within"))
    t = p.agg(F.regr_slope("cap", "year").alias("all"))
    return r6(s.join(F.broadcast(t)).select("within", (F.col("all") - F.col("within")).alias("rest")))


@query("agg53_top_bridge", "SELECT round(sum(cap*mate/rev)/sum(cap), 6) AS mean FROM (SELECT cap, mate, rev FROM panel ORDER BY rev DESC, entity, year LIMIT 50)")
def _(p):
    return r6(p.orderBy(F.desc("rev"), "entity", "year").limit(50).agg(moments.weighted_mean(F.col("mate") / F.col("rev"), "cap").alias("mean")))


@query("agg56_top_share", "m AS (SELECT market, year, max(rev)/sum(rev) AS top FROM panel GROUP BY 1, 2)\nSELECT year, round(quantile_cont(top, 0.5), 6) AS p50, round(quantile_cont(top, 0.9), 6) AS p90 FROM m GROUP BY 1")
def _(p):
    m = p.groupBy(*KEYS).agg((F.max("rev") / F.sum("rev")).alias("top"))
    return r6(m.groupBy("year").agg(F.percentile("top", F.lit(0.5)).alias("p50"), F.percentile("top", F.lit(0.9)).alias("p90")))


@query("agg58_weighted_cdf", "SELECT cell, entity, year, round(cume_dist() OVER (PARTITION BY cell ORDER BY cap), 6) AS ecdf, round(sum(rev) OVER (PARTITION BY cell ORDER BY cap RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)/sum(rev) OVER (PARTITION BY cell), 6) AS wcdf FROM panel")
def _(p):
    """Running sums over distinct values, joined back to the rows."""
    p = p.select("cell", "entity", "year", "cap", "rev")
    values = p.groupBy("cell", "cap").agg(F.count("*").alias("n"), F.sum("rev").alias("s"))
    run = ordered.running(values, ["cell"], [F.col("cap")], {"u": F.col("n"), "v": F.col("s")}, rank=None)
    run = run.select("cell", "cap", (F.col("u") / F.col("u_total")).alias("ecdf"), (F.col("v") / F.col("v_total")).alias("wcdf"))
    return r6(p.join(run, ["cell", "cap"]).select("cell", "entity", "year", "ecdf", "wcdf"))


@query("win3_growth", "y AS (SELECT cell, year, sum(rev) AS rev FROM panel GROUP BY 1, 2)\nSELECT cell, year, round(rev/lag(rev) OVER (PARTITION BY cell ORDER BY year)-1, 6) AS g FROM y")
def _(p):
    y = p.groupBy("cell", "year").agg(F.sum("rev").alias("rev"))
    return r6(y.select("cell", "year", (F.col("rev") / F.lag("rev").over(Window.partitionBy("cell").orderBy("year")) - 1).alias("g")))


@query("win6_cumulative_share", "SELECT market, year, entity, round(sum(rev) OVER (PARTITION BY market, year ORDER BY rev DESC, entity ROWS UNBOUNDED PRECEDING)/sum(rev) OVER (PARTITION BY market, year), 6) AS cum FROM panel")
def _(p):
    w = Window.partitionBy(*KEYS)
    run = F.sum("rev").over(w.orderBy(F.desc("rev"), "entity").rowsBetween(Window.unboundedPreceding, 0))
    return r6(p.select(*KEYS, "entity", (run / F.sum("rev").over(w)).alias("cum")))


@query("win9_deciles", "r AS (SELECT entity, year, (rank() OVER (PARTITION BY market ORDER BY rev) + (count(*) OVER (PARTITION BY market, rev)-1)/2.0)/count(*) OVER (PARTITION BY market) AS pr FROM panel)\nSELECT entity, year, least(ceil(pr*10), 10)::BIGINT AS decile FROM r")
def _(p):
    return p.select("entity", "year", F.least(F.ceil(market.average_rank_share("rev", ["market"]) * 10), F.lit(10)).cast("long").alias("decile"))


@query("win11_weighted_demean", "SELECT entity, year, round(cap - sum(rev*cap) OVER (PARTITION BY market)/sum(rev) OVER (PARTITION BY market), 4) AS d FROM panel")
def _(p):
    return p.select("entity", "year", F.round(moments.demean("cap", ["market"], "rev"), 4).alias("d"))


@query("win15_min_group", "SELECT entity, year FROM panel WHERE (market, year) IN (SELECT (market, year) FROM panel GROUP BY market, year HAVING count(*) >= 10)")
def _(p):
    return p.select("entity", "year", F.count("*").over(Window.partitionBy(*KEYS)).alias("n")).where("n >= 10").drop("n")


@query("win16_equal_width", "SELECT CASE WHEN cap <= 25 THEN 'a' WHEN cap <= 50 THEN 'b' WHEN cap <= 100 THEN 'c' ELSE 'd' END AS bin, count(*) AS n FROM panel GROUP BY 1")
def _(p):
    b = F.when(F.col("cap") <= 25, "a").when(F.col("cap") <= 50, "b").when(F.col("cap") <= 100, "c").otherwise("d")
    return p.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


@query("win17_equal_mass", "q AS (SELECT cell, quantile_cont(rev, 0.25) AS a, quantile_cont(rev, 0.5) AS b, quantile_cont(rev, 0.75) AS c FROM panel GROUP BY 1)\nSELECT cell, (1 + (rev > a)::INTEGER + (rev > b)::INTEGER + (rev > c)::INTEGER)::INTEGER AS bin, count(*) AS n FROM panel JOIN q USING (cell) GROUP BY 1, 2")
def _(p):
    q = quantiles.linear(p, "rev", ["cell"], [0.25, 0.5, 0.75])
    b = sum(((F.col("rev") > F.col(f"q{i}")).cast("int") for i in range(3)), F.lit(1))
    return p.select("cell", "rev").join(q, "cell").groupBy("cell", b.alias("bin")).agg(F.count("*").alias("n"))


@query("win19_group_share", "SELECT entity, year, round(rev/sum(rev) OVER (PARTITION BY cell, year), 6) AS share FROM panel")
def _(p):
    return r6(p.select("entity", "year", (F.col("rev") / F.sum("rev").over(Window.partitionBy("cell", "year"))).alias("share")))


@query("win20_relative_profile", "m AS (SELECT least(year, 1999)::INTEGER AS age, avg(cap) AS m FROM panel GROUP BY 1)\nSELECT age, round(m - (SELECT arg_max(m, age) FROM m), 6) AS rel FROM m")
def _(p):
    m = p.groupBy(F.least("year", F.lit(1999)).alias("age")).agg(F.avg("cap").alias("m"))
    return r6(m.join(F.broadcast(m.agg(F.max_by("m", "age").alias("last")))).select("age", (F.col("m") - F.col("last")).alias("rel")))


@query("win22_kth_row", "r AS (SELECT market, year, rev, row_number() OVER (PARTITION BY market, year ORDER BY rev DESC, entity) AS rk FROM panel)\nSELECT market, year, rev FROM r WHERE rk = 4")
def _(p):
    return p.select(*KEYS, "rev", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("rev"), "entity")).alias("rk")).where("rk = 4").drop("rk")


@query("est3_group_ols", LOGS + "\nSELECT market, year, count(*) AS n, round(regr_slope(y, x), 6) AS slope FROM v GROUP BY 1, 2 HAVING count(*) >= 5")
def _(p):
    return r6(logs(p).groupBy(*KEYS).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope")).where("n >= 5"))


@query("est4_clustered", LOGS + """, d AS (SELECT entity, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y FROM v WINDOW w AS (PARTITION BY market, year)), b AS (SELECT sum(x*y)/sum(x*x) AS b, sum(x*x) AS xx FROM d),
s AS (SELECT entity, sum((y-b*x)*x) AS s FROM d, b GROUP BY 1)
SELECT round(any_value(b), 6) AS slope, count(*) AS clusters, round(sqrt(sum(s*s))/any_value(xx), 6) AS se FROM s, b""")
def _(p):
    return r6(regress.clustered(logs(p), "y", "x", KEYS, "entity"))


@query("est6_variance_split", LOGS + ", g AS (SELECT y, cap, sum(cap*y) OVER (PARTITION BY market)/sum(cap) OVER (PARTITION BY market) AS m, sum(cap*y) OVER ()/sum(cap) OVER () AS t FROM v)\nSELECT round(sum(cap*(m-t)*(m-t))/sum(cap), 6) AS between_groups, round(sum(cap*(y-m)*(y-m))/sum(cap), 6) AS within_groups FROM g")
def _(p):
    y = F.col("y")
    g = logs(p).groupBy("market").agg(F.sum("cap").alias("w"), moments.weighted_mean("y", "cap").alias("m"), moments.weighted_mean(y * y, "cap").alias("q"))
    within = moments.weighted_mean(F.col("q") - F.col("m") * F.col("m"), "w")
    between = moments.weighted_mean(F.col("m") * F.col("m"), "w") - F.pow(moments.weighted_mean("m", "w"), F.lit(2.0))
    return r6(g.agg(between.alias("between_groups"), within.alias("within_groups")))


@query("est10_long_difference", "m AS (SELECT market, year, ln(sum(rev)) AS y, ln(sum(mate)) AS x FROM panel GROUP BY 1, 2)\nSELECT count(*) AS n, round(regr_slope(b.y-a.y, b.x-a.x), 6) AS slope FROM m a JOIN m b ON a.market = b.market AND a.year = 1995 AND b.year = 1998")
def _(p):
    at = lambda c, y: F.ln(F.sum(F.when(F.col("year") == y, F.col(c))))
    d = p.where("year in (1995, 1998)").groupBy("market").agg((at("rev", 1998) - at("rev", 1995)).alias("dy"), (at("mate", 1998) - at("mate", 1995)).alias("dx"))
    return r6(d.where("dy is not null and dx is not null").agg(F.count("*").alias("n"), F.regr_slope("dy", "dx").alias("slope")))


@query("sim6_markup_rule", "SELECT entity, year, r.regime, round(CASE r.regime WHEN 'planner' THEN 1.0::DOUBLE WHEN 'uniform' THEN 1.2::DOUBLE ELSE e/(e-1) END, 6) AS markup FROM (SELECT entity, year, 1/(s/1.5::DOUBLE + (1-s)/6.0::DOUBLE) AS e FROM (SELECT entity, year, rev/sum(rev) OVER (PARTITION BY market, year) AS s FROM panel)) CROSS JOIN (VALUES ('market'), ('planner'), ('uniform')) r(regime)")
def _(p):
    s = p.select("entity", "year", (F.col("rev") / F.sum("rev").over(Window.partitionBy(*KEYS))).alias("s"))
    e = s.select("entity", "year", (1 / (F.col("s") / 1.5 + (1 - F.col("s")) / 6.0)).alias("e"), F.explode(F.array(*map(F.lit, ("market", "planner", "uniform")))).alias("regime"))
    rule = F.when(F.col("regime") == "planner", 1.0).when(F.col("regime") == "uniform", 1.2).otherwise(F.col("e") / (F.col("e") - 1))
    return r6(e.select("entity", "year", "regime", rule.alias("markup")))


@query("agg54_content_hash", "SELECT count(*) AS n, sum(('0x' || substr(md5(concat_ws('|', entity, year, cell, market, rev::DECIMAL(38,6), mate::DECIMAL(38,6))), 1, 15))::HUGEINT)::VARCHAR AS hash FROM panel")
def _(p):
    return moments.content_hash(p.select("entity", "year", "cell", "market", "rev", "mate"))


_P = ordered.PRIME


@query("smp2_cluster_bootstrap", f"""u AS (SELECT md5(entity::VARCHAR || ':1') AS h, sum(cap) AS s, count(*) AS n FROM panel GROUP BY entity), d AS (SELECT s, n, ('0x' || substr(h, 1, 8))::BIGINT % {_P} AS a, ('0x' || substr(h, 9, 8))::BIGINT % {_P} AS b, ('0x' || substr(h, 17, 8))::BIGINT % {_P} AS c, r FROM u, range(1, 201) q(r)),
v AS (SELECT s, n, r, ((a + b * r % {_P} + c * r % {_P} * r % {_P}) % {_P})::DOUBLE / {_P} AS v FROM d), w AS (SELECT *, {" + ".join(f"(v >= {p})::INT" for p in ordered.POISSON)} AS w FROM v) SELECT r::INTEGER AS replicate, round(sum(w*s)/sum(w*n), 6) AS mean FROM w GROUP BY 1""")
def _(p):
    return r6(moments.bootstrap(p, "entity", "cap", 200))
