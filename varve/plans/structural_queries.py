"""Queries for structural estimators, scenarios, accounting aggregates and validation over the proxy panel."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from varve.operators import estimate, moments, ordered, panel, quantiles
from varve.sources import files

from .panel_queries import QUERIES, firm_years, query, r6

V = "v AS (SELECT *, ln(rev) AS y, ln(cap) AS x, ln(mate) AS z FROM panel WHERE rev > 0 AND cap > 0 AND mate > 0)"


def logged(p):
    return p.where("rev > 0 and cap > 0 and mate > 0").withColumns({"y": F.ln("rev"), "x": F.ln("cap"), "z": F.ln("mate")})


def production(p):
    """k, m, l (centred in the cell), s (log share) and a year's own columns; rows without labour are left out."""
    logs = logged(p).where("staf > 0").withColumns({"k": F.col("x"), "m": F.col("z"), "l": F.ln("staf"), "s": F.col("z") - F.col("y")})
    return estimate.centred(logs, "cell")


@query("agg8_weighted_median", "c AS (SELECT market, rev, sum(cap) OVER (PARTITION BY market ORDER BY rev)/sum(cap) OVER (PARTITION BY market) AS c FROM panel WHERE cap > 0)\nSELECT market, min(rev) AS med FROM c WHERE c >= 0.5 - 1e-12 GROUP BY 1")
def _(p):
    return quantiles.weighted(p, "rev", "cap", ["market"], 0.5).withColumnRenamed("q", "med")


@query("agg11_weighted_deviation", "m AS (SELECT *, sum(cap*rev) OVER (PARTITION BY cell)/sum(cap) OVER (PARTITION BY cell) AS mu FROM panel)\nSELECT cell, round(sqrt(sum(cap*(rev-mu)*(rev-mu))/sum(cap)), 4) AS sd FROM m GROUP BY 1")
def _(p):
    d = p.withColumn("d", moments.demean("rev", ["cell"], "cap"))
    return d.groupBy("cell").agg(F.round(F.sqrt(moments.weighted_mean(F.col("d") * F.col("d"), "cap")), 4).alias("sd"))


@query("agg18_residual_correlation", V + ", b AS (SELECT cell, regr_slope(y, x) AS by_, regr_slope(z, x) AS bz, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM v GROUP BY 1)\nSELECT cell, round(corr(y-my-by_*(x-mx), z-mz-bz*(x-mx)), 6) AS r FROM v JOIN b USING (cell) GROUP BY 1")
def _(p):
    v = logged(p)
    line = v.groupBy("cell").agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"), *(F.regr_slope(c, "x").alias(f"b{c}") for c in "yz"))
    rest = lambda c: F.col(c) - F.col(f"m{c}") - F.col(f"b{c}") * (F.col("x") - F.col("mx"))
    return r6(v.join(line, "cell").select("cell", rest("y").alias("a"), rest("z").alias("b")).groupBy("cell").agg(F.corr("a", "b").alias("r")))


@query("agg20_hhi", "s AS (SELECT market, year, rev/sum(rev) OVER (PARTITION BY market, year) AS s FROM panel)\nSELECT market, year, round(sum(s*s), 6) AS hhi FROM s GROUP BY 1, 2")
def _(p):
    s = p.select("market", "year", (F.col("rev") / F.sum("rev").over(Window.partitionBy("market", "year"))).alias("s"))
    return r6(s.groupBy("market", "year").agg(F.sum(F.col("s") * F.col("s")).alias("hhi")))


@query("agg28_tail_block", """c AS (SELECT unnest([0.02::DOUBLE, 0.05, 0.1]) AS share), r AS (SELECT year, share, ln(rev) AS lx, row_number() OVER (PARTITION BY year, share ORDER BY rev DESC, entity) AS rk, count(*) OVER (PARTITION BY year, share) AS n FROM panel, c WHERE rev > 0),
t AS (SELECT * FROM r WHERE rk <= greatest(floor(n*share)::BIGINT, 20)), u AS (SELECT *, min(lx) OVER w AS low, count(*) OVER w AS kk FROM t WINDOW w AS (PARTITION BY year, share))
SELECT year, share, count(*) AS k, round(-regr_slope(ln(rk-0.5), lx), 6) AS zipf, round(-regr_slope(ln(rk-0.5), lx)*sqrt(2.0/count(*)), 6) AS se, round(1/avg(CASE WHEN rk < kk THEN lx-low END), 6) AS hill FROM u GROUP BY 1, 2""")
def _(p):
    # Ranked once; a cutoff only marks ranks.
    w = Window.partitionBy("year")
    least = lambda share: F.col("rk") <= F.greatest(F.floor(F.col("n") * share), F.lit(20))
    ranked = p.where("rev > 0").select("year", F.ln("rev").alias("lx"), F.row_number().over(w.orderBy(F.desc("rev"), "entity")).alias("rk"), F.count("*").over(w).alias("n"))
    top = ranked.where(least(0.1)).withColumn("share", F.explode(F.array(*(F.lit(x) for x in (0.02, 0.05, 0.1))))).where(least(F.col("share")))
    w = Window.partitionBy("year", "share")
    top = top.withColumns({"low": F.min("lx").over(w), "kk": F.count("*").over(w)})
    zipf = -F.regr_slope(F.ln(F.col("rk") - 0.5), F.col("lx"))
    hill = 1 / F.avg(F.when(F.col("rk") < F.col("kk"), F.col("lx") - F.col("low")))
    return r6(top.groupBy("year", "share").agg(F.count("*").alias("k"), zipf.alias("zipf"), (zipf * F.sqrt(2 / F.count("*"))).alias("se"), hill.alias("hill")))


@query("agg32_shrink_clip", "m AS (SELECT cell, mate/rev AS a, avg(mate/rev) OVER (PARTITION BY cell) AS mu FROM panel), s AS (SELECT *, mu + 0.5*(a-mu) AS b FROM m)\nSELECT cell, round(avg(greatest(0.3, least(b, 0.9))), 6) AS mean, round(avg(CASE WHEN b < 0.3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS low_mass, round(avg(CASE WHEN b > 0.9 THEN 1.0::DOUBLE ELSE 0 END), 6) AS high_mass FROM s GROUP BY 1")
def _(p):
    s = p.select("cell", (F.col("mate") / F.col("rev")).alias("a"))
    s = s.join(s.groupBy("cell").agg(F.avg("a").alias("mu")), "cell").withColumn("b", F.col("mu") + 0.5 * (F.col("a") - F.col("mu")))
    return r6(s.groupBy("cell").agg(F.avg(F.greatest(F.lit(0.3), F.least("b", F.lit(0.9)))).alias("mean"), F.avg((F.col("b") < 0.3).cast("double")).alias("low_mass"), F.avg((F.col("b") > 0.9).cast("double")).alias("high_mass")))


@query("agg37_coverage", "SELECT year, cell, round(avg(CASE WHEN staf IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS present, round(avg(CASE WHEN staf > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS positive FROM panel GROUP BY 1, 2")
def _(p):
    return r6(p.groupBy("year", "cell").agg(F.avg(F.col("staf").isNotNull().cast("double")).alias("present"), F.avg(F.coalesce((F.col("staf") > 0).cast("double"), F.lit(0.0))).alias("positive")))


@query("agg41_window_shares", "m AS (SELECT cell, market, avg(rev-mate) AS va, avg(staf/rev) AS s FROM panel WHERE year BETWEEN 1996 AND 1999 GROUP BY 1, 2)\nSELECT cell, round(CASE WHEN sum(va) > 0 THEN sum(va*s)/sum(va) ELSE avg(s) END, 6) AS share FROM m GROUP BY 1")
def _(p):
    m = p.where("year between 1996 and 1999").groupBy("cell", "market").agg(F.avg(F.col("rev") - F.col("mate")).alias("va"), F.avg(F.col("staf") / F.col("rev")).alias("s"))
    return r6(m.groupBy("cell").agg(F.when(F.sum("va") > 0, moments.weighted_mean("s", "va")).otherwise(F.avg("s")).alias("share")))


@query("agg44_two_way_grid", """b AS (SELECT rev, mate, ntile(5) OVER (PARTITION BY year ORDER BY rev, entity) AS size_bin, ntile(4) OVER (PARTITION BY year ORDER BY rev/mate, entity) AS markup_bin FROM panel)
SELECT size_bin::INTEGER AS size_bin, markup_bin::INTEGER AS markup_bin, count(*) AS n, round(sum(rev)/(SELECT sum(rev) FROM b), 6) AS sales_share, round(sum(mate)/(SELECT sum(mate) FROM b), 6) AS cost_share, round(sum(rev)/sum(mate), 6) AS wedge FROM b GROUP BY 1, 2""")
def _(p):
    b = p.select("year", "entity", "rev", "mate", (F.col("rev") / F.col("mate")).alias("mu"))
    for name, by, k in (("size_bin", "rev", 5), ("markup_bin", "mu", 4)):
        b = ordered.running(b, ["year"], [F.col(by), F.col("entity")]).withColumn(name, ordered.tiles(k)).drop("rank", "rank_total")
    grid = b.groupBy("size_bin", "markup_bin").agg(F.count("*").alias("n"), F.sum("rev").alias("r"), F.sum("mate").alias("c"))
    all_of = lambda c: F.sum(c).over(Window.partitionBy())  # noqa: E731  (20 rows)
    return r6(grid.select("size_bin", "markup_bin", "n", (F.col("r") / all_of("r")).alias("sales_share"), (F.col("c") / all_of("c")).alias("cost_share"), (F.col("r") / F.col("c")).alias("wedge")))


@query("agg46_resources", "SELECT year, round(sum(rev), 4) AS q, round(sum(mate), 4) AS m, round(sum(staf), 4) AS l, round(sum(rev-mate-staf), 4) AS profit, round(sum(rev)/sum(mate+staf), 6) AS markup FROM panel GROUP BY 1")
def _(p):
    cost = F.col("mate") + F.col("staf")
    total = lambda c, n: F.round(F.sum(c), 4).alias(n)
    return p.groupBy("year").agg(total("rev", "q"), total("mate", "m"), total("staf", "l"), total(F.col("rev") - cost, "profit"), F.round(F.sum("rev") / F.sum(cost), 6).alias("markup"))


@query("agg48_spread_placement", "m AS (SELECT year, cell, rev/mate AS mu, mate/sum(mate) OVER (PARTITION BY year) AS w, count(*) OVER (PARTITION BY year) AS n, avg(rev/mate) OVER (PARTITION BY year) AS mean FROM panel)\nSELECT year, round(sum(w*mu), 6) AS total, round(max(mean), 6) AS spread, round(sum((w-1.0/n)*(mu-mean)), 6) AS placement FROM m GROUP BY 1")
def _(p):
    m = p.select("year", (F.col("rev") / F.col("mate")).alias("mu"), "mate")
    years = m.groupBy("year").agg(F.sum("mate").alias("c"), F.count("*").alias("n"), F.avg("mu").alias("mean"))
    m = m.join(years, "year").withColumn("w", F.col("mate") / F.col("c"))
    return r6(m.groupBy("year").agg(F.sum(F.col("w") * F.col("mu")).alias("total"), F.max("mean").alias("spread"), F.sum((F.col("w") - 1.0 / F.col("n")) * (F.col("mu") - F.col("mean"))).alias("placement")))


@query("agg52_income_split", "b AS (SELECT ntile(4) OVER (PARTITION BY year ORDER BY rev, entity) AS bin, * FROM panel), r(rate) AS (VALUES (0.05::DOUBLE), (0.12::DOUBLE))\nSELECT bin::INTEGER AS bin, rate, round(sum(staf)/sum(rev), 6) AS labour, round(rate*sum(cap)*100/sum(rev), 6) AS capital, round(1-(sum(staf)+sum(mate)+rate*sum(cap)*100)/sum(rev), 6) AS profit FROM b, r GROUP BY 1, 2")
def _(p):
    b = ordered.running(p, ["year"], [F.col("rev"), F.col("entity")]).withColumn("bin", ordered.tiles(4))
    b = b.groupBy("bin").agg(*(F.sum(c).alias(c) for c in ("rev", "staf", "mate", "cap"))).withColumn("rate", F.explode(F.array(F.lit(0.05), F.lit(0.12))))
    k = F.col("rate") * F.col("cap") * 100
    return r6(b.select("bin", "rate", (F.col("staf") / F.col("rev")).alias("labour"), (k / F.col("rev")).alias("capital"), (1 - (F.col("staf") + F.col("mate") + k) / F.col("rev")).alias("profit")))


@query("agg55_identities", "s AS (SELECT year, sum(rev)/(SELECT sum(rev) FROM panel) AS s, count(*) AS n FROM panel GROUP BY 1)\nSELECT abs(sum(s)-1) < 1e-9 AS shares_add_up, sum(n) = (SELECT count(*) FROM panel) AS counts_add_up FROM s")
def _(p):
    years = p.groupBy("year").agg(F.sum("rev").alias("r"), F.count("*").alias("n"))
    total = p.agg(F.sum("rev").alias("tr"), F.count("*").alias("tn"))
    one = years.agg(F.sum("r").alias("r"), F.sum("n").alias("n"))
    return one.join(total).select((F.abs(F.col("r") / F.col("tr") - 1) < 1e-9).alias("shares_add_up"), (F.col("n") == F.col("tn")).alias("counts_add_up"))


@query("agg57_sector_export", "SELECT market, round(avg(mate/rev), 6) AS mean, count(*) AS n, count(DISTINCT year) AS years FROM panel WHERE year BETWEEN 1996 AND 2000 GROUP BY 1")
def _(p):
    return r6(p.where("year between 1996 and 2000").groupBy("market").agg(F.avg(F.col("mate") / F.col("rev")).alias("mean"), F.count("*").alias("n"), F.countDistinct("year").alias("years")))


@query("agg59_hybrid", "m AS (SELECT market, avg(mate/rev) AS a FROM panel GROUP BY 1 HAVING count(*) >= 60), t AS (SELECT avg(mate/rev) AS t FROM panel)\nSELECT entity, year, round(coalesce(a, t), 6) AS alpha, CASE WHEN a IS NULL THEN 'all' ELSE 'market' END AS source FROM panel LEFT JOIN m USING (market), t")
def _(p):
    a = F.avg(F.col("mate") / F.col("rev"))
    m = p.groupBy("market").agg(a.alias("a"), F.count("*").alias("n")).where("n >= 60").drop("n")
    joined = p.select("entity", "year", "market").join(m, "market", "left").join(p.agg(a.alias("t")))
    return r6(joined.select("entity", "year", F.coalesce("a", "t").alias("alpha"), F.when(F.col("a").isNull(), "all").otherwise("market").alias("source")))


@query("agg60_capital_share", "SELECT cell, round(1-avg(mate)/avg(rev), 6) AS phi, round(sum(cap)/(sum(cap)+sum(staf)), 6) AS capital FROM panel WHERE staf > 0 AND year >= 1997 GROUP BY 1")
def _(p):
    return r6(p.where("staf > 0 and year >= 1997").groupBy("cell").agg((1 - F.avg("mate") / F.avg("rev")).alias("phi"), (F.sum("cap") / (F.sum("cap") + F.sum("staf"))).alias("capital")))


@query("win4_group_totals", "SELECT entity, year, count(*) OVER w AS n, round(sum(rev) OVER w, 4) AS total, round(avg(rev) OVER w, 6) AS mean FROM panel WINDOW w AS (PARTITION BY market, year)")
def _(p):
    w = Window.partitionBy("market", "year")
    return p.select("entity", "year", F.count("*").over(w).alias("n"), F.round(F.sum("rev").over(w), 4).alias("total"), F.round(F.avg("rev").over(w), 6).alias("mean"))


@query("win5_rank", "SELECT entity, year, row_number() OVER (PARTITION BY market, year ORDER BY rev DESC, entity)::INTEGER AS rk FROM panel")
def _(p):
    return p.select("entity", "year", F.row_number().over(Window.partitionBy("market", "year").orderBy(F.desc("rev"), "entity")).alias("rk"))


@query("win8_both_ranks", "SELECT entity, year, row_number() OVER (PARTITION BY year ORDER BY cap, entity)::INTEGER AS up, row_number() OVER (PARTITION BY year ORDER BY cap DESC, entity)::INTEGER AS down FROM panel")
def _(p):
    p = p.select("entity", "year", "cap")
    up = ordered.running(p, ["year"], [F.col("cap"), F.col("entity")], rank="up")
    both = ordered.running(up.drop("up_total"), ["year"], [F.desc("cap"), F.col("entity")], rank="down")
    return both.select("entity", "year", F.col("up").cast("int").alias("up"), F.col("down").cast("int").alias("down"))


@query("win14_joint_and_sequential_trim", """q AS (SELECT *, quantile_cont(rev, [0.05, 0.95]) OVER (PARTITION BY cell) AS a, quantile_cont(mate/rev, [0.05, 0.95]) OVER (PARTITION BY cell) AS b FROM panel), s1 AS (SELECT * FROM q WHERE rev > a[1] AND rev < a[2]), s2 AS (SELECT cell, mate/rev AS s, quantile_cont(mate/rev, [0.05, 0.95]) OVER (PARTITION BY cell) AS c FROM s1)
SELECT 'joint' AS way, cell, count(*) AS n FROM s1 WHERE mate/rev > b[1] AND mate/rev < b[2] GROUP BY 2 UNION ALL SELECT 'sequential', cell, count(*) FROM s2 WHERE s > c[1] AND s < c[2] GROUP BY 2""")
def _(p):
    p = p.select("cell", "rev", (F.col("mate") / F.col("rev")).alias("s"))
    cuts = quantiles.exact(p, {f"{c}_{n}": (c, a) for c in ("rev", "s") for n, a in (("low", 0.05), ("high", 0.95))}, ["cell"])
    inside = lambda c: (F.col(c) > F.col(f"{c}_low")) & (F.col(c) < F.col(f"{c}_high"))
    joint = p.join(cuts, "cell").where(inside("rev") & inside("s"))
    apart = panel.trim_by(panel.trim_by(p, "rev", ["cell"], 0.05, 0.95), "s", ["cell"], 0.05, 0.95)
    count = lambda d, n: d.groupBy("cell").agg(F.count("*").alias("n")).select(F.lit(n).alias("way"), "cell", "n")
    return count(joint, "joint").unionByName(count(apart, "sequential"))


@query("jn2_composite_join", "SELECT a.entity, a.year, a.rev, b.mate FROM panel a LEFT JOIN (SELECT * FROM panel WHERE year >= 1998) b ON a.entity=b.entity AND a.year=b.year AND a.cell=b.cell AND a.market=b.market")
def _(p):
    keys = ["entity", "year", "cell", "market"]
    return p.select(*keys, "rev").join(p.where("year >= 1998").select(*keys, "mate"), keys, "left").select("entity", "year", "rev", "mate")


@query("jn3_inner_join", "SELECT entity, year, rev, staf FROM panel JOIN (SELECT entity, year FROM panel WHERE staf > 100) USING (entity, year)")
def _(p):
    return p.select("entity", "year", "rev", "staf").join(p.where("staf > 100").select("entity", "year"), ["entity", "year"])


@query("jn16_overlap", "a AS (SELECT year, avg(rev) AS u FROM panel WHERE year <= 1999 GROUP BY 1), b AS (SELECT year, avg(rev)*1.001 AS v FROM panel WHERE year >= 1996 GROUP BY 1)\nSELECT count(*) AS n, round(max(abs(u-v)), 4) AS gap FROM a JOIN b USING (year)")
def _(p):
    a = p.where("year <= 1999").groupBy("year").agg(F.avg("rev").alias("u"))
    b = p.where("year >= 1996").groupBy("year").agg((F.avg("rev") * 1.001).alias("v"))
    return a.join(b, "year").agg(F.count("*").alias("n"), F.round(F.max(F.abs(F.col("u") - F.col("v"))), 4).alias("gap"))


@query("jn20_key_adaptive", "f AS (SELECT entity, year, mate/rev AS t FROM panel WHERE year >= 1999), c AS (SELECT cell, year, avg(mate/rev) AS t FROM panel GROUP BY 1, 2)\nSELECT entity, year, round(coalesce(f.t, c.t), 6) AS theta FROM panel LEFT JOIN f USING (entity, year) LEFT JOIN c USING (cell, year)")
def _(p):
    t = F.col("mate") / F.col("rev")
    own = p.where("year >= 1999").select("entity", "year", t.alias("theta"))
    cells = p.groupBy("cell", "year").agg(F.avg(t).alias("theta"))
    return r6(panel.lookup_with_fallback(p.select("entity", "year", "cell"), [(own, ["entity", "year"]), (cells, ["cell", "year"])], "theta").select("entity", "year", "theta"))


@query("smp3_permutation", "o AS (SELECT entity, market, year, rev, row_number() OVER (PARTITION BY market, year ORDER BY entity) AS i, row_number() OVER (PARTITION BY market, year ORDER BY md5(concat('7-', entity, '-', year)), entity) AS j FROM panel)\nSELECT a.entity, a.year, b.rev FROM o a JOIN o b ON a.market=b.market AND a.year=b.year AND a.i=b.j")
def _(p):
    w = Window.partitionBy("market", "year")
    # A hash orders the draws, so they don't depend on partitions.
    draw = F.md5(F.concat_ws("-", F.lit("7"), "entity", "year"))
    rows = p.select("entity", "market", "year", "rev", F.row_number().over(w.orderBy("entity")).alias("i"), F.row_number().over(w.orderBy(draw, "entity")).alias("j"))
    return rows.select("entity", "market", "year", "i").join(rows.select("market", "year", F.col("j").alias("i"), "rev"), ["market", "year", "i"]).select("entity", "year", "rev")


@query("mth7_supply_elasticity", "SELECT entity, year, round(5*a/(a+5*(1-a)), 6) AS e FROM (SELECT entity, year, least(mate/rev, 0.95) AS a FROM panel)")
def _(p):
    a = F.least(F.col("mate") / F.col("rev"), F.lit(0.95))
    return r6(p.select("entity", "year", (5 * a / (a + 5 * (1 - a))).alias("e")))


@query("mth5_box_transform", "SELECT entity, year, round(ln((s+0.5)/(4-s)), 6) AS z FROM (SELECT entity, year, mate/rev AS s FROM panel) WHERE s > -0.5 AND s < 4")
def _(p):
    s = F.col("mate") / F.col("rev")
    return r6(p.select("entity", "year", s.alias("s")).where("s > -0.5D and s < 4").select("entity", "year", F.ln((F.col("s") + 0.5) / (4 - F.col("s"))).alias("z")))


@query("str2_pad", "SELECT DISTINCT entity, lpad(regexp_replace(trim(concat(' ', entity, '.0 ')), '\\.0$', ''), greatest(6, length(entity::VARCHAR))::INTEGER, '0') AS code FROM panel")
def _(p):
    code = F.regexp_replace(F.trim(F.concat(F.lit(" "), "entity", F.lit(".0 "))), r"\.0$", "")
    return p.select("entity").distinct().select("entity", F.when(F.length(code) < 6, F.lpad(code, 6, "0")).otherwise(code).alias("code"))


@query("str4_patterns", "SELECT DISTINCT market, regexp_full_match(market, 'Brand#[0-9]+') AS ok, array_to_string(regexp_extract_all(market, '[0-9]'), '') AS digits FROM panel")
def _(p):
    return p.select("market").distinct().select("market", F.col("market").rlike(r"^Brand#[0-9]+$").alias("ok"), F.array_join(F.regexp_extract_all("market", F.lit("[0-9]"), F.lit(0)), "").alias("digits"))


@query("est5_weighted_fixed_effects", V + """, m AS (SELECT cap AS w, y - sum(cap*y) OVER g/sum(cap) OVER g AS y, x - sum(cap*x) OVER g/sum(cap) OVER g AS x, z - sum(cap*z) OVER g/sum(cap) OVER g AS z FROM v WINDOW g AS (PARTITION BY market, year)),
s AS (SELECT count(*) AS n, sum(w*x*x) AS xx, sum(w*x*z) AS xz, sum(w*z*z) AS zz, sum(w*x*y) AS xy, sum(w*z*y) AS zy, sum(w*y*y) AS yy FROM m), b AS (SELECT *, (xy*zz-zy*xz)/(xx*zz-xz*xz) AS bx, (zy*xx-xy*xz)/(xx*zz-xz*xz) AS bz FROM s)
SELECT n, round(bx, 6) AS bx, round(bz, 6) AS bz, round((bx*xy+bz*zy)/yy, 6) AS r2, round(xy*xy/xx/yy, 6) AS r2_x, round(zy*zy/zz/yy, 6) AS r2_z FROM b""")
def _(p):
    d = logged(p).select(F.col("cap").alias("w"), *(moments.demean(c, ["market", "year"], "cap").alias(c) for c in "xyz"))
    s = d.agg(F.count("*").alias("n"), *(F.sum(F.col("w") * F.col(a) * F.col(b)).alias(a + b) for a, b in ("xx", "xz", "zz", "xy", "zy", "yy")))
    det = "(xx * zz - xz * xz)"
    b = s.withColumns({"bx": F.expr(f"(xy * zz - zy * xz) / {det}"), "bz": F.expr(f"(zy * xx - xy * xz) / {det}")})
    return r6(b.select("n", "bx", "bz", F.expr("(bx * xy + bz * zy) / yy").alias("r2"), F.expr("xy * xy / xx / yy").alias("r2_x"), F.expr("zy * zy / zz / yy").alias("r2_z")))


@query("est11_change_parts", """a AS (SELECT entity, mate/rev AS t0, staf/rev AS c0 FROM panel WHERE year = 1996), b AS (SELECT entity, mate/rev AS t1, staf/rev AS c1 FROM panel WHERE year = 1999), d AS (SELECT t1*c1-t0*c0 AS total, (t1-t0)*(c0+c1)/2 AS first, (c1-c0)*(t0+t1)/2 AS second FROM a JOIN b USING (entity))
SELECT count(*) AS n, round(avg(total), 6) AS total, round(avg(first), 6) AS first, round(avg(second), 6) AS second, round(var_samp(first)/var_samp(total), 6) AS share FROM d""")
def _(p):
    side = lambda y, k: p.where(f"year = {y}").select("entity", (F.col("mate") / F.col("rev")).alias(f"t{k}"), (F.col("staf") / F.col("rev")).alias(f"c{k}"))
    d = side(1996, 0).join(side(1999, 1), "entity").selectExpr("t1 * c1 - t0 * c0 AS total", "(t1 - t0) * (c0 + c1) / 2 AS first", "(c1 - c0) * (t0 + t1) / 2 AS second")
    return r6(d.agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in ("total", "first", "second")), (F.variance("first") / F.variance("total")).alias("share")))


@query("est12_level_regression", V + "\nSELECT cell, count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(sqrt((regr_syy(y, x)-regr_slope(y, x)*regr_sxy(y, x))/(count(*)-2)/regr_sxx(y, x)), 6) AS se FROM v GROUP BY 1 HAVING count(*) > 2")
def _(p):
    slope = F.regr_slope("y", "x")
    se = F.sqrt((F.regr_syy("y", "x") - slope * F.regr_sxy("y", "x")) / (F.count("*") - 2) / F.regr_sxx("y", "x"))
    return r6(logged(p).groupBy("cell").agg(F.count("*").alias("n"), slope.alias("slope"), F.regr_intercept("y", "x").alias("intercept"), se.alias("se")).where("n > 2"))


@query("est24_weighted_ols_hc1", V + """, c AS (SELECT cell, count(*) AS n, sum(cap) AS w, sum(cap*x)/sum(cap) AS mx, sum(cap*y)/sum(cap) AS my FROM v GROUP BY 1), d AS (SELECT cell, n, cap AS w, x-mx AS dx, y-my AS dy, mx, my FROM v JOIN c USING (cell)),
b AS (SELECT cell, sum(w*dx*dy)/sum(w*dx*dx) AS b, sum(w*dx*dx) AS q FROM d GROUP BY 1)
SELECT cell, max(n) AS n, round(max(b), 6) AS coef, round(sqrt(sum(w*w*(dy-b*dx)*(dy-b*dx)*dx*dx)*max(n)/(max(n)-2))/max(q), 6) AS se FROM d JOIN b USING (cell) GROUP BY 1""")
def _(p):
    return r6(estimate.wls(logged(p), "y", ["x"], ["cell"], "cap").where("term = 'x'").select("cell", "n", "coef", "se"))


@query("est5_two_regressors", V + """, m AS (SELECT cell, y-avg(y) OVER (PARTITION BY cell) AS y, x-avg(x) OVER (PARTITION BY cell) AS x, z-avg(z) OVER (PARTITION BY cell) AS z FROM v), s AS (SELECT cell, count(*) AS n, sum(x*x) AS xx, sum(x*z) AS xz, sum(z*z) AS zz, sum(x*y) AS xy, sum(z*y) AS zy FROM m GROUP BY 1)
SELECT cell, n, 'x' AS term, round((xy*zz-zy*xz)/(xx*zz-xz*xz), 6) AS coef FROM s UNION ALL SELECT cell, n, 'z', round((zy*xx-xy*xz)/(xx*zz-xz*xz), 6) FROM s""")
def _(p):
    return r6(estimate.wls(logged(p), "y", ["x", "z"], ["cell"]).where("term <> 'const'").select("cell", "n", "term", "coef"))


@query("sim10_variety", "SELECT market, year, round(pow(count(*), 5.0/4), 6) AS factor FROM panel GROUP BY 1, 2")
def _(p):
    return r6(p.groupBy("market", "year").agg(F.pow(F.count("*"), F.lit(1.25)).alias("factor")))


@query("sim27_two_by_two", "s AS (SELECT year, sum(rev/mate*cap)/sum(cap) AS w00, sum(rev/mate*cap*1.1)/sum(cap) AS w10, sum(rev/(mate+staf)*cap)/sum(cap) AS w01, sum(rev/(mate+staf)*cap*1.1)/sum(cap) AS w11 FROM panel GROUP BY 1)\nSELECT year, round(w11-w00, 6) AS total, round(w10-w00, 6) AS first, round(w01-w00, 6) AS second, round(w11-w10-w01+w00, 6) AS interaction FROM s")
def _(p):
    mean = lambda cost, k: moments.weighted_mean(F.col("rev") / cost * k, "cap")
    one, two = F.col("mate"), F.col("mate") + F.col("staf")
    s = p.groupBy("year").agg(mean(one, 1.0).alias("w00"), mean(one, 1.1).alias("w10"), mean(two, 1.0).alias("w01"), mean(two, 1.1).alias("w11"))
    return r6(s.selectExpr("year", "w11 - w00 AS total", "w10 - w00 AS first", "w01 - w00 AS second", "w11 - w10 - w01 + w00 AS interaction"))


@query("cal1_residuals", "d AS (SELECT cell, avg(mate/rev) AS m FROM panel GROUP BY 1), t AS (SELECT avg(mate/rev) AS t FROM panel)\nSELECT cell, round(2*(m-t)/(1+abs(t)), 6) AS residual FROM d, t")
def _(p):
    a = F.avg(F.col("mate") / F.col("rev"))
    return r6(p.groupBy("cell").agg(a.alias("m")).join(p.agg(a.alias("t"))).select("cell", (2 * (F.col("m") - F.col("t")) / (1 + F.abs("t"))).alias("residual")))


@query("cal8_validation_table", "d AS (SELECT cell, avg(rev) AS a FROM panel WHERE year <= 1998 GROUP BY 1), m AS (SELECT cell, avg(rev) AS b FROM panel WHERE year > 1998 GROUP BY 1)\nSELECT cell, round(a, 4) AS data, round(b, 4) AS model, round(b/a-1, 6) AS gap FROM d LEFT JOIN m USING (cell)")
def _(p):
    d = p.groupBy("cell").agg(F.avg(F.when(F.col("year") <= 1998, F.col("rev"))).alias("a"), F.avg(F.when(F.col("year") > 1998, F.col("rev"))).alias("b")).where("a is not null")
    return d.select("cell", F.round("a", 4).alias("data"), F.round("b", 4).alias("model"), F.round(F.col("b") / F.col("a") - 1, 6).alias("gap"))


@query("prv1_manifest", "SELECT year, count(*) AS n, count(DISTINCT entity) AS entities, min(entity) AS first, max(entity) AS last FROM panel GROUP BY 1")
def _(p):
    return p.groupBy("year").agg(F.count("*").alias("n"), F.countDistinct("entity").alias("entities"), F.min("entity").alias("first"), F.max("entity").alias("last"))


def est14_share_nls(spark, sf_dir):
    """The first step of the production function in each cell: the share equation by nonlinear least squares, from four starts."""
    p = files.kept(production(firm_years(spark, sf_dir)).select("cell", "k", "m", "l", "s"), "shares")
    return r6(estimate.share_nls(p, "cell", starts=estimate.share_starts(p, "cell")).drop("spread"))


def est16_elasticities(spark, sf_dir):
    p = production(firm_years(spark, sf_dir))
    return r6(estimate.elasticities(p, estimate.share_nls(p, "cell"), "cell").select("entity", "year", "melast", "kelast", "lelast"))


def est17_markov_gmm(spark, sf_dir):
    """The second step in each cell: five coefficients of capital and labour, net of the integrated elasticity."""
    p = production(firm_years(spark, sf_dir))
    net = estimate.elasticities(p, estimate.share_nls(p, "cell"), "cell").withColumn("a", F.col("y") - F.col("integral"))
    return r6(estimate.markov_gmm(panel.consecutive_lag(net, ["a", "k", "l"]), ["cell"]))


QUERIES |= {f.__name__: f for f in (est14_share_nls, est16_elasticities, est17_markov_gmm)}


@query("est7_iv", """g AS (SELECT entity, cell, ln(rev) AS y, ln(mate) AS x, ln(cap) AS k, CASE WHEN lag(year) OVER w = year-1 THEN ln(lag(mate) OVER w) END AS z FROM panel WHERE rev > 0 AND cap > 0 AND mate > 0 WINDOW w AS (PARTITION BY entity ORDER BY year)),
f AS (SELECT cell, regr_slope(y, k) AS sy, regr_intercept(y, k) AS ay, regr_slope(x, k) AS sx, regr_intercept(x, k) AS ax, regr_slope(z, k) AS sz, regr_intercept(z, k) AS az FROM g WHERE z IS NOT NULL GROUP BY 1),
d AS (SELECT cell, y-ay-sy*k AS y, x-ax-sx*k AS x, z-az-sz*k AS z FROM g JOIN f USING (cell) WHERE z IS NOT NULL),
b AS (SELECT cell, sum(z*y)/sum(z*x) AS b, sum(z*x)/sum(z*z) AS p, sum(z*x) AS zx, sum(z*z) AS zz FROM d GROUP BY 1)
SELECT cell, count(*) AS n, round(any_value(b), 4) AS beta, round(sqrt(sum((y-b*x)*(y-b*x)*z*z))/abs(any_value(zx)), 4) AS se, round(any_value(p*zz)/sqrt(sum((x-p*z)*(x-p*z)*z*z)), 2) AS first_t FROM d JOIN b USING (cell) GROUP BY 1""")
def _(p):
    lagged = panel.consecutive_lag(logged(p), ["z"])
    got = estimate.iv_exogenous(lagged, "y", "z", "l_z", ["x"], ["cell"])
    return got.select("cell", "n", F.round("beta", 4).alias("beta"), F.round("se", 4).alias("se"), F.round("first_t", 2).alias("first_t"))
