"""Queries for sources, sinks, guardrails, dates and the smaller scalar and aggregate operators of the inventory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from varve.functions import dates, scalars
from varve.operators import guards, ordered, quantiles
from varve.sources import files

from .panel_queries import KEYS, PANEL, QUERIES, SQL, firm_years, query, r6, table


def register(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


@register("src1_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")


@query("src3_boolean_predicate", "SELECT entity, year FROM panel WHERE (staf > 0) = true")
def _(p):
    return p.withColumn("active", F.col("staf") > 0).where("active = true").select("entity", "year")


@register("src6_year_chunk", PANEL + "SELECT entity, year, rev FROM panel WHERE year BETWEEN 1996 AND 1998 AND cell = 'PROMO'")
def _(spark, sf_dir):
    return firm_years(spark, sf_dir, 1996, 1998).where("cell = 'PROMO'").select("entity", "year", "rev")


@query("src8_id_list", "SELECT entity, year, rev FROM panel WHERE entity IN (SELECT DISTINCT entity FROM panel WHERE cap > 200)")
def _(p):
    return p.join(p.where("cap > 200").select("entity").distinct(), "entity", "left_semi").select("entity", "year", "rev")


@register("src10_restartable_chunks", PANEL + "SELECT year, count(*) AS n, max(rev) AS rev FROM panel WHERE year BETWEEN 1995 AND 1998 GROUP BY 1")
def _(spark, sf_dir):
    path, schema, years = files.scratch(spark, "chunks"), "year int, n long, rev double", [1995, 1996, 1997, 1998]
    part = lambda y: firm_years(spark, sf_dir, y, y).groupBy("year").agg(F.count("*").alias("n"), F.max("rev").alias("rev"))
    for y in years[:2]:
        files.append_lines(part(y), path)
    for y in files.missing_parts(spark, path, "year", years, schema):  # as a restarted job does
        files.append_lines(part(y), path)
    return spark.read.schema(schema).json(path)


@register("snk1_parquet", PANEL + "SELECT entity, year, rev FROM panel WHERE year = 1997")
def _(spark, sf_dir):
    path = files.scratch(spark, "parquet")
    files.write_parquet(firm_years(spark, sf_dir).select("entity", "year", "rev"), path, ["year"])
    return spark.read.parquet(path).where("year = 1997").select("entity", "year", "rev")


@register("snk3_csv", PANEL + "SELECT entity, year, CASE WHEN staf > 0 THEN staf END AS staf, CASE WHEN year = 1996 THEN '' ELSE cell END AS cell FROM panel")
def _(spark, sf_dir):
    path = files.scratch(spark, "csv")
    files.write_csv(firm_years(spark, sf_dir).select("entity", "year", F.when(F.col("staf") > 0, F.col("staf")).alias("staf"), F.when(F.col("year") == 1996, "").otherwise(F.col("cell")).alias("cell")), path)
    return files.read_csv(spark, path, "entity long, year int, staf double, cell string")


@register("src4_csv_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_totalprice FROM orders")
def _(spark, sf_dir):
    path = files.scratch(spark, "dates")
    files.write_csv(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), "o_totalprice"), path)
    return files.read_csv(spark, path, "o_orderkey long, day date, o_totalprice double")


@register("snk4_json", PANEL + "SELECT entity, year, CASE WHEN staf > 0 THEN staf END AS staf FROM panel")
def _(spark, sf_dir):
    path = files.scratch(spark, "json")
    files.write_json(firm_years(spark, sf_dir).select("entity", "year", F.when(F.col("staf") > 0, F.col("staf")).otherwise(F.lit(float("nan"))).alias("staf")), path)
    return spark.read.schema("entity long, year int, staf double").json(path)


@register("snk6_append_lines", PANEL + "SELECT entity, year FROM panel WHERE year IN (1995, 1996)")
def _(spark, sf_dir):
    path = files.scratch(spark, "lines")
    for y in (1995, 1996):
        files.append_lines(firm_years(spark, sf_dir, y, y).select("entity", "year"), path)
    return spark.read.schema("entity long, year int").json(path)


@query("prj1_assign", "SELECT entity, year, round(rev - mate, 2) AS margin FROM panel")
def _(p):
    return p.withColumn("margin", F.round(F.col("rev") - F.col("mate"), 2)).select("entity", "year", "margin")


@query("prj2_rename_roles", "SELECT entity AS gvkey, year, rev AS rev_lvl, cap AS cap_lvl, mate AS mat_lvl FROM panel")
def _(p):
    return p.withColumnsRenamed({"entity": "gvkey", "rev": "rev_lvl", "cap": "cap_lvl", "mate": "mat_lvl"}).select("gvkey", "year", "rev_lvl", "cap_lvl", "mat_lvl")


@query("prj3_keep_list", "SELECT entity, year, rev FROM panel")
def _(p):
    return p.select(*dict.fromkeys(["entity", "year", "rev", "year", "entity"]))


@query("flt8_guardrails", "SELECT cell, count(*) AS n FROM panel GROUP BY 1 HAVING count(*) >= 10")
def _(p):
    cells = guards.require_rows(guards.require_columns(p, ["cell", "rev"]), 100, "panel").groupBy("cell").agg(F.count("*").alias("n"))
    return guards.require_rows(cells.where("n >= 10"), 1, "cells")


@query("jn12_exact_gap", "SELECT a.entity, a.year, b.rev AS rev_before FROM panel a LEFT JOIN panel b ON b.entity = a.entity AND b.year = a.year - 2")
def _(p):
    return p.join(p.select("entity", (F.col("year") + 2).alias("year"), F.col("rev").alias("rev_before")), ["entity", "year"], "left").select("entity", "year", "rev_before")


@query("jn19_several_plans", "SELECT market, year, max(rev) AS rev, round(sum(cap), 2) AS cap, max(mate) AS mate FROM panel GROUP BY 1, 2")
def _(p):
    parts = [p.groupBy(*KEYS).agg(a) for a in (F.max("rev").alias("rev"), F.round(F.sum("cap"), 2).alias("cap"), F.max("mate").alias("mate"))]
    return guards.join_all(parts[0], parts[1:], KEYS)


@query("jn1_validated", "SELECT entity, year, m.n FROM panel JOIN (SELECT market, year, count(*) AS n FROM panel GROUP BY 1, 2) m USING (market, year)")
def _(p):
    return guards.join_many_to_one(p, p.groupBy(*KEYS).agg(F.count("*").alias("n")), KEYS).select("entity", "year", "n")


@query("jn5_all_matched", "SELECT market, year, max(rev) AS rev, count(*) AS n FROM panel GROUP BY 1, 2")
def _(p):
    return guards.join_matched(p.groupBy(*KEYS).agg(F.max("rev").alias("rev")), p.groupBy(*KEYS).agg(F.count("*").alias("n")), KEYS)


@register("prv2_same_input", PANEL + "SELECT year, count(*) AS n FROM panel GROUP BY 1")
def _(spark, sf_dir):
    """The first step records its input's fingerprint; the second reads the input anew and is refused unless it is the same."""
    path, small = files.scratch(spark, "recorded"), lambda: firm_years(spark, sf_dir).select("entity", "year", "cell")
    guards.record(small(), path)
    return guards.require_recorded(small(), path).groupBy("year").agg(F.count("*").alias("n"))


@query("agg22_top_fraction", "r AS (SELECT market, year, rev, row_number() OVER (PARTITION BY market, year ORDER BY rev DESC) AS rk, count(*) OVER (PARTITION BY market, year) AS n FROM panel)\nSELECT market, year, round(coalesce(sum(CASE WHEN rk <= ceil(0.25*n) THEN rev END), 0)/sum(rev), 6) AS top, 0.0::DOUBLE AS none, 1.0::DOUBLE AS whole FROM r GROUP BY 1, 2")
def _(p):
    w = Window.partitionBy(*KEYS)
    r = p.withColumns({"rk": F.row_number().over(w.orderBy(F.desc("rev"))), "n": F.count("*").over(w)})
    share = lambda f: F.coalesce(F.sum(F.when(F.col("rk") <= F.ceil(F.lit(f) * F.col("n")), F.col("rev"))), F.lit(0.0)) / F.sum("rev")
    return r6(r.groupBy(*KEYS).agg(share(0.25).alias("top"), share(0.0).alias("none"), share(1.0).alias("whole")))


@query("agg39_distribution", "v AS (SELECT year, mate/rev AS s FROM panel WHERE rev > 0)\nSELECT year, count(*) AS n, round(avg(s), 6) AS mean, round(quantile_cont(s, 0.5), 6) AS p50, round(quantile_cont(s, 0.9), 6) AS p90, round(avg(CASE WHEN s > 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS above_one FROM v GROUP BY 1")
def _(p):
    s = p.where("rev > 0").select("year", (F.col("mate") / F.col("rev")).alias("s"))
    q = quantiles.exact(s, {"p50": ("s", 0.5), "p90": ("s", 0.9)}, ["year"])
    return r6(s.groupBy("year").agg(F.count("*").alias("n"), F.avg("s").alias("mean"), F.avg((F.col("s") > 1).cast("double")).alias("above_one")).join(q, "year"))


@query("agg42_reference_scale", "v AS (SELECT cell, ln(rev) AS y, ln(cap) AS k, ln(mate) AS m, mate/rev AS s, rev, cap FROM panel WHERE rev > 0 AND cap > 0 AND mate > 0)\nSELECT cell, count(*) AS n, round(avg(y), 6) AS y_mean, round(stddev_samp(y), 6) AS y_sd, round(avg(k), 6) AS k_mean, round(stddev_samp(k), 6) AS k_sd, round(avg(m), 6) AS m_mean, round(stddev_samp(m), 6) AS m_sd, round(quantile_cont(y, 0.1), 6) AS y_p10, round(quantile_cont(y, 0.5), 6) AS y_p50, round(quantile_cont(y, 0.9), 6) AS y_p90, round(avg(s), 6) AS s_mean, round(quantile_cont(s, 0.5), 6) AS s_p50, round(corr(y, k), 6) AS c_yk, round(corr(y, m), 6) AS c_ym, round(regr_slope(y, k), 6) AS scale, round(regr_intercept(y, k), 6) AS scale_intercept, round(regr_r2(y, k), 6) AS scale_r2, round(avg(y) - avg(s)*avg(m) - (1-avg(s))*avg(k), 6) AS cobb_douglas, round(sum(s*rev)/sum(rev), 6) AS s_weighted, round(max(rev)/sum(rev), 6) AS top_share FROM v GROUP BY 1")
def _(p):
    v = p.where("rev > 0 and cap > 0 and mate > 0").select("cell", F.ln("rev").alias("y"), F.ln("cap").alias("k"), F.ln("mate").alias("m"), (F.col("mate") / F.col("rev")).alias("s"), "rev")
    levels = quantiles.exact(v, {"y_p10": ("y", 0.1), "y_p50": ("y", 0.5), "y_p90": ("y", 0.9), "s_p50": ("s", 0.5)}, ["cell"])
    moments = [x for c in "ykm" for x in (F.avg(c).alias(f"{c}_mean"), F.stddev(c).alias(f"{c}_sd"))]
    constant = F.avg("y") - F.avg("s") * F.avg("m") - (1 - F.avg("s")) * F.avg("k")
    return r6(v.groupBy("cell").agg(
        F.count("*").alias("n"), *moments, F.avg("s").alias("s_mean"),
        F.corr("y", "k").alias("c_yk"), F.corr("y", "m").alias("c_ym"), F.regr_slope("y", "k").alias("scale"), F.regr_intercept("y", "k").alias("scale_intercept"), F.regr_r2("y", "k").alias("scale_r2"),
        constant.alias("cobb_douglas"), (F.sum(F.col("s") * F.col("rev")) / F.sum("rev")).alias("s_weighted"), (F.max("rev") / F.sum("rev")).alias("top_share"),
    ).join(levels, "cell"))


@query("agg19_gaussian_copula", "r AS (SELECT cell, rank() OVER (PARTITION BY cell ORDER BY rev) AS a, rank() OVER (PARTITION BY cell ORDER BY mate) AS b FROM panel)\nSELECT cell, round(2*sin(pi()*corr(a, b)/6), 6) AS rho FROM r GROUP BY 1")
def _(p):
    p = ordered.value_ranks(ordered.value_ranks(p.select("cell", "rev", "mate"), ["cell"], "rev", "a"), ["cell"], "mate", "b")
    return r6(p.groupBy("cell").agg((2 * F.sin(F.lit(3.141592653589793) * F.corr("a", "b") / 6)).alias("rho")))


@query("agg34_pivot_statistics", "SELECT market, round(avg(CASE WHEN year=1996 THEN rev END), 4) AS y1996_mean, round(quantile_cont(CASE WHEN year=1996 THEN rev END, 0.5), 4) AS y1996_median, count(CASE WHEN year=1996 THEN 1 END) AS y1996_size, round(avg(CASE WHEN year=1997 THEN rev END), 4) AS y1997_mean, round(quantile_cont(CASE WHEN year=1997 THEN rev END, 0.5), 4) AS y1997_median, count(CASE WHEN year=1997 THEN 1 END) AS y1997_size FROM panel GROUP BY 1")
def _(p):
    made = p.groupBy("market").pivot("year", [1996, 1997]).agg(F.round(F.avg("rev"), 4).alias("mean"), F.round(F.percentile("rev", F.lit(0.5)), 4).alias("median"), F.count("rev").alias("size"))
    return made.select("market", *(F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(f"y{c}") if c.endswith("size") else F.col(f"`{c}`").alias(f"y{c}") for c in made.columns[1:]))


@query("agg45_price_index", "SELECT market, year, round(power(sum(power(mate/cap, -0.5::DOUBLE)), -2.0::DOUBLE), 6) AS price FROM panel GROUP BY 1, 2")
def _(p):
    return r6(p.groupBy(*KEYS).agg(F.pow(F.sum(F.pow(F.col("mate") / F.col("cap"), F.lit(-0.5))), F.lit(-2.0)).alias("price")))


@query("agg53_bottom_bridge", "SELECT round(sum(cap*mate/rev)/sum(cap), 6) AS mean FROM (SELECT cap, mate, rev FROM panel ORDER BY rev, entity, year LIMIT 50)")
def _(p):
    return r6(p.orderBy("rev", "entity", "year").limit(50).agg((F.sum(F.col("cap") * F.col("mate") / F.col("rev")) / F.sum("cap")).alias("mean")))


@query("ord1_mixed_sort", "SELECT entity, year, row_number() OVER (PARTITION BY cell ORDER BY year DESC, rev, entity) AS place FROM panel")
def _(p):
    p = p.select("entity", "year", "cell", "rev")
    return ordered.running(p, ["cell"], [F.desc("year"), F.col("rev"), F.col("entity")]).select("entity", "year", F.col("rank").alias("place"))


@query("ord6_partial_selection", "SELECT market, year, sum(top) AS top FROM (SELECT market, year, CASE WHEN row_number() OVER (PARTITION BY market, year ORDER BY cap DESC, entity) <= 3 THEN cap ELSE 0 END AS top FROM panel) GROUP BY 1, 2")
def _(p):
    # A rank filter: each task keeps the first three of a group before the shuffle.
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("cap"), "entity"))
    return p.select(*KEYS, "entity", "cap", rank.alias("rk")).where("rk <= 3").groupBy(*KEYS).agg(F.sum("cap").alias("top"))


@query("set1_union_all", "SELECT entity, year FROM panel WHERE year <= 1996 UNION ALL SELECT entity, year FROM panel WHERE cap > 50")
def _(p):
    return p.where("year <= 1996").select("entity", "year").unionByName(p.where("cap > 50").select("entity", "year"))


@query("mth6_finite", "SELECT count(*) AS n, count(*) FILTER (WHERE staf > 0) AS finite FROM panel")
def _(p):
    x = F.when(F.col("staf") > 0, F.ln("staf")).otherwise(F.lit(float("nan")))
    return p.select(x.alias("x")).agg(F.count("*").alias("n"), F.count_if(~F.isnan("x") & (F.abs("x") < float("inf"))).alias("finite"))


@query("str3_group_key", "SELECT cell || '_' || year AS k, count(*) AS n FROM panel GROUP BY 1")
def _(p):
    return p.groupBy(F.concat_ws("_", "cell", F.col("year").cast("string")).alias("k")).agg(F.count("*").alias("n"))


@query("str5_percentile_labels", "SELECT 'p05' AS label, round(quantile_cont(rev, 0.05), 6) AS v FROM panel UNION ALL SELECT 'p50', round(quantile_cont(rev, 0.5), 6) FROM panel UNION ALL SELECT 'p99', round(quantile_cont(rev, 0.99), 6) FROM panel")
def _(p):
    levels = [0.05, 0.5, 0.99]
    q = quantiles.linear(p, "rev", [], levels).select(F.array("q0", "q1", "q2").alias("q"))
    rows = q.select(F.explode(F.arrays_zip(F.array(*map(F.lit, levels)).alias("a"), F.col("q"))).alias("r"))
    return r6(rows.select(scalars.percent_label("p", F.col("r.a")).alias("label"), F.col("r.q").alias("v")))


@register("dt1_dates", "SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS first_day, CAST(min(year(o_orderdate)) AS INTEGER) AS first_year, CAST(max(year(o_orderdate)) - min(year(o_orderdate)) AS INTEGER) AS span FROM orders GROUP BY 1")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    return o.groupBy("o_custkey").agg(F.min("day").alias("first_day"), F.min(F.year("day")).alias("first_year"), (F.max(F.year("day")) - F.min(F.year("day"))).alias("span"))


@register("dt2_splice", """WITH a AS (SELECT year(day) AS year, avg(v) AS v FROM (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS v FROM orders GROUP BY 1) GROUP BY 1 HAVING year(day) <= 1995),
b AS (SELECT year(day) AS year, avg(v) AS v FROM (SELECT CAST(l_shipdate AS DATE) AS day, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1) GROUP BY 1), k AS (SELECT a.v/b.v AS factor, a.v-b.v AS spread FROM a JOIN b USING (year) WHERE year = 1995)
SELECT CAST(year AS INTEGER) AS year, 'first' AS source, round(a.v, 4) AS v, round(a.v-b.v, 4) AS spread FROM a LEFT JOIN b USING (year) UNION ALL SELECT CAST(year AS INTEGER), 'second', round(b.v*factor, 4), round(spread, 4) FROM b, k WHERE year > 1995""")
def _(spark, sf_dir):
    """Two daily series as annual means; after the first one's last year the second goes on, scaled to it there, with the spread of that year."""
    daily = lambda t, day, v: table(spark, sf_dir, t).groupBy(F.col(day).cast("date").alias("day")).agg(F.avg(v).alias("v")).groupBy(F.year("day").alias("year")).agg(F.avg("v").alias("v"))
    return dates.splice(daily("orders", "o_orderdate", "o_totalprice").where("year <= 1995"), daily("lineitem", "l_shipdate", "l_extendedprice"), 1995)


@query("dt3_odd_years", "SELECT year % 2 = 1 AS odd, count(*) AS n, round(avg(rev), 4) AS rev FROM panel GROUP BY 1")
def _(p):
    return p.groupBy((F.col("year") % 2 == 1).alias("odd")).agg(F.count("*").alias("n"), F.round(F.avg("rev"), 4).alias("rev"))


@query("arr1_repeat", "SELECT entity, CAST(unnest(range(1, 4)) AS INTEGER) AS slot FROM (SELECT DISTINCT entity FROM panel)")
def _(p):
    return p.select("entity").distinct().select("entity", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("slot"))


@query("arr2_harmonic_mean", "SELECT market, year, round(count(*)/sum(1/cap), 6) AS h FROM panel GROUP BY 1, 2")
def _(p):
    return r6(p.groupBy(*KEYS).agg((F.count("*") / F.sum(1 / F.col("cap"))).alias("h")))


@query("arr3_interpolation", "SELECT entity, year, round(CASE WHEN cap <= 10 THEN 1.0::DOUBLE WHEN cap <= 50 THEN 1 + (cap-10)*0.025::DOUBLE WHEN cap <= 100 THEN 2 + (cap-50)*0.02::DOUBLE ELSE 3 END, 6) AS v FROM panel")
def _(p):
    return r6(p.select("entity", "year", scalars.interpolate(F.col("cap"), [(10.0, 1.0), (50.0, 2.0), (100.0, 3.0)]).alias("v")))


@query("jsn1_fingerprint", "SELECT entity, year, '{\"cell\":\"' || cell || '\",\"market\":\"' || market || '\",\"year\":' || year || '}' AS json, sha256('{\"cell\":\"' || cell || '\",\"market\":\"' || market || '\",\"year\":' || year || '}') AS fingerprint, cell, market FROM panel")
def _(p):
    """Encoded with sorted keys, fingerprinted, and decoded again."""
    named = ("market", "cell", "year")
    made = p.select("entity", "year", F.to_json(F.struct(*(F.col(c) for c in sorted(named)))).alias("json")).withColumn("fingerprint", F.sha2(F.col("json").cast("binary"), 256))
    back = made.withColumn("back", F.from_json("json", "cell string, market string, year int"))
    return back.where("back.year = year").select("entity", "year", "json", "fingerprint", "back.cell", "back.market")


@query("smp4_partial_reverse", "r AS (SELECT market, year, entity, rev, row_number() OVER (PARTITION BY market, year ORDER BY rev, entity) AS rk, count(*) OVER (PARTITION BY market, year) AS n FROM panel)\nSELECT a.market, a.year, a.entity, b.rev FROM r a JOIN r b ON a.market = b.market AND a.year = b.year AND b.rk = CASE WHEN a.rk <= round(0.5*a.n) THEN round(0.5*a.n) + 1 - a.rk ELSE a.rk END")
def _(p):
    w = Window.partitionBy(*KEYS)
    r = p.select(*KEYS, "entity", "rev", F.row_number().over(w.orderBy("rev", "entity")).alias("rk"), F.count("*").over(w).alias("n"))
    some = F.round(F.lit(0.5) * F.col("n")).cast("int")  # the slots that change places, in an order fixed by rank
    moved = r.withColumn("rk", F.when(F.col("rk") <= some, some + 1 - F.col("rk")).otherwise(F.col("rk"))).select(*KEYS, "entity", "rk")
    return moved.join(r.select(*KEYS, "rk", "rev"), [*KEYS, "rk"]).drop("rk")
