"""Queries for scans, projections, filters, joins, order, set operations and scalar functions over the proxy panel."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from varve.operators import panel

from .panel_queries import KEYS, query, r6


@query("src2_pushed_filter", "SELECT entity, year, rev FROM panel WHERE cell = 'PROMO'")
def _(p):
    return p.where("cell = 'PROMO'").select("entity", "year", "rev")


@query("src7_collapse", "SELECT entity, max(rev) AS rev, count(DISTINCT year) AS years, max(CASE WHEN year >= 1998 THEN cap END) AS late_cap FROM panel GROUP BY 1")
def _(p):
    return p.groupBy("entity").agg(F.max("rev").alias("rev"), F.countDistinct("year").alias("years"), F.max(F.when(F.col("year") >= 1998, F.col("cap"))).alias("late_cap"))


@query("src9_profile", "SELECT year, round(avg(CASE WHEN staf > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS positive, string_agg(DISTINCT cell, ',' ORDER BY cell) AS cells FROM panel GROUP BY 1")
def _(p):
    positive = F.avg(F.coalesce((F.col("staf") > 0).cast("double"), F.lit(0.0)))
    return r6(p.groupBy("year").agg(positive.alias("positive"), F.array_join(F.array_sort(F.collect_set("cell")), ",").alias("cells")))


@query("prj4_first_present", "SELECT entity, year, round(coalesce(nullif(staf, 0), rev*0.01::DOUBLE), 4) AS labour, staf = 0 AS filled FROM panel")
def _(p):
    own = F.nullif("staf", F.lit(0.0))
    return p.select("entity", "year", F.round(F.coalesce(own, F.col("rev") * 0.01), 4).alias("labour"), own.isNull().alias("filled"))


@query("prj6_try_cast", "SELECT DISTINCT market, try_cast(regexp_extract(market, '[0-9]+') AS INTEGER) AS code, try_cast(market AS INTEGER) AS bad FROM panel")
def _(p):
    return p.select("market").distinct().select("market", F.regexp_extract("market", "[0-9]+", 0).try_cast("int").alias("code"), F.col("market").try_cast("int").alias("bad"))


@query("prj7_row_sum", "SELECT entity, year, round(mate + nullif(staf, 0), 4) AS cost FROM panel")
def _(p):
    return p.select("entity", "year", F.round(F.col("mate") + F.nullif("staf", F.lit(0.0)), 4).alias("cost"))


@query("prj8_clip", "SELECT entity, year, greatest(20.0::DOUBLE, least(60.0::DOUBLE, cap)) AS cap FROM panel")
def _(p):
    return p.select("entity", "year", F.when(F.col("cap").isNotNull(), F.greatest(F.lit(20.0), F.least(F.lit(60.0), "cap"))).alias("cap"))


@query("prj10_ratio", "SELECT entity, year, round(mate/nullif(staf, 0), 6) AS ratio FROM panel")
def _(p):
    return r6(p.select("entity", "year", F.try_divide("mate", "staf").alias("ratio")))


@query("prj11_dummies", "SELECT entity, year, (year = 1996)::INTEGER AS y1996, (year = 1997)::INTEGER AS y1997 FROM panel")
def _(p):
    return p.select("entity", "year", *((F.col("year") == y).cast("int").alias(f"y{y}") for y in (1996, 1997)))


@query("prj12_tiers", "SELECT entity, year, 'l' AS tier FROM panel WHERE cap >= 50 UNION ALL SELECT entity, year, 's' FROM panel WHERE cap < 50")
def _(p):
    part = lambda c, t: p.where(c).select("entity", "year", F.lit(t).alias("tier"))
    return part("cap >= 50", "l").unionByName(part("cap < 50", "s"))


@query("flt1_predicates", "SELECT entity, year FROM panel WHERE year BETWEEN 1996 AND 1998 AND cell IN ('PROMO', 'STANDARD') AND market NOT IN ('Brand#11', 'Brand#12')")
def _(p):
    return p.where(F.col("year").between(1996, 1998) & F.col("cell").isin("PROMO", "STANDARD") & ~F.col("market").isin("Brand#11", "Brand#12")).select("entity", "year")


@query("flt2_prefix", "SELECT entity, year, cell FROM panel WHERE starts_with(cell, 'S')")
def _(p):
    return p.where(F.col("cell").startswith("S")).select("entity", "year", "cell")


@query("flt3_complete_cases", "SELECT entity, year FROM panel WHERE nullif(staf, 0) IS NOT NULL AND rev IS NOT NULL")
def _(p):
    return p.select("entity", "year", F.nullif("staf", F.lit(0.0)).alias("staf"), "rev").na.drop(subset=["staf", "rev"]).select("entity", "year")


@query("flt4_finite", "SELECT entity, year, round(ln(mate/staf), 6) AS x FROM panel WHERE staf > 0")
def _(p):
    x = F.col("x")
    return r6(p.select("entity", "year", F.ln(F.try_divide("mate", "staf")).alias("x")).where(x.isNotNull() & ~F.isnan("x") & (F.abs(x) < float("inf"))))


@query("flt6_relative_tolerance", "SELECT entity, year FROM panel WHERE abs(rev-mate)/rev < 0.1")
def _(p):
    return p.where(F.abs(F.col("rev") - F.col("mate")) / F.col("rev") < 0.1).select("entity", "year")


@query("jn1_many_to_one", "SELECT entity, year, round(rev/m, 6) AS rel FROM panel JOIN (SELECT cell, year, avg(rev) AS m FROM panel GROUP BY 1, 2) USING (cell, year)")
def _(p):
    return r6(p.join(p.groupBy("cell", "year").agg(F.avg("rev").alias("m")), ["cell", "year"], "left").select("entity", "year", (F.col("rev") / F.col("m")).alias("rel")))


@query("jn5_match_indicator", "SELECT CASE WHEN a.entity IS NULL THEN 'right' WHEN b.entity IS NULL THEN 'left' ELSE 'both' END AS found, count(*) AS n FROM (SELECT entity FROM panel WHERE year=1995) a FULL JOIN (SELECT entity FROM panel WHERE year=2001) b ON a.entity = b.entity GROUP BY 1")
def _(p):
    side = lambda y, m: p.where(f"year = {y}").select("entity", F.lit(True).alias(m))
    found = F.when(F.col("a").isNull(), "right").when(F.col("b").isNull(), "left").otherwise("both")
    return side(1995, "a").join(side(2001, "b"), "entity", "full_outer").groupBy(found.alias("found")).agg(F.count("*").alias("n"))


@query("jn8_map", "SELECT cell, CASE cell WHEN 'PROMO' THEN 1 WHEN 'STANDARD' THEN 2 END AS code, count(*) AS n FROM panel GROUP BY 1, 2")
def _(p):
    codes = F.create_map(F.lit("PROMO"), F.lit(1), F.lit("STANDARD"), F.lit(2))
    return p.groupBy("cell").agg(F.count("*").alias("n")).select("cell", F.try_element_at(codes, F.col("cell")).alias("code"), "n")


@query("jn10_range_lookup", "SELECT entity, year, s.name FROM panel JOIN (VALUES (1, 20, 'A'), (21, 60, 'B'), (61, 1000000, 'C')) s(lo, hi, name) ON floor(cap) BETWEEN lo AND hi")
def _(p):
    sections = p.sparkSession.createDataFrame([(1, 20, "A"), (21, 60, "B"), (61, 1_000_000, "C")], "lo long, hi long, name string")
    return p.join(F.broadcast(sections), F.floor("cap").between(F.col("lo"), F.col("hi"))).select("entity", "year", "name")


@query("jn13_year_pair", "SELECT a.market, round(ln(b.rev/a.rev), 6) AS d FROM (SELECT market, sum(rev) AS rev FROM panel WHERE year=1995 GROUP BY 1) a JOIN (SELECT market, sum(rev) AS rev FROM panel WHERE year=1998 GROUP BY 1) b USING (market)")
def _(p):
    at = lambda y: F.sum(F.when(F.col("year") == y, F.col("rev")))
    return r6(p.where("year in (1995, 1998)").groupBy("market").agg(F.ln(at(1998) / at(1995)).alias("d")).where("d is not null"))


@query("jn14_rebase", "y AS (SELECT cell, year, sum(rev) AS rev FROM panel GROUP BY 1, 2)\nSELECT cell, y.year, round(100*y.rev/b.rev, 6) AS idx FROM y JOIN (SELECT cell, rev FROM y WHERE year=1997) b USING (cell)")
def _(p):
    y = p.groupBy("cell", "year").agg(F.sum("rev").alias("rev"))
    base = F.max(F.when(F.col("year") == 1997, F.col("rev"))).over(Window.partitionBy("cell"))
    return r6(y.select("cell", "year", (100 * F.col("rev") / base).alias("idx")).where("idx is not null"))


@query("jn15_grid", "SELECT cell, w.n AS width, count(*) AS n FROM panel CROSS JOIN (VALUES (1), (2), (3)) w(n) WHERE year BETWEEN 1998-w.n AND 1998 GROUP BY 1, 2")
def _(p):
    widths = F.explode(F.sequence(F.greatest(F.lit(1), 1998 - F.col("year")), F.lit(3)))
    return p.where("year between 1995 and 1998").select("cell", widths.alias("width")).groupBy("cell", "width").agg(F.count("*").alias("n"))


@query("jn17_array_overlap", "s AS (SELECT entity, list(year ORDER BY year) AS y FROM panel GROUP BY 1)\nSELECT entity FROM s WHERE list_has_any(y, [1995, 2001])")
def _(p):
    return p.groupBy("entity").agg(F.collect_set("year").alias("y")).where(F.arrays_overlap("y", F.array(F.lit(1995), F.lit(2001)))).select("entity")


@query("jn18_split_sample", "SELECT entity, round(avg(CASE WHEN year%2=1 THEN rev END), 6) AS odd, round(avg(CASE WHEN year%2=0 THEN rev END), 6) AS even FROM panel GROUP BY 1 HAVING count(CASE WHEN year%2=1 THEN 1 END) > 0 AND count(CASE WHEN year%2=0 THEN 1 END) > 0")
def _(p):
    half = lambda r: F.round(F.avg(F.when(F.col("year") % 2 == r, F.col("rev"))), 6)
    return p.groupBy("entity").agg(half(1).alias("odd"), half(0).alias("even")).where("odd is not null and even is not null")


@query("jn21_validation", "SELECT count(*) AS n, count(*) - count(DISTINCT (entity, year)) AS repeated, count(*) FILTER (WHERE entity IS NULL) AS null_keys, count(*) FILTER (WHERE NOT staf > 0) AS not_positive FROM panel")
def _(p):
    return panel.validate(p, ["entity", "year"], "staf")


@query("ord3_distinct_keys", "SELECT DISTINCT cell, market FROM panel")
def _(p):
    return p.select("cell", "market").dropDuplicates(["cell", "market"])


@query("ord4_top_n", "SELECT entity, year, rev FROM panel ORDER BY rev DESC, entity, year LIMIT 25")
def _(p):
    return p.select("entity", "year", "rev").orderBy(F.desc("rev"), "entity", "year").limit(25)


@query("ord5_top_k_by_group", "r AS (SELECT cell, entity, year, rev, row_number() OVER (PARTITION BY cell ORDER BY rev DESC, entity, year) AS rk FROM panel)\nSELECT cell, entity, year, rev, rk::INTEGER AS rk FROM r WHERE rk <= 5")
def _(p):
    rk = F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("rev"), "entity", "year"))
    return p.select("cell", "entity", "year", "rev", rk.alias("rk")).where("rk <= 5")


def _entities(p, y):
    return p.where(f"year = {y}").select("entity")


@query("set2_union", "SELECT entity FROM panel WHERE year=1995 UNION SELECT entity FROM panel WHERE year=2001")
def _(p):
    return _entities(p, 1995).union(_entities(p, 2001)).distinct()


@query("set3_difference", "SELECT entity FROM panel WHERE year=1996 EXCEPT SELECT entity FROM panel WHERE year=1997")
def _(p):
    return _entities(p, 1996).subtract(_entities(p, 1997))


@query("set4_intersection", "SELECT entity FROM panel WHERE year=1996 INTERSECT SELECT entity FROM panel WHERE year=1997")
def _(p):
    return _entities(p, 1996).intersect(_entities(p, 1997))


@query("mth1_logs", "SELECT entity, year, round(ln(1+cap), 6) AS a, round(exp(-cap/100)-1, 6) AS b, round(sqrt(cap), 6) AS c, round(abs(rev-mate), 4) AS d FROM panel")
def _(p):
    return p.select("entity", "year", F.round(F.log1p("cap"), 6).alias("a"), F.round(F.expm1(-F.col("cap") / 100), 6).alias("b"), F.round(F.sqrt("cap"), 6).alias("c"), F.round(F.abs(F.col("rev") - F.col("mate")), 4).alias("d"))


@query("mth2_rounding", "SELECT entity, year, ceil(rev)::BIGINT AS up, floor(rev)::BIGINT AS down, round_even(cap/4, 0) AS even FROM panel")
def _(p):
    return p.select("entity", "year", F.ceil("rev").alias("up"), F.floor("rev").alias("down"), F.bround(F.col("cap") / 4, 0).alias("even"))


@query("mth4_pareto", "SELECT entity, year, round(power(1 - (entity%1000)/1000.0::DOUBLE, -1/1.1::DOUBLE), 6) AS v FROM panel")
def _(p):
    return r6(p.select("entity", "year", F.pow(1 - (F.col("entity") % 1000) / 1000.0, F.lit(-1 / 1.1)).alias("v")))


@query("str1_slices", "SELECT DISTINCT market, substring(market, 1, 5) AS head, lpad(trim(substring(market, 7)), 6, '0') AS code, regexp_full_match(market, 'Brand#[0-9]+') AS whole, concat(market, '_', year) AS key FROM panel")
def _(p):
    m = F.col("market")
    return p.select(*KEYS).distinct().select("market", m.substr(1, 5).alias("head"), F.lpad(F.trim(m.substr(7, 100)), 6, "0").alias("code"), m.rlike("^Brand#[0-9]+$").alias("whole"), F.concat_ws("_", "market", "year").alias("key"))


@query("hsh1_sha256", "SELECT DISTINCT market, sha256(market) AS digest FROM panel")
def _(p):
    return p.select("market").distinct().select("market", F.sha2("market", 256).alias("digest"))


@query("map1_default", "SELECT DISTINCT cell, CASE cell WHEN 'PROMO' THEN 'P' ELSE cell END AS short FROM panel")
def _(p):
    return p.select("cell").distinct().select("cell", F.coalesce(F.try_element_at(F.create_map(F.lit("PROMO"), F.lit("P")), F.col("cell")), "cell").alias("short"))
