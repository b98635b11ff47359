"""Queries for arrangements, curves in tables, manifests, validation moments, and fuller forms of smaller operators, over the proxy panel."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from varve.functions import scalars
from varve.operators import arrange, curves, guards, market, ordered, panel, quantiles, specs
from varve.sources import files

from .panel_queries import KEYS, query, r6
from .source_queries import register

U = ["market", "year"]


@query("smp4_partial_shuffle", """r AS (SELECT market, year, entity, cap, rev, row_number() OVER (PARTITION BY market, year ORDER BY cap, entity) AS k, row_number() OVER (PARTITION BY market, year ORDER BY rev, entity) AS j, row_number() OVER (PARTITION BY market, year ORDER BY md5(entity::VARCHAR || ':p:slot'), entity) <= round(0.4*count(*) OVER (PARTITION BY market, year)) AS chosen FROM panel),
s AS (SELECT a.market, a.year, a.entity, a.k, a.chosen, b.rev AS given FROM r a JOIN r b ON a.market = b.market AND a.year = b.year AND a.k = b.j),
t AS (SELECT *, row_number() OVER (PARTITION BY market, year, chosen ORDER BY k) AS x, row_number() OVER (PARTITION BY market, year, chosen ORDER BY md5(entity::VARCHAR || ':p:value'), entity) AS y FROM s)
SELECT a.market, a.year, a.entity, CASE WHEN a.chosen THEN b.given ELSE a.given END AS rev FROM t a JOIN t b ON a.market = b.market AND a.year = b.year AND a.chosen = b.chosen AND a.x = b.y""")
def _(p):
    got = arrange.arrange(p.select(*U, "entity", "cap", "rev"), U, "entity", "cap", "rev", "partial", "p", 0.4)
    return got.select(*U, "entity", F.col("given").alias("rev"))


def _ranked(kind: str, slot: str, own: str) -> str:
    return f"SELECT 'permutation' AS kind, '{kind}' AS label, a.*, b.v AS given FROM (SELECT *, row_number() OVER (PARTITION BY market, year ORDER BY {slot}) AS k FROM u) a JOIN (SELECT market, year, val AS v, row_number() OVER (PARTITION BY market, year ORDER BY {own}) AS k FROM u) b USING (market, year, k)"


SHARES = [0.0, 0.25, 0.5, 0.75, 1.0]
ARRANGED = """u AS (SELECT market, year, entity, rev, mate, mate/rev AS val FROM panel WHERE rev > 0 AND mate > 0),
""" + "".join(f"""s{round(100 * q)} AS (SELECT a.*, b.v AS given FROM (SELECT *, row_number() OVER (PARTITION BY market, year ORDER BY rev, entity) AS k, row_number() OVER (PARTITION BY market, year ORDER BY md5(entity::VARCHAR || ':p:slot'), entity) <= round({q}::DOUBLE*count(*) OVER (PARTITION BY market, year)) AS chosen FROM u) a JOIN (SELECT market, year, val AS v, row_number() OVER (PARTITION BY market, year ORDER BY val, entity) AS k FROM u) b USING (market, year, k)),
t{round(100 * q)} AS (SELECT *, row_number() OVER (PARTITION BY market, year, chosen ORDER BY k) AS x, row_number() OVER (PARTITION BY market, year, chosen ORDER BY md5(entity::VARCHAR || ':p:value'), entity) AS y FROM s{round(100 * q)}),
""" for q in SHARES) + "arr AS (SELECT kind, label, rev, mate, val, given FROM (" + " UNION ALL ".join(
    ["SELECT 'baseline' AS kind, 'baseline' AS label, rev, mate, val, val AS given FROM u"]
    + [f"SELECT kind, label, rev, mate, val, given FROM ({_ranked(f'shuffle_{i}', 'rev, entity', f'md5(entity::VARCHAR || {chr(39)}:s{i}{chr(39)}), entity')})" for i in (1, 2, 3)]
    + [f"SELECT kind, label, rev, mate, val, given FROM ({_ranked('reverse', 'rev DESC, entity DESC', 'val, entity')})"]
    + [f"SELECT 'curve', 'partial_{round(100 * q):03d}', rev, mate, val, given FROM (SELECT a.rev, a.mate, a.val, CASE WHEN a.chosen THEN b.given ELSE a.given END AS given FROM t{round(100 * q)} a JOIN t{round(100 * q)} b ON a.market = b.market AND a.year = b.year AND a.chosen = b.chosen AND a.x = b.y)" for q in SHARES]
    + ["SELECT 'alike', 'hom_group', rev, mate, val, count(*) OVER w/sum(1/val) OVER w FROM u WINDOW w AS (PARTITION BY market, year)", "SELECT 'alike', 'hom_cost', rev, mate, val, sum(mate) OVER ()/sum(mate/val) OVER () FROM u"]
) + ")),\npts AS (SELECT kind, label, count(*) AS n, CASE WHEN label = 'hom_cost' THEN NULL ELSE corr(rev, given) END AS corr, sum(rev*given)/sum(rev) AS delta FROM arr GROUP BY 1, 2)\n"


def points(p):
    """The arrangements' summaries, written once: a row each."""
    u = p.where("rev > 0 and mate > 0").select(*U, "entity", "rev", "mate", (F.col("mate") / F.col("rev")).alias("val"))
    made = arrange.summary(arrange.arrangements(u, U, "entity", "rev", "val", "mate", 3, SHARES), "given", "rev", "rev")
    path = files.scratch(p.sparkSession, "points")
    made.withColumn("corr", F.when(F.col("label") != "hom_cost", F.col("corr"))).coalesce(1).write.parquet(path)
    return p.sparkSession.read.parquet(path)


@query("sim21_arrangements", ARRANGED + "SELECT kind, label, n, round(corr, 6) AS corr, round(delta, 6) AS delta FROM pts")
def _(p):
    return r6(points(p))


@query("sim26_sorting_split", ARRANGED.rstrip() + """, x AS (SELECT max(delta) FILTER (label = 'baseline') AS base, max(delta) FILTER (label = 'hom_group') AS common, max(delta) FILTER (label = 'hom_cost') AS common_cost, avg(delta) FILTER (label LIKE 'shuffle%') AS shuf, max(delta) FILTER (label LIKE 'shuffle%') - min(delta) FILTER (label LIKE 'shuffle%') AS rng, count(*) FILTER (label LIKE 'shuffle%') AS k FROM pts)
SELECT k AS n_shuffles, round(base, 6) AS base, round(common, 6) AS common, round(common_cost, 6) AS common_cost, round(shuf-common, 6) AS heterogeneity, round(base-shuf, 6) AS sorting, round(rng, 6) AS shuffle_range, round(common/base, 6) AS share_common, round((shuf-common)/base, 6) AS share_heterogeneity, round((base-shuf)/base, 6) AS share_sorting FROM x""")
def _(p):
    return r6(arrange.split(points(p)))


@query("sim26_gaps_to_curve", ARRANGED.rstrip() + """, kn AS (SELECT corr AS x, delta AS y, lead(corr) OVER (ORDER BY corr) AS nx, lead(delta) OVER (ORDER BY corr) AS ny FROM pts WHERE kind IN ('curve', 'baseline'))
SELECT label, round(pts.corr, 6) AS corr, nx IS NOT NULL AS inside, round(delta - (y + (pts.corr-x)*(ny-y)/(nx-x)), 6) AS gap FROM pts LEFT JOIN kn ON pts.corr >= x AND pts.corr < nx WHERE kind = 'permutation'""")
def _(p):
    pts = points(p)
    got = curves.interpolate(pts.where("kind = 'permutation'"), "corr", pts.where("kind in ('curve', 'baseline')"), "corr", ["delta"])
    return r6(got.select("label", "corr", "inside", (F.col("delta") - F.col("at_delta")).alias("gap")))


@query("sim26_secants", ARRANGED.rstrip() + "\nSELECT round(corr, 6) AS corr, round((lead(delta) OVER w - delta)/(lead(corr) OVER w - corr), 5) AS slope FROM pts WHERE kind IN ('curve', 'baseline') WINDOW w AS (ORDER BY corr)")
def _(p):
    got = curves.secants(points(p).where("kind in ('curve', 'baseline')"), [], "corr", ["delta"])
    return got.select(F.round("corr", 6).alias("corr"), F.round("slope_delta", 5).alias("slope"))


@query("arr3_curve_by_cell", """kn AS (SELECT cell, q AS x, lead(q) OVER w AS nx, y, lead(y) OVER w AS ny FROM (SELECT cell, cap AS q, avg(rev) AS y FROM panel WHERE year = 1996 GROUP BY 1, 2) WINDOW w AS (PARTITION BY cell ORDER BY q))
SELECT entity, year, round(ln(CASE WHEN p.cap = x THEN y WHEN p.cap <= nx THEN y + (p.cap-x)*(ny-y)/(nx-x) END), 6) AS v, coalesce(p.cap = x OR p.cap <= nx, false) AS inside FROM (SELECT * FROM panel WHERE year = 1997) p ASOF LEFT JOIN kn ON p.cell = kn.cell AND p.cap >= kn.x""")
def _(p):
    """Each row's place on its own cell's curve, whose knots are rows of a table."""
    knots = p.where("year = 1996").select("cell", "cap", "rev")
    got = curves.interpolate(p.where("year = 1997").select("entity", "year", "cell", F.col("cap").alias("x")), "x", knots, "cap", ["rev"], ["cell"])
    return got.select("entity", "year", F.round(F.ln("at_rev"), 6).alias("v"), "inside")


@query("sim22_homogenized", "SELECT entity, year, round(count(*) OVER w/sum(1/mate) OVER w, 4) AS by_group, round(sum(rev) OVER ()/sum(rev/mate) OVER (), 4) AS by_cost FROM panel WHERE mate > 0 WINDOW w AS (PARTITION BY market, year)")
def _(p):
    p = p.where("mate > 0").select(*U, "entity", "rev", "mate")
    got = arrange.alike(arrange.alike(p, "mate", U, name="by_group"), "mate", [], "rev", name="by_cost")
    return got.select("entity", "year", F.round("by_group", 4).alias("by_group"), F.round("by_cost", 4).alias("by_cost"))


@register("prv1_file_manifest", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows, {k} AS columns, true AS verified FROM {t}" for t, k in (("nation", 3), ("region", 2), ("supplier", 4), ("customer", 5))))
def _(spark, sf_dir):
    """Recorded from the files themselves (digest, bytes and rows of each), then verified against them by a second step."""
    paths, at = {t: f"{sf_dir}/{t}.parquet" for t in ("nation", "region", "supplier", "customer")}, files.scratch(spark, "manifest")
    files.manifest(spark, paths).write.parquet(at)
    seen = files.verify(spark, at, paths)
    return seen.groupBy("table").agg(F.sum("rows").alias("rows"), F.max("columns").alias("columns"), F.bool_and((F.length("sha256") == 64) & (F.col("bytes") > 0)).alias("verified"))


def _poly(cs, x: str) -> str:
    out = f"({cs[0]}::DOUBLE)"
    for c in cs[1:]:
        out = f"({out}*{x} + {c})"
    return out


_TAILED = lambda u: f"{_poly(scalars._TAIL[0], f'sqrt(-2*ln({u}))')}/{_poly(scalars._TAIL[1], f'sqrt(-2*ln({u}))')}"


@query("mth3_normal", """m AS (SELECT cell, avg(ln(rev)) AS m, stddev_samp(ln(rev)) AS sd FROM panel WHERE rev > 0 GROUP BY 1), z AS (SELECT entity, year, (ln(rev)-m)/sd AS z FROM panel JOIN m USING (cell) WHERE rev > 0), t AS (SELECT *, 1/(1+0.3275911*abs(z)/sqrt(2.0::DOUBLE)) AS t FROM z),
c AS (SELECT *, ((((1.061405429*t - 1.453152027)*t + 1.421413741)*t - 0.284496736)*t + 0.254829592)*t*exp(-z*z/2)/2 AS half FROM t), u AS (SELECT entity, year, CASE WHEN z < 0 THEN half ELSE 1-half END AS u FROM c)
SELECT entity, year, round(u, 6) AS u, round(CASE WHEN u < 0.02425 THEN """ + _TAILED("u") + " WHEN u > 1 - 0.02425 THEN -" + _TAILED("(1-u)") + f" ELSE (u-0.5)*{_poly(scalars._CENTRE[0], '((u-0.5)*(u-0.5))')}/{_poly(scalars._CENTRE[1], '((u-0.5)*(u-0.5))')} END, 5) AS z FROM u")
def _(p):
    """Distribution function of the standardized log revenue of each cell, and its quantile back."""
    p = p.where("rev > 0").select("entity", "year", "cell", F.ln("rev").alias("y"))
    m = p.groupBy("cell").agg(F.avg("y").alias("m"), F.stddev("y").alias("sd"))
    u = p.join(m, "cell").select("entity", "year", scalars.normal_cdf((F.col("y") - F.col("m")) / F.col("sd")).alias("u"))
    return u.select("entity", "year", F.round("u", 6).alias("u"), F.round(scalars.normal_quantile(F.col("u")), 5).alias("z"))


#: Markups of each firm as they are (true) and as one elasticity for all measures them (meas).
VALID = """b AS (SELECT entity, year, rev AS s, mate AS c, rev/sum(rev) OVER (PARTITION BY market, year) AS sh FROM panel WHERE rev > 0 AND mate > 0), m AS (SELECT *, 1/(1-(sh/1.5+(1-sh)/6.0::DOUBLE)) AS mu FROM b), a AS (SELECT *, c*mu/s AS a FROM m), g AS (SELECT sum(c*a)/sum(c) AS abar FROM a),
v AS (SELECT entity, year, s, c, a, variant, CASE variant WHEN 'true' THEN mu ELSE mu*abar/a END AS mu FROM a, g, (VALUES ('true'), ('meas')) t(variant)),
w AS (SELECT *, sum(w) OVER (PARTITION BY variant, weight ORDER BY mu, entity, year ROWS UNBOUNDED PRECEDING)/sum(w) OVER (PARTITION BY variant, weight) AS cum FROM (SELECT *, CASE weight WHEN 'uw' THEN 1.0::DOUBLE WHEN 'cw' THEN c ELSE s END AS w FROM v, (VALUES ('uw'), ('cw'), ('sw')) t(weight)))
"""


def valued(p):
    b = p.where("rev > 0 and mate > 0").select("entity", "year", "market", F.col("rev").alias("s"), F.col("mate").alias("c"))
    b = b.join(b.groupBy(*U).agg(F.sum("s").alias("_t")), U).withColumn("_h", F.col("s") / F.col("_t"))
    b = b.withColumn("mu", 1 / (1 - (F.col("_h") / 1.5 + (1 - F.col("_h")) / 6.0))).withColumn("a", F.col("c") * F.col("mu") / F.col("s"))
    g = F.broadcast(b.agg((F.sum(F.col("c") * F.col("a")) / F.sum("c")).alias("abar")))  # one row
    each = F.explode(F.array(F.struct(F.lit("true").alias("variant"), F.col("mu").alias("m")), F.struct(F.lit("meas").alias("variant"), (F.col("mu") * F.col("abar") / F.col("a")).alias("m"))))
    return b.join(g).select("entity", "year", "s", "c", "a", each.alias("e")).select("entity", "year", "s", "c", "a", "e.variant", F.col("e.m").alias("mu"))


@query("cal7_markup_moments", VALID + """, f AS (SELECT variant, sum(c*mu)/sum(c) AS cw, sum(s*mu)/sum(s) AS sw, sum(c*ln(mu))/sum(c) AS lc, sum(s*ln(mu))/sum(s) AS ls FROM v GROUP BY 1)
SELECT variant, round(any_value(cw), 6) AS mu_cw, round(any_value(sw), 6) AS mu_sw, round(any_value(sw-cw), 6) AS gap, round(sum(c*(ln(mu)-lc)*(ln(mu)-lc))/sum(c), 6) AS var_cw_log, round(sum(s*(ln(mu)-ls)*(ln(mu)-ls))/sum(s), 6) AS var_sw_log, round(1.2::DOUBLE, 6) AS mu_floor, round(any_value(cw)-1.2, 6) AS share_part, round((any_value(cw)-1.2)/(any_value(cw)-1), 6) AS share_part_frac FROM v JOIN f USING (variant) GROUP BY 1""")
def _(p):
    """The floor is the markup of a firm without a share: 6 / (6 - 1)."""
    v = valued(p).withColumn("l", F.ln("mu"))
    mean = lambda w, x: F.sum(F.col(w) * F.col(x)) / F.sum(w)
    f = v.groupBy("variant").agg(mean("c", "mu").alias("mu_cw"), mean("s", "mu").alias("mu_sw"), mean("c", "l").alias("lc"), mean("s", "l").alias("ls"))
    got = v.join(F.broadcast(f), "variant").groupBy("variant").agg(*(F.first(c).alias(c) for c in ("mu_cw", "mu_sw")), (F.sum(F.col("c") * F.pow(F.col("l") - F.col("lc"), 2)) / F.sum("c")).alias("var_cw_log"), (F.sum(F.col("s") * F.pow(F.col("l") - F.col("ls"), 2)) / F.sum("s")).alias("var_sw_log"))
    floor = F.lit(1.2)
    return r6(got.withColumns({"gap": F.col("mu_sw") - F.col("mu_cw"), "mu_floor": floor, "share_part": F.col("mu_cw") - floor, "share_part_frac": (F.col("mu_cw") - floor) / (F.col("mu_cw") - 1)}))


@query("cal7_markup_quantiles", VALID + "SELECT variant, weight, round(min(mu) FILTER (cum >= 0.5 - 1e-12), 6) AS p50, round(min(mu) FILTER (cum >= 0.9 - 1e-12), 6) AS p90, round(min(mu) FILTER (cum >= 0.99 - 1e-12), 6) AS p99 FROM w GROUP BY 1, 2")
def _(p):
    """Six weighted rankings, along one distributed sort."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("weight"), w.alias("w")) for n, w in (("uw", F.lit(1.0)), ("cw", F.col("c")), ("sw", F.col("s"))))))
    v = valued(p).select("variant", "entity", "year", "mu", each.alias("e")).select("variant", "entity", "year", "mu", "e.*")
    run = ordered.running(v, ["variant", "weight"], [F.col("mu"), F.col("entity"), F.col("year")], {"cum": F.col("w")}, rank=None)
    at = lambda q: F.min(F.when(F.col("cum") / F.col("cum_total") >= q - 1e-12, F.col("mu")))
    return r6(run.groupBy("variant", "weight").agg(at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99")))


@query("cal7_top_shares", VALID + """, r AS (SELECT *, row_number() OVER (ORDER BY s DESC, entity, year) AS rk, count(*) OVER () AS n FROM v WHERE variant = 'true')
SELECT round(sum(s) FILTER (rk <= greatest(1, floor(0.001*n)))/sum(s), 6) AS top_01, round(sum(s) FILTER (rk <= greatest(1, floor(0.01*n)))/sum(s), 6) AS top_1, round(sum(s) FILTER (rk <= greatest(1, floor(0.05*n)))/sum(s), 6) AS top_5, round(avg(a) FILTER (rk <= greatest(1, floor(0.01*n))), 6) AS alpha_top_1, round(sum(s*mu) FILTER (rk <= greatest(1, floor(0.01*n)))/sum(s) FILTER (rk <= greatest(1, floor(0.01*n))), 6) AS mu_sw_top_1 FROM r""")
def _(p):
    r = ordered.running(valued(p).where("variant = 'true'"), [], [F.desc("s"), F.col("entity"), F.col("year")])
    top = lambda q: F.col("rank") <= F.greatest(F.lit(1), F.floor(F.lit(q) * F.col("rank_total")))
    share = lambda q: F.sum(F.when(top(q), F.col("s"))) / F.sum("s")
    return r6(r.agg(share(0.001).alias("top_01"), share(0.01).alias("top_1"), share(0.05).alias("top_5"), F.avg(F.when(top(0.01), F.col("a"))).alias("alpha_top_1"), (F.sum(F.when(top(0.01), F.col("s") * F.col("mu"))) / F.sum(F.when(top(0.01), F.col("s")))).alias("mu_sw_top_1")))


@query("agg3_quantiles_by_sort", "SELECT cell, round(quantile_cont(rev, 0.01), 4) AS q01, round(quantile_cont(rev, 0.5), 4) AS q50, round(quantile_cont(rev, 0.99), 4) AS q99 FROM panel GROUP BY 1")
def _(p):
    """Exact linear quantiles from a histogram and a distributed sort of the few steps that hold the ranks: no task holds a group."""
    q = quantiles.linear(p, "rev", ["cell"], [0.01, 0.5, 0.99])
    return q.select("cell", *(F.round(f"q{i}", 4).alias(n) for i, n in enumerate(("q01", "q50", "q99"))))


@query("agg15_mean_spearman", """r AS (SELECT market, year, rank() OVER (PARTITION BY market, year ORDER BY rev) + (count(*) OVER (PARTITION BY market, year, rev)-1)/2.0 AS a, rank() OVER (PARTITION BY market, year ORDER BY cap) + (count(*) OVER (PARTITION BY market, year, cap)-1)/2.0 AS b FROM panel),
g AS (SELECT market, year, count(*) AS n, CASE WHEN count(*) >= 75 THEN corr(a::DOUBLE, b::DOUBLE) END AS rho FROM r GROUP BY 1, 2) SELECT year, count(*) AS markets, count(rho) AS used, round(avg(rho), 6) AS rho FROM g GROUP BY 1""")
def _(p):
    """Rank correlations of markets with 75 firms or more (others have none), and their mean in each year."""
    ranks = p.select(*KEYS, market.average_rank_share("rev", KEYS).alias("a"), market.average_rank_share("cap", KEYS).alias("b"))
    g = ranks.groupBy(*KEYS).agg(F.when(F.count("*") >= 75, F.corr("a", "b")).alias("rho"))
    return r6(g.groupBy("year").agg(F.count("*").alias("markets"), F.count("rho").alias("used"), F.avg("rho").alias("rho")))


@query("agg18_two_controls", """v AS (SELECT cell, ln(rev) AS y, ln(mate) AS z, ln(cap) AS a, ln(staf) AS b FROM panel WHERE rev > 0 AND mate > 0 AND cap > 0 AND staf > 0), c AS (SELECT cell, corr(y,z) AS yz, corr(y,a) AS ya, corr(y,b) AS yb, corr(z,a) AS za, corr(z,b) AS zb, corr(a,b) AS ab FROM v GROUP BY 1),
p AS (SELECT cell, (yz-ya*za)/sqrt((1-ya*ya)*(1-za*za)) AS yz, (yb-ya*ab)/sqrt((1-ya*ya)*(1-ab*ab)) AS yb, (zb-za*ab)/sqrt((1-za*za)*(1-ab*ab)) AS zb FROM c) SELECT cell, round((yz-yb*zb)/sqrt((1-yb*yb)*(1-zb*zb)), 6) AS r FROM p""")
def _(p):
    """Correlation of revenue and materials given capital and labour: the sign of one's coefficient on the other, and its partial R2."""
    v = p.where("rev > 0 and mate > 0 and cap > 0 and staf > 0").select("cell", *(F.ln(c).alias(n) for c, n in (("rev", "y"), ("mate", "z"), ("cap", "a"), ("staf", "b"))))
    got = specs.least_squares(v, ["cell"], {"s": ("y", ["z", "a", "b"])}).where("term = 'z'")
    return r6(got.select("cell", (F.signum("coef") * F.sqrt("partial_r2")).alias("r")))


@query("agg31_winsorized_nodes", """q AS (SELECT cell, quantile_cont(cap, 0.02) AS lo, quantile_cont(cap, 0.98) AS hi FROM panel GROUP BY 1), w AS (SELECT cell, greatest(lo, least(cap, hi)) AS x FROM panel JOIN q USING (cell)), n AS (SELECT cell, quantile_cont(x, [0.1, 0.3, 0.5, 0.7, 0.9]) AS q FROM w GROUP BY 1)
SELECT cell, k::INTEGER AS k, round(q[k], 6) AS node FROM n, range(1, 6) t(k)""")
def _(p):
    """Five nodes of equal mass, at the middle of their shares, after winsorizing."""
    w = panel.winsorize_by(p.select("cell", "cap"), "cap", ["cell"], 0.02, 0.98, "x")
    q = quantiles.linear(w, "x", ["cell"], [0.1, 0.3, 0.5, 0.7, 0.9])
    return r6(q.select("cell", F.posexplode(F.array(*(f"q{i}" for i in range(5)))).alias("k", "node")).withColumn("k", F.col("k") + 1))


@query("agg58_excluded_mass", """c AS (SELECT cell, cap, rev, sum(rev) OVER (PARTITION BY cell ORDER BY cap, entity, year ROWS UNBOUNDED PRECEDING)/sum(rev) OVER (PARTITION BY cell) AS w, row_number() OVER (PARTITION BY cell ORDER BY cap, entity, year)/(count(*) OVER (PARTITION BY cell))::DOUBLE AS u FROM panel)
SELECT cell, round(max(u) FILTER (cap <= 100), 6) AS ecdf, round(max(w) FILTER (cap <= 100), 6) AS wcdf, round(1 - max(u) FILTER (cap <= 100), 6) AS excluded_firms, round(1 - max(w) FILTER (cap <= 100), 6) AS excluded_sales FROM c GROUP BY 1""")
def _(p):
    """Step distribution functions at a truncation point, and the mass above it."""
    run = ordered.running(p.select("cell", "entity", "year", "cap", "rev"), ["cell"], [F.col("cap"), F.col("entity"), F.col("year")], {"w": F.col("rev")})
    at = lambda n: F.max(F.when(F.col("cap") <= 100, F.col(n) / F.col(f"{n}_total")))
    got = run.groupBy("cell").agg(at("rank").alias("ecdf"), at("w").alias("wcdf"))
    return r6(got.withColumns({"excluded_firms": 1 - F.col("ecdf"), "excluded_sales": 1 - F.col("wcdf")}))


@query("win17_distinct_edges", """v AS (SELECT cell, least(greatest(round(cap/20), 1), 3) AS x FROM panel), q AS (SELECT cell, list_sort(list_distinct(quantile_cont(x, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM v GROUP BY 1)
SELECT cell, greatest(len(list_filter(e, lambda y: y < x)), 1)::INTEGER AS bin, count(*) AS n, len(any_value(e))::INTEGER AS edges FROM v JOIN q USING (cell) GROUP BY 1, 2""")
def _(p):
    """Quantile bins of a column of few values: edges that coincide are dropped, bins are closed on the right, the first on both sides."""
    v = p.select("cell", F.least(F.greatest(F.round(F.col("cap") / 20), F.lit(1.0)), F.lit(3.0)).alias("x"))
    v = files.kept(v, "few_values")
    q = quantiles.linear(v, "x", ["cell"], [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])
    edges = q.select("cell", F.array_sort(F.array_distinct(F.array(*(f"q{i}" for i in range(6))))).alias("e"))
    bins = v.join(files.small(edges, "edges")[0], "cell").select("cell", F.size("e").alias("edges"), F.greatest(F.size(F.filter("e", lambda y: y < F.col("x"))), F.lit(1)).alias("bin"))
    return bins.groupBy("cell", "bin").agg(F.count("*").alias("n"), F.max("edges").alias("edges"))


@query("jn16_overlap_gap", """a AS (SELECT year, avg(rev) AS u FROM panel WHERE year <= 1996 GROUP BY 1), b AS (SELECT year, avg(rev)*1.0001 AS v FROM panel WHERE year >= 1995 GROUP BY 1)
SELECT year::INTEGER AS year, round(u, 4) AS u, round(v, 4) AS v, round(abs(u-v)/u, 6) AS gap FROM a JOIN b USING (year) WHERE (SELECT max(abs(u-v)/u) FROM a JOIN b USING (year)) <= 0.001""")
def _(p):
    """Two series must agree within 0.1 % in the years that both have, or the join is refused."""
    a = p.where("year <= 1996").groupBy("year").agg(F.avg("rev").alias("u"))
    b = p.where("year >= 1995").groupBy("year").agg((F.avg("rev") * 1.0001).alias("v"))
    got = guards.join_overlapping(a, b, ["year"], "u", "v", 0.001)
    return got.select("year", F.round("u", 4).alias("u"), F.round("v", 4).alias("v"), F.round("gap", 6).alias("gap"))


@query("jn21_panel_checks", "SELECT 'missing columns' AS check, 0::BIGINT AS rows UNION ALL SELECT 'null keys', 0 UNION ALL SELECT 'repeated keys', 0 UNION ALL SELECT 'not positive', count(*) FILTER (NOT staf > 0) FROM panel UNION ALL SELECT 'not finite', count(*) FILTER (staf = 0) FROM panel")
def _(p):
    """Required columns, keys, signs and finiteness, each with the rows that fail it, in two passes."""
    q = p.select("entity", "year", "staf", (F.col("rev") / F.when(F.col("staf") == 0, None).otherwise(F.col("staf"))).alias("ratio"))
    q = q.withColumn("ratio", F.coalesce("ratio", F.lit(float("inf"))))
    return guards.panel_checks(q, ["entity", "year", "staf", "ratio"], ["entity", "year"], ["staf"], ["ratio"])


@query("sim6_capped_markups", "SELECT entity, year, r.regime, round(CASE r.regime WHEN 'planner' THEN 1.0::DOUBLE WHEN 'uniform' THEN 1.2::DOUBLE ELSE least(e/(e-1), 1.25) END, 6) AS markup, (r.regime = 'market' AND e/(e-1) > 1.25) AS capped FROM (SELECT entity, year, 1/(s/1.5::DOUBLE + (1-s)/6.0::DOUBLE) AS e FROM (SELECT entity, year, rev/sum(rev) OVER (PARTITION BY market, year) AS s FROM panel)) CROSS JOIN (VALUES ('market'), ('planner'), ('uniform')) r(regime)")
def _(p):
    s = p.join(p.groupBy(*KEYS).agg(F.sum("rev").alias("t")), KEYS).select("entity", "year", (F.col("rev") / F.col("t")).alias("s"))
    e = s.select("entity", "year", (1 / (F.col("s") / 1.5 + (1 - F.col("s")) / 6.0)).alias("e"), F.explode(F.array(*map(F.lit, ("market", "planner", "uniform")))).alias("regime"))
    free = F.col("e") / (F.col("e") - 1)
    rule = F.when(F.col("regime") == "planner", 1.0).when(F.col("regime") == "uniform", 1.2).otherwise(F.least(free, F.lit(1.25)))
    return r6(e.select("entity", "year", "regime", rule.alias("markup"), ((F.col("regime") == "market") & (free > 1.25)).alias("capped")))


@query("sim20_moments_table", """s AS (SELECT market, year, rev, mate, rev/sum(rev) OVER w AS s, row_number() OVER (PARTITION BY market, year ORDER BY rev DESC, entity) AS rk FROM panel WINDOW w AS (PARTITION BY market, year)), m AS (SELECT *, 1/(1-(s/1.5+(1-s)/6.0::DOUBLE)) AS mu FROM s), k AS (SELECT market, year, max(s) AS top, sum(s) FILTER (rk <= 4) AS cr4, sum(s*s) AS hhi, count(*) AS n FROM m GROUP BY 1, 2)
SELECT (SELECT count(*) FROM m) AS n_active, (SELECT count(*) FROM k) AS n_markets, (SELECT round(sum(mu*mate)/sum(mate), 6) FROM m) AS mu_cw, round(avg(cr4), 6) AS cr4, round(avg(hhi), 6) AS hhi, round(median(top), 6) AS top_median, round(quantile_cont(top, 0.9), 6) AS top_p90, round(avg(n), 6) AS firms FROM k""")
def _(p):
    """Moments of the materialized firm panel: one row."""
    t = p.join(p.groupBy(*KEYS).agg(F.sum("rev").alias("t")), KEYS).withColumn("s", F.col("rev") / F.col("t"))
    t = t.withColumn("mu", 1 / (1 - (F.col("s") / 1.5 + (1 - F.col("s")) / 6.0)))
    four = t.withColumn("rk", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("rev"), "entity"))).where("rk <= 4").groupBy(*KEYS).agg(F.sum("s").alias("cr4"))
    k = t.groupBy(*KEYS).agg(F.max("s").alias("top"), F.sum(F.col("s") * F.col("s")).alias("hhi"), F.count("*").alias("n")).join(four, KEYS)
    q = F.percentile("top", F.array(F.lit(0.5), F.lit(0.9)))  # a row a market
    moments = k.agg(F.count("*").alias("n_markets"), F.avg("cr4").alias("cr4"), F.avg("hhi").alias("hhi"), q.alias("q"), F.avg("n").alias("firms"))
    firms = t.agg(F.count("*").alias("n_active"), (F.sum(F.col("mu") * F.col("mate")) / F.sum("mate")).alias("mu_cw"))
    return r6(firms.join(moments).select("n_active", "n_markets", "mu_cw", "cr4", "hhi", F.col("q")[0].alias("top_median"), F.col("q")[1].alias("top_p90"), "firms"))


_TAIL_SQL = "v AS (SELECT entity, year, 'cell' AS axis, rev/avg(rev) OVER (PARTITION BY cell, year) AS x FROM panel UNION ALL SELECT entity, year, 'market', rev/avg(rev) OVER (PARTITION BY market, year) FROM panel)"


@query("agg28_tail_by_axis", _TAIL_SQL + """, r AS (SELECT axis, year, ln(x) AS lx, row_number() OVER (PARTITION BY axis, year ORDER BY ln(x) DESC, entity) AS rk, count(*) OVER (PARTITION BY axis, year) AS n FROM v WHERE x > 0),
k AS (SELECT axis, year, cutoff, lx, rk, greatest(floor(share*n), 20) AS k, n FROM r, (VALUES ('p01', 0.01::DOUBLE), ('p05', 0.05), ('p10', 0.1)) t(cutoff, share)), f AS (SELECT * FROM k WHERE rk <= k AND k <= n)
SELECT axis, year, cutoff, count(*) AS k, round(-regr_slope(ln(rk-0.5), lx), 6) AS zipf, round(1/(avg(lx) FILTER (rk < k) - max(lx) FILTER (rk = k)), 6) AS hill, round(-regr_slope(ln(rk-0.5), lx)*sqrt(2.0::DOUBLE/count(*)), 6) AS se FROM f GROUP BY 1, 2, 3""")
def _(p):
    """Revenue relative to two kinds of groups, three cutoffs, every year: fourteen rankings along one distributed sort."""
    rel = lambda k: p.join(p.groupBy(k, "year").agg(F.avg("rev").alias("_m")), [k, "year"]).select("entity", "year", F.lit(k).alias("axis"), (F.col("rev") / F.col("_m")).alias("x"))
    return r6(market.tail_blocks(rel("cell").unionByName(rel("market")), ["axis", "year"], "x", ["entity"], {"p01": 0.01, "p05": 0.05, "p10": 0.1}))


@query("src9_guarded_profile", """t AS (SELECT year, cell || CASE WHEN entity % 3 = 0 THEN '' ELSE ':' || cap END AS raw, staf FROM panel)
SELECT year, round(avg(coalesce((staf > 0)::INT, 0)), 6) AS positive, count(*) FILTER (regexp_full_match(split_part(raw, ':', 2), '[0-9]+(\\.[0-9]+)?')) AS numeric, round(avg(CASE WHEN regexp_full_match(split_part(raw, ':', 2), '[0-9]+(\\.[0-9]+)?') THEN split_part(raw, ':', 2)::DOUBLE END), 6) AS mean, string_agg(DISTINCT split_part(raw, ':', 1), ',' ORDER BY split_part(raw, ':', 1)) AS cells FROM t GROUP BY 1""")
def _(p):
    """A text column of numbers and gaps: cast only where a pattern says it is a number; shares, counts and the distinct labels."""
    raw = F.concat("cell", F.when(F.col("entity") % 3 == 0, "").otherwise(F.concat(F.lit(":"), F.col("cap").cast("string"))))
    cell, tail = F.split_part(F.col("raw"), F.lit(":"), F.lit(1)), F.split_part(F.col("raw"), F.lit(":"), F.lit(2))
    number = F.when(tail.rlike(r"^[0-9]+(\.[0-9]+)?$"), tail.try_cast("double"))
    t = p.select("year", raw.alias("raw"), "staf")
    return r6(t.groupBy("year").agg(F.avg(F.coalesce((F.col("staf") > 0).cast("double"), F.lit(0.0))).alias("positive"), F.count(number).alias("numeric"), F.avg(number).alias("mean"), F.array_join(F.array_sort(F.collect_set(cell)), ",").alias("cells")))


@query("agg52_income_split", """r AS (SELECT *, 1 + floor(least(greatest(cap, 1), 99)/20) AS bin FROM panel), s AS (SELECT bin, sum(staf) AS l, sum(rev) AS y, sum(mate) AS k, count(*) AS n FROM r GROUP BY 1)
SELECT bin::INTEGER AS bin, rate, n, round(l/y, 6) AS s_l, round(rr*k/y, 6) AS s_k, round(1-l/y-rr*k/y, 6) AS s_pi, round(1/(l/y+rr*k/y), 6) AS markup, round(l/(l+rr*k), 6) AS s_l_cost FROM s, (VALUES ('high', 0.4::DOUBLE), ('low', 0.1)) t(rate, rr)""")
def _(p):
    """Shares of labour, capital and profit and the markup they imply, by size, under two rental rates."""
    s = p.groupBy((1 + F.floor(F.least(F.greatest("cap", F.lit(1.0)), F.lit(99.0)) / 20)).cast("int").alias("bin")).agg(F.sum("staf").alias("l"), F.sum("rev").alias("y"), F.sum("mate").alias("k"), F.count("*").alias("n"))
    s = s.withColumn("r", F.explode(F.array(*(F.struct(F.lit(n).alias("rate"), F.lit(v).alias("rr")) for n, v in (("high", 0.4), ("low", 0.1))))))
    a, b = F.col("l") / F.col("y"), F.col("r.rr") * F.col("k") / F.col("y")
    return r6(s.select("bin", "r.rate", "n", a.alias("s_l"), b.alias("s_k"), (1 - a - b).alias("s_pi"), (1 / (a + b)).alias("markup"), (F.col("l") / (F.col("l") + F.col("r.rr") * F.col("k"))).alias("s_l_cost")))


@query("agg57_export_diagnostics", """v AS (SELECT cell, year, rev/mate AS r FROM panel WHERE mate > 0)
SELECT 'year' AS axis, year::VARCHAR AS level, count(*) AS n, NULL::DOUBLE AS mean, NULL::DOUBLE AS in_window FROM v GROUP BY year UNION ALL SELECT 'cell', cell, count(*), round(avg(r), 6), round(avg(r) FILTER (year BETWEEN 1994 AND 1996), 6) FROM v GROUP BY cell UNION ALL SELECT 'all', '', count(*), round(avg(r), 6), round(avg(r) FILTER (year BETWEEN 1994 AND 1996), 6) FROM v""")
def _(p):
    """Counts by year, counts and means by cell (all years and a window) and in all, from one pass over grouping sets."""
    v = p.where("mate > 0").select("cell", "year", (F.col("rev") / F.col("mate")).alias("r"))
    got = v.groupingSets([[F.col("year")], [F.col("cell")], []], "year", "cell").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.avg("r").alias("mean"), F.avg(F.when(F.col("year").between(1994, 1996), F.col("r"))).alias("w"))
    axis = F.when(F.col("g") == 1, "year").when(F.col("g") == 2, "cell").otherwise("all")
    return r6(got.select(axis.alias("axis"), F.when(F.col("g") == 1, F.col("year").cast("string")).when(F.col("g") == 2, F.col("cell")).otherwise("").alias("level"), "n", F.when(F.col("g") != 1, F.col("mean")).alias("mean"), F.when(F.col("g") != 1, F.col("w")).alias("in_window")))


@query("sim10_variety_toggle", "SELECT market, year, t.love, round(CASE t.love WHEN 'on' THEN 1.0::DOUBLE ELSE pow(count(*), 5.0/4) END, 6) AS factor FROM panel, (VALUES ('on'), ('off')) t(love) GROUP BY 1, 2, 3")
def _(p):
    n = p.groupBy("market", "year").agg(F.count("*").alias("n")).withColumn("love", F.explode(F.array(F.lit("on"), F.lit("off"))))
    return r6(n.select("market", "year", "love", F.when(F.col("love") == "on", 1.0).otherwise(F.pow("n", F.lit(1.25))).alias("factor")))


@query("sim32_contribution_grid", """b AS (SELECT market, year, CASE WHEN cap < 30 THEN 1 WHEN cap < 60 THEN 2 ELSE 3 END AS bin, rev, mate, rev/sum(rev) OVER (PARTITION BY market, year) AS s FROM panel), m AS (SELECT *, 1/(1-(s/1.5+(1-s)/6.0::DOUBLE)) AS mu FROM b), t AS (SELECT sum(mate) AS c, sum(mu*mate)/sum(mate) AS bar, sum((mu-1)*mate) AS w FROM m),
g AS (SELECT bin, year, sum((mu-1)*mate)/any_value(w) AS level_w, sum(mate)/any_value(c) AS cost_share, sum(mu*mate)/sum(mate) AS mean_mu, any_value(bar) AS bar FROM m, t GROUP BY 1, 2), d AS (SELECT *, cost_share*(mean_mu-bar)*(mean_mu-bar) AS dw FROM g)
SELECT bin, year, round(level_w, 6) AS level_weight, round(dw/sum(dw) OVER (), 5) AS dispersion_weight, round(100*(0.7::DOUBLE*level_w + 0.3::DOUBLE*dw/sum(dw) OVER ()), 4) AS percent FROM d""")
def _(p):
    """Each cell's part of a gain that is 70 % level (in proportion to wedges) and 30 % dispersion (in proportion to cost-weighted squared deviations of markups)."""
    t = p.join(p.groupBy(*KEYS).agg(F.sum("rev").alias("t")), KEYS).withColumn("s", F.col("rev") / F.col("t"))
    m = t.select("year", F.when(F.col("cap") < 30, 1).when(F.col("cap") < 60, 2).otherwise(3).alias("bin"), "mate", (1 / (1 - (F.col("s") / 1.5 + (1 - F.col("s")) / 6.0))).alias("mu"))
    cells = m.groupBy("bin", "year").agg(F.sum("mate").alias("c"), F.sum(F.col("mu") * F.col("mate")).alias("mc"), F.sum((F.col("mu") - 1) * F.col("mate")).alias("w"))
    total = F.broadcast(cells.agg(F.sum("c").alias("tc"), (F.sum("mc") / F.sum("c")).alias("bar"), F.sum("w").alias("tw")))  # one row
    g = cells.join(total).withColumns({"level": F.col("w") / F.col("tw"), "d": F.col("c") / F.col("tc") * F.pow(F.col("mc") / F.col("c") - F.col("bar"), 2)})
    g = g.join(F.broadcast(g.agg(F.sum("d").alias("td")))).withColumn("disp", F.col("d") / F.col("td"))  # one row
    return g.select("bin", "year", F.round("level", 6).alias("level_weight"), F.round("disp", 5).alias("dispersion_weight"), F.round(100 * (0.7 * F.col("level") + 0.3 * F.col("disp")), 4).alias("percent"))
