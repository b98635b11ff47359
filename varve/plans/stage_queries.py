"""Queries for restartable stages and samples checked by their own counts, over the proxy panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from varve.operators import estimate, stages
from varve.sources import files

from .panel_queries import query, r6

LOGGED = "v AS (SELECT *, ln(rev) AS y, ln(cap) AS k, ln(mate) AS m, ln(staf) AS l, mate/rev AS share FROM panel WHERE rev > 0 AND cap > 0 AND mate > 0 AND staf > 0)"


def logged(p):
    good = p.where("rev > 0 and cap > 0 and mate > 0 and staf > 0")
    return good.withColumns({"y": F.ln("rev"), "k": F.ln("cap"), "m": F.ln("mate"), "l": F.ln("staf"), "share": F.col("mate") / F.col("rev")})


def fitted(rows):
    """By cell: rows, entities, the slope of y on k and quantiles of the share."""
    q = F.percentile("share", F.array(F.lit(0.1), F.lit(0.9)))
    made = rows.groupBy("cell").agg(F.count("*").alias("n"), F.countDistinct("entity").alias("entities"), F.regr_slope("y", "k").alias("slope"), F.avg("share").alias("share_mean"), q.alias("q"), F.avg((F.col("share") > 1).cast("double")).alias("share_over"))
    return made.select("cell", "n", "entities", "slope", "share_mean", F.col("q")[0].alias("share_p10"), F.col("q")[1].alias("share_p90"), "share_over")


_FIT = "count(*) AS n, count(DISTINCT entity) AS entities, round(regr_slope(y, k), 6) AS slope, round(avg(share), 6) AS share_mean, round(quantile_cont(share, 0.1), 6) AS share_p10, round(quantile_cont(share, 0.9), 6) AS share_p90, round(avg((share > 1)::INT), 6) AS share_over"


@query("est22_cells", LOGGED + f"\nSELECT cell, {_FIT}, 6::BIGINT AS cells, (SELECT count(DISTINCT cell) FROM v WHERE year = 1998 AND cell IN ('PROMO', 'SMALL'))::BIGINT AS recomputed FROM v GROUP BY 1")
def _(p):
    """A first run without the latest year of two cells, then all rows: the second run computes these two alone."""
    rows, path = logged(p).select("entity", "year", "cell", "y", "k", "share"), files.scratch(p.sparkSession, "cells")
    stages.refresh(rows.where("year <> 1998 or cell not in ('PROMO', 'SMALL')"), "cell", path, fitted, "slope of y on k")
    got, told = stages.refresh(rows, "cell", path, fitted, "slope of y on k")
    return r6(got.withColumns({"cells": F.lit(told["cells"]).cast("long"), "recomputed": F.lit(told["recomputed"]).cast("long")}))


@query("est27_pooled_stages", LOGGED + f"\nSELECT 'all' AS cell, {_FIT} FROM v")
def _(p):
    """One pooled cell: built, estimated and read back; the same input again computes nothing."""
    rows, path = logged(p).select("entity", "year", F.lit("all").alias("cell"), "y", "k", "share"), files.scratch(p.sparkSession, "pool")
    stages.refresh(rows, "cell", path, fitted)
    got, told = stages.refresh(rows, "cell", path, fitted)
    return r6(got.where(F.lit(told["recomputed"] == 0)))


#: The published moments that pooled ones are held against.
PUBLISHED = {"share": {"mean": 0.60, "p10": 0.20, "p50": 0.60, "p90": 1.00}, "y": {"mean": 11.0, "p10": 9.5, "p50": 11.0, "p90": 12.5}}


@query("est22_against_published", LOGGED + "".join(
    f"{' UNION ALL ' if i else chr(10)}SELECT '{c}' AS object, count({c}) AS n, round(avg({c}), 6) AS mean, round(quantile_cont({c}, 0.1), 6) AS p10, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.9), 6) AS p90, "
    + ", ".join(f"{v}::DOUBLE AS published_{k}" for k, v in t.items())
    + f", round(greatest(abs(avg({c})-{t['mean']}), abs(quantile_cont({c}, 0.1)-{t['p10']}), abs(quantile_cont({c}, 0.5)-{t['p50']}), abs(quantile_cont({c}, 0.9)-{t['p90']})), 6) AS gap FROM v WHERE year BETWEEN 1994 AND 1997"
    for i, (c, t) in enumerate(PUBLISHED.items())
))
def _(p):
    return r6(stages.against(logged(p), list(PUBLISHED), PUBLISHED, F.col("year").between(1994, 1997)))


#: A share linear in its three inputs, by one slope each, and a fixed function of capital and labour: coefficients that SQL has too.
STEP2 = LOGGED + """, c AS (SELECT cell, avg(k) AS mk, avg(m) AS mm, avg(l) AS ml FROM v GROUP BY 1), w AS (SELECT entity, year, cell, y, k-mk AS k, m-mm AS m, l-ml AS l, share, ln(share) AS s FROM v JOIN c USING (cell)),
b AS (SELECT cell, avg(share) AS c0, regr_slope(share, k) AS c1, regr_slope(share, m) AS c2, regr_slope(share, l) AS c3 FROM w GROUP BY 1),
f AS (SELECT w.*, c0 + c1*k + c2*m + c3*l AS me, m*(c0 + c1*k + c3*l + c2*m/2) AS integral, m*c1 AS ke0, m*c3 AS le0 FROM w JOIN b USING (cell)),
o AS (SELECT *, CASE WHEN me > 0 THEN ln(me) - s END AS eps, y - CASE WHEN me > 0 THEN ln(me) - s END - integral - 0.3::DOUBLE*k - 0.2::DOUBLE*l + 0.01::DOUBLE*k*k AS om, ke0 + 0.3::DOUBLE - 0.02::DOUBLE*k AS ke, le0 + 0.2::DOUBLE AS le FROM f),
g AS (SELECT *, CASE WHEN lag(year) OVER e = year - 1 THEN lag(me) OVER e END AS lme, CASE WHEN lag(year) OVER e = year - 1 THEN lag(om) OVER e END AS lom FROM o WINDOW e AS (PARTITION BY entity ORDER BY year)),
r AS (SELECT *, coalesce(lme > 0, false) AS chosen, me + ke + le AS rts FROM g)
"""


def step2(p, expected=None):
    w = estimate.centred(logged(p).select("entity", "year", "cell", "y", "k", "m", "l", "share"), "cell").withColumn("s", F.ln("share"))
    b = w.groupBy("cell").agg(F.avg("share").alias("c0"), *(F.regr_slope("share", c).alias(f"c{i}") for i, c in enumerate("kml", 1)))
    b = b.select("cell", "c0", "c1", "c2", "c3", *(F.lit(0.0).alias(f"c{i}") for i in range(4, 10)))
    alpha = b.select("cell", *(F.lit(v).alias(f"a{i}") for i, v in enumerate((-0.3, -0.2, 0.01, 0.0, 0.0))))
    return stages.second_step(w, b, alpha, "cell", (0.5, 1.5), expected)


@query("est20_second_step", STEP2 + """SELECT entity, year, cell, round(eps, 6) AS eps, round(me, 6) AS melast, round(CASE WHEN chosen THEN ke END, 6) AS kelast, round(CASE WHEN chosen THEN le END, 6) AS lelast, round(CASE WHEN chosen THEN om END, 6) AS omega, round(CASE WHEN chosen THEN lom END, 6) AS lomega, round(CASE WHEN chosen THEN rts END, 6) AS rts, chosen AS in_sample, coalesce(chosen AND rts NOT BETWEEN 0.5 AND 1.5, false) AS outlier FROM r""")
def _(p):
    return r6(step2(p)[0])


@query("prv5_pass_counters", STEP2 + "SELECT count(*) AS rows, count(*) FILTER (chosen) AS selected, count(*) FILTER (chosen AND rts NOT BETWEEN 0.5 AND 1.5) AS flagged, count(*) FILTER (chosen AND ke < 0) AS negative_k, count(*) FILTER (chosen AND le < 0) AS negative_l FROM r")
def _(p):
    """The first pass tells how many rows are selected; the second is refused unless it selects as many."""
    told = step2(p)[1]
    again = step2(p, told["selected"])[1]
    return p.sparkSession.createDataFrame([tuple(again.values())], ", ".join(f"{k} long" for k in again))
