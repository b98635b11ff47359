"""Fixed effects of two factors on unbalanced cells, by alternating projections over the table of cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.sources.files import kept as _keep
from varve.sources.files import small

#: Cells up to which the projections run in one task, on arrays of the cells' sums; beyond, each is an aggregation by Spark.
FEW_CELLS = 200_000

#: Levels of a factor up to which its effects are solved at once, from a matrix of that size on the driver.
FEW_LEVELS = 200


def project(a: np.ndarray, b: np.ndarray, n: np.ndarray, sums: np.ndarray, tol: float, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Effects (level x column) of two factors: each in turn is the mean of what the other leaves, until no effect moves by tol of its column's
    greatest. a and b number the cells' levels; sums are the columns' sums in the cells."""
    na, nb = np.bincount(a, n), np.bincount(b, n)
    total = lambda at, w, size: np.stack([np.bincount(at, w[:, k], size) for k in range(w.shape[1])], axis=1)
    sa, sb = total(a, sums, len(na)), total(b, sums, len(nb))
    left, right = np.zeros((len(na), sums.shape[1])), np.zeros((len(nb), sums.shape[1]))
    for step in range(1, most + 1):
        new = (sa - total(a, n[:, None] * right[b], len(na))) / na[:, None]
        right = (sb - total(b, n[:, None] * new[a], len(nb))) / nb[:, None]
        moved, left = np.abs(new - left).max(axis=0), new
        if (moved <= tol * np.maximum(np.abs(left).max(axis=0), 1e-300)).all():
            return left, right, step
    return left, right, -most


def parts(a: np.ndarray, b: np.ndarray) -> int:
    """Connected components of the graph whose edges are cells and whose nodes are levels of either factor."""
    label = np.arange(a.max() + 1)
    while True:
        low = np.full(b.max() + 1, len(label))
        np.minimum.at(low, b, label[a])
        new = label.copy()
        np.minimum.at(new, a, low[b])
        new = new[new]  # halve the way to the least
        if (new == label).all():
            return len(np.unique(label))
        label = new


def _spread(cells: DataFrame, columns: list[str], tol: float, most: int) -> tuple[DataFrame, DataFrame, int, int]:
    """``project`` and ``parts`` with an aggregation a step: effects of a and b (columns e0, e1, ...), steps and components."""
    names = [f"e{i}" for i in range(len(columns))]

    def means(of: str, other: str, effects: DataFrame | None) -> DataFrame:
        if effects is None:
            return cells.groupBy(of).agg(*(F.try_divide(F.sum(c), F.sum("n")).alias(e) for c, e in zip(columns, names, strict=True)))
        met = cells.join(effects, other)
        return met.groupBy(of).agg(*(F.try_divide(F.sum(F.col(c) - F.col("n") * F.col(e)), F.sum("n")).alias(e) for c, e in zip(columns, names, strict=True)))

    right, left, steps = None, None, -most
    for step in range(1, most + 1):
        new = _keep(means("a", "b", right), "effects")
        right = _keep(means("b", "a", new), "effects")
        if left is not None:
            pair = new.join(left.select("a", *(F.col(e).alias(f"_{e}") for e in names)), "a")
            r = pair.agg(*(F.max(F.abs(F.col(e) - F.col(f"_{e}"))).alias(e) for e in names), *(F.max(F.abs(e)).alias(f"m_{e}") for e in names)).first()
            if all(r[e] <= tol * max(r[f"m_{e}"], 1e-300) for e in names):
                left, steps = new, step
                break
        left = new
    label = cells.groupBy("a").agg(F.min("a").alias("label"))
    before = None
    while True:
        low = cells.select("a", "b").join(label, "a").groupBy("b").agg(F.min("label").alias("label"))
        label = _keep(cells.select("a", "b").join(low, "b").groupBy("a").agg(F.min("label").alias("label")), "labels")
        now = tuple(label.agg(F.countDistinct("label"), F.sum(F.xxhash64("a", "label").cast("decimal(38,0)"))).first())
        if now == before:
            return left, right, steps, now[0]
        before = now


def _direct(cells: DataFrame, few: str, many: str, columns: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """Effects (columns e0, e1, ...) of the levels of few, of which there are at most some hundred, and of many, and the number of components.

    With the effects of many put in as means, those of few solve one linear system, whose matrix is a sum over the levels of many: their cells are brought together
    once, at most as many each as few has levels. In each component one level of few has an effect of 0."""
    spark, names = cells.sparkSession, [f"e{i}" for i in range(len(columns))]
    lists = cells.groupBy(many).agg(F.sum("n").alias("_n"), *(F.sum(c).alias(f"_s{c}") for c in columns), F.collect_list(F.struct(F.col(few).alias("f"), "n", *columns)).alias("_l"))
    lists = _keep(lists, "lists")
    each = lists.select("_n", *(f"_s{c}" for c in columns), F.explode("_l").alias("p"), "_l")
    own = each.groupBy("p.f").agg(F.sum("p.n").alias("n"), *(F.sum(F.col(f"p.{c}") - F.col("p.n") * F.col(f"_s{c}") / F.col("_n")).alias(e) for c, e in zip(columns, names, strict=True))).collect()  # a row a level
    met = each.select("_n", "p", F.explode("_l").alias("q")).groupBy(F.col("p.f").alias("f"), F.col("q.f").alias("g")).agg(F.sum(F.col("p.n") * F.col("q.n") / F.col("_n")).alias("w")).collect()  # a row a pair of levels
    at = {r.f: i for i, r in enumerate(own)}
    matrix, sums, first = np.diag([r.n for r in own]), np.array([[r[e] for e in names] for r in own]), np.arange(len(own))
    for r in met:
        matrix[at[r.f], at[r.g]] -= r.w
    linked = matrix < 0
    np.fill_diagonal(linked, True)
    while True:  # the least level that each one reaches
        new = np.where(linked, first[None, :], len(own)).min(axis=1)
        if (new == first).all():
            break
        first = new
    free = first != np.arange(len(own))
    effects = np.zeros(sums.shape)
    if free.any():
        effects[free] = np.linalg.solve(matrix[np.ix_(free, free)], sums[free])
    kind = dict(cells.dtypes)[few]
    levels = [(r.f, *map(float, x)) for r, x in zip(own, effects, strict=True)]
    table = spark.createDataFrame([({r[0]: list(r[1:]) for r in levels},)], f"_m map<{kind}, array<double>>")
    less = lambda i: F.aggregate("_l", F.lit(0.0), lambda t, x: t + x["n"] * F.col("_m")[x["f"]][i])
    other = lists.join(F.broadcast(table)).select(many, *(((F.col(f"_s{c}") - less(i)) / F.col("_n")).alias(e) for i, (c, e) in enumerate(zip(columns, names, strict=True))))
    return spark.createDataFrame(levels, f"{few} {kind}, " + ", ".join(f"{e} double" for e in names)), other, int((~free).sum())


def two_way(df: DataFrame, y: str, xs: list[str], a: str, b: str, cluster: str | None = None, tol: float = 1e-11, most: int = 2000, few_cells: int = FEW_CELLS, few_levels: int = FEW_LEVELS) -> DataFrame:
    """Least squares of y on xs with an effect for each level of two factors: term, coef, se (HC1, or clustered), t, n, r2, within_r2,
    levels, components, steps (negative: not converged).

    Rows with a null are left out. The effects are found on the table of cells (pairs of levels that occur) with the columns' sums: up to few_cells cells by
    projections in one task; if one factor has at most few_levels levels, at once from a linear system; by a Spark aggregation a step otherwise. The model has a coefficient a regressor and (levels of a) + (levels of b) - (components of the graph that cells make of the levels):
    where the factors are not connected, each component has a free constant of its own. HC1 errors are scaled by n / (n - coefficients);
    clustered ones by G / (G - 1) (n - 1) / (n - coefficients). Columns that the effects explain wholly are an error."""
    columns = [*xs, y]
    v = [f"_v{i}" for i in range(len(columns))]
    used = [F.col(a).alias("a"), F.col(b).alias("b"), *(F.col(c).cast("double").alias(n) for c, n in zip(columns, v, strict=True))]
    rows = df.select(*used, *([F.col(cluster).alias("_c")] if cluster else [])).dropna()
    rows = _keep(rows, "rows")
    means = [m or 0.0 for m in rows.agg(*(F.avg(c) for c in v)).first()]
    rows = rows.withColumns({c: F.col(c) - m for c, m in zip(v, means, strict=True)})  # so that sums of products don't cancel
    cells = _keep(rows.groupBy("a", "b").agg(F.count("*").cast("double").alias("n"), *(F.sum(c).alias(c) for c in v)), "cells")
    n_cells = cells.count()
    if n_cells == 0:
        raise ValueError("no rows are complete")
    names = [f"e{i}" for i in range(len(v))]
    count = lambda f: cells.select(f).distinct().count()
    if n_cells <= few_cells:
        t = cells.toPandas()  # at most few_cells rows
        (ai, au), (bi, bu) = (pd.factorize(t[c]) for c in "ab")
        left, right, steps = project(ai, bi, t["n"].to_numpy(), t[v].to_numpy(), tol, most)
        levels, components = (len(au), len(bu)), parts(ai, bi)
        kinds = dict(cells.dtypes)
        back = lambda k, u, e: df.sparkSession.createDataFrame([(x, *map(float, r)) for x, r in zip(u.tolist(), e, strict=True)], f"{k} {kinds[k]}, " + ", ".join(f"{n} double" for n in names))
        left, right = F.broadcast(back("a", au, left)), F.broadcast(back("b", bu, right))
    else:
        levels = count("a"), count("b")
        if min(levels) > few_levels:
            left, right, steps, components = _spread(cells, v, tol, min(most, 500))
        elif levels[1] <= levels[0]:
            (right, left, components), steps = _direct(cells, "b", "a", v), 1
        else:
            (left, right, components), steps = _direct(cells, "a", "b", v), 1
        left, right = small(left, "left")[0], small(right, "right")[0]
    right = right.withColumnsRenamed({n: f"_{n}" for n in names})
    clean = rows.join(left, "a").join(right, "b").select(*(F.col(c) for c in ["_c"] if cluster), *((F.col(c) - F.col(n) - F.col(f"_{n}")).alias(c) for c, n in zip(v, names, strict=True)), F.col(v[-1]).alias("_y"))
    clean = _keep(clean, "clean")
    k = len(xs)
    gram = clean.agg(F.count("*").alias("n"), F.sum("_y").alias("sy"), F.sum(F.col("_y") * F.col("_y")).alias("syy"), *(F.sum(F.col(v[i]) * F.col(v[j])).alias(f"g{i}_{j}") for i in range(k + 1) for j in range(i, k + 1))).first()
    g = np.array([[gram[f"g{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
    scale = np.array([[c] for c in cells.agg(*(F.sum(F.col(c) * F.col(c) / F.col("n")) for c in v[:k])).first()]).ravel()
    if (np.diag(g)[:k] <= 1e-16 * np.maximum(scale, 1e-300)).any() or np.linalg.matrix_rank(g[:k, :k]) < k:
        raise ValueError("a regressor is explained by the effects or by others")
    inverse = np.linalg.inv(g[:k, :k])
    beta = inverse @ g[:k, k]
    e: Column = F.col(v[k])
    for i in range(k):
        e = e - float(beta[i]) * F.col(v[i])
    scored = clean.select(*(["_c"] if cluster else []), e.alias("_e"), *((e * F.col(v[i])).alias(f"s{i}") for i in range(k)))
    if cluster:  # a cluster's score is the sum of its rows'
        scored = scored.groupBy("_c").agg(F.sum(F.col("_e") * F.col("_e")).alias("ee"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(k)))
    else:
        scored = scored.withColumn("ee", F.col("_e") * F.col("_e"))
    m = scored.agg(F.count("*").alias("groups"), F.sum("ee").alias("ssr"), *(F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k))).first()
    meat = np.array([[m[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    n, coefficients = gram.n, k + levels[0] + levels[1] - components
    free = max(n - coefficients, 1)
    factor = m.groups / (m.groups - 1) * (n - 1) / free if cluster else n / free
    se = np.sqrt(np.maximum(np.diag(inverse @ meat @ inverse) * factor, 0))
    total = gram.syy - gram.sy**2 / n
    rows_out = [(c, float(beta[i]), float(se[i]), float(beta[i] / se[i]) if se[i] > 0 else None, n, float(1 - m.ssr / total) if total > 0 else None, float(1 - m.ssr / g[k, k]) if g[k, k] > 0 else None, levels[0] + levels[1], components, steps) for i, c in enumerate(xs)]
    return df.sparkSession.createDataFrame(rows_out, "term string, coef double, se double, t double, n long, r2 double, within_r2 double, levels long, components long, steps int")
