"""Many least-squares specifications at once: one Gram matrix of all columns, each specification solved from its sub-block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.sources.files import small


def least_squares(df: DataFrame, keys: list[str], specs: dict[str, tuple[str, list[str]]], weights: dict[str, str | None] | None = None, absorbs: dict[str, str | None] | None = None) -> DataFrame:
    """Per group of keys, weighting, absorbed factor, specification and regressor: n, coef, se (HC1), r2, within_r2, partial_r2, alone_r2.

    specs: name -> (y, regressors). weights: name -> column (None: rows count alike). absorbs: name -> column whose levels have
    an effect each (None: a constant). Rows with a null in any used column, or without a positive weight, are left out of all.

    Rows are read for the levels' means, for the Gram matrices of all columns, and for the errors of all specifications: three times, however many there are.
    within_r2 is after the effects; partial_r2 is the regressor's given the others; alone_r2 the regressor's without them, both after
    the effects. A specification that is singular in a group, or has no more rows than coefficients, gives no rows there."""
    weights, absorbs = weights or {"none": None}, absorbs or {"none": None}
    columns = list(dict.fromkeys(c for y, xs in specs.values() for c in [y, *xs]))
    place = {c: i for i, c in enumerate(columns)}
    v = [f"_v{i}" for i in range(len(columns))]
    schemes = F.explode(F.array(*(
        F.struct(F.lit(wn).alias("weight"), F.lit(an).alias("absorb"), (F.col(w).cast("double") if w else F.lit(1.0)).alias("w"), (F.col(a).cast("string") if a else F.lit("")).alias("g"))
        for wn, w in weights.items() for an, a in absorbs.items()
    ))).alias("s")
    rows = df.select(*keys, *(F.col(c).cast("double").alias(n) for c, n in zip(columns, v, strict=True)), schemes).select(*keys, *v, "s.*").dropna().where("w > 0")
    scheme = [*keys, "weight", "absorb"]
    means = rows.groupBy(*scheme, "g").agg(F.sum("w").alias("_W"), *(F.try_divide(F.sum(F.col("w") * F.col(c)), F.sum("w")).alias(f"m{c}") for c in v))
    means = small(means, "means")[0]  # a row a level
    clean = rows.join(means, [*scheme, "g"]).select(*scheme, "w", *((F.col(c) - F.col(f"m{c}")).alias(c) for c in v))
    k = len(v)
    gram = clean.groupBy(*scheme).agg(F.count("*").alias("n"), *(F.sum(F.col("w") * F.col(v[i]) * F.col(v[j])).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)))
    # Sums of squares between the levels, from one row a level.
    wide = means.groupBy(*scheme).agg(F.count("*").alias("levels"), *((F.sum(F.col("_W") * F.col(f"m{c}") * F.col(f"m{c}")) - F.try_divide(F.pow(F.sum(F.col("_W") * F.col(f"m{c}")), 2), F.sum("_W"))).alias(f"b{i}") for i, c in enumerate(v)))
    moments = gram.join(wide, scheme)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in moments.select(*scheme).schema)

    def block(row: dict) -> np.ndarray:
        return np.array([[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                g = block(row)
                made = [row[c] for c in scheme] + [row["n"], row["levels"]]
                for y, xs in specs.values():
                    at, yi = [place[x] for x in xs], place[y]
                    a, b = g[np.ix_(at, at)], g[at, yi]
                    scale = np.sqrt(np.maximum(np.diag(a), 0))
                    sound = row["n"] > len(xs) + row["levels"] and (scale > 0).all() and np.linalg.matrix_rank(a / np.outer(scale, scale), tol=1e-9) == len(xs)
                    if not sound:
                        made += [None, None, None]
                        continue
                    inverse = np.linalg.inv(a / np.outer(scale, scale)) / np.outer(scale, scale)
                    beta = inverse @ b
                    ssr, within, total = g[yi, yi] - beta @ b, g[yi, yi], g[yi, yi] + max(row[f"b{yi}"], 0.0)
                    share = [1 - ssr / total if total > 0 else np.nan, 1 - ssr / within if within > 0 else np.nan]
                    for i in range(len(xs)):
                        alone = b[i] ** 2 / (a[i, i] * within) if within > 0 else np.nan
                        gain = beta[i] ** 2 / inverse[i, i]  # what the others alone leave more
                        share += [gain / (ssr + gain) if ssr + gain > 0 else np.nan, alone]
                    made += [beta.tolist(), inverse.ravel().tolist(), [float(s) for s in share]]
                out.append(made)
            yield pd.DataFrame(out, columns=[*scheme, "n", "levels", *(f"{c}{i}" for i in range(len(specs)) for c in ("beta", "inv", "share"))])

    solved = moments.mapInPandas(solve, f"{ddl}, n long, levels long, " + ", ".join(f"beta{i} array<double>, inv{i} array<double>, share{i} array<double>" for i in range(len(specs))))
    solved = small(solved, "solved")[0]  # a row a group: rows meet it where they are
    met = clean.join(solved, scheme)
    meats = []
    for s, (y, xs) in enumerate(specs.values()):
        e = F.col(v[place[y]])
        for i, x in enumerate(xs):
            e = e - F.col(f"beta{s}")[i] * F.col(v[place[x]])
        meats += [F.sum(F.pow(F.col("w") * e, 2) * F.col(v[place[xs[i]]]) * F.col(v[place[xs[j]]])).alias(f"q{s}_{i}_{j}") for i in range(len(xs)) for j in range(i, len(xs))]
    kept = [c for c in solved.columns if c not in scheme]
    full = met.groupBy(*scheme).agg(*(F.first(c).alias(c) for c in kept), *meats)

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                for s, (name, (_, xs)) in enumerate(specs.items()):
                    if row[f"beta{s}"] is None:
                        continue
                    m = len(xs)
                    inverse = np.array(row[f"inv{s}"]).reshape(m, m)
                    meat = np.array([[row[f"q{s}_{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)])
                    se = np.sqrt(np.maximum(np.diag(inverse @ meat @ inverse), 0) * row["n"] / (row["n"] - m - row["levels"]))
                    share = row[f"share{s}"]
                    out += [(*(row[c] for c in scheme), name, x, row["n"], float(row[f"beta{s}"][i]), float(se[i]), share[0], share[1], share[2 + 2 * i], share[3 + 2 * i]) for i, x in enumerate(xs)]
            yield pd.DataFrame(out, columns=[*scheme, "spec", "term", "n", "coef", "se", "r2", "within_r2", "partial_r2", "alone_r2"])

    return full.mapInPandas(errors, f"{ddl}, spec string, term string, n long, coef double, se double, r2 double, within_r2 double, partial_r2 double, alone_r2 double")


def differences(wide: DataFrame, group: str, series: str, period: str, columns: dict[str, str], weight: str, windows: dict[str, tuple[list[int], list[int]]]) -> DataFrame:
    """Long and stacked differences in one pass: per group and window (name -> (start periods, end periods)) d_<name> of the columns, the mean of the end
    periods less that of the start periods, and the weight's mean at the start; null if a period is missing.

    wide has one row for each group and period (so a group's periods are few); ``series`` names the output's window column."""
    at = F.map_from_entries(F.collect_list(F.struct(period, F.struct(*(F.col(c).alias(n) for n, c in columns.items()), F.col(weight).alias("_w"))))).alias("at")
    held = wide.groupBy(group).agg(at)

    def mean(periods: list[int], c: str):
        return sum((F.try_element_at("at", F.lit(p))[c] for p in periods[1:]), F.try_element_at("at", F.lit(periods[0]))[c]) / len(periods)

    made = F.explode(F.array(*(F.struct(F.lit(name).alias(series), *((mean(end, c) - mean(start, c)).alias(f"d_{c}") for c in columns), mean(start, "_w").alias("w")) for name, (start, end) in windows.items())))
    return held.select(group, made.alias("m")).select(group, "m.*")
