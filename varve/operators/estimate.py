"""Grouped estimators whose data stay on the executors: what reaches the driver is a row of sums for each group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The share's terms, and those of the second step's function of capital and labour.
TERMS = ("1", "k", "m", "l", "kk", "mm", "ll", "km", "kl", "ml")
CONSTANT = ("k", "l", "kk", "ll", "kl")
#: Below this, the logarithm of the share goes on as its tangent.
FLOOR = 1e-6


def _gram(vector: list[Column]) -> list[Column]:
    """Sums of the products of the vector's entries, upper triangle by rows."""
    return [F.sum(vector[i] * vector[j]).alias(f"g{i}_{j}") for i in range(len(vector)) for j in range(i, len(vector))]


def _matrix(row, n: int) -> np.ndarray:
    out = np.empty((n, n))
    for i in range(n):
        for j in range(i, n):
            out[i, j] = out[j, i] = row[f"g{i}_{j}"]
    return out


def wls(df: DataFrame, y: str, xs: list[str], keys: list[str], weight: str | None = None) -> DataFrame:
    """Per group and regressor (``const`` included): n, coef and HC1 standard error of (weighted) least squares.

    Two passes: one for the cross moments, one for the residuals' meat. A group with a singular matrix or no more rows
    than coefficients gives no row; rows with a null in any column are left out.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    df = df.select(*keys, *(F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate([*xs, y])), w.cast("double").alias("_w")).dropna().where("_w > 0")
    names, k = ["const", *xs], len(xs) + 1
    x = [F.lit(1.0), *(F.col(f"_v{i}") for i in range(k - 1))]
    target = F.col(f"_v{k - 1}")
    schema = df.select(*keys).schema
    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    root = F.sqrt("_w")
    moments = df.groupBy(*keys).agg(F.count("*").alias("n"), *_gram([root * c for c in [*x, target]]))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                g = _matrix(row, k + 1)
                if row["n"] > k and np.linalg.matrix_rank(g[:k, :k]) == k:
                    inverse = np.linalg.inv(g[:k, :k])
                    rows.append((*(row[c] for c in keys), row["n"], (inverse @ g[:k, k]).tolist(), inverse.ravel().tolist()))
            yield pd.DataFrame(rows, columns=[*keys, "n", "_b", "_inv"])

    fitted = moments.mapInPandas(solve, f"{key_ddl}, n long, _b array<double>, _inv array<double>")
    e = target - sum((F.col("_b")[i] * x[i] for i in range(1, k)), F.col("_b")[0])
    meat = df.join(fitted, keys).groupBy(*keys).agg(F.first("n").alias("n"), F.first("_b").alias("_b"), F.first("_inv").alias("_inv"), *_gram([F.col("_w") * e * c for c in x]))

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                inverse = np.array(row["_inv"]).reshape(k, k)
                cov = inverse @ _matrix(row, k) @ inverse * row["n"] / (row["n"] - k)
                rows += [(*(row[c] for c in keys), names[i], row["n"], float(row["_b"][i]), float(np.sqrt(cov[i, i]))) for i in range(k)]
            yield pd.DataFrame(rows, columns=[*keys, "term", "n", "coef", "se"])

    return meat.mapInPandas(errors, f"{key_ddl}, term string, n long, coef double, se double")


def share_terms(k: Column, m: Column, l: Column) -> list[Column]:  # noqa: E741
    return [F.lit(1.0), k, m, l, k * k, m * m, l * l, k * m, k * l, m * l]


def centred(df: DataFrame, key: str) -> DataFrame:
    """k, m and l as deviations from their means in the group; the quadratic form is as general, and better conditioned."""
    names = ("k", "m", "l")
    means = df.groupBy(key).agg(*(F.avg(c).alias(f"_m{c}") for c in names))
    return df.join(means, key).withColumns({c: F.col(c) - F.col(f"_m{c}") for c in names}).drop(*(f"_m{c}" for c in names))


#: Groups up to which a step's sums are made by matrix products in the tasks; beyond, by Spark's aggregation.
FEW_GROUPS = 100


def share_sums(batches: Iterator[pd.DataFrame], trial: dict[int, list[tuple[int, np.ndarray]]]) -> Iterator[pd.DataFrame]:
    """Per group number _g and start _j of a task's rows (_g, k, m, l, s): their number and the sums of products of ``share_nls``, as a flat matrix q. trial: group -> (start, coefficients)."""
    total: dict = {}
    for batch in batches:
        number = batch["_g"].to_numpy()
        k, m, l, s = (batch[c].to_numpy() for c in ("k", "m", "l", "s"))  # noqa: E741
        terms = np.column_stack([np.ones(len(k)), k, m, l, k * k, m * m, l * l, k * m, k * l, m * l])
        for g in np.unique(number).tolist():
            at = number == g
            p, share = terms[at], s[at]
            for j, c in trial.get(g, []):
                fit = p @ c
                low, above = fit < FLOOR, np.maximum(fit, FLOOR)
                value = np.where(low, np.log(FLOOR) + fit / FLOOR - 1, np.log(above))
                v = np.column_stack([p / above[:, None], value - share])
                n, q = total.get((g, j), (0, 0.0))
                total[g, j] = (n + len(p), q + v.T @ v)
    yield pd.DataFrame([(g, j, n, q.ravel().tolist()) for (g, j), (n, q) in total.items()], columns=["_g", "_j", "n", "q"])


#: Groups whose coefficients and sums the driver holds while it steps.
MOST_GROUPS = 20_000


def share_starts(df: DataFrame, key: str, jitters: int = 2, seed: int = 1) -> dict:
    """Per group its starting points: a constant share; least squares of exp(s) on the terms, moved up until the fit at the mean share is positive; and seeded
    jitters of the latter. One aggregation of sums by group."""
    p, t = share_terms(F.col("k"), F.col("m"), F.col("l")), len(TERMS)
    rows = df.groupBy(key).agg(F.avg("s").alias("a"), F.min(F.exp("s")).alias("low"), *_gram([*p, F.exp("s")])).collect()  # a row a group
    out = {}
    for r in rows:
        g = _matrix(r, t + 1)
        guess = np.linalg.lstsq(g[:t, :t], g[:t, t], rcond=None)[0]
        guess[0] = max(guess[0], r.low / 2)  # the terms are centred, so this is the fit at their means
        rng = np.random.default_rng([seed, *str(r[key]).encode()])
        spread = 0.1 * np.maximum(np.abs(guess), 0.01)
        out[r[key]] = [np.array([np.exp(r.a), *[0.0] * (t - 1)]), guess, *(guess + spread * rng.normal(size=t) for _ in range(jitters))]
    return out


def share_nls(df: DataFrame, key: str, most: int = 40, tol: float = 1e-8, starts: dict | None = None, bound: float = 100.0) -> DataFrame:
    """Per group: n, loss, converged and the coefficients c0 to c9 that minimize mean((ln(P c) - s)^2), P the quadratic
    TERMS of k, m and l, and n_starts, n_converged and spread (of the losses that the starts reach).

    Levenberg-Marquardt steps from all starts of all groups at once: a step is one aggregation of 66 sums by group and start, so a group of any size is summed by all tasks; the driver
    holds coefficients alone, and more than MOST_GROUPS groups are refused. starts: group -> points (``share_starts``); by default a constant share. Coefficients stay within
    bound (100 for the constant, a tenth of that for others): a step is cut off there. The least loss is kept, ties to the earlier start. converged: a step no longer lowers the loss by
    tol of it, within most steps."""
    spark = df.sparkSession
    df = df.select(key, "k", "m", "l", "s").dropna().persist()
    kind = df.schema[key].dataType.simpleString()
    p, t = share_terms(F.col("k"), F.col("m"), F.col("l")), len(TERMS)
    limit = np.array([bound, *[bound / 10] * (t - 1)])
    fit = sum((F.col("_c")[i] * p[i] for i in range(1, t)), F.col("_c")[0])
    low = fit < FLOOR
    value = F.when(low, np.log(FLOOR) + fit / FLOOR - 1).otherwise(F.ln(F.greatest(fit, F.lit(FLOOR))))
    slope = F.when(low, 1 / FLOOR).otherwise(1 / F.greatest(fit, F.lit(FLOOR)))
    vector = [*(slope * x for x in p), value - F.col("s")]

    def sums(trial: dict) -> dict:
        if packed is not None:
            told: dict = {}
            for (g, j), c in trial.items():
                told.setdefault(place[g], []).append((j, c))
            parts = packed.where(F.col("_g").isin(list(told))).mapInPandas(lambda rows: share_sums(rows, told), "_g int, _j int, n long, q array<double>")
            each = parts.select("_g", "_j", "n", F.posexplode("q").alias("at", "q")).groupBy("_g", "_j", "at").agg(F.sum("n").alias("n"), F.sum("q").alias("q")).collect()  # a matrix a group and start
            made: dict = {}
            for r in each:
                n, q = made.setdefault((few[r["_g"]][key], r["_j"]), (r["n"], np.empty((t + 1) ** 2)))
                q[r["at"]] = r["q"]
            return {g: (n, q.reshape(t + 1, t + 1)) for g, (n, q) in made.items()}
        table = spark.createDataFrame([(g, j, c.tolist()) for (g, j), c in trial.items()], f"`{key}` {kind}, _j int, _c array<double>")
        rows = df.join(F.broadcast(table), key).groupBy(key, "_j").agg(F.count("*").alias("n"), *_gram(vector)).collect()  # a row a group and start
        return {(r[key], r["_j"]): (r.n, _matrix(r, t + 1)) for r in rows}

    few = df.groupBy(key).agg(F.avg("s").alias("a")).limit(MOST_GROUPS + 1).collect()
    if len(few) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups of {key}")
    packed, place = None, {r[key]: i for i, r in enumerate(few)}
    if 0 < len(few) <= FEW_GROUPS:
        numbers = spark.createDataFrame([(g, i) for g, i in place.items()], f"`{key}` {kind}, _g int")
        packed = df.join(F.broadcast(numbers), key).select("_g", *(F.col(c).cast("double").alias(c) for c in ("k", "m", "l", "s"))).persist()
    points = {r[key]: [np.array([np.exp(r.a), *[0.0] * (t - 1)])] for r in few} if starts is None else {r[key]: starts[r[key]] for r in few}
    best = {(g, j): np.clip(np.asarray(c, float), -limit, limit) for g, cs in points.items() for j, c in enumerate(cs)}
    state, damping, done = sums(best) if best else {}, dict.fromkeys(best, 1e-3), set()
    for _ in range(most):
        trial = {}
        for g in best:
            if g not in done:
                a, b = state[g][1][:t, :t], state[g][1][:t, t]
                trial[g] = np.clip(best[g] - np.linalg.lstsq(a + damping[g] * np.diag(np.maximum(np.diag(a), 1e-12)), b, rcond=None)[0], -limit, limit)
        if not trial:
            break
        for g, (n, matrix) in sums(trial).items():
            before, after = state[g][1][t, t], matrix[t, t]
            if after <= before:
                best[g], state[g], damping[g] = trial[g], (n, matrix), damping[g] / 5
                if before - after <= tol * before:
                    done.add(g)
            else:
                damping[g] *= 10
                if damping[g] > 1e6:
                    done.add(g)
    df.unpersist()
    if packed is not None:
        packed.unpersist()
    rows = []
    for g, cs in points.items():
        losses = [float(state[g, j][1][t, t] / state[g, j][0]) for j in range(len(cs))]
        j = int(np.argmin(losses))
        rows.append((g, int(state[g, j][0]), losses[j], (g, j) in done, *map(float, best[g, j]), len(cs), sum((g, i) in done for i in range(len(cs))), max(losses) - min(losses)))
    return spark.createDataFrame(rows, f"`{key}` {kind}, n long, loss double, converged boolean, " + ", ".join(f"c{i} double" for i in range(t)) + ", n_starts int, n_converged int, spread double")


def elasticities(df: DataFrame, coefficients: DataFrame, key: str) -> DataFrame:
    """df with melast (the fitted share), integral (of it over m), kelast and lelast (the integral's slopes in k and l)."""
    c = [F.col(f"c{i}") for i in range(len(TERMS))]
    k, m, l = F.col("k"), F.col("m"), F.col("l")  # noqa: E741
    made = df.join(F.broadcast(coefficients.select(key, *(f"c{i}" for i in range(len(TERMS))))), key)  # a row a group
    return made.withColumns({
        "melast": sum((a * b for a, b in zip(c[1:], share_terms(k, m, l)[1:], strict=True)), c[0]),
        "integral": m * (c[0] + c[1] * k + c[3] * l + c[4] * k * k + c[6] * l * l + c[8] * k * l + m * (c[2] + c[7] * k + c[9] * l) / 2 + c[5] * m * m / 3),
        "kelast": m * (c[1] + 2 * c[4] * k + c[8] * l + c[7] * m / 2),
        "lelast": m * (c[3] + 2 * c[6] * l + c[8] * k + c[9] * m / 2),
    }).drop(*(f"c{i}" for i in range(len(TERMS))))


def cross_moments(df: DataFrame, keys: list[str], make: Callable[[pd.DataFrame], np.ndarray], width: int) -> DataFrame:
    """Per group: n and gram, the sums of products of make's columns (upper triangle by rows). Each task adds up its rows in
    numpy, and the tasks' sums are added by group and place."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    upper = np.triu_indices(width)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, rows in batch.groupby(keys):
                x = make(rows)
                held[key] = held.get(key, 0) + np.append((x.T @ x)[upper], len(rows))
        yield pd.DataFrame([(*k, v.tolist()) for k, v in held.items()], columns=[*keys, "g"])

    sums = df.mapInPandas(part, f"{kinds}, g array<double>").select(*keys, F.posexplode("g").alias("pos", "g")).groupBy(*keys, "pos").agg(F.sum("g").alias("g"))
    last = len(upper[0])
    whole = sums.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "g"))).alias("g"))
    return whole.select(*keys, F.col("g")[last]["g"].cast("long").alias("n"), F.slice("g.g", 1, last).alias("gram"))


def markov_gmm(df: DataFrame, keys: list[str], most: int = 60) -> DataFrame:
    """Per group: n, alpha_<term> of CONSTANT, persistence, loss and converged.

    Productivity is w = a - alpha.(k, l, kk, ll, kl) and follows a quadratic Markov process; alpha makes the innovation
    orthogonal to k, kk, the lagged l, its square, and k times it. w, its lag and the lag's square are linear in 35 monomials
    with weights that depend on alpha alone, so one pass for the monomials' cross moments gives the exact moments at
    any alpha; Newton steps, halved until the moments shrink, from the least-squares alpha, half of it and zero find where
    they vanish, and the best is kept. loss: sum of squared moments; converged: it is zero to rounding. df has a, k, l and their lags l_a, l_k,
    l_l; rows with a null are left out, and groups of fewer rows than monomials.
    """
    names = ["a", "k", "l", "l_a", "l_k", "l_l"]
    df = df.select(*keys, *(F.col(c).cast("double").alias(c) for c in names)).dropna()
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    left, right = np.triu_indices(6)
    at = {"a": 1, "p": slice(2, 7), "lag": slice(7, 13), "squares": slice(13, 34)}
    instruments = [2, 4, 9, 11, 34]  # k, kk, lagged l, its square, k times it

    def make(x: pd.DataFrame) -> np.ndarray:
        a, k, l, la, lk, ll = (x[c].to_numpy() for c in names)  # noqa: E741
        lag = np.stack([la, lk, ll, lk * lk, ll * ll, lk * ll], 1)
        return np.column_stack([np.ones(len(x)), a, k, l, k * k, l * l, k * l, lag, lag[:, left] * lag[:, right], k * ll])

    def moments(g: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, x, own = np.zeros(35), np.zeros((3, 35)), np.concatenate(([1.0], -alpha))
        w[at["a"]], w[at["p"]] = 1, -alpha
        x[0, 0], x[1, at["lag"]] = 1, own
        x[2, at["squares"]] = np.where(left == right, 1, 2) * own[left] * own[right]
        b = np.linalg.lstsq(x @ g @ x.T, x @ g @ w, rcond=None)[0]
        return g[instruments] @ (w - b @ x), b

    def solve_one(g: np.ndarray) -> tuple[np.ndarray, float, float]:
        design = [0, *range(2, 7)]
        ols = np.linalg.lstsq(g[np.ix_(design, design)], g[design, 1], rcond=None)[0][1:]
        best = None
        for alpha in (ols, ols / 2, np.zeros(5)):
            f = moments(g, alpha)[0]
            for _ in range(most):
                h = 1e-5 * np.maximum(1, np.abs(alpha))
                jac = np.stack([(moments(g, alpha + h * e)[0] - moments(g, alpha - h * e)[0]) / (2 * h[i]) for i, e in enumerate(np.eye(5))], 1)
                step, size = np.linalg.lstsq(jac, -f, rcond=None)[0], 1.0
                while size > 1e-4 and not (trial := moments(g, alpha + size * step)[0]) @ trial < f @ f:
                    size /= 2
                if size <= 1e-4 or f @ f < 1e-24:
                    break
                alpha, f = alpha + size * step, trial
            if best is None or f @ f < best[1]:
                best = alpha, float(f @ f)
        return best[0], best[1], float(moments(g, best[0])[1][1])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                if row["n"] < 35:
                    continue
                g = np.zeros((35, 35))
                g[np.triu_indices(35)] = row["gram"]
                alpha, loss, persistence = solve_one((g + np.triu(g, 1).T) / row["n"])
                out.append((*(row[c] for c in keys), row["n"], *alpha.tolist(), persistence, loss, loss < 1e-14))
            yield pd.DataFrame(out, columns=[*keys, "n", *(f"alpha_{c}" for c in CONSTANT), "persistence", "loss", "converged"])

    return cross_moments(df, keys, make, 35).mapInPandas(solve, f"{kinds}, n long, {', '.join(f'alpha_{c} double' for c in CONSTANT)}, persistence double, loss double, converged boolean")


def iv_exogenous(df: DataFrame, y: str, x: str, z: str, exogenous: list[str], keys: list[str]) -> DataFrame:
    """Per group: n, beta of x (instrument z, with exogenous regressors and a constant), its HC0 standard error, and the
    first stage's robust t of z. Two passes, as in ``wls``: cross moments, then both stages' squared scores."""
    names = [x, z, y, *exogenous]
    df = df.select(*keys, *(F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(names))).dropna()
    more = [F.lit(1.0), *(F.col(f"_v{i}") for i in range(3, len(names)))]
    k = len(more) + 1
    xs, zs, target = [F.col("_v0"), *more], [F.col("_v1"), *more], F.col("_v2")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    moments = df.groupBy(*keys).agg(F.count("*").alias("n"), *_gram([F.col("_v0"), F.col("_v1"), target, *more]))
    zi, xi = [1, *range(3, k + 2)], [0, *range(3, k + 2)]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                g = _matrix(row, k + 2)
                zx, zz = g[np.ix_(zi, xi)], g[np.ix_(zi, zi)]
                if row["n"] > k and np.linalg.matrix_rank(zx) == k and np.linalg.matrix_rank(zz) == k:
                    rows.append((*(row[c] for c in keys), row["n"], np.linalg.solve(zx, g[zi, 2]).tolist(), np.linalg.solve(zz, g[zi, 0]).tolist(), np.linalg.inv(zx)[0].tolist(), np.linalg.inv(zz)[0].tolist()))
            yield pd.DataFrame(rows, columns=[*keys, "n", "_b", "_p", "_zx", "_zz"])

    fitted = moments.mapInPandas(solve, f"{kinds}, n long, _b array<double>, _p array<double>, _zx array<double>, _zz array<double>")
    dot = lambda name, v: sum((F.col(name)[i] * c for i, c in enumerate(v)), F.lit(0.0))
    scored = df.join(fitted, keys).select(*keys, "n", F.col("_b")[0].alias("beta"), F.col("_p")[0].alias("_pi"), ((target - dot("_b", xs)) * dot("_zx", zs)).alias("_u"), ((F.col("_v0") - dot("_p", zs)) * dot("_zz", zs)).alias("_w"))
    return scored.groupBy(*keys).agg(F.first("n").alias("n"), F.first("beta").alias("beta"), F.sqrt(F.sum(F.col("_u") * F.col("_u"))).alias("se"), (F.first("_pi") / F.sqrt(F.sum(F.col("_w") * F.col("_w")))).alias("first_t"))
