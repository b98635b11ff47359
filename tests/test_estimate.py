import numpy as np
import pandas as pd

from varve.operators import estimate


def terms(k, m, l):  # noqa: E741
    return np.stack([np.ones_like(k), k, m, l, k * k, m * m, l * l, k * m, k * l, m * l], 1)


TRUE = np.array([0.5, 0.05, 0.08, 0.03, -0.01, 0.03, 0.01, 0.02, -0.02, 0.015])


def test_share_nls_finds_the_coefficients(spark):
    g = np.random.default_rng(1)
    k, m, lab = g.normal(0, 0.5, (3, 4000))
    s = np.log(terms(k, m, lab) @ TRUE) + g.normal(0, 0.01, 4000)
    df = spark.createDataFrame(pd.DataFrame({"cell": np.where(np.arange(4000) % 2, "a", "b"), "k": k, "m": m, "l": lab, "s": s}))
    got = estimate.share_nls(df, "cell").toPandas()
    assert sorted(got["cell"]) == ["a", "b"] and (got["n"] == 2000).all() and got["converged"].all()
    assert np.abs(got[[f"c{i}" for i in range(10)]].to_numpy() - TRUE).max() < 0.005
    assert np.abs(got["loss"] - 1e-4).max() < 1e-5
    assert estimate.share_nls(df.where("k > 99"), "cell").count() == 0


def test_markov_gmm_finds_capital_and_labour(spark):
    g = np.random.default_rng(2)
    n, rho, alpha = 40000, 0.7, np.array([0.35, 0.4, 0.02, -0.03, 0.01])
    w0, lk, ll = g.normal(0, 1, n), g.normal(0, 1, n), g.normal(0, 1, n)
    shock = g.normal(0, 0.2, n)
    k = 0.8 * lk + 0.3 * w0 + g.normal(0, 0.5, n)
    lab = 0.7 * ll + 0.2 * w0 + shock + g.normal(0, 0.3, n)  # labour sees the innovation, so least squares is biased
    p2 = lambda a, b: np.stack([a, b, a * a, b * b, a * b], 1) @ alpha
    a, la = rho * w0 + shock + p2(k, lab), w0 + p2(lk, ll)
    df = spark.createDataFrame(pd.DataFrame({"cell": "c", "a": a, "k": k, "l": lab, "l_a": la, "l_k": lk, "l_l": ll}))
    got = estimate.markov_gmm(df.repartition(5), ["cell"]).toPandas().iloc[0]
    found = got[[f"alpha_{t}" for t in estimate.CONSTANT]].to_numpy(float)
    assert got["n"] == n and got["loss"] < 1e-6, got["loss"]
    assert np.abs(found - alpha).max() < 0.05 and abs(got["persistence"] - rho) < 0.03, (found, got["persistence"])
    w, lw = a - np.stack([k, lab, k * k, lab * lab, k * lab], 1) @ found, la - np.stack([lk, ll, lk * lk, ll * ll, lk * ll], 1) @ found
    design = np.stack([np.ones(n), lw, lw * lw], 1)
    rest = w - design @ np.linalg.lstsq(design, w, rcond=None)[0]
    direct = np.array([(rest * z).mean() for z in (k, k * k, ll, ll * ll, k * ll)])
    assert abs(direct @ direct - got["loss"]) < 1e-10 and got["converged"] == (got["loss"] < 1e-14)


def test_iv_equals_matrix_algebra(spark):
    g = np.random.default_rng(5)
    n = 3000
    z, c, d, u = g.normal(0, 1, (4, n))
    x = z + 0.5 * c + 0.7 * u + g.normal(0, 1, n)
    y = 1 + 2 * x - c + 0.3 * d + u * (1 + z * z)
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "x": x, "z": z, "y": y, "c": c, "d": d}))
    got = estimate.iv_exogenous(df, "y", "x", "z", ["c", "d"], ["g"]).toPandas().iloc[0]
    xs, zs = np.stack([x, c, d, np.ones(n)], 1), np.stack([z, c, d, np.ones(n)], 1)
    inv = np.linalg.inv(zs.T @ xs)
    b = inv @ zs.T @ y
    s = (y - xs @ b)[:, None] * zs
    zz = np.linalg.inv(zs.T @ zs)
    p = zz @ zs.T @ x
    e = (x - zs @ p)[:, None] * zs
    assert np.isclose(got["beta"], b[0]) and np.isclose(got["se"], np.sqrt((inv @ s.T @ s @ inv.T)[0, 0]))
    assert np.isclose(got["first_t"], p[0] / np.sqrt((zz @ e.T @ e @ zz)[0, 0]))


def test_wls_equals_matrix_algebra(spark):
    g = np.random.default_rng(3)
    x, z, w = g.normal(0, 1, 500), g.normal(0, 1, 500), g.random(500) + 0.1
    y = 1 + 2 * x - z + g.normal(0, 1 + np.abs(x))
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "x": x, "z": z, "y": y, "w": w}))
    got = estimate.wls(df, "y", ["x", "z"], ["g"], "w").toPandas().set_index("term")
    d = np.stack([np.ones(500), x, z], 1)
    inv = np.linalg.inv((d * w[:, None]).T @ d)
    b = inv @ (d * w[:, None]).T @ y
    e = (w * (y - d @ b))[:, None] * d
    se = np.sqrt(np.diag(inv @ e.T @ e @ inv) * 500 / 497)
    assert np.allclose(got.loc[["const", "x", "z"], "coef"], b) and np.allclose(got.loc[["const", "x", "z"], "se"], se)
    assert estimate.wls(df.limit(2), "y", ["x", "z"], ["g"]).count() == 0


def test_two_steps_on_the_proxy_panel(spark, sf):
    import __spark_entry__ as entry

    got = entry.queries()["est17_markov_gmm"](spark, sf).toPandas()  # takes the first step and the elasticities too
    assert len(got) == 6 and np.isfinite(got.drop(columns=["cell", "converged"]).to_numpy(float)).all()


def test_elasticities_are_the_slopes_of_the_integral(spark):
    c = spark.createDataFrame([("a", *TRUE.tolist())], "cell string, " + ", ".join(f"c{i} double" for i in range(10)))
    h, at = 1e-5, {"k": 0.3, "m": 0.7, "l": -0.4}
    points = {"mid": at} | {f"{v}{s}": at | {v: at[v] + s * h} for v in at for s in (-1, 1)}
    df = spark.createDataFrame([("a", n, x["k"], x["m"], x["l"]) for n, x in points.items()], "cell string, name string, k double, m double, l double")
    got = {r["name"]: r for r in estimate.elasticities(df, c, "cell").collect()}
    for v, name in (("m", "melast"), ("k", "kelast"), ("l", "lelast")):
        assert abs((got[f"{v}1"].integral - got[f"{v}-1"].integral) / (2 * h) - got["mid"][name]) < 1e-8


def test_share_sums_equal_sparks(spark, monkeypatch):
    """The tasks' matrix products give what the aggregation gives, where the fit is below the floor too."""
    rng = np.random.default_rng(8)
    k, m, l = rng.normal(size=(3, 500))  # noqa: E741
    df = spark.createDataFrame(pd.DataFrame({"cell": rng.integers(0, 3, 500), "k": k, "m": m, "l": l, "s": np.log(0.4 + 0.02 * k - 0.01 * m * m + 0.001 * rng.normal(size=500) + 0.2)})).repartition(4)
    starts = {c: [np.array([0.4, *[0.0] * 9]), np.array([-0.2, 0.3, *[0.0] * 8])] for c in range(3)}
    got = estimate.share_nls(df, "cell", most=5, starts=starts).sort("cell").toPandas()
    monkeypatch.setattr(estimate, "share_sums", None)
    monkeypatch.setattr(estimate, "FEW_GROUPS", 0)
    want = estimate.share_nls(df, "cell", most=5, starts=starts).sort("cell").toPandas()
    assert np.allclose(got.astype(float), want.astype(float), rtol=1e-6, atol=1e-9)
