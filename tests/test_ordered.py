import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from varve.operators import market, ordered, panel, quantiles


def rows_of(seed=3):
    """Groups of several shapes: spread over decades and signs, dense in one step, ties, one row, and nulls; one group has a null key."""
    rng = np.random.default_rng(seed)
    shapes = {
        "wide": (rng.choice([-1, 1], 701) * 10 ** rng.uniform(-8, 8, 701)).tolist(),
        "dense": (1000 + rng.uniform(0, 1e-3, 500)).tolist(),
        "ties": rng.integers(-2, 3, 400).astype(float).tolist(),
        "one": [-0.25],
        None: rng.normal(size=90).tolist(),
    }
    return [(k, i, v) for k, vs in shapes.items() for i, v in enumerate([*vs, None])]


SCHEMA = "g string, entity long, x double"


def test_steps_ascend(spark):
    xs = [float("-inf"), -1e300, -2.0, -1.0, -1e-300, 0.0, 5e-324, 1e-300, 0.5, 1.0, 1.5, 2.0, 1e300, float("inf"), float("nan")]
    got = [r.s for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", ordered.step(F.col("x")).alias("s")).orderBy("i").collect()]
    assert got == sorted(got) and len(set(got[:-1])) == len(xs) - 1 and got[-1] == got[-2]


@pytest.mark.parametrize("keys", [["g"], []])
def test_exact_quantiles_equal_numpy(spark, keys):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("y", -F.col("x"))
    ps = [0.0, 0.01, 0.5, 0.77, 1.0]
    wanted = {f"x{i}": ("x", p) for i, p in enumerate(ps)} | {"y0": ("y", 0.3)}
    got = {r["g"] if keys else "": r for r in quantiles.exact(df, wanted, keys).collect()}
    groups = {k: np.array([x for g, _, x in rows if (g == k or not keys) and x is not None]) for k in ({g for g, *_ in rows} if keys else [""])}
    assert set(got) == set(groups)
    for k, xs in groups.items():
        for i, p in enumerate(ps):
            assert math.isclose(got[k][f"x{i}"], np.quantile(xs, p), rel_tol=1e-12, abs_tol=1e-12), (k, p)
        assert math.isclose(got[k]["y0"], np.quantile(-xs, 0.3), rel_tol=1e-12, abs_tol=1e-12), k


def test_quantiles_of_nothing(spark):
    none = spark.createDataFrame([("a", 1, None)], SCHEMA)
    assert quantiles.exact(none, {"q": ("x", 0.5)}, ["g"]).count() == 0
    assert quantiles.linear(none.where("false"), "x", ["g"], [0.5]).count() == 0
    assert [r.w for r in panel.winsorize_by(none, "x", ["g"], 0.1, 0.9, "w").collect()] == [None]
    assert panel.trim_by(none, "x", ["g"], 0.1, 0.9).count() == 0


def test_winsorized_rows_stay(spark):
    rows = rows_of()
    got = panel.winsorize_by(spark.createDataFrame(rows, SCHEMA), "x", ["g"], 0.1, 0.9, "w").collect()
    assert len(got) == len(rows)
    cuts = {k: np.quantile([x for g, _, x in rows if g == k and x is not None], [0.1, 0.9]) for k in {g for g, *_ in rows}}
    for r in got:
        assert r.w is None if r.x is None else math.isclose(r.w, min(max(r.x, cuts[r.g][0]), cuts[r.g][1]), rel_tol=1e-12, abs_tol=1e-12)


@pytest.mark.parametrize(("share", "least"), [(0.1, 5), (0.0, 1), (1.0, 3), (0.02, 450)])
def test_top_rows_equal_a_full_ranking(spark, share, least):
    rows = [r for r in rows_of() if r[2] is not None]
    got = {(r.g, r.entity): (r["rank"], r.rank_total) for r in ordered.top(spark.createDataFrame(rows_of(), SCHEMA), ["g"], "x", ["entity"], share, least).collect()}
    want = {}
    for k in {g for g, *_ in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1]))
        for i, r in enumerate(own[: max(int(share * len(own)), least)], 1):
            want[k, r[1]] = (i, len(own))
    assert got == want


def test_tail_of_a_small_group_keeps_its_lowest_gap(spark):
    xs = [math.exp(v) for v in (3.0, 2.0, 1.0)]
    r = market.tail(spark.createDataFrame([("a", i, x) for i, x in enumerate(xs)], SCHEMA), ["g"], "x", 0.5, 20).first()
    assert r.k == 3 and math.isclose(r.hill, 1.0)  # the gaps 2, 1, 0, as all ranks are below 20


def test_value_ranks_and_tiles(spark):
    rows = rows_of()
    got = {(r.g, r.entity): r.a for r in ordered.value_ranks(spark.createDataFrame(rows, SCHEMA), ["g"], "x", "a").collect()}
    assert got == {(g, e): None if x is None else 1 + sum(1 for h, _, y in rows if h == g and y is not None and y < x) for g, e, x in rows}
    for n in (1, 3, 4, 5, 11):
        df = spark.range(1, n + 1).select(F.col("id").alias("rank"), F.lit(n).cast("long").alias("rank_total"))
        tiles = [r.t for r in df.select("rank", ordered.tiles(4).alias("t")).orderBy("rank").collect()]
        assert tiles == [t + 1 for t, part in enumerate(np.array_split(np.arange(n), 4)) for _ in part]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("keys", [["g"], []])
def test_edges_equal_ranks(spark, keys):
    df = spark.createDataFrame([(g, e, None if e % 11 == 0 else float(e * e % 13) - 4) for g, n in (("a", 61), ("b", 3), (None, 10), ("c", 1)) for e in range(n)], "g string, e long, x double").repartition(5)
    got = ordered.edges(df, keys, "x", ["e", *(["g"] if not keys else [])], lambda n: [F.floor(n * j / 5) for j in range(1, 5)], "at").toPandas()
    df = df.toPandas()
    order = df.assign(null=df["x"].notna(), gn=df["g"].notna()).sort_values(["null", "x", "e", "gn", "g"])
    by = order.groupby("g", dropna=False) if keys else order.assign(all=1).groupby("all")
    order["q"] = np.ceil(5 * (by.cumcount() + 1) / by["e"].transform("size"))
    met = got.merge(order, on=["g", "e"])
    assert len(met) == 75 and (5 - met["at"] == met["q"]).all()


def test_ranks_do_not_move_rows_again(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(500)], "g long, e long")
    run = ordered.running(df, ["g"], [F.col("e")])
    assert "Exchange hashpartitioning" not in plan(run)
    assert [r["rank"] for r in run.where("g = 1").sort("e").collect()] == list(range(1, 168))


def test_quantiles_of_few_values_sort_no_rows(spark, monkeypatch):
    """In a column of few values every row is in a wanted step: rows are counted where they are, not sorted or dealt out by value."""
    seen, run = [], ordered.running
    monkeypatch.setattr(quantiles, "running", lambda df, *a, **k: seen.append(plan(df)) or run(df, *a, **k))
    df = spark.createDataFrame([(i % 2, float(i % 3)) for i in range(900)], "g long, x double")
    got = {r.g: (r.q0, r.q1) for r in quantiles.linear(df, "x", ["g"], [0.25, 0.9]).collect()}
    assert got == {0: (0.0, 2.0), 1: (0.0, 2.0)}
    assert "SortAggregate" not in seen[0] and "SortMergeJoin" not in seen[0]
