import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from varve.functions import scalars
from varve.operators import guards, moments, panel
from varve.plans import registry

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), ignore_index=True)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, db, sf, name):
    got, want = plain(registry.queries()[name](spark, sf).toPandas()), plain(db.execute(registry.oracle_sql()[name]).df())
    assert len(want) and list(got.columns) == list(want.columns)
    for c in got.columns:
        if pd.api.types.is_float_dtype(want[c]) or pd.api.types.is_float_dtype(got[c]):
            assert np.allclose(got[c].astype(float), want[c].astype(float), atol=2e-6, rtol=1e-9, equal_nan=True), c
        else:
            assert (got[c] == want[c]).all(), c


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_content_hash_ignores_order_and_sees_changes(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k long, v string")
    one = moments.content_hash(df).first()
    assert one == moments.content_hash(df.orderBy("k").repartition(3)).first() and one.n == 3
    assert one.hash != moments.content_hash(df.distinct()).first().hash


def test_bootstrap_matches_the_mean_and_its_error(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(5, 2, 400)
    df = spark.createDataFrame([(int(i // 2), float(v)) for i, v in enumerate(x)], "entity long, x double")
    means = moments.bootstrap(df, "entity", "x", 300).toPandas()["mean"]
    by_entity = x.reshape(-1, 2).mean(axis=1)
    assert abs(means.mean() - x.mean()) < 0.05
    assert abs(means.std() / (by_entity.std() / np.sqrt(200)) - 1) < 0.2
    assert moments.bootstrap(df.where("entity < 0"), "entity", "x", 3).count() == 0


def test_validation_counts_faults(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 1, 0.0), (None, 1, 1.0)], "entity long, year long, x double")
    assert tuple(panel.validate(df, ["entity", "year"], "x").first()) == (3, 1, 1, 1)
    assert tuple(panel.validate(df.where("entity > 5"), ["entity", "year"], "x").first()) == (0, 0, 0, 0)


def test_guards_refuse(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "k long, v long")
    one = df.dropDuplicates(["k"])
    assert guards.require_rows(df, 3) is df and guards.join_many_to_one(df, one.withColumnRenamed("v", "w"), ["k"]).count() == 3
    assert guards.join_matched(one, one.withColumnRenamed("v", "w"), ["k"]).count() == 2
    for bad in (
        lambda: guards.require_rows(df, 4), lambda: guards.require_columns(df, ["k", "x"]), lambda: guards.require_unique(df, ["k"]), lambda: guards.join_many_to_one(one, df, ["k"]),
        lambda: guards.join_all(one, [df], ["k"]), lambda: guards.join_matched(one, one.where("k = 1"), ["k"]), lambda: guards.require_same(df, guards.fingerprint(one)),
    ):
        with pytest.raises(guards.Refused):
            bad()
    assert guards.require_same(df, guards.fingerprint(df.repartition(3))) is df


def test_scalar_functions(spark):
    from math import erf

    xs = [-6.0, -1.96, -0.5, 0.0, 0.3, 2.5, 40.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", scalars.normal_cdf(F.col("x")).alias("p"), scalars.interpolate(F.col("x"), [(-1.0, 0.0), (1.0, 4.0)]).alias("y")).collect()
    assert all(abs(r.p - (1 + erf(r.x / 2**0.5)) / 2) < 1e-7 and r.y == float(np.interp(r.x, [-1, 1], [0, 4])) for r in got)


def test_year_bounds_reach_the_scan(spark, sf):
    from varve.sources.proxy import firm_years

    plan = firm_years(spark, sf, 1996, 1998)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_shipdate" in plan
