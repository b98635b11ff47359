"""Regressions from distributed sums: only moments of a few columns leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _centred(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """columns less their means (kept as m_<column>) over the group, so that sums of their products don't cancel."""
    means = df.groupBy(*keys).agg(*(F.avg(c).alias(f"m_{c}") for c in columns))
    return df.join(means, keys).withColumns({c: F.col(c) - F.col(f"m_{c}") for c in columns})


def ols_hc1(df: DataFrame, y: str, x: str, keys: list[str]) -> DataFrame:
    """Per group n, slope, intercept, r2 and the HC1 standard error of the slope of y on x with a constant.

    The squared scores (e x)^2 are sums of products of x y and x x, so one aggregation gives all of it."""
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).alias("x"), F.col(y).alias("y"))
    xy, xx = F.col("x") * F.col("y"), F.col("x") * F.col("x")
    sums = _centred(df, ["x", "y"], keys).groupBy(*keys).agg(F.count("*").alias("n"), F.first("m_x").alias("mx"), F.first("m_y").alias("my"), F.sum(xx).alias("xx"), F.sum(xy).alias("xy"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.sum(xy * xy).alias("aa"), F.sum(xy * xx).alias("ab"), F.sum(xx * xx).alias("bb")).where("n > 2")
    b = F.col("xy") / F.col("xx")
    meat = F.greatest(F.col("aa") - 2 * b * F.col("ab") + b * b * F.col("bb"), F.lit(0.0))
    return sums.select(*keys, "n", b.alias("slope"), (F.col("my") - b * F.col("mx")).alias("intercept"), (b * F.col("xy") / F.col("yy")).alias("r2"), (F.sqrt(meat * F.col("n") / (F.col("n") - 2)) / F.col("xx")).alias("se"))


def within_slope(df: DataFrame, y: str, x: str, keys: list[str]) -> DataFrame:
    """Slope of y on x with a fixed effect for each group, by demeaning."""
    w = Window.partitionBy(*keys)
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select((F.col(x) - F.avg(x).over(w)).alias("_x"), (F.col(y) - F.avg(y).over(w)).alias("_y"))
    return df.agg(F.count("*").alias("n"), (F.sum(F.col("_x") * F.col("_y")) / F.sum(F.col("_x") * F.col("_x"))).alias("slope"))


def rolling(df: DataFrame, half: int, period: str = "year") -> DataFrame:
    """Each row once for every centre within half periods that the table has: equal keys instead of a range join."""
    bounds = df.agg(F.min(period).alias("_lo"), F.max(period).alias("_hi"))
    df = df.join(F.broadcast(bounds))
    spots = F.sequence(F.greatest(F.col(period) - half, F.col("_lo")), F.least(F.col(period) + half, F.col("_hi")))
    return df.withColumn("centre", F.explode(spots)).drop("_lo", "_hi")


def rolling_iv(df: DataFrame, y: str, x: str, z: str, key: str, half: int, centres: tuple[int, int], impute: list[int], min_obs: int, period: str = "year") -> DataFrame:
    """Just-identified IV of y on x (instrument z, constant) in each group over the periods within half of each centre:
    key, period, n, beta, its HC0 standard error, the first stage's robust t, imputed (periods of impute take the first centre's).

    Data are summed once by group and period: the squared scores are sums of products of [1, y, x, z, yz, xz, zz]. A
    window adds the sums of its periods. Windows of fewer rows than min_obs are left out."""
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull()).select(key, period, *(F.col(c).cast("double").alias(n) for n, c in (("y", y), ("x", x), ("z", z))))
    df = _centred(df, ["y", "x", "z"], [key])
    v = [F.lit(1.0), F.col("y"), F.col("x"), F.col("z"), F.col("y") * F.col("z"), F.col("x") * F.col("z"), F.col("z") * F.col("z")]
    pairs = [(i, j) for i in range(7) for j in range(i, 7)]
    sums = df.groupBy(key, period).agg(*(F.sum(v[i] * v[j]).alias(f"g{i}_{j}") for i, j in pairs))
    centre = F.explode(F.sequence(F.greatest(F.col(period) - half, F.lit(centres[0])), F.least(F.col(period) + half, F.lit(centres[1]))))
    rolled = sums.where(F.col(period).between(centres[0] - half, centres[1] + half)).withColumn("centre", centre).groupBy(key, "centre").agg(*(F.sum(f"g{i}_{j}").alias(f"g{i}_{j}") for i, j in pairs))
    g = lambda i, j: F.col(f"g{min(i, j)}_{max(i, j)}")
    n = g(0, 0)
    my, mx, mz = (g(0, i) / n for i in (1, 2, 3))
    zy, zx, zz = (g(i, 3) - n * m * mz for i, m in ((1, my), (2, mx), (3, mz)))
    rolled = rolled.withColumns({"_b": zy / zx, "_p": zx / zz, "_my": my, "_mx": mx, "_mz": mz, "_zx": zx, "_zz": zz})
    b, p, my, mx, mz = (F.col(c) for c in ("_b", "_p", "_my", "_mx", "_mz"))
    second = [(my - b * mx) * mz, -mz, b * mz, b * mx - my, F.lit(1.0), -b, F.lit(0.0)]  # (y - my - b (x - mx)) (z - mz)
    first = [mx * mz - p * mz * mz, F.lit(0.0), -mz, 2 * p * mz - mx, F.lit(0.0), F.lit(1.0), -p]  # (x - mx - p (z - mz)) (z - mz)
    meat = lambda c: F.greatest(sum(((1 if i == j else 2) * c[i] * c[j] * g(i, j) for i, j in pairs), F.lit(0.0)), F.lit(0.0))
    out = rolled.where(n >= min_obs).select(key, F.col("centre").alias(period), n.cast("long").alias("n"), b.alias("beta"), (F.sqrt(meat(second)) / F.abs("_zx")).alias("se"), (p * F.col("_zz") / F.sqrt(meat(first))).alias("first_t"))
    periods = F.when(F.col(period) == centres[0], F.array(F.lit(centres[0]), *map(F.lit, impute))).otherwise(F.array(period))
    return out.withColumn("_at", F.explode(periods)).select(key, F.col("_at").alias(period), "n", "beta", "se", "first_t", (F.col("_at") != F.col(period)).alias("imputed"))


def clustered(df: DataFrame, y: str, x: str, absorb: list[str], cluster: str) -> DataFrame:
    """Slope of y on x with a fixed effect for each absorbed group, and its standard error clustered (without a
    small-sample factor). A cluster's score is sum(x y) - b sum(x x), so one sum by cluster gives slope and scores."""
    w = Window.partitionBy(*absorb)
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(cluster).alias("_c"), (F.col(x) - F.avg(x).over(w)).alias("_x"), (F.col(y) - F.avg(y).over(w)).alias("_y"))
    sums = df.groupBy("_c").agg(F.sum(F.col("_x") * F.col("_y")).alias("a"), F.sum(F.col("_x") * F.col("_x")).alias("q"))
    slope = F.sum("a") / F.sum("q")
    meat = F.sum(F.col("a") * F.col("a")) - 2 * slope * F.sum(F.col("a") * F.col("q")) + slope * slope * F.sum(F.col("q") * F.col("q"))
    return sums.agg(slope.alias("slope"), F.count("*").alias("clusters"), (F.sqrt(meat) / F.sum("q")).alias("se"))
