"""Weighted moments, correlations and decompositions, from sums that Spark combines before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import POISSON, PRIME, seeds


def weighted_mean(x: str | Column, w: str | Column) -> Column:
    """Sum of w x over sum of w; null if the weights sum to zero."""
    x, w = (F.col(c) if isinstance(c, str) else c for c in (x, w))
    return F.try_divide(F.sum(w * x), F.sum(w))


def weighted_corr(df: DataFrame, x: str, y: str, w: str, keys: list[str], name: str) -> DataFrame:
    """Weighted correlation by group. Deviations from the group's weighted means are summed, so large means don't cancel."""
    means = df.groupBy(*keys).agg(weighted_mean(x, w).alias("_mx"), weighted_mean(y, w).alias("_my"))
    d = df.join(means, keys).select(*keys, F.col(w).alias("_w"), (F.col(x) - F.col("_mx")).alias("_x"), (F.col(y) - F.col("_my")).alias("_y"))
    s = lambda a, b: F.sum(F.col("_w") * F.col(a) * F.col(b))
    return d.groupBy(*keys).agg(F.try_divide(s("_x", "_y"), F.sqrt(s("_x", "_x") * s("_y", "_y"))).alias(name))


def partial_corr(x: str, y: str, control: str) -> Column:
    """Correlation of x and y given one control, from the three pairwise ones."""
    xy, xz, yz = F.corr(x, y), F.corr(x, control), F.corr(y, control)
    return F.try_divide(xy - xz * yz, F.sqrt((1 - xz * xz) * (1 - yz * yz)))


def demean(x: str, keys: list[str], weight: str | None = None) -> Column:
    """x minus its (weighted) mean over the group."""
    w = Window.partitionBy(*keys)
    if weight is None:
        return F.col(x) - F.avg(x).over(w)
    return F.col(x) - F.sum(F.col(weight) * F.col(x)).over(w) / F.sum(weight).over(w)


def content_hash(df: DataFrame) -> DataFrame:
    """Row count and a hash of the rows that doesn't depend on their order: the sum of 60 bits of each row's MD5 (against accidents, not attackers).

    Any engine can follow it: a row is its columns' texts joined by ``|``, a null ``\\N``, a float as a decimal with six places."""
    text = [F.coalesce(F.col(f"`{c}`").cast("decimal(38,6)" if t in ("double", "float") else "string").cast("string"), F.lit("\\N")) for c, t in df.dtypes]
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *text).cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("hash"))


def bootstrap(df: DataFrame, entity: str, x: str, replicates: int, seed: int = 1) -> DataFrame:
    """Cluster bootstrap of the mean of x: replicate, mean. Entities weigh a Poisson(1) number, by the same portable draws as ``ordered.rank_bootstrap``, alike under any
    partitioning and in any engine; rows are first summed by entity, and draws by replicate before the shuffle."""
    sums = df.where(F.col(x).isNotNull()).groupBy(entity).agg(F.sum(x).alias("_s"), F.count("*").alias("_n"))
    draws = sums.select("_s", "_n", *seeds(entity, seed), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    r, p = F.col("replicate").cast("long"), F.lit(PRIME).cast("long")
    u = ((F.col("_s0") + F.col("_s1") * r % p + F.col("_s2") * r % p * r % p) % p) / float(PRIME)
    weight = sum(((u >= s).cast("int") for s in POISSON[1:]), (u >= POISSON[0]).cast("int"))
    return draws.withColumn("_w", weight).groupBy("replicate").agg(F.try_divide(F.sum(F.col("_w") * F.col("_s")), F.sum(F.col("_w") * F.col("_n"))).alias("mean"))
