"""Within-market ranks, shares, concentration, tails and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import top


def average_rank_share(x: str, keys: list[str]) -> Column:
    """Percentile rank with ties at their average: (rank + (ties - 1) / 2) / n."""
    w = Window.partitionBy(*keys)
    ties = F.count("*").over(Window.partitionBy(*keys, x))
    return (F.rank().over(w.orderBy(x)) + (ties - 1) / 2.0) / F.count("*").over(w)


def concentration(df: DataFrame, keys: list[str], sales: str = "rev", entity: str = "entity") -> DataFrame:
    """n, tot_sale, cr4, cr20, top1pct, top5pct, hhi of each market."""
    w = Window.partitionBy(*keys)
    ranked = df.select(*keys, F.row_number().over(w.orderBy(F.desc(sales), entity)).alias("rk"), F.count("*").over(w).alias("n"), F.col(sales).alias("sale"), (F.col(sales) / F.sum(sales).over(w)).alias("s"))
    top = lambda k: F.sum(F.when(F.col("rk") <= k, F.col("s")).otherwise(0.0))
    part = lambda p: F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(p)))
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("sale").alias("tot_sale"), top(4).alias("cr4"), top(20).alias("cr20"), top(part(0.01)).alias("top1pct"), top(part(0.05)).alias("top5pct"), F.sum(F.col("s") * F.col("s")).alias("hhi"))


def tail(df: DataFrame, keys: list[str], x: str, share: float, least: int = 20) -> DataFrame:
    """k, zipf (minus the slope of ln(rank - 1/2) on ln x) and hill, over the top max(int(share n), least) of each group."""
    got = top(df.where(F.col(x) > 0).select(*keys, x, "entity"), keys, x, ["entity"], share, least).withColumn("lx", F.ln(x))
    above = F.col("rank") < F.greatest(F.floor(F.col("rank_total") * F.lit(share)), F.lit(least))
    gap = F.avg(F.when(above, F.col("lx"))) - F.min("lx")
    return got.groupBy(*keys).agg(F.count("*").alias("k"), (-F.regr_slope(F.ln(F.col("rank") - 0.5), F.col("lx"))).alias("zipf"), F.try_divide(F.lit(1.0), gap).alias("hill"))


def rank_gap(df: DataFrame, keys: list[str], size: str, value: str, top: float, bottom: float = 0.5) -> DataFrame:
    """Mean demeaned value over units in the top ranks of their market, minus that of the bottom; pooled over units."""
    df = df.select(average_rank_share(size, keys).alias("pr"), (F.col(value) - F.avg(value).over(Window.partitionBy(*keys))).alias("d"))
    return df.agg((F.avg(F.when(F.col("pr") > top, F.col("d"))) - F.avg(F.when(F.col("pr") <= bottom, F.col("d")))).alias("gap"))


def tail_blocks(df: DataFrame, keys: list[str], x: str, tie: list[str], cutoffs: dict[str, float], least: int = 20) -> DataFrame:
    """Per group and cutoff (name -> share of the top): k, zipf (minus the slope of ln(rank - 1/2) on ln x), hill and se (zipf sqrt(2 / k)), over the top
    max(int(share n), least) positive values, which also need that many.

    All cutoffs come from one distributed sort and one aggregation; rows that cannot lie above the widest cutoff go before it."""
    df = df.where(F.col(x) > 0).select(*keys, *tie, F.ln(x).alias("lx"))
    ranked = top(df, keys, "lx", tie, max(cutoffs.values()), least)
    k = lambda share: F.greatest(F.floor(F.lit(share) * F.col("rank_total")), F.lit(least))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("cutoff"), k(share).alias("k")) for n, share in cutoffs.items())))
    chosen = ranked.select(*keys, "lx", "rank", "rank_total", each.alias("c")).select(*keys, "lx", "rank", "rank_total", "c.*").where((F.col("rank") <= F.col("k")) & (F.col("k") <= F.col("rank_total")))
    slope = -F.regr_slope(F.ln(F.col("rank") - 0.5), F.col("lx"))
    above = F.avg(F.when(F.col("rank") < F.col("k"), F.col("lx"))) - F.max(F.when(F.col("rank") == F.col("k"), F.col("lx")))
    got = chosen.groupBy(*keys, "cutoff").agg(F.count("*").alias("k"), slope.alias("zipf"), F.try_divide(F.lit(1.0), above).alias("hill"))
    return got.withColumn("se", F.col("zipf") * F.sqrt(2 / F.col("k")))
