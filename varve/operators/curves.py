"""Curves held in tables of knots: as-of lookup, linear interpolation, secant slopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import blocks


def carried(df: DataFrame, keys: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """df with name: the last value that is not null at or before the row, in its group's order. Along one distributed sort: a block takes over what the blocks
    before it hold, of which there is one row a block and group."""
    held = blocks(df, keys, order)
    local = Window.partitionBy("_part", *keys).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    inside = held.withColumn("_in", F.last(value, ignorenulls=True).over(local))
    sides = held.groupBy(*keys, "_part").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_pos"))).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ks = [f"_k{i}" for i in range(len(keys))]
    small = sides.withColumn("_before", F.last("_last", ignorenulls=True).over(across)).select(F.col("_part").alias("_p"), *(F.col(k).alias(n) for k, n in zip(keys, ks, strict=True)), "_before")
    on = [F.col("_part") == F.col("_p"), *(F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, ks, strict=True))]
    return inside.join(small, on).select(*(f"`{c}`" for c in df.columns), F.coalesce("_in", "_before").alias(name))


def secants(knots: DataFrame, keys: list[str], x: str, ys: list[str]) -> DataFrame:
    """knots with the next one (next_<x>) and the slope of each y towards it (slope_<y>); null for the last. Knots that repeat x count once, with the mean of y."""
    w = Window.partitionBy(*keys).orderBy(x)
    one = knots.groupBy(*keys, x).agg(*(F.avg(y).alias(y) for y in ys))
    ahead = F.lead(x).over(w)
    return one.withColumns({f"next_{x}": ahead, **{f"slope_{y}": (F.lead(y).over(w) - F.col(y)) / (ahead - F.col(x)) for y in ys}})


def interpolate(df: DataFrame, x: str, knots: DataFrame, knot: str, ys: list[str], keys: list[str] | None = None) -> DataFrame:
    """df with at_<y> of each y, linear between the knots of the row's group, and inside (whether x lies on the curve); beyond its ends, and for a null x, null.

    Rows and knots are sorted together, and each row takes the last knot at or before it: an as-of join, with no limit on rows or knots."""
    keys = keys or []
    made = secants(knots.where(F.col(knot).isNotNull()), keys, knot, ys)
    packed = made.select(*keys, F.col(knot).cast("double").alias("_x"), F.lit(0).alias("_row"), F.struct(F.col(knot).cast("double").alias("x"), F.col(f"next_{knot}").cast("double").alias("n"), *(F.col(y).alias(f"y_{y}") for y in ys), *(F.col(f"slope_{y}").alias(f"s_{y}") for y in ys)).alias("_knot"))
    rows = df.select(*(F.col(k) for k in keys), F.col(x).cast("double").alias("_x"), F.lit(1).alias("_row"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_df"))
    both = rows.unionByName(packed, allowMissingColumns=True)
    got = carried(both, keys, [F.col("_x").asc_nulls_first(), F.col("_row")], "_knot", "_at").where("_row = 1")
    k, at = F.col("_at"), F.col("_x")
    inside = F.coalesce((at == k["x"]) | (at <= k["n"]), F.lit(False))
    value = lambda y: F.when(at == k["x"], k[f"y_{y}"]).when(at <= k["n"], k[f"y_{y}"] + (at - k["x"]) * k[f"s_{y}"])
    return got.select("_df.*", *(value(y).alias(f"at_{y}") for y in ys), inside.alias("inside"))
