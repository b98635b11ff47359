"""Panel verbs: lags that need the period before, flags, priority dedup, trims, winsorizing, lookups with fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import quantiles


def consecutive_lag(df: DataFrame, columns: list[str], key: str = "entity", period: str = "year") -> DataFrame:
    """l_<column>: the value of the period before; null if that period has no row."""
    w = Window.partitionBy(key).orderBy(period)
    near = F.lag(period).over(w) == F.col(period) - 1
    return df.withColumns({f"l_{c}": F.when(near, F.lag(c).over(w)) for c in columns})


def panel_flags(df: DataFrame, key: str = "entity", period: str = "year") -> DataFrame:
    """has_prev, has_next (adjoining periods) and n_periods of the entity."""
    w = Window.partitionBy(key).orderBy(period)
    return df.withColumns({
        "has_prev": F.coalesce(F.lag(period).over(w) == F.col(period) - 1, F.lit(False)),
        "has_next": F.coalesce(F.lead(period).over(w) == F.col(period) + 1, F.lit(False)),
        "n_periods": F.count("*").over(Window.partitionBy(key)),
    })


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in the (total) order."""
    return df.withColumn("_rk", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rk = 1").drop("_rk")


def safe_ln(x: str | Column) -> Column:
    """ln of positive values, else null."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(x > 0, F.ln(x))


def _with_cuts(df: DataFrame, column: str, keys: list[str], low: float, high: float) -> DataFrame:
    """df with the group's linear quantiles as cut_low and cut_high, of which there are few rows to join; null where the group has no value."""
    df, names = df.drop("cut_low", "cut_high"), [f"_k{i}" for i in range(len(keys))]
    cuts = quantiles.exact(df, {"cut_low": (column, low), "cut_high": (column, high)}, keys)
    cuts = cuts.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), "cut_low", "cut_high")
    return df.join(cuts, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)], "left").drop(*names)


def trim_by(df: DataFrame, column: str, keys: list[str], low: float, high: float, strict: bool = True) -> DataFrame:
    """Rows between the group's linear quantiles of the column, with these as cut_low and cut_high."""
    x, a, b = F.col(column), F.col("cut_low"), F.col("cut_high")
    return _with_cuts(df, column, keys, low, high).where((x > a) & (x < b) if strict else x.between(a, b))


def winsorize_by(df: DataFrame, column: str, keys: list[str], low: float, high: float, name: str) -> DataFrame:
    inside = F.greatest(F.col("cut_low"), F.least(F.col(column), F.col("cut_high")))
    return _with_cuts(df, column, keys, low, high).withColumn(name, F.when(F.col(column).isNotNull(), inside)).drop("cut_low", "cut_high")


def lookup_with_fallback(df: DataFrame, levels: list[tuple[DataFrame, list[str]]], value: str) -> DataFrame:
    """value from the first level that has the row's keys, and ``level`` (from 1). Each level is one row per keys."""
    for k, (dim, on) in enumerate(levels, 1):
        df = df.join(dim.select(*on, F.col(value).alias(f"_v{k}")), on, "left")
    names = [f"_v{k}" for k in range(1, len(levels) + 1)]
    level = F.coalesce(*(F.when(F.col(n).isNotNull(), F.lit(k)) for k, n in enumerate(names, 1)))
    return df.withColumn(value, F.coalesce(*names)).withColumn("level", level).drop(*names)


def waterfall(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """Rows and distinct entities left after each filter, and rows that it dropped, in one pass: step, name, n_rows, n_entities, dropped."""
    passed, flags = F.lit(True), []
    for name, condition in steps:
        passed = passed & F.coalesce(condition, F.lit(False))
        flags.append(F.struct(F.lit(len(flags) + 1).alias("step"), F.lit(name).alias("name"), passed.alias("ok")))
    left = df.select("entity", F.explode(F.array(F.struct(F.lit(0).alias("step"), F.lit("all").alias("name"), F.lit(True).alias("ok")), *flags)).alias("s")).where("s.ok")
    left = left.groupBy("s.step", "s.name").agg(F.count("*").alias("n_rows"), F.countDistinct("entity").alias("n_entities"))
    before = F.lag("n_rows").over(Window.orderBy("step"))  # a row a step
    return left.withColumn("dropped", before - F.col("n_rows")).where("step > 0")


def validate(df: DataFrame, keys: list[str], positive: str) -> DataFrame:
    """One row: n, rows that repeat a key, rows with a null key, rows whose column is not positive."""
    by_key = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(~(F.col(positive) > 0)).alias("bad"))
    null_key = F.greatest(*(F.col(k).isNull() for k in keys)) if len(keys) > 1 else F.col(keys[0]).isNull()
    return by_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"),
        F.coalesce(F.sum(F.when(null_key, F.col("n")).otherwise(0)), F.lit(0)).alias("null_keys"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("not_positive"),
    )
