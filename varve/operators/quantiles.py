"""Quantiles by their conventions, from ranks and cumulative weights along a distributed sort, so that groups may be of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.sources.files import small

from .ordered import histogram, running, step


def _ranked(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """_x, its rank _r in the group, and the group's row count _n; nulls are left out."""
    df = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("_x"))
    return running(df, keys, [F.col("_x")], rank="_r").withColumnRenamed("_r_total", "_n")


def exact(df: DataFrame, wanted: dict[str, tuple[str, float]], keys: list[str]) -> DataFrame:
    """keys and, for each name of wanted, the value at rank 1 + p (n - 1) of its column, interpolated (column, p). Nulls are left out; a group without
    any value in all the columns gives no row.

    Spark's ``percentile`` gives the same, but holds a group's distinct values in one task. Here a histogram of fine steps tells which step holds each
    rank, and only the distinct values of those steps are sorted, by all tasks. The data are aggregated twice and never sorted or shuffled whole."""
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    parts = F.array(*(F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_x")) for i, c in enumerate(columns)))
    rows = df.select(*keys, F.explode(parts).alias("_e")).select(*keys, "_e.*") if len(columns) > 1 else df.select(*keys, F.lit(0).alias("_c"), F.col(columns[0]).cast("double").alias("_x"))
    rows = rows.where(F.col("_x").isNotNull())
    by = [*keys, "_c"]
    levels = F.array(*(F.struct(F.lit(i).alias("q"), F.lit(columns.index(c)).alias("c"), F.lit(float(p)).alias("p")) for i, (c, p) in enumerate(wanted.values())))
    held = histogram(rows, by, "_x").withColumn("_h", F.explode(F.filter(levels, lambda v: v["c"] == F.col("_c"))))
    h = 1 + F.col("_h.p") * (F.col("_total") - 1)
    ends = F.explode(F.array(F.struct(F.floor(h).alias("r"), (1 - (h - F.floor(h))).alias("w")), F.struct((F.floor(h) + 1).alias("r"), (h - F.floor(h)).alias("w"))))
    held = held.select(*by, "_b", (F.col("_upto") - F.col("_n")).alias("_before"), "_upto", F.col("_h.q").alias("_q"), ends.alias("_e")).where((F.col("_e.w") > 0) & (F.col("_e.r") > F.col("_before")) & (F.col("_e.r") <= F.col("_upto")))
    # A row a step that holds wanted ranks, with what is wanted of it, which goes along with the step's values.
    names = [f"_k{i}" for i in range(len(by))]
    target = F.struct("_q", (F.col("_e.r") - F.col("_before")).alias("r"), F.col("_e.w").alias("w"))
    steps = held.groupBy(*(F.col(k).alias(n) for k, n in zip(by, names, strict=True)), F.col("_b").alias("_s")).agg(F.collect_list(target).alias("_t"))
    same = [*(F.col(k).eqNullSafe(F.col(n)) for k, n in zip(by, names, strict=True)), F.col("_b") == F.col("_s")]
    steps, few = small(steps, "steps")
    # Values are counted before they get what is wanted of them: in a column of few values most rows are in such steps. Few steps meet the rows where they are;
    # of many, the distinct values are dealt out, so that one value's rows don't meet in a task.
    inside, each = rows.withColumn("_b", step(F.col("_x"))), [*by, "_b", "_x"]
    inside = inside if few else inside.groupBy(*each).agg(F.count("*").alias("_m"))
    inside = inside.join(steps, same, "left_semi")
    inside = inside.groupBy(*each).agg(F.count("*").alias("_m")) if few else inside
    run = running(inside, [*by, "_b"], [F.col("_x")], {"_to": F.col("_m")}, rank=None).join(steps, same)
    met = run.select(*keys, "_x", F.explode(F.filter("_t", lambda t: (t["r"] <= F.col("_to")) & (t["r"] > F.col("_to") - F.col("_m")))).alias("_t"))
    return met.groupBy(*keys).agg(*(F.sum(F.when(F.col("_t._q") == i, F.col("_t.w") * F.col("_x"))).alias(n) for i, n in enumerate(wanted)))


def linear(df: DataFrame, column: str, keys: list[str], ps: list[float]) -> DataFrame:
    """``exact`` of one column: columns q0, q1, ... for the levels ps."""
    return exact(df, {f"q{i}": (column, p) for i, p in enumerate(ps)}, keys)


def hazen(df: DataFrame, column: str, keys: list[str], p: float) -> DataFrame:
    """Interpolation at rank n p + 1/2, kept within 1 and n."""
    h = F.greatest(F.lit(1.0), F.least(F.col("_n").cast("double"), F.col("_n") * F.lit(p) + 0.5))
    at = lambda r: F.max(F.when(F.col("_r") == r, F.col("_x")))
    out = _ranked(df, column, keys).withColumn("_h", h).groupBy(*keys).agg(at(F.floor("_h")).alias("lo"), at(F.ceil("_h")).alias("hi"), F.max("_h").alias("_h"))
    return out.select(*keys, (F.col("lo") + (F.col("_h") - F.floor("_h")) * (F.col("hi") - F.col("lo"))).alias("q"))


def averaged(df: DataFrame, column: str, keys: list[str], percent: int) -> DataFrame:
    """Mean of the two order statistics around n p where it is whole, else the next one."""
    np_, whole = F.col("_n") * percent, (F.col("_n") * percent) % 100 == 0
    k = F.floor(np_ / 100)
    ranked = _ranked(df, column, keys).where((F.col("_r") == k + 1) | (whole & (F.col("_r") == k)) | ((k >= F.col("_n")) & (F.col("_r") == F.col("_n"))))
    return ranked.groupBy(*keys).agg(F.avg("_x").alias("q"))


def weighted(df: DataFrame, column: str, weight: str, keys: list[str], p: float) -> DataFrame:
    """Least value at which the cumulative weight reaches the share p, over rows with a value and a positive weight."""
    df = df.where(F.col(column).isNotNull() & (F.col(weight) > 0)).select(*keys, F.col(column).alias("_x"), F.col(weight).cast("double").alias("_w"))
    run = running(df, keys, [F.col("_x")], {"_c": F.col("_w")}, rank=None)
    return run.where(F.col("_c") / F.col("_c_total") >= p - 1e-12).groupBy(*keys).agg(F.min("_x").alias("q"))
