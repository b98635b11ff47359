"""Restartable stages: cells computed anew only where their input changed, and samples checked by counts taken in the same pass."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from varve.sources.files import scratch

from .estimate import CONSTANT, elasticities
from .guards import Refused
from .panel import consecutive_lag


def fingerprints(df: DataFrame, key: str, settings: str = "") -> DataFrame:
    """key and print: a digest of the cell's rows in any order (two sums of 64-bit hashes and a count) and of the settings."""
    columns = [F.col(f"`{c}`") for c in sorted(df.columns)]
    sums = [F.sum(F.xxhash64(F.lit(s), *columns).cast("decimal(38,0)")).cast("string") for s in (1, 2)]
    told = F.lit(f"{settings}|{df.select(*sorted(df.columns)).schema.simpleString()}")
    return df.groupBy(key).agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *sums, told).cast("binary"), 256).alias("print"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def refresh(df: DataFrame, key: str, path: str, compute: Callable[[DataFrame], DataFrame], settings: str = "") -> tuple[DataFrame, dict[str, int]]:
    """compute(df) by cell, kept at path: only cells whose rows or settings differ from those of the kept results are computed.

    compute takes the rows of some cells and returns rows with key (which must not be null). Results are partitioned by key, each with its input's fingerprint, and changed partitions
    are overwritten one by one, so a job that dies leaves whole cells, which the next one keeps. What counts is the fingerprint: results of cells that vanished,
    or that give no rows any more, stay in their folders but are not returned. Returns the results and the numbers of cells and of recomputed ones."""
    spark = df.sparkSession
    at = scratch(spark, "prints")
    fingerprints(df, key, settings).write.parquet(at)
    prints = spark.read.parquet(at)
    known = _exists(spark, path)
    old = spark.read.parquet(path).select(key, "print").distinct() if known else prints.limit(0)
    # Partition columns are read back with types of their own.
    kind = prints.schema[key].dataType
    changed = prints.join(old.select(F.col(key).cast(kind).alias(key), "print"), [key, "print"], "left_anti")
    n, n_changed = prints.count(), changed.count()
    if n_changed:
        made = compute(df.join(changed.select(key), key, "left_semi"))
        made.join(changed, key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
    if not known and not n_changed:
        return compute(df), {"cells": n, "recomputed": 0}
    held = spark.read.parquet(path)
    held = held.withColumn(key, F.col(key).cast(kind))
    return held.join(prints, [key, "print"], "left_semi").drop("print"), {"cells": n, "recomputed": n_changed}


def counted(df: DataFrame, tag: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """df, written, and metrics over its rows taken in the pass that writes it."""
    spark, seen, path = df.sparkSession, Observation(tag), scratch(df.sparkSession, tag)
    df.observe(seen, *(v.alias(k) for k, v in metrics.items())).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get


def second_step(df: DataFrame, coefficients: DataFrame, alpha: DataFrame, key: str, flag: tuple[float, float], expected: int | None = None) -> tuple[DataFrame, dict]:
    """The sample and the firm-year objects of the second step, and counts: rows, selected, flagged and negative elasticities.

    df: entity, year, key, y, s, k, m, l. coefficients: c0 to c9 of the share (``share_nls``). alpha: a0 to a4 of the function of capital and labour. A row is selected if its entity has a
    row the year before whose fitted share is positive; selected rows get omega (productivity), lomega (the year before's), kelast, lelast and rts (with melast their sum), others null.
    eps (the share's residual) and melast are given for all rows with a positive fit. rts outside flag is marked, not dropped. The counts are taken while the result is written;
    if expected is given and differs from the number selected, it is refused: panel or parameters changed since the estimation."""
    made = elasticities(df, coefficients, key).withColumn("eps", F.when(F.col("melast") > 0, F.ln("melast") - F.col("s")))
    k, l = F.col("k"), F.col("l")  # noqa: E741
    a = {c: F.col(f"a{i}") for i, c in enumerate(CONSTANT)}
    form = a["k"] * k + a["l"] * l + a["kk"] * k * k + a["ll"] * l * l + a["kl"] * k * l
    made = made.join(F.broadcast(alpha), key)  # a row a cell
    made = made.withColumns({"_omega": F.col("y") - F.col("eps") - F.col("integral") + form, "_kelast": F.col("kelast") - a["k"] - 2 * a["kk"] * k - a["kl"] * l, "_lelast": F.col("lelast") - a["l"] - 2 * a["ll"] * l - a["kl"] * k})
    made = consecutive_lag(made, ["melast", "_omega"])
    chosen = F.coalesce(F.col("l_melast") > 0, F.lit(False))
    only = lambda c: F.when(F.col("in_sample"), c)
    made = made.withColumn("in_sample", chosen).withColumns({"omega": only(F.col("_omega")), "lomega": only(F.col("l__omega")), "kelast": only(F.col("_kelast")), "lelast": only(F.col("_lelast"))})
    made = made.withColumn("rts", F.col("melast") + F.col("kelast") + F.col("lelast")).withColumn("outlier", F.coalesce(~F.col("rts").between(*flag), F.lit(False)))
    out = made.select("entity", "year", key, "eps", "melast", "kelast", "lelast", "omega", "lomega", "rts", "in_sample", "outlier")
    out, seen = counted(out, "second_step", rows=F.count("*"), selected=F.count_if("in_sample"), flagged=F.count_if("outlier"), negative_k=F.count_if(F.col("kelast") < 0), negative_l=F.count_if(F.col("lelast") < 0))
    if expected is not None and seen["selected"] != expected:
        raise Refused(f"{seen['selected']} rows are selected, {expected} at estimation: panel or parameters changed")
    return out, seen


def against(df: DataFrame, columns: list[str], targets: dict[str, dict[str, float]], where: Column) -> DataFrame:
    """Per column: rows, mean, exact p10, p50 and p90 over the rows where the condition holds, the published ones and the largest gap."""
    made = []
    for c in columns:
        q = F.percentile(c, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
        t = targets[c]
        row = df.where(where).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), q.alias("q")).select(F.lit(c).alias("object"), "n", "mean", *(F.col("q")[i].alias(p) for i, p in enumerate(("p10", "p50", "p90"))), *(F.lit(float(v)).alias(f"published_{p}") for p, v in t.items()))
        made.append(row.withColumn("gap", F.greatest(*(F.abs(F.col(p) - F.col(f"published_{p}")) for p in t))))
    return reduce(DataFrame.unionByName, made)
