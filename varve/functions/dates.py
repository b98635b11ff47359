"""Series by year: splices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def splice(first: DataFrame, second: DataFrame, last: int) -> DataFrame:
    """year, source, v and spread from two tables (year, v): the first's values to its year ``last``, then the second's, scaled so that both agree in that year.

    spread is first less second in each of the first's years (null where the second has none), and that of the last year after it."""
    both = first.withColumnsRenamed({"v": "a"}).join(second.withColumnsRenamed({"v": "b"}), "year", "full")
    tie = F.broadcast(both.where(F.col("year") == last).select((F.col("a") / F.col("b")).alias("factor"), (F.col("a") - F.col("b")).alias("gap")))  # one row
    old = F.col("year") <= last
    made = both.join(tie).where((old & F.col("a").isNotNull()) | (~old & F.col("b").isNotNull()))
    return made.select("year", F.when(old, "first").otherwise("second").alias("source"), F.round(F.when(old, F.col("a")).otherwise(F.col("b") * F.col("factor")), 4).alias("v"), F.round(F.when(old, F.col("a") - F.col("b")).otherwise(F.col("gap")), 4).alias("spread"))
