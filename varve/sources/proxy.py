"""The proxy entity-by-year panel over the driver's tables: one scan each of lineitem and part, two columns groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def firm_years(spark: SparkSession, sf_dir: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """entity, year, cell, market, rev, mate, staf, cap; (entity, year) is a key. Bounds on the year reach the scan as bounds
    on the ship date."""
    lines = table(spark, sf_dir, "lineitem")
    if first is not None:
        lines = lines.where(F.col("l_shipdate") >= F.lit(f"{first}-01-01").cast(lines.schema["l_shipdate"].dataType))
    if last is not None:
        lines = lines.where(F.col("l_shipdate") < F.lit(f"{last + 1}-01-01").cast(lines.schema["l_shipdate"].dataType))
    lines = lines.groupBy("l_partkey", F.year("l_shipdate").alias("year")).agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"),
        F.sum("l_quantity").alias("cap"),
        F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("staf"),
    )  # aggregated before the join, so that one row per entity and year is joined
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_retailprice")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_partkey").alias("entity"), "year", F.col("p_type").alias("cell"), F.col("p_brand").alias("market"),
        F.round("rev", 4).alias("rev"), F.round(F.col("cap") * F.col("p_retailprice"), 2).alias("mate"), F.round("staf", 4).alias("staf"), "cap",
    )
