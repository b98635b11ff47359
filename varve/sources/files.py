"""Parquet, CSV and JSON files: sinks, and scans with a declared schema, so that nothing is inferred by a pass of its own."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder beside checkpoints, which driver and executors share; local sessions without one get a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="varve-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def kept(df: DataFrame, tag: str) -> DataFrame:
    """df, written and read back: lineage ends, and lost executors do no harm."""
    path = scratch(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to which a side of a join is broadcast, so that the other side meets it where it is.
FEW_ROWS = 200_000


def small(df: DataFrame, tag: str, most: int = FEW_ROWS) -> tuple[DataFrame, bool]:
    """``kept`` with a broadcast hint, and whether it has one: if df has at most most rows. Without one, Spark deals the other side out by the join's keys first,
    and the rows of a large group meet in one task."""
    df = kept(df, tag)
    few = df.count() <= most
    return (F.broadcast(df) if few else df), few


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Refuses an existing path. Partition columns become folders, which later filters prune."""
    (df.write.partitionBy(*partition_by) if partition_by else df.write).option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; nulls are empty fields and empty strings quoted ones, which ``read_csv`` tells apart."""
    df.write.option("header", True).option("nullValue", "").option("emptyValue", '""').option("dateFormat", "yyyy-MM-dd").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


#: What a quoted empty field is read as before it becomes an empty string: two characters that Unicode keeps out of texts.
_EMPTY = "\ufffe\uffff"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed by the schema (dates as yyyy-MM-dd); a malformed line is an error, not a row of nulls. Empty strings come back as such, nulls as nulls."""
    df = spark.read.option("header", True).option("dateFormat", "yyyy-MM-dd").option("mode", "FAILFAST").option("emptyValue", _EMPTY).schema(schema).csv(path)
    return df.withColumns({c: F.when(F.col(c) == _EMPTY, "").otherwise(F.col(c)) for c, t in df.dtypes if t == "string"})


def write_json(df: DataFrame, path: str) -> None:
    """A line a row; numbers that JSON lacks (NaN and infinities) are written as null."""
    finite = {c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) for c, t in df.dtypes if t in ("double", "float")}
    df.withColumns(finite).write.option("ignoreNullFields", False).json(path)


def append_lines(df: DataFrame, path: str) -> None:
    """Append-only JSON lines: a checkpoint that later runs add to."""
    df.write.mode("append").json(path)


def missing_parts(spark: SparkSession, path: str, done: str, wanted: list[int], schema: str) -> list[int]:
    """Of the wanted parts, those that no row of the JSON lines at path tells done: what a restarted job has left to do."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return wanted
    have = {r[0] for r in spark.read.schema(schema).json(path).select(done).distinct().collect()}  # at most the wanted parts
    return [w for w in wanted if w not in have]


def manifest(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """One row for each data file of the named Parquet tables: table, file, bytes, sha256, rows and columns.

    Digests come from the binaryFile source, a task a file (each below 2 GB, as Spark's writers make them), rows from the scans' own file names."""
    hashed, counted = [], []
    for name, path in paths.items():
        held = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
        hashed.append(held.select(F.lit(name).alias("table"), F.substring_index("path", "/", -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")))
        rows = spark.read.parquet(path)
        counted.append(rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "file", "rows", F.lit(len(rows.columns)).alias("columns")))
    all_of = lambda dfs: reduce(DataFrame.unionByName, dfs)
    return all_of(hashed).join(all_of(counted), ["table", "file"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def verify(spark: SparkSession, recorded: str, paths: dict[str, str]) -> DataFrame:
    """The recorded manifest (``manifest``, written as Parquet), if every file is as it was then and none is lost or new; refused otherwise."""
    was, now = spark.read.parquet(recorded), manifest(spark, paths)
    key = ["table", "file", "sha256", "rows"]
    odd = was.select(*key).exceptAll(now.select(*key)).unionByName(now.select(*key).exceptAll(was.select(*key))).limit(5).collect()
    if odd:
        raise ChangedFiles(f"differ from the manifest: {sorted({(r.table, r.file) for r in odd})}")
    return was


class ChangedFiles(ValueError):
    """Input files that are not those that the manifest names."""
