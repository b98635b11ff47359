"""Helpers that several training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separator of "plain" words.
SPACE = r"[\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session has none, a local master (tests) gets a temporary one, which is recorded; on a cluster that is an
    error, as executors would each write to a disk of their own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="varve-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def cut(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and survives lost executors."""
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(df: DataFrame) -> DataFrame:
    """df, with at most 256 rows in an Arrow batch: whole texts are wide, and a batch is held on both sides."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    return df


def map_arrow(df: DataFrame, schema: str, f: Callable[[dict[str, list]], Iterator[dict[str, list]]], rows: int = 256) -> DataFrame:
    """mapInArrow with f from a dict of at most ``rows`` values a column to dicts of the result's columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                for made in f(batch.slice(at, rows).to_pydict()):
                    yield pa.RecordBatch.from_arrays([pa.array(made[x.name], x.type) for x in out], schema=out)
        pa.default_memory_pool().release_unused()  # the worker stays for other tasks

    return small_batches(df).mapInArrow(run, schema)


def by_size(small: DataFrame, most_rows: int, weight: Column | None = None) -> DataFrame:
    """small with a broadcast hint if it has at most most_rows rows of bounded width; otherwise joins shuffle.

    weight (of a row, in such rows) bounds a row that may be wide: then the weights' sum is compared.
    """
    if weight is None:
        return F.broadcast(small) if small.limit(most_rows + 1).count() <= most_rows else small
    return F.broadcast(small) if (small.agg(F.sum(weight)).first()[0] or 0) <= most_rows else small


def unused(df: DataFrame, name: str) -> str:
    """name, lengthened until no column of df has it."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def deal(rows: DataFrame, groups: DataFrame, keys: list[str], n: str = "n", most_hot: int = 50_000) -> DataFrame:
    """rows left-joined with groups, which has one row for each value of keys and in column n the number of rows with it.

    groups is read three times, so it should be a written table (``cut``).

    Groups with over one part in most_hot of all rows (at most most_hot of them, so they are broadcast) are met without a
    shuffle, and their rows are dealt out by chance; all others are shuffled on keys. So no key's rows meet in one task.
    """
    total = groups.agg(F.sum(n)).first()[0] or 0
    least = max(1000, -(-total // most_hot))
    rest = [c for c in groups.columns if c not in keys]
    hot = F.broadcast(groups.where(F.col(n) > least).select(*(F.col(k).alias(f"_hot_{k}") for k in keys), *(F.col(c).alias(f"_hot_{c}") for c in rest)))
    cold = groups.where(F.col(n) <= least).select(*(F.col(k).alias(f"_cold_{k}") for k in keys), *rest)
    met = rows.join(hot, [F.col(k) == F.col(f"_hot_{k}") for k in keys], "left")
    # The first key of a row that has met its group is replaced by a number of its own, which no group has but by chance.
    other = F.when(F.col(f"_hot_{n}").isNull(), F.col(keys[0])).otherwise(F.xxhash64(*(c for c in rows.columns if dict(rows.dtypes)[c] in ("bigint", "int"))))
    met = met.withColumn("_dealt", other)
    both = met.join(cold, [F.col("_dealt") == F.col(f"_cold_{keys[0]}"), *(F.col(k) == F.col(f"_cold_{k}") for k in keys[1:])], "left")
    return both.select(*rows.columns, *(F.when(F.col(f"_hot_{n}").isNotNull(), F.col(f"_hot_{c}")).otherwise(F.col(c)).alias(c) for c in rest))
