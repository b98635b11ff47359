"""Guardrails: checks that stop a job with a reason instead of letting it go on with wrong rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Refused(ValueError):
    """Input that a job must not go on with."""


def require_rows(df: DataFrame, least: int, what: str = "table") -> DataFrame:
    """df, if it has at least so many rows; no more than that many are counted."""
    found = df.limit(least).count()
    if found < least:
        raise Refused(f"{what}: {found} rows, at least {least} are needed")
    return df


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise Refused(f"missing columns: {missing}")
    return df


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, if no key repeats."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise Refused(f"{keys} repeat, first {tuple(twice[0])[:-1]}")
    return df


def join_many_to_one(df: DataFrame, dim: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that is refused unless dim has one row for each key."""
    return df.join(require_unique(dim, keys), keys, "left")


def join_all(df: DataFrame, others: list[DataFrame], keys: list[str]) -> DataFrame:
    """Left joins of several tables, each of one row for each key, with df of one row for each key."""
    return reduce(lambda a, b: join_many_to_one(a, b, keys), others, require_unique(df, keys))


def join_matched(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join that is refused unless every key is on both sides."""
    lone = a.select(*keys).join(b.select(*keys), keys, "left_anti").limit(1).collect() or b.select(*keys).join(a.select(*keys), keys, "left_anti").limit(1).collect()
    if lone:
        raise Refused(f"{tuple(lone[0])} is on one side only")
    return a.join(b, keys)


def fingerprint(df: DataFrame) -> str:
    """A hash of schema and rows that doesn't depend on their order: a sum of 64-bit hashes, against accidents, not attackers."""
    rows = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)).cast("decimal(38,0)")).alias("h")).first()
    return f"{df.schema.simpleString()}|{rows.n}|{rows.h}"


def require_same(df: DataFrame, expected: str) -> DataFrame:
    """df, if its fingerprint is that which an earlier step recorded."""
    if fingerprint(df) != expected:
        raise Refused("the input differs from the one that the earlier step used")
    return df


def record(df: DataFrame, path: str) -> None:
    """Writes df's fingerprint, for a later step."""
    df.sparkSession.createDataFrame([(fingerprint(df),)], "fingerprint string").coalesce(1).write.json(path)


def require_recorded(df: DataFrame, path: str) -> DataFrame:
    """df, if it is what ``record`` saw."""
    return require_same(df, df.sparkSession.read.schema("fingerprint string").json(path).first().fingerprint)


def join_overlapping(a: DataFrame, b: DataFrame, keys: list[str], x: str, y: str, most: float) -> DataFrame:
    """a and b where both have the keys, with gap, the distance of x and y relative to x; refused if there are none such, or a gap exceeds most (or is undefined)."""
    met = join_many_to_one(a, b, keys).where(F.col(y).isNotNull()).withColumn("gap", F.try_divide(F.abs(F.col(x) - F.col(y)), F.abs(F.col(x))))
    seen = met.agg(F.count("*").alias("n"), F.max(F.coalesce("gap", F.lit(float("inf")))).alias("gap")).first()
    if seen.n == 0 or seen.gap > most:
        raise Refused(f"{x} and {y} meet in {seen.n} rows and differ by {seen.gap}, at most {most} is allowed")
    return met


def panel_checks(df: DataFrame, required: list[str], keys: list[str], positive: list[str], finite: list[str]) -> DataFrame:
    """check and rows: how many rows lack a required column's value (all of them, if the column is missing), have a null key, repeat a key, or have
    values that are not positive or not finite (NaN, infinite)."""
    missing = [c for c in required if c not in df.columns]
    have = lambda cs: [c for c in cs if c in df.columns]
    any_of = lambda cs: reduce(lambda a, b: a | b, cs, F.lit(False))
    bad = {
        "missing columns": F.lit(bool(missing)), "null keys": any_of([F.col(k).isNull() for k in have(keys)]), "not positive": any_of([~F.coalesce(F.col(c) > 0, F.lit(True)) for c in have(positive)]),
        "not finite": any_of([F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")) for c in have(finite)]),
    }
    counts = df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in bad.items()))
    twice = df.groupBy(*have(keys)).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated keys"))
    both = counts.join(twice)
    order = ["missing columns", "null keys", "repeated keys", "not positive", "not finite"]
    return both.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(f"`{n}`").alias("rows")) for n in order))).alias("x")).select("x.*")
