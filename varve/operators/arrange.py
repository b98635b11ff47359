"""Arrangements of values over the slots of a group: who has which value, by rank, by seeded draws, or made alike."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.sources.files import kept


def draw(entity: str, seed: str) -> Column:
    """A seeded order of entities that any engine has: the MD5 of both."""
    return F.md5(F.concat(F.col(entity).cast("string"), F.lit(f":{seed}")).cast("binary"))


def _place(keys: list[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def arrange(df: DataFrame, keys: list[str], entity: str, by: str, value: str, kind: str, seed: str = "1", share: float = 1.0, name: str = "given") -> DataFrame:
    """df with the value that each slot is given in its group.

    kind: ``identity``; ``sorted`` (the k-th least value to the k-th least slot by ``by``), ``reverse`` (the k-th least to the k-th greatest);
    ``shuffle`` (values in a seeded order); ``partial`` (sorted, then round(share n) slots, chosen by one seeded order, change values among themselves by another).
    Ties are settled by entity, which should be unique in a group. A group's values are only moved, never changed."""
    if kind == "identity":
        return df.withColumn(name, F.col(value))
    placed = places(df, keys, entity, by, value, {"d": seed, "chosen": f"{seed}:slot", "value": f"{seed}:value"} if kind in ("shuffle", "partial") else {})
    if kind == "shuffle":
        made = _matched(placed, keys, value, F.col("_slot"), F.col("_d"), name)
    elif kind == "reverse":
        made = _matched(placed, keys, value, F.col("_n") + 1 - F.col("_slot"), F.col("_own"), name)
    else:
        made = _matched(placed, keys, value, F.col("_slot"), F.col("_own"), name)
        made = _moved(made, keys, share, name) if kind == "partial" else made
    return made.select(*(f"`{c}`" for c in df.columns), name)


def places(df: DataFrame, keys: list[str], entity: str, by: str, value: str, draws: dict[str, str]) -> DataFrame:
    """df with places in the group: _slot (by ``by``), _own (by value), one for each seeded order (name -> seed, as _<name>), and _n, the group's rows."""
    made = {"_slot": _place(keys, F.col(by), F.col(entity)), "_own": _place(keys, F.col(value), F.col(entity)), "_n": F.count("*").over(Window.partitionBy(*keys))}
    return df.withColumns(made | {f"_{n}": _place(keys, draw(entity, s), F.col(entity)) for n, s in draws.items()})


def _matched(placed: DataFrame, keys: list[str], value: str, slot: Column, own: Column, name: str) -> DataFrame:
    """placed with the value whose place own is the slot's."""
    return placed.withColumn("_k", slot).join(placed.select(*keys, F.col(value).alias(name), own.alias("_k")), [*keys, "_k"])


def _moved(made: DataFrame, keys: list[str], share: float, name: str) -> DataFrame:
    """made, in which the chosen slots (by their places _chosen in a seeded order) change values among themselves by another (_value); the others are left alone."""
    chosen = F.col("_chosen") <= F.round(F.lit(share) * F.col("_n"))
    some = made.where(chosen).withColumns({"_a": _place(keys, F.col("_slot")), "_b": _place(keys, F.col("_value"))})
    moved = some.select(*keys, F.col("_b").alias("_a"), F.col(name).alias("_moved"))
    some = some.join(moved, [*keys, "_a"]).withColumn(name, F.col("_moved"))
    return made.where(~chosen).unionByName(some.select(*made.columns))


def alike(df: DataFrame, value: str, keys: list[str], cost: str | None = None, name: str = "given") -> DataFrame:
    """df with one value for all: the harmonic mean over the group (of keys; [] for all rows), weighted by cost if that is named."""
    w = F.col(cost) if cost else F.lit(1.0)
    mean = (F.sum(w) / F.sum(w / F.col(value))).alias(name)
    return df.join(df.groupBy(*keys).agg(mean), keys) if keys else df.join(F.broadcast(df.agg(mean)))


def summary(df: DataFrame, value: str, weight: str, by: str) -> DataFrame:
    """Of arrangements (columns kind, label): n, corr of by and the given value (null if one is constant), and delta, the weighted mean of the value."""
    return df.groupBy("kind", "label").agg(F.count("*").alias("n"), F.try_divide(F.covar_pop(by, value), F.stddev_pop(by) * F.stddev_pop(value)).alias("corr"), (F.sum(F.col(weight) * F.col(value)) / F.sum(weight)).alias("delta"))


def arrangements(df: DataFrame, keys: list[str], entity: str, by: str, value: str, cost: str, shuffles: int, shares: list[float]) -> DataFrame:
    """All arrangements under each other, with kind and label: baseline, shuffles, extremes, a curve of partial shuffles, and two with all values alike."""
    # Rows are written with all their places, and once more with the sorted values, instead of being made and sorted for each arrangement.
    df = kept(df, "slots")
    seeds = {f"d{i}": f"s{i}" for i in range(1, shuffles + 1)} | {"chosen": "p:slot", "value": "p:value"}
    placed = kept(places(df, keys, entity, by, value, seeds), "places")
    ordered = kept(_matched(placed, keys, value, F.col("_slot"), F.col("_own"), "given"), "sorted")
    made = [("baseline", "baseline", arrange(df, keys, entity, by, value, "identity"))]
    made += [("permutation", f"shuffle_{i}", _matched(placed, keys, value, F.col("_slot"), F.col(f"_d{i}"), "given")) for i in range(1, shuffles + 1)]
    made += [("permutation", "reverse", _matched(placed, keys, value, F.col("_n") + 1 - F.col("_slot"), F.col("_own"), "given"))]
    made += [("curve", f"partial_{round(100 * q):03d}", _moved(ordered, keys, q, "given")) for q in shares]
    made += [("alike", "hom_group", alike(df, value, keys)), ("alike", "hom_cost", alike(df, value, [], cost))]
    return reduce(DataFrame.unionByName, (t.select(F.lit(k).alias("kind"), F.lit(label).alias("label"), *df.columns, "given") for k, label, t in made))


def split(points: DataFrame) -> DataFrame:
    """From ``summary``: what all alike give (common), what differing values add in a random order (heterogeneity, over the shuffles' mean), and what their
    own order adds (sorting), with the shuffles' range and shares of the baseline; one row."""
    at = lambda label: F.max(F.when(F.col("label") == label, F.col("delta")))
    shuffled = F.when(F.col("label").startswith("shuffle_"), F.col("delta"))
    x = points.agg(at("baseline").alias("base"), at("hom_group").alias("common"), at("hom_cost").alias("common_cost"), F.avg(shuffled).alias("shuf"), (F.max(shuffled) - F.min(shuffled)).alias("shuffle_range"), F.count(shuffled).alias("n_shuffles"))
    x = x.select("n_shuffles", "base", "common", "common_cost", (F.col("shuf") - F.col("common")).alias("heterogeneity"), (F.col("base") - F.col("shuf")).alias("sorting"), "shuffle_range")
    return x.withColumns({f"share_{c}": F.try_divide(F.col(c), F.col("base")) for c in ("common", "heterogeneity", "sorting")})
