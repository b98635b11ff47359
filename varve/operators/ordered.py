"""Ranks, running sums and resampled rankings along one distributed sort, for groups of any size.

A window over few groups gives each group to one task. Here rows are range-partitioned by group and order instead, numbered in their block, and
written once; a group's running sum is that of its block plus what earlier blocks of the group hold, of which there is one row a block
and group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.sources.files import scratch, small


def blocks(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """df sorted by keys and order (which should be total), written as blocks: _part ascends with the sort, _pos counts in it."""
    spark, by = df.sparkSession, [*(F.col(k) for k in keys), *order]
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    path = scratch(spark, "blocks")
    # Both are taken from the sorted partition itself: the number of the partition, and a counter in it.
    placed = ranged.withColumn("_id", F.monotonically_increasing_id())
    placed = placed.select(*(f"`{c}`" for c in df.columns), F.shiftright("_id", 33).cast("int").alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos"))
    placed.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column] | None = None, rank: str | None = "rank") -> DataFrame:
    """df with rank (from 1, in the group's order) and, for each name of sums, its inclusive running sum, and ``<name>_total`` and
    ``rank_total`` (the group's row count). Sums skip nulls."""
    sums = {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in (sums or {}).items()}
    if rank:
        sums[rank] = F.lit(1).cast("long")
    held = blocks(df, keys, order)
    ks = [f"_k{i}" for i in range(len(keys))]
    on = [F.col("_part") == F.col("_p"), *(F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, ks, strict=True))]
    own = [F.col("_part").alias("_p"), *(F.col(k).alias(n) for k, n in zip(keys, ks, strict=True))]
    if list(sums) == [rank]:  # a group's rows stand together in a block, so their places tell the rank: rows are not moved again
        sides = held.groupBy(*keys, "_part").agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
        across = Window.partitionBy(*keys)
        before = F.coalesce(F.sum("_n").over(across.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sides = sides.select(*own, (before - F.col("_first") + 1).alias("_add"), F.sum("_n").over(across).alias(f"{rank}_total"))
        met = held.join(small(sides, "sides")[0], on)
        return met.select(*(f"`{c}`" for c in df.columns), (F.col("_pos") + F.col("_add")).alias(rank), f"{rank}_total")
    local = Window.partitionBy("_part", *keys).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    inside = held.withColumns({f"_in_{n}": F.sum(v).over(local) for n, v in sums.items()})
    # One row a block and group.
    sides = held.groupBy(*keys, "_part").agg(*(F.sum(v).alias(f"_sum_{n}") for n, v in sums.items()))
    across = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sides = sides.withColumns({f"_before_{n}": F.coalesce(F.sum(f"_sum_{n}").over(across), F.lit(0)) for n in sums} | {f"{n}_total": F.sum(f"_sum_{n}").over(Window.partitionBy(*keys)) for n in sums})
    met = inside.join(sides.select(*own, *(f"_before_{n}" for n in sums), *(f"{n}_total" for n in sums)), on)
    return met.select(*(f"`{c}`" for c in df.columns), *((F.col(f"_in_{n}") + F.col(f"_before_{n}")).alias(n) for n in sums), *(f"{n}_total" for n in sums))


def value_ranks(df: DataFrame, keys: list[str], x: str, name: str) -> DataFrame:
    """df with the rank of x in its group (1 + rows with a lesser value; null for null): running counts over the distinct values, joined back."""
    values = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("_n"))
    run = running(values, keys, [F.col(x)], {"_to": F.col("_n")}, rank=None)
    names = [f"_k{i}" for i in range(len(keys) + 1)]
    ranks = run.select(*(F.col(k).alias(n) for k, n in zip([*keys, x], names, strict=True)), (F.col("_to") - F.col("_n") + 1).cast("long").alias(name))
    return df.join(ranks, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip([*keys, x], names, strict=True)], "left").drop(*names)


def tiles(k: int, rank: str = "rank", total: str = "rank_total") -> Column:
    """The tile (1 to k) of a rank: tiles differ by one row at most, the larger ones come first."""
    size, more, at = F.floor(F.col(total) / k), F.col(total) % k, F.col(rank) - 1
    head = more * (size + 1)
    return F.when(at < head, F.floor(at / (size + 1))).otherwise(more + F.floor((at - head) / F.greatest(size, F.lit(1)))).cast("int") + 1


#: Steps of ``step`` to a doubling.
STEPS = 256


def step(x: Column) -> Column:
    """A whole number that ascends with x (null for null), with STEPS values to a doubling of its size; infinities and NaN share the last."""
    size = F.floor(F.least(F.log2(F.abs(x)), F.lit(1100.0)) * STEPS) + 1200 * STEPS
    return F.when(x > 0, size).when(x < 0, -size).when(x == 0, F.lit(0)).cast("int")


def histogram(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Of each group and step of x (nulls left out): keys, _b (the step), _n rows in it, _upto rows in it or below, _total rows of the group.

    One aggregation with a bounded number of rows a group: at most 2 * STEPS * 2200, in practice some thousand."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, step(F.col(x)).alias("_b")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    return counts.withColumns({"_upto": F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)), "_total": F.sum("_n").over(w)})


def top(df: DataFrame, keys: list[str], x: str, tie: list[str], share: float, least: int) -> DataFrame:
    """Rows of the top max(int(share n), least) of each group by x (descending, ties by tie), with rank and rank_total (n, rows with a value).

    A histogram tells which steps can hold these rows; only rows of those steps are sorted."""
    held = histogram(df, keys, x)
    k = lambda n: F.greatest(F.floor(F.lit(share) * n), F.lit(least))
    ks = [f"_k{i}" for i in range(len(keys))]
    lowest = held.where(F.col("_total") - F.col("_upto") < k(F.col("_total"))).groupBy(*(F.col(c).alias(n) for c, n in zip(keys, ks, strict=True))).agg(F.min("_b").alias("_low"), F.max("_total").alias("_all"))
    on = [*(F.col(c).eqNullSafe(F.col(n)) for c, n in zip(keys, ks, strict=True)), step(F.col(x)) >= F.col("_low")]
    near = df.join(small(lowest, "lowest")[0], on).select(*(f"`{c}`" for c in df.columns), "_all")
    ranked = running(near, keys, [F.desc(x), *(F.col(c) for c in tie)])
    return ranked.where(F.col("rank") <= k(F.col("_all"))).withColumn("rank_total", F.col("_all")).drop("_all")


def edges(df: DataFrame, keys: list[str], x: str, tie: list[str], ranks: Callable[[Column], list[Column]], name: str, source: DataFrame | None = None) -> DataFrame:
    """df with name: how many of the group's rows at these ranks (of the row count; 0 for none) stand at or behind the row, in the order of x (nulls first) and tie.

    A histogram tells which steps hold the ranks; only the rows of those steps are sorted, without their other columns. The rows of df are not moved.
    source: the same rows in a form that is cheaper to read, if there is one."""
    source = df if source is None else source
    at = F.coalesce(step(F.col(x)), F.lit(-(1 << 31)))
    ks, by = [f"_k{i}" for i in range(len(keys))], [*keys, "_b"]
    w = Window.partitionBy(*keys)
    held = source.groupBy(*keys, at.alias("_b")).agg(F.count("*").alias("_n"))
    held = held.withColumns({"_before": F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"), "_total": F.sum("_n").over(w)})
    inside = F.filter(F.transform(F.array(*(r.cast("long") for r in ranks(F.col("_total")))), lambda r: r - F.col("_before")), lambda r: (r > 0) & (r <= F.col("_n")))
    held = held.select(*(F.col(k).alias(n) for k, n in zip(keys, ks, strict=True)), F.col("_b").alias("_s"), inside.alias("_t")).where(F.size("_t") > 0)
    steps = small(held, "steps")[0]
    same = [*(F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, ks, strict=True)), F.col("_b") == F.col("_s")]
    near = source.select(*keys, x, *tie, at.alias("_b")).join(steps, same, "left_semi")
    # One row for each rank of each group.
    found = running(near, by, [F.col(x), *(F.col(c) for c in tie)]).join(steps, same).select(*ks, F.struct(x, *tie).alias("_e"), F.explode("_t").alias("_r"), "rank").where("_r = rank")
    found = small(found.groupBy(*ks).agg(F.collect_list("_e").alias("_edges")), "edges")[0]
    met = df.join(found, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, ks, strict=True)] or F.lit(True), "left")
    count = F.size(F.filter(F.coalesce("_edges", F.array()), lambda e: F.struct(x, *tie) <= e))
    return met.select(*(f"`{c}`" for c in df.columns), count.alias(name))


#: Fixed value: 2^31 - 1, a prime; draws are a polynomial of the replicate's number modulo it.
PRIME = 2147483647
#: The distribution function of Poisson(1) at 0 to 7.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998976)


def seeds(entity: str, seed: int = 1) -> list[Column]:
    """Three numbers below PRIME from the MD5 of entity and seed: the coefficients of an entity's polynomial."""
    h = F.md5(F.concat(F.col(entity).cast("string"), F.lit(f":{seed}")).cast("binary"))
    return [(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long") % PRIME).alias(f"_s{i}") for i in range(3)]


def multiplicities(s0: np.ndarray, s1: np.ndarray, s2: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """Poisson(1) weights, a row for each entity and a column for each replicate; any three of an entity's are independent."""
    r = replicates[None, :]
    h = (s0[:, None] + s1[:, None] * r % PRIME + s2[:, None] * r % PRIME * r % PRIME) % PRIME
    return np.searchsorted(np.array(POISSON), h / PRIME, side="right")


#: Rows of a group that lies within one block which a task may hold; the sums of larger ones leave it, as those of shared groups do.
MOST_HELD = 65_536


def _pieces(batches: Iterable[pd.DataFrame], chunk: int) -> Iterator[tuple[int, object, pd.DataFrame]]:
    """Block, group and at most chunk rows of it, in order, from batches of rows sorted by _part and _pos."""
    for rows in batches:
        part, g = rows["_part"].to_numpy(), rows["g"].to_numpy()
        at = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (part[1:] != part[:-1]), [True]))) if len(rows) else []
        for a, b in zip(at[:-1], at[1:], strict=True):
            for c in range(a, b, chunk):
                yield part[a], g[a], rows.iloc[c : min(c + chunk, b)]


def _draws(rows: pd.DataFrame, numbers: np.ndarray) -> np.ndarray:
    return multiplicities(*(rows[f"_s{i}"].to_numpy() for i in range(3)), numbers).astype(float)


def group_sums(batches: Iterable[pd.DataFrame], replicates: int, chunk: int, most: int) -> Iterator[pd.DataFrame]:
    """Of the first and last group of each block (the only ones that other blocks may share), and of those with over most rows in it: part, g, and of each
    replicate the number of draws n and the sum of x over them s. Rows are sorted by _part and _pos; chunk of them are a matrix at a time."""
    numbers, now, size, first, n, s = np.arange(1, replicates + 1), None, 0, True, None, None

    def told() -> pd.DataFrame:
        return pd.DataFrame([(now[0], now[1], n.tolist(), s.tolist())], columns=["part", "g", "n", "s"])

    for part, g, piece in _pieces(batches, chunk):
        if now is None or now != (part, g):
            if now is not None and (first or part != now[0] or size > most):
                yield told()
            first = now is None or part != now[0]
            now, size, n, s = (part, g), 0, np.zeros(replicates), np.zeros(replicates)
        c = _draws(piece, numbers)
        size, n, s = size + len(piece), n + c.sum(axis=0), s + piece["x"].to_numpy() @ c
    if now is not None:
        yield told()


def rank_sums(batches: Iterable[pd.DataFrame], known: dict, replicates: int, top: float, bottom: float, chunk: int) -> Iterator[pd.DataFrame]:
    """Of each replicate, weights and weighted deviations above top (h, hx) and up to bottom (l, lx), over all rows of a task. known: group -> (block, n, s) of
    each of its blocks, as ``group_sums`` tells; rows of other groups are held until their group ends."""
    numbers, total = np.arange(1, replicates + 1), np.zeros((4, replicates))

    def add(piece: pd.DataFrame, before: np.ndarray, n: np.ndarray, s: np.ndarray) -> np.ndarray:
        c = _draws(piece, numbers)
        cum = before + np.cumsum(c, axis=0)
        place = np.divide(cum - c + (c + 1) / 2, n, out=np.zeros_like(c), where=n > 0)
        off = piece["x"].to_numpy()[:, None] - np.divide(s, n, out=np.zeros(replicates), where=n > 0)
        for k, where in ((0, place > top), (2, place <= bottom)):
            w = c * where
            total[k] += w.sum(axis=0)
            total[k + 1] += (w * off).sum(axis=0)
        return cum[-1]

    def close(held: list[pd.DataFrame]) -> None:
        n, s, before = np.zeros(replicates), np.zeros(replicates), np.zeros(replicates)
        for piece in held:
            c = _draws(piece, numbers)
            n, s = n + c.sum(axis=0), s + piece["x"].to_numpy() @ c
        for piece in held:
            before = add(piece, before, n, s)

    now, held, before, n, s = None, [], None, None, None
    for part, g, piece in _pieces(batches, chunk):
        if now is None or now != (part, g):
            close(held)
            now, held = (part, g), []
            if g in known:
                n, s = (sum(p[k] for p in known[g]) for k in (1, 2))
                before = sum((p[1] for p in known[g] if p[0] < part), np.zeros(replicates))
        if g in known:
            before = add(piece, before, n, s)
        else:
            held.append(piece[["x", "_s0", "_s1", "_s2"]].copy())  # at most MOST_HELD rows
    close(held)
    if now is not None:
        yield pd.DataFrame({"replicate": numbers, "h": total[0], "hx": total[1], "l": total[2], "lx": total[3]})


def rank_bootstrap(df: DataFrame, group: str, entity: str, order: str, x: str, replicates: int, top: float, bottom: float, seed: int = 1, chunk: int = 2_048) -> DataFrame:
    """Entity bootstrap of a rank statistic, ranks recomputed in each replicate: replicate, gap.

    gap is the mean of x less its group's mean over entities above the share ``top`` of their group's resampled ranking by order, less that
    over those up to ``bottom``; an entity drawn c times has the middle rank of its c copies. df has one row for each entity; nulls are left out.

    The ranking of all replicates costs one sort: multiplicities are made in the tasks, and of each block only its first and last group (the only ones that
    other blocks may share) and groups of over MOST_HELD rows leave it, as a vector of the replicates. A group may so be of any size: blocks stream through
    the tasks, with chunk rows as a matrix at a time. Replicates without a draw on one side give no row."""
    spark = df.sparkSession
    held = df.select(F.col(group).alias("g"), F.col(entity).alias("e"), F.col(order).cast("double").alias("o"), F.col(x).cast("double").alias("x"), *seeds(entity, seed)).dropna()
    held = blocks(held, ["g"], [F.col("o"), F.col("e")]).select("g", "x", "_s0", "_s1", "_s2", "_part", "_pos")
    kind = dict(held.dtypes)["g"]
    held = held.repartition("_part").sortWithinPartitions("_part", "_pos")
    most = MOST_HELD
    found = held.mapInPandas(lambda rows: group_sums(rows, replicates, chunk, most), f"part int, g {kind}, n array<double>, s array<double>").collect()  # two rows a block, and one for MOST_HELD rows
    shared: dict = {}
    for r in sorted(found, key=lambda r: r.part):
        shared.setdefault(r.g, []).append((r.part, np.array(r.n), np.array(r.s)))
    known = spark.sparkContext.broadcast(shared)
    parts = held.mapInPandas(lambda rows: rank_sums(rows, known.value, replicates, top, bottom, chunk), "replicate int, h double, hx double, l double, lx double")
    return parts.groupBy("replicate").agg(*(F.sum(c).alias(c) for c in ("h", "hx", "l", "lx"))).where("h > 0 and l > 0").select("replicate", (F.col("hx") / F.col("h") - F.col("lx") / F.col("l")).alias("gap"))
