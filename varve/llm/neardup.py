"""Near-duplicate detection with HyperMinHash registers.

A document's set is its distinct word shingles (with fewer words than a shingle, the whole sequence as one). Each of
``K`` buckets has its own hash function and stores, of the least hash in it, the number of leading zeros and the first
``MANTISSA`` bits after them: 16 bits a bucket. ``BANDS`` bands of ``ROWS`` registers give candidates. A candidate
pair's Jaccard similarity is estimated from equal registers, corrected for registers that are equal by chance, and
only pairs near or over the threshold are confirmed on their full sets.

Documents of equal sets are one class, so thousands of copies count once. Candidates of a band are not paired with
each other. Each bucket has a hub, its member with the most company over all buckets, and each member x is compared
with its hub h alone; what differs is its set of edits E(x), the symmetric difference with h. The symmetric difference
of two members is that of their edits, so members x and y are alike only if it has at most q (|x| + |y|) elements, with
q = (100 - percent) / (100 + percent). Both linked with the hub, they are in one component already; otherwise
|E(x)| + |E(y)| exceeds that bound, and they must share at least half the excess of their edits. That is an exact set
join on edits, done with prefix filters per hub (elements that the hub lacks first). It finds every link that is left,
and random edits share next to nothing, so a group of thousands of near copies gives few pairs.

A pair at the threshold of 0.8 shares no band with probability (1 - 0.8^5)^36, under 1e-6.

Null, empty and wordless texts have an empty set, are linked with nothing and stand for themselves. Rows that repeat
a doc_id stand in one class, whatever their texts: each text is compared, and their classes are joined. Rows with a null doc_id get a null
component, and are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_size, cut, deal, map_arrow, unused

ROWS, BANDS = 5, 36
K = ROWS * BANDS
MANTISSA = 10
#: Standard errors that an estimate may lie below the threshold before its pair is given up.
SLACK = 6.0

_RNG = np.random.default_rng(20240229)
_MULTIPLY = _RNG.integers(1, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, K, dtype=np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles. A-Z count as a-z; ASCII white space separates words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.full(n, len(h) if len(h) < size else size, np.uint64)
    for j in range(min(size, len(h))):
        out = _mix(out * _M2 + h[j : j + n])
    return np.unique(out)


def registers(s: np.ndarray) -> np.ndarray:
    """K registers of a non-empty set: leading zeros of each bucket's least hash, then the bits after them."""
    least = np.full(K, ~np.uint64(0))
    for at in range(0, len(s), 512):
        np.minimum(least, (s[at : at + 512, None] * _MULTIPLY + _ADD).min(axis=0), out=least)
    fraction, exponent = np.frexp(np.maximum(least, np.uint64(1)).astype(np.float64))
    zeros = 64 - np.minimum(exponent, 64)
    return ((zeros << MANTISSA) | np.minimum((fraction * 2 - 1) * (1 << MANTISSA), (1 << MANTISSA) - 1).astype(np.int64)).astype(np.uint16)


def bands(r: np.ndarray) -> np.ndarray:
    r = r.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = _mix(key * _M2 + r[:, j] + np.uint64(1))
    return key.view(np.int64)


@lru_cache(4096)
def chance(n: int, m: int) -> float:
    """Probability that registers of disjoint sets of about n and m elements agree."""
    cells = 1 << 6  # cells of a power of two; finer ones only divide the result
    edges = (2.0 ** -np.arange(1, 49))[:, None] * (1 + np.arange(cells + 1) / cells)
    below = lambda x, size: -np.expm1(size * np.log1p(-np.minimum(x, 1 - 1e-16)))
    p, q = (np.diff(below(edges, float(x)), axis=1) for x in (n, m))
    return float((p * q).sum()) * cells / (1 << MANTISSA)


def _class(n: int) -> int:
    """n to three significant bits, for the cache."""
    shift = max(0, n.bit_length() - 3)
    return n >> shift << shift


def estimate(a: np.ndarray, b: np.ndarray, n: int, m: int) -> float:
    """Jaccard similarity of sets of n and m elements from their registers, corrected for chance agreement."""
    c = chance(*sorted((_class(n), _class(m))))
    return max(0.0, (float((a == b).mean()) - c) / (1 - c))


def _sketch(docs: DataFrame, size: int) -> DataFrame:
    """Per row: doc_id, n, digest of the set in two halves, band keys."""

    def f(x: dict) -> Iterator[dict]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n", "h1", "h2", "keys")}
        for d, t in zip(x["doc_id"], x["text"], strict=True):
            s = shingles(t, size)
            digest = xxhash.xxh3_128_digest(s.tobytes())
            for k, v in zip(out, (d, len(s), *np.frombuffer(digest, np.int64).tolist(), bands(registers(s)).tolist() if len(s) else []), strict=True):
                out[k].append(v)
        yield out

    return map_arrow(docs.select("doc_id", "text"), "doc_id long, n long, h1 long, h2 long, keys array<long>", f)


def _features(docs: DataFrame, size: int) -> DataFrame:
    def f(x: dict) -> Iterator[dict]:
        sets = [shingles(t, size) for t in x["text"]]
        digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64)
        yield {"id": x["doc_id"], "h1": digests[::2].tolist(), "h2": digests[1::2].tolist(), "registers": [registers(s).tobytes() if len(s) else b"" for s in sets], "elements": [s.tobytes() for s in sets]}

    return map_arrow(docs.select("doc_id", "text"), "id long, h1 long, h2 long, registers binary, elements binary", f, 64)


def _paired(pairs: DataFrame, features: DataFrame) -> DataFrame:
    side = lambda k: features.select(F.col("id").alias(k), F.col("registers").alias(f"r{k}"), F.col("elements").alias(f"e{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ra", "rb", "ea", "eb")


def _maybe(ra: bytes, rb: bytes, n: int, m: int, percent: int) -> bool:
    """The registers' estimate doesn't rule the pair out."""
    p = percent / 100
    return estimate(np.frombuffer(ra, np.uint16), np.frombuffer(rb, np.uint16), n, m) >= p - SLACK * (p * (1 - p) / K) ** 0.5


def _confirm(pairs: DataFrame, features: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union: estimated first, then counted."""

    def f(x: dict) -> Iterator[dict]:
        out: dict[str, list] = {"a": [], "b": []}
        for a, b, ra, rb, ea, eb in zip(*(x[k] for k in ("a", "b", "ra", "rb", "ea", "eb")), strict=True):
            n, m = len(ea) // 8, len(eb) // 8
            if _maybe(ra, rb, n, m, percent):
                both = n + m - len(np.union1d(np.frombuffer(ea, np.uint64), np.frombuffer(eb, np.uint64)))
                if 100 * both >= percent * (n + m - both):
                    out["a"].append(a)
                    out["b"].append(b)
        yield out

    return map_arrow(_paired(pairs, features), "a long, b long", f)


def _edits(pairs: DataFrame, features: DataFrame, percent: int) -> DataFrame:
    """For hub a and member b: n (size of b's set), e (number of its edits), linked, and the edits' prefix that an
    alike member must meet, those that the hub lacks first."""

    def f(x: dict) -> Iterator[dict]:
        out: dict[str, list] = {k: [] for k in ("a", "b", "n", "e", "linked", "prefix")}
        for a, b, ra, rb, ea, eb in zip(*(x[k] for k in ("a", "b", "ra", "rb", "ea", "eb")), strict=True):
            hub, own = np.frombuffer(ea, np.uint64), np.frombuffer(eb, np.uint64)
            n, m = len(hub), len(own)
            edits = np.concatenate((np.setdiff1d(own, hub, assume_unique=True), np.setdiff1d(hub, own, assume_unique=True)))
            both = (n + m - len(edits)) // 2
            linked = _maybe(ra, rb, n, m, percent) and 100 * both >= percent * (n + m - both)
            most = (100 - percent) * (m + m * 100 // percent + 1) // (100 + percent) + 1
            for k, v in zip(out, (a, b, m, len(edits), linked, edits[:most].view(np.int64).tolist()), strict=True):
                out[k].append(v)
        yield out

    return map_arrow(_paired(pairs, features), "a long, b long, n long, e long, linked boolean, prefix array<long>", f, 64)


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, component) of all ends of edges (a, b): the least id reachable. Alternates large-star and small-star steps."""
    edges = cut(spark, edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("u"), F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        edges = cut(spark, small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def classes(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = cut(spark, _sketch(docs, size), "sketch")
    # Documents of equal sets are one class under the least doc_id.
    filled = sketch.where("n > 0 and doc_id is not null")
    # A doc_id whose rows have several sets names none of them: where it would, a set is known by a negative number from its digest.
    own = cut(spark, filled.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("x"), F.max(F.struct("h1", "h2")).alias("y")).where("x <> y").select("doc_id"), "several")
    several = not own.isEmpty()
    sets = filled.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.min_by("keys", "doc_id").alias("keys"), F.count("*").alias("n"))
    if several:
        named = sets.join(by_size(own.withColumnsRenamed({"doc_id": "_own"}), 2_000_000), F.col("id") == F.col("_own"), "left")
        sets = named.withColumn("id", F.when(F.col("_own").isNotNull(), F.col("h1").bitwiseOR(F.lit(-(1 << 63)))).otherwise(F.col("id"))).drop("_own")
    sets = cut(spark, sets, "sets")
    reps = sets.select("h1", "h2", "id", "n")
    table = sets.select("id", F.explode("keys").alias("key")).distinct()
    many = table.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    table = cut(spark, table.join(many, "key"), "bands")
    wanted = table.select("id").distinct()
    if several:  # rows of the wanted sets, known by their digests; any row of a set has its features
        rows = filled.join(reps, ["h1", "h2"]).join(wanted.where("id < 0"), "id", "left_semi").select("doc_id").distinct()
        some = wanted.where("id >= 0").select(F.col("id").alias("doc_id")).unionByName(rows).distinct()
    else:
        some = wanted.select(F.col("id").alias("doc_id"))
    some = by_size(cut(spark, some, "wanted"), 2_000_000)
    features = cut(spark, _features(docs.join(some, "doc_id", "left_semi"), size), "features")
    if several:
        features = features.drop("id").join(reps.join(wanted, "id", "left_semi").select("id", "h1", "h2"), ["h1", "h2"])
    features = features.select("id", "registers", "elements").dropDuplicates(["id"])

    # Each bucket's members with its hub.
    company = table.groupBy("id").agg(F.sum("c").alias("company"))
    hubs = table.join(company, "id").groupBy("key").agg(F.min_by("id", F.struct(-F.col("company"), "id")).alias("a"))
    stars = table.join(hubs, "key").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    edits = cut(spark, _edits(stars, features, percent), "edits")
    links = edits.where("linked").select("a", "b")
    labels = cut(spark, components(spark, links), "labels")

    # Members that a hub's group may still link: their prefixes of edits meet.
    open_hubs = edits.groupBy("a").agg(F.count("*").alias("members"), F.count_if(~F.col("linked")).alias("apart")).where("members > 1 and apart > 0").select("a")
    rows = edits.join(open_hubs, "a", "left_semi").join(labels.withColumnRenamed("id", "b"), "b", "left").withColumn("label", F.coalesce("component", "b"))
    rows = rows.select("a", "b", "n", "e", "linked", "label", F.posexplode("prefix").alias("pos", "element"))
    x, y = rows.alias("x"), rows.alias("y")
    excess = (100 + percent) * (F.col("x.e") + F.col("y.e")) - (100 - percent) * (F.col("x.n") + F.col("y.n"))
    need = F.ceil(excess / (2 * (100 + percent)))  # edits that they must share
    alike = (F.col("x.n") * 100 >= F.col("y.n") * percent) & (F.col("y.n") * 100 >= F.col("x.n") * percent)
    reach = (F.col("x.pos") <= F.col("x.e") - need) & (F.col("y.pos") <= F.col("y.e") - need)
    apart = (F.col("x.b") < F.col("y.b")) & (F.col("x.label") != F.col("y.label")) & ~(F.col("x.linked") & F.col("y.linked"))
    same = (F.col("x.a") == F.col("y.a")) & (F.col("x.element") == F.col("y.element"))
    rest = x.join(y, same & apart & alike & reach).select(F.col("x.b").alias("a"), F.col("y.b").alias("b")).distinct()
    found = cut(spark, _confirm(rest, features, percent), "links")

    ids = deal(filled.select("doc_id", "h1", "h2"), reps, ["h1", "h2"]).select("doc_id", "id")  # thousands may share a set
    more = found
    if several:  # rows of one doc_id with different sets belong together whatever their sets
        shared = cut(spark, ids.join(by_size(own, 2_000_000), "doc_id", "left_semi").distinct(), "shared")
        more = more.unionByName(shared.join(shared.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").select("a", F.col("id").alias("b")).where("a <> b"))
    if not more.isEmpty():
        stars_of = labels.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
        labels = cut(spark, components(spark, stars_of.unionByName(more)), "labels")
    ids = ids.join(labels, "id", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "id")).alias("component"))
    if several:  # components whose least number is no doc_id
        least = ids.where("component < 0").groupBy("component").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
        ids = deal(ids, cut(spark, least, "least"), ["component"]).select("doc_id", F.coalesce("least", "component").alias("component"))
    out = sketch.select("doc_id", "n").join(ids, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their component. Of rows that repeat a doc_id, all stay or go."""
    name = unused(docs, "_n_id")
    gone = cut(docs.sparkSession, classes(docs, size, percent).where("not kept").select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(by_size(gone, 2_000_000), F.col("doc_id").cast("long") == F.col(name), "left_anti")
