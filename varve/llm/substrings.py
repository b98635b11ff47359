"""Substring deduplication by content-defined chunking.

A gear hash rolls over a text's UTF-8 bytes; where it is below a threshold at the start of a word, a chunk starts. So
chunk borders depend only on the bytes just before them, and text inserted or deleted shifts no later border. Chunks
have 128-bit digests; their sequences are looked up, so words stand together wherever they are found.

*Anchors* are the sequences of adjoining chunks that have ``SEED_WORDS`` words at least and lose that with either end
chunk. The first place of an anchor, in the order of documents (by doc_id, then by a hash of the text; rows without a doc_id
last, while ids are below 2^62) and of words in them, owns it. Anchors elsewhere are copies; those of one document that follow on each other at one
distance from their owners' places are a run. Each run is extended word by word to its true ends, by comparing up to
``REACH`` bytes of text on either side of both places. A run of ``MIN_WORDS`` words or more is a repeated passage, and
``strip`` removes it: all of its words stand together at its owner's place too. A passage inside one document counts once
it lies wholly after its owner's place, so the first of them stays. A passage of ``MIN_WORDS`` words is missed if no
anchor lies in it, or if all of its anchors are owned by documents that lack the rest of it; tests measure how often.

Null and empty texts have no chunks and stay as they are. Rows that share a doc_id but differ in text are documents of
their own; rows equal in both are one document. Rows with a null doc_id are known by 125 bits of their texts' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_size, cut, deal, map_arrow, unused

#: Expected words in a chunk, bytes after which a chunk ends at the next word at latest, words of an anchor and of a
#: passage, bytes of text compared beyond each end of a run.
MEAN_WORDS, MOST_BYTES, SEED_WORDS, MIN_WORDS, REACH = 5, 128, 8, 30, 320
_GEAR = np.random.default_rng(7).integers(0, 1 << 16, 256, dtype=np.uint16)
_BELOW = np.uint16((1 << 16) // MEAN_WORDS)
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def gear(data: np.ndarray) -> np.ndarray:
    """The 16-bit gear hash after each byte: each step shifts the hash left by one and adds the byte's number, so 16
    bytes are in it. Twice the window is made of two halves, so four passes give all positions."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8):
        h[width:] = h[width:] + (h[:-width] << np.uint16(width))
    return h


def chunk(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The text's bytes, the chunks' starts with the end appended, and the words before each of these."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return raw, np.zeros(1, np.int64), np.zeros(1, np.int64)
    space = _SPACES[data]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    # The hash before the word's first byte; a word at the very start always opens a chunk.
    at = starts[(starts > 0) & (gear(data)[np.maximum(starts - 1, 0)] < _BELOW)]
    edges = np.concatenate(([0], at, [len(data)]))
    if (wide := np.flatnonzero(np.diff(edges) > MOST_BYTES)).size:
        more = []
        for i in wide:
            steps = np.arange(edges[i] + MOST_BYTES, edges[i + 1], MOST_BYTES)
            k = np.searchsorted(starts, steps)
            more.append(starts[k[k < len(starts)]])
        edges = np.unique(np.concatenate((edges, *more)))
    return raw, edges, np.searchsorted(starts, edges)


def anchors(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last edges of the anchors, from the words before each chunk edge."""
    n = len(words) - 1
    ends = np.searchsorted(words, words + least, "left")  # beyond n where too few words follow
    starts = np.searchsorted(words, words - least, "right") - 1
    first = np.flatnonzero((ends <= n) & (starts[np.minimum(ends, n)] == np.arange(n + 1)))
    return first, ends[first]


def named(docs: DataFrame, d: str = "d", t: str = "t") -> DataFrame:
    """docs with d and t, which name a row by its doc_id and, where that is null or repeated, by hashes of its text.

    t is 0 for a doc_id that stands once, even and 63 bits of a hash for rows of one that is repeated. A row without a doc_id has an odd t
    and another hash in d (from 2^62 on, so that it comes after other rows), 125 bits together."""
    spark, name = docs.sparkSession, unused(docs, "_s_again")
    again = docs.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias(name)).agg(F.count("*").alias("n")).where("n > 1").select(name)
    again = by_size(cut(spark, again, "again"), 2_000_000)
    most = (1 << 62) - 1
    text = F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull().cast("int")
    other = F.xxhash64(F.lit(1), *text).bitwiseAND(F.lit(most)).bitwiseOR(F.lit(most + 1))
    half = F.xxhash64(*text).bitwiseAND(F.lit(-2))
    made = docs.join(again, F.col("doc_id").cast("long") == F.col(name), "left")
    made = made.withColumns({d: F.coalesce(F.col("doc_id").cast("long"), other), t: F.when(F.col("doc_id").isNull(), half.bitwiseOR(F.lit(1))).when(F.col(name).isNotNull(), half).otherwise(F.lit(0).cast("long"))})
    return made.select(*(f"`{c}`" for c in docs.columns), d, t)


def doc_id_of(d: Column, t: Column) -> Column:
    return F.when(t.bitwiseAND(F.lit(1)) == 0, d)


def _anchors(docs: DataFrame) -> DataFrame:
    """Anchors: d, t, h (the digest), w (words before it) and n (its words)."""

    def f(x: dict) -> Iterator[dict]:
        out: dict[str, list] = {k: [] for k in ("d", "t", "h", "w", "n")}
        for d, t, text in zip(x["d"], x["t"], x["text"], strict=True):
            raw, edges, words = chunk(text)
            if words[-1] < SEED_WORDS:
                continue
            first, last = anchors(words, SEED_WORDS)
            cuts = edges.tolist()
            chunks = b"".join([xxhash.xxh3_128_digest(raw[a:b].strip()) for a, b in zip(cuts, cuts[1:], strict=False)])
            digests = b"".join([xxhash.xxh3_64_digest(chunks[16 * a : 16 * b]) for a, b in zip(first.tolist(), last.tolist(), strict=True)])
            for k, v in zip(out, ([d] * len(first), [t] * len(first), np.frombuffer(digests, np.int64).tolist(), words[first].tolist(), (words[last] - words[first]).tolist()), strict=True):
                out[k] += v
        yield out

    return map_arrow(docs, "d long, t long, h long, w int, n int", f, 64)


def _runs(rows: DataFrame) -> DataFrame:
    """Copied anchors that follow on each other: run, d, t, w0 and w1 (words), and their owner's od, ot, ow0."""
    owners = rows.groupBy("h").agg(F.min(F.struct("d", "t", "w")).alias("o"), F.count("*").alias("c")).where("c > 1")
    owners = cut(rows.sparkSession, owners, "owners")
    met = deal(rows, owners, ["h"], "c").where("o is not null").select("d", "t", "w", "n", F.col("o.d").alias("od"), F.col("o.t").alias("ot"), F.col("o.w").alias("ow"))
    own = (F.col("d") == F.col("od")) & (F.col("t") == F.col("ot"))
    copies = met.where(~own | (F.col("w") >= F.col("ow") + F.col("n"))).withColumn("shift", F.col("w") - F.col("ow"))
    order = Window.partitionBy("d", "t", "od", "ot", "shift").orderBy("w")
    reached = F.max(F.col("w") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = copies.withColumn("new", F.when(F.col("w") <= reached, 0).otherwise(1)).withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    made = marked.groupBy("d", "t", "od", "ot", "shift", "part").agg(F.min("w").alias("w0"), F.max(F.col("w") + F.col("n")).alias("w1"))
    return made.select(F.xxhash64("d", "t", "od", "ot", "shift", "part").alias("run"), "d", "t", "w0", "w1", "od", "ot", (F.col("w0") - F.col("shift")).alias("ow0"))


def _word_starts(raw: bytes) -> np.ndarray:
    space = _SPACES[np.frombuffer(raw, np.uint8)]
    return np.flatnonzero(~space & np.concatenate(([True], space[:-1])))


def _around(docs: DataFrame, places: DataFrame) -> DataFrame:
    """d, t, w, left (whether the text before word w is meant), near: up to REACH bytes of whole words there. Equal rows of docs give equal rows."""
    wanted = places.distinct().groupBy("d", "t").agg(F.collect_list(F.struct("w", "left")).alias("places"), F.count("*").alias("c"))
    wanted = by_size(cut(docs.sparkSession, wanted, "places"), 500_000, F.col("c") + 2).drop("c")

    def f(x: dict) -> Iterator[dict]:
        out: dict[str, list] = {k: [] for k in ("d", "t", "w", "left", "near")}
        for d, t, text, places in zip(x["d"], x["t"], x["text"], x["places"], strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            starts = np.append(_word_starts(raw), len(raw))
            for p in places:
                at = int(starts[p["w"]])
                if p["left"]:
                    near = raw[starts[np.searchsorted(starts, at - REACH)] : at]
                else:
                    near = raw[at : starts[np.searchsorted(starts, at + REACH, "right") - 1]]
                for k, v in zip(out, (d, t, p["w"], p["left"], near), strict=True):
                    out[k].append(v)
        yield out

    return map_arrow(docs.join(wanted, ["d", "t"]).select("d", "t", "text", "places"), "d long, t long, w int, left boolean, near binary", f, 64)


def _alike(left: bool, a: bytes, b: bytes) -> int:
    """Words that two texts have in common at the end (left) or at the start."""
    x, y = a.split(), b.split()
    n = 0
    for u, v in zip(reversed(x), reversed(y), strict=False) if left else zip(x, y, strict=False):
        if u != v:
            break
        n += 1
    return n


def passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Of docs as ``named`` has them, repeated passages: d, t, w0 and w1 (words), owners (doc_ids of documents that had parts of it first)."""
    docs = docs.select("d", "t", "text")
    runs = cut(docs.sparkSession, _runs(_anchors(docs)), "runs")
    length = F.col("w1") - F.col("w0")
    sides = F.explode(F.array(F.struct(F.lit(True).alias("left"), F.col("w0").alias("w"), F.col("ow0").alias("ow")), F.struct(F.lit(False).alias("left"), F.col("w1").alias("w"), (F.col("ow0") + length).alias("ow"))))
    ends = runs.select("run", "d", "t", "od", "ot", sides.alias("s")).select("run", "d", "t", "od", "ot", "s.*")
    near = cut(docs.sparkSession, _around(docs, ends.select("d", "t", "w", "left").union(ends.select("od", "ot", "ow", "left"))), "near")
    # One row a place, dealt by the keys of the joins below, which so need no other shuffle of the texts.
    near = near.groupBy("d", "t", "w", "left").agg(F.min("near").alias("near"))
    # Thousands of copies may have one owner's place.
    place = ["od", "ot", "ow", "left"]
    owners = ends.groupBy(*place).agg(F.count("*").alias("c")).join(near.select(F.col("d").alias("od"), F.col("t").alias("ot"), F.col("w").alias("ow"), "left", F.col("near").alias("onear")), place)
    owners = cut(docs.sparkSession, owners, "owners")
    met = deal(ends.join(near, ["d", "t", "w", "left"]), owners, place, "c")

    def grow(x: dict) -> Iterator[dict]:
        yield {"run": x["run"], "before": [_alike(s, a, b) if s else 0 for s, a, b in zip(x["left"], x["near"], x["onear"], strict=True)], "after": [0 if s else _alike(s, a, b) for s, a, b in zip(x["left"], x["near"], x["onear"], strict=True)]}

    more = map_arrow(met.select("run", "left", "near", "onear"), "run long, before int, after int", grow).groupBy("run").agg(F.max("before").alias("before"), F.max("after").alias("after"))
    grown = runs.join(more, "run")
    # Inside one document a copy starts where its owner's place ends, at the earliest.
    shift = F.col("w0") - F.col("ow0")
    own = (F.col("d") == F.col("od")) & (F.col("t") == F.col("ot"))
    room = F.greatest(shift - length, F.lit(0))
    before = F.when(own, F.least("before", room)).otherwise(F.col("before"))
    after = F.when(own, F.least("after", F.greatest(room - before, F.lit(0)))).otherwise(F.col("after"))
    found = grown.select("d", "t", (F.col("w0") - before).alias("w0"), (F.col("w1") + after).alias("w1"), doc_id_of(F.col("od"), F.col("ot")).alias("owner")).where((F.col("w1") - F.col("w0") >= min_words))
    order = Window.partitionBy("d", "t").orderBy("w0", "w1")
    reached = F.max("w1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("new", F.when(F.col("w0") <= reached, 0).otherwise(1)).withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("d", "t", "part").agg(F.min("w0").alias("w0"), F.max("w1").alias("w1"), F.sort_array(F.collect_set("owner")).alias("owners")).drop("part")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per document with repeated passages: doc_id, n_passages, n_words, starts and ends (in words), owner_ids."""
    spans = F.sort_array(F.collect_list(F.struct("w0", "w1")))
    found = passages(named(docs.select("doc_id", "text")), min_words).groupBy("d", "t").agg(F.count("*").alias("n_passages"), F.sum(F.col("w1") - F.col("w0")).alias("n_words"), spans.alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("owners")))).alias("owner_ids"))
    return found.select(doc_id_of(F.col("d"), F.col("t")).alias("doc_id"), "n_passages", "n_words", F.col("s.w0").alias("starts"), F.col("s.w1").alias("ends"), "owner_ids")


def strip(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with all its columns, repeated passages taken out of ``text`` (and ``n_chars`` following, if there).
    A document of which nothing but white space is left goes."""
    names = {k: unused(docs, f"_s_{k}") for k in ("d", "t", "spans", "text")}
    marked = named(docs, names["d"], names["t"])
    texts = marked.select(F.col(names["d"]).alias("d"), F.col(names["t"]).alias("t"), "text")
    names |= {"od": unused(docs, "_s_od"), "ot": unused(docs, "_s_ot")}
    spans = passages(texts, min_words).groupBy(F.col("d").alias(names["od"]), F.col("t").alias(names["ot"])).agg(F.sort_array(F.collect_list(F.struct("w0", "w1"))).alias(names["spans"]))
    spans = by_size(cut(docs.sparkSession, spans, "passages"), 500_000, F.size(names["spans"]) + 1)
    held = marked.join(spans, (F.col(names["d"]) == F.col(names["od"])) & (F.col(names["t"]) == F.col(names["ot"])), "left")

    @F.pandas_udf("string")
    def without(texts, all_spans):
        import pandas as pd

        out = []
        for text, spans in zip(texts, all_spans, strict=True):
            if spans is None or text is None:
                out.append(text)
                continue
            raw, at, parts = text.encode("utf-8", "surrogatepass"), 0, []
            starts = np.append(_word_starts(raw), len(raw))
            for s in spans:
                parts.append(raw[at : starts[s["w0"]]])
                at = int(starts[s["w1"]])
            out.append(b"".join([*parts, raw[at:]]).decode("utf-8", "replace"))
        return pd.Series(out, dtype=object)

    spans, text = F.col(names["spans"]), F.col(names["text"])
    done = held.withColumn(names["text"], F.when(spans.isNotNull(), without("text", spans)).otherwise(F.col("text")))
    done = done.where(spans.isNull() | (F.trim(F.regexp_replace(text, r"\s+", " ")) != ""))
    change = {"text": text}
    if "n_chars" in docs.columns:
        change["n_chars"] = F.when(spans.isNotNull(), F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return done.withColumns(change).select(*(f"`{c}`" for c in docs.columns))
