"""Benchmark decontamination as a prefix-filtered set join.

Items are cut into windows of ``size`` consecutive words. Each window must occur whole, so its necessary prefix is one
word: its rarest by document frequency over the whole corpus. Documents meet windows on that word; the word's place in the
window bounds where it starts, the window's length bounds the room left, and the words are then compared exactly.

Frequencies and prefixes are Spark aggregations and joins. If all windows together are of bounded size (``most`` words and
item ids, counted first), they are broadcast and each document is joined in place. Otherwise documents' words are
shuffled to the windows (a frequent word's rows dealt out), and what meets goes back to its document to be compared.

Null texts have no words; a document without words has no hits; an item without words has no windows. Rows are judged one
by one, whatever doc_id they repeat or lack. Items that share an item_id count once.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, cut, deal, map_arrow, small_batches, unused

#: Words and item ids of all windows that are broadcast at most.
MOST = 4_000_000
#: A-Z become a-z; other ASCII characters that are no letter or digit separate words; the rest are word characters.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_FIELDS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows_of(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def _hash(word: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def windows(benchmark: DataFrame, size: int) -> DataFrame:
    """window (its words joined by blanks), items (ids as strings)."""

    def f(x: dict) -> Iterator[dict]:
        pairs = {(b" ".join(w), str(i)) for i, t in zip(x["item_id"], x["text"], strict=True) for w in windows_of(words_of(t), size)}
        yield {"window": [w for w, _ in pairs], "item": [i for _, i in pairs]}

    made = map_arrow(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("None")).alias("item_id"), "text"), "window binary, item string", f)
    return made.groupBy("window").agg(F.collect_set("item").alias("items"))


def frequencies(docs: DataFrame, words: DataFrame) -> DataFrame:
    """word, df: documents in which each of the words occurs, over the whole corpus."""
    few = words.distinct()
    known = docs.sparkSession.sparkContext.broadcast(frozenset(bytes(r.word) for r in few.collect())) if few.count() <= MOST // 8 else None

    def count(x: dict) -> Iterator[dict]:
        seen: Counter = Counter()
        for t in x["text"]:
            seen.update(known.value.intersection(words_of(t)) if known else set(words_of(t)))
        yield {"word": list(seen), "n": list(seen.values())}

    return map_arrow(docs.select("text"), "word binary, n long", count, 4096).groupBy("word").agg(F.sum("n").alias("df"))


def prefixes(docs: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    """window, items, word (the window's rarest), at (its place in the window), df."""
    spark = docs.sparkSession
    held = cut(spark, windows(benchmark, size), "windows")

    def split(x: dict) -> Iterator[dict]:
        rows = [(w, i, word) for w in x["window"] for i, word in enumerate(w.split())]
        yield {"window": [r[0] for r in rows], "at": [r[1] for r in rows], "word": [r[2] for r in rows]}

    words = map_arrow(held.select("window"), "window binary, at int, word binary", split)
    rarity = F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word", "at")
    counts = by_size(cut(spark, frequencies(docs, words.select("word")), "frequencies"), MOST // 8)
    rarest = words.join(counts, "word", "left").groupBy("window").agg(F.min(rarity).alias("r"))
    return held.join(rarest, "window").select("window", "items", "r.word", "r.at", "r.df")


def _broadcast(table: DataFrame, most: int):
    """word -> its windows (place of the word, words, items), broadcast; None if they are more than most."""
    weight = table.agg(F.sum(F.length("window") / 4 + F.size("items") + 2)).first()[0] or 0
    if weight > most:
        return None
    index: dict[bytes, list] = {}
    for r in table.toLocalIterator():
        index.setdefault(bytes(r.word), []).append((r.at, bytes(r.window).split(), tuple(r["items"])))
    return table.sparkSession.sparkContext.broadcast(index)


def _spans(words: list[bytes], index: dict) -> tuple[list[tuple[int, int]], set]:
    spans, items = [], set()
    if not index.keys().isdisjoint(words):
        for i, w in enumerate(words):
            for at, window, ids in index.get(w, ()):
                start = i - at
                if start >= 0 and start + len(window) <= len(words) and words[start : start + len(window)] == window:
                    spans.append((start, start + len(window)))
                    items.update(ids)
    return spans, items


def covered(spans: list[tuple[int, int]]) -> int:
    total = end = 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def digest(items: set) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _result(words: list[list[bytes]], found: list[tuple[list, set]]) -> dict:
    n = [covered(s) for s, _ in found]
    return {
        "n_words": [len(w) for w in words], "n_hit": n, "n_items": [len(i) for _, i in found], "items_sha256": [digest(i) for _, i in found],
        "contaminated": [x > 0 for x in n], "items": [sorted(i) for _, i in found],
    }


def _met(rows: DataFrame, table: DataFrame) -> DataFrame:
    """By a shuffle on the prefix: row and the fields of its result, from rows (row, text)."""

    def places(x: dict) -> Iterator[dict]:
        out: dict[str, list] = {"row": [], "i": [], "h": []}
        for r, t in zip(x["row"], x["text"], strict=True):
            h = list(map(_hash, words_of(t)))
            out["row"] += [r] * len(h)
            out["i"] += range(len(h))
            out["h"] += h
        yield out

    def keyed(x: dict) -> Iterator[dict]:
        yield {"h": list(map(_hash, x["word"]))} | {k: x[k] for k in ("window", "at", "items", "df")}

    groups = map_arrow(table, "h long, window binary, at int, items array<string>, df long", keyed).groupBy("h").agg(F.collect_list(F.struct("window", "at", "items")).alias("windows"), F.max("df").alias("n"))
    met = deal(map_arrow(rows.select("row", "text"), "row long, i int, h long", places), groups, ["h"])
    some = met.where("windows is not null").select("row", "i", F.explode("windows").alias("w")).where("i >= w.at").groupBy("row").agg(F.collect_list(F.struct((F.col("i") - F.col("w.at")).alias("start"), "w.window", "w.items")).alias("spots"))

    def verify(x: dict) -> Iterator[dict]:
        words, found = [words_of(t) for t in x["text"]], []
        for own, spots in zip(words, x["spots"], strict=True):
            true = []
            for s in spots or []:
                w = s["window"].split()
                if own[s["start"] : s["start"] + len(w)] == w:
                    true.append((s["start"], len(w), s["items"]))
            found.append(([(a, a + n) for a, n, _ in true], {i for *_, ids in true for i in ids}))
        yield {"row": x["row"]} | _result(words, found)

    return map_arrow(rows.select("row", "text").join(some, "row", "left"), f"row long, {_FIELDS}", verify, 64)


def hits(docs: DataFrame, benchmark: DataFrame, size: int = 10, most: int = MOST) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (ids as strings)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    table = cut(spark, prefixes(docs, benchmark, size), "prefixes")
    index = _broadcast(table, most)
    if index is not None:

        def one(x: dict) -> Iterator[dict]:
            words = [words_of(t) for t in x["text"]]
            yield {"doc_id": x["doc_id"]} | _result(words, [_spans(w, index.value) for w in words])

        return map_arrow(docs, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_FIELDS}", one)
    rows = cut(spark, docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    return rows.select("doc_id", "row").join(_met(rows, table), "row").drop("row")


def keep_clean(docs: DataFrame, benchmark: DataFrame, size: int = 10, most: int = MOST) -> DataFrame:
    """The rows of docs, with all their columns, that have no benchmark passage in them."""
    spark = docs.sparkSession
    table = cut(spark, prefixes(docs, benchmark, size), "prefixes")
    index = _broadcast(table, most)
    if index is not None:

        @F.pandas_udf("boolean")
        def clean(texts):
            import pandas as pd

            return pd.Series([not _spans(words_of(t), index.value)[0] for t in texts], dtype=bool)

        return small_batches(docs).where(clean("text"))
    row = unused(docs, "_d_row")
    rows = cut(spark, docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    bad = _met(rows.select(F.col(row).alias("row"), "text"), table).where("contaminated").select(F.col("row").alias(row))
    return rows.join(bad, row, "left_anti").drop(row)
