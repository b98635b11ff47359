"""Phrases whose words stand together more often than their parts would by chance, per language.

Equal pieces are first made one, with their multiplicity. Their n-grams are counted in rounds: words; pairs of frequent words; and three to five
words of frequent pairs. Only n-grams whose parts may be frequent are made, which loses nothing, as no n-gram is more frequent than its
parts; which parts are is known by a bit each of ``BITS`` (so its size does not grow with the data; where many parts share bits, only more
n-grams are counted). A task sums the n-grams of about ``WORDS`` words at a time before they are shuffled by a hash of language and n-gram; each hash
bucket is then summed in duckdb within ``MEMORY``, out-of-core in the shared folder beyond that, and the frequent ones stay.

Each cut of a candidate asks for the counts of its two parts: the requests are shuffled to where the part's count is, and the answers back to
the candidate. A word that many candidates ask for stands in ``SALTS`` places, so its requests are dealt out. Products are exact (decimals
of 38 digits). A candidate inside a longer one that is (at ``absorb`` percent) as frequent goes, whatever becomes of the longer one.

Null and empty texts, and pieces of separators alone, have no words. A null language is ``und``. Repeated rows count each time. Ties are
settled by frequency, then by the phrase's bytes.
"""

from __future__ import annotations

import functools
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_size, cut, shared_dir

LONGEST, BITS, WORDS, SALTS = 5, 1 << 26, 1 << 20, 16
#: Words of a row of pieces: longer ones are cut into rows that overlap, so that a batch of rows has a bounded size.
ROW_WORDS = 1024
MEMORY = "256MB"
_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLOCK = 1 << 16  # bits of a block of the bit set


def pieces(docs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Distinct pieces with a word: lang, piece (words joined by one space), m, how often it stands, and own, in how many words from its start n-grams begin.

    A piece of over ROW_WORDS words is cut into rows of so many words and the next longest - 1, in which none begins."""
    low = F.translate(F.coalesce(F.col("text"), F.lit("")), _A, _Z)
    cuts = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.explode(F.split(low, "[.,;:!?\\x0A-\\x0D]")).alias("piece"))
    plain = cuts.select("lang", F.trim(F.when(F.col("piece").rlike("\t|  "), F.regexp_replace("piece", "[ \t]+", " ")).otherwise(F.col("piece"))).alias("piece"))
    held = plain.where("piece <> ''").groupBy("lang", "piece").agg(F.count("*").alias("m"))
    n, words = F.length("piece") - F.length(F.translate("piece", " ", "")) + 1, F.split("piece", " ")
    whole = F.array(F.struct(F.col("piece"), n.cast("int").alias("own")))
    # The words are bound, so that a piece is split once and not at every cut.
    cuts_of = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(ROW_WORDS)), lambda i: F.struct(F.array_join(F.slice(w, i + 1, ROW_WORDS + longest - 1), " ").alias("piece"), F.least(F.lit(ROW_WORDS), F.size(w) - i).cast("int").alias("own")))
    parts = F.transform(F.array(words), cuts_of)[0]
    return held.select("lang", "m", F.explode(F.when(n <= ROW_WORDS, whole).otherwise(parts)).alias("p")).select("lang", "p.piece", "m", "p.own")


def _mix(h: np.ndarray, k: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + k
    return h ^ (h >> np.uint64(32))


def _hashes(texts: pa.Array) -> np.ndarray:
    import pandas as pd

    return pd.util.hash_array(texts.to_numpy(zero_copy_only=False), categorize=False)


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of texts of words joined by spaces: the words' codes, the distinct words, and the number of each text's first word."""
    split = pc.split_pattern(texts, " ")
    flat = split.flatten().dictionary_encode()
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    return flat.indices.to_numpy(), flat.dictionary, np.concatenate(([0], np.cumsum(lengths)))


def _bits(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = (h % np.uint64(BITS)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


class _Hashed:
    """A batch's words: codes, starts of texts, and the hash of each word with its language."""

    def __init__(self, batch: pa.Table, column: str):
        texts, lang = (batch.column(c).combine_chunks() for c in (column, "lang"))
        self.code, self.names, self.first = _words(texts)
        self.lang = lang.dictionary_encode()
        lengths = np.diff(self.first)
        self.of_lang = np.repeat(self.lang.indices.to_numpy(), lengths)
        self.hash = _mix(_hashes(self.names)[self.code], _hashes(self.lang.dictionary)[self.of_lang])
        self.left = np.repeat(self.first[1:], lengths) - np.arange(len(self.code))  # words from here to the text's end


def _grams(batch: pa.Table, lengths: tuple[int, ...], parts: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """The distinct n-grams of a batch of pieces with their counts; parts: the bits of shorter ones that may be frequent."""
    x = _Hashed(batch, "piece")
    lengths_of = np.diff(x.first)
    n_words = len(x.code)
    begins = np.arange(n_words) - np.repeat(x.first[:-1], lengths_of) < np.repeat(batch.column("own").to_numpy(), lengths_of)
    m = np.repeat(batch.column("m").to_numpy(), lengths_of) * begins
    size = lengths[0] - 1  # of the parts
    may = np.ones(n_words, bool)
    if parts is not None:
        h = x.hash
        for k in range(1, size):
            h = _mix(h[:-1], x.hash[k:])
        may = np.concatenate((_bits(h, parts), np.zeros(n_words - len(h), bool))) & (x.left >= size)
    key = x.of_lang.astype(np.int64) * len(x.names) + x.code
    seen, key = np.unique(key, return_inverse=True)
    for n in range(1, min(lengths[-1], n_words) + 1):
        if n > 1:  # the n-gram is its first n - 1 words and one more
            at = key * len(x.names) + np.concatenate((x.code[n - 1 :], np.zeros(n - 1, x.code.dtype)))
            at[x.left < n] = -1
            if n in lengths and parts is not None:  # both of its parts of n - 1 words may be frequent
                at[~(may & np.concatenate((may[1:], [False])))] = -1
                may = at >= 0
            seen, key = np.unique(at, return_inverse=True)
        if n in lengths:
            held = np.bincount(key, m, len(seen)).astype(np.int64)
            some = np.full(len(seen), -1)
            some[key] = np.arange(n_words)  # one place of each
            good = np.flatnonzero((seen >= 0) & (held > 0))
            start = some[good]
            words = [x.names.take(pa.array(x.code[start + k])) for k in range(n)]
            phrase = words[0] if n == 1 else pc.binary_join_element_wise(*words, " ")
            yield pa.RecordBatch.from_arrays([x.lang.dictionary.take(pa.array(x.of_lang[start])), phrase, pa.array(held[good])], ["lang", "phrase", "f"])


def _enough(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size > 6 * WORDS:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def _summed(batches: Iterator[pa.RecordBatch], least: int, folder: str | None) -> Iterator[pa.RecordBatch]:
    """Sums of f by language and phrase, least or more, in duckdb."""
    import duckdb

    place = f"{folder}/{uuid.uuid4().hex}" if folder else ""
    with duckdb.connect(config={"memory_limit": MEMORY, "threads": 1, "temp_directory": place, "preserve_insertion_order": False}) as con:
        try:
            schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])
            reader = pa.RecordBatchReader.from_batches(schema, (b.select(schema.names).cast(schema) for b in batches))
            con.register("grams", reader)
            yield from con.sql(f"SELECT lang, phrase, sum(f)::BIGINT AS f FROM grams GROUP BY ALL HAVING sum(f) >= {least}").to_arrow_reader(8192)
        finally:
            if place:
                shutil.rmtree(place, ignore_errors=True)


def _wide_batches(spark: SparkSession, rows: int) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def _count(held: DataFrame, lengths: tuple[int, ...], parts: bytes | None, least: int, tag: str) -> DataFrame:
    """lang, phrase, f of the n-grams of these lengths that stand least times or more."""
    spark = held.sparkSession
    shared = spark.sparkContext.broadcast(parts)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if shared.value is None else np.frombuffer(shared.value, np.uint8)
        for table in _enough(batches, "piece"):
            for made in _grams(table, lengths, bits):
                for at in range(0, made.num_rows, 8192):
                    yield made.slice(at, 8192)

    at = shared_dir(spark)
    folder = f"{at.removeprefix('file:')}/duckdb" if at.startswith(("/", "file:/")) else None  # duckdb spills to paths only
    schema = "lang string, phrase string, f long"
    _wide_batches(spark, 8192)
    buckets = held.mapInArrow(local, schema).repartition("lang", "phrase")
    out = cut(spark, buckets.mapInArrow(functools.partial(_summed, least=least, folder=folder), schema), tag)
    _wide_batches(spark, 256)
    return out


def _bit_set(frequent: DataFrame) -> bytes:
    """BITS bits, set for the hashes of frequent's phrases: at most BITS / 8 bytes, in blocks, come to the driver."""
    spark = frequent.sparkSession

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _Hashed(pa.Table.from_batches([batch]), "phrase")
            h, n = x.hash, np.diff(x.first)[0]  # all of a length
            h = h.reshape(-1, n)
            out = h[:, 0]
            for k in range(1, n):
                out = _mix(out, h[:, k])
            at = np.unique(out % np.uint64(BITS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // _BLOCK), pa.array(at % _BLOCK)], ["block", "bit"])

    bits = bytearray(BITS // 8)
    # A bitmap is 8 bytes for 64 bits: at most BITS / 64 rows.
    _wide_batches(spark, 8192)
    words = frequent.select("lang", "phrase").mapInArrow(blocks, "block long, bit long").groupBy("block", (F.col("bit") / 64).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("w"))
    packed = words.groupBy("block").agg(F.collect_list(F.struct("word", "w")).alias("words"))
    for r in packed.toLocalIterator():
        for word, w in r.words:
            at = r.block * _BLOCK // 8 + word * 8
            bits[at : at + 8] = (w & (1 << 64) - 1).to_bytes(8, "little")
    _wide_batches(spark, 256)
    return bytes(bits)


def frequencies(held: DataFrame, least: int = 100, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, size, f: all n-grams of up to longest words that stand least times or more. held: as ``pieces`` gives."""
    found = [_count(held, (1,), None, least, "words")]
    for lengths in [(2,), tuple(range(3, longest + 1))]:
        if lengths and lengths[-1] <= longest:
            found.append(_count(held, lengths, _bit_set(found[-1]), least, f"grams{lengths[0]}"))
    out = functools.reduce(DataFrame.unionByName, found)
    return out.select("lang", "phrase", (F.length(F.regexp_replace("phrase", "[^ ]+", "")) + 1).alias("size"), "f")


def mine(docs: DataFrame, least: int = 100, top: int = 2000, absorb: int = 100, longest: int = LONGEST) -> DataFrame:
    """Per language its first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    from pyspark.sql import Window

    spark = docs.sparkSession
    held = cut(spark, pieces(docs, longest), "pieces")
    totals = held.groupBy("lang").agg(F.sum(F.col("m") * F.col("own")).alias("n"))
    counted = frequencies(held, least, longest)

    candidates = counted.where("size > 1").withColumn("w", F.split("phrase", " "))
    sides = F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.array(
        F.struct(k.alias("k"), F.lit("l").alias("side"), F.array_join(F.slice("w", F.lit(1), k), " ").alias("part")),
        F.struct(k.alias("k"), F.lit("r").alias("side"), F.array_join(F.slice("w", k + 1, F.col("size") - k), " ").alias("part")),
    ))))
    requests = candidates.select("lang", "phrase", F.col("f").alias("a"), sides.alias("x")).select("lang", "phrase", "a", "x.*")
    requests = requests.withColumn("salt", F.when(F.instr("part", " ") == 0, F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).otherwise(0).cast("int"))
    counts = counted.where(F.col("size") < longest).select(F.col("lang"), F.col("phrase").alias("part"), "f", F.explode(F.when(F.col("size") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    answers = requests.join(counts.hint("merge"), ["lang", "part", "salt"])
    by_cut = [F.sum(F.when((F.col("k") == k) & (F.col("side") == s), F.col("f"))).alias(f"{s}{k}") for k in range(1, longest) for s in "lr"]
    answered = answers.groupBy("lang", "phrase", "a").agg(*by_cut)

    # f(longer) of all longer candidates around each shorter phrase.
    inside = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " ")))))
    around = candidates.where("size > 2").select("lang", inside.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("_longer"))
    alone = answered.join(around, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("_longer") < absorb * F.col("a"), F.lit(True)))

    whole = alone.join(by_size(totals, 10_000), "lang")
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    over = (wide("a") * 1000).cast("decimal(20,0)") * wide("n")

    def score(k: int):
        return F.floor(F.try_divide(over - F.pmod(over, wide(f"l{k}") * wide(f"r{k}")), wide(f"l{k}") * wide(f"r{k}"))).cast("long")

    cuts = F.array_min(F.filter(F.array(*(F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, longest))), lambda c: c["l"].isNotNull()))
    scored = whole.select("lang", "phrase", "a", "n", cuts.alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = some.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_rank") <= top)  # the first of all are among these
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
