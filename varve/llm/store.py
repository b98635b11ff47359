"""A content-addressed store of token ids.

Documents' id streams are cut where a rolling gear hash over the last 16 ids is below a threshold, so equal passages
give equal chunks. Each distinct chunk is held once. A folder holds five Parquet tables:

* ``chunks`` (digest, data): the chunks that stand in more than one place. data: ids as little-endian numbers of ``width``
  bytes (2 if the whole vocabulary and the end id fit, else 4); digest is its BLAKE2b-128.
* ``own`` (home, digest, data): the chunks that stand in one place, with the number of the document that has them, so
  that reading brings them there at once.
* ``recipes`` (part, row, doc_id, home, local_start, n_tokens, root, digests): documents in ascending doc_id order (nulls
  first, then by root), in range parts; home is a number that no other document has; root is the SHA-256 of the digests
  in order; local_start counts ids in the part.
* ``manifest`` (part, n_docs, n_tokens, root): per part, root being the Merkle root of its documents (doc_id, place,
  home, length and root of each).
* ``head`` (width, n_parts, n_docs, n_tokens, root, n_chunks, chunk_sum): one row; root is the Merkle root of the manifest's rows,
  chunk_sum the sum of 64-bit hashes of the chunks' digests.

Reading verifies all of it: the head against the manifest, every part's Merkle root and counts against its recipes, every
chunk that a recipe names against its digest, every document against its root, and the chunks' number and sum against the head. A missing,
extra or changed chunk, recipe or manifest row is an error. Null and empty texts are documents of the end id alone. Rows that repeat a doc_id, and rows without one, are
documents of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_size, cut, map_arrow, new_path, remove, small_batches
from .tokens import encoder

MEAN, LEAST, MOST = 512, 64, 4096


def _mixed(ids: np.ndarray) -> np.ndarray:
    x = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA77)
    return (x ^ (x >> np.uint32(13))).astype(np.uint16)


def _low(ids: np.ndarray, lengths: list[int]) -> list[list[int]]:
    """Ends at a low hash of each of the streams of these lengths, which ids holds one after another."""
    x = _mixed(ids)
    # Zeros before each stream: its hashes see nothing of the one before.
    starts = np.cumsum([16, *(n + 16 for n in lengths)])[:-1]
    h, at = np.zeros(len(ids) + 16 * len(lengths), np.uint16), 0
    for a, n in zip(starts.tolist(), lengths, strict=True):
        h[a : a + n] = x[at : at + n]
        at += n
    for width in (1, 2, 4, 8):
        h[width:] = h[width:] + (h[:-width] << np.uint16(width))
    low = np.flatnonzero(h < (1 << 16) // MEAN)
    first, last = np.searchsorted(low, starts).tolist(), np.searchsorted(low, starts + lengths).tolist()
    return [(low[i:j] + (1 - a)).tolist() for i, j, a in zip(first, last, starts.tolist(), strict=True)]


def cuts(ids: np.ndarray, lengths: list[int]) -> Iterator[list[int]]:
    """Ends of the chunks of each stream: after LEAST ids at least, at a low hash, or after MOST."""
    for n, low in zip(lengths, _low(ids, lengths), strict=True):
        out, at = [], 0
        for c in [*low, n]:
            while c - at > MOST:
                at += MOST
                out.append(at)
            if c - at >= LEAST or c == n and c > at:
                out.append(c)
                at = c
        yield out


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(leaves: Iterable[bytes]) -> bytes:
    """Root over leaves in order, of which a few are held at a time: equal subtrees are joined as soon as they are full."""
    peaks: list[tuple[int, bytes]] = []
    for leaf in leaves:
        level, node = 0, hashlib.sha256(b"\0" + leaf).digest()
        while peaks and peaks[-1][0] == level:
            node = hashlib.sha256(b"\1" + peaks.pop()[1] + node).digest()
            level += 1
        peaks.append((level, node))
    node = b""
    for _, peak in reversed(peaks):
        node = hashlib.sha256(b"\2" + peak + node).digest()
    return node or hashlib.sha256(b"").digest()


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    spark = docs.sparkSession
    width, end = 2 if max(encoder(tokenizer).largest, end_id) < 1 << 16 else 4, end_id.to_bytes(4, "little")

    def encode(x: dict) -> Iterator[dict]:
        out: dict[str, list] = {"home": x["home"], "doc_id": x["doc_id"], "n_tokens": [], "root": [], "digests": [], "chunks": []}
        raw = [r + end for r in encoder(tokenizer).encode(x["text"])]
        ids, at = np.frombuffer(b"".join(raw), "<u4"), 0
        data, out["n_tokens"] = ids.astype(f"<u{width}").tobytes(), [len(r) // 4 for r in raw]
        for n, ends in zip(out["n_tokens"], cuts(ids, out["n_tokens"]), strict=True):
            chunks = [data[width * (at + a) : width * (at + b)] for a, b in zip([0, *ends], ends, strict=False)]
            names = [digest(c) for c in chunks]
            out["root"].append(hashlib.sha256(b"".join(names)).digest())
            out["digests"].append(names)
            out["chunks"].append(chunks)
            at += n
        yield out

    staged_path = new_path(spark, "staged")
    numbered = docs.select(F.monotonically_increasing_id().alias("home"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    staged = map_arrow(numbered, "home long, doc_id long, n_tokens long, root binary, digests array<binary>, chunks array<binary>", encode, 64)
    staged.write.option("compression", "zstd").parquet(staged_path)
    staged = spark.read.schema(staged.schema).parquet(staged_path)

    one = staged.select("home", F.explode(F.arrays_zip("digests", "chunks")).alias("c")).select("home", F.col("c.digests").alias("digest"), F.col("c.chunks").alias("data"))
    # Most chunks stand once: only those that don't are shuffled, if the others can be told from a table of bounded size.
    twice = staged.select(F.explode("digests").alias("digest")).groupBy("digest").count().where("count > 1").select("digest")
    twice = by_size(cut(spark, twice, "twice"), 500_000)
    one.join(twice, "digest", "left_anti").select("home", "digest", "data").write.option("compression", "zstd").parquet(f"{path}/own")
    one.join(twice, "digest", "left_semi").select("digest", "data").dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{path}/chunks")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, row, part = 0, 0, TaskContext.get().partitionId()
        for b in batches:
            n = b.column("n_tokens").to_pylist()
            starts = [start, *accumulate(n, initial=start)][1:]
            yield pa.RecordBatch.from_pydict({"part": pa.array([part] * len(n), pa.int32()), "row": pa.array(range(row, row + len(n)), pa.int64()), "doc_id": b.column("doc_id"), "home": b.column("home"), "local_start": pa.array(starts[:-1], pa.int64()), "n_tokens": b.column("n_tokens"), "root": b.column("root"), "digests": b.column("digests")})
            start, row = starts[-1], row + len(n)

    small = staged.select("doc_id", "home", "n_tokens", "root", "digests")
    ordered = small.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root")
    ordered.mapInArrow(number, "part int, row long, doc_id long, home long, local_start long, n_tokens long, root binary, digests array<binary>").write.option("compression", "zstd").parquet(f"{path}/recipes")
    summary(spark, path).coalesce(1).write.parquet(f"{path}/manifest")
    remove(spark, staged_path)
    manifest = _manifest(spark, path)
    head = [(width, len(manifest), sum(r.n_docs for r in manifest), sum(r.n_tokens for r in manifest), _root(manifest), *_chunk_sum(spark, path))]
    spark.createDataFrame(head, "width int, n_parts int, n_docs long, n_tokens long, root binary, n_chunks long, chunk_sum decimal(38,0)").write.parquet(f"{path}/head")


def summary(spark: SparkSession, path: str) -> DataFrame:
    """What the recipes say of each part: its counts and the Merkle root of its documents, taken in order of row."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("part", "row", "doc_id", "home", "local_start", "n_tokens", "root")), strict=True)

        out: dict[str, list] = {"part": [], "n_docs": [], "n_tokens": [], "root": []}
        todo = rows()
        ahead = next(todo, None)
        while ahead is not None:
            part, n_docs, n_tokens = ahead[0], 0, 0

            def leaves() -> Iterator[bytes]:
                nonlocal ahead, n_docs, n_tokens
                while ahead is not None and ahead[0] == part:
                    _, row, doc_id, home, start, n, root = ahead
                    yield f"{row},{doc_id},{home},{start},{n},".encode() + root
                    n_docs, n_tokens = n_docs + 1, n_tokens + n
                    ahead = next(todo, None)

            root = merkle(leaves())
            for k, v in zip(out, (part, n_docs, n_tokens, root), strict=True):
                out[k].append(v)
        yield pa.RecordBatch.from_pydict({"part": pa.array(out["part"], pa.int32()), "n_docs": pa.array(out["n_docs"], pa.int64()), "n_tokens": pa.array(out["n_tokens"], pa.int64()), "root": pa.array(out["root"], pa.binary())})

    recipes = spark.read.parquet(f"{path}/recipes").select("part", "row", "doc_id", "home", "local_start", "n_tokens", "root")
    return recipes.repartition("part").sortWithinPartitions("part", "row").mapInArrow(f, "part int, n_docs long, n_tokens long, root binary")


def _manifest(spark: SparkSession, path: str) -> list:
    """A row a part, so small beside the recipes."""
    return spark.read.parquet(f"{path}/manifest").orderBy("part").collect()


def _root(manifest: list) -> bytes:
    return merkle(f"{r.part},{r.n_docs},{r.n_tokens},".encode() + bytes(r.root) for r in manifest)


def _chunk_sum(spark: SparkSession, path: str) -> tuple:
    """Number of stored chunks, and the sum of their digests' hashes."""
    hashed = F.coalesce(F.sum(F.xxhash64("digest").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    digests = [spark.read.parquet(f"{path}/{table}").select("digest") for table in ("chunks", "own")]
    return tuple(digests[0].unionAll(digests[1]).agg(F.count("*"), hashed).first())


def verified(spark: SparkSession, path: str) -> tuple[int, list]:
    """The id width and the manifest, once head, manifest and recipes agree; an error otherwise."""
    heads, manifest = spark.read.parquet(f"{path}/head").collect(), _manifest(spark, path)
    told = (len(manifest), sum(r.n_docs for r in manifest), sum(r.n_tokens for r in manifest), _root(manifest))
    if len(heads) != 1 or tuple(heads[0])[1:4] != told[:3] or bytes(heads[0].root) != told[3]:
        raise ValueError("the store's manifest is damaged: it differs from the head")
    if _chunk_sum(spark, path) != tuple(heads[0])[5:7]:
        raise ValueError("the store's chunks are damaged: some are lost, doubled or in excess")
    kept = spark.createDataFrame(manifest, "part int, n_docs long, n_tokens long, root binary")
    found = summary(spark, path).withColumnsRenamed({c: f"_{c}" for c in ("n_docs", "n_tokens", "root")})
    same = F.col("n_docs").eqNullSafe(F.col("_n_docs")) & F.col("n_tokens").eqNullSafe(F.col("_n_tokens")) & F.col("root").eqNullSafe(F.col("_root"))
    bad = [r.part for r in found.join(F.broadcast(kept), "part", "full_outer").where(~same).select("part").take(10)]
    if bad:
        raise ValueError(f"the store's recipes are damaged: parts {bad} differ from the manifest")
    return heads[0].width, manifest


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit), in no order; verified."""
    width, manifest = verified(spark, path)
    base = list(accumulate((r.n_tokens for r in manifest), initial=0))
    starts = spark.createDataFrame([(r.part, b) for r, b in zip(manifest, base, strict=False)], "part int, base long")
    recipes, own = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/own")
    # A chunk that stands in one place goes to its document at once; only the others are looked up by digest.
    asked = recipes.select("home", F.explode(F.array_distinct("digests")).alias("digest"))
    shared = asked.join(spark.read.parquet(f"{path}/chunks"), "digest").select("home", "digest", "data")
    told = recipes.select("home", F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("binary").alias("data"), F.struct("part", "doc_id", "local_start", "n_tokens", "root", "digests").alias("told"))
    pieces = own.select("home", "digest", "data").unionAll(shared).withColumn("told", F.lit(None).cast(told.schema["told"].dataType))
    rows = small_batches(told.unionAll(pieces).repartition("home").sortWithinPartitions("home"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document, once its rows, which stand together, are past."""
        done: list[tuple] = []
        begun, at, recipe, found = False, None, None, {}

        def close() -> None:
            if recipe is None or any(n not in found for n in recipe["digests"]) or any(digest(c) != n for n, c in found.items()) or hashlib.sha256(b"".join(recipe["digests"])).digest() != recipe["root"]:
                raise ValueError("a chunk or recipe of the store is damaged")
            ids = np.frombuffer(b"".join([found[n] for n in recipe["digests"]]), f"<u{width}")
            if len(ids) != recipe["n_tokens"]:
                raise ValueError("a document of the store has another length than its recipe says")
            done.append((recipe["part"], recipe["doc_id"], recipe["local_start"], recipe["n_tokens"], ids.astype("<u4").tobytes()))

        def made() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * 5
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "doc_id", "local_start", "n_tokens", "ids"])

        for b in batches:
            for home, name, data, one in zip(*(b.column(c).to_pylist() for c in ("home", "digest", "data", "told")), strict=True):
                if not begun or home != at:
                    if begun:
                        close()
                    begun, at, recipe, found = True, home, None, {}
                if one is None:
                    found[name] = data
                elif recipe is None:
                    recipe = one
                else:
                    raise ValueError("the store's recipes are damaged: two have the same home")
            yield made()
        if begun:
            close()
            yield made()
        pa.default_memory_pool().release_unused()  # the worker stays for other tasks

    whole = rows.mapInArrow(joined, "part int, doc_id long, local_start long, n_tokens long, ids binary")
    return whole.join(F.broadcast(starts), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")
