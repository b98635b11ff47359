"""Cost-balanced packing of documents into token sequences.

Each task packs its own documents, in groups of bounded size, so nothing is shuffled and no group is unbounded. In a
group, whole sequences are cut off documents longer than one; the rest are taken in descending order, and each goes to
the sequence of the lowest estimated cost (linear plus quadratic in each piece, as attention is) of all that have room
for it. A rest that fits nowhere whole is cut over the emptiest sequences. The last tokens of a group fill sequences
of powers of two, which need no padding.

Null texts count as empty: such a document is its end id alone. Repeated rows and null doc_ids are packed as they are,
each row a document; doc_id keeps its type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import small_batches
from .tokens import encoder

LINEAR, QUADRATIC = 1.0, 1.0 / 1024


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def plan(lengths: list[int], size: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for all tokens of documents of these lengths.

    Every sequence but the last few is full or nearly so; sequences count from 0.
    """
    out: list[tuple[int, int, int, int, int]] = []
    n_seq, rests = 0, []
    for d, n in enumerate(lengths):
        whole = n // size
        for k in range(whole):
            out.append((d, k * size, size, n_seq, 0))
            n_seq += 1
        if n % size:
            rests.append((n % size, d, whole * size))
    left = sum(n for n, _, _ in rests)
    room = [size] * (left // size)
    for b in reversed(range(size.bit_length())):  # the tail in powers of two
        if left % size >> b & 1:
            room.append(1 << b)
    free, spent, first = np.array(room, np.int64), np.zeros(len(room)), n_seq
    fill = [0] * len(room)

    def put(s: int, d: int, start: int, n: int) -> None:
        out.append((d, start, n, first + s, fill[s]))
        fill[s] += n
        free[s] -= n
        spent[s] += cost(n)

    for n, d, start in sorted(rests, key=lambda x: (-x[0], x[1])):
        s = int(np.argmin(np.where(free >= n, spent, np.inf)))
        if free[s] >= n:
            put(s, d, start, n)
            continue
        while n:  # it fits nowhere whole: cut over the emptiest
            s = int(np.argmax(free))
            take = min(n, int(free[s]))
            put(s, d, start, take)
            start, n = start + take, n - take
    return out


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, group_tokens: int = 1 << 21) -> DataFrame:
    """Per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit)."""
    end = np.array([end_id], "<u4").tobytes()
    longs = ("start", "length", "doc_tokens", "sequence_id", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        base = TaskContext.get().partitionId() << 36  # sequences of one task stay apart from those of others
        held: list[tuple[object, bytes]] = []
        tokens, kind = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, tokens, base
            made = plan([len(x) // 4 for _, x in held], size)
            for at in range(0, len(made), 4096):
                some = made[at : at + 4096]
                columns = {"doc_id": pa.array([held[d][0] for d, *_ in some], kind)}
                values = ([s for _, s, *_ in some], [n for _, _, n, *_ in some], [len(held[d][1]) // 4 for d, *_ in some], [base + q for *_, q, _ in some], [o for *_, o in some])
                columns |= {k: pa.array(v, pa.int64()) for k, v in zip(longs, values, strict=True)}
                yield pa.RecordBatch.from_pydict(columns | {"ids": pa.array([held[d][1][4 * s : 4 * (s + n)] for d, s, n, *_ in some], pa.binary())})
            base += 1 + max((x[3] for x in made), default=-1)
            held, tokens = [], 0

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64).to_pydict()
                for d, ids in zip(part["doc_id"], code.encode(part["text"]), strict=True):
                    held.append((d, ids + end))
                    tokens += len(ids) // 4 + 1
                if tokens >= group_tokens:
                    yield from flush()
        if held:
            yield from flush()

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{k} long' for k in longs)}, ids binary")
