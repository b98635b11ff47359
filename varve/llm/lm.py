"""Masked pseudo-likelihood: a window network predicts every word from the words on both sides of it.

Corpus counts over all documents give the vocabulary: the ``VOCABULARY`` most frequent words have ids of their own, all
rarer ones fall in ``BUCKETS`` hashed ids; q is an id's share of the corpus. A hidden layer h sees the embeddings of two
words to the left and two to the right, never the word itself, and each id w has an output vector v and bias b of its own:

    log p(w | both sides) = log q(w) + h.v(w) + b(w) - log Z,    Z = sum over all ids of q exp(h.v + b).

Training is noise-contrastive (each position against ``NOISE`` ids drawn from q for its batch), which needs no Z. Scoring
estimates Z from the ``HEAD`` most frequent ids, exactly, and a fixed stratified sample of ``TAIL`` of the others, which
stand for equal shares of the rest. The words of one hashed id share its probability equally.

Every position of every document is a target once. Documents are dealt to shards by a hash of doc_id and text, each of
about ``SHARD`` words, and sorted in them, so the result does not depend on how the input is partitioned. Each shard
fits the network from the same start; the shards' changes are averaged in a tree, ``FAN`` to one, a word's vectors weighted
by its occurrences in the shard. A network travels in ``PIECES`` by ranges of ids, averaged apart, so no row is wide. So what is counted, trained and averaged grows with the corpus; only the bounded
weights and vocabulary reach the driver.

Null, empty and wordless texts have no words: their sum is 0 and their mean null. Repeated rows score alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, small_batches
from .decontaminate import words_of

VOCABULARY, BUCKETS = 16_384, 4_096
WIDTH, HIDDEN, SIDE = 16, 32, 2
NOISE, HEAD, TAIL = 64, 64, 64
SHARD, MOST_SHARDS, FAN, PIECES = 3_000_000, 20_000, 16, 16
RATE, BATCH = 0.1, 2048


@dataclass
class Vocabulary:
    """ids: 64-bit hash of a word -> id from 1 on; 0 stands beyond a text's ends, the last BUCKETS ids are of rare words.
    share: q of each id, log_in: log of a word's part of its id, total: words of the corpus; support and its log_weight: the ids that estimate Z."""

    ids: dict[int, int]
    share: np.ndarray
    log_in: np.ndarray
    total: int
    support: np.ndarray
    log_weight: np.ndarray
    words: dict[bytes, int] | None = None

    def encode(self, words: list[bytes]) -> np.ndarray:
        if self.words is None:
            self.words = {}
        memo = self.words
        if len(memo) > 300_000:
            memo.clear()
        rare = len(self.share) - BUCKETS
        for w in set(words).difference(memo):
            h = _hash(w)
            memo[w] = self.ids.get(h) or rare + h % BUCKETS
        return np.fromiter(map(memo.__getitem__, words), np.int32, len(words))


def _hash(word: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def vocabulary(docs: DataFrame, most: int = VOCABULARY) -> Vocabulary:
    def count(x: dict) -> Iterator[dict]:
        seen: Counter = Counter()
        for t in x["text"]:
            seen.update(words_of(t))
        yield {"word": list(map(_hash, seen)), "n": list(seen.values())}

    counts = cut(docs.sparkSession, map_arrow(docs.select("text"), "word long, n long", count, 1024).groupBy("word").agg(F.sum("n").alias("n")), "counts")
    top = counts.orderBy(F.desc("n"), "word").limit(most).collect()  # the vocabulary's bound
    rare_n, rare_types = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.groupBy(F.pmod("word", F.lit(BUCKETS)).alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect():  # a row a bucket
        rare_n[r.k], rare_types[r.k] = r.n, r.types
    total = int(rare_n.sum())
    for r in top:
        rare_n[r.word % BUCKETS] -= r.n
        rare_types[r.word % BUCKETS] -= 1
    n = np.array([0, *(r.n for r in top), *np.maximum(rare_n, 1)], float)
    log_in = np.zeros(len(n))
    log_in[1 + len(top) :] = -np.log(np.maximum(rare_types, 1))
    return Vocabulary({r.word: i for i, r in enumerate(top, 1)}, n / n.sum(), log_in, total, *_support(n / n.sum()))


def _support(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The HEAD likeliest ids with their shares, and ids at TAIL even steps of the others' cumulative share."""
    order = np.argsort(-q, kind="stable")[: np.count_nonzero(q)]
    head, rest = order[:HEAD], order[HEAD:]
    if not len(rest):
        return head, np.log(q[head])
    steps = np.cumsum(q[rest])
    tail = rest[np.minimum(np.searchsorted(steps, (np.arange(TAIL) + 0.5) / TAIL * steps[-1]), len(rest) - 1)]
    return np.concatenate((head, tail)), np.log(np.concatenate((q[head], np.full(TAIL, steps[-1] / TAIL))))


def initial(n_ids: int) -> list[np.ndarray]:
    """Embeddings, hidden layer and its bias, output vectors with their bias last."""
    g = np.random.default_rng(11)
    return [x.astype(np.float32) for x in (g.normal(0, 0.1, (n_ids, WIDTH)), g.normal(0, (2 * SIDE * WIDTH) ** -0.5, (2 * SIDE * WIDTH, HIDDEN)), np.zeros(HIDDEN), np.zeros((n_ids, HIDDEN + 1)))]


def squares(net: list[np.ndarray], start: float = 1e-8) -> list[np.ndarray]:
    """Sums of squared gradients."""
    return [np.full_like(p, start) for p in net]


def contexts(ids: np.ndarray) -> np.ndarray:
    """Per word the ids of its neighbours, SIDE to the left and SIDE to the right."""
    padded = np.concatenate((np.zeros(SIDE, np.int32), ids, np.zeros(SIDE, np.int32)))
    return np.stack([padded[k : k + len(ids)] for k in range(2 * SIDE + 1) if k != SIDE], axis=1)


def hidden(net: list[np.ndarray], context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The embeddings side by side, and the hidden layer with 1 appended."""
    e, u, a, _ = net
    x = e[context].reshape(len(context), -1)
    h = np.ones((len(x), HIDDEN + 1), x.dtype)
    np.tanh(x @ u + a, out=h[:, :HIDDEN])
    return x, h


def _spread(p: np.ndarray, square: np.ndarray, spots: np.ndarray, grads: np.ndarray) -> None:
    """An Adagrad step on the rows of p at spots, whose gradients are summed where they repeat."""
    order = np.argsort(spots.astype(np.uint16) if len(p) < 1 << 16 else spots, kind="stable")
    held = spots[order]
    first = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1])))
    g, at = np.add.reduceat(grads[order], first, axis=0), held[first]
    rate = square[at]
    rate += g * g
    square[at] = rate
    np.sqrt(rate, out=rate)
    rate += 1e-6
    g /= rate
    g *= RATE
    p[at] -= g


def _margins(net: list[np.ndarray], context: np.ndarray, ids: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, ...]:
    """x, the hidden layer, the output vectors of ids and noise, and the log-odds that each is the word rather than noise."""
    x, h = hidden(net, context)
    own, others = net[3][ids], net[3][noise]
    shift = np.float32(np.log(len(noise)))
    return x, h, own, others, np.einsum("ij,ij->i", h, own) - shift, h @ others.T - shift


def loss(net: list[np.ndarray], context: np.ndarray, ids: np.ndarray, noise: np.ndarray) -> float:
    """Mean noise-contrastive loss of telling each id from the noise ids."""
    *_, good, bad = _margins(net, context, ids, noise)
    return float(np.logaddexp(0, -good).mean() + np.logaddexp(0, bad).sum() / len(ids))


def step(net: list[np.ndarray], square: list[np.ndarray], context: np.ndarray, ids: np.ndarray, noise: np.ndarray) -> None:
    """One Adagrad step on the loss."""
    e, u, _, v = net
    x, h, own, others, good, bad = _margins(net, context, ids, noise)
    n = np.float32(len(ids))
    up = -1 / (n + n * np.exp(good))
    down = np.exp(np.negative(bad, out=bad), out=bad)
    down += 1
    down *= n
    np.reciprocal(down, out=down)
    d = (up[:, None] * own + down @ others)[:, :HIDDEN]
    d *= 1 - h[:, :HIDDEN] ** 2
    _spread(v, square[3], np.concatenate((ids, noise)), np.concatenate((up[:, None] * h, down.T @ h)))
    dx = (d @ u.T).reshape(-1, WIDTH)
    for k, g in ((1, x.T @ d), (2, d.sum(0))):
        square[k] += g * g
        net[k] -= RATE * g / (np.sqrt(square[k]) + 1e-6)
    _spread(e, square[0], context.ravel(), dx)


def train(docs: DataFrame, vocab: Vocabulary, shard: int = SHARD) -> list[np.ndarray]:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocab)
    n_ids = len(vocab.share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, g = shared.value, np.random.default_rng(17)
        steps = np.cumsum(v.share)
        net, seen = initial(n_ids), np.zeros(n_ids)
        square = squares(net)
        held: list[np.ndarray] = []
        n = 0

        def fit(least: int) -> None:
            nonlocal held, n
            flat = np.concatenate(held)
            c, at = contexts(flat), 0
            real = np.flatnonzero(flat)  # texts are set apart by empty places
            while len(real) - at >= least and at < len(real):
                some = real[at : at + BATCH]
                step(net, square, c[some], flat[some], np.searchsorted(steps, g.random(NOISE) * steps[-1]))
                at += len(some)
            seen[:] += np.bincount(flat[real[:at]], minlength=n_ids)
            left = real[at] - SIDE if at < len(real) else len(flat)
            held, n = [flat[max(0, left) :]], len(real) - at

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if words := words_of(text):
                    held += [v.encode(words), np.zeros(SIDE, np.int32)]
                    n += len(words)
                if n >= 8 * BATCH:
                    fit(BATCH)
        if n:
            fit(1)
        if seen.any():
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()] * PIECES, "piece": list(range(PIECES)), "net": _pack(net, seen)})

    n = min(MOST_SHARDS, max(1, -(-vocab.total // shard)))
    dealt = docs.select("text", F.xxhash64("doc_id", "text").alias("k")).repartition(n, "k").sortWithinPartitions("k", "text").select("text")
    schema = "part long, piece long, net binary"
    nets = cut(spark, small_batches(dealt).mapInArrow(run, schema), "networks")

    def mean(table: pa.Table) -> pa.Table:
        piece, sums, weights, all_seen, all_total = table["piece"][0].as_py(), None, None, 0.0, 0.0
        for _, raw in sorted(zip(table["part"].to_pylist(), table["net"].to_pylist(), strict=True)):  # at most FAN
            change, seen, total = _unpack(raw, piece, n_ids)
            w = _weights(seen, total, piece)
            part = [c * x for c, x in zip(change, w, strict=True)]
            sums = part if sums is None else [x + y for x, y in zip(sums, part, strict=True)]
            weights = w if weights is None else [x + y for x, y in zip(weights, w, strict=True)]
            all_seen, all_total = all_seen + seen, all_total + total
        change = [x / np.maximum(w, 1) for x, w in zip(sums, weights, strict=True)]
        return pa.table({"part": [table["part"][0].as_py() // FAN], "piece": [piece], "net": [_packed(change, all_seen, all_total)]})

    while nets.count() > PIECES:
        nets = cut(spark, nets.groupBy(F.floor(F.col("part") / FAN).alias("g"), "piece").applyInArrow(mean, schema), "networks")
    net = initial(n_ids)
    for row in nets.collect():  # one network
        at = slice(*_range(row.piece, n_ids))
        for p, c in zip((net[0][at], net[1], net[2], net[3][at]), _unpack(row.net, row.piece, n_ids)[0], strict=True):
            if c.size:
                p += c.astype(np.float32)
    return net


def _range(piece: int, n_ids: int) -> tuple[int, int]:
    """First id of a piece, and of the next."""
    return piece * n_ids // PIECES, (piece + 1) * n_ids // PIECES


def _weights(seen: np.ndarray, total: float, piece: int) -> list:
    """Of each part of a piece in an average; what is beyond a text's ends (id 0) is met in each shard."""
    rows = seen.copy()
    if piece == 0 and len(rows):
        rows[0] = total
    return [rows[:, None], total, total, rows[:, None]]


def _packed(change: list[np.ndarray], seen: np.ndarray, total: float) -> bytes:
    return np.float64(total).tobytes() + seen.astype("<f4").tobytes() + b"".join(c.astype("<f2").tobytes() for c in change)


def _pack(net: list[np.ndarray], seen: np.ndarray) -> list[bytes]:
    """The pieces of what training has changed, zero for words not met, and how often each id was a target. The first has
    the hidden layer."""
    e, u, a, v = (p - q for p, q in zip(net, initial(len(seen)), strict=True))
    out = []
    for piece in range(PIECES):
        at = slice(*_range(piece, len(seen)))
        met = _weights(seen[at], seen.sum(), piece)[0] > 0
        out.append(_packed([e[at] * met, *((u, a) if piece == 0 else (u[:0], a[:0])), v[at] * met], seen[at], seen.sum()))
    return out


def _unpack(raw: bytes, piece: int, n_ids: int) -> tuple[list[np.ndarray], np.ndarray, float]:
    first, end = _range(piece, n_ids)
    n, hidden_rows = end - first, 2 * SIDE * WIDTH if piece == 0 else 0
    seen = np.frombuffer(raw, "<f4", n, 8).astype(np.float64)
    flat, out = np.frombuffer(raw, "<f2", offset=8 + 4 * n), []
    for shape in ((n, WIDTH), (hidden_rows, HIDDEN), (HIDDEN if piece == 0 else 0,), (n, HIDDEN + 1)):
        size = int(np.prod(shape))
        out.append(flat[:size].reshape(shape).astype(np.float64))
        flat = flat[size:]
    return out, seen, float(np.frombuffer(raw, "<f8", 1)[0])


def conditional(vocab: Vocabulary, net: list[np.ndarray], context: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """log p of each id between its neighbours, as a word of it has."""
    _, h = hidden(net, context)
    v = net[3]
    z = h @ v[vocab.support].T + vocab.log_weight.astype(np.float32)
    top = z.max(axis=1)
    log_z = np.log(np.exp(z - top[:, None]).sum(axis=1)) + top
    return np.log(np.maximum(vocab.share[ids], 1e-300)) + np.einsum("ij,ij->i", h, v[ids]) - log_z + vocab.log_in[ids]


def log_probabilities(vocab: Vocabulary, net: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
    """Of every word given its neighbours."""
    out, c = np.empty(len(ids)), contexts(ids)
    for at in range(0, len(ids), 2048):
        out[at : at + 2048] = conditional(vocab, net, c[at : at + 2048], ids[at : at + 2048])
    return out


def score(docs: DataFrame, vocab: Vocabulary, net: list[np.ndarray]) -> DataFrame:
    """Per row: doc_id, n_words, sum_log_prob, mean_log_prob."""
    shared = docs.sparkSession.sparkContext.broadcast((vocab, net))

    def f(x: dict) -> Iterator[dict]:
        v, net = shared.value
        ids = [v.encode(words_of(t)) for t in x["text"]]
        # The texts of a batch in one array, their ends apart by SIDE empty places: few large products.
        gap = np.zeros(SIDE, np.int32)
        flat = np.concatenate([y for i in ids for y in (i, gap)]) if ids else gap
        p = log_probabilities(v, net, flat)
        n, sums, at = [len(i) for i in ids], [], 0
        for k in n:
            sums.append(float(p[at : at + k].sum()))
            at += k + SIDE
        yield {"doc_id": x["doc_id"], "n_words": n, "sum_log_prob": sums, "mean_log_prob": [s / k if k else None for s, k in zip(sums, n, strict=True)]}

    return map_arrow(docs.select("doc_id", "text"), "doc_id long, n_words long, sum_log_prob double, mean_log_prob double", f, 128)
