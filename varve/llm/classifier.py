"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its words, hashed into ``BUCKETS`` with weights 1 + ln(count) of length 1 together, and one of ``BINS`` for
each structure statistic (of characters, words, lines and repeats) and for the table's n_chars, where it has that column. The score is the
logistic of w0 + sum of w_i x_i + sum over pairs of <v_i, v_j> x_i x_j, with vectors of ``RANK`` numbers. The pairs are never
made: their sum is half of (sum of v_i x_i)^2 - sum of (v_i x_i)^2, so a score takes time linear in the text's distinct words.

It is fitted on at most ``MAX_EXAMPLES`` labelled rows, a hash sample by doc_id, by AdaGrad steps in numpy, with weights averaged over the last
half of the steps; bins end at the sample's quantiles. Rows without a label, a doc_id or a document give no example. A doc_id labelled twice is
of quality if all its labels say so; of the texts that share a doc_id the least is the example. Without examples every score is 0.5.
Null and empty texts have no words and the lowest bins. Every row of docs gets a score, repeated ones the same.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow

MAX_EXAMPLES, BUCKETS, BINS, RANK = 6144, 1 << 14, 16, 8
EPOCHS, BATCH, RATE, PENALTY = 16, 64, 0.05, 2e-4
SYMBOLS = "#*$%&|<>"
_WORD = re.compile(r"[^\W_]+")
STATISTICS = ("chars", "words", "word_chars", "symbols", "marks", "shouts", "digits", "capitals", "distinct", "repeats", "same_lines", "line_words", "commonest", "short", "ends", "stutter")
#: Statistics, then n_chars and how far it is from the text's own length.
N_BINNED = len(STATISTICS) + 2


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    """In the order of STATISTICS."""
    plain = text.split()
    n, chars, lines = max(1, len(plain)), max(1, len(text)), [x for x in text.split("\n") if x.strip()]
    letters = sum(map(len, words))
    threes = set(zip(words, words[1:], words[2:], strict=False))
    return [
        np.log2(chars),
        np.log2(n),
        sum(map(len, plain)) / n,
        sum(map(text.count, SYMBOLS)) / n,
        (chars - letters - text.count(" ") - text.count("\n")) / chars,
        text.count("!") / n,
        sum(map(text.count, "0123456789")) / chars,
        sum(w.isupper() for w in plain) / n,
        len(counts) / max(1, len(words)),
        1 - len(threes) / max(1, len(words) - 2) if len(words) > 2 else 0.0,
        1 - len(set(lines)) / max(1, len(lines)) if lines else 0.0,
        np.log2(1 + len(plain) / max(1, len(lines))),
        max(counts.values(), default=0) / max(1, len(words)),
        sum(len(w) <= 3 for w in plain) / n,
        sum(map(text.count, ".?;:,")) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, len(words)),
    ]


_hashed: dict[str, int] = {}


def features(text: str | None, n_chars: int | None) -> tuple[list[int], list[float], list[float]]:
    """Buckets of words and their weights, and the values to be binned."""
    text = text or ""
    words = _WORD.findall(text)
    counts = Counter(map(str.lower, words))
    if len(_hashed) > 200_000:
        _hashed.clear()
    held: dict[int, float] = {}
    for w, c in counts.items():
        at = _hashed.get(w)
        if at is None:
            at = _hashed[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS
        held[at] = held.get(at, 0.0) + c
    weights = 1 + np.log(np.fromiter(held.values(), float, len(held)))
    norm = float(np.linalg.norm(weights)) or 1.0
    known = n_chars is not None
    told = [float(np.log2(1 + max(0, n_chars))) if known else -1.0, float(abs(n_chars - len(text)) / (1 + len(text))) if known else -1.0]
    return list(held), (weights / norm).tolist(), [float(v) for v in statistics(text, words, counts)] + told


@dataclass
class Machine:
    edges: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def rows(self, made: list[tuple[list[int], list[float], list[float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature numbers and values of all texts, and where each text's begin. Bins come first in each."""
        index, value, begins = [], [], [0]
        for words, weights, stats in made:
            bins = BUCKETS + np.arange(N_BINNED) * BINS + (self.edges < np.array(stats)[:, None]).sum(axis=1)
            index += [bins, np.array(words, np.int64)]
            value += [np.full(N_BINNED, N_BINNED**-0.5), np.array(weights)]
            begins.append(begins[-1] + N_BINNED + len(words))
        return np.concatenate(index), np.concatenate(value), np.array(begins[:-1])

    def margin(self, index: np.ndarray, value: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: the logit, and the sum of its features' vectors."""
        x = self.factors[index] * value[:, None]
        sums = np.add.reduceat(x, begins)
        pairs = 0.5 * ((sums**2).sum(axis=1) - np.add.reduceat((x**2).sum(axis=1), begins))
        return self.bias + np.add.reduceat(self.linear[index] * value, begins) + pairs, sums

    def scores(self, made: list) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(*self.rows(made))[0], -30, 30))) if made else np.zeros(0)


def train(made: list[tuple], labels: np.ndarray, seed: int = 0) -> Machine:
    rng, size = np.random.default_rng(seed), BUCKETS + N_BINNED * BINS
    machine = Machine(np.zeros((N_BINNED, BINS - 1)), 0.0, np.zeros(size), rng.normal(0, 0.05, (size, RANK)))
    if not len(labels):
        machine.factors[:] = 0
        return machine
    stats = np.array([m[2] for m in made])
    machine.edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
    share = (labels.sum() + 1) / (len(labels) + 2)
    machine.bias = float(np.log(share / (1 - share)))
    index, value, begins = machine.rows(made)
    ends = np.append(begins[1:], len(index))
    g_linear, g_factors, g_bias = np.full(size, 1e-6), np.full((size, RANK), 1e-6), 1e-6
    mean, taken = [0.0, np.zeros(size), np.zeros((size, RANK))], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            lengths = ends[some] - begins[some]
            first = np.cumsum(lengths) - lengths
            spot = np.arange(lengths.sum()) + np.repeat(begins[some] - first, lengths)
            i, x = index[spot], value[spot]
            logit, sums = machine.margin(i, x, first)
            miss = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[some]) / len(some)
            each = np.repeat(miss, lengths) * x
            used, where = np.unique(i, return_inverse=True)
            d_linear = np.bincount(where, each, len(used)) + PENALTY * machine.linear[used]
            v = machine.factors[i]
            slope = each[:, None] * (np.repeat(sums, lengths, axis=0) - v * x[:, None])
            d_factors = np.stack([np.bincount(where, slope[:, r], len(used)) for r in range(RANK)], axis=1) + PENALTY * machine.factors[used]
            g_linear[used] += d_linear**2
            g_factors[used] += d_factors**2
            g_bias += miss.sum() ** 2
            machine.linear[used] -= 4 * RATE * d_linear / np.sqrt(g_linear[used])
            machine.factors[used] -= RATE * d_factors / np.sqrt(g_factors[used])
            machine.bias -= RATE * miss.sum() / g_bias**0.5
        if 2 * epoch >= EPOCHS:
            taken += 1
            for k, now in enumerate((machine.bias, machine.linear, machine.factors)):
                mean[k] = mean[k] + (now - mean[k]) / taken
    machine.bias, machine.linear, machine.factors = float(mean[0]), mean[1], mean[2]
    return machine


def _texts(docs: DataFrame) -> DataFrame:
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select("doc_id", "text", n_chars.alias("n_chars"))


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> Machine:
    """labels: doc_id and quality, of the rows that may be learnt from."""
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)  # the sample's documented bound
    texts = _texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct("text", "n_chars")).alias("x"))

    def f(x: dict) -> Iterator[dict]:
        made = [features(t, n) for t, n in zip(x["text"], x["n_chars"], strict=True)]
        yield {"doc_id": x["doc_id"], "quality": [int(bool(y)) for y in x["quality"]], "words": [m[0] for m in made], "weights": [m[1] for m in made], "stats": [m[2] for m in made]}

    found = map_arrow(texts.select("doc_id", "quality", "x.text", "x.n_chars"), "doc_id long, quality int, words array<int>, weights array<double>, stats array<double>", f)
    rows = [(r.quality, (np.array(r.words, np.int64), np.array(r.weights), r.stats)) for r in cut(docs.sparkSession, found, "examples").orderBy("doc_id").toLocalIterator()]  # bounded by max_examples
    return train([m for _, m in rows], np.array([y for y, _ in rows], float))


def score(docs: DataFrame, machine: Machine, least: float = 0.3) -> DataFrame:
    """Per row: doc_id, score and predicted (score >= least)."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def f(x: dict) -> Iterator[dict]:
        got = shared.value.scores([features(t, n) for t, n in zip(x["text"], x["n_chars"], strict=True)])
        yield {"doc_id": x["doc_id"], "score": got.tolist(), "predicted": [int(s >= least) for s in got]}

    return map_arrow(_texts(docs), f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int", f)
