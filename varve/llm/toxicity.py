"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The vector of a text has every word that a sampled example has: (1 + ln tf) * idf * association, of length 1. idf is over
all documents; association, 1 + sqrt(chi2) of word and label over the sample, makes words that tell the labels apart
weigh more, and drops none. All sampled examples are in the index.

The index is inverted: for each word, the examples that have it, in blocks of ``BLOCK`` examples, with the greatest weight
of each frequent word in each block. The sum of a query's weights times those maxima, and the most that its rarer words
(whose lists are short, and added up first) give an example there, bound its similarity to all examples of a block. The
``FIRST_BLOCKS`` of highest bound are scored, then all whose bound reaches the k-th best similarity so far; no other block
can hold a neighbour, so those found (with all that tie with the k-th) are exact. Blocks hold examples of like words.

Neighbours vote for their labels, each with its similarity (1 - distance); the share is shrunk towards the share of toxic
examples, then calibrated by a logistic curve fitted on all examples, each left out of its own vote. A text without any
word of the index, a null or an empty one has no neighbours and gets the calibrated base share.

The classifier is fitted on at most ``MAX_EXAMPLES`` labelled rows, a hash sample by doc_id. Rows without a label, a
doc_id or a document give no example. A doc_id labelled twice counts as toxic if any of its labels says so; of the texts
that share a doc_id the least is the example. Every row of docs gets a score, repeated ones the same.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow

MAX_EXAMPLES = 4096
NEIGHBOURS, SHRINK, BLOCK, FIRST_BLOCKS = 15, 0.1, 64, 6
#: Words with dense weights in the index, and queries that are searched together.
FREQUENT, QUERIES = 256, 64
_WORD = re.compile(r"[^\W_]+")
_NONE = np.empty(0, np.int64), np.empty(0)


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length, in one array."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


@dataclass
class Index:
    """A block-max inverted index of the sampled examples, and the calibration of their votes.

    Of the FREQUENT words that most examples have (place: their number, -1 for others), dense holds each block's weights
    (block x word x example) and greatest the most in each block (word x block). Any other word t has the short list
    begins[t]:begins[t + 1] of example and value."""

    names: list[str]
    weight: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    place: np.ndarray
    dense: np.ndarray
    greatest: np.ndarray
    begins: np.ndarray
    example: np.ndarray
    value: np.ndarray
    base: float
    slope: float = 1.0
    shift: float = 0.0
    memo: dict = field(default_factory=dict)

    def __post_init__(self):
        self.vocabulary = {t: i for i, t in enumerate(self.names)}

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        known = [t for t in counts if t in self.vocabulary]
        c = np.fromiter(map(self.vocabulary.__getitem__, known), np.int64, len(known))
        w = (1 + np.log(np.fromiter(map(counts.__getitem__, known), float, len(known)))) * self.weight[c]
        return c, w / (np.linalg.norm(w) or 1)

    def neighbours(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, but: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each query (words, weights): numbers and similarities of the k most similar examples, but one, and of all
        that tie with the last of them."""
        n, n_blocks = len(self.labels), len(self.dense)
        if not n or not queries:
            return [_NONE] * len(queries)
        c, w = (np.concatenate(x) for x in zip(*queries, strict=True))
        query = np.repeat(np.arange(len(queries)), [len(x) for x, _ in queries])
        often = self.place[c] >= 0
        frequent = np.zeros((len(queries), self.dense.shape[1]))
        frequent[query[often], self.place[c[often]]] = w[often]
        c, w, query = c[~often], w[~often], query[~often]
        size = self.begins[c + 1] - self.begins[c]
        p = spans(self.begins[c], size)
        sims = np.bincount(np.repeat(query, size) * (n_blocks * BLOCK) + self.example[p], np.repeat(w, size) * self.value[p], len(queries) * n_blocks * BLOCK).reshape(len(queries), n_blocks, BLOCK)
        bound = frequent @ self.greatest + sims.max(axis=2)
        scored = np.zeros(sims.shape)
        some = bound >= np.partition(bound, max(0, n_blocks - FIRST_BLOCKS), axis=1)[:, max(0, n_blocks - FIRST_BLOCKS), None]
        some &= bound > 0
        least = np.zeros(len(queries))
        while some.any():
            for b in np.flatnonzero(some.any(axis=0)):
                q = np.flatnonzero(some[:, b])
                scored[q, b] = frequent[q] @ self.dense[b] + sims[q, b]
            if but is not None:
                scored.reshape(len(queries), -1)[np.arange(len(queries)), but] = 0
            bound[some] = 0
            flat = scored.reshape(len(queries), -1)
            if flat.shape[1] > k:
                least = np.partition(flat, flat.shape[1] - k, axis=1)[:, flat.shape[1] - k]
            some = (bound > 0) & (bound >= least[:, None] - 1e-9)
        out = []
        for row, reached in zip(scored.reshape(len(queries), -1), least.tolist(), strict=True):
            spot = np.flatnonzero(row >= max(reached - 1e-9, 1e-12))
            out.append((spot, row[spot]))
        return out

    def vote(self, spot: np.ndarray, sim: np.ndarray) -> float:
        if len(sim) > NEIGHBOURS:  # ties share the votes of NEIGHBOURS
            sim = sim * NEIGHBOURS / len(sim)
        return (float(sim @ self.labels[spot]) + SHRINK * self.base) / (float(sim.sum()) + SHRINK)

    def calibrated(self, vote: float) -> float:
        v = min(max(vote, 1e-4), 1 - 1e-4)
        return 1 / (1 + np.exp(-(self.slope * np.log(v / (1 - v)) + self.shift)))

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[int], list[float], list[str]]]:
        """Of each text: score, evidence (ids and similarities of the nearest few examples) and the words that weigh most."""
        keys = [hashlib.blake2b((t or "").encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
        if len(self.memo) > 20_000:
            self.memo.clear()
        new = list({k: t for k, t in zip(keys, texts, strict=True) if k not in self.memo}.items())
        for at in range(0, len(new), QUERIES):
            some = new[at : at + QUERIES]
            vectors = [self.vector(Counter(words(t))) for _, t in some]
            for (key, _), (c, w), (spot, sim) in zip(some, vectors, self.neighbours(vectors), strict=True):
                near = np.lexsort((self.ids[spot], -sim))[:3]
                heavy = [self.names[i] for i in c[np.lexsort((c, -w))[:5]]]
                self.memo[key] = float(self.calibrated(self.vote(spot, sim))), self.ids[spot[near]].tolist(), sim[near].round(6).tolist(), heavy
        return [self.memo[k] for k in keys]


def association(n1: np.ndarray, n0: np.ndarray, p: int, q: int) -> np.ndarray:
    """1 + sqrt(chi2) of words that n1 of p toxic and n0 of q other examples have."""
    cross = n1 * (q - n0) - n0 * (p - n1)
    room = p * q * (n1 + n0) * (p + q - n1 - n0)
    return 1 + np.abs(cross) * np.sqrt(np.divide(p + q, room, out=np.zeros_like(room), where=room > 0))


def _groups(found: list[set[int]], df: np.ndarray, n_words: int = 256, n_groups: int = 12) -> list[int]:
    """A group for each example, by k-means over which of the most frequent words it has."""
    frequent = np.argsort(-df, kind="stable")[:n_words]
    has = np.array([[t in f for t in frequent.tolist()] for f in found], float).reshape(len(found), len(frequent))
    has /= np.maximum(np.linalg.norm(has, axis=1, keepdims=True), 1)
    centres = has[:: max(1, len(has) // n_groups)][:n_groups]
    group = np.zeros(len(has), int)
    for _ in range(8 if len(has) else 0):
        group = np.argmax(has @ centres.T, axis=1)
        sums = np.array([has[group == g].sum(axis=0) for g in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return group.tolist()


def build(examples: list[tuple[int, int, dict[str, int]]], df: dict[str, int], n_docs: int) -> Index:
    """The index of examples (id, label, counts of words), not yet calibrated; df: documents that have each word."""
    names = sorted({t for *_, c in examples for t in c})
    vocabulary = {t: i for i, t in enumerate(names)}
    labels = np.array([y for _, y, _ in examples], float)
    n1, n0 = np.zeros(len(names)), np.zeros(len(names))
    for _, y, c in examples:
        (n1 if y else n0)[[vocabulary[t] for t in c]] += 1
    p = int(labels.sum())
    idf = np.log((1 + n_docs) / (1 + np.array([df.get(t, 0) for t in names], float))) + 1
    weight = idf * association(n1, n0, p, len(labels) - p)
    # Examples of like words lie together, which keeps the bounds of other blocks low.
    group = _groups([{vocabulary[t] for t in c} for *_, c in examples], n1 + n0)
    heaviest = [max(((weight[vocabulary[t]], t) for t in c), default=(0, "")) for *_, c in examples]
    rows = [examples[i] for i in sorted(range(len(examples)), key=lambda i: (group[i], heaviest[i], examples[i][0]))]
    n_blocks, often = -(-len(rows) // BLOCK), np.argsort(-(n1 + n0), kind="stable")[:FREQUENT]
    place = np.full(len(names), -1)
    place[often] = np.arange(len(often))
    index = Index(names, weight, np.array([y for _, y, _ in rows], float), np.array([d for d, *_ in rows], np.int64), place, np.zeros((n_blocks, len(often), BLOCK)), np.zeros((len(often), n_blocks)), np.zeros(len(names) + 1, np.int64), np.empty(0, np.int64), np.empty(0), (p + 1) / (len(rows) + 20))
    vectors = [index.vector(c) for *_, c in rows]
    if names:
        word, value = (np.concatenate(x) for x in zip(*vectors, strict=True))
        example = np.repeat(np.arange(len(rows)), [len(c) for c, _ in vectors])
        at = place[word] >= 0
        index.dense[example[at] // BLOCK, place[word[at]], example[at] % BLOCK] = value[at]
        index.greatest = index.dense.max(axis=2).T.copy()
        order = np.flatnonzero(~at)[np.lexsort((example[~at], word[~at]))]
        index.example, index.value = example[order], value[order]
        index.begins = np.searchsorted(word[order], np.arange(len(names) + 1))
    return index


def _logistic(v: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    v = np.clip(v, 1e-4, 1 - 1e-4)
    x = np.stack([np.log(v / (1 - v)), np.ones_like(v)], axis=1)
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (p - y) + 0.1 * (b - [1.0, 0.0])
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        b = b - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return max(0.05, float(b[0])), float(b[1])


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> Index:
    """labels: doc_id and toxic, of the rows that may be learnt from."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)  # the sample's documented bound
    examples = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))

    def count(x: dict) -> Iterator[dict]:
        found = [Counter(words(t)) for t in x["text"]]
        yield {"doc_id": x["doc_id"], "toxic": [int(bool(y)) for y in x["toxic"]], "words": [list(f) for f in found], "counts": [list(f.values()) for f in found]}

    examples = cut(spark, map_arrow(examples, "doc_id long, toxic int, words array<string>, counts array<int>", count), "examples")
    rows = [(r.doc_id, r.toxic, dict(zip(r.words, r.counts, strict=True))) for r in examples.orderBy("doc_id").toLocalIterator()]  # bounded by max_examples
    vocabulary = spark.sparkContext.broadcast(frozenset(t for *_, c in rows for t in c))

    def frequency(x: dict) -> Iterator[dict]:
        seen: Counter = Counter()
        for t in x["text"]:
            seen.update(vocabulary.value.intersection(words(t)))
        seen["\n"] = len(x["text"])  # no word: the documents counted
        yield {"word": list(seen), "n": list(seen.values())}

    df = {r.word: r.n for r in map_arrow(docs.select("text"), "word string, n long", frequency, 4096).groupBy("word").agg(F.sum("n").alias("n")).toLocalIterator()}
    n_docs = df.pop("\n", 0)
    index = build(rows, df, n_docs)
    shared = spark.sparkContext.broadcast((index, {d: i for i, d in enumerate(index.ids.tolist())}))

    def left_out(x: dict) -> Iterator[dict]:
        held, place = shared.value
        vectors = [held.vector(dict(zip(t, n, strict=True))) for t, n in zip(x["words"], x["counts"], strict=True)]
        votes = [held.vote(*found) for found in held.neighbours(vectors, but=[place[d] for d in x["doc_id"]])]
        yield {"vote": votes, "toxic": x["toxic"]}

    few = examples.repartition(max(1, -(-len(rows) // 256)))
    votes = map_arrow(few, "vote double, toxic int", left_out, QUERIES).collect()  # of the examples
    if votes:
        index.slope, index.shift = _logistic(np.array([r.vote for r in votes]), np.array([r.toxic for r in votes], float))
    return index


def score(docs: DataFrame, index: Index) -> DataFrame:
    """Per row: doc_id, score, predicted, evidence_ids, evidence_similarities, evidence_words."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def f(x: dict) -> Iterator[dict]:
        got = shared.value.scores(x["text"])
        yield {"doc_id": x["doc_id"], "score": [g[0] for g in got], "predicted": [int(g[0] >= 0.5) for g in got], "evidence_ids": [g[1] for g in got], "evidence_similarities": [g[2] for g in got], "evidence_words": [g[3] for g in got]}

    return map_arrow(docs.select("doc_id", "text"), "doc_id long, score double, predicted int, evidence_ids array<long>, evidence_similarities array<double>, evidence_words array<string>", f)


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(5)) == 0
