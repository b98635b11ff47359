"""Conversation repair: the cheapest edits that give a legal sequence of roles, by dynamic programming over a prefix trie.

Rows are (conv_id, turn, role, text), ordered in a conversation by turn (nulls first), then role and the text's SHA-256. Its
signature has one symbol a row: who speaks and the row's first fault. Sorted signatures form a prefix trie: consecutive ones share
their common prefix, so a task keeps one stack of DP layers, cuts it back to that prefix and computes only the layers beyond it;
equal signatures share their answer. A layer has, for each state of ``(s?(ua)+)?``, the least cost so far and the order of the
cheapest audits. Taken relative to the least cost there are few such layers, so each step is made once and looked up after that:
a layer on the stack is a number and a cost.

Audits are letters: D delete (2; the only edit of a blank or duplicate row), I insert an empty row (5), K keep (0), R set the role that the
sequence needs (1); a truncated row that stays adds 5. Of equal cost the least audit in ASCII order is taken. Letters ending in a row of the
input are never prefixes of each other at the same row, so their order is kept by rank alone.

Null role and text stand for one space, a null turn or conv_id for one space in the damaging key; null turns are left out of gaps; rows
without conv_id are one conversation. A conversation without rows has cost 0 and an empty audit. A long conversation's
signature (a byte a row) is put together from pieces that stand in order in a range-partitioned sort, so its rows are not gathered; its digest
is sequential by nature and streams through one task in bounded memory.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, small_batches

SPEAKERS, FAULTS = "sua", "nbdt"
BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, DONE = range(4)  # nothing yet; after s; after u; after a
#: State -> (role that an inserted or rerole'd row takes, state after it).
NEEDS = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", DONE), DONE: ("user", USER)}
_AFTER = {(START, "s"): SYSTEM} | {(q, role[0]): to for q, (role, to) in NEEDS.items()}
_ROW = "conv_id", "turn", "role", "digest"


def symbol(speaker: str, fault: str) -> str:
    """One letter for each pair; speakers but s, u and a are alike."""
    return chr(65 + 4 * (SPEAKERS.find(speaker) if speaker in SPEAKERS and speaker else 3) + FAULTS.index(fault))


def _pair(c: str) -> tuple[str, str]:
    return "suao"[(ord(c) - 65) // 4], FAULTS[(ord(c) - 65) % 4]


class Trie:
    """Layers of the path to the last signature. Signatures may come in any order; sorted ones share most."""

    def __init__(self):
        first = ((0, 0), None, None, None)
        self.kinds, self.number, self.steps, self.ends = [first], {first: 0}, {}, {}
        self.path, self.last, self.layers_made = "", None, 0
        self.kind, self.cost, self.illegal = array("i", [0]), array("q", [0]), array("q", [0])

    @staticmethod
    def _inserts(state: int, most: int = 2) -> Iterator[tuple[str, int, int]]:
        for k in range(most + 1):
            yield "I" * k, INSERT * k, state
            state = NEEDS[state][1]

    def _step(self, kind: int, c: str) -> tuple[int, int, tuple]:
        """The next layer's number, what its least cost adds, and for each state the one before with the letters between."""
        if (kind, c) not in self.steps:
            speaker, fault = _pair(c)
            best: dict[int, tuple] = {}
            for state, held in enumerate(self.kinds[kind]):
                if held is None:
                    continue
                for letters, paid, at in self._inserts(state):
                    ways = [("D", DELETE, at)]
                    if fault not in "bd":
                        late = TRUNCATED if fault == "t" else 0
                        ways.append(("R", REROLE + late, NEEDS[at][1]))
                        if (at, speaker) in _AFTER:
                            ways.append(("K", KEEP + late, _AFTER[at, speaker]))
                    for letter, price, to in ways:
                        way = held[0] + paid + price, held[1], letters + letter, state
                        best[to] = min(best.get(to, way), way)
            least = min(w[0] for w in best.values())
            order = sorted(best, key=lambda to: best[to][1:3])
            layer = tuple((best[to][0] - least, order.index(to)) if to in best else None for to in range(4))
            if layer not in self.number:
                self.number[layer] = len(self.kinds)
                self.kinds.append(layer)
            self.steps[kind, c] = self.number[layer], least, tuple((best[to][3], best[to][2]) if to in best else None for to in range(4))
        return self.steps[kind, c]

    def _end(self, kind: int) -> tuple[int, str, int]:
        if kind not in self.ends:
            ways = [(held[0] + paid, held[1], letters, state) for state, held in enumerate(self.kinds[kind]) if held for letters, paid, at in self._inserts(state) if at in (START, DONE)]
            cost, _, letters, state = min(ways)
            self.ends[kind] = cost, letters, state
        return self.ends[kind]

    def solve(self, signature: str) -> tuple[int, int, str]:
        """Adjacent illegal pairs, cost and audit."""
        if self.last is not None and signature == self.path:
            return self.last
        low, high = 0, min(len(signature), len(self.path))
        while low < high:  # length of the common prefix
            mid = (low + high + 1) // 2
            low, high = (mid, high) if signature.startswith(self.path[:mid]) else (low, mid - 1)
        for column in (self.kind, self.cost, self.illegal):
            del column[low + 1 :]
        for i in range(low, len(signature)):
            to, more, _ = self._step(self.kind[i], signature[i])
            pair = _pair(signature[i - 1])[0] + _pair(signature[i])[0] if i else "su"
            self.kind.append(to)
            self.cost.append(self.cost[i] + more)
            self.illegal.append(self.illegal[i] + (pair not in ("su", "ua", "au")))
        self.layers_made += len(signature) - low
        more, letters, state = self._end(self.kind[-1])
        found = [letters]
        for i in range(len(signature) - 1, -1, -1):
            state, letters = self.steps[self.kind[i], signature[i]][2][state]
            found.append(letters)
        self.path, self.last = signature, (self.illegal[-1], self.cost[-1] + more, "".join(reversed(found)))
        return self.last


def damage(rows: DataFrame) -> DataFrame:
    """The rows with planted faults, by crc32 of ``conv_id:turn`` mod 20; copies: how often each row stands (0: dropped)."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text = F.when(h == 1, "").when(h == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text"))
    role = F.when(h == 4, "user").otherwise(text_of("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(h == 0, 0).when(h == 3, 2).otherwise(1).alias("copies"))


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def signatures(rows: DataFrame) -> DataFrame:
    """Per conversation: conv_id, signature and gaps in its turns. rows: conv_id, turn, role, text and perhaps copies."""
    spark, n = rows.sparkSession, F.col("copies") if "copies" in rows.columns else F.lit(1)
    last = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    light = rows.select("conv_id", "turn", "role", _digest("text").alias("digest"), F.when(last == "", "b").when(last.isin(".", "!", "?"), "n").otherwise("t").alias("fault"), n.alias("copies"))
    # A dropped row only says that its conversation is there.
    gone = F.col("copies") == 0
    light = light.select("conv_id", *(F.when(~gone, F.col(c)).alias(c) for c in ("turn", "role", "digest", "fault")), "copies").groupBy(*_ROW, "fault").agg(F.sum("copies").alias("n"))
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first())) == 1
    marked = cut(spark, light.select(*_ROW, F.substring("role", 1, 1).alias("speaker"), "fault", "n", first.alias("first")), "signed")
    order = [F.col(c).asc_nulls_first() for c in _ROW]

    def pieces(x: dict) -> Iterator[dict]:
        """Of each conversation's run of rows in a batch: its symbols, first and last turn, and the number of turns."""
        out: dict[str, list] = {c: [] for c in ("conv_id", "part", "run", "signature", "low", "high", "turns")}
        before: object = out
        for conv, turn, speaker, fault, n, first in zip(*(x[c] for c in ("conv_id", "turn", "speaker", "fault", "n", "first")), strict=True):
            if before is out or conv != before:
                runs[0] += 1
                for c, v in (("conv_id", conv), ("part", TaskContext.get().partitionId()), ("run", runs[0]), ("signature", []), ("low", None), ("high", None), ("turns", 0)):
                    out[c].append(v)
                before = conv
            if n:
                again = symbol(speaker or "", "b" if fault == "b" else "d")
                out["signature"][-1].append((symbol(speaker or "", fault) if first else again) + again * (n - 1))
            if turn is not None and turn != out["high"][-1]:
                out["low"][-1] = turn if out["low"][-1] is None else out["low"][-1]
                out["high"][-1] = turn
                out["turns"][-1] += 1
        out["signature"] = ["".join(s) for s in out["signature"]]
        yield out

    runs = [0]
    kind = dict(rows.dtypes)
    schema = f"conv_id {kind['conv_id']}, part int, run long, signature string, low {kind['turn']}, high {kind['turn']}, turns long"
    found = map_arrow(marked.repartitionByRange(*order).sortWithinPartitions(*order), schema, pieces, 4096)
    found = found.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "run", "signature", "low", "high", "turns"))).alias("p"))
    held = F.filter("p", lambda x: x["turns"] > 0)
    shared = F.size(F.filter(F.transform(F.col("held"), lambda x, i: (i > 0) & (x["low"] == F.get(F.col("held"), F.greatest(i - 1, F.lit(0)))["high"])), lambda b: b)).cast("long")
    distinct = F.aggregate("held", F.lit(0).cast("long"), lambda acc, x: acc + x["turns"]) - shared
    gaps = F.array_max(F.col("held")["high"]) - F.array_min(F.col("held")["low"]) + 1 - distinct
    return found.withColumn("held", held).select("conv_id", F.array_join(F.col("p")["signature"], "").alias("signature"), F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"))


def audits(signs: DataFrame) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit."""
    trie = Trie()  # every task gets its own

    def f(x: dict) -> Iterator[dict]:
        got = [trie.solve(s) for s in x["signature"]]
        yield {"conv_id": x["conv_id"], "signature": x["signature"], "gaps": x["gaps"], "illegal": [g[0] for g in got], "cost": [g[1] for g in got], "audit": [g[2] for g in got]}

    kind = dict(signs.dtypes)["conv_id"]
    order = ["signature", F.col("conv_id").asc_nulls_first()]
    solved = map_arrow(signs.repartitionByRange(*order).sortWithinPartitions(*order), f"conv_id {kind}, signature string, gaps long, illegal long, cost long, audit string", f)
    named = {"blank": "b", "duplicate": "d", "truncated": "t"}
    count = lambda fault: F.length(F.regexp_replace("signature", "[^" + "".join(symbol(s, fault) for s in "suao") + "]", "")).cast("long")
    return solved.select("conv_id", "gaps", *(count(f).alias(c) for c, f in named.items()), "illegal", "cost", "audit")


class _Edits:
    """One conversation's audit, applied to its rows as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _set(self, text: str) -> tuple[str, str]:
        role, self.state = NEEDS[self.state]
        return role, text

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit.startswith("I", self.at):
            self.at += 1
            yield self._set("")

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        letter, self.at = self.audit[self.at], self.at + 1
        if letter == "R":
            yield self._set(text)
        elif letter == "K":
            self.state = _AFTER[self.state, role[0]]
            yield role, text


def _with_heads(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of each conversation in order, in one partition, behind a row with what was found for it."""
    n = F.col("copies") if "copies" in rows.columns else F.lit(1)
    body = rows.select("conv_id", F.lit(1).alias("k"), "turn", "role", _digest("text").alias("digest"), "text", n.alias("copies")).where("copies > 0")
    head = found.select("conv_id", F.lit(0).alias("k"), F.struct(*(c for c in found.columns if c != "conv_id")).alias("head"))
    both = body.unionByName(head, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "k", *(F.col(c).asc_nulls_first() for c in _ROW[1:]))


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, head, None) for each conversation, then (conv_id, None, (role, text)) for each of its repaired rows."""
    edits, conv = None, None
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            x = batch.slice(at, 256).select(["conv_id", "k", "role", "text", "copies", "head"]).to_pydict()
            for new, k, role, text, copies, head in zip(*x.values(), strict=True):
                if k == 0:
                    if edits is not None:
                        yield from ((conv, None, made) for made in edits.inserted())
                    conv, edits = new, _Edits(head["audit"])
                    yield conv, head, None
                else:
                    for _ in range(copies):
                        yield from ((conv, None, made) for made in edits.row(role, text))
    if edits is not None:
        yield from ((conv, None, made) for made in edits.inserted())


def _in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == 256:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)  # noqa: B905
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)  # noqa: B905


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, place (from 0), role, text."""
    schema = f"conv_id {dict(rows.dtypes)['conv_id']}, place long, role string, text string"
    out = _arrow(schema)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        place = 0
        for conv, head, made in _events(batches):
            place = 0 if head else place + 1
            if made:
                yield conv, place - 1, *made

    return small_batches(_with_heads(rows, found)).mapInArrow(lambda b: _in_batches(numbered(b), out), schema)


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """found with repaired_sha256: of the repaired rows as ``role:text``, joined by newlines."""
    kinds = dict(found.dtypes)
    names = [c for c in found.columns if c != "conv_id"]
    schema = ", ".join(f"{c} {kinds[c]}" for c in ["conv_id", *names]) + ", repaired_sha256 string"
    out = _arrow(schema)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at, sha, some = None, None, False
        for conv, head, made in _events(batches):
            if head:
                if at:
                    yield *at, sha.hexdigest()
                at, sha, some = (conv, *(head[c] for c in names)), hashlib.sha256(), False
            else:
                sha.update((("\n" if some else "") + f"{made[0]}:{made[1]}").encode("utf-8", "surrogatepass"))
                some = True
        if at:
            yield *at, sha.hexdigest()

    return small_batches(_with_heads(rows, found)).mapInArrow(lambda b: _in_batches(hashed(b), out), schema)
