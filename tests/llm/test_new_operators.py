"""Quality classifier, phrase mining and conversation repair, against brute force, SQL and held-out rows."""

import functools
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import SCHEMA, both, none, odd  # noqa: F401  (fixtures)
from varve.llm import classifier, phrases, queries, repair, sql_phrases, sql_repair, toxicity
from varve.llm.common import load

TALK = "conv_id long, turn long, role string, text string"


# -- conversation repair ---------------------------------------------------------------------------------------------


@functools.cache
def cheapest(signature):
    """All audits over the rows of a signature by plain search over (row, state), least (cost, audit) first."""
    rows = [repair._pair(c) for c in signature]
    order = {"s": 1, "u": 2, "a": 3}
    follows = {0: "su", 1: "u", 2: "a", 3: "u"}
    best = {}
    # Shortest paths in the graph of (row, state); edges only go forward but for inserts, so relax until nothing changes.
    best[0, 0] = (0, "")
    changed = True
    while changed:
        changed = False
        for (i, q), (cost, audit) in list(best.items()):
            moves = [(i, order[c], 5, "I") for c in "ua" if c in follows[q]]
            if i < len(rows):
                who, fault = rows[i]
                moves.append((i + 1, q, 2, "D"))
                if fault not in "bd":
                    late = 5 * (fault == "t")
                    moves += [(i + 1, order[c], 1 + late, "R") for c in "ua" if c in follows[q]]
                    moves += [(i + 1, order[who], late, "K")] if who in follows[q] else []
            for at, to, price, letter in moves:
                way = (cost + price, audit + letter)
                if way < best.get((at, to), (10**9, "")):
                    best[at, to] = way
                    changed = True
    return min(best[k] for k in ((len(rows), 0), (len(rows), 3)) if k in best)


def test_trie_equals_plain_search():
    r = random.Random(4)
    letters = [repair.symbol(s, f) for s in ("s", "u", "a", "tool") for f in "nbdt"]
    some = {"".join(r.choice(letters[:12] if r.random() < 0.7 else letters) for _ in range(r.randrange(8))) for _ in range(400)} | {""}
    shared, apart = repair.Trie(), 0
    for s in sorted(some):
        illegal, cost, audit = shared.solve(s)
        assert (cost, audit) == cheapest(s), s
        who = [repair._pair(c)[0] for c in s]
        assert illegal == sum(a + b not in ("su", "ua", "au") for a, b in zip(who, who[1:], strict=False))
        apart += len(s)
    assert shared.layers_made < apart  # prefixes are not computed again
    mixed = repair.Trie()
    assert all(mixed.solve(s)[1:] == cheapest(s) for s in r.sample(sorted(some), 100))


def talks(spark):
    r = random.Random(8)
    rows = []
    for conv in [*range(300), None]:
        for turn in range(r.randrange(9)):
            role = r.choice(["user", "assistant", "system", "User", "", None, "tool", "user", "assistant"])
            text = r.choice(["Hello there.", "", None, " \n", "no end", "Wow!", "What? ", "same", "é…", "a|b:\nuser:x."])
            rows.append((conv, turn if r.random() < 0.9 else None, role, text))
            if r.random() < 0.1:
                rows.append(rows[-1])
    rows += [(1000, t, "user" if t % 2 == 0 else "assistant", f"text {t % 700}.") for t in range(3000)]
    return spark.createDataFrame(rows, TALK).withColumns({"signature": F.lit("clash"), "copies": F.lit(9), "k": F.lit(1)})


def test_repair_equals_sql_on_odd_rows(spark, sf):
    docs = talks(spark)
    docs = docs.unionByName(load(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), allowMissingColumns=True)
    con = duckdb.connect()
    con.register("conversations", docs.select("conv_id", "turn", "role", "text").toArrow())
    want = {r[0]: r[1:] for r in con.execute(sql_repair.OP13).fetchall()}
    rows = repair.damage(docs.repartition(5))
    found = repair.audits(repair.signatures(rows))
    got = [tuple(r) for r in repair.digests(rows, found).collect()]
    assert len(got) == len(want) and {r[0]: r[1:] for r in got} == want


def test_repaired_rows_are_legal_and_hash_alike(spark):
    rows = repair.damage(talks(spark))
    found = repair.audits(repair.signatures(rows)).persist()
    texts = defaultdict(list)
    for r in repair.repaired(rows, found).orderBy("conv_id", "place").collect():
        assert r.place == len(texts[r.conv_id])
        texts[r.conv_id].append((r.role, r.text))
    for r in repair.digests(rows, found).collect():
        made = texts[r.conv_id]
        who = "".join(x[0][:1] for x in made)
        body = who[1:] if who.startswith("s") else who
        assert not who or (body and body == "ua" * (len(body) // 2))
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in made).encode()).hexdigest()
        assert r.cost >= 2 * r.audit.count("D") + r.audit.count("R") + 5 * r.audit.count("I")
    found.unpersist()


def test_damage_follows_the_key(spark):
    rows = [(c, t, "assistant", "One. Two! x?") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    got = {(r.conv_id, r.turn): r for r in repair.damage(spark.createDataFrame(rows, TALK)).collect()}
    for c, t, *_ in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r = got[c, t]
        assert r.copies == {0: 0, 3: 2}.get(h, 1)
        assert r.text == {1: "", 2: "One Two x"}.get(h, " " if c is None else "One. Two! x?")
        assert r.role == ("user" if h == 4 else " " if c is None else "assistant")


def test_repair_of_nothing_and_of_dropped_rows(spark):
    empty = repair.damage(spark.createDataFrame([], TALK))
    assert repair.digests(empty, repair.audits(repair.signatures(empty))).count() == 0
    key = next((c, t) for c in range(1000) for t in range(20) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    gone = repair.damage(spark.createDataFrame([(*key, "user", "x")], TALK))
    assert tuple(repair.digests(gone, repair.audits(repair.signatures(gone))).first()) == (key[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# -- phrase mining ---------------------------------------------------------------------------------------------------


def mined(rows, least, top, absorb=100, longest=5):
    import re

    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    inside = defaultdict(int)
    for (lang, w), a in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(inside[lang, w[i : i + k]], a)
    out = defaultdict(list)
    for (lang, w), a in found.items():
        if inside[lang, w] * 100 >= absorb * a:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, i + 1): (p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top])}


@pytest.mark.parametrize("least,top,absorb,longest", [(3, 50, 100, 5), (2, 100_000, 60, 5), (2, 100_000, 100, 3), (2, 100_000, 100, 2)])
def test_phrases_equal_brute_force(spark, both, none, least, top, absorb, longest, monkeypatch):  # noqa: F811
    monkeypatch.setattr(phrases, "ROW_WORDS", 7)  # so that many pieces are cut
    r = random.Random(2)
    words = ["the", "cat", "sat", "Mat", "ünï", "\x1c", "日本", "a\x00b"]
    more = [(300_000 + i, "".join(r.choice(words) + r.choice([" ", "  ", "\t", " ", " ", ". ", "\x0b"]) for _ in range(30)), r.choice(["en", None, "und", "de"]), "s", None) for i in range(200)]
    docs = both.unionByName(spark.createDataFrame(more, SCHEMA)).withColumns({"piece": F.lit("clash"), "m": F.lit(7), "phrase": F.lit("x")})
    docs = docs.where("doc_id >= 100000 or doc_id % 3 = 0") if least == 2 else docs  # the fixture; the operator takes all of it
    want = mined([(x.text, x.lang) for x in docs.select("text", "lang").collect()], least, top, absorb, longest)
    got = {(x.lang, x["rank"]): (x.phrase, x.a, x.l, x.r, x.n, x.score) for x in phrases.mine(docs, least, top, absorb, longest).collect()}
    assert len(want) > 50 and got == want
    assert phrases.mine(none).count() == 0


def test_phrases_equal_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = sorted(con.execute(sql_phrases.OP12).fetchall())
    assert len(want) > 10 and sorted(tuple(r) for r in queries.op12_phrase_mining(spark, sf).collect()) == want


def test_scores_pass_64_bits(spark):
    """a * n * 1000 over 2^63: pieces are multiplied before they are mined."""
    held = spark.createDataFrame([("en", "x y", 3 * 10**12, 2), ("en", "x z", 5 * 10**11, 2), ("en", "w", 10**13, 1)], "lang string, piece string, m long, own int")
    docs = spark.createDataFrame([], SCHEMA)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(phrases, "pieces", lambda *_: held)
        got = {r.phrase: r for r in phrases.mine(docs, 10**9).collect()}
    n = 2 * (3 * 10**12 + 5 * 10**11) + 10**13
    assert got["x y"].score == 1000 * 3 * 10**12 * n // (35 * 10**11 * 3 * 10**12) and got["x z"].n == n


def test_bucket_sums_leave_memory(tmp_path, monkeypatch):
    monkeypatch.setattr(phrases, "MEMORY", "24MB")
    def batches():
        for _ in range(2):
            for at in range(0, 400_000, 8192):
                k = range(at, min(at + 8192, 400_000))
                yield pa.RecordBatch.from_arrays([pa.array(["en"] * len(k)), pa.array([f"a rather long phrase number {i}" for i in k]), pa.array([i % 60 for i in k])], ["lang", "phrase", "f"])
    got = pa.Table.from_batches(list(phrases._summed(batches(), 100, str(tmp_path))))
    assert got.num_rows == sum(2 * (i % 60) >= 100 for i in range(400_000)) and not list(tmp_path.iterdir())


# -- quality classifier ----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def judged(spark):
    at = "/root/testdata/sf0.01"
    return load(spark, at, "documents"), load(spark, at, "labels").select("doc_id", "quality")


def test_quality_of_held_out_rows(spark, judged):
    docs, labels = judged
    machine = classifier.fit(docs, labels.where(~toxicity.held_out()))
    x = classifier.score(docs, machine).join(labels, "doc_id").where(toxicity.held_out()).toPandas()
    good, bad = x[x.quality == 1], x[x.quality == 0]
    auc = np.mean(good.score.values[:, None] > bad.score.values[None, :])
    assert auc > 0.95 and (good.predicted == 1).mean() > 0.95 and abs(x.score.mean() - x.quality.mean()) < 0.06
    assert ((x.predicted == 1) == (x.score >= 0.3)).all()


def test_scores_use_no_ids_and_all_text(spark, judged):
    docs, labels = judged
    machine = classifier.fit(docs, labels.where(~toxicity.held_out()))
    plain = {r.doc_id: r.score for r in classifier.score(docs, machine).collect()}
    moved = {r.doc_id: r.score for r in classifier.score(docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string"), "score": F.lit(3)}).repartition(3), machine).collect()}
    assert plain == moved
    text = docs.where("length(text) > 2000").first().text
    tail = spark.createDataFrame([(1, text, None), (2, text + " ###" * 2000, None)], "doc_id long, text string, n_chars long")
    a, b = (r.score for r in classifier.score(tail, machine).orderBy("doc_id").collect())
    assert b < a


def test_pairs_from_the_sum_of_squares():
    r = np.random.default_rng(0)
    size = classifier.BUCKETS + classifier.N_BINNED * classifier.BINS
    machine = classifier.Machine(np.zeros((classifier.N_BINNED, classifier.BINS - 1)), 0.3, r.normal(size=size), r.normal(size=(size, classifier.RANK)))
    made = [classifier.features(t, n) for t, n in (("one two two three", 4), ("", None), (None, 9), ("x" * 50, 50))]
    index, value, begins = machine.rows(made)
    got, _ = machine.margin(index, value, begins)
    for k, (a, b) in enumerate(zip(begins, [*begins[1:], len(index)], strict=True)):
        want = 0.3 + sum(machine.linear[i] * v for i, v in zip(index[a:b], value[a:b], strict=True))
        want += sum(machine.factors[index[i]] @ machine.factors[index[j]] * value[i] * value[j] for i in range(a, b) for j in range(a, i))
        assert abs(got[k] - want) < 1e-9


def test_classifier_of_odd_and_empty(spark, odd, none):  # noqa: F811
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 20, 2)] + [(2, 1), (None, 1), (4, None), (999, 1)], "doc_id long, quality int")
    docs = odd.unionByName(odd.limit(5)).withColumn("predicted", F.lit("clash"))
    got = classifier.score(docs, classifier.fit(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    seen = defaultdict(set)
    for r in got:
        seen[r.doc_id].add(r.score)
    assert all(len(s) == 1 for s in seen.values())
    blank = classifier.fit(none, labels)
    assert {r.score for r in classifier.score(odd.drop("n_chars"), blank).collect()} == {0.5}
    assert classifier.score(none, blank).count() == 0
    one = spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in classifier.score(odd, classifier.fit(odd, one)).collect())
