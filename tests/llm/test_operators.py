import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from varve.llm import chat, decontaminate, licenses, lm, neardup, packing, quality, queries, store, substrings, tokens, toxicity
from varve.llm.common import load, new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_texts():
    r = random.Random(1)
    words = [f"w{r.randrange(300)}" for _ in range(4000)]
    base = " ".join(words[:200])
    return [
        None, "", " ", "\n\t ", "one", "One one", "a b", "Ünïcode naïve — “quotes” 日本語 🙂 x y z", "  lead", "trail  ", "a  b \n c\x0bd\x1ce\x85f",
        base, base, base.upper(), base + " more words here", " ".join(words), " ".join(words[:3900]), "x" * 5000, "same line\n" * 40, "it's we'll 'S 123456 ... !!! <|endoftext|> <|startoftext|> a<|endoftext|> b",
        " ".join(["the cat"] * 30), "<|im_end|> \\ <\\| $ #tag & <b>", "é ́x ﬁ",
    ]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 5 == 0 else "en", "s", None) for i, t in enumerate(odd_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def both(spark, odd, sf):
    return load(spark, sf, "documents").unionByName(odd.withColumn("doc_id", F.col("doc_id") + 100_000))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_ids_equal_plain_ids(both, name):
    plain, fast = Tokenizer.from_file(public_tokenizers.path(name)), tokens.encoder(public_tokenizers.path(name))
    assert fast.split is not None
    texts = [r.text for r in both.collect()]
    for t, raw in zip(texts, fast.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == plain.encode(t or "", add_special_tokens=False).ids, t


def test_quality_equals_brute_force(both, none):
    got, texts = by_id(quality.measures(both)), {r.doc_id: r.text for r in both.collect()}
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.base_measures(t), t
        ratios = brute.ratios(t)
        assert (r.mean_word_chars, r.symbol_ratio, r.exclamation_ratio, r.stop_word_ratio, r.dup_line_ratio) == ratios, t
        assert r.kept == (not r.base_failed and 2 <= ratios[0] <= 15 and ratios[1] <= 0.3 and ratios[2] <= 0.5 and ratios[3] >= 0.03 and ratios[4] <= 0.4)
    assert quality.measures(none).count() == 0


def test_quality_keeps_good_and_all_columns(both, spark, sf):
    both = both.withColumn("n_words", F.lit("clash"))
    kept = quality.keep_good(both)
    assert kept.columns == both.columns
    labels = {r.doc_id: r.quality for r in load(spark, sf, "labels").collect()}
    ids = {r.doc_id for r in kept.collect()}
    good, bad = ([d in ids for d, q in labels.items() if q == k] for k in (1, 0))
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.2


@pytest.mark.parametrize("size,percent", [(2, 80), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, both, none, size, percent):
    r = random.Random(3)
    more, at = [], 200_000
    for n in (6, 12, 60, 400):  # groups of near copies around the threshold
        base = [f"v{r.randrange(10**6)}" for _ in range(n)]
        for _ in range(40):
            w = [f"u{r.randrange(10**6)}" if r.random() < 0.06 else x for x in base]
            more.append((at, " ".join(w), "en", "s", 1))
            at += 1
    docs = both.unionByName(spark.createDataFrame(more, SCHEMA))
    want = brute.components({r.doc_id: r.text for r in docs.collect()}, size, percent)
    got = by_id(neardup.classes(docs, size, percent))
    assert {d: (x.n_shingles, x.component_id) for d, x in got.items()} == want
    assert all(x.kept == (x.component_id == d) for d, x in got.items())
    assert neardup.classes(none, size, percent).count() == 0


def test_near_duplicates_of_repeated_and_null_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    docs = spark.createDataFrame([(1, a), (1, a), (2, b), (3, a), (3, b), (None, a), (4, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in neardup.classes(docs, 2).collect())
    assert got == [(-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (3, 1, False), (4, 4, True)]


def test_near_duplicates_of_one_id_with_many_texts(spark):
    """Every text of a repeated doc_id is compared: held to all pairs of rows, whose ids are joined."""
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    near = " ".join([*b[:59], "other"])
    for rows in ([(1, " ".join(a)), (1, " ".join(b)), (2, near)], [(5, " ".join(b)), (5, " ".join(a)), (3, near), (9, " ".join(a)), (8, "x y z"), (8, "x y z")]):
        got = {(r.doc_id, r.component_id) for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
        assert got == {(d, 8 if d == 8 else min(x for x, _ in rows if x != 8)) for d, _ in rows}
    r = random.Random(5)
    for round_ in range(2):
        bases = [[f"w{r.randrange(10**6)}" for _ in range(40)] for _ in range(12)]
        rows = []
        for _ in range(90):
            words = [f"z{r.randrange(10**6)}" if r.random() < 0.05 else w for w in r.choice(bases)]
            rows.append((r.randrange(70), " ".join(words)))
        sets = [brute.shingle_set(t, 2) for _, t in rows]
        root = {d: d for d, _ in rows}

        def find(d):
            while root[d] != d:
                d = root[d]
            return d

        for i in range(len(rows)):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    x, y = sorted((find(rows[i][0]), find(rows[j][0])))
                    root[y] = x
        got = {(x.doc_id, x.component_id) for x in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 2).collect()}
        assert got == {(d, find(d)) for d in root}


def test_estimate_is_unbiased():
    r = np.random.default_rng(0)
    for n, share in ((30, 0.5), (500, 0.8), (5000, 0.9)):
        x = r.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        k = round(2 * n * share / (1 + share) / 2) * 1
        a, b = np.unique(x[:n]), np.unique(np.concatenate((x[:k], x[n : 2 * n - k])))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(neardup.estimate(neardup.registers(a), neardup.registers(b), len(a), len(b)) - true) < 0.16


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (150, 200), (300, 301)]
    random.Random(0).shuffle(edges)
    got = {r.id: r.component for r in neardup.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100, 300: 300, 301: 300}


def word_maker(seed):
    r = random.Random(seed)
    return r, lambda n: " ".join(f"{r.choice('abcdefgh')}{r.randrange(10 ** r.randrange(5, 9))}" for _ in range(n))


def test_substring_passages_are_found_and_removed(spark, none):
    r, text = word_maker(5)
    passage = text(60)
    rows = [(i, f"{text(r.randrange(5, 90))} {passage}\n{text(40)}" if i < 30 else text(120)) for i in range(200)] + [(900, None), (901, ""), (902, f"{text(30)} {passage} {text(20)} {passage} {text(9)}")]
    docs = spark.createDataFrame([(d, t, "c", "c") for d, t in rows], "doc_id long, text string, start string, _s_d string")
    found = by_id(substrings.repeats(docs))
    assert {*range(1, 30), 902} == set(found)
    assert all(x.owner_ids[0] == 0 for x in found.values())
    assert all(x.n_words == 60 and x.starts == [dict(rows)[d].split().index(passage.split()[0])] for d, x in found.items() if d < 900)
    assert found[902].starts == [30, 110] and found[902].ends == [90, 170]
    left = by_id(substrings.strip(docs))
    assert len(left) == len(rows) and left[0].text == rows[0][1] and left[900].text is None and left[0].start == "c"
    assert all(left[d].text.split() == t.replace(passage, "").split() for d, t in rows if 0 < d < 30 or d == 902)
    assert all(left[d].text == t for d, t in rows if 30 <= d < 900)
    assert substrings.repeats(none).count() == 0 and substrings.strip(none).count() == 0


def test_substrings_tell_rows_of_one_id_apart(spark):
    _, text = word_maker(6)
    p, b = text(60), text(70)
    rows = [(0, p), (1, f"{text(10)} {p} {text(5)}"), (1, b), (1, b), (None, f"{text(3)} {b}"), (None, text(50)), (2, None), (2, "")]
    left = [(x.doc_id, x.text) for x in substrings.strip(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    words = sorted((d if d is not None else 9, len((t or "").split())) for d, t in left)
    assert words == sorted([(0, 60), (1, 15), (1, 70), (1, 70), (9, 3), (9, 50), (2, 0), (2, 0)])


def test_texts_of_one_32_bit_hash_stay_apart(spark):
    """Two texts that Spark's 32-bit hash does not tell apart, without or with one doc_id."""
    _, text = word_maker(17)
    passage = text(50)
    seen, pair = {}, None
    table = spark.range(400_000).select(F.concat(F.lit("no"), F.col("id").cast("string"), F.lit(" ")).alias("head"))
    for k, tail in enumerate((passage, text(90), "short one")):
        for r in table.select("head", F.hash(F.concat("head", F.lit(tail))).alias("h")).collect():
            if k == 0:
                seen.setdefault(r.h, r.head)
            elif r.h in seen:
                pair = (seen[r.h] + passage, r.head + tail)
                for d in (None, 7) if k == 1 else (None,):
                    rows = [(1, passage), *((d, t) for t in pair)]
                    left = sorted(len(x.text.split()) for x in substrings.strip(spark.createDataFrame(rows, "doc_id long, text string")).collect())
                    assert left == sorted([50, 1, len(pair[1].split())])
                break
    assert pair


@pytest.mark.parametrize("n,least", [(30, 0.9), (40, 0.97), (50, 0.99)])
def test_substring_recall_by_length(spark, n, least):
    _, text = word_maker(n)
    shared = [text(n) for _ in range(300)]
    docs = spark.createDataFrame([(1000 * k + i, f"{text(40)} {p} {text(40)}") for k in (0, 1) for i, p in enumerate(shared)], "doc_id long, text string")
    found = by_id(substrings.repeats(docs))
    assert all(d >= 1000 and x.starts == [40] and x.ends == [40 + n] for d, x in found.items())
    assert len(found) >= least * 300


def test_substring_passages_stand_in_earlier_documents(spark):
    """All that is found stands whole in an earlier document, or earlier in its own, and most of what does is found, though
    these documents are made of short slices of each other, so that most anchors are owned by documents without the rest."""
    r, text = word_maker(9)
    old = text(1500).split()
    rows = []
    for d in range(80):
        made = []
        while len(made) < 150:
            at, n = r.randrange(len(old)), r.randrange(3, 70)
            made += old[at : at + n] if r.random() < 0.6 else [f"q{r.randrange(9)}" for _ in range(r.randrange(1, 9))]
        rows.append((d, " ".join(made)))
    rows += [(90, " ".join(["the cat"] * 60)), (91, " ".join(text(1).split() * 200))]
    texts = dict(rows)
    found = by_id(substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    brute_hit = got_hit = both = 0
    for d, t in rows:
        w = t.split()
        before = {tuple(e[i : i + 30]) for k in texts if k < d for e in [texts[k].split()] for i in range(len(e) - 29)}
        first = {}
        want = {j for i in range(len(w) - 29) if tuple(w[i : i + 30]) in before or first.setdefault(tuple(w[i : i + 30]), i) <= i - 30 for j in range(i, i + 30)}
        got = {j for x in [found.get(d)] if x for a, b in zip(x.starts, x.ends, strict=True) for j in range(a, b)}
        assert got <= want, d
        brute_hit, got_hit, both = brute_hit + len(want), got_hit + len(got), both + len(want & got)
    assert brute_hit > 1000 and both > 0.8 * brute_hit
    assert found[90].starts[0] >= 30 and 91 in found


def test_substrings_leave_texts_of_many_owners_chunks(spark):
    r = random.Random(8)
    lexicon = ["".join(r.choice("abcdefghij") for _ in range(17)) for _ in range(5000)]
    rows = [(i, " ".join(r.choice(lexicon) for _ in range(90))) for i in range(80)]
    parts = lambda t: [raw[a:b] for raw, e, _ in [substrings.chunk(t)] for a, b in zip(e, e[1:])]
    held = {p.strip() for _, t in rows for p in parts(t)}
    made = ""
    for _, t in rows:
        for p in parts(t)[1:-1]:
            tried = made + p.decode()
            if len(p.split()) <= 3 and all(x.strip() in held for x in parts(tried)):
                made = tried
                break
    assert len(made.split()) >= 30 and all(p.strip() in held for p in parts(made))
    docs = spark.createDataFrame([*rows, (900, made)], "doc_id long, text string")
    assert substrings.repeats(docs).count() == 0 and by_id(substrings.strip(docs))[900].text == made


def test_chunks_resist_insertions_and_cover_texts():
    r = random.Random(2)
    words = [f"y{r.randrange(10**6)}" for _ in range(500)]
    a, b = " ".join(words), " ".join(["new", "start", *words])
    pieces = lambda t: {raw[i:j] for raw, e, _ in [substrings.chunk(t)] for i, j in zip(e, e[1:])}
    assert len(pieces(a) & pieces(b)) >= 0.9 * len(pieces(a))
    for t in [x for x in odd_texts() if x]:
        raw, edges, n = substrings.chunk(t)
        assert edges[0] == 0 and edges[-1] == len(raw) and all(np.diff(edges) > 0) and n[-1] == len(brute.plain_words(t))
    naive = 0
    data = np.frombuffer(a.encode(), np.uint8)
    for c in data:
        naive = ((naive << 1) + int(substrings._GEAR[c])) % 65536
    assert substrings.gear(data)[-1] == naive


def test_decontamination_equals_brute_force(spark, both, none, sf):
    items = [(r.item_id, r.text) for r in load(spark, sf, "benchmark").collect()] + [(5001, "w1"), (5002, None), (5003, "the cat the cat the cat the cat the cat"), (5003, "Naïve, “quotes”")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = {r.doc_id: r.text for r in both.collect()}
    want = {d: brute.hits(t, items, 10) for d, t in texts.items()}
    for most in (decontaminate.MOST, 100):  # broadcast, and by a shuffle
        got = by_id(decontaminate.hits(both, bench, 10, most))
        assert {d: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for d, r in got.items()} == want
    assert any(w[4] for w in want.values())
    for most in (decontaminate.MOST, 100):
        kept = {r.doc_id for r in decontaminate.keep_clean(both, bench, 10, most).collect()}
        assert kept == {d for d, w in want.items() if not w[4]}
        assert decontaminate.hits(none, bench, 10, most).count() == 0
    assert not any(r.contaminated for r in decontaminate.hits(both, bench.limit(0)).collect())


def test_decontamination_judges_each_row(spark):
    bench = spark.createDataFrame([("x", " ".join(f"b{i}" for i in range(30)))], "item_id string, text string")
    dirty, clean = "so " + " ".join(f"b{i}" for i in range(5, 20)), "all is well here"
    docs = spark.createDataFrame([(1, dirty, "r"), (1, clean, "r"), (None, dirty, "r"), (None, clean, "r"), (1, clean, "r"), (2, None, "r")], "doc_id long, text string, _d_row string")
    for most in (decontaminate.MOST, 1):
        kept = decontaminate.keep_clean(docs, bench, 10, most)
        assert kept.columns == docs.columns
        assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == [(-1, clean), (1, clean), (1, clean), (2, "")]
        assert sorted((r.doc_id or -1, r.n_hit) for r in decontaminate.hits(docs, bench, 10, most).collect()) == [(-1, 0), (-1, 15), (1, 0), (1, 0), (1, 15), (2, 0)]


def test_packing_holds_every_id_once(both, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    want = {r.doc_id: plain.encode(r.text or "", add_special_tokens=False).ids + [1] for r in both.collect()}
    pieces = packing.pack(both, path).collect()
    seen, seqs = {}, {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        ids = np.frombuffer(bytes(p.ids), "<u4").tolist()
        assert len(ids) == p.length and p.start == len(seen.setdefault(p.doc_id, [])) and p.doc_tokens == len(want[p.doc_id])
        seen[p.doc_id] += ids
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert seen == want
    padding = 0
    for spots in seqs.values():
        end = 0
        for o, n in sorted(spots):
            assert o == end
            end += n
        assert end <= 2048
        padding += 0 if end & (end - 1) == 0 else 2048 - end
    assert padding == 0
    assert packing.pack(none, path).count() == 0
    odd_ids = both.sparkSession.createDataFrame([(None, "a b"), (7, "c"), (7, "c"), (7, None)], "doc_id int, text string").coalesce(1)
    made = packing.pack(odd_ids, path)
    assert dict(made.dtypes)["doc_id"] == "int" and sorted((p.doc_id or 0, p.length) for p in made.collect()) == [(0, 3), (7, 1), (7, 2), (7, 2)]


def test_packing_equals_a_plain_search():
    """Descending rests each go to the cheapest sequence with room, and are cut over the emptiest only where none has."""
    r = random.Random(3)
    lengths = [r.choice([r.randrange(1, 300), r.randrange(1, 20)]) for _ in range(400)]
    made = packing.plan(lengths, 128)
    whole = sum(n // 128 for n in lengths)
    room = {s: 0 for *_, s, _ in made if s >= whole}
    for *_, n, s, _ in made:
        if s >= whole:
            room[s] += n
    spent, at, want = dict.fromkeys(room, 0.0), dict.fromkeys(room, 0), []
    for n, d in sorted(((n % 128, d) for d, n in enumerate(lengths) if n % 128), key=lambda x: (-x[0], x[1])):
        fits, start = [s for s in room if room[s] - at[s] >= n], lengths[d] // 128 * 128
        while n:
            s = min(fits, key=lambda s: (spent[s], s)) if fits else max(room, key=lambda s: (room[s] - at[s], -s))
            k = min(n, room[s] - at[s])
            want.append((d, start, k, s, at[s]))
            at[s], spent[s], start, n = at[s] + k, spent[s] + packing.cost(k), start + k, n - k
    assert [x for x in made if x[3] >= whole] == want


def test_packing_balances_cost():
    r = random.Random(0)
    lengths = [r.randrange(1, 1500) for _ in range(3000)]
    made = packing.plan(lengths, 2048)
    spent = {}
    for _, _, n, s, _ in made:
        spent[s] = spent.get(s, 0) + packing.cost(n)
    costs = np.array([c for s, c in spent.items()])
    assert costs.std() / costs.mean() < 0.35
    assert sum(n for _, _, n, _, _ in made) == sum(lengths)


def test_chat_round_trip(spark, none):
    same = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 1, "assistant", same), (1, 0, "user", same), (2, 0, None, None), (2, 1, "assistant", "a\\|b <\\|x \\\\ \n é🙂"), (2, 2, "assistant", "<|<|"), (3, 0, "odd\nro\\nle", "t"), (None, 0, "user", "x")]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_records(chat.as_records(docs))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c in (1, 2, 3, None):  # the only row without a conv_id
        turns = [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == c), key=lambda x: x[1])]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    assert chat.read_back(chat.format_records(chat.as_records(docs.limit(0)))).count() == 0


RECORDS = [
    ({"messages": [{"role": "human", "content": "a"}, {"role": "assistant", "content": None}]}, [("human", "a"), ("assistant", "")]),
    ({"messages": [{"role": "user", "content": "a", "name": "Kim"}, {"content": "b", "role": "assistant"}]}, [("user", "a"), ("assistant", "b")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, [("user", "a"), ("assistant", "b")]),
    ({"turns": [{"speaker": "bot", "text": "<|x"}, {"speaker": "user", "text": 3}]}, [("assistant", "<|x"), ("user", "3")]),
    ({"completion": "y", "prompt": "x"}, [("user", "x"), ("assistant", "y")]),
    ({"response": "y", "prompt": "x"}, [("user", "x"), ("assistant", "y")]),
    ({"response": "y", "prompt": "x", "system": "s"}, [("system", "s"), ("user", "x"), ("assistant", "y")]),
    ({"question": "q", "answer": None}, [("user", "q"), ("assistant", "")]),
    ({"question": "q", "answer": "r", "context": "c"}, [("user", "c\n\nq"), ("assistant", "r")]),
    ({"instruction": "do", "output": "done"}, [("user", "do"), ("assistant", "done")]),
    ({"instruction": "do", "input": "this", "output": "done"}, [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"system": "s", "instruction": "do", "input": "", "output": "done"}, [("system", "s"), ("user", "do"), ("assistant", "done")]),
    ({"prompt": [{"role": "user", "content": "p"}], "completion": [{"role": "assistant", "content": "c"}]}, [("user", "p"), ("assistant", "c")]),
]


def test_chat_layouts(spark):
    import json

    bad = [None, "", "no json", "[1, 2]", "3", "{}", '{"messages": []}', '{"unknown": 1}', '{"messages": [{"role": "user", "content": "a"}, 3]}', '{"prompt": "x"}']
    rows = [(i, json.dumps(r)) for i, (r, _) in enumerate(RECORDS)] + [(100 + i, b) for i, b in enumerate(bad)] + [(None, bad[0])]
    made = chat.format_records(spark.createDataFrame(rows, "conv_id long, record string"))
    got = {r.conv_id: r for r in made.collect()}
    for i, (_, turns) in enumerate(RECORDS):
        assert got[i].problem is None and chat.parse(got[i].formatted) == turns
        assert [got[i].formatted[m.start : m.end] for m in got[i].mask] == [chat.escape(t) for r, t in turns if r == "assistant"]
    assert len({got[i].fingerprint for i in range(len(RECORDS))}) == len(RECORDS)
    assert all(got[100 + i].problem and got[100 + i].formatted is None and got[100 + i].fingerprint for i in range(len(bad)))
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert all(back[100 + i].n_turns == 0 and back[100 + i].formatted_chars == 0 for i in range(len(bad))) and len(back) == len({k for k, _ in rows})


def test_no_record_ends_the_job(spark):
    import json

    r = random.Random(11)
    names = ["messages", "messages[]", "messages[].role", "role", "content", "prompt", "completion", "conversations[].from", "from", "value", "", "a.b", '"', "\n"]

    def value(depth):
        kind = r.randrange(6 if depth < 4 else 4)
        if kind < 4:
            return r.choice([None, 3, True, "x", "\ud800", "<|im_end|>", 1e300])
        return [value(depth + 1) for _ in range(r.randrange(4))] if kind == 4 else {r.choice(names): value(depth + 1) for _ in range(r.randrange(5))}

    bad = [json.dumps({"messages[].role": "x", "messages[].content": "y"}), json.dumps({"messages": [{"role": "user", "content": "\ud800"}]}), "[" * 200_000 + "]" * 200_000, '{"a":' * 200_000 + "1" + "}" * 200_000, json.dumps({"prompt": "p", "completion": "c", "completion.x": 1})]
    rows = [(i, t) for i, t in enumerate([*bad, *(json.dumps(value(0)) for _ in range(1500))])]
    made = chat.format_records(spark.createDataFrame(rows, "conv_id long, record string"))
    got = {x.conv_id: x for x in made.collect()}
    assert len(got) == len(rows) and all(got[i].problem for i in range(len(bad)))
    assert all((x.problem is None) == (x.formatted is not None) for x in got.values()) and chat.read_back(made).count() == len(rows)


def test_chat_layouts_keep_roles_and_lone_rows(spark):
    rows = [(c, t, r, f"{c} {t} {r}") for c in range(30) for t, r in enumerate(["user", "assistant", "gpt"] if c % 5 == 0 else ["system", "user", "assistant"])] + [(None, 0, "user", "x"), (None, 0, "user", "x"), (None, 1, "assistant", None)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    records = chat.as_records(docs, ("messages", "conversations", "turns"))
    made = chat.format_records(records).collect()
    assert len({m.fingerprint for m in made}) == 3 and len(made) == 33
    assert all(chat.parse(m.formatted) == [(r, x) for c, _, r, x in rows if c == m.conv_id] for m in made if m.conv_id is not None)


def test_store_round_trip(spark, both, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = sorted((r.doc_id, r.text) for r in both.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect())
    want, at = {}, 0
    for d, t in texts:
        ids = plain.encode(t, add_special_tokens=False).ids + [2]
        want[d] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    to = new_path(spark, "store")
    store.write(both, to, path)
    got = by_id(store.read(spark, to).withColumn("crc", F.crc32("ids")))
    assert {d: (r.start, r.n_tokens, r.crc) for d, r in got.items()} == want
    chunks = spark.read.parquet(f"{to}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    empty = new_path(spark, "store")
    store.write(none, empty, path)
    assert store.read(spark, empty).count() == 0
    again = new_path(spark, "store")
    store.write(spark.createDataFrame([(None, "a"), (3, "b c"), (3, "a"), (3, None)], "doc_id long, text string"), again, path)
    assert sorted((r.doc_id or 0, r.start, r.n_tokens) for r in store.read(spark, again).collect())[0] == (0, 0, 2)
    assert sorted(r.n_tokens for r in store.read(spark, again).collect()) == [1, 2, 2, 3]


@pytest.mark.parametrize("table", ["chunks", "recipes", "manifest", "head"])
@pytest.mark.parametrize("change", ["lost", "twice", "changed", "more"])
def test_store_notices_damage(spark, odd, table, change):
    to = new_path(spark, "store")
    store.write(odd, to, public_tokenizers.path("word_bpe_49k.json"))
    held = spark.read.parquet(f"{to}/{table}")
    rows = held.collect()
    if change == "lost":
        rows = rows[1:]
    elif change == "twice":
        rows = [*rows, rows[0]]
    elif change == "more":
        if table != "chunks":
            return
        rows = [*rows, type(rows[0])(digest=store.digest(b"xy"), data=b"xy")]
    else:
        field = {"chunks": "digest", "recipes": "root", "manifest": "root", "head": "root"}[table]
        rows = [r if i else type(r)(*(b"0" * 16 if f == field else r[f] for f in held.columns)) for i, r in enumerate(rows)]
    spark.createDataFrame(rows, held.schema).write.mode("overwrite").parquet(f"{to}/{table}")
    with pytest.raises(Exception, match="damaged|another length"):
        store.read(spark, to).count()


def test_store_brings_unshared_chunks_home_at_once(spark, both):
    """Each chunk is held once; one that stands in one place is with its document's number, and is not looked up by digest."""
    to = new_path(spark, "store")
    store.write(both, to, public_tokenizers.path("word_bpe_49k.json"))
    own, chunks, recipes = (spark.read.parquet(f"{to}/{t}") for t in ("own", "chunks", "recipes"))
    places = Counter((r.home, bytes(d)) for r in recipes.collect() for d in r.digests)
    often = Counter(d for (_, d), n in places.items() for _ in range(n))
    alone = {(h, d) for h, d in places if often[d] == 1}
    assert alone and {(r.home, bytes(r.digest)) for r in own.collect()} == alone and own.count() == len(alone)
    assert sorted(bytes(r.digest) for r in chunks.collect()) == sorted(d for d, n in often.items() if n > 1)


@pytest.mark.parametrize("change", ["lost", "twice", "data", "home", "none"])
def test_store_notices_damage_to_own_chunks(spark, odd, change):
    to = new_path(spark, "store")
    store.write(odd, to, public_tokenizers.path("word_bpe_49k.json"))
    held = spark.read.parquet(f"{to}/own")
    rows = held.collect()
    a, b = rows[:2]
    new = {"lost": [], "twice": [a, a], "data": [Row(home=a.home, digest=a.digest, data=b.data)], "home": [Row(home=b.home, digest=a.digest, data=a.data)], "none": [Row(home=None, digest=a.digest, data=a.data)]}
    spark.createDataFrame(new[change] + rows[1:], held.schema).write.mode("overwrite").parquet(f"{to}/own")
    with pytest.raises(Exception, match="damaged"):
        store.read(spark, to).count()


def test_chunks_of_streams_laid_together_are_those_of_each_alone():
    dice = np.random.default_rng(3)
    streams = [dice.integers(0, 49_408, n).astype("<u4") for n in (1, 15, 16, 17, 70, 20_000, 1, 3000)] + [np.full(9000, 5, "<u4"), np.full(1, 2, "<u4")]
    together = list(store.cuts(np.concatenate(streams), [len(x) for x in streams]))
    assert together == [e for x in streams for e in store.cuts(x, [len(x)])] and all(e[-1] == len(x) for e, x in zip(together, streams, strict=True))
    for x, ends in zip(streams, together, strict=True):
        hashes = [sum(int(store._mixed(x[i - k : i - k + 1])[0]) << k for k in range(min(i + 1, 16))) % (1 << 16) for i in range(len(x))]
        low = {i + 1 for i, h in enumerate(hashes) if h < (1 << 16) // store.MEAN}
        assert all(e in low or e - s == store.MOST or e == len(x) for s, e in zip([0, *ends], ends, strict=False))


def test_known_runs_are_not_split_again(monkeypatch):
    code = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    text = "Some words, it's\tthe 2nd 'version of cafés... (x2)\n"
    first, plain = code.encode([text]), code.units.whole.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(first[0], "<u4").tolist() == plain
    monkeypatch.setattr(tokens, "_PLAIN", None)
    monkeypatch.setattr(code, "split", lambda text: 1 / 0)
    code.units.clear()
    assert code.encode([text.upper(), text]) == first * 2


def test_store_width_follows_the_vocabulary(spark, odd):
    path, to = public_tokenizers.path("word_bpe_49k.json"), new_path(spark, "store")
    store.write(odd, to, path, end_id=1 << 20)
    assert spark.read.parquet(f"{to}/head").first().width == 4
    assert all(np.frombuffer(bytes(r.ids), "<u4")[-1] == 1 << 20 for r in store.read(spark, to).collect())


def test_toxicity_on_held_out_rows(spark, sf):
    sf = sf.replace("0.001", "0.01")
    got = by_id(queries.op1_toxicity(spark, sf))
    labels = {r.doc_id: r.toxic for r in load(spark, sf, "labels").collect()}
    held = [(got[d].score, y) for d, y in labels.items() if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for d, r in got.items())
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([[(p > n) + 0.5 * (p == n) for n in neg] for p in pos])
    assert auc > 0.85, auc
    assert sum(not r.evidence_ids for r in got.values()) < 0.05 * len(got)
    # The whole query against a plain scan of all examples.
    docs, rows = load(spark, sf, "documents"), load(spark, sf, "labels").where(~toxicity.held_out())
    index = toxicity.fit(docs, rows)
    texts, ids = {r.doc_id: r.text for r in docs.collect()}, index.ids.tolist()
    assert sorted(ids) == sorted(r.doc_id for r in rows.collect())
    vectors = []
    for d in ids:
        c, w = index.vector({t: n for t, n in Counter(toxicity.words(texts[d])).items()})
        vectors.append(dict(zip(c.tolist(), w.tolist())))
    for d in list(texts)[:150]:
        c, w = index.vector(Counter(toxicity.words(texts[d])))
        full = np.array([sum(x * v.get(t, 0.0) for t, x in zip(c.tolist(), w.tolist())) for v in vectors])
        k = np.sort(full)[-toxicity.NEIGHBOURS]
        spot = np.flatnonzero(full >= max(k - 1e-9, 1e-12))
        assert abs(index.calibrated(index.vote(spot, full[spot])) - got[d].score) < 1e-6


def test_neighbours_equal_full_scan(monkeypatch):
    r = random.Random(4)
    names = [f"t{i}" for i in range(60)]
    examples = [(i, r.randrange(2), {w: r.randrange(1, 4) for w in r.sample(names, r.randrange(0, 9))}) for i in range(900)]
    monkeypatch.setattr(toxicity, "FREQUENT", 20)
    index = toxicity.build(examples, {w: r.randrange(1, 200) for w in names}, 1000)
    dense = np.zeros((900, len(index.names)))
    for i, d in enumerate(index.ids.tolist()):
        c, w = index.vector(examples[d][2])
        dense[i, c] = w
    for n in range(100):
        c, w = index.vector({x: 1 for x in r.sample(names, 4)})
        but = n if n % 2 else -1
        full = dense[:, c] @ w
        if but >= 0:
            full[but] = 0
        spot, sim = index.neighbours([(c, w)], but=[but] if but >= 0 else None)[0]
        least = np.sort(full)[-toxicity.NEIGHBOURS]
        assert spot.tolist() == np.flatnonzero((full >= least - 1e-9) & (full > 1e-9)).tolist()
        assert np.allclose(full[spot], sim)


def test_toxicity_of_odd_and_empty(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (999, 1), (3, None)], "doc_id long, toxic int")
    for docs in (odd, none):
        index = toxicity.fit(docs, labels)
        assert toxicity.score(docs, index).count() == docs.count()
    twice = spark.createDataFrame([(1, "bad words here"), (1, "a good day"), (2, "bad bad"), (None, "bad"), (3, None)], "doc_id long, text string")
    scores = [sorted((r.doc_id or 0, r.score) for r in toxicity.score(twice, toxicity.fit(twice.repartition(n), labels)).collect()) for n in (1, 4)]
    assert scores[0] == scores[1] and all(0 <= x <= 1 for _, x in scores[0])


def test_lm_prefers_corpus_order(spark, sf, none, odd):
    docs = load(spark, sf.replace("0.001", "0.01"), "documents").repartition(4)
    vocab = lm.vocabulary(docs)
    net = lm.train(docs, vocab, 100_000)
    loss = {}
    for k, n in (("trained", net), ("unigrams", lm.initial(len(vocab.share)))):
        got = [r for r in lm.score(docs, vocab, n).collect() if r.n_words]
        loss[k] = -sum(r.sum_log_prob for r in got) / sum(r.n_words for r in got)
    assert loss["trained"] < loss["unigrams"] - 0.1
    other = docs.repartition(7)
    again = lm.train(other, lm.vocabulary(other), 100_000)
    assert all((a == b).all() for a, b in zip(net, again, strict=True))
    # Sums by document, one word at a time, with the exact normalizer over all ids beside the estimate of it.
    scores, errors = by_id(lm.score(docs, vocab, net)), []
    for r in docs.orderBy("doc_id").limit(12).collect():
        ids = vocab.encode(lm.words_of(r.text))
        c = lm.contexts(ids)
        assert abs(sum(float(lm.conditional(vocab, net, c[i : i + 1], ids[i : i + 1])[0]) for i in range(len(ids))) - scores[r.doc_id].sum_log_prob) < 1e-3 * max(1, len(ids))
        _, h = lm.hidden(net, c[:40])
        every = np.log(np.exp(h @ net[3].T) @ vocab.share)
        errors += (np.log(vocab.share[ids[:40]]) + np.einsum("ij,ij->i", h, net[3][ids[:40]]) - every + vocab.log_in[ids[:40]] - lm.conditional(vocab, net, c[:40], ids[:40])).tolist()
    assert abs(np.mean(errors)) < 0.2 and np.std(errors) < 0.2
    for few in (none, odd, odd.unionByName(odd).withColumn("doc_id", F.lit(None).cast("long"))):
        v = lm.vocabulary(few)
        got = lm.score(few, v, lm.train(few, v)).collect()
        assert len(got) == few.count() and all((r.mean_log_prob is None) == (r.n_words == 0) for r in got)


def test_lm_context_tells_words_apart(spark):
    r = random.Random(6)
    fill = lambda k: [f"f{r.randrange(120)}" for _ in range(k)]
    rows = [(i, " ".join([*fill(4), "kx" if i % 2 else "ky", f"{'ab'[i % 2]}{r.randrange(200)}", *fill(4)])) for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    vocab = lm.vocabulary(docs)
    net = lm.train(docs, vocab)
    code = lambda *w: vocab.encode([x.encode() for x in w])
    a, b = code(*(f"a{i}" for i in range(200))), code(*(f"b{i}" for i in range(200)))
    around = lambda k: np.repeat(code("f1", k, "f2", "f3")[None], 200, axis=0)
    ratio = {k: lm.conditional(vocab, net, around(k), a) - lm.conditional(vocab, net, around(k), b) for k in ("kx", "ky")}
    assert np.mean(ratio["ky"] - ratio["kx"]) > 2


def test_lm_gradients():
    g = np.random.default_rng(0)
    net = [p.astype(np.float64) + g.normal(0, 0.1, p.shape) for p in lm.initial(30)]
    c, ids, noise = g.integers(0, 30, (7, 4)), g.integers(1, 30, 7), g.integers(1, 30, 5)
    before = [p.copy() for p in net]
    lm.step(net, lm.squares(net, 1e12), c, ids, noise)  # so steps are tiny multiples of the gradient
    for k in range(4):
        move = (before[k] - net[k]) / lm.RATE * 1e6
        i = np.unravel_index(np.abs(move).argmax(), move.shape)
        losses = []
        for sign in (1, -1):
            shifted = [p.copy() for p in before]
            shifted[k][i] += sign * 1e-5
            losses.append(lm.loss(shifted, c, ids, noise))
        assert abs((losses[0] - losses[1]) / 2e-5 - move[i]) < 1e-3 * max(1e-3, abs(move[i])) + 1e-6


def test_licenses(spark, both, none, sf):
    templates = licenses.default_templates(spark)
    r = random.Random(6)
    fill = lambda n: " ".join(f"z{r.randrange(10**6)}" for _ in range(n))
    rows = [(k, f"{fill(r.randrange(0, 60))} {t} {fill(9)}", i) for i, (k, t) in enumerate(licenses.TEMPLATES)]
    docs = spark.createDataFrame([(i, t, "q", "q") for _, t, i in rows], "doc_id long, text string, license string, h string")
    got = {}
    for x in licenses.scan(docs, templates).collect():
        got.setdefault(x.doc_id, set()).add(x.license)
    assert all(k in got[i] for k, _, i in rows)
    real = by_id(licenses.scan(both, templates))
    lines = {d.doc_id for d in both.collect() if any(s in (d.text or "") for s in ("Licensed under", "is licensed under", "Released under the MIT License"))}
    assert lines == set(real)
    assert licenses.scan(none, templates).count() == 0
    notice = licenses.TEMPLATES[2][1]
    twice = spark.createDataFrame([(1, notice), (1, "x"), (1, notice), (None, notice), (None, "x"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.license, r.n_places) for r in licenses.scan(twice, templates).collect()) == [(0, "Apache-2.0", 1), (1, "Apache-2.0", 1), (1, "Apache-2.0", 1)]
    bsd = max((x for k, x in licenses.TEMPLATES if k == "BSD"), key=len).split()
    half = len(bsd) // 2
    parts = spark.createDataFrame([(None, " ".join(bsd[:half])), (None, " ".join(bsd[half:])), (7, " ".join(bsd[:half])), (7, " ".join(bsd[half:]))], "doc_id long, text string")
    alone = [len({(r.license, r.template_id) for r in licenses.scan(parts.where(w), templates).collect()}) for w in ("doc_id = 7", "doc_id is null")]
    assert alone[0] == alone[1] and all(r.template_id != licenses.TEMPLATES.index(("BSD", " ".join(bsd))) for r in licenses.scan(parts, templates).collect())


def test_short_licenses_between_long_ones(spark):
    short = [(k, x) for k, x in licenses.TEMPLATES if len(x.split()) < 12]
    long = [(k, x) for k, x in licenses.TEMPLATES if len(x.split()) > 20]
    rows, want = [], {}
    for k, x in short:
        others = [y for other, y in long if other != k]
        for n in range(16):
            want[len(rows)] = k
            rows.append((len(rows), f"{'pad ' * n}{others[n % len(others)]} {x} {others[(n + 1) % len(others)]}"))
    got = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.default_templates(spark)).collect()}
    assert set(want.items()) <= got


def test_queries_equal_sql(spark, sf):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name, text in queries.oracle_sql().items():
        want, got = db.execute(text).df(), queries.queries()[name](spark, sf).toPandas()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        key = [c for c in ("doc_id", "conv_id", "license") if c in columns]
        assert got[columns].sort_values(key, ignore_index=True).equals(want[columns].sort_values(key, ignore_index=True)), name


def test_pipeline_on_odd_tables(spark, both, none, sf):
    """Each stage against what it promises: its columns, what goes and what stays, and the packed tokens of what is left."""
    import corpus_pipeline

    _, text = word_maker(12)
    again = both.where("doc_id < 40").withColumn("text", F.concat("text", F.lit(" the end of it")))
    lone = spark.createDataFrame([(None, f"the and of {text(40)} in that", "en", None, 1), (None, None, None, None, None), (5, "the of and " + "very long words in the text " + text(30_000), "en", "s", 3)], SCHEMA)
    whole = both.unionByName(again).unionByName(lone).withColumn("key", F.lit(1)).withColumn("_s_text", F.lit("x")).withColumn("_n_id", F.lit(2))
    for docs in (whole, none):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            made = stage(spark, docs, sf)
            assert made.columns == docs.columns
            docs = spark.createDataFrame(made.collect(), made.schema)
            assert docs.count() <= n
            n = docs.count()
            texts = [(r.doc_id, r.text) for r in docs.collect()]
            if name == "quality_rules":
                assert all(not brute.base_measures(t)[-1] for _, t in texts)
            elif name == "near_dedup":
                ids = {d: t for d, t in texts if d is not None and sum(d == e for e, _ in texts) == 1}
                assert all(d == c for d, (_, c) in brute.components(ids, 5, 80).items())
            elif name == "decontaminate":
                items = [(r.item_id, r.text) for r in load(spark, sf, "benchmark").collect()]
                assert not any(brute.hits(t, items, 10)[4] for _, t in texts)
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
        plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        assert sum(p.length for p in pieces) == sum(len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts)
        assert (n == 0) == (not pieces)
