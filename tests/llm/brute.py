"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import defaultdict

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingle_set(text, size):
    w = plain_words(lower(text))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def components(texts, size, percent):
    """{id: (n, component)} from {id: text}, all pairs."""
    sets = {d: shingle_set(t, size) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    met = defaultdict(int)
    for ids in holders.values():
        for i, a in enumerate(ids):
            for b in ids[:i]:
                met[a, b] += 1
    for (a, b), both in met.items():
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(sets[d]), find(d)) for d in texts}


def hits(text, items, size):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    places = defaultdict(list)
    lengths = set()
    windows = {}
    for k, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        windows[k] = windows.get(k, set()) | ({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
        lengths |= {len(x) for x in windows[k]}
    for n in lengths:
        for i in range(len(words) - n + 1):
            places[tuple(words[i : i + n])].append(i)
    hit, found = set(), set()
    for k, ws in windows.items():
        for w in ws:
            for i in places.get(w, ()):
                hit.update(range(i, i + len(w)))
                found.add(str(k))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def base_measures(text):
    text = text or ""
    words = plain_words(text)
    lines = [x for x in text.split("\n") if plain_words(x)]
    seen = defaultdict(list)
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])].append(i)
    hit = {j for spots in seen.values() if len(spots) > 1 for i in spots for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), len(words) < 20 or 100 * len(hit) > 30 * len(words)


def ratios(text):
    """Of words: mean length, symbols, exclamation marks and stop words; of lines: repeats."""
    import regex

    from varve.llm.quality import STOP_WORDS

    text = text or ""
    words, lines = plain_words(text), [x for x in text.split("\n") if plain_words(x)]
    stops = sum(w in STOP_WORDS for w in plain_words(regex.sub(r"[^\p{L}\p{N} \t\n\x0b\f\r]", "", text.lower())))
    n = len(words)
    share = lambda x, y: x / y if y else 0.0
    return share(sum(map(len, words)), n), share(sum(text.count(c) for c in "#*$%&|<>"), n), share(text.count("!"), n), share(stops, n), share(len(lines) - len(set(lines)), len(lines))
