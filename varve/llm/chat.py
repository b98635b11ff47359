"""Chat formatting by schema fingerprints.

A record is a JSON object in any layout. Its fingerprint is a hash of its sorted nested field paths (lists count as
``[]``), and selects a declarative mapping of the layout to canonical turns (role, text). A turn is written as
``<|im_start|>role\\n`` text ``<|im_end|>\\n``; inside texts and roles a backslash is doubled and one is put into each
``<|`` or its escaped forms, so control strings never occur there and the original comes back exactly. The loss mask
is a list of (start, end) code points of the formatted text: the assistant's texts.

A mapping's optional fields may be there or not: each combination has a fingerprint. Null texts count as empty, null
roles as empty names. A record that has no mapping (unknown fields, an empty list, no JSON object, null), is nested too deeply or has half of a
surrogate pair in a text or role gets the
fingerprint of the fields it has, a ``problem``, no formatted text and an empty mask; reading it back gives no turns.

Of a conversations table, turns are ordered by turn, then role and text, nulls first; repeated rows are repeated turns.
Rows without a conv_id belong to nothing known: each is a conversation of its own.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import combinations
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

START, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)

#: Names of roles in layouts whose lists name speakers.
SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

#: Layouts: for each, the field paths that it has, optional ones, and how turns are read. A list mapping names the list and
#: the fields of role and text, and how roles are renamed; a fixed mapping names (role, fields joined by a blank line) for each turn.
LAYOUTS: list[dict[str, Any]] = [
    {"name": "messages", "paths": ["messages[].role", "messages[].content"], "optional": ["messages[].name"], "list": ("messages", "role", "content"), "roles": {}},
    {"name": "conversations", "paths": ["conversations[].from", "conversations[].value"], "list": ("conversations", "from", "value"), "roles": SPEAKERS},
    {"name": "turns", "paths": ["turns[].speaker", "turns[].text"], "list": ("turns", "speaker", "text"), "roles": SPEAKERS},
    {"name": "completion", "paths": ["prompt", "completion"], "turns": [("user", ["prompt"]), ("assistant", ["completion"])]},
    {"name": "response", "paths": ["prompt", "response"], "optional": ["system"], "turns": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]},
    {"name": "answer", "paths": ["question", "answer"], "optional": ["context"], "turns": [("user", ["context", "question"]), ("assistant", ["answer"])]},
    {"name": "instruction", "paths": ["instruction", "output"], "optional": ["input", "system"], "turns": [("system", ["system"]), ("user", ["instruction", "input"]), ("assistant", ["output"])]},
    {"name": "nested", "paths": ["prompt[].role", "prompt[].content", "completion[].role", "completion[].content"], "lists": ["prompt", "completion"], "list": ("", "role", "content"), "roles": {}},
]


def _key(name: str) -> str:
    """A field's name in a path; one with the path's own marks is quoted, so that no two layouts have the same paths."""
    return json.dumps(name) if re.search(r'[.\[\]"\n]', name) or not name else name


def field_paths(value: Any) -> set[str]:
    found, todo = set(), [(value, "")]
    while todo:
        value, at = todo.pop()
        if isinstance(value, dict):
            todo += ((v, f"{at}.{_key(k)}" if at else _key(k)) for k, v in value.items())
        elif isinstance(value, list):
            todo += ((v, at + "[]") for v in value)
        else:
            found.add(at)
    return found


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def _mappings() -> dict[str, dict[str, Any]]:
    out = {}
    for x in LAYOUTS:
        for n in range(len(x.get("optional", [])) + 1):
            for more in combinations(x.get("optional", []), n):
                out[fingerprint({*x["paths"], *more})] = x
    return out


MAPPINGS = _mappings()


def _text(value: Any) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


_LONE = re.compile("[\ud800-\udfff]")


def turns_of(record: str | None) -> tuple[str, list[tuple[str, str]], str | None]:
    """The record's fingerprint, its canonical turns, and what kept it from having any."""
    key, turns, problem = _turns_of(record)
    if any(_LONE.search(x) for turn in turns for x in turn):  # no text in UTF-8
        return key, [], "half of a surrogate pair"
    return key, turns, problem


def _turns_of(record: str | None) -> tuple[str, list[tuple[str, str]], str | None]:
    try:
        value = json.loads(record) if record is not None else None
    except ValueError:
        return fingerprint(set()), [], "no JSON"
    except RecursionError:
        return fingerprint(set()), [], "nested too deeply"
    if not isinstance(value, dict):
        return fingerprint(field_paths(value) if isinstance(value, list) else set()), [], "null" if value is None else "no object"
    key = fingerprint(field_paths(value))
    mapping = MAPPINGS.get(key)
    if mapping is None:
        return key, [], "no mapping for these fields" if field_paths(value) else "no fields"
    if "list" in mapping:
        name, role, text = mapping["list"]
        lists = [value.get(k) for k in mapping.get("lists", [name])]
        if not all(isinstance(x, list) for x in lists):
            return key, [], "turns are no list"
        rows = [t for x in lists for t in x]
        if not all(isinstance(t, dict) for t in rows):
            return key, [], "a turn is no object"
        roles = [_text(t.get(role)) for t in rows]
        return key, [(mapping["roles"].get(r, r), _text(t.get(text))) for r, t in zip(roles, rows, strict=True)], None
    made = [(role, [f for f in fields if f in value]) for role, fields in mapping["turns"]]
    return key, [(role, "\n\n".join(x for x in (_text(value[f]) for f in fields) if x)) for role, fields in made if fields], None


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and its loss mask."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body, tail = f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n", escape(text), f"{END}\n"
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, tail]
        at += len(head) + len(body) + len(tail)
    return "".join(parts), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(re.sub(r"(?<!\\)((?:\\\\)*)\\n", r"\1\n", role)), unescape(text)) for role, text in _TURN.findall(formatted)]


def as_records(conversations: DataFrame, layouts: tuple[str, ...] = ("messages",)) -> DataFrame:
    """(conv_id, record): each conversation as a JSON object in one of the named list layouts, dealt out by conv_id.

    Layouts that rename roles keep only those that they don't rename: a conversation with another is given as messages."""
    own = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1)).alias("own")
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    rows = conversations.select("conv_id", own, turn.alias("t"))
    grouped = rows.groupBy("conv_id", "own").agg(F.sort_array(F.collect_list("t")).alias("rows"))
    known = {x["name"]: x for x in LAYOUTS}

    def json_in(name: str) -> Column:
        at, role, text = known[name]["list"]
        return F.to_json(F.struct(F.transform("rows", lambda r: F.struct(r["role"].alias(role), r["content"].alias(text))).alias(at)))

    record = json_in("messages")
    dealt = F.pmod(F.xxhash64("conv_id"), F.lit(len(layouts)))
    renamed = F.exists("rows", lambda r: r["role"].isin(list(SPEAKERS)))
    for i, name in enumerate(layouts):
        record = F.when((dealt == i) & ~(renamed & F.lit(bool(known[name]["roles"]))), json_in(name)).otherwise(record)
    return grouped.select("conv_id", record.alias("record"))


def format_records(records: DataFrame) -> DataFrame:
    """(conv_id, record) -> conv_id, fingerprint, formatted, mask (array of start and end), problem."""

    def f(x: dict) -> Iterator[dict]:
        got = [turns_of(r) for r in x["record"]]
        made = [render(t) for _, t, _ in got]
        yield {"conv_id": x["conv_id"], "fingerprint": [g[0] for g in got], "formatted": [None if g[2] else m[0] for g, m in zip(got, made, strict=True)], "mask": [[{"start": a, "end": b} for a, b in m[1]] for m in made], "problem": [g[2] for g in got]}

    return map_arrow(records.select("conv_id", "record"), "conv_id long, fingerprint string, formatted string, mask array<struct<start:int,end:int>>, problem string", f)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted texts and masks say: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def f(x: dict) -> Iterator[dict]:
        texts = [t or "" for t in x["formatted"]]
        turns = [parse(t) for t in texts]
        loss = ["".join(unescape(t[m["start"] : m["end"]]) for m in mask or []) for t, mask in zip(texts, x["mask"], strict=True)]
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        yield {
            "conv_id": x["conv_id"], "n_turns": [len(t) for t in turns], "turns_sha256": [sha("".join(f"{r}\n{s}\n" for r, s in t)) for t in turns],
            "loss_chars": [len(s) for s in loss], "loss_sha256": [sha(s) for s in loss], "formatted_chars": [len(t) for t in texts],
        }

    return map_arrow(formatted, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long", f)
