"""Exact token ids at the speed of a unit cache.

Both tokenizers split a text by a fixed pattern and merge within the units found. For texts of Latin-1 and common
punctuation alone, whose letters, digits and spaces Python and the tokenizers class alike, the same pattern splits here,
and a bounded cache from unit to ids replaces most merges; the library's merge model takes new units. Where units never hold
a space, a second such cache knows whole runs between spaces, so that the pattern splits new runs only. Any other text,
or one with the start of a control string, goes through the whole tokenizer. Null texts count as empty.
"""

from __future__ import annotations

import os
import re

#: A character beyond Latin-1 and common punctuation, or one that is a space to one side only.
_OTHER = re.compile("[^\\t\\n\\r -~\xa1-\xff‐-‧‰-›€]")
#: The bytes of Latin-1 that _OTHER lets pass.
_USUAL = bytes(b for b in range(256) if not _OTHER.match(chr(b)))
_L, _N = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: The tokenizers' own patterns, over these classes. In the first, a unit carries the space before it.
_SPACED = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
_PLAIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")


class _Visible(dict):
    """Character -> the visible characters that stand for its UTF-8 bytes."""

    def __init__(self):
        from tokenizers.pre_tokenizers import ByteLevel

        self.level = ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, c: int) -> str:
        self[c] = self.level.pre_tokenize_str(chr(c))[0][0]
        return self[c]


class _Units(dict):
    """unit -> ids as little-endian unsigned 32-bit integers, found when first asked for."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.merge, self.visible = self.whole.model.tokenize, _Visible()
        self.packed = [i.to_bytes(4, "little") for i in range(self.whole.get_vocab_size())].__getitem__

    def __missing__(self, unit: str) -> bytes:
        plain = unit.isascii() and unit.isalpha()  # such letters stand for themselves
        found = self[unit] = b"".join([self.packed(t.id) for t in self.merge(unit if plain else unit.translate(self.visible))])
        return found


class _Runs(dict):
    """run between spaces, lower-cased -> ids of its units one after another; runs of over 64 characters are not kept."""

    def __init__(self, units: _Units):
        super().__init__()
        self.units = units

    def __missing__(self, run: str) -> bytes:
        head = run[:-1]
        if run.isalpha():
            found = self.units[run]
        elif head.isalpha():  # letters and one mark or digit: two units
            found = self.units[head] + self.units[run[-1]]
        else:
            found = b"".join(map(self.units.__getitem__, _PLAIN.findall(run)))
        if len(run) <= 64:
            self[run] = found
        return found


#: A text of all kinds of units, on which a way of splitting must agree with the tokenizer itself.
PROBE = "It's  we'LL 'S naïve CAFÉ  12 345x\t\n\n a_b c-d !!! #$%&|<> “quoted” — ½ µ\u00aa \n\r\n  x  "


class Encoder:
    """A tokenizer file's ids. Of the two ways of splitting (byte-level, with the space before a unit; lower-cased, without
    spaces) that one is taken which gives the tokenizer's own ids on PROBE; if none does, every text goes through the tokenizer."""

    most_cached, most_runs = 300_000, 600_000

    def __init__(self, path: str):
        self.units = _Units(path)
        self.runs = _Runs(self.units)
        self.largest = max(self.units.whole.get_vocab(with_added_tokens=True).values())
        self.controls = [t.content for t in self.units.whole.get_added_tokens_decoder().values() if "<|" not in t.content]
        self.split, self.lower = None, False
        ways = ((_SPACED.findall, False), (_PLAIN.findall, True))
        found = [w for w in ways if self._split(PROBE, *w) == self._whole(PROBE)]
        if found:
            self.split, self.lower = found[0]
        if self.lower:
            self.most_cached = self.most_runs

    def _whole(self, text: str) -> bytes:
        return b"".join(map(self.units.packed, self.units.whole.encode(text, add_special_tokens=False).ids))

    def _split(self, text: str, split, lower: bool) -> bytes:
        if lower:
            return b"".join(map(self.runs.__getitem__, text.lower().split()))
        return b"".join(map(self.units.__getitem__, split(text)))

    @staticmethod
    def _usual(text: str) -> bool:
        try:
            return not text.encode("latin-1").translate(None, _USUAL)
        except UnicodeEncodeError:
            return not _OTHER.search(text)

    def _ids(self, text: str) -> bytes:
        if self.split is None or "<|" in text or any(c in text for c in self.controls) or not self._usual(text):
            return self._whole(text)
        return self._split(text, self.split, self.lower)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.units) > self.most_cached:
            self.units.clear()
        if len(self.runs) > self.most_runs:
            self.runs.clear()
        return [self._ids(t or "") for t in texts]


_made: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]
