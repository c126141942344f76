"""Surfaces that stand in a text, found by their rarest or first word, for workers that hold all surfaces."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from functools import cache

from pyspark import Broadcast

#: Surfaces that the driver and every worker may hold, some 250 bytes each.
HELD_SURFACES = 1 << 20
#: Pairs of surface and entity that they may hold, some 60 bytes each in the driver, 4 in a worker besides the names; rows of a batch of claims.
HELD_PAIRS, CLAIMED_ROWS = 1 << 21, 1 << 16

_WORD = re.compile(r"\w+")
_indexes: dict[str, tuple[list, dict[str, list[int]]]] = {}
_claims: dict[str, Claims] = {}


def index(key: str, surfaces: list) -> tuple[list, dict[str, list[int]]]:
    """The surfaces and, by word, the numbers of those of which it is the rarest. A worker keeps the last index it made."""
    if key not in _indexes:
        _indexes.clear()
        words = [_WORD.findall(s) for s in surfaces]
        n = Counter(w for ws in words for w in set(ws))
        by_word: dict[str, list[int]] = {}
        for i, ws in enumerate(words):
            if ws:
                by_word.setdefault(min(ws, key=lambda w: (n[w], w)), []).append(i)
        _indexes[key] = surfaces, by_word
    return _indexes[key]


def candidates(text: str, surfaces: list, by_word: dict[str, list[int]]) -> list[int]:
    """Numbers of the surfaces that the text holds. One that stands there between words has all its words among the text's."""
    return [i for w in set(_WORD.findall(text)) for i in by_word.get(w, ()) if surfaces[i] in text]


@cache
def odd() -> tuple[str, str]:
    """Characters that are of words for the JVM's Unicode ``\\w`` alone, and those that are for Python's alone."""
    chars = "".join(map(chr, range(sys.maxunicode + 1)))
    circled = "".join(chars[a : b + 1] for a, b in ((0x24B6, 0x24E9), (0x1F130, 0x1F149), (0x1F150, 0x1F169), (0x1F170, 0x1F189)))
    kinds = {"Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc", "Me", "Nd", "Nl", "Pc"}
    jvm = {c for c, kind in zip(chars, map(unicodedata.category, chars), strict=True) if kind in kinds} | {*circled, "\u200c", "\u200d"}
    here = {*filter(str.isalnum, chars), "_"}
    return "".join(sorted(jvm - here)), "".join(sorted(here - jvm))


class Claims:
    """Surfaces by the word they begin with, or the character where that is of none, and the lengths to try there. Words are those of the JVM, see ``odd``."""

    def __init__(self, surfaces: list[str], odd: tuple[str, str]):
        word = rf"(?:[^\W{odd[1]}]|[{odd[0]}])"
        self.numbers, self.odd = {s: i for i, s in enumerate(surfaces)}, frozenset(odd[0] + odd[1])
        within = re.compile(word)
        heads = "".join(re.escape(c) for c in sorted({s[0] for s in surfaces}) if not within.match(c))
        begin = lambda w: re.compile(rf"{w}+" + (rf"|(?<!{w})[{heads}]" if heads else ""))
        # Python's own class is the faster one, and the same where no odd character stands
        self.plain, self.full = (begin(r"\w"), re.compile(r"\w")), (begin(word), within)
        lengths: dict[str, set[int]] = {}
        for s in surfaces:
            lengths.setdefault(self._words(s)[0].match(s).group(), set()).add(len(s))
        self.lengths = {k: sorted(v, reverse=True) for k, v in lengths.items()}

    def _words(self, text: str) -> tuple[re.Pattern, re.Pattern]:
        return self.plain if text.isascii() or self.odd.isdisjoint(text) else self.full

    def of(self, text: str) -> set[int]:
        """Numbers of the surfaces that stand in the text between words, leftmost and longest first, none overlapping."""
        begin, within = self._words(text)
        stop, kept = 0, set()
        for m in begin.finditer(text):
            at = m.start()
            if at >= stop:
                for n in self.lengths.get(m.group(), ()):
                    i = self.numbers.get(text[at : at + n])
                    if i is not None and not within.match(text, at + n):
                        stop = at + n
                        kept.add(i)
                        break
        return kept


def claims(key: str, shared: Broadcast) -> Claims:
    """Of the broadcast odd characters and surfaces. A worker keeps the last it made."""
    if key not in _claims:
        _claims.clear()
        _claims[key] = Claims(shared.value[1].to_pylist(), shared.value[0])
    return _claims[key]
