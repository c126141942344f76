"""Splitting oversized items at natural boundaries: content-defined chunking whose landmarks snap to the nearest boundary.

The landmark of a piece is the place with the least rolling hash among those where it may end. Where that is depends on the words
around it alone, so two versions of a text agree on it as soon as their pieces overlap there: an edit alters its neighbours only.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "chunk_id string, section string, source_path string, piece_no int, begin int, end int, source_offset int, cut string, forced int, text string"

_PARAGRAPH = re.compile(r"\n[ \t]*\n\s*")
_LINE = re.compile(r"\n\s*")
_SENTENCE = re.compile(r"[.!?…][\"'”’)\]]*\s+")
_SPACE = re.compile(r"[ \t\n]+")
BLANKS = " \t\n"


@dataclass(frozen=True)
class Sizes:
    """Code points: no piece is longer than ``most``; neighbours share ``overlap``; a piece brings at least ``least`` new ones where it can."""

    most: int = 1200
    overlap: int = 100
    least: int = 500
    window: int = 24
    #: A paragraph's, line's or sentence's end this near the landmark is taken; else the nearest space.
    reach: int = 250


def rolling_hashes(text: str, sizes: Sizes) -> np.ndarray:
    """For each place from 0 to the end the mixed hash of the ``window`` code points before it; places without so many have the greatest value."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = np.full(len(codes) + 1, np.iinfo(np.uint64).max, np.uint64)
    if len(codes) < sizes.window:
        return out
    rolling = np.zeros(len(codes) - sizes.window + 1, np.uint64)
    for k in range(sizes.window):
        rolling = rolling * np.uint64(1_099_511_628_211) + codes[k : len(codes) - sizes.window + 1 + k]
    mixed = (rolling ^ (rolling >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    out[sizes.window :] = mixed ^ (mixed >> np.uint64(29))
    return out


def boundaries(text: str) -> list[tuple[str, list[int]]]:
    """Places to cut, strongest kind first: after a paragraph, a line, a sentence, a space."""
    return [(k, [m.end() for m in p.finditer(text)]) for k, p in (("paragraph", _PARAGRAPH), ("line", _LINE), ("sentence", _SENTENCE), ("space", _SPACE))]


def _nearest(places: list[int], at: int, lo: int, hi: int) -> int | None:
    i, j = bisect_left(places, lo), bisect_right(places, hi)
    if i >= j:
        return None
    k = min(max(bisect_left(places, at, i, j), i), j - 1)
    return min((places[x] for x in (k - 1, k) if i <= x < j), key=lambda p: abs(p - at))


def cuts(text: str, sizes: Sizes = Sizes()) -> list[tuple[int, str]]:
    """(end of the new part, kind of boundary) of each piece. Kind 'forced' means that no boundary stood in the piece's span."""
    n = len(text)
    *strong, (_, spaces) = boundaries(text)
    kinds = {at: kind for kind, where in reversed(strong) for at in where}
    natural = sorted(kinds)
    hashes = rolling_hashes(text, sizes)
    out: list[tuple[int, str]] = []
    s = 0
    while True:
        room = sizes.most - (sizes.overlap if out else 0)
        if n - s <= room:
            out.append((n, "end"))
            return out
        lo, hi = s + sizes.least, s + room
        goal = lo + int(hashes[lo : hi + 1].argmin())
        at = _nearest(natural, goal, max(lo, goal - sizes.reach), min(hi, goal + sizes.reach))
        if at is None:
            at = _nearest(spaces, goal, lo, hi)
        if at is None:  # nothing where the piece should end: the last boundary before that
            last = [where[j] for where in (natural, spaces) if (j := bisect_right(where, hi) - 1) >= 0 and where[j] > s + sizes.overlap]
            at = max(last, default=None)
        if at is None:
            at = hi
            while at > s + sizes.overlap + 1 and unicodedata.combining(text[at]):
                at -= 1
            out.append((at, "forced"))
        else:
            out.append((at, kinds.get(at, "space")))
        s = at


def cut_through(text: str, at: int) -> int:
    """Length of the run without space, tab or newline that a cut at ``at`` divides, 0 if it divides none."""
    if at >= len(text) or text[at - 1] in BLANKS or text[at] in BLANKS:
        return 0
    begin = max(text.rfind(b, 0, at) for b in BLANKS) + 1
    return min((p for b in BLANKS if (p := text.find(b, at)) >= 0), default=len(text)) - begin


def _split(batches: Iterator[pa.RecordBatch], sizes: Sizes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for key, text, offset, section, path in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            ends = cuts(text, sizes)
            # a run longer than a piece cannot but be divided, so the cuts have seen every one
            forced = int(any(cut_through(text, at) > sizes.most for at, _ in ends))
            begin = 0
            for k, (end, kind) in enumerate(ends):
                rows.append((key, section, path, k, begin, end, offset + begin if offset is not None and offset >= 0 else -1, kind, forced, text[begin:end]))
                begin = end - sizes.overlap
            if len(rows) > 5000:
                yield _batch(rows)
                rows = []
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [*[pa.string()] * 3, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string()]
    names = [c.split()[0] for c in PIECES.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def pieces(chunks: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """Pieces of every chunk longer than ``sizes.most``, with the chunk's section and path.

    ``begin`` and ``end`` are offsets in the chunk, ``source_offset`` that of the piece in its source, -1 if the chunk's own is
    unknown (negative or null). Piece k + 1 begins ``overlap`` code points before piece k ends. ``cut`` is the kind of boundary
    at the end. ``forced`` is 1 for chunks with more than ``most`` code points in a row without space, tab or newline; only
    in such runs must a cut fall inside a word, up to ``overlap`` less. The stored length is not used: it may be stale.
    Chunks of null or short text and null ids have no pieces; repeated rows count once. Each text is cut by itself, whole.
    """
    big = chunks.where(F.col("id").isNotNull() & (F.length("text") > sizes.most)).select("id", "text", "offset", "section", "source_path").dropDuplicates(["id"])
    return big.mapInArrow(lambda b: _split(b, sizes), PIECES)
