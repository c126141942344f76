"""Evaluation texts leaking into training text: CGK embedding and bit-sampling LSH over item-sized windows, then exact checks.

A window is a run of words: as many as an item's passage has, but no more than the plan's, since a part of a passage that long
is a leak. The CGK random walk reads a window with pauses decided by random bits of the word it stands on and so turns edits of
few words into few differing positions; tables of sampled positions then make windows within the allowed number of edits
collide. Passages shorter than the plan's window are matched whole and without edits. The evaluation set is the stated query set: it
is cut into blocks of bounded size, and one pass over the documents, which are never shuffled, holds every block against each.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of evaluation text per block; one block's index takes about a hundred times as many bytes.
BLOCK_CHARS = 2_000_000
#: Characters of documents that are held against one block before the next block's turn, and the blocks whose indexes a worker keeps.
HELD_CHARS, KEPT_INDEXES = 8_000_000, 2
MATCHED = "doc_id bigint, item_id bigint, doc_word int, item_word int, n_words int, edits int, whole boolean"

_INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿]")
_TAG = re.compile(r"</?[A-Za-z][^<>@]{0,80}>")
_TOKEN = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """The words of a text without case, markup, punctuation and invisible characters."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", text)
    return _TOKEN.findall(text.casefold())


@dataclass(frozen=True)
class Plan:
    """Windows of ``window`` words, up to ``edits`` edited words, ``tables`` tables of ``sampled`` positions of the embedding."""

    window: int = 15
    edits: int = 2
    sampled: int = 6
    recall: float = 0.98
    seed: int = 20_240

    @property
    def length(self) -> int:
        """Steps of a walk: it leaves its window after about twice as many as that has words, and reads nothing there that tells windows apart."""
        return 2 * self.window

    @property
    def tables(self) -> int:
        """Enough for ``recall`` at ``edits`` edits, each of which is reckoned to change a seventh of the positions (tests measure it), at least two tables."""
        same = max(0.05, 1 - self.edits / 7) ** self.sampled
        return max(2, math.ceil(math.log(1 - self.recall) / math.log(1 - same)))


def embed(symbols: np.ndarray, starts: np.ndarray, plan: Plan, steps: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """LSH keys of the windows at ``starts`` for one table: sampled positions of their CGK walks, mixed to 64 bits.

    ``symbols`` are word numbers; bit j of ``steps[s]`` says whether the walk leaves symbol s at its step j, and beyond its
    window a walk reads the last symbol of ``steps``. ``taken`` are the sampled steps in rising order.
    """
    outside = len(steps) - 1
    padded = np.concatenate([symbols, np.zeros(plan.window, np.int64)]).astype(np.int32)
    at = starts.astype(np.int64)
    ends = at + plan.window
    key = np.zeros(len(starts), np.uint64)
    sampled = set(taken.tolist())
    for j in range(int(taken[-1]) + 1):
        here = padded[at]
        if j >= plan.window:  # no walk can have left its window before
            here[at >= ends] = outside
        if j in sampled:
            key = (key ^ (here.astype(np.uint64) + np.uint64(j * 0x9E3779B1))) * np.uint64(0xFF51AFD7ED558CCD)
            key ^= key >> np.uint64(29)
        moves = ((steps >> np.uint64(j)) & np.uint64(1)).astype(np.int8)
        moves[outside] = 0
        at += moves[here]
    return key


def _run_keys(symbols: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit key of the ``length`` symbols from each start."""
    key = np.zeros(len(starts), np.uint64)
    for j in range(length):
        key = (key ^ symbols[starts + j].astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(29)
    return key


class Index:
    """Every window of the given items under every table, the items shorter than a window by their length, and the vocabulary of all."""

    def __init__(self, items: list[tuple[int, str]], plan: Plan):
        self.plan = plan
        split = [(i, w) for i, p in items if p and (w := words(p))]
        kept = [(i, w) for i, w in split if len(w) >= plan.window]
        self.items = dict(kept)
        self.vocabulary = {w: n for n, w in enumerate(dict.fromkeys(x for _, ws in split for x in ws), 1)}
        rng = np.random.default_rng(plan.seed)
        steps = rng.integers(0, 1 << 63, (plan.tables, len(self.vocabulary) + 2), np.uint64, endpoint=True)
        flat = [self.vocabulary[x] for _, ws in kept for x in ws]
        self.symbols = np.array(flat, np.int64)
        starts, ids, offsets = [], [], []
        base = 0
        for i, ws in kept:
            n = len(ws) - plan.window + 1
            starts.append(np.arange(base, base + n))
            ids.append(np.full(n, i, np.int64))
            offsets.append(np.arange(n))
            base += len(ws)
        none = [np.zeros(0, np.int64)]
        self.starts = np.concatenate(starts or none)
        self.ids, self.offsets = np.concatenate(ids or none), np.concatenate(offsets or none)
        self.tables = []
        for t in range(plan.tables if len(self.starts) else 0):
            taken = np.sort(rng.choice(plan.length, plan.sampled, replace=False))
            keys = embed(self.symbols, self.starts, plan, steps[t], taken)
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], order, steps[t], taken))
        self.short: dict[int, tuple[np.ndarray, list[int], np.ndarray]] = {}
        for length in sorted({len(w) for _, w in split if len(w) < plan.window}):
            same = [(i, w) for i, w in split if len(w) == length]
            symbols = np.array([self.vocabulary[x] for _, ws in same for x in ws], np.int64)
            keys = _run_keys(symbols, np.arange(len(same)) * length, length)
            order = np.argsort(keys, kind="stable")
            self.short[length] = (keys[order], [same[k][0] for k in order], symbols.reshape(len(same), length)[order])

    def whole_short(self, symbols: np.ndarray, foreign: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(start in ``symbols``, item, length) of the passages shorter than a window, wherever they stand word by word."""
        for length, (keys, ids, rows) in self.short.items():
            starts = np.nonzero(foreign[length:] == foreign[:-length])[0]
            mine = _run_keys(symbols, starts, length)
            lo, hi = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
            for k in np.nonzero(hi > lo)[0].tolist():
                for at in range(lo[k], hi[k]):
                    if (symbols[starts[k] : starts[k] + length] == rows[at]).all():
                        yield int(starts[k]), ids[at], length

    def candidates(self, symbols: np.ndarray, foreign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start in ``symbols``, number of the item window) of windows that collide in any table.

        Only windows with at most ``edits`` words foreign to all items are embedded: no other can be within ``edits`` of one.
        ``foreign`` counts the foreign words before each position.
        """
        w = self.plan.window
        n = len(symbols)
        ends = np.minimum(np.arange(n) + w, n)
        starts = np.nonzero(foreign[ends] - foreign[:-1] + (w - (ends - np.arange(n))) <= self.plan.edits)[0]
        found = []
        for keys, order, steps, taken in self.tables:
            if not len(starts):
                break
            mine = embed(symbols, starts, self.plan, steps, taken)
            lo, hi = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
            many = hi - lo
            which = np.repeat(np.arange(len(starts)), many)
            place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
            found.append(starts[which] * len(order) + order[place])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.starts), pairs % len(self.starts)


def edit_distances(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Row by row: edits that turn the words of ``a`` into a prefix of the words of ``b``, or ``most`` + 1 if more are needed.

    The band around the diagonal that ``most`` edits can reach is filled for all rows at once.
    """
    n, width = a.shape[1], 2 * most + 1
    far = np.int16(most + 1)
    band = np.full((len(a), width), far, np.int16)  # band[:, k] is the cell (i, i + k - most)
    band[:, most:] = np.arange(most + 1)
    for i in range(1, n + 1):
        new = np.full_like(band, far)
        for k in range(width):
            j = i + k - most
            if j < 0 or j > b.shape[1]:
                continue
            if j == 0:
                new[:, k] = min(i, most + 1)
                continue
            cell = band[:, k] + (a[:, i - 1] != b[:, j - 1])
            if k + 1 < width:
                cell = np.minimum(cell, band[:, k + 1] + 1)
            if k:
                cell = np.minimum(cell, new[:, k - 1] + 1)
            new[:, k] = np.minimum(cell, far)
        band = new
    return band.min(axis=1)


Found = dict[tuple[int, int], tuple[int, int, int, int, bool]]


def _match(index: Index, ids: list[int], texts: list[str | None]) -> Found:
    return _match_words(index, ids, [words(t) if t else [] for t in texts])


def _match_words(index: Index, ids: list[int], split: list[list[str]]) -> Found:
    """(doc, item) to (place in the document, place in the item, words, edits, whole) of the best match: whole before edited, few edits before many."""
    plan = index.plan
    get = index.vocabulary.get
    gap = [0] * (plan.window + plan.edits)
    flat: list[int] = []
    for ws in split:
        flat.extend(map(get, ws, repeat(0)))
        flat += gap
    symbols = np.array(flat, np.int64)
    lengths = np.array([len(ws) for ws in split], np.int64)
    begins = np.cumsum(lengths + len(gap)) - lengths - len(gap)
    foreign = np.concatenate([[0], np.cumsum(symbols == 0)])
    starts, windows = index.candidates(symbols, foreign)
    out: Found = {}
    for lo in range(0, len(starts), 200_000):
        s, w = starts[lo : lo + 200_000], windows[lo : lo + 200_000]
        mine = index.symbols[index.starts[w][:, None] + np.arange(plan.window)]
        there = symbols[np.minimum(s[:, None] + np.arange(plan.window + plan.edits), len(symbols) - 1)]
        edits = np.where((mine == there[:, : plan.window]).all(axis=1), 0, plan.edits + 1)
        rest = np.nonzero(edits)[0]
        edits[rest] = edit_distances(mine[rest], there[rest], plan.edits)
        near = np.nonzero(edits <= plan.edits)[0]
        docs = np.searchsorted(begins, s[near], "right") - 1
        for start, window, e, d in zip(s[near].tolist(), w[near].tolist(), edits[near].tolist(), docs.tolist(), strict=True):
            key = (ids[d], int(index.ids[window]))
            best = out.get(key)
            if best is not None and best[3] == 0:
                continue
            at, off = start - int(begins[d]), int(index.offsets[window])
            whole = e == 0 or "".join(split[d][at : at + plan.window + plan.edits]).startswith("".join(index.items[key[1]][off : off + plan.window]))
            if best is None or (not whole, e) < (not best[4], best[3]):
                out[key] = (at, off, plan.window, e, whole)
    for start, item, length in index.whole_short(symbols, foreign):
        d = int(np.searchsorted(begins, start, "right")) - 1
        out.setdefault((ids[d], item), (start - int(begins[d]), 0, length, 0, True))
    return out


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The distinct items in blocks of about BLOCK_CHARS characters, one at a time: the driver holds no more than a partition and a block."""
    total = items.agg(F.sum(F.length("passage"))).first()[0] or 0
    parts = items.where("passage is not null").select(F.col("item_id").cast("bigint"), "passage").distinct().repartition(max(1, math.ceil(2 * total / BLOCK_CHARS)), "item_id")
    block: list[tuple[int, str]] = []
    size = 0
    for item, passage in parts.toLocalIterator():
        block.append((item, passage))
        size += len(passage)
        if size >= BLOCK_CHARS:
            yield sorted(block)
            block, size = [], 0
    if block:
        yield sorted(block)


#: The indexes this worker built last; workers outlive tasks, so a block's index is built once for many of them.
_indexes: OrderedDict[str, Index] = OrderedDict()


def _index(name: str, shared, plan: Plan) -> Index:
    if name not in _indexes:
        while len(_indexes) >= KEPT_INDEXES:
            _indexes.popitem(last=False)
        _indexes[name] = Index(shared.value, plan)
        vars(shared).pop("_value", None)  # the texts are on disk should they be needed again
    _indexes.move_to_end(name)
    return _indexes[name]


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[list[str]]]]:
    """Documents as words, some HELD_CHARS characters at a time."""
    ids: list[int] = []
    split: list[list[str]] = []
    size = 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(key)
            split.append(words(text) if text else [])
            size += len(text or "")
            if size >= HELD_CHARS:
                yield ids, split
                ids, split, size = [], [], 0
    yield ids, split


def leaks(documents: DataFrame, items: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_words, edits, whole): the best match of each document and item.

    A pair is found if some window of the document is within ``edits`` word edits of a window of the item's passage;
    ``whole`` is true if the item's words stand there letter by letter, however they are spaced or broken (so a word split in
    two still counts). Pairs within 0 edits collide in every table; at ``edits`` edits recall is at least the plan's, as the
    tests measure. An item shorter than a window is found where all its ``n_words`` words stand. Null and blank texts match nothing;
    repeated items are one; no row is dropped for being frequent. Columns beyond doc_id, text, item_id, passage are ignored.
    """
    spark = documents.sparkSession
    name = uuid.uuid4().hex
    shared = [spark.sparkContext.broadcast(block) for block in _blocks(items)]  # each lies in a file of the driver, not in its memory

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.bool_()]
        names = [c.split()[0] for c in MATCHED.split(", ")]
        for ids, split in _held(batches):
            for k, block in enumerate(shared):
                got = _match_words(_index(f"{name}-{k}", block, plan), ids, split)
                columns = list(zip(*[(*key, *v) for key, v in got.items()], strict=True)) if got else [[] for _ in kinds]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return documents.where("text is not null").select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, MATCHED)
