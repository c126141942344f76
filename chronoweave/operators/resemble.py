"""Names of one block that resemble each other: an exact search over tf-idf vectors of character n-grams, held in whole numbers by every worker."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronoweave.runtime import Workspace, shuffle_partitions

#: Forms that the driver and every worker may hold, some 400 bytes each; pairs that a task weighs at once.
HELD_FORMS, WEIGHED_PAIRS = 1 << 20, 150_000
#: Below the bound by so much a prefix still counts, whatever sums in another order come to.
SLACK = 1e-6


@dataclass
class Vectors:
    """Rows are forms in order of block and form; a row's entries lie between two of ``first``, common terms first, those from ``rare`` on are its prefix."""

    first: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    rare: np.ndarray


def _grams(form: str, n: int = 3) -> list[str]:
    padded = f" {form} "
    return [form] if len(padded) <= n else [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _vectors(forms: list[str], merge_at: float) -> Vectors:
    """Of one block. Terms are numbered from the most common to the rarest."""
    ids: dict[str, int] = {}
    sizes, flat = [], []
    for f in forms:
        grams = _grams(f)
        sizes.append(len(grams))
        flat += [ids.setdefault(g, len(ids)) for g in grams]
    row = np.repeat(np.arange(len(forms)), sizes)
    key, tf = np.unique(row * len(ids) + np.array(flat), return_counts=True)
    del flat
    row, term = key // len(ids), key % len(ids)
    df = np.bincount(term, minlength=len(ids))
    weight = tf * (np.log((len(forms) + 1) / (df + 1)) + 1)[term]
    weight /= np.sqrt(np.bincount(row, weight * weight))[row]
    rank = np.empty(len(ids), np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(ids))
    term = rank[term]
    order = np.lexsort((term, row))
    term, weight = term[order], weight[order]
    first = np.append(0, np.cumsum(np.bincount(row, minlength=len(forms))))
    passed = np.cumsum(weight * weight)
    behind = passed - np.append(0, passed)[first[:-1]][row]
    # without what lies before their prefixes two unit vectors stay below the bound, so those that reach it share a term of both prefixes
    rare = first[1:] - np.bincount(row, np.sqrt(np.maximum(behind, 0)) >= merge_at - SLACK, minlength=len(forms)).astype(np.int64)
    return Vectors(first, term.astype(np.int32), weight, rare)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(start - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())


def _close(v: Vectors, rows: np.ndarray, merge_at: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (x, y), x < y, of ``rows`` x whose cosine reaches the bound; every pair that shares a term of both prefixes is weighed exactly."""
    n, n_terms = len(v.first) - 1, int(v.term.max()) + 1
    at = _ranges(v.rare, v.first[1:] - v.rare)
    owner = np.repeat(np.arange(n), v.first[1:] - v.rare)
    by_term = np.argsort(v.term[at], kind="stable")
    posting, place = owner[by_term].astype(np.int32), np.empty(len(at), np.int64)
    place[by_term] = np.arange(len(at))
    stop = np.cumsum(np.bincount(v.term[at], minlength=n_terms))[v.term[at]]  # where the postings of an entry's term end
    begin = np.append(0, np.cumsum(v.first[1:] - v.rare))
    met = np.add.reduceat(stop - place - 1, begin[:-1])  # later rows that a row meets
    here = 0
    while here < len(rows):
        upto = here + max(1, int(np.searchsorted(np.cumsum(met[rows[here : here + 256]]), WEIGHED_PAIRS, "right")))
        xs = rows[here:upto]
        here = upto
        size = begin[xs + 1] - begin[xs]
        own = _ranges(begin[xs], size)
        counts = stop[own] - place[own] - 1
        key = np.unique(np.repeat(np.repeat(np.arange(len(xs)), size), counts) * n + posting[_ranges(place[own] + 1, counts)])
        dense = np.zeros((len(xs), n_terms))
        mine = v.first[xs + 1] - v.first[xs]
        entries = _ranges(v.first[xs], mine)
        dense[np.repeat(np.arange(len(xs)), mine), v.term[entries]] = v.weight[entries]
        for k in range(0, len(key), WEIGHED_PAIRS):
            x, y = np.divmod(key[k : k + WEIGHED_PAIRS], n)
            size = v.first[y + 1] - v.first[y]
            entries = _ranges(v.first[y], size)
            cosine = np.add.reduceat(v.weight[entries] * dense[np.repeat(x, size), v.term[entries]], np.append(0, np.cumsum(size)[:-1]))
            near = cosine >= merge_at
            yield xs[x[near]], y[near]


class Groups:
    """Sets of numbers that are joined; a set is named by its least."""

    def __init__(self, n: int):
        self.of = list(range(n))

    def name(self, x: int) -> int:
        of = self.of
        while of[x] != x:
            of[x] = x = of[of[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.name(x), self.name(y)
        self.of[max(x, y)] = min(x, y)
        return x != y


def groups(names: DataFrame, ws: Workspace, merge_at: float, held: int = HELD_FORMS) -> DataFrame | None:
    """(block, form, least): forms that one or more of their block are as near as ``merge_at``, with the least form of all so joined; None beyond ``held`` names.

    ``names`` are distinct (block, form). Tasks weigh their share of the forms against all later ones, and give only such pairs as join what
    they have not joined yet.
    """
    spark = names.sparkSession
    table = names.select("block", "form").limit(held + 1).toArrow()
    if table.num_rows > held:
        return None
    blocks: dict[str, list[str]] = {}
    for block, form in zip(table["block"].to_pylist(), table["form"].to_pylist(), strict=True):
        blocks.setdefault(block, []).append(form)
    del table
    found: list[tuple[str, str, str]] = []
    for block, forms in sorted(blocks.items()):
        forms.sort()
        shared = spark.sparkContext.broadcast(_vectors(forms, merge_at))
        parts = min(len(forms), shuffle_partitions(spark))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, n=len(forms), parts=parts) -> Iterator[pa.RecordBatch]:
            joined = Groups(n)
            for batch in batches:
                for part in batch.column(0).to_pylist():
                    for x, y in _close(shared.value, np.arange(part, n, parts), merge_at):
                        links = [p for p in zip(x.tolist(), y.tolist(), strict=True) if joined.join(*p)]
                        if links:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in zip(*links, strict=True)], ["x", "y"])

        links = spark.range(0, parts, 1, parts).mapInArrow(run, "x int, y int").toArrow()
        joined = Groups(len(forms))
        for x, y in zip(links["x"].to_pylist(), links["y"].to_pylist(), strict=True):
            joined.join(x, y)
        members = {i for c in ("x", "y") for i in links[c].to_pylist()}
        found += [(block, forms[i], forms[joined.name(i)]) for i in sorted(members)]
        shared.destroy()
    columns = list(zip(*found, strict=True)) or [(), (), ()]
    return ws.put(spark.createDataFrame(pa.table({c: pa.array(v, pa.string()) for c, v in zip(("block", "form", "least"), columns, strict=True)})), keep=True)
