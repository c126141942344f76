"""Deeply nested records to flat tables of parents and children.

The JVM parses each text once and lays out what a ``Level`` names, list within list, as typed columns; the lists are then
flattened on Arrow buffers, level by level: child rows are the flattened values, their parents come from the list offsets,
and keys and positions are carried down by a vectorised take. No row is parsed or looped over in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Level:
    """The list at ``path`` of each value above it; ``fields`` are (column, path, type) of its entries, ``inner`` the list within each.

    A column name stands for one field of one level. A path '$' with type string is the entry itself where it is no object.
    """

    path: str
    fields: tuple[tuple[str, str, str], ...] = ()
    inner: Level | None = None

    @property
    def levels(self) -> list[Level]:
        return [self, *(self.inner.levels if self.inner else [])]

    def bare(self) -> Level:
        """The same lists without any field: for those who need the keys alone."""
        return Level(self.path, (), self.inner.bare() if self.inner else None)


def parsed(text: str) -> Column:
    """The text as VARIANT, null unless it is valid JSON from end to end; JSON encoded as a JSON string is parsed again."""
    once = f"try_parse_json({text})"
    return F.expr(f"case when startswith(trim({text}), '\"') then try_parse_json(try_variant_get({once}, '$', 'string')) else {once} end")


def as_list(variant: str, path: str = "$") -> str:
    """SQL for the value at ``path`` as array<variant>: a list as it is, a single value as one entry, null or nothing as null."""
    single = f"try_variant_get({variant}, '{path}', 'variant')"
    return f"coalesce(try_variant_get({variant}, '{path}', 'array<variant>'), case when is_variant_null({single}) then null else filter(array({single}), s -> s is not null) end)"


def nested(variant: str, level: Level, depth: int = 0) -> str:
    """SQL for the lists of ``level`` as an array of structs (there, fields, inner), null entries kept in place."""
    v = f"v{depth}"
    plain = f"case when coalesce(cardinality(try_variant_get({v}, '$', 'map<string, variant>')), -1) < 0 then try_variant_get({v}, '$', 'string') end"
    parts = ["true as there", *[f"{plain if p == '$' else f"try_variant_get({v}, '{p}', '{t}')"} as `{c}`" for c, p, t in level.fields]]
    if level.inner:
        parts.append(f"{nested(v, level.inner, depth + 1)} as `_inner`")
    return f"transform({as_list(variant, level.path)}, {v} -> case when not is_variant_null({v}) then struct({', '.join(parts)}) end)"


def _positions(lists: pa.ListArray) -> tuple[pa.Array, pa.Array]:
    """For each flattened value its list's index and its place in the list, from the offsets alone. Null lists hold no values."""
    parents = pc.list_parent_indices(lists)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begins = np.cumsum(sizes) - sizes
    place = pa.array(np.arange(len(parents), dtype=np.int64) - begins[np.asarray(parents)])
    return parents, place.cast(pa.int32())


def flatten_batch(record: pa.Array, lists: pa.ListArray, schema: pa.Schema, depth: int) -> Iterator[pa.RecordBatch]:
    """One batch a level, all of ``schema``: record_id, no_0 to no_n, and the fields of every level; what is not of the level is null."""
    keys: list[pa.Array] = []
    for level in range(depth):
        parents, place = _positions(lists)
        entries = pc.list_flatten(lists)
        real = pc.is_valid(entries)
        parents, place, entries = parents.filter(real), place.filter(real), entries.filter(real)
        record, keys = pc.take(record, parents), [*[pc.take(k, parents) for k in keys], place]
        own = {entries.type.field(i).name: i for i in range(entries.type.num_fields)}
        fixed = {"record_id": record} | {f"no_{i}": k for i, k in enumerate(keys)}
        columns = [fixed[f.name] if f.name in fixed else pc.struct_field(entries, own[f.name]).cast(f.type) if f.name in own else pa.nulls(len(record), f.type) for f in schema]
        yield pa.record_batch([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=schema)
        if level + 1 < depth:
            lists = pc.struct_field(entries, own["_inner"])


def flatten(rows: DataFrame, level: Level) -> DataFrame:
    """(record_id, lists) to one row per entry of any level: record_id, no_0, no_1 and so on, then the fields of all levels.

    ``lists`` is what ``nested`` gives for ``level``. An entry of level k has the positions no_0 to no_k, from 0, which link it to its
    parents, and its own fields; the rest is null. Null entries are skipped but counted; null or empty lists give no rows;
    an optional field that is missing or of another type is null. No shuffle.
    """
    levels = level.levels
    fields = [f"`{c}` {t}" for one in levels for c, _, t in one.fields]
    ddl = ", ".join(["record_id string", *[f"no_{i} int" for i in range(len(levels))], *fields])
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    schema = pa.schema([("record_id", pa.string()), *[(f"no_{i}", pa.int32()) for i in range(len(levels))], *[(c, kinds[t]) for one in levels for c, _, t in one.fields]])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from flatten_batch(b.column(0), b.column(1), schema, len(levels))

    return rows.select("record_id", "lists").mapInArrow(kernel, ddl)


def table(flat: DataFrame, level: Level, depth: int) -> DataFrame:
    """The table of one level: the key of its row, which begins with its parent's, and its fields."""
    last = len(level.levels) - 1
    own = flat.where(F.col(f"no_{depth}").isNotNull() & (F.col(f"no_{depth + 1}").isNull() if depth < last else F.lit(True)))
    return own.select("record_id", *[f"no_{i}" for i in range(depth + 1)], *[c for c, _, _ in level.levels[depth].fields])


def run_on(*lists: str) -> str:
    """SQL for lists of one record as one list, in the order given; null ones are left out."""
    return f"flatten(filter(array({', '.join(lists)}), a -> a is not null))"


def run_on_parts(variant: str, parts: str, level: Level) -> str:
    """SQL for the lists of ``level`` in each entry of the list at ``parts``, run on in the order of the parts."""
    return f"flatten(filter(transform({as_list(variant, parts)}, q -> {nested('q', level)}), a -> a is not null))"
