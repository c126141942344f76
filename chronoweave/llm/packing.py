"""Filling fixed-capacity containers: large-item matching and best fit, planned on the histogram of sizes.

Sizes are whole numbers of tokens up to the capacity, so the plan depends on at most ``capacity`` counts, whatever the number
of documents. It says which ranks within each size go to which containers; documents learn their rank from their place in
their partition and the offsets of the partitions before it, and find their container in the broadcast plan.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.runtime import Workspace

SIZED = "doc_id bigint, piece int, token_begin bigint, token_end bigint, size int, pid int, place bigint"
#: (size, first rank, items, first container, items per container)
Step = tuple[int, int, int, int, int]


def plan(counts: dict[int, int], capacity: int) -> list[Step]:
    """Containers for ``counts[size]`` items of each size from 1 to ``capacity``.

    Items above a third of the capacity go at most two to a container: the largest is matched with the largest that still
    fits beside it. The others, in falling size, go where they leave the least gap, a new container being opened where
    none fits. Equal items are placed together: a run of equal containers is split only where the items run out.
    """
    left = {s: n for s, n in counts.items() if n > 0 and 0 < s <= capacity}
    used = dict.fromkeys(left, 0)
    steps: list[Step] = []
    gaps: list[tuple[int, int, int]] = []  # (gap, first container, containers), sorted
    opened = 0

    def take(size: int, items: int, first: int, each: int) -> None:
        steps.append((size, used[size], items, first, each))
        used[size] += items
        left[size] -= items

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        size = large[-1]
        if not left[size]:
            large.pop()
            continue
        fitting = bisect_right(large, capacity - size) - 1
        while fitting >= 0 and not left[large[fitting]]:
            fitting -= 1
        other = large[fitting] if fitting >= 0 else None
        if other == size and left[size] < 2:
            fitting -= 1
            while fitting >= 0 and not left[large[fitting]]:
                fitting -= 1
            other = large[fitting] if fitting >= 0 else None
        if other is None:
            n, gap = left[size], capacity - size
            take(size, n, opened, 1)
        elif other == size:
            n, gap = left[size] // 2, capacity - 2 * size
            take(size, 2 * n, opened, 2)
        else:
            n, gap = min(left[size], left[other]), capacity - size - other
            take(size, n, opened, 1)
            take(other, n, opened, 1)
        if gap:
            insort(gaps, (gap, opened, n))
        opened += n
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            i = bisect_left(gaps, (size, -1, -1))
            if i < len(gaps):
                gap, first, n = gaps.pop(i)
            else:
                gap, first = capacity, opened
                n = -(-left[size] // (capacity // size))
                opened += n
            each = gap // size
            whole = min(n, left[size] // each)
            if whole:
                take(size, whole * each, first, each)
                if gap - each * size:
                    insort(gaps, (gap - each * size, first, whole))
                first, n = first + whole, n - whole
            if n and left[size]:
                rest = left[size]
                take(size, rest, first, rest)
                if gap - rest * size:
                    insort(gaps, (gap - rest * size, first, 1))
                first, n = first + 1, n - 1
            if n:
                insort(gaps, (gap, first, n))
    return steps


def _sizes(batches: Iterator[pa.RecordBatch], ranks: str, capacity: int) -> Iterator[pa.RecordBatch]:
    import base64

    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the vocabulary's own split
    encoding = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    pid = TaskContext.get().partitionId()
    seen: dict[int, int] = {}
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    names = [c.split()[0] for c in SIZED.split(", ")]
    for batch in batches:
        rows = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n = len(encoding.encode_ordinary(text)) if text else 0
            for piece, begin in enumerate(range(0, n, capacity) if n else (0,)):
                end = min(n, begin + capacity)
                place = seen.get(end - begin, 0)
                seen[end - begin] = place + 1
                rows.append((key, piece, begin, end, end - begin, pid, place))
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def fill(documents: DataFrame, workspace: Workspace, ranks: str, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, token_begin, token_end, size, container): every document's place.

    ``ranks`` is the path of a public vocabulary in tiktoken's format, readable on every executor. A document larger than a
    container is divided into full containers and a rest; no other is divided. One pass counts tokens; what is shuffled
    are counts per partition and size. The plan has some rows for each size up to the capacity, so it may be broadcast.
    Null and empty texts have one row of size 0 without a container. Repeated ids are separate items. An empty table gives no rows.
    """
    spark = documents.sparkSession
    sized = workspace.put(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(lambda b: _sizes(b, ranks, capacity), SIZED), keep=True)
    here = sized.where("size > 0").groupBy("size", "pid").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("size").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = workspace.put(here.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))), keep=True)
    counts = {r[0]: r[1] for r in offsets.groupBy("size").agg(F.sum("n")).collect()}  # at most ``capacity`` rows
    steps = plan(counts, capacity)
    table = spark.createDataFrame(steps, "size int, first bigint, items bigint, container bigint, each bigint")
    ranked = sized.join(offsets.select("size", "pid", "offset"), ["size", "pid"], "left").withColumn("rank", F.col("offset") + F.col("place"))
    at = F.broadcast(table.withColumnRenamed("size", "_size"))
    inside = (F.col("size") == F.col("_size")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("items"))
    return ranked.join(at, inside, "left").select(
        "doc_id", "piece", "token_begin", "token_end", "size", (F.col("container") + F.floor((F.col("rank") - F.col("first")) / F.col("each"))).cast("bigint").alias("container")
    )


def room(filled: DataFrame, capacity: int = 2048) -> DataFrame:
    """(n_items, n_tokens) of each container and what is left."""
    return filled.where("container is not null").groupBy("container").agg(F.count(F.lit(1)).alias("n_items"), F.sum("size").alias("n_tokens"), (F.lit(capacity) - F.sum("size")).alias("room"))
