"""Traversal by iteration over DataFrames: closure, ancestors, k-hop, distances, components, strong components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from chronoweave.runtime import Workspace, shuffle_partitions

#: Links of a closure that every worker may hold, some 70 bytes each in the driver; rows of a batch it gives.
HELD_LINKS, WALKED_ROWS = 1 << 20, 1 << 16


def _counted(ws: Workspace, df: DataFrame, keep: bool = False) -> tuple[DataFrame, int]:
    seen = Observation()
    out = ws.put(df.observe(seen, F.count(F.lit(1)).alias("n")), keep=keep)
    return out, seen.get["n"]


def closure(edges: DataFrame, ws: Workspace, held: int = HELD_LINKS) -> DataFrame:
    """(a, b): every b reachable from a over (src, dst) in one step or more. On a circle a reaches itself.

    Up to ``held`` distinct links are numbered and sent to every worker, where each task walks from its own share of the starts: pairs are
    made once, where they are read, and never shuffled or written. More links are joined in rounds (see ``_closure_by_joins``).
    """
    links = edges.where("src is not null and dst is not null").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    links, n = _counted(ws, links, keep=True)
    if not n:
        return links
    return _closure_by_joins(links, ws) if n > held else _closure_by_walks(links, ws)


def _closure_by_walks(links: DataFrame, ws: Workspace) -> DataFrame:
    """(a, b) of ``links`` (a, b): the starts are dealt out, and each task walks from its own over all links, in whole numbers."""
    spark = links.sparkSession
    table = links.toArrow()
    ws.drop(links)
    ends = pa.chunked_array([*table["a"].cast("string").chunks, *table["b"].cast("string").chunks]).combine_chunks().dictionary_encode()
    src, dst = np.split(ends.indices.to_numpy(zero_copy_only=False).astype(np.int32), 2)
    order = np.argsort(src, kind="stable")
    starts, first = np.unique(src[order], return_index=True)
    shared = spark.sparkContext.broadcast((ends.dictionary, starts, np.append(first, len(order)), dst[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, starts, first, onward = shared.value
        after: list = [()] * len(names)
        onward = onward.tolist()
        for k, s in enumerate(starts.tolist()):
            after[s] = onward[first[k] : first[k + 1]]

        def pairs(froms: list[int], sizes: list[int], reached: list[int]) -> pa.RecordBatch:
            sides = np.repeat(np.array(froms, np.int32), sizes), np.array(reached, np.int32)
            return pa.RecordBatch.from_arrays([names.take(pa.array(x)) for x in sides], ["a", "b"])

        for batch in batches:
            froms, sizes, reached = [], [], []
            for s in starts[batch.column(0).to_numpy()].tolist():
                ahead = list(after[s])
                seen = set(ahead)
                while ahead:
                    for x in after[ahead.pop()]:
                        if x not in seen:
                            seen.add(x)
                            ahead.append(x)
                froms.append(s)
                sizes.append(len(seen))
                reached += seen
                if len(reached) >= WALKED_ROWS:
                    yield pairs(froms, sizes, reached)
                    froms, sizes, reached = [], [], []
            if reached:
                yield pairs(froms, sizes, reached)

    return spark.range(0, len(starts), 1, shuffle_partitions(spark)).mapInArrow(run, "a string, b string")


def _closure_by_joins(links: DataFrame, ws: Workspace) -> DataFrame:
    """(a, b) of ``links`` (a, b), at their distance: in round k ``parts`` hold the pairs less than 2^k steps apart, ``far`` those exactly as far.

    A way is cut in one place only, 2^k steps before its end, so a pair is met by few joins however long its way is, and the rounds grow with
    the logarithm of the depth; no cap cuts a deep chain. Each round is written, so lineage stays short.
    """
    every = lambda frames: reduce(DataFrame.unionByName, frames)
    onward = lambda df, far: df.select("a", F.col("b").alias("m")).join(far.select(F.col("a").alias("m"), "b"), "m").select("a", "b").distinct()
    parts, far, n = [], links, 1
    while n:
        between = [ws.put(onward(every(parts), far).join(every([*parts, far]), ["a", "b"], "left_anti"), keep=True)] if parts else []
        parts += [far, *between]
        far, n = _counted(ws, onward(far, far).join(every(parts), ["a", "b"], "left_anti"), keep=True)
    return every(parts)


def ancestors(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(id, ancestor): all direct parents of each node met on the way up, where only the smallest parent is climbed further."""
    links = edges.where("src is not null and dst is not null").select("src", "dst").distinct()
    climb = links.groupBy("src").agg(F.min("dst").alias("dst"))
    chain = closure(climb, ws)
    met = chain.select(F.col("a").alias("id"), F.col("b").alias("src")).join(links, "src").select("id", F.col("dst").alias("ancestor"))
    own = links.select(F.col("src").alias("id"), F.col("dst").alias("ancestor"))
    return own.unionByName(met).where("id <> ancestor").distinct()


def khop(edges: DataFrame, starts: DataFrame, depth: int, ws: Workspace, direction: str = "both") -> tuple[DataFrame, DataFrame]:
    """Nodes (id, hops) and edges (id) met while expanding from ``starts``; depth is kept within 1 to 6.

    Edges between two nodes of the last layer are not met. Ends that do not exist as nodes are kept.
    """
    depth = min(6, max(1, depth))
    sides = [("src", "dst")] * (direction != "in") + [("dst", "src")] * (direction != "out")
    steps = reduce(DataFrame.unionByName, [edges.where("src is not null and dst is not null").select("id", F.col(a).alias("here"), F.col(b).alias("there")) for a, b in sides])
    steps = ws.put(steps, keep=True)
    layer = ws.put(starts.select(F.col(starts.columns[0]).alias("id")).distinct().withColumn("hops", F.lit(0)), keep=True)
    layers, met = [layer], []
    for k in range(1, depth + 1):
        out = ws.put(steps.join(layer.select(F.col("id").alias("here")), "here", "left_semi"), keep=True)
        met.append(out.select("id"))
        seen = reduce(DataFrame.unionByName, layers).select("id")
        layer, n = _counted(ws, out.select(F.col("there").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hops", F.lit(k)), keep=True)
        layers.append(layer)
        if not n:
            break
    return reduce(DataFrame.unionByName, layers), reduce(DataFrame.unionByName, met).distinct()


def distances(edges: DataFrame, start: str, ws: Workspace, directed: bool = False) -> DataFrame:
    """(id, hops, via): hop distance of all reachable nodes and the smallest predecessor, from which a shortest path is read back."""
    sides = [("src", "dst"), *[("dst", "src")] * (not directed)]
    steps = reduce(DataFrame.unionByName, [edges.where("src is not null and dst is not null").select(F.col(a).alias("here"), F.col(b).alias("there")) for a, b in sides]).distinct()
    steps = ws.put(steps, keep=True)
    spark = edges.sparkSession
    layer = ws.put(spark.range(1).select(F.lit(start).alias("id"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("via")), keep=True)
    layers, n = [layer], 1
    while n:
        seen = reduce(DataFrame.unionByName, layers).select("id")
        out = steps.join(layer.select(F.col("id").alias("here"), "hops"), "here").groupBy(F.col("there").alias("id")).agg((F.min("hops") + 1).alias("hops"), F.min("here").alias("via"))
        layer, n = _counted(ws, out.join(seen, "id", "left_anti"), keep=True)
        layers.append(layer)
    return reduce(DataFrame.unionByName, layers)


def shortest_path(edges: DataFrame, start: str, end: str, ws: Workspace, directed: bool = False) -> DataFrame:
    """(step, id) from ``start`` to ``end`` along the fewest edges, by the smallest predecessor at every step; no rows if there is no way.

    A start that is the end is a path of one row. The path is read back step by step, as it has but one row a step.
    """
    spark = edges.sparkSession
    met = ws.put(distances(edges, start, ws, directed), keep=True)
    path, at = [], end
    while at is not None:
        row = met.where(F.col("id") == at).first()
        if row is None:
            break
        path.append((row.hops, at))
        at = row.via
    return spark.createDataFrame(path, "step int, id string")


def components(pairs: DataFrame, ws: Workspace) -> DataFrame:
    """(id, component): connected components of (a, b), named by their smallest id, by alternating large and small stars.

    Every round links each node's larger neighbours to its smallest and then all to the least; a star forest is reached in
    O(log^2 n) rounds. Neighbours are reduced to their minimum before anything is joined, so a hub is never gathered.
    """
    both = pairs.where("a is not null and b is not null")
    ids = both.select(F.col("a").alias("id")).unionByName(both.select(F.col("b").alias("id"))).distinct()
    links, n = _counted(ws, both.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while n:
        two_way = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = two_way.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = ws.put(two_way.where("b > a").join(least, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a <> b").distinct())
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(floor, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        new = ws.put(small)
        same = new.join(links, ["a", "b"], "left_anti").isEmpty() and links.join(new, ["a", "b"], "left_anti").isEmpty()
        ws.drop(links, large)
        links = new
        if same:
            break
    stars = ws.put(links, keep=True)
    return ws.put(ids.join(stars.select(F.col("a").alias("id"), "b"), "id", "left").select("id", F.coalesce("b", "id").alias("component")), keep=True)


def _spread(links: DataFrame, labels: DataFrame, ws: Workspace) -> DataFrame:
    """``labels`` (id, label) with each label lowered to the least that reaches its id along ``links``.

    Only ids whose label has just changed send it on, and a receiver keeps the least of what it is sent.
    """
    labels = ws.put(labels)
    fresh = labels
    while True:
        sent = links.join(fresh.select(F.col("id").alias("src"), F.col("label").alias("sent")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("sent").alias("sent"))
        lower = labels.join(sent, "id").where("sent < label").select("id", F.col("sent").alias("label"))
        new, n = _counted(ws, lower)
        if fresh is not labels:
            ws.drop(fresh)
        if not n:
            ws.drop(new)
            return labels
        merged = ws.put(labels.join(new.select("id", F.col("label").alias("new")), "id", "left").select("id", F.coalesce("new", "label").alias("label")))
        ws.drop(labels)
        labels, fresh = merged, new


def strong_components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(id, scc): the members of every strongly connected component that holds a circle, named by its smallest id.

    Ids that nothing reaches or that reach nothing are trimmed away. Of the rest each takes the least id that reaches it as its colour, and those of a
    colour that can get back to the id it is named by are its component. What is left goes into the next round. Every step is a join over
    the edges; no pairs of ids are formed. The steps grow with the longest path, not with its closure.
    """
    links = ws.put(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    found = [ws.put(links.where("src = dst").select(F.col("src").alias("id"), F.col("src").alias("scc")), keep=True)]  # circles of one
    links, n = _counted(ws, links.where("src <> dst"))
    while n:
        last = n + 1
        while n and n < last:
            last = n
            ends = links.select(F.col("dst").alias("src")).distinct(), links.select(F.col("src").alias("dst")).distinct()
            links, n = _counted(ws, links.join(ends[0], "src", "left_semi").join(ends[1], "dst", "left_semi"))
        if not n:
            break
        ids = links.select(F.col("src").alias("id")).unionByName(links.select(F.col("dst").alias("id"))).distinct()
        colours = _spread(links, ids.select("id", F.col("id").alias("label")), ws)
        of = lambda c: colours.select(F.col("id").alias(c), F.col("label").alias(f"{c}_colour"))  # noqa: B023, E731
        inside = links.join(of("src"), "src").join(of("dst"), "dst").where("src_colour = dst_colour")
        back = ws.put(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        # backwards within a colour from the id it is named by: reached ids are marked with it, others keep a mark above every id
        above = F.lit("\U0010ffff")
        marked = _spread(back, colours.select("id", F.when(F.col("id") == F.col("label"), F.col("id")).otherwise(above).alias("label")), ws)
        found.append(ws.put(marked.where(F.col("label") != above).select("id", F.col("label").alias("scc")), keep=True))
        rest = marked.where(F.col("label") == above).select("id")
        links, n = _counted(ws, links.join(rest.select(F.col("id").alias("src")), "src", "left_semi").join(rest.select(F.col("id").alias("dst")), "dst", "left_semi"))
    sizes = reduce(DataFrame.unionByName, found).groupBy("id").agg(F.min("scc").alias("scc"))
    circles = reduce(DataFrame.unionByName, found[1:]).groupBy("scc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("scc") if len(found) > 1 else None
    single = found[0].select("id")
    if circles is None:
        return sizes
    in_circle = sizes.join(circles, "scc", "left_semi").select("id", "scc")
    return in_circle.unionByName(sizes.join(single, "id", "left_semi").join(in_circle.select("id"), "id", "left_anti").select("id", "scc"))


def activation_fixpoint(needs: DataFrame, roots: DataFrame, ws: Workspace) -> DataFrame:
    """Ids that can become active: roots, and any node of which some (src, dst) predecessor is active."""
    links = needs.select("src", "dst").distinct()
    found, n = _counted(ws, roots.select(F.col(roots.columns[0]).alias("id")).distinct(), keep=True)
    parts, fresh = [found], found
    while n:
        seen = reduce(DataFrame.unionByName, parts)
        step = links.join(fresh.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        fresh, n = _counted(ws, step.join(seen, "id", "left_anti"), keep=True)
        parts.append(fresh)
    return reduce(DataFrame.unionByName, parts)
