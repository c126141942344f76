"""Parent-child links to full hierarchies by tree contraction: rake leaves, compress unary chains, expand in reverse."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from chronoweave.runtime import Workspace

FREE, GONE = 0, 1


def parent_links(rows: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """(id, parent, named): one row per id. A blank parent or one that is not in the table becomes null; ``named`` says whether one was given.

    Rows with a null id are left out. Where copies of a row disagree, the largest parent counts.
    """
    one = rows.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.when(F.trim(parent_col) != "", F.col(parent_col))).alias("up"))
    ids = one.select(F.col("id").alias("up"), F.lit(True).alias("there"))
    return one.join(ids, "up", "left").select("id", F.when(F.col("there"), F.col("up")).alias("parent"), F.col("up").isNotNull().alias("named"))


def contract(links: DataFrame, workspace: Workspace, paths: bool = False, sizes: bool = False) -> DataFrame:
    """Solve every id of ``links`` (id, parent): (id, root, depth) and, if asked for, its path from the root and its circle, or the size of its subtree.

    A node whose parent is null is its own root at depth 0. An id on a circle or below one has depth -1, the circle's
    smallest id as root and a null path; ``circle`` lists a circle's members on the one row that closes it. ``size`` counts an id and
    all below it; on a circle it is not defined.

    Each round rakes all leaves and splices out unary nodes that come before both neighbours in a fresh random order, so that
    no two adjacent nodes go at once: a chain loses a third of its nodes a round and any forest is gone after O(log n)
    rounds, whatever its depth. A link carries its length and the smallest id it has jumped over. Circles shrink
    to a self-link that no rule removes: what is left at the end is exactly one core per circle. The recorded
    removals are then undone from the last round to the first; each refers only to nodes that outlived its round. A hub's
    children are counted with map-side combination and never gathered. An empty table gives no rows.

    Sizes add up on the way: a raked leaf hands what it holds to its parent, a link carries what the nodes it jumped over held, and a
    spliced node is what it held, what its child's link carried and its child's size. No pair is ever formed for them.
    """
    links = links.select("id", "parent").where("id is not null")
    extra = ["seg"] * paths + ["carried"] * sizes
    zero = F.lit(0).cast("bigint")
    start = links.where("parent is not null")
    roots = links.where("parent is null").select("id")
    state = start.join(roots.withColumn("top", F.lit(True)).withColumnRenamed("id", "parent"), "parent", "left").select(
        "id", "parent", F.lit(1).cast("bigint").alias("w"), F.lit(None).cast("string").alias("low"), F.coalesce("top", F.lit(False)).alias("top"), F.lit(FREE).alias("fate"),
        *([F.array().cast("array<string>").alias("seg")] if paths else []),
        *([zero.alias("carried"), (zero + 1).alias("held"), F.lit(None).cast("string").alias("kid_id"), zero.alias("kid_carried")] if sizes else []),
    )
    state = workspace.put(state)
    rounds: list[DataFrame] = []
    while True:
        alive = state.where(F.col("fate") == FREE).drop("fate", "kid_id", "kid_carried")
        order = lambda c: F.xxhash64(F.lit(len(rounds)), c)  # noqa: B023, E731
        # what was raked in the round before counts no more, but hands over what it held
        living = F.col("fate") == FREE
        handed = [F.sum(F.when(~living & F.col("kid_id").isNull(), F.col("held") + F.col("carried"))).alias("handed")] if sizes else []
        kids = (state if sizes else state.where(living)).groupBy(F.col("parent").alias("id")).agg(F.count_if(living).alias("n"), F.max(F.when(living, F.struct("id", "w", "low", *extra))).alias("kid"), *handed)
        x = alive.join(kids, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        if sizes:
            x = x.withColumn("held", F.col("held") + F.coalesce("handed", zero)).drop("handed")
        loop = F.col("id") == F.col("parent")
        splice = (F.col("n") == 1) & ~loop & (order(F.col("id")) < order(F.col("kid.id"))) & (F.col("top") | (order(F.col("id")) < order(F.col("parent"))))
        x = x.withColumn("spliced", F.coalesce(splice, F.lit(False)))
        jumps = x.where("spliced").select(
            F.col("kid.id").alias("id"), F.col("parent").alias("parent2"), (F.col("kid.w") + F.col("w")).alias("w2"),
            F.least("kid.low", "id", "low").alias("low2"), F.col("top").alias("top2"),
            *([F.concat("kid.seg", F.array("id"), "seg").alias("seg2")] if paths else []),
            *([(F.col("kid.carried") + F.col("held") + F.col("carried")).alias("carried2")] if sizes else []),
        )
        y = x.join(jumps, "id", "left")
        jumped = F.col("parent2").isNotNull()
        new = y.select(
            "id", *[F.when(jumped, F.col(f"{c}2")).otherwise(F.col(c)).alias(c) for c in ("parent", "w", "low", "top", *extra)],
            F.when(F.col("spliced") | (F.col("n") == 0), GONE).otherwise(FREE).alias("fate"),
            *(["held", F.when(F.col("spliced"), F.col("kid.id")).alias("kid_id"), F.when(F.col("spliced"), F.col("kid.carried")).otherwise(zero).alias("kid_carried")] if sizes else []),
        )
        seen = Observation()
        before = state
        state = workspace.put(new.observe(seen, F.count_if((F.col("fate") == FREE) & (F.col("id") != F.col("parent"))).alias("open"), F.count_if(F.col("fate") == GONE).alias("gone")))
        if len(rounds) == 0:
            workspace.drop(before)
        rounds.append(state)
        if not seen.get["open"]:
            break

    cores = state.where(F.col("fate") == FREE)
    nothing = F.lit(None).cast("array<string>")
    shape = lambda df: df.select("id", "root", "depth", *(["path", "circle"] if paths else []), *(["size"] if sizes else []))
    tops = roots
    if sizes:
        leaves = reduce(DataFrame.unionByName, [r.where((F.col("fate") == GONE) & F.col("top") & F.col("kid_id").isNull()).select(F.col("parent").alias("id"), (F.col("held") + F.col("carried")).alias("n")) for r in rounds])
        tops = roots.join(leaves.groupBy("id").agg(F.sum("n").alias("below")), "id", "left").select("id", (F.coalesce("below", zero) + 1).alias("size"))
    top_rows = shape(tops.withColumns({"root": F.col("id"), "depth": zero, "path": F.array("id"), "circle": nothing}))
    solved = [
        workspace.put(top_rows, keep=True) if sizes else top_rows,
        workspace.put(shape(cores.withColumns({"root": F.least("id", "low"), "depth": F.lit(-1).cast("bigint"), "path": nothing, "circle": F.concat(F.array("id"), "seg") if paths else nothing, "size": F.lit(None).cast("bigint")})), keep=True),
    ]
    for record in reversed(rounds):
        gone = record.where(F.col("fate") == GONE)
        own = lambda up: F.concat(up, F.reverse("seg"), F.array("id")) if paths else nothing
        known = reduce(DataFrame.unionByName, solved[1:])
        if sizes:
            leaves = gone.where("kid_id is null").withColumn("size", F.col("held"))
            kid_sizes = known.select(F.col("id").alias("kid_id"), "size").unionByName(leaves.select(F.col("id").alias("kid_id"), "size"))
            inner = gone.where("kid_id is not null").join(kid_sizes, "kid_id").withColumn("size", F.col("held") + F.col("kid_carried") + F.col("size"))
            gone = leaves.unionByName(inner)
        at_top = gone.where("top").withColumns({"root": F.col("parent"), "depth": F.col("w"), "path": own(F.array("parent")), "circle": nothing})
        ups = known.select(F.col("id").alias("parent"), F.col("root"), F.col("depth").alias("up_depth"), *([F.col("path").alias("up_path")] if paths else []))
        below = gone.where("not top").join(ups, "parent").withColumn("depth", F.when(F.col("up_depth") < 0, F.lit(-1)).otherwise(F.col("up_depth") + F.col("w")))
        below = below.withColumn("path", F.when(F.col("up_depth") >= 0, own(F.col("up_path")))).withColumn("circle", nothing) if paths else below
        solved.append(workspace.put(shape(at_top).unionByName(shape(below)), keep=True))
        if not sizes:  # the roots' sizes are written by now, but the records are small and go with the workspace
            workspace.drop(record)
    return reduce(DataFrame.unionByName, solved)


def below_circles(links: DataFrame, solved: DataFrame, workspace: Workspace, sizes: bool = False) -> DataFrame:
    """Ids on circles or below them as forests of their own: root is the circle member an id hangs on, depth and path count from it.

    ``solved`` is what ``contract`` gave with paths. A member is its own root at depth 0: around a circle nobody is above anybody.
    """
    members = solved.where("circle is not null").select(F.explode("circle").alias("id"), F.lit(True).alias("member"))
    inside = links.select("id", "parent").join(solved.where("depth < 0").select("id"), "id", "left_semi").join(members, "id", "left")
    return contract(workspace.put(inside.select("id", F.when(F.col("member").isNull(), F.col("parent")).alias("parent")), keep=True), workspace, paths=True, sizes=sizes)


def descendants(solved: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) of every pair, from the paths; the output itself, not a join, is what grows with depth."""
    return solved.where("depth > 0").select(F.col("id").alias("descendant"), "depth", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("pos", "ancestor")).select(
        "ancestor", "descendant", (F.col("depth") - F.col("pos")).alias("distance")
    )
