"""Grading of sets and graphs: precision, recall, F1, macro means, leaderboards, sweeps, fidelity, alignment."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.operators.traverse import components
from chronoweave.runtime import Workspace


def prf(expected: Column, predicted: Column, both: Column) -> list[Column]:
    """Precision, recall, F1 from counts. Nothing expected and nothing predicted is perfect; one side empty is zero."""
    empty = (expected == 0) & (predicted == 0)
    p = F.when(empty, 1.0).when(predicted == 0, 0.0).otherwise(both / F.nullif(predicted, F.lit(0)))
    r = F.when(empty, 1.0).when(expected == 0, 0.0).otherwise(both / F.nullif(expected, F.lit(0)))
    f = F.when(empty, 1.0).when(both == 0, 0.0).otherwise(2.0 * both / (expected + predicted))
    return [p.alias("p"), r.alias("r"), f.alias("f1")]


def grade(expected: DataFrame, predicted: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Per item of ``items``: set scores of its members in the two long tables (key, member).

    ``items`` drives: one without a prediction is graded against the empty set, predictions for unknown items are ignored.
    """
    e, q = expected.select(key, "member").distinct(), predicted.select(key, "member").distinct()
    sides = e.withColumn("e", F.lit(1)).join(q.withColumn("q", F.lit(1)), [key, "member"], "full_outer")
    counts = sides.groupBy(key).agg(F.count("e").alias("n_expected"), F.count("q").alias("n_predicted"), F.count(F.when(F.col("e").isNotNull() & F.col("q").isNotNull(), 1)).alias("n_both"))
    rows = items.join(counts, key, "left").na.fill(0, ["n_expected", "n_predicted", "n_both"])
    exact = ((F.col("n_both") == F.col("n_expected")) & (F.col("n_both") == F.col("n_predicted"))).alias("exact")
    return rows.select("*", *prf(F.col("n_expected"), F.col("n_predicted"), F.col("n_both")), exact)


def macro(graded: DataFrame, by: str) -> DataFrame:
    """Macro means overall (group 'all') and per group, in one pass over grouping sets."""
    means = [F.avg(c).alias(c) for c in ("p", "r", "f1")] + [F.avg(F.col("exact").cast("double")).alias("exact_rate"), F.count(F.lit(1)).alias("n")]
    return graded.rollup(by).agg(*means, F.grouping(by).alias("_all")).withColumn(by, F.when(F.col("_all") == 1, "all").otherwise(F.coalesce(by, F.lit("")))).drop("_all")


def leaderboard(scores: DataFrame) -> DataFrame:
    """(runner, f1, place): best first, names break ties."""
    return scores.withColumn("place", F.row_number().over(Window.orderBy(F.desc("f1"), "runner")))  # one row per runner


def sweep(scored: DataFrame, n_gold: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Scores of keeping what reaches each threshold: ``scored`` has score and right; ``n_gold`` one row with n."""
    cuts = scored.sparkSession.createDataFrame([(float(t),) for t in sorted(set(thresholds))], "threshold double")
    # counts per score first, so that what meets the thresholds is no longer than the distinct scores
    small = scored.groupBy("score").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("right").cast("bigint")).alias("ok"))
    kept = F.col("score") >= F.col("threshold")
    per = F.broadcast(cuts).join(small, kept, "left").groupBy("threshold").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n_predicted"), F.coalesce(F.sum("ok"), F.lit(0)).alias("n_both"))
    return per.crossJoin(F.broadcast(n_gold.select(F.col("n").alias("n_expected")))).select("threshold", "n_predicted", "n_both", *prf(F.col("n_expected"), F.col("n_predicted"), F.col("n_both")))


def compare(gold: DataFrame, other: DataFrame, key: Sequence[str], group: str) -> DataFrame:
    """Scores by group of two tables of distinct keys; an item counts under its gold group, an unmatched one under its own."""
    a, b = gold.select(*key, F.col(group).alias("_a")).distinct(), other.select(*key, F.col(group).alias("_b")).distinct()
    rows = a.join(b, list(key), "full_outer").withColumn(group, F.coalesce("_a", "_b"))
    counts = rows.groupBy(group).agg(F.count("_a").alias("n_expected"), F.count("_b").alias("n_predicted"), F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("n_both"))
    return counts.select("*", *prf(F.col("n_expected"), F.col("n_predicted"), F.col("n_both")))


def align_nodes(gold: DataFrame, other: DataFrame, candidates: DataFrame, ws: Workspace, rounds: int = 8) -> DataFrame:
    """(other, gold): one to one. Records with the same id and type are paired first; the rest greedily, each in id order with its smallest candidate still free.

    ``gold`` and ``other`` have id and type, ``candidates`` other and gold. A round settles at once all pairs in which the gold one is the record's
    smallest candidate and the record the first that could take it, which is what the order comes to. Chains of rivals longer than
    ``rounds`` are walked one connected group at a time (``align``).
    """
    exact = ws.put(other.select("id", "type").distinct().join(gold.select("id", "type").distinct(), ["id", "type"]).select(F.col("id").alias("other"), F.col("id").alias("gold")).distinct(), keep=True)
    free = lambda df, taken: df.join(taken.select("other"), "other", "left_anti").join(taken.select("gold"), "gold", "left_anti")
    left, found = ws.put(free(candidates.select("other", "gold").where("other is not null and gold is not null").distinct(), exact)), [exact]
    for _ in range(rounds):
        wish, first = left.groupBy("other").agg(F.min("gold").alias("gold")), left.groupBy("gold").agg(F.min("other").alias("other"))
        found.append(ws.put(wish.join(first, ["other", "gold"]).select("other", "gold"), keep=True))
        left = ws.put(free(left, found[-1]))
        if left.isEmpty():
            return reduce(DataFrame.unionByName, found)
    groups = components(left.select(F.concat(F.lit("g"), "gold").alias("a"), F.concat(F.lit("o"), "other").alias("b")), ws)
    blocks = groups.where("id like 'o%'").select(F.expr("substr(id, 2)").alias("other"), F.col("component").alias("block"))
    found.append(ws.put(align(left.join(blocks, "other")).select("other", "gold"), keep=True))
    return reduce(DataFrame.unionByName, found)


def align(candidates: DataFrame) -> DataFrame:
    """Greedy one-to-one: in order of ``other`` each takes its smallest ``gold`` still free. Runs per ``block``.

    A block is a set of records that share a candidate key, kept small by the caller's key; no pair crosses blocks.
    """

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        taken: set[str] = set()
        out = []
        for other, golds in rows.sort_values(["other", "gold"]).groupby("other", sort=True)["gold"]:
            free = next((x for x in golds if x not in taken), None)
            if free is not None:
                taken.add(free)
                out.append((rows["block"].iloc[0], other, free))
        return pd.DataFrame(out, columns=["block", "other", "gold"])

    return candidates.select("block", "other", "gold").distinct().groupBy("block").applyInPandas(pick, "block string, other string, gold string")
