"""The closure on both its ways, against brute force, and what it moves."""

import random
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__
from chronoweave.operators import graph, infer, traverse
from chronoweave.runtime import Workspace
from tests.test_core import brute_closure

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("held", [0, 1000])
def test_closure_of_deep_and_round_graphs(spark, held):
    rng = random.Random(5)
    chain = [(f"c{i:02}", f"c{i + 1:02}") for i in range(37)]
    circle = [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)]
    pairs = {*chain, *circle, ("c09", "r3"), ("c02", "c30"), ("x", "x"), *((f"n{rng.randrange(20)}", f"n{rng.randrange(20)}") for _ in range(24))}
    df = spark.createDataFrame([*pairs, *chain, (None, "x"), ("x", None)], "src string, dst string")
    with Workspace(spark, "t") as ws:
        got = [tuple(r) for r in traverse.closure(df, ws, held).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_closure(pairs)
        assert traverse.closure(df.limit(0), ws, held).count() == 0


def test_closure_pairs_are_neither_written_nor_shuffled(spark):
    """A chain of 400 has 79,800 pairs; before, all were written and shuffled in every round."""
    with Workspace(spark, "t") as ws:
        df = traverse.closure(spark.range(399).selectExpr("cast(id as string) src", "cast(id + 1 as string) dst"), ws)
        assert df.count() == 400 * 399 // 2 and "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert not list(Path(ws.root.removeprefix("file:")).rglob("*.parquet"))


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan()


def test_inference_gathers_no_closure(spark):
    """Its parts are sets with predicates of their own; before, all facts were shuffled once more to be made distinct."""
    edges = [("reports_to", f"p{i:02}", f"p{i + 1:02}") for i in range(40)] + [("leads", "p01", "d"), ("member_of", "p01", "t"), ("part_of", "t", "d"), ("advances_goal", "p01", "g"), ("advances_goal", "p01", "h"), ("subgoal_of", "g", "h")]
    e = spark.createDataFrame(edges, "type string, src string, dst string")
    with Workspace(spark, "t") as ws:
        df = infer.infer(graph.TemporalGraph(spark.createDataFrame([("d", "Department")], "id string, type string"), e, e), ws)
        assert optimized(df).nodeName() == "Union"
        got = [tuple(r) for r in df.collect()]
        assert len(got) == len(set(got)) and sum(p == "der:manages_chain" for _, p, _ in got) == 41 * 40 // 2
        assert {r for r in got if r[1] in ("der:in_department", "der:advances_goal_effective")} == {("p01", "der:in_department", "d"), ("p01", "der:advances_goal_effective", "g"), ("p01", "der:advances_goal_effective", "h")}


def test_inferred_counts_count_facts_where_they_are_made(spark):
    df = __spark_entry__.queries()["inferred_counts"](spark, SF)
    assert [optimized(df).nodeName(), optimized(df).children().head().nodeName()] == ["Aggregate", "Union"]  # before, all facts were made distinct in between
    assert {r.p: r.n for r in df.collect()} == dict(Counter(r.p for r in __spark_entry__.queries()["inference"](spark, SF).collect()))


def test_chains_are_counted_with_one_shuffle(spark):
    """Before, the pairs themselves went through every round's shuffles and were written."""
    df = __spark_entry__.queries()["qa_chains"](spark, SF)
    assert "Join" not in optimized(df).toString()
    rows = df.collect()
    up = {}
    for r in __spark_entry__.queries()["mgmt_chain"](spark, SF).collect():
        up.setdefault(r.id, set()).add(r.ancestor)
    assert {r.id: (r.n, r.difficulty) for r in rows} == {k: (n, "hard" if n > 1 else "medium") for k, v in up.items() if (n := len(v - {k}))}
