"""The operators for orphans, as-of attributes, hierarchies and nested records, against brute force and odd inputs."""

import datetime as dt
import json
import random

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoweave.operators import asof, flatten, forest, orphans
from chronoweave.runtime import Workspace

T = lambda h: dt.datetime(2027, 1, 1) + dt.timedelta(hours=h)
REC = "id string, first_seen timestamp_ntz, deleted_at timestamp_ntz"
REF = "row_key string, ref_id string, arrived timestamp_ntz, extra string, tab string"


def graph(spark, nodes, edges, edge_refs, prov):
    records = {"nodes": spark.createDataFrame(nodes, REC), "edges": spark.createDataFrame(edges, REC)}
    keys = [orphans.ForeignKey("edges", "src", spark.createDataFrame(edge_refs, REF), ("nodes",)), orphans.ForeignKey("provenance", "target_id", spark.createDataFrame(prov, REF), ("edges", "nodes"))]
    return keys, records


def test_orphans_states_and_inheritance(spark):
    nodes = [("a", T(0), None), ("b", T(0), T(5)), ("c", T(9), None)]
    edges = [("e1", T(1), None), ("e2", T(6), None), ("e3", T(1), None), ("e4", T(1), None)]
    refs = [("e1", "a", T(1), "x", "clash"), ("e1", "a", T(3), "x", "clash"), ("e2", "b", T(6), None, None), ("e3", "c", T(1), "", "t"), ("e4", "zz", T(1), "", "t"), ("e5", None, T(1), "", ""), ("e6", "  ", T(1), "", "")]
    prov = [("e2", "e2", T(7), "", ""), ("a", "a", T(7), "", ""), ("e9", "e9", T(7), "", ""), (None, None, T(7), "", "")]
    with Workspace(spark, "t") as ws:
        got = {(r.tab, r.row_key, r.state, r.kind, r.depth) for r in orphans.cascade(*graph(spark, nodes, edges, refs, prov), ws).collect()}
    assert got == {
        ("edges", "e2", "deleted", "direct", 0), ("edges", "e3", "late", "direct", 0), ("edges", "e4", "missing", "direct", 0),
        ("provenance", "e9", "missing", "direct", 0), ("provenance", "e2", "orphaned_parent", "inherited", 1),
    }


def test_orphans_empty_and_deleted_at_the_same_instant(spark):
    with Workspace(spark, "t") as ws:
        assert orphans.cascade(*graph(spark, [], [], [], []), ws).count() == 0
        same = orphans.direct_orphans(*graph(spark, [("a", T(0), T(4))], [], [("e", "a", T(4), "", ""), ("f", "a", T(3), "", "")], [])).collect()
    assert [(r.row_key, r.state) for r in same] == [("e", "deleted")]


def test_orphans_self_reference_runs_to_the_fixpoint(spark):
    """A chain whose top is missing: everything below inherits, circles end."""
    rows = [(f"n{i}", f"n{i - 1}" if i else "gone", T(i), "", "") for i in range(7)] + [("x", "y", T(1), "", ""), ("y", "x", T(1), "", "")]
    records = {"log": spark.createDataFrame([(r[0], T(0), None) for r in rows], REC)}
    key = orphans.ForeignKey("log", "parent", spark.createDataFrame(rows, REF), ("log",))
    with Workspace(spark, "t") as ws:
        got = {r.row_key: r.depth for r in orphans.cascade([key], records, ws).collect()}
    assert got == {f"n{i}": i for i in range(7)}


def test_report_counts_by_month(spark):
    rows = spark.createDataFrame([("edges", "e", "src", "a", T(1), "missing", "direct"), ("edges", "f", "src", "a", T(2), "missing", "direct")], "tab string, row_key string, field_name string, ref_id string, arrived timestamp_ntz, state string, kind string")
    assert [(r.month, r.n_refs, r.n_targets) for r in orphans.report(rows).collect()] == [("2027-01", 2, 1)]


def brute_asof(events, changes):
    out = {}
    for eid, key, at in events:
        best = None
        for k, avail, value in changes:
            if k == key and k is not None and avail is not None and at is not None and avail <= at and value is not None and (best is None or value > best):
                best = value
        out[eid] = best
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_asof_against_brute_force(spark, hot):
    rng = random.Random(5)
    n = 9000 if hot else 300
    key = lambda: "hot" if hot and rng.random() < 0.6 else rng.choice(["a", "b", "c", None, ""])
    events = [(i, key(), T(rng.randrange(200)) if rng.random() < 0.95 else None) for i in range(n)]
    changes = [(key(), T(rng.randrange(200)) if rng.random() < 0.95 else None, rng.choice([None, *range(50)])) for _ in range(n // 30)]
    ev = spark.createDataFrame(events, "event int, k string, at timestamp_ntz").withColumn("value", F.lit("clash")).withColumn("_at", F.lit(1))
    ch = spark.createDataFrame(changes, "k string, seen timestamp_ntz, v int").withColumn("at", F.lit("clash"))
    got = asof.carry_forward(ev, ch, "k", "at", "seen", {"value": F.col("v")}).collect()
    assert len(got) == n
    assert {r.event: r.value for r in got} == brute_asof(events, changes)


def test_asof_empty_sides_and_ties(spark):
    ev = spark.createDataFrame([(1, "a", T(3))], "event int, k string, at timestamp_ntz")
    ch = spark.createDataFrame([("a", T(3), 7), ("a", T(3), 7), ("a", T(4), 9)], "k string, seen timestamp_ntz, v int")
    tracks = {"value": F.col("v")}
    assert asof.carry_forward(ev, ch, "k", "at", "seen", tracks).first().value == 7
    assert asof.carry_forward(ev, ch.limit(0), "k", "at", "seen", tracks).first().value is None
    assert asof.carry_forward(ev.limit(0), ch, "k", "at", "seen", tracks).count() == 0


def brute_forest(links):
    out = {}
    for node in links:
        seen, cur = [], node
        while cur not in seen and links[cur] in links:
            seen.append(cur)
            cur = links[cur]
        if cur in seen:
            out[node] = (min(seen[seen.index(cur):]), -1, None)
        else:
            out[node] = (cur, len(seen), [cur, *reversed(seen)])
    return out


def solve(spark, links, paths=True):
    df = spark.createDataFrame([(i, p, "x", True) for i, p in links], "id string, parent_event string, root string, top boolean")
    with Workspace(spark, "t") as ws:
        flat = ws.put(forest.parent_links(df, "id", "parent_event"), keep=True)
        return forest.contract(flat, ws, paths).collect()


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 40), st.one_of(st.none(), st.integers(0, 45))), max_size=60))
def test_forest_against_brute_force(spark, rows):
    links = {}
    for i, p in rows:
        links.setdefault(f"n{i:02d}", None if p is None else f"n{p:02d}")
    got = solve(spark, list(links.items()))
    assert {r.id: (r.root, r.depth, r.path) for r in got} == brute_forest(links)


def test_forest_long_chain_circle_hub_blank_and_repeats(spark):
    links = {f"c{i:03d}": f"c{i - 1:03d}" if i else None for i in range(300)}
    links |= {f"r{i}": f"r{(i + 1) % 5}" for i in range(5)} | {"tail": "r3", "tail2": "tail", "self": "self", "blank": "  ", "lost": "nowhere"}
    links |= {f"h{i}": "hub" for i in range(400)} | {"hub": None}
    got = solve(spark, [*links.items(), *list(links.items())[:50], (None, "hub")])
    assert len(got) == len(links)
    assert {r.id: (r.root, r.depth, r.path) for r in got} == brute_forest({k: v for k, v in links.items()})
    assert sorted(sorted(r.circle) for r in got if r.circle) == [[f"r{i}" for i in range(5)], ["self"]]
    assert solve(spark, []) == []
    assert {(r.id, r.depth) for r in solve(spark, [("a", None)], paths=False)} == {("a", 0)}


def test_descendants(spark):
    df = spark.createDataFrame([("a", 0, ["a"]), ("b", 1, ["a", "b"]), ("c", 2, ["a", "b", "c"]), ("x", -1, None)], "id string, depth int, path array<string>")
    assert {tuple(r) for r in forest.descendants(df).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}


BODIES = [
    ("one", '{"s":{"h":[1,null,"x"]}}'), ("list", '{"s":[null,"mild",{"h":null},{"h":[]},{"h":{"by":"a"}}]}'), ("twice", json.dumps('{"s":["a"]}')), ("null", '{"s":null}'),
    ("broken", '{"s":["a"]'), ("none", None), ("empty", ""), ("number", "3"), ("nothing", "{}"), ("long", json.dumps({"s": ["y" * 200_000]})), ("one", '{"s":{"h":[1,null,"x"]}}'),
]


def test_flatten_shapes(spark):
    level = flatten.Level("$.s", (("value", "$", "string"),), flatten.Level("$.h", (("by", "$.by", "string"),)))
    df = spark.createDataFrame(BODIES, "record_id string, body string").withColumn("v", flatten.parsed("body"))
    rows = df.select("record_id", F.lit("s").alias("list_name"), F.expr(flatten.nested("v", level)).alias("lists"))
    flat = flatten.flatten(rows, level)
    got = {(r.record_id, r.no_0, -1 if r.no_1 is None else r.no_1) for r in flat.collect()}
    one = lambda k, *pos: {(k, i, j) for i, j in pos}
    assert got == one("one", (0, -1), (0, 0), (0, 2)) | one("list", (1, -1), (2, -1), (3, -1), (4, -1), (4, 0)) | one("twice", (0, -1)) | one("long", (0, -1))
    assert flatten.flatten(rows.limit(0), level).count() == 0
    keys = flatten.flatten(df.select("record_id", F.expr(flatten.nested("v", level.bare())).alias("lists")), level.bare())
    assert keys.columns == ["record_id", "no_0", "no_1"] and {(r[0], r[1], -1 if r[2] is None else r[2]) for r in keys.collect()} == got
    parents = {(r.record_id, r.no_0): r.value for r in flatten.table(flat, level, 0).collect()}
    assert parents["list", 1] == "mild" and parents["list", 4] is None and parents["long", 0] == "y" * 200_000
    assert [tuple(r) for r in flatten.table(flat, level, 1).where("by is not null").collect()] == [("list", 4, 0, "a")]


def test_flatten_kernel_on_sliced_and_null_lists():
    kind = pa.list_(pa.struct([("item", pa.string()), ("_inner", pa.list_(pa.struct([("sub", pa.string())])))]))
    subs = lambda *xs: [None if x is None else {"sub": x} for x in xs]
    lists = pa.array([[{"item": "skip", "_inner": None}], None, [], [None, {"item": "a", "_inner": subs("p", None, "q")}], [{"item": "b", "_inner": []}]], kind)[1:]
    schema = pa.schema([("record_id", pa.string()), ("no_0", pa.int32()), ("no_1", pa.int32()), ("item", pa.string()), ("sub", pa.string())])
    got = [r for b in flatten.flatten_batch(pa.array(list("wxyz")), lists, schema, 2) for r in b.to_pylist()]
    assert {(r["record_id"], r["no_0"], r["no_1"], r["item"], r["sub"]) for r in got} == {("y", 1, None, "a", None), ("y", 1, 0, None, "p"), ("y", 1, 2, None, "q"), ("z", 0, None, "b", None)}


def test_flatten_any_depth_with_typed_fields(spark):
    level = flatten.Level("$.a", (("x", "$.x", "int"),), flatten.Level("$.b", (("y", "$.y", "double"),), flatten.Level("$.c", (("z", "$", "string"),))))
    body = '{"a":[{"x":1,"b":[{"y":0.5,"c":["p",null,"q"]},{"c":"r"}]},null,{"x":"no number","b":{"y":2}}]}'
    rows = spark.createDataFrame([("k", body)], "record_id string, body string").withColumn("v", flatten.parsed("body")).select("record_id", F.expr(flatten.nested("v", level)).alias("lists"))
    flat = flatten.flatten(rows, level)
    tables = [{tuple(r)[1:] for r in flatten.table(flat, level, d).collect()} for d in range(3)]
    assert tables == [{(0, 1), (2, None)}, {(0, 0, 0.5), (0, 1, None), (2, 0, 2.0)}, {(0, 0, 0, "p"), (0, 0, 2, "q"), (0, 1, 0, "r")}]


def test_subtree_sizes_without_pairs(spark):
    rng = random.Random(8)
    links = {f"n{i}": f"n{rng.randrange(i)}" if i else None for i in range(300)} | {f"c{i}": f"c{i - 1}" if i else None for i in range(120)}
    links |= {f"r{i}": f"r{(i + 1) % 4}" for i in range(4)} | {"t0": "r0", "t1": "t0", "t2": "t0"}
    with Workspace(spark, "t") as ws:
        solved = forest.contract(spark.createDataFrame(list(links.items()), "id string, parent string"), ws, sizes=True)
        got = {r.id: r.size for r in solved.collect()}
    want = dict.fromkeys(links, 0)
    for k in links:
        while k is not None and not k.startswith("r"):
            want[k] += 1
            k = links[k]
    assert {k: v for k, v in got.items() if not k.startswith("r")} == {k: v for k, v in want.items() if not k.startswith("r")}
