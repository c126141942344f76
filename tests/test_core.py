"""Graph, traversal, journal, scoring, text, sources and streaming on small fixtures."""

import datetime as dt
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from chronoweave.operators import graph as g
from chronoweave.operators import infer, journal, score, text, traverse, validate
from chronoweave.runtime import Workspace, hot_keys
from chronoweave.sources import exports, runs
from chronoweave.streaming import journal as stream

SF = "/root/testdata/sf0.001"
D = lambda d, h=9, m=0: dt.datetime(2026, 1, d, h, m)


def make(spark, nodes, edges, events=()):
    n = spark.createDataFrame([(i, t, D(d), json.dumps(p), a, None) for i, t, d, p, a in nodes], "id string, type string, created timestamp_ntz, props string, aliases array<string>, deleted_at timestamp_ntz")
    e = spark.createDataFrame([(f"{t}:{a}->{b}", t, a, b, D(d), "{}") for t, a, b, d in edges], "id string, type string, src string, dst string, created timestamp_ntz, props string")
    j = spark.createDataFrame(list(events), "id string, type string, ts timestamp_ntz, actors map<string,array<string>>, subjects array<string>, parent_event string, payload string")
    return g.TemporalGraph(n, e, j)


@pytest.fixture(scope="module")
def org(spark):
    nodes = [(i, t, d, {"name": i.title()}, [i]) for i, t, d in [("ann", "Person", 1), ("ben", "Person", 2), ("cy", "Person", 3), ("team", "Team", 1), ("dep", "Department", 1), ("g1", "Goal", 1), ("g2", "Goal", 1), ("p", "Project", 4)]]
    edges = [("reports_to", "ben", "ann", 2), ("reports_to", "cy", "ben", 3), ("member_of", "cy", "team", 3), ("part_of", "team", "dep", 1), ("subgoal_of", "g2", "g1", 1), ("advances_goal", "p", "g2", 4), ("collaborates_with", "ann", "cy", 3), ("leads", "ann", "dep", 1), ("works_on", "ann", "ghost", 5)]
    events = [("e1", "Raised", D(2, 10), {"by": ["ann"]}, ["p"], None, "{}"), ("e2", "Comment", D(1, 10), {"by": ["ben", "nobody"]}, ["ghost"], "e1", '{"in_reply_to":"e1"}'), ("e3", "Comment", D(3, 20), {"by": ["ann"]}, None, "lost", None)]
    return make(spark, nodes, edges, events)


def ids(df, *c):
    return sorted(tuple(r) if len(r) > 1 else r[0] for r in df.select(*(c or ["id"])).collect())


def test_projection_bounds_are_inclusive(org):
    assert ids(org.at("2026-01-02 09:00:00").of_type("Person")) == ["ann", "ben"]
    assert ids(org.at("2026-01-03 09:00:00", "1 day").of_type("Person")) == ["ben", "cy"]


def test_focus_needs_both_ends_in_the_set(spark, org):
    f = org.focus(spark.createDataFrame([("ann",), ("ben",), ("ghost",)], "id string"))
    assert ids(f.edges) == ["reports_to:ben->ann", "works_on:ann->ghost"]
    assert ids(f.events) == ["e1", "e2", "e3"]


def test_neighbors_skip_what_does_not_exist(org):
    assert ids(org.neighbors("out").where("id = 'ann'"), "neighbor") == ["cy", "dep"]
    with pytest.raises(ValueError):
        org.neighbors("sideways")


def test_labels(spark):
    t = make(spark, [("a", "Person", 1, {"title": "Lead", "name": "Ann"}, ["Annie"]), ("b", "Goal", 1, {"statement": "Win"}, []), ("c", "X", 1, {"title": " "}, [""]), ("d", "X", 1, {}, None)], [])
    got = {r.id: (r.q, r.m) for r in t.nodes.select("id", g.question_label().alias("q"), g.model_label().alias("m")).collect()}
    assert got == {"a": ("Annie", "Lead"), "b": ("Win", "Win"), "c": (" ", "c"), "d": ("d", "d")}


def test_missing_never_matches(spark):
    df = spark.createDataFrame([(None,), ("x",)], "v string")
    assert df.where(g.matches(F.col("v"), "ne", "y")).count() == 1
    with pytest.raises(ValueError):
        g.matches(F.col("v"), "like", "x")


def test_inference_rules(spark, org):
    with Workspace(spark, "t") as ws:
        got = {tuple(r) for r in infer.infer(org, ws).collect()}
    assert {("cy", "der:reports_to_chain", "ann"), ("ann", "der:manages_chain", "cy"), ("cy", "rel:collaborates_with", "ann"), ("p", "der:advances_goal_effective", "g1"), ("cy", "der:in_department", "dep"), ("ann", "der:in_department", "dep")} <= got
    assert not any(p == "rel:collaborates_with" and s == "ann" for s, p, _ in got)


def brute_closure(pairs):
    out = set(pairs)
    while True:
        more = {(a, d) for a, b in out for c, d in out if b == c} - out
        if not more:
            return out
        out |= more


def test_traversal_against_brute_force(spark):
    rng = random.Random(3)
    pairs = {(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(30)}
    df = spark.createDataFrame([(f"{a}{b}", a, b) for a, b in pairs], "id string, src string, dst string")
    want = brute_closure(pairs)
    with Workspace(spark, "t") as ws:
        assert {tuple(r) for r in traverse.closure(df, ws).collect()} == want
        scc = {r.id: r.scc for r in traverse.strong_components(df, ws).collect()}
        assert set(scc) == {a for a, b in want if a == b} and all((scc[a] == scc[b]) == ((a, b) in want and (b, a) in want) for a in scc for b in scc if a != b)
        comp = {r.id: r.component for r in traverse.components(df.select(F.col("src").alias("a"), F.col("dst").alias("b")), ws).collect()}
        both = brute_closure(pairs | {(b, a) for a, b in pairs})
        assert comp == {x: min([b for a, b in both if a == x] + [x]) for x in {x for p in pairs for x in p}}
        assert traverse.components(df.select(F.col("src").alias("a"), F.col("dst").alias("b")).limit(0), ws).count() == 0
        active = {r.id for r in traverse.activation_fixpoint(df, spark.createDataFrame([("n1",)], "id string"), ws).collect()}
        assert active == {"n1"} | {b for a, b in want if a == "n1"}


def test_khop_clamps_and_misses_last_layer_edges(spark):
    df = spark.createDataFrame([(f"e{i}", f"c{i}", f"c{i + 1}") for i in range(8)] + [("x", "c1", "z"), ("y", "z", "c2")], "id string, src string, dst string")
    start = spark.createDataFrame([("c0",)], "id string")
    with Workspace(spark, "t") as ws:
        assert ids(traverse.khop(df, start, 0, ws)[0]) == ["c0", "c1"]
        nodes, edges = traverse.khop(df, start, 2, ws)
        assert ids(nodes) == ["c0", "c1", "c2", "z"] and "y" not in ids(edges)
        assert max(r.hops for r in traverse.khop(df, start, 99, ws)[0].collect()) == 6
        hops = {r.id: (r.hops, r.via) for r in traverse.distances(df, "c0", ws).collect()}
    assert hops["c0"] == (0, None) and hops["z"] == (2, "c1") and hops["c8"][0] == 8


def test_diff_orientation(spark):
    a, b = (spark.createDataFrame(x, "id string, type string") for x in ([("k", "T"), ("old", "T")], [("k", "T"), ("new", "U")]))
    changes = g.diff(a, b)
    assert ids(changes, "id", "change") == [("k", "common"), ("new", "added"), ("old", "removed")]
    assert ids(g.type_deltas(changes), "type", "added", "removed") == [("T", 0, 1), ("U", 1, 0)]


def test_validation_kinds(spark, org):
    kinds = {(r.kind, r["where"], r.detail) for r in validate.dangling(org).collect()}
    assert kinds == {("dangling_edge", "works_on:ann->ghost", "dst=ghost"), ("dangling_subject", "e2", "subject=ghost"), ("dangling_actor", "e2", "by=nobody"), ("dangling_parent", "e3", "lost")}
    assert ids(validate.child_before_parent(org.events), "where") == ["e2"]
    assert {(r.kind, r["where"]) for r in validate.unresolved_replies(org.events).collect()} == {("reply_too_late", "e2"), ("reply_unresolved", "e3")}
    assert ids(validate.outside_hours(org.events), "where") == ["e3"]
    assert validate.out_of_window(org, "2026-01-01 09:00:00", "2026-01-03 20:00:00").count() == 3
    declared = spark.createDataFrame([("Raised",)], "type string")
    assert {r.n for r in validate.summary(validate.undeclared_types(org.events, declared)).collect()} == {2}


def brute_conflicts(rows):
    out = {}
    for p in {r[1] for r in rows}:
        held = None
        for i, _, s, e in sorted([r for r in rows if r[1] == p], key=lambda r: (r[2], r[3], r[0])):
            if held and s < held[0]:
                out[i] = held[1]
            if held is None or e > held[0]:
                held = (e, i)
    return out


@pytest.mark.parametrize("n", [60, 9000])
def test_conflicts_against_brute_force(spark, n):
    """With the larger number a person is cut into slices."""
    rng = random.Random(1)
    rows = [(i, rng.choice("aab"), s := D(1) + dt.timedelta(minutes=10 * rng.randrange(n)), s + dt.timedelta(minutes=10 * rng.randrange(1, 6))) for i in range(n)]
    df = spark.createDataFrame([*rows, (99_999, None, D(1), D(2))], "id int, person string, start timestamp_ntz, end timestamp_ntz")
    assert {r.id: r.conflicts_with for r in journal.conflicts(df).collect()} == brute_conflicts(rows)


def test_working_time(spark):
    cases = [(D(2, 16), 2, D(5, 10)), (D(2, 16), 1, D(2, 17)), (D(3, 12), 8, D(5, 17)), (D(3, 12), 0, D(3, 12)), (D(5, 8), 16, D(6, 17)), (D(5, 17), 0.5, D(6, 9, 30)), (D(1, 10, 15), 40, D(8, 10, 15))]
    df = spark.createDataFrame([(i, t, float(h)) for i, (t, h, _) in enumerate(cases)], "id int, ts timestamp_ntz, h double")
    assert [r.at for r in journal.advance(df, "ts", F.col("h"), "at").orderBy("id").collect()] == [w for _, _, w in cases]
    words = spark.createDataFrame([("2h",), ("1.5d",), ("day 2",), ("30m",), ("soon",)], "t string")
    assert [r[0] for r in words.select(journal.working_seconds(F.col("t"))).collect()] == [7200.0, 43200.0, 57600.0, 1800.0, None]


def test_gini_closed_form_equals_pairwise(spark):
    xs = [0, 1, 1, 4, 9]
    got = journal.gini(spark.createDataFrame([("a", x) for x in xs] + [("z", 0), ("z", 0)], "k string, x bigint"), ["k"], "x").collect()
    want = sum(abs(a - b) for a in xs for b in xs) / (2 * len(xs) * sum(xs))
    assert {r.k: round(r.gini, 9) for r in got} == {"a": round(want, 9), "z": 0.0}


def test_booking_is_greedy_and_free_of_overlap(spark):
    rows = [(1, "a", D(2, 16, 30), 60.0), (2, "a", D(2, 9), 60.0), (3, "a", D(2, 9, 30), 60.0), (4, "a", D(2, 9), 600.0)]
    out = {r.id: (r.start, r.forced) for r in journal.book(spark.createDataFrame(rows, "id int, person string, wish timestamp_ntz, minutes double")).collect()}
    assert out[2] == (D(2, 9), False) and out[4] == (D(2, 9), True) and out[1][0] >= D(5, 9)


def test_triggers_stock_and_ids(spark):
    df = spark.createDataFrame([(i, "u", D(1, i), v) for i, v in enumerate([9.0, 2.0, 1.0, 8.0, 3.0, None, 2.0])], "id int, u string, ts timestamp_ntz, v double")
    assert ids(journal.triggers(df, "u", F.col("v") < 5)) == [1, 4, 6]
    assert [r.stock for r in journal.running_stock(df.na.fill(0.0), "u", "v", 12.0).orderBy("id").collect()] == [3.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    names = spark.createDataFrame([("1", "Ä!"), ("2", "a b"), ("3", "A-B"), ("4", None)], "id string, n string").withColumn("base", journal.slug(F.col("n")))
    assert [r.unique_id for r in journal.numbered(names, "base", ["id"]).orderBy("id").collect()] == ["x", "a-b", "a-b-2", "x-2"]


def test_scores_of_empty_sets(spark):
    items = spark.createDataFrame([("both",), ("none",), ("miss",), ("extra",)], "id string")
    e = spark.createDataFrame([("both", "a"), ("both", "b"), ("both", "a"), ("miss", "a")], "id string, member string")
    q = spark.createDataFrame([("both", "b"), ("both", "c"), ("extra", "z"), ("unknown", "z")], "id string, member string")
    got = {r.id: (r.p, r.r, r.f1, r.exact) for r in score.grade(e, q, items, "id").collect()}
    assert got == {"both": (0.5, 0.5, 0.5, False), "none": (1.0, 1.0, 1.0, True), "miss": (0.0, 0.0, 0.0, False), "extra": (0.0, 0.0, 0.0, False)}
    assert {r.f1 for r in score.compare(e.withColumn("t", F.lit("x")), e.withColumn("t", F.lit("x")), ["id", "member"], "t").collect()} == {1.0}


def test_greedy_alignment_takes_the_lowest_free(spark):
    df = spark.createDataFrame([("b", "r1", "g1"), ("b", "r1", "g2"), ("b", "r2", "g1"), ("b", "r3", "g1")], "block string, other string, gold string")
    assert ids(score.align(df), "other", "gold") == [("r1", "g1")]


def test_chunking_and_packing(spark):
    doc = "intro\n# A\none\n## B\n```\n# no heading\n```\ntwo\n# C\n\n"
    got = text.sections(doc)
    assert [(c, t.split("\n")[0]) for c, _, t in got] == [("", "intro"), ("A", "# A"), ("A > B", "## B"), ("C", "# C")]
    assert all(doc[o : o + len(t)] == t for _, o, t in got)
    assert text.sections(None) == []
    packed = text.pack_passages(spark.createDataFrame([(1, ""), (2, "\n\n".join("w " * 60 for _ in range(5))), (3, None), (4, " \n \n\u00a0"), (5, "w " * 400 + "\n\nend")], "doc_id bigint, text string")).collect()
    assert [(r.doc_id, len(r.text.split())) for r in sorted(packed, key=lambda r: (r.doc_id, r.idx))] == [(2, 120), (2, 120), (2, 60), (5, 400), (5, 1)]


def test_tagging_claims_longest_first(spark):
    docs = spark.createDataFrame([(1, "Ann Lee met Ann; O'Ann and Annie"), (2, None), (3, "")], "doc_id bigint, text string")
    roster = spark.createDataFrame([("Ann Lee", "p1"), ("Ann", "p2"), ("met", "p3")], "surface string, entity_id string")
    assert ids(text.tag_mentions(docs, roster), "offset", "length", "entity_id") == [(0, 7, "p1"), (8, 3, "p3"), (12, 3, "p2")]


def test_ticket_chunks(spark):
    body = json.dumps({"fields": {"summary": "S", "description": " ", "comment": {"comments": [{"body": "one"}, {"body": ""}, {"body": "two"}]}}})
    df = spark.createDataFrame([("a", body), ("b", "{broken"), ("c", None)], "path string, text string")
    assert ids(text.chunk_ticket(df), "section", "text") == [("fields.comment.comments[0].body", "one"), ("fields.comment.comments[2].body", "two"), ("fields.summary", "S")]


def test_mentions_resolve_within_their_type(spark):
    rows = [("1", "P", "Ann Meyer"), ("2", "P", " ann  MEYER "), ("3", "P", "Anne Meyer"), ("4", "Q", "Ann Meyer"), ("5", "P", "Zeno"), ("6", None, "Zeno"), ("7", "P", None)]
    with Workspace(spark, "t") as ws:
        got = {r.mention_id: (r.type, r.entity) for r in text.resolve_mentions(spark.createDataFrame(rows, "id string, type string, surface string"), ws, 0.6).collect()}
    assert got["1"] == got["2"] == got["3"] and got["4"] != got["1"] and got["5"] != got["6"] and "7" not in got


def test_run_round_trip_and_tolerance(spark, tmp_path):
    root = f"file://{tmp_path}/runs/a"
    nodes = spark.createDataFrame([("b", "T", "2026-01-01T00:00:00", "{}", ["x"]), ("a", "T", None, None, None)], runs.TABLES["nodes"])
    runs.write_table(nodes, root, "nodes")
    assert sorted(runs.read_table(spark, root, "nodes").collect()) == sorted(nodes.collect())
    assert ids(runs.schema_issues(nodes, "nodes"), "id", "field") == [("a", "created_at")]
    assert [p.rsplit("/", 1)[1] for p in runs.discover(spark, f"file://{tmp_path}")] == ["a"]
    assert runs.read_table(spark, root, "edges", tolerant=True).count() == 0
    bad = tmp_path / "runs/a/kg/edges.jsonl"
    bad.write_text('{"id":"e","type":"t"}\n{broken\n\n{"id":"e","type":"t"}\n')
    assert runs.read_table(spark, root, "edges", tolerant=True).count() == 2
    assert ids(runs.duplicates(runs.read_table(spark, root, "edges", tolerant=True)), "id") == ["e"]
    with pytest.raises(Exception):  # noqa: B017
        runs.read_table(spark, root, "edges").collect()


def test_corpus_text_per_format(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    with zipfile.ZipFile(tmp_path / "docs/a.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p><w:r><w:t>Hi &amp; bye</w:t></w:r></w:p><w:p><w:t>two</w:t></w:p>")
    (tmp_path / "docs/b.jira.json").write_text('{"a":["x",{"b":" y "}],"n":1}')
    (tmp_path / "c.eml").write_bytes(b"Subject: Hello\nContent-Type: text/plain\n\nbody\n")
    (tmp_path / "d.md").write_text("# head")
    got = {r.path: r.text for r in runs.corpus(spark, str(tmp_path)).collect()}
    assert got == {"docs/a.docx": "Hi & bye\ntwo", "docs/b.jira.json": "x\ny", "c.eml": "Hello\nbody", "d.md": "# head"}


def test_exports(spark, org, tmp_path):
    lines = [r.statement for r in exports.statements(org.nodes, org.edges).orderBy("position").collect()]
    assert lines[0].startswith("MERGE (n:`Person` {id: 'ann'})") and not any("ghost" in x for x in lines)
    exports.write_csv(org.nodes, org.edges, f"file://{tmp_path}/csv")
    assert (tmp_path / "csv/nodes/type=Person").exists()
    assert exports.node_link(org.nodes, org.edges).count() == 17
    assert exports.flattened(org.nodes, "Person", ["name", "Order"]).columns == ["id", "name", "p_order"]


def test_streaming_counts_once_and_alerts_across_batches(spark, tmp_path):
    src = tmp_path / "in"
    for k, rows in enumerate([[(1, "a", D(1, 9), True), (1, "a", D(1, 9), True)], [(2, "a", D(1, 10), True), (3, "a", D(1, 11), False)], [(4, "a", D(1, 12), True)]]):
        spark.createDataFrame(rows, "id int, key string, ts timestamp, low boolean").coalesce(1).write.parquet(f"file://{src}/b{k}")
    schema = "id int, key string, ts timestamp, low boolean"

    def run(make, mode, name):
        df = make(stream.read(spark, f"file://{src}/*", schema))
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert len(run(lambda d: stream.once(d, "id", "ts", "10 hours"), "append", "once")) == 4
    assert sum(r.n for r in run(lambda d: stream.counts(d, "ts", "key", delay="10 hours"), "complete", "counted")) == 5
    assert sorted(r.id for r in run(stream.alerts, "append", "alerted")) == [1, 4]


def test_hot_keys_are_few(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"))
    assert [(r.k, r._pieces > 1) for r in hot_keys(df, ["k"], 8).collect()] == [("hot", True)]


def test_every_core_query_is_named_and_flagship_runs(spark):
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert {"p1_found", "p2_found", "p4_found", "p6_found"} <= set(names)
    rows = names["graph_top_degree"](spark, SF)
    assert rows.columns == ["id", "type", "degree"] and rows.count() > 0
