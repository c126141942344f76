"""Graph building, static checks and reproducible values."""

import json

from pyspark.sql import functions as F

from chronoweave.functions import stable
from chronoweave.operators import kgbuild, playbook
from chronoweave.runtime import Workspace


def rows(df, *c):
    return sorted(tuple(r) for r in df.select(*c).collect())


def test_extraction_to_edges(spark):
    body = json.dumps({"mentions": [{"surface_form": "Ann", "type": "Person"}, {"surface_form": "Zed", "type": "Person"}, {"surface_form": "Ann", "type": "Alien"}],
                       "triples": [{"src": "ANN", "rel": "leads", "dst": "The  Team", "confidence": 0.4}, {"src": "Ann", "rel": "leads", "dst": "The Team", "confidence": "high"}, {"src": "Ann", "rel": "eats", "dst": "Ann"}, {"src": "Ann", "rel": "leads", "dst": "ann", "confidence": 1}]})
    env = spark.createDataFrame([("c1", body), ("c2", "{broken"), ("c3", None)], "chunk_id string, body string")
    chunks = spark.createDataFrame([("c1", "Then Ann left The Team", "p1"), ("c2", "", "p2")], "id string, text string, source_path string")
    assert rows(kgbuild.mention_spans(env, chunks, ["Person"]), "surface_form", "start", "stop") == [("Ann", 5, 8), ("Zed", -1, -1)]
    found = spark.createDataFrame([("c1", "Ann", "person:b"), ("c1", "ann", "person:a"), ("c1", "the team", "team:t")], "chunk_id string, surface_form string, entity_id string")
    triples = kgbuild.candidate_triples(env, ["leads"])
    edges = kgbuild.edges(kgbuild.resolve_triples(triples, found), chunks)
    assert [(r.id, r.support, r.confidence, r.chunk_ids, r.source_paths) for r in edges.collect()] == [("edge:leads:person:a:team:t", 2, 1.0, ["c1"], ["p1"])]
    nodes = spark.createDataFrame([("artifact:1", "Artifact", '{"path":"p1"}')], "id string, type string, props string")
    grounded = kgbuild.node_provenance(found.unionByName(spark.createDataFrame([("c2", "x", "team:t")], found.schema)), chunks)
    pairs, made = kgbuild.project_groundings(grounded, nodes)
    assert ("team:t", "p2") in rows(pairs, "entity_id", "artifact") and rows(made, "id") == [("p2",)]


def test_aliases_resolve_longest_and_ambiguous(spark):
    q = spark.createDataFrame([(1, "Did Ann Lee meet annex Ann?"), (2, "nobody"), (3, None)], "id int, text string")
    index = spark.createDataFrame([("Ann Lee", "p1"), ("ann", "p2"), ("ANN", "p3"), ("Lee", "p4"), (" ", "p5")], "surface string, entity_id string")
    assert rows(kgbuild.resolve_aliases(q, index), "id", "entity_id") == [(1, "p1"), (1, "p2"), (1, "p3")]


def test_snippets(spark):
    loc = "struct<medium:string,offset:int,length:int,line:int>"
    m = spark.createDataFrame([("p", "e", "x", ("md", 0, 1, 2)), ("p", "f", "x", None), ("q", "g", "x", ("md", 0, 1, 9))], f"artifact_path string, entity_id string, surface_form string, locator {loc}")
    t = spark.createDataFrame([("p", "one\ntwo")], "path string, text string")
    assert {(r.entity_id, r.snippet) for r in kgbuild.snippets(m, t).collect()} == {("e", "two"), ("f", "one"), ("g", None)}


def test_playbook_checks(spark):
    a = spark.createDataFrame([("start", True, False, "doc", 1, 10), ("loop1", False, False, None, 1, 10), ("loop2", False, False, "doc", 0, 10), ("lost", False, False, "doc", 1, 10**6)], "activation string, root boolean, guarded boolean, deliverable string, staff int, per_run int")
    emits = spark.createDataFrame([("start", "s"), ("loop1", "x"), ("loop2", "y")], "activation string, event string")
    watches = spark.createDataFrame([("loop1", "s"), ("loop2", "x"), ("loop1", "y"), ("lost", "never")], "activation string, event string")
    with Workspace(spark, "t") as ws:
        got = {tuple(r) for r in playbook.issues(a, emits, watches, ws).collect()}
    assert got == {("dead_trigger", "never"), ("unreachable", "lost"), ("unguarded_cycle", "loop1"), ("no_deliverable", "loop1"), ("no_staff", "loop2"), ("volume", "lost")}


def test_reproducible_values(spark):
    assert stable.subseed(7, "a") == stable.subseed(7, "a") != stable.subseed(7, "b")
    assert stable.digest({"a": 1, "scale": 2}) == stable.digest({"scale": 9, "a": 1})
    keys = spark.createDataFrame([("a",), ("b",), ("a",)], "key string")
    one, two = (sorted(stable.arrivals(keys.repartition(n), 3, 2.0, 10).collect()) for n in (1, 4))
    assert one == two and len(one) > 10
    df = spark.createDataFrame([("a\nb\nc", 4, 1, "c", "0.5"), (None, -1, 0, "s", "true"), ("x", 0, 1, "x", "7")], "t string, o int, l int, s string, c string")
    got = df.select(stable.line_of(F.col("t"), F.col("o")), stable.context(F.col("t"), F.col("o"), F.col("l"), F.col("s"), 2), stable.confidence(F.col("c")), stable.request_key(F.col("s"), F.col("o"))).collect()
    assert [tuple(r)[:3] for r in got] == [(3, "b\nc", 0.5), (None, "s", 1.0), (1, "x", 1.0)] and len({r[3] for r in got}) == 3
    assert df.select(stable.subseed_column(F.col("l"), F.col("s"))).distinct().count() == 3
    usage = spark.createDataFrame([("m", 1_000_000, 0, False), ("m", 9, 9, True), ("n", 5, 5, False)], "model string, input_tokens long, output_tokens long, cached boolean")
    prices = spark.createDataFrame([("m", 3.0, 15.0)], "model string, input_price double, output_price double")
    assert rows(stable.token_cost(usage, prices), "model", "calls", "cost") == [("m", 1, 3.0), ("n", 1, 0.0)]
