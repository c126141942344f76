"""A known identifier that several nodes bear falls through to the weaker rules, among its bearers."""

import json

from chronoweave.llm import entity_match
from chronoweave.runtime import Workspace


def test_shared_codes_fall_through_among_their_bearers(spark):
    project = lambda i, name, code, dept: (f"project:{i}", "Project", json.dumps({"name": name, "code": code, "department": dept}), [], 1)
    nodes = [
        project("a", "Maesfeth Dosing Study", "ST-158406", "Clinical Operations"), project("b", "Wourark Washout Trial", "ST-158406", "Drug Safety"),
        project("c", "Maesfeth Dosing Study", "ST-222222", "Clinical Operations"), project("d", "Lone Imaging Pilot", "ST-333333", "Drug Safety"),
    ]
    asked = [
        ("r:name", {"label": "maesfeth dosing study", "code": "158406", "dept": "clinical ops."}),  # two share name and department, one of them the code
        ("r:other", {"label": "Lone Imaging Pilot", "code": "158406", "dept": "Drug Safety"}),  # none of the code's bearers
        ("r:stranger", {"label": "Lone Imaging Pilot", "code": "999999", "dept": "Drug Safety"}), ("r:code", {"label": "LIP", "code": "#333333"}),
    ]
    n = spark.createDataFrame(nodes, "id string, type string, props string, aliases array<string>, rev int")
    q = spark.createDataFrame([(i, "Project", json.dumps(p), []) for i, p in asked], "id string, type string, props string, aliases array<string>")
    with Workspace(spark, "t") as ws:
        got = {r.recon_id: (r.node_id, r.rule) for r in entity_match.match(n, spark.createDataFrame([], "entity_id string, canonical string, aliases array<string>"), q, ws).collect()}
    assert got == {"r:name": ("project:a", "name+department"), "r:code": ("project:d", "identifier")}


def test_identifiers_one_letter_off(spark):
    nodes = [(f"person:{i}", "Person", json.dumps({"name": n, "handle": h}), [], 1) for i, n, h in (("a", "Ann Berg", "aberg12345"), ("b", "Ann Berg", "xberg99876"), ("d", "Eva Lund", "elund11111"), ("e", "Eva Lund", "elund22111"), ("c", "Bo Carl", "bcarl777"))]
    asked = [("r:off", "Ann Berg", "aberg1234"), ("r:far", "Ann Berg", "aberg55555"), ("r:name", "Bo Dahl", "bcarl778"), ("r:swap", "Bo Carl", "bcarl7777"), ("r:torn", "Eva Lund", "elund1111")]  # the last has two namesakes alike at either end
    n = spark.createDataFrame(nodes, "id string, type string, props string, aliases array<string>, rev int")
    q = spark.createDataFrame([(i, "Person", json.dumps({"label": label, "contact": {"mail": f"{m}@x.example"}}), []) for i, label, m in asked], "id string, type string, props string, aliases array<string>")
    with Workspace(spark, "t") as ws:
        got = {r.recon_id: (r.node_id, r.rule) for r in entity_match.match(n, spark.createDataFrame([], "entity_id string, canonical string, aliases array<string>"), q, ws).collect()}
    assert got == {"r:off": ("person:a", "name+identifier one letter off"), "r:swap": ("person:c", "name+identifier one letter off")}
