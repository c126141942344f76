"""Registered queries and operators do the whole job: what a narrower form left out, against brute force."""

import __spark_entry__
from chronoweave.runtime import read_table

SF = "/root/testdata/sf0.001"


def test_neighbors_of_every_entity(spark):
    there = {r.id for r in read_table(spark, SF, "nodes").select("id").collect()}
    want: dict = {}
    for e in read_table(spark, SF, "edges").select("src", "dst").collect():
        for d, a, b in (("out", e.src, e.dst), ("in", e.dst, e.src), ("both", e.src, e.dst), ("both", e.dst, e.src)):
            if a is not None and b in there:
                want.setdefault((d, a), set()).add(b)
    got = {(r.direction, r.id): (r.n, r.neighbors) for r in __spark_entry__.queries()["neighbors"](spark, SF).collect()}
    assert got == {k: (len(v), "|".join(sorted(v))) for k, v in want.items()}
