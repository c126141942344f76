"""Names are compared by workers that hold them, with the same groups as by joins."""

import random

from chronoweave.operators import text
from chronoweave.runtime import Workspace


def test_held_names_give_the_groups_that_joins_give(spark):
    """Before, every pair of names with a rare n-gram in common was shuffled with its vectors, and all of them were written."""
    rng = random.Random(4)
    part = lambda: "".join(rng.choice(["an", "ber", "g", "lund", "ka", "ë", "mo", "ri"]) for _ in range(rng.randrange(1, 4)))
    names = [f"{part()} {part()}" for _ in range(150)] + ["x", "ab", "X ", "ß", "  ", "reduce delay at ost by 4 percent", "reduce delay at ost by 14 percent"]
    rows = [(str(i), rng.choice(["P", "Q", None]), rng.choice([n, n.upper()])) for i, n in enumerate(names * 2)]
    df = spark.createDataFrame([*rows, ("none", "P", None)], "id string, type string, surface string")
    with Workspace(spark, "t") as ws:
        held = text.resolve_mentions(df, ws)
        assert "cosine" not in held._jdf.queryExecution().analyzed().toString() and "component" not in held._jdf.queryExecution().analyzed().toString()
        got = sorted(tuple(r) for r in held.collect())
        assert got == sorted(tuple(r) for r in text.resolve_mentions(df, ws, held=0).collect())
        assert len({r[1:] for r in got}) < len({(t, n.lower().strip()) for _, t, n in rows}) and text.resolve_mentions(df.limit(0), ws).count() == 0


def test_entities_of_held_names(spark):
    df = spark.createDataFrame([(str(i), "P", n) for i, n in enumerate(["Anna Berglund", "anna berglund", "Anna Berglundh", "Bo Ek"])], "id string, type string, surface string")
    with Workspace(spark, "t") as ws:
        df_held, joined = (text.entities(df, text.resolve_mentions(df, ws, **k)) for k in ({}, {"held": 0}))
        assert "cosine" not in df_held._jdf.queryExecution().analyzed().toString() and sorted(df_held.collect()) == sorted(joined.collect()) and df_held.count() == 2
