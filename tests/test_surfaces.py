"""Texts are held against surfaces where they are read."""

import random

from chronoweave.operators import kgbuild, surfaces, text
from tests.test_closure import optimized

WORDS = ["Ann", "Lee", "Ann Lee", "Bo-Ek", "Ek", "Trial 4", "Trial", "4", "Zoë", "Lee's", "r+d"]


def test_held_roster_tags_as_joins_do_without_a_shuffle(spark):
    """Before, each text was shuffled with its words and candidates."""
    rng = random.Random(8)
    docs = spark.createDataFrame([*((i, rng.choice([" ", ", "]).join(rng.choice([*WORDS, "and", "O'Ann", "Trialist"]) for _ in range(15))) for i in range(60)), (98, ""), (99, None)], "doc_id bigint, text string")
    known = spark.createDataFrame([(w, f"e{i}") for i, w in enumerate(WORDS)], "surface string, entity_id string")
    got = text.tag_mentions(docs, known)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = sorted(tuple(r) for r in text.tag_mentions(docs, known, 0).collect())
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 300


def test_held_aliases_are_claimed_as_joins_claim_them(spark):
    """Before, each text was joined with every surface that begins with one of its words, and of 'bo bo' in 'ann bo bo bo' only the first place was tried."""
    rng = random.Random(9)
    forms = ["ann", "ann bo", "bo bo", "bo ek", "ek", "trial 4", "(old) trial", "(old)", "r+d", "+", "²", "zoé", "zo", "x‍", "ß-1", "ek."]
    index = spark.createDataFrame([*((f, f"e{i}") for i, f in enumerate(forms)), ("Ann", "twin"), ("ANN BO", "e1"), (" ", "blank"), ("and", None)], "surface string, entity_id string")
    parts = [*forms, "and", "bo", "x", "zoé", "zó", "4²", "trialist", "ek..", "ann_bo"]
    texts = [*((i, "".join(rng.choice(parts) + rng.choice([" ", " ", ", ", ""]) for _ in range(14))) for i in range(150)), (900, "Ann bo bo bo"), (901, "(old)"), (98, ""), (99, None)]
    questions = spark.createDataFrame(texts, "id int, text string")
    got = kgbuild.resolve_aliases(questions, index)
    assert "split(" not in (plan := optimized(got).toString()) and "Join" not in plan and "Aggregate" not in plan
    rows = sorted(tuple(r) for r in got.collect())
    assert {(900, "e1"), (900, "e2"), (901, "e7")} <= set(rows) and len(rows) == len(set(rows)) > 500
    assert rows == sorted(tuple(r) for r in kgbuild.resolve_aliases(questions, index, 0).collect())


def test_words_are_the_jvms(spark):
    """Every character that its version of Unicode knows."""
    odd = {*"".join(surfaces.odd())}
    points = spark.range(0x110000).where("id not between 55296 and 57343").selectExpr("id", "decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') c")
    rows = points.where(r"c not rlike '\\p{Cn}'").selectExpr("id", r"c rlike '(?U)\\w' w").collect()
    assert len(rows) > 250_000 and not [hex(r.id) for r in rows if r.w != ((chr(r.id).isalnum() or r.id == 95) != (chr(r.id) in odd))]
