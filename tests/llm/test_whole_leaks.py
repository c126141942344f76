"""Short items, blocks of items, and recall where edited passages lie within longer texts."""

import random

from chronoweave.llm import leakage

WORDS = "the site board agreed that new visit plan was late because of two open queries about dosing and nobody could confirm numbers before call with sponsor while draft report stayed under review".split()


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_items_shorter_than_a_window_are_matched_whole(spark):
    items = spark.createDataFrame([(1, "Zulu kilo, seven papa"), (2, "zulu kilo seven papa"), (3, "solitary"), (4, "..."), (5, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen")], "item_id bigint, passage string")
    rows = [(1, "so ZULU kilo\nseven <b>papa</b> said"), (2, "zulu kilo papa"), (3, "a solitary word"), (4, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"), (5, ""), (6, None)]
    got = leakage.leaks(docs(spark, rows), items).collect()
    assert {(r.doc_id, r.item_id, r.n_words) for r in got} == {(1, 1, 4), (1, 2, 4), (3, 3, 1), (4, 5, 14)} and all(r.whole and r.edits == 0 for r in got)


def test_blocks_of_items_give_what_one_block_gives(spark, monkeypatch):
    rng = random.Random(3)
    passages = [" ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(rng.choice((6, 20, 45)))) for _ in range(40)]
    items = spark.createDataFrame(list(enumerate(passages)), "item_id bigint, passage string")
    texts = docs(spark, [(i, f"{' '.join(rng.choices(WORDS, k=30))} {p} {' '.join(rng.choices(WORDS, k=9))}") for i, p in enumerate(passages)] * 2)
    key = lambda r: (r.doc_id, r.item_id, r.n_words, r.edits, r.whole)
    whole = sorted(map(key, leakage.leaks(texts, items).collect()))
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 900)
    assert len(list(leakage._blocks(items))) > 3
    assert sorted(map(key, leakage.leaks(texts, items).collect())) == whole and {(i, i) for i in range(40)} <= {k[:2] for k in whole}


def test_recall_of_edited_passages_in_running_text():
    """Items of natural length, in each of which one window was copied into a text with one or two edits."""
    for edits in (1, 2):
        rng = random.Random(10 + edits)
        items = [(i, " ".join(rng.choice(WORDS) + rng.choice(("", "", str(rng.randrange(9)))) for _ in range(rng.randrange(40, 110)))) for i in range(400)]
        index = leakage.Index(items, leakage.Plan())
        texts = []
        for _, p in items:
            w = p.split()
            at = rng.randrange(len(w) - 15)
            run = w[at : at + 15]
            for _ in range(edits):
                k, kind = rng.randrange(1, len(run) - 1), rng.randrange(3)
                run[k : k + (kind != 1)] = [] if kind == 2 else [rng.choice(WORDS)]
            texts.append(" ".join([*rng.choices(WORDS, k=40), *run, *rng.choices(WORDS, k=40)]))
        got = leakage._match(index, list(range(400)), texts)
        assert sum((i, i) in got for i in range(400)) >= leakage.Plan().recall * 400
