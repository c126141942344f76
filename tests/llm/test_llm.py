"""The text operators against brute force, exact round trips and odd inputs."""

import datetime as dt
import json
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__
from chronoweave.llm import catalog, entity_match, leakage, packing, quality, splitting
from chronoweave.runtime import Workspace

SF = "/root/testdata/sf0.001"
NODE = "id string, type string, created_at string, props string, aliases array<string>, rev int, deleted_at timestamp_ntz, ingested_at timestamp_ntz, key string, rule string"
ALIAS = "entity_id string, canonical string, aliases array<string>"
RECON = "id string, type string, created_at string, props string, aliases array<string>, bare string"


# --- matching ------------------------------------------------------------------------------------------------


def match(spark, nodes, recon, aliases=()):
    n = spark.createDataFrame([(i, t, "", None if p is None else json.dumps(p), a, r, None, dt.datetime(2027, 1, 1), "x", "y") for i, t, p, a, r in nodes], NODE)
    q = spark.createDataFrame([(i, t, "", p if isinstance(p, str) or p is None else json.dumps(p), a, "z") for i, t, p, a in recon], RECON)
    with Workspace(spark, "t") as ws:
        return {r.recon_id: (r.node_id, r.rule, r.confidence) for r in entity_match.match(n, spark.createDataFrame(list(aliases), ALIAS), q, ws).collect()}


def person(name, handle="h1", desk="111-2222", hired="2020-01-02", **more):
    return {"name": name, "handle": handle, "desk": desk, "hired_on": hired, "department": "Drug Safety", "site": "Breve"} | more


def test_cascade_rules_and_strangers(spark):
    nodes = [
        ("person:a", "Person", person("Ann Berg"), ["A. Berg"], 1), ("person:a", "Person", person("Ann Berg", site="Ost"), [], 2), ("person:b", "Person", person("Bo Carl", "h2", "333-4444", "2021-05-06"), None, 1),
        ("person:c", "Person", person("Ann Berg", "h3", "555-6666", "2019-03-04"), [], 1), ("project:p", "Project", {"name": "Zulu Imaging Pilot", "code": "ST-123456", "started_on": "2025-01-01"}, [], 1),
        ("person:null", "Person", None, None, 1), (None, "Person", person("X Y"), [], 1), ("artifact:x", "Artifact", {"name": "Ann Berg"}, [], 1),
    ]
    recon = [
        ("r:mail", "Person", {"label": "Other Name", "contact": {"mail": "H1@x.example"}}, []), ("r:desk", None, {"label": "Berg, Ann", "contact": {"desk": "+00 555-6666"}}, []),
        ("r:date", "Staff", {"label": "Dr BO CARL", "since": "06.05.2021"}, []), ("r:typo", "Person", {"label": "Bo Cral", "since": "May 6, 2021"}, []), ("r:initial", "Person", {"label": "B. Carl", "contact": {"desk": "x333.4444"}}, None),
        ("r:stranger", "Person", {"label": "Ann Berg", "since": "2020-01-02", "contact": {"mail": "nobody@x.example"}}, []), ("r:samename", "Person", {"label": "Ann Berg", "since": "2001-01-01"}, []),
        ("r:samedesk", "Person", {"label": "Eva Lund", "contact": {"desk": "111-2222"}}, []), ("r:code", "Programme", {"label": "ZIP", "code": "st 123456"}, []), ("r:form", "Project", {"label": "Pilot: Zulu Imaging", "since": "2025/01/01"}, []),
        ("r:othercode", "Project", {"label": "Zulu Imaging Pilot", "code": "#999999", "since": "2025-01-01"}, []), ("r:broken", "Person", "{broken", []), ("r:none", "Person", None, None), ("r:blank", "Person", {"label": " "}, [" "]),
        ("r:mail", "Person", {"label": "Other Name", "contact": {"mail": "H1@x.example"}}, []), (None, "Person", {"label": "Ann Berg"}, []),
    ]
    got = match(spark, nodes, recon)
    assert {k: v[0] for k, v in got.items()} == {
        "r:mail": "person:a", "r:desk": "person:c", "r:date": "person:b", "r:typo": "person:b", "r:initial": "person:b", "r:code": "project:p", "r:form": "project:p",
    }
    assert got["r:mail"][1] == "identifier" and got["r:date"][1] == "date+name" and all(0 < v[2] < 1 for v in got.values())


def test_a_name_that_two_share_resolves_nothing_and_empty_tables(spark):
    nodes = [(f"person:{i}", "Person", person("Ann Berg", f"h{i}", f"1{i}", None), [], 1) for i in range(2)]
    assert match(spark, nodes, [("r", "Person", {"label": "Ann Berg"}, [])]) == {}
    assert match(spark, nodes[:1], [("r", "Person", {"label": "Ann Berg"}, [])])["r"][:2] == ("person:0", "name")
    assert match(spark, nodes, []) == {} and match(spark, [], [("r", "Person", {"label": "Ann Berg"}, [])]) == {}


# --- splitting -----------------------------------------------------------------------------------------------


def check_pieces(text, sizes=splitting.Sizes()):
    ends = splitting.cuts(text, sizes)
    begin, whole = 0, ""
    for k, (end, kind) in enumerate(ends):
        assert min(1, len(text)) <= end - begin <= sizes.most and (k == 0 or end > begin + sizes.overlap)
        whole += text[begin + (sizes.overlap if k else 0) : end]
        if kind == "forced":
            assert not re.search(r"[ \t\n]", text[begin + sizes.overlap + 1 : end - 1])
        begin = end - sizes.overlap
    assert whole == text
    return ends


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word ", "A sentence. ", "\n", "\n\n", "x" * 90, "ǘ", "🧪 ", "\t"]), max_size=400))
def test_pieces_are_a_round_trip(parts):
    check_pieces("".join(parts))


def test_forced_cuts_and_edit_locality():
    assert {k for _, k in check_pieces("y" * 10_000)} == {"forced", "end"}
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) + ("." if rng.random() < 0.1 else "") for _ in range(6000))
    old = {text[a:b] for a, b in zip([0, *[e for e, _ in check_pieces(text)]], [e for e, _ in check_pieces(text)], strict=False)}
    at = len(text) // 2
    edited = text[:at] + "inserted " + text[at:]
    ends = [e for e, _ in check_pieces(edited)]
    new = {edited[a:b] for a, b in zip([0, *ends], ends, strict=False)}
    assert len(new - old) <= 8 < len(new)


def test_split_operator_on_odd_rows(spark):
    long = "Prose here. " * 200
    rows = [("a", long, "p", 7, 3, "S", "clash"), ("a", long, "p", 7, 3, "S", "clash"), ("b", "short", "p", 0, 5, None, ""), ("c", None, "p", 0, 5, None, ""), ("d", "z" * 1201, None, -1, None, None, ""), ("e", "z" * 1200, "p", 0, 1, "", ""), (None, long, "p", 0, 1, "", "")]
    df = spark.createDataFrame(rows, "id string, text string, source_path string, offset int, length int, section string, cut string")
    got = splitting.pieces(df).collect()
    assert {r.chunk_id for r in got} == {"a", "d"} and {r.forced for r in got if r.chunk_id == "d"} == {1} and {r.source_offset for r in got if r.chunk_id == "d"} == {-1}
    a = sorted((r for r in got if r.chunk_id == "a"), key=lambda r: r.piece_no)
    assert all(r.source_offset == r.begin + 7 and r.section == "S" and r.text == long[r.begin : r.end] for r in a)
    assert all(x.end - y.begin == 100 for x, y in zip(a, a[1:], strict=False)) and splitting.pieces(df.limit(0)).count() == 0


# --- containers ----------------------------------------------------------------------------------------------


def unpack(counts, capacity):
    bins: dict[int, list[int]] = {}
    placed: dict[int, set] = {}
    for size, first, items, container, each in packing.plan(counts, capacity):
        for r in range(items):
            bins.setdefault(container + r // each, []).append(size)
            assert first + r not in placed.setdefault(size, set())
            placed[size].add(first + r)
    assert {s: len(r) for s, r in placed.items()} == {s: n for s, n in counts.items() if n}
    assert all(placed[s] == set(range(len(placed[s]))) for s in placed)
    assert sorted(bins) == list(range(len(bins))) and all(sum(b) <= capacity for b in bins.values())
    assert all(sum(3 * s > capacity for s in b) <= 2 for b in bins.values())
    return bins


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(0, 30), max_size=30))
def test_plan_is_valid_and_near_the_bound(counts):
    bins = unpack(counts, 60)
    total, large = sum(s * n for s, n in counts.items()), sum(n for s, n in counts.items() if 2 * s > 60)
    assert len(bins) <= 1.5 * max(total / 60, large) + 2


def test_fill_on_texts(spark):
    texts = ["one two three", "", None, "word " * 700, "alpha beta " * 40, "one two three", "x"]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, size string, pid int")
    with Workspace(spark, "t") as ws:
        got = packing.fill(df, ws, catalog.VOCABULARY, 128).collect()
        assert packing.fill(df.limit(0), ws, catalog.VOCABULARY, 128).count() == 0
    by_doc = {i: sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece) for i in range(7)}
    assert by_doc[1][0].container is None and by_doc[2][0].container is None
    assert [r.size for r in by_doc[3]] == [128] * (len(by_doc[3]) - 1) + [by_doc[3][-1].size] and len(by_doc[3]) > 1
    assert all(x.token_end == y.token_begin for x, y in zip(by_doc[3], by_doc[3][1:], strict=False)) and all(len(by_doc[i]) == 1 for i in (0, 4, 5, 6))
    load: dict[int, int] = {}
    for r in got:
        if r.container is not None:
            load[r.container] = load.get(r.container, 0) + r.size
    assert max(load.values()) <= 128 and len(load) == -(-sum(load.values()) // 128)


# --- leaks ---------------------------------------------------------------------------------------------------


def passage(rng, n):
    return [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.randrange(400)}q" for _ in range(n)]


def test_leaks_in_any_dress_and_near_misses(spark):
    rng = random.Random(2)
    item = passage(rng, 40)
    filler = lambda: " ".join(passage(rng, 60))
    run = item[5:20]
    dressed = {
        1: " ".join(run), 2: " ".join(run).upper(), 3: "\n> ".join(run), 4: " ".join(f"<b>{w}</b>" for w in run), 5: ", ".join(f"**{w}**" for w in run), 6: " ".join(w[:2] + "­" + w[2:] for w in run),
        7: "​ ".join(run), 8: "\t".join(run), 9: " ".join(run[:7]) + " " + run[7][:2] + "-\n" + run[7][2:] + " " + " ".join(run[8:]), 10: "&nbsp;".join(run), 11: " ".join(chr(0xFEE0 + ord(w[0])) + w[1:] for w in run),
    }
    misses = {20: " ".join(run[:14]), 21: " ".join(run[:7] + ["also"] + run[7:]), 22: " ".join(reversed(run)), 23: " ".join(run[:7] + run[8:])}
    rows = [(i, f"{filler()} {t} {filler()}", "x") for i, t in (dressed | misses).items()] + [(30, None, ""), (31, "", ""), (32, filler() * 200, ""), (33, " ".join(run), ""), (33, " ".join(run), "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(7, " ".join(item)), (7, " ".join(item)), (8, None), (9, "too short"), (10, "")], "item_id bigint, passage string")
    got = leakage.leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.whole} == {(i, 7) for i in [*dressed, 33]}
    assert {21, 23} <= {r.doc_id for r in got} and all(r.edits > 0 for r in got if r.doc_id in (21, 23))
    assert leakage.leaks(docs.limit(0), items).count() == 0 and leakage.leaks(docs, items.limit(0)).count() == 0


def brute_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_edit_distances_against_brute_force():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 4, (300, 8))
    b = np.where(rng.random((300, 10)) < 0.8, np.pad(a, ((0, 0), (0, 2))), rng.integers(0, 4, (300, 10)))
    want = [min(brute_edits(list(x), list(y)), 3) for x, y in zip(a, b, strict=True)]
    assert leakage.edit_distances(a, b, 2).tolist() == want


@pytest.mark.parametrize("edits", [1, 2])
def test_recall_at_the_allowed_edits(edits):
    """Windows with that many random word edits are found at the plan's recall, measured over many."""
    rng = random.Random(edits)
    items = [(i, " ".join(passage(rng, 15))) for i in range(300)]
    index = leakage.Index(items, leakage.Plan())
    texts = []
    for _, p in items:
        w = p.split()
        for _ in range(edits):
            at = rng.randrange(1, len(w))
            kind = rng.randrange(3)
            w[at : at + (kind != 1)] = [] if kind == 2 else ["foreign"]
        texts.append("before " + " ".join(w + ["behind"] * 3))
    got = leakage._match(index, list(range(300)), texts)
    assert sum((i, i) in got for i in range(300)) >= leakage.Plan().recall * 300


# --- quality -------------------------------------------------------------------------------------------------

PROSE = "The board has finished the draft of the plan because the deadline has moved. Nobody on the call could confirm the numbers, although two of us had doubts.\n"


def share(text):
    return quality.measure(text, "en")[-1]


def test_prose_and_no_prose():
    assert share(PROSE * 2) > 0.9 and share(PROSE.lower().replace(".", "").replace(",", "")) > 0.9 and share("We will look at the list again on Monday.") > 0.9
    assert share("\n".join(re.findall(r".{1,40}(?:\s|$)", PROSE * 2))) > 0.9
    for junk in ("- the plan\n- the list of deviations\n* the budget\n" * 5, "a|b|c\n1|2|3\n" * 9, "the plan of the board " * 30, "x = 1\ny: 2\n" * 9, "lorem ipsum dolor amet " * 3 + "stone river cloud lamp " * 9, "!@# $%^ &*( \n" * 20, "1.1 The plan ........ 3\n1.2 The list ........ 9\n" * 6):
        assert share(junk) < 0.3, junk
    assert 0.3 < share(PROSE + "1;2;3;4;5;6;7;8;9\n" * 9) < 0.7


def test_measures_and_languages():
    m = dict(zip(["lang", *quality.STATS], quality.measure("Wir haben 12 Fragen, die wir noch klären.\n\n", "en"), strict=True))
    assert m["lang"] == "de" and m["n_words"] == 8 and round(m["mean_word_length"], 3) == 4.25 and m["end_punctuation_share"] == 1.0
    assert quality.measure("???", None)[1:4] == (1.0, 3.0, 1.0)


def test_tails_are_exact_ranks(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["en", "de"]), *[float(rng.choice([0, 0, 0, rng.randrange(30)])) for _ in quality.STATS]) for i in range(400)]
    df = spark.createDataFrame(rows, quality.MEASURED)
    with Workspace(spark, "t") as ws:
        got = quality.tails(df, ws).collect()
    for r in got:
        mine = [x[2 + quality.STATS.index(r.stat)] for x in rows if x[1] == r.lang_used]
        assert r.low_tail == pytest.approx(sum(v <= r.value for v in mine) / len(mine)) and r.high_tail == pytest.approx(sum(v >= r.value for v in mine) / len(mine))
    assert sum(r.n_rows for r in got) == 400 * len(quality.STATS)


def test_no_prose_on_odd_rows(spark):
    texts = [PROSE * 2] * 30 + ["a;b;c\n1;2;3\n" * 20] * 4 + [None, "", " \n\t", PROSE * 3000, "y" * 100_000]
    df = spark.createDataFrame([(i, t, None if i % 2 else "EN-x", 5.0) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, score double")
    with Workspace(spark, "t") as ws:
        # the line repeated thousands of times is a repetition, not prose
        assert sorted(r.doc_id for r in quality.no_prose(df, ws).collect()) == [30, 31, 32, 33, 37, 38]
        assert quality.no_prose(df.limit(0), ws).count() == 0
        assert quality.statistics(df).count() == 36


def test_every_text_query_is_registered():
    assert {"p3_found", "p5_found", "p7_fill", "p8_found", "p9_found"} <= set(__spark_entry__.queries())
