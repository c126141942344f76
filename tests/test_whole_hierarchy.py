"""Trees below circles have their paths, pairs and counts too, against brute force."""

import random

import pytest

from chronoweave.plans import problems

JOURNAL = "id string, parent_event string"


def climbed(links):
    """(ancestor, descendant, distance) by climbing from every id off a circle as far as the top or the first circle member."""
    on = set()
    for i in links:
        cur, steps = links.get(i), 0
        while cur in links and cur != i and steps < len(links):
            cur, steps = links[cur], steps + 1
        if cur == i:
            on.add(i)
    pairs = set()
    for i in links.keys() - on:
        cur, k = links[i], 1
        while cur in links:
            pairs.add((cur, i, k))
            if cur in on:
                break
            cur, k = links[cur], k + 1
    return pairs, on


@pytest.mark.parametrize("seed", [1, 2])
def test_everything_below_circles(spark, tmp_path, seed):
    rng = random.Random(seed)
    links = {f"r{i}": f"r{(i + 1) % 4}" for i in range(4)} | {"self": "self", "t1": "r2", "t2": "t1", "t3": "t2", "t4": "t1", "s1": "self", "root": None, "a": "root", "b": "a"}
    links |= {f"x{i:02d}": f"x{rng.randrange(30):02d}" for i in range(30)}
    spark.createDataFrame(list(links.items()), JOURNAL).write.parquet(str(tmp_path / "run_clinical_study.parquet"))
    want, on = climbed(links)
    assert ("r2", "t3", 3) in want and {"self", "r0"} <= on
    got = [tuple(r) for r in problems.p4_descendants(spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want)
    rows = {r.event_id: r for r in problems.p4_hierarchy(spark, str(tmp_path)).collect()}
    assert {k: r.n_descendants for k, r in rows.items()} == {i: sum(a == i for a, _, _ in want) for i in links}
    assert (rows["t3"].path, rows["t3"].depth, rows["t3"].root_id) == ("r2>t1>t2>t3", -1, "r0") and rows["b"].path == "root>a>b"
    assert all(rows[i].path is None for i in on)
