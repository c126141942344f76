"""Edits alter neighbouring pieces only; what a chunk was forced to is what its cuts went through."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from chronoweave.llm import splitting


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) + rng.choice(["", "", "", "", "", "", ".", ".\n"]) for _ in range(n))


def parts(text):
    ends = [e for e, _ in splitting.cuts(text)]
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def test_edits_alter_neighbouring_pieces_only():
    text = prose(1, 6000)
    old = set(parts(text))
    rng = random.Random(2)
    changed = []
    for _ in range(60):
        at = rng.randrange(len(text))
        edited = text[:at] + rng.choice(["inserted ", "x", "A new sentence. "]) + text[at + rng.choice([0, 0, 7]) :]
        changed.append(len([p for p in parts(edited) if p not in old]))
    assert sum(changed) / len(changed) <= 2.5 and sorted(changed)[54] <= 4 and len(old) > 30


def test_cuts_stand_at_the_nearest_natural_boundary():
    text, sizes = prose(3, 3000), splitting.Sizes()
    hashes, begin = splitting.rolling_hashes(text, sizes), 0
    natural = [m.end() for m in re.finditer(r"\n\s*|[.!?…]\s+", text)]
    for k, (end, kind) in enumerate(splitting.cuts(text)[:-1]):
        lo, hi = begin + sizes.least, begin + sizes.most - (sizes.overlap if k else 0)
        goal = lo + int(hashes[lo : hi + 1].argmin())
        near = [p for p in natural if lo <= p <= hi and abs(p - goal) <= sizes.reach]
        assert (abs(end - goal) == min(abs(p - goal) for p in near)) if near else kind == "space"
        begin = end


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["word ", "x" * 90, "y" * 700, ". ", ". ", "\n", "\t", "ǘ"]), min_size=12, max_size=60))
def test_forced_is_what_the_cuts_went_through(pieces):
    text = "".join(pieces)
    want = max((len(r) for r in re.split(r"[ \t\n]", text)), default=0) > 1200
    assert any(splitting.cut_through(text, at) > 1200 for at, _ in splitting.cuts(text)) == want
