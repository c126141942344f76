"""Junk is found however common it is, and copies of a text count once in the ranks."""

from chronoweave.llm import quality
from chronoweave.runtime import Workspace

PROSE = "The team met on Monday and agreed that the plan for the next visit is sound. We will send it to all sites before the end of the week. "
JUNK = "a;b;c\n1;2;3\n" * 20


def test_common_junk_and_copies(spark):
    texts = [JUNK] * 84 + [f"{PROSE * 2}Visit {i} was on time and all of us were there." for i in range(16)]
    df = spark.createDataFrame([(i, t, "fr" if t == JUNK else "en") for i, t in enumerate([*texts, JUNK + "9;9;9"])], "doc_id bigint, text string, lang string")
    with Workspace(spark, "t") as ws:
        assert sorted(r.doc_id for r in quality.no_prose(df, ws).collect()) == [*range(84), 100]
        assert sorted(r.doc_id for r in quality.no_prose(df.where("doc_id = 0"), ws).collect()) == [0]
        once = {r.doc_id: r.score for r in quality.outlier_scores(quality.keyed_statistics(df.where("doc_id = 0 or doc_id > 83")), ws).collect()}
        many = {r.doc_id: r.score for r in quality.outlier_scores(quality.keyed_statistics(df), ws).collect()}
    assert len(many) == 101 and all(abs(many[k] - v) < 1e-9 for k, v in once.items()) and {round(many[i], 9) for i in range(84)} == {round(once[0], 9)}
