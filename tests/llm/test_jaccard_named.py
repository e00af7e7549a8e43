"""Only the sets that pairs name are moved; where they name too many, all are, with the same result."""

import pytest

from ledgerloom.llm import jaccard

WORDS = [f"w{i}" for i in range(60)]


def docs(spark):
    near = [(i, " ".join(WORDS[:k] + [f"x{i}"] + WORDS[k + 1 :])) for i, k in enumerate(range(0, 60, 3))]
    return spark.createDataFrame(near + [(100, " ".join(WORDS)), (101, "a b c d e"), (102, "a b c d e"), (103, None)], "doc_id long, text string")


def test_overlaps_leave_out_unnamed_sets(spark):
    sets = spark.createDataFrame([(c, [c % 3, 1 << 33, 5]) for c in range(50)], "class long, codes array<long>")
    pairs = spark.createDataFrame([(1, 4, 3, 3), (1, 2, 3, 3)], "a long, b long, na int, nb int")
    out = jaccard._overlaps(pairs, sets)
    assert [tuple(r) for r in out.collect()] == [(1, 4, 3)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 2  # either side of a pair


@pytest.mark.parametrize("few, short", [(0, 16), (0, 1), (500_000, 1)])
def test_same_result_by_any_way(spark, monkeypatch, few, short):
    want = sorted(tuple(r) for r in jaccard.near_duplicates(docs(spark)).drop("class").collect())
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "SHORT", short)
    assert sorted(tuple(r) for r in jaccard.near_duplicates(docs(spark)).drop("class").collect()) == want
