"""Few edges and few pairs take few shuffles; where there are more, tables are contracted, with the same result."""

import numpy as np
import pytest

from ledgerloom.llm import components, jaccard


def counted(monkeypatch):
    plain, names = components.written, []
    monkeypatch.setattr(components, "written", lambda df, name: names.append(name) or plain(df, name))
    return names


def graph(spark):
    rng = np.random.default_rng(3)
    chain = [(i, i + 1) for i in range(0, 60)] + [(i + 1, i) for i in range(0, 60, 7)] + [(9, 9)]
    edges = chain + [(-5, 1000), (1000, 999), (2**62, -(2**62))] + [(2000 + int(x), 2000 + int(y)) for x, y in rng.integers(0, 90, (70, 2))]
    return spark.createDataFrame(edges, "a long, b long"), edges


def plain(edges):
    label = {n: n for e in edges for n in e if e[0] != e[1]}
    while True:
        before = dict(label)
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


def test_few_edges_make_one_table(spark, monkeypatch):
    names = counted(monkeypatch)
    df, edges = graph(spark)
    assert {r.node: r.label for r in components.components(df).collect()} == plain(edges)
    assert names == ["step"]


@pytest.mark.parametrize("few", [-1, 0, 40, 100])
def test_tables_are_contracted_first(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    df, edges = graph(spark)
    out = components.components(df)
    assert sorted(tuple(r) for r in out.collect()) == sorted(plain(edges).items())
    assert components.components(df.limit(0)).count() == 0


def test_few_pairs_are_not_dealt_by_set(spark, monkeypatch):
    sets = spark.createDataFrame([(c, [c % 3, 1 << 33, 5]) for c in range(50)], "class long, codes array<long>")
    pairs = spark.createDataFrame([(1, 4, 3, 3), (1, 2, 3, 3), (7, 10, 3, 3)], "a long, b long, na int, nb int")
    plans = []
    for few in (500_000, 0):
        monkeypatch.setattr(jaccard, "FEW", few)
        out = jaccard._overlaps(pairs, sets)
        assert sorted(tuple(r) for r in out.collect()) == [(1, 4, 3), (7, 10, 3)]
        plans.append(out._jdf.queryExecution().optimizedPlan().toString())
    assert "strategy=broadcast" in plans[0].split("LeftSemi")[0]
    assert "strategy=broadcast" not in plans[1]
