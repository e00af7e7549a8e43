import re

import numpy as np
import pytest

from ledgerloom.llm import jaccard
from ledgerloom.llm.components import components
from tests.llm.common import awkward

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CASE = {c: c + 32 for c in range(65, 91)}


def grams(text):
    w = WORD.findall((text or "").translate(CASE))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [grams(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted((str(d), len(sets[i]), str(least.get(root(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def result(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def cases():
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(r[0], r[1]) for r in awkward()]
    n = 100
    for size in (12, 40, 90, 200):
        base = rng.choice(vocabulary, size)
        for _ in range(25):  # variants of a base that may not be there itself, chains included
            w = base.copy()
            w[rng.integers(0, size, rng.integers(1, max(2, size // 12)))] = rng.choice(vocabulary)
            rows.append((n, " ".join(w)))
            n += 1
        walk = base.copy()
        for _ in range(15):
            walk = walk.copy()
            walk[rng.integers(0, size, max(1, size // 60))] = rng.choice(vocabulary)
            rows.append((n, " ".join(walk).upper()))
            n += 1
    passage = " ".join(rng.choice(vocabulary, 30))
    rows += [(n + i, " ".join(rng.choice(vocabulary, 25)) + " " + passage) for i in range(40)]
    rows += [(n + 50 + i, passage + " " + " ".join(rng.choice(vocabulary, i % 4))) for i in range(12)]
    rows += [(n + 80 + i, " ".join(f"t{j}" for j in range(4 - i % 4))) for i in range(8)]
    return rows


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_cases(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    rows = cases()
    got = result(jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute(rows)


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert result(jaccard.near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (300, 299), (300, 299)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {299: 299, 300: 299}


def test_stage_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(5, text), (3, text), (9, text + " x"), (7, "own words here"), (8, None), (None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = jaccard.one_of_each(spark, docs, "")
    assert out.schema == docs.schema
    assert sorted(str(r.doc_id) for r in out.collect()) == ["3", "7", "8", "None"]
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def variants(n, edits, seed=5):
    """Near copies of a text that isn't there: each has other words at a few random places."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"v{i}" for i in range(5000)]
    base, rows = rng.choice(vocabulary, 60), []
    for i in range(n):
        w = base.copy()
        w[rng.choice(60, edits, replace=False)] = rng.choice(vocabulary, edits)
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("edits", [1, 2])
def test_pairs_grow_in_proportion(spark, monkeypatch, edits):
    plain, pairs = jaccard._overlaps, []

    def counted(p, sets):
        pairs[-1] += p.count()
        return plain(p, sets)

    monkeypatch.setattr(jaccard, "_overlaps", counted)
    for n in (300, 600):
        rows = variants(n, edits)
        pairs.append(0)
        assert result(jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
        assert pairs[-1] <= n


@pytest.mark.parametrize("short", [0, 1, 3])
def test_lists_indexed_by_difference(spark, monkeypatch, short):
    """However early lists count as long, no link is lost."""
    monkeypatch.setattr(jaccard, "SHORT", short)
    rows = cases() + [(1000 + i, t) for i, t in variants(60, 2, 8)]
    assert result(jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_stage_keeps_one_row_of_each(spark):
    """Repeated and null ids don't count as other documents, and columns may be named like the stage's own."""
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(5, text, 1, 2), (5, text, 1, 2), (3, text, 3, 4), (3, text, 3, 4), (None, text, 5, 6), (7, "own words", 7, 8), (7, None, 7, 8), (None, "lone text", 9, 9), (None, "lone text", 9, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __gone int, row int")
    out = jaccard.one_of_each(spark, docs, "")
    assert out.schema == docs.schema
    assert sorted(map(str, out.collect())) == sorted(map(str, spark.createDataFrame([rows[2], rows[5], rows[6], rows[7]], docs.schema).collect()))
