import hashlib
import re

import numpy as np
import pytest

from ledgerloom.llm import decontaminate
from tests.llm.common import awkward, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CASE = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(CASE))


def brute(rows, items):
    out = []
    for doc_id, text in rows:
        own, hit, found = words(text), set(), set()
        for name, item in items:
            w = words(item)
            if not w:
                continue
            size = min(13, len(w))
            for i in range(len(w) - size + 1):
                for j in range(len(own) - size + 1):
                    if own[j : j + size] == w[i : i + size]:
                        hit |= set(range(j, j + size))
                        found.add("" if name is None else str(name))
        n = len(hit)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((str(doc_id), len(own), n, len(found), digest, n > 0 and 20 * n >= len(own)))
    return sorted(out)


def result(df):
    return sorted((str(r.doc_id), *r[1:6]) for r in df.collect())


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


ITEMS = [(1, " ".join(f"Word{i}" for i in range(5, 30))), (2, "one"), (3, None), (4, ""), (10, "zwei drei zwei"), (1, "straße"), (None, "null id text"), (7, "very " * 14)]


@pytest.mark.parametrize("size", [8 << 20, 60])
def test_awkward_rows_and_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
    rows = [(r[0], r[1]) for r in awkward() if r[0] != 11]
    got = decontaminate.decontaminate(documents(spark, [r for r in awkward() if r[0] != 11]), bench(spark, ITEMS))
    assert result(got) == brute(rows, ITEMS)


def test_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = decontaminate.decontaminate(docs, items)
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert result(got) == want and any(r[2] for r in want)


def test_longest_match(spark):
    rows = [(1, "x " + ITEMS[0][1] + " y", "en", "s", 1), (2, " ".join(ITEMS[0][1].split()[3:17]), "en", "s", 1)]
    got = {r.doc_id: r.longest_match for r in decontaminate.decontaminate(documents(spark, rows), bench(spark, ITEMS)).collect()}
    assert got == {1: 25, 2: 14}


def test_empty_tables_and_stage(spark, tmp_path):
    assert decontaminate.decontaminate(documents(spark, []), bench(spark, ITEMS)).count() == 0
    assert not any(r.contaminated for r in decontaminate.decontaminate(documents(spark), bench(spark, [])).collect())
    bench(spark, ITEMS).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = documents(spark).withColumnRenamed("lang", "contaminated")
    out = decontaminate.keep_clean(spark, docs, str(tmp_path))
    assert out.schema == docs.schema
    kept = {r.doc_id for r in out.collect()}
    assert 0 not in kept and 6 not in kept and 8 in kept and 4 in kept


@pytest.mark.parametrize("size", [8 << 20, 60])
def test_spans_and_items(spark, monkeypatch, size):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
    long = ITEMS[0][1].split()
    rows = [(1, " ".join(["x", *long, "y", "one"]), "en", "s", 1), (2, " ".join(["p", "q", *long[3:17]]), "en", "s", 1), (3, "clean", "en", "s", 1), (4, None, "en", "s", 1)]
    got = {r.doc_id: (r.spans, r.items) for r in decontaminate.decontaminate(documents(spark, rows), bench(spark, ITEMS)).collect()}
    assert got == {1: ([1, 26, 27, 28], ["1", "2"]), 2: ([2, 16], ["1"]), 3: ([], []), 4: ([], [])}


def longest(text, items):
    """Words of the longest common run, and its first place in the document."""
    own, best = words(text), (0, None)
    for _, item in items:
        w, row = words(item), {}
        for i in range(len(w)):
            row = {j: row.get(j - 1, 0) + 1 for j in range(len(own)) if own[j] == w[i]}
            for j, n in row.items():
                if n > best[0] or n == best[0] and j - n + 1 < best[1]:
                    best = (n, j - n + 1)
    return best


@pytest.mark.parametrize("size,shard", [(8 << 20, 2 << 20), (300, 200)])
def test_random_texts(spark, monkeypatch, size, shard):
    """Few words, so that runs of every length, short items inside long ones and repeated items occur."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
    rng = np.random.default_rng(4)
    draw = lambda n: " ".join(rng.choice(["a", "b", "c", "unknown" if n > 30 else "a"], n, p=[0.5, 0.3, 0.15, 0.05]))
    items = [(i, draw(n)) for i, n in enumerate([1, 2, 3, 5, 12, 13, 14, 20, 25, 30])]
    items += [(20, " ".join(items[9][1].split()[-5:])), (21, items[9][1]), (22, "zz " + items[8][1]), (9, "other words")]
    rows = [(i, draw(int(rng.integers(0, 80)))) for i in range(40)] + [(50, "q q " + items[9][1] + " q"), (51, items[8][1] + " " + items[8][1])]
    got = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bench(spark, items)).collect()
    assert sorted((str(r.doc_id), *r[1:6]) for r in got) == brute(rows, items)
    texts = dict(rows)
    named = {}
    for i, t in items:
        named.setdefault(str(i), []).append(words(t))
    for r in got:
        n, at = longest(texts[r.doc_id], items)
        assert (r.longest_match, r.longest_at) == (n, at)
        if n:
            run = words(texts[r.doc_id])[at : at + n]
            assert any(w[r.longest_item_at : r.longest_item_at + n] == run for w in named[r.longest_item])


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(6)
    for letters, n in ((2, 400), (5, 1000), (1, 300)):
        sequence = rng.integers(0, letters + 1, n)
        sequence[n // 2 : n // 2 + 100] = sequence[:100]
        array, rank = decontaminate.suffix_array(sequence)
        raw = [*sequence.tolist(), 0]
        suffix = [raw[p : raw.index(0, p)] for p in array.tolist()]
        assert sorted(array.tolist()) == np.flatnonzero(sequence).tolist()
        assert suffix == sorted(suffix)
        assert [a == b for a, b in zip(rank, rank[1:])] == [a == b for a, b in zip(suffix, suffix[1:])]


def test_very_long_text(spark):
    rows = [(r[0], r[1]) for r in awkward() if r[0] == 11]
    assert result(decontaminate.decontaminate(documents(spark, [r for r in awkward() if r[0] == 11]), bench(spark, ITEMS))) == brute(rows, ITEMS)


@pytest.mark.parametrize("size", [8 << 20, 60])
def test_stage_with_clashing_columns(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
    bench(spark, ITEMS).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(1, ITEMS[0][1], "x", [1], 7, 2.0), (2, "clean", None, None, None, None)], "doc_id long, text string, __x string, spans array<int>, __spans int, longest double")
    out = decontaminate.keep_clean(spark, docs, str(tmp_path))
    assert out.schema == docs.schema and [tuple(r) for r in out.collect()] == [(2, "clean", None, None, None, None)]
