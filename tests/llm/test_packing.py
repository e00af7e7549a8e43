import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import packing
from tests.llm.common import awkward, documents


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def pieces(tokenizer, rows):
    out = []
    for doc, text in rows:
        ids = np.asarray([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = (len(ids) - 1) % 1024 + 1
        for k, start in enumerate([0, *range(first, len(ids), 1024)]):
            own = ids[start : first if k == 0 else start + 1024]
            out.append((str(doc), k, start, len(own), zlib.crc32(own.tobytes())))
    return sorted(out)


def check(got, want):
    assert sorted((str(r.doc_id), *r[1:5]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    return len(bins)


def test_awkward(spark, tokenizer):
    rows = [(r[0], r[1]) for r in awkward()] + [(30, "<|endoftext|> in text"), (31, "    x" * 50), (32, "don't we'LL 123 \r\n\n a" * 40)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(got, pieces(tokenizer, rows))


def test_given_table_and_bound(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 100)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = packing.pack(docs).collect()
    n = check(got, pieces(tokenizer, [(r.doc_id, r.text) for r in docs.collect()]))
    least = -(-sum(r.length for r in got) // 1024)
    assert n <= least * 1.01 + 1


def test_sequences_hold_the_ids(spark, tokenizer):
    rows = [(1, "alpha beta gamma"), (2, "one two"), (3, "x y z " * 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = packing.sequences(docs, packing.pack(docs)).collect()
    ids = Counter(i for r in out for i in r.ids)
    want = Counter(i for _, t in rows for i in [*tokenizer.encode(t, add_special_tokens=False).ids, 2])
    assert ids == want and max(len(r.ids) for r in out) == 1024


def test_islands_do_not_lose_to_best_fit():
    rng = np.random.default_rng(3)
    lengths = rng.integers(200, 480, 400)
    start = [packing.first_packing(lengths, rng if k else None) for k in range(4)]
    out = packing.evolve(lengths, start, np.random.default_rng(1))
    assert min(int(p.max()) for p in out) <= min(int(p.max()) for p in start)
    for p in out:
        assert np.bincount(p, lengths).max() <= 1024 and (p >= 0).all()


def test_cross_keeps_every_piece_once():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 1024, 300)
    a, b = (packing.first_packing(lengths, rng) for _ in range(2))
    child = packing.cross(lengths, a, b, rng)
    assert (child >= 0).all() and np.bincount(child, lengths).max() <= 1024
    assert set(child.tolist()) == set(range(int(child.max()) + 1))


def test_empty(spark):
    assert packing.pack(documents(spark, [])).count() == 0


def test_query_takes_ids_as_the_tokenizer_gives_them(spark, tmp_path):
    """In the query a control token's string is that token; by default it is plain text (`test_awkward`)."""
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    names = [t.content for t in plain.get_added_tokens_decoder().values()]
    rows = [(1, "a<|endoftext|>b"), (2, "".join(names)), (3, "no control"), (4, None), (5, f"中文{names[0]} x"), (6, f"  {names[0]}  y\n" * 400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = packing.query(spark, str(tmp_path)).collect()
    check(got, pieces(plain, rows))
    assert {r.doc_id: r.length for r in got if r.piece == 0}[1] == 4


@pytest.mark.parametrize("low,high,n", [(250, 520, 2000), (300, 600, 2000), (340, 345, 900), (200, 512, 4000)])
def test_the_search_wins_where_best_fit_is_off_the_bound(low, high, n):
    lengths = np.random.default_rng(3).integers(low, high, n)
    population = [packing.first_packing(lengths, np.random.default_rng(k) if k else None) for k in range(4)]
    plain = int(population[0].max()) + 1
    for epoch in range(6):
        population = packing.evolve(lengths, population, np.random.default_rng(epoch))
    assert min(int(p.max()) for p in population) + 1 < plain


def test_stage_with_clashing_columns(spark):
    rows = [(1, "one two three", 4, 5, 6), (2, None, 4, 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block int, length int, __id int")
    assert sorted((r.doc_id, r.length) for r in packing.packed_stage(spark, docs, "").collect()) == [(1, 4), (2, 1)]
