import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import lm
from tests.llm.common import awkward, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CASE = {c: c + 32 for c in range(65, 91)}
END = ("end",)
BEGIN = ("begin",)


def tokens(text):
    return [*WORD.findall((text or "").translate(CASE)), END]


def fold(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7


def base(rows):
    count = Counter(t for d, x in rows if fold(d) != 2 for t in tokens(x))
    n, v = sum(count.values()), len(count)
    out = []
    for d, x in rows:
        own = tokens(x)
        out.append((str(d), fold(d) == 2, len(own), sum(count[t] > 0 for t in own), n, round(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in own), 6)))
    return sorted(out)


def result(df):
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect())


def counted(rows, skip):
    """Counts of the 1-, 2- and 3-grams of documents in whose folds `skip` isn't."""
    out = [Counter(), Counter(), Counter()]
    n_docs = 0
    for d, x in rows:
        if fold(d) not in skip:
            n_docs += 1
            seq = [BEGIN, BEGIN, *tokens(x)]
            for i in range(2, len(seq)):
                for k in range(3):
                    out[k][tuple(seq[i - k : i + 1])] += 1
    return out, n_docs


def estimates(seq, i, counts, n_docs):
    one, two, three = counts
    n, v = sum(one.values()), len(one)
    p = [1 / (v + 1), one[(seq[i],)] / max(n, 1)]
    bucket = 0
    for k in (1, 2):
        context = tuple(seq[i - k : i])
        seen = n_docs if set(context) == {BEGIN} else counts[k - 1][context]
        p.append(counts[k][tuple(seq[i - k : i + 1])] / seen if seen else 0.0)
        bucket = bucket * lm.LEVELS + min(math.frexp(float(seen))[1], lm.LEVELS - 1)
    return bucket, p


def model_scores(rows):
    """The same model by plain counting, position by position."""
    counts, n_docs = counted(rows, {2, 3})
    cells = Counter()
    for d, x in rows:
        if fold(d) == 3:
            seq = [BEGIN, BEGIN, *tokens(x)]
            for i in range(2, len(seq)):
                bucket, p = estimates(seq, i, counts, n_docs)
                cell = bucket
                for q in p[1:]:
                    cell = cell * 64 + (0 if q == 0 else 1 + min(62, max(0, int(np.rint(-np.log2(q))))))
                cells[cell] += 1
    weight = lm.learn(np.array(sorted(cells), np.int64), np.array([cells[c] for c in sorted(cells)], float), len(counts[0]))
    counts, n_docs = counted(rows, {2})
    out = []
    for d, x in rows:
        seq = [BEGIN, BEGIN, *tokens(x)]
        total = 0.0
        for i in range(2, len(seq)):
            bucket, p = estimates(seq, i, counts, n_docs)
            total += math.log10(sum(w * q for w, q in zip(weight[bucket], p)))
        out.append((str(d), round(total, 5)))
    return sorted(out)


def test_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in awkward()]
    assert result(lm.lm_scores(documents(spark))) == base(rows)


@pytest.mark.parametrize("block", [4 << 20, 20_000])
def test_given_table_against_plain_counting(spark, monkeypatch, block):
    monkeypatch.setattr(lm, "BLOCK_BYTES", block)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = lm.lm_scores(docs)
    assert result(got) == base(rows)
    assert [(d, pytest.approx(s, abs=1e-4)) for d, s in model_scores(rows)] == sorted((str(r.doc_id), r.score) for r in got.collect())


def test_held_out_documents_are_likelier_than_under_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [r for r in lm.lm_scores(docs).collect() if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_no_training_documents_and_empty(spark):
    only = next(i for i in range(100) if fold(i) == 2)
    (row,) = lm.lm_scores(documents(spark, [(only, "a b", "en", "s", 1)])).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (True, 3, 0, 0, 0.0, 0.0)
    assert lm.lm_scores(documents(spark, [])).count() == 0


def test_weights_are_distributions():
    cell = np.array([(3 * lm.LEVELS + 2) * 64**3 + 5 * 64**2 + 3 * 64 + 2, (1 * lm.LEVELS + 0) * 64**3 + 9 * 64**2])
    weight = lm.learn(cell, np.array([10.0, 4.0]), 1000)
    assert np.allclose(weight.sum(1), 1) and (weight >= 0).all()
    assert weight[3 * lm.LEVELS, 3] == 0 and weight[2, 2] == 0  # unseen contexts
    assert weight[3 * lm.LEVELS + 2, 3] > 0.5


def test_codes_round_trip():
    for keys in ([], [0, 5, 1 << 39], list(range(1000))):
        assert lm._unpack_keys(lm._pack_keys(np.array(keys, np.uint64))).tolist() == keys
    counts = np.array([0, 1, 254, 255, 256, 1 << 31])
    assert lm._unpack_counts(lm._pack_counts(counts)).tolist() == counts.tolist()


def test_weights_from_a_table_are_the_same(spark, monkeypatch):
    """Evidence that is too large for the driver gives the same weights by aggregations."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plain = {r.doc_id: r.score for r in lm.lm_scores(docs).collect()}
    monkeypatch.setattr(lm, "CELLS", 0)
    monkeypatch.setattr(lm, "ROUNDS", 40)
    other = {r.doc_id: r.score for r in lm.lm_scores(docs).collect()}
    assert set(plain) == set(other) and all(abs(plain[d] - other[d]) < 1e-6 * max(1, abs(plain[d])) for d in plain)
    empty = spark.createDataFrame([], "cell long, n long")
    assert np.allclose(lm.learn_from(empty, 5), lm.learn(np.zeros(0, np.int64), np.zeros(0), 5))
