import hashlib
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import suffixes
from tests.llm.common import awkward


def brute(rows):
    count = Counter()
    raw = [(d, (t or "").encode()) for d, t in rows]
    for _, b in raw:
        count.update(b[i : i + 200] for i in range(len(b) - 199))
    out = []
    for d, b in raw:
        gone = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i] += 1
                gone[i + 200] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~mask])
        runs = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if len(mask) else 0
        out.append((str(d), len(b), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((str(r.doc_id), *r[1:]) for r in df.collect())


def prose(rng, n):
    words = ["".join(rng.choice(list("abcdeéü"), rng.integers(2, 9))) for _ in range(60)]
    return " ".join(rng.choice(words, n))


def cases():
    rng = np.random.default_rng(2)
    base = [prose(rng, 150) for _ in range(6)]
    rows = [(r[0], r[1]) for r in awkward() if r[0] != 11]
    rows += [(20, base[0]), (21, base[0][:400] + "X" + base[0][401:]), (22, base[0][100:299]), (23, base[0][100:300]), (24, "pre " + base[0][50:270] + base[1][10:230] + " post")]
    rows += [(25, base[1]), (26, base[2] + base[2]), (27, base[3][:199]), (28, base[3][:199]), (29, base[3][:200]), (30, base[3][:201]), (31, "ab" * 300), (32, "x" * 199), (33, "y" * 200), (34, "z" * 201)]
    rows += [(40 + i, prose(rng, 30) + base[4][:250] + prose(rng, 30)) for i in range(25)]
    return rows


def test_cases(spark):
    rows = cases()
    assert result(suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert result(suffixes.dedup(docs)) == want and sum(r[2] for r in want) > 0


@pytest.mark.parametrize("alphabet", [1, 2, 26])
def test_suffix_array_is_sorted(alphabet):
    rng = np.random.default_rng(alphabet)
    data = (rng.integers(0, alphabet, 3000) + 97).astype(np.uint8)
    data[1000:1500] = data[200:700]
    wanted = rng.random(3000) < 0.7
    order = suffixes.sort_suffixes(data, wanted)
    assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist()
    raw = data.tobytes() + b"\xff" * 300
    keys = [raw[i : i + 200] for i in order]
    assert keys == sorted(keys)
    lcp = suffixes.common_prefixes(data, order)
    for k in range(1, len(order), 37):
        a, b = data[order[k] :].tobytes()[:200], data[order[k - 1] :].tobytes()[:200]
        n = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        assert lcp[k] == n


def test_spans_and_empty(spark):
    rows = [(1, "q" * 10 + "lorem ipsum dolor " * 20), (2, "lorem ipsum dolor " * 20), (3, None)]
    got = {r.doc_id: r.removed for r in suffixes.removed_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(x) for x in got[1]] == [(10, 370)] and [tuple(x) for x in got[2]] == [(0, 360)] and got[3] is None
    assert suffixes.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def shard_rows(texts):
    """What one fragment makes of the texts, without Spark: (text number, first, end)."""
    import pyarrow as pa

    batch = pa.record_batch({"k": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.large_string()), "copies": pa.array([1] * len(texts), pa.int64())})
    places = suffixes._repeated(pa.Table.from_batches([suffixes._send_anchors(1)(batch)])).to_pylist()
    at = pa.array([[p["at"] for p in places if p["k"] == k] for k in range(len(texts))], pa.list_(pa.int64()))
    sent = suffixes._send_contexts(1)(pa.record_batch({**{c: batch.column(c) for c in batch.schema.names}, "at": at}))
    return [tuple(r.values()) for r in suffixes._shard(pa.Table.from_batches([sent])).to_pylist()]


def test_common_prefixes_alone_decide(monkeypatch):
    rng = np.random.default_rng(12)
    passage = prose(rng, 120)
    texts = [prose(rng, 40) + passage + prose(rng, 40) for _ in range(6)] + [prose(rng, 200), passage + "!", "?" + passage[:300]]
    assert {k for k, _, _ in shard_rows(texts)} == {0, 1, 2, 3, 4, 5, 7, 8}
    seen = []
    plain = suffixes.common_prefixes
    monkeypatch.setattr(suffixes, "common_prefixes", lambda data, order, most=200: seen.append(len(order)) or plain(data, order, most))
    shard_rows(texts)
    assert seen and sum(seen) > len(passage.encode()) - 199
    monkeypatch.setattr(suffixes, "common_prefixes", lambda data, order, most=200: np.zeros(len(order), np.int64))
    assert shard_rows(texts) == []


def test_equal_hashes_of_other_bytes(monkeypatch):
    """Hashes only route: contexts whose hashes happen to be equal are still told apart by their bytes."""
    rng = np.random.default_rng(13)
    texts = [(i, prose(rng, 60)) for i in range(8)] + [(20, prose(rng, 90))]
    passage = texts[8][1]
    texts += [(21, "a" + passage + "b"), (22, passage + prose(rng, 20))]
    plain = suffixes._hashes
    monkeypatch.setattr(suffixes, "_hashes", lambda text, begin, end: plain(text, begin, end) & np.uint64(0))
    got = shard_rows([t for _, t in texts])
    covered = {}
    for k, a, b in got:
        covered.setdefault(k, np.zeros(len(texts[k][1].encode()), bool))[a:b] = True
    want = {d: n for d, _, n, _, _ in brute(texts)}
    assert {str(texts[k][0]): int(m.sum()) for k, m in covered.items()} == {d: n for d, n in want.items() if n}


def test_very_long_text(spark):
    rows = [(r[0], r[1]) for r in awkward() if r[0] == 11]
    assert result(suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
