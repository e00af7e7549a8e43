import re

import numpy as np
import pytest

from ledgerloom.llm import quality
from tests.llm.common import awkward, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    hit = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_base_counts_match_brute_force(spark):
    rows = awkward()
    got = quality.quality_rules(documents(spark), labels(spark, [])).collect()
    assert len(got) == len(rows)
    want = sorted((str(r[0]), *base(r[1])) for r in rows)
    assert sorted((str(r.doc_id), *r[1:6]) for r in got) == want
    for r in got:
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed
        assert r.kept == (not failed)  # without labels nothing else is rejected


def test_base_counts_match_on_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = quality.quality_rules(docs, labels(spark, [])).toPandas().set_index("doc_id")
    for row in docs.collect():
        assert tuple(got.loc[row.doc_id][:5]) == base(row.text)


def test_junk_is_rejected_and_prose_kept(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"{a}{b}{c}" for a in "brstm" for b in "aeiou" for c in "lnrt"]
    prose = [(i, " ".join(rng.choice(vocabulary, 80)), "en", "s", 1) for i in range(120)]
    junk = [(1000 + i, " ".join(w.upper() + "!!%%" for w in rng.choice(vocabulary, 80)), "en", "s", 1) for i in range(40)]
    marked = labels(spark, [(i, 1, 0) for i in range(60)] + [(1000 + i, 0, 0) for i in range(20)])
    got = {r.doc_id: r.kept for r in quality.quality_rules(documents(spark, prose + junk), marked).collect()}
    assert all(got[r[0]] for r in prose)
    assert not any(got[r[0]] for r in junk)


def test_stage_keeps_all_columns_and_empty_tables_work(spark, tmp_path):
    labels(spark, [(1, 1, 0)]).write.parquet(str(tmp_path / "labels.parquet"))
    docs = documents(spark).withColumnRenamed("lang", "kept")
    out = quality.keep_good(spark, docs, str(tmp_path))
    assert out.schema == docs.schema
    assert {r.doc_id for r in out.collect()} <= {r[0] for r in awkward()}
    assert quality.quality_rules(documents(spark, []), labels(spark, [])).count() == 0


@pytest.mark.parametrize("trusted,least", [([True, True], -np.inf), ([False, True], 0.5)])
def test_threshold(trusted, least):
    got = quality.threshold(np.array([0.0, 1.0]), np.array(trusted))
    assert got == least


def plain_grams(text):
    raw = (text or "").encode()
    out = []
    for i in range(len(raw) - 3):
        code = int.from_bytes(raw[i : i + 4], "little")
        mixed = (code * 0x9E3779B1 ^ code >> 15) & 0xFFFFFFFF
        out.append((mixed * 0x85EBCA77 & 0xFFFFFFFF) >> 16)
    return out


def test_ratio_threshold_and_verdict_match_a_plain_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    trusted = {}
    for r in marks.collect():
        if r.doc_id is not None and r.quality is not None:
            trusted[r.doc_id] = trusted.get(r.doc_id, True) and r.quality == 1
    raw, target = np.full(1 << 16, 0.5), np.full(1 << 16, 0.5)
    grams = {d: plain_grams(t) for d, t in rows.items()}
    for d, own in grams.items():
        for b in own:
            raw[b] += 1
            target[b] += trusted.get(d, False)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    llr = {d: float(np.mean(ratio[own])) if own else 0.0 for d, own in grams.items()}
    seen = [(llr[d], t) for d, t in trusted.items() if d in llr]
    good, bad = [s for s, t in seen if t], [s for s, t in seen if not t]
    assert good and bad
    at = sorted({s for s, _ in seen})
    cuts = [at[0] - 1] + [(a + b) / 2 for a, b in zip(at, at[1:])]
    gains = [sum(s < c for s in bad) / len(bad) - quality.TRUSTED_WEIGHT * sum(s < c for s in good) / len(good) for c in cuts]
    gaps = [0.0] + [b - a for a, b in zip(at, at[1:])]
    best = max((round(g, 11), w, -c) for g, w, c in zip(gains, gaps, cuts))
    for r in quality.quality_rules(docs, marks).collect():
        assert abs(r.llr - llr[r.doc_id]) < 1e-9
        if abs(llr[r.doc_id] + best[2]) > 1e-9:
            assert r.kept == (not r.base_failed and llr[r.doc_id] >= -best[2])
