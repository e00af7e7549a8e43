import numpy as np
import pyarrow as pa

from ledgerloom.llm import licenses
from tests.llm.common import awkward, documents

MIT = dict(licenses.TEMPLATES)["MIT-grant"]


def plain_local(template, text):
    """Best local alignment without a band: score, matched."""
    best, row = (0, 0), [(0, 0)] * (len(text) + 1)
    for t in template:
        new = [(0, 0)]
        for j, x in enumerate(text, 1):
            options = [(row[j - 1][0] + (1 if t == x else -1), row[j - 1][1] + (t == x)), (row[j][0] - 1, row[j][1]), (new[-1][0] - 1, new[-1][1])]
            s = max(options)
            new.append(s if s[0] > 0 else (0, 0))
            best = max(best, new[-1])
        row = new
    return best


def test_banded_alignment_matches_the_full_one():
    rng = np.random.default_rng(1)
    for _ in range(60):
        template = rng.integers(0, 8, rng.integers(3, 15))
        text = np.concatenate([rng.integers(0, 8, 4), np.delete(template, rng.integers(0, len(template))), rng.integers(0, 8, 3)])
        got = licenses.align(template, text, 4, band=40)
        assert got[:2] == plain_local(template.tolist(), text.tolist())
        assert 0 <= got[2] < got[3] <= len(text) or got[0] == 0


def test_spans_and_coverage(spark):
    words = MIT.split()
    edited = " ".join(w if i != 9 else "some other" for i, w in enumerate(words))
    text = "Prosé befóre.\n" + edited + "\nafter it"
    rows = [(1, text, "en", "s", 1), (2, " ".join(words[: len(words) // 2]), "en", "s", 1), (3, "x Released under the MIT license. y. Released under the MIT License.", "en", "s", 1)]
    got = licenses.license_scan(documents(spark, rows)).collect()
    (one,) = [r for r in got if r.doc_id == 1]
    assert one.license == "MIT-grant" and one.matched == len(words) - 1 and text[one.first_char : one.end_char] == edited
    assert not [r for r in got if r.doc_id == 2]
    assert [(r.license, r.coverage) for r in got if r.doc_id == 3] == [("MIT", 1.0)] * 2


def test_given_table_against_plain_search(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(r.doc_id, r.license) for r in licenses.license_scan(docs).collect() if r.coverage == 1}
    want = {(r.doc_id, n) for r in docs.collect() for n, t in licenses.TEMPLATES if t.rstrip(".").lower() in (r.text or "").lower()}
    assert want and want <= got and all(n in dict(licenses.TEMPLATES) for _, n in got)


def test_awkward_and_empty(spark):
    assert licenses.license_scan(documents(spark)).count() == 0
    assert licenses.license_scan(documents(spark, [])).count() == 0
    got = licenses.license_scan(documents(spark), [("word", "one"), ("none", "  "), ("two", "zwei drei")]).collect()
    assert {(r.doc_id, r.license) for r in got} == {(6, "word"), (7, "two")} and len(got) == 3
    assert len(awkward()) == 17


def test_winnowed_places_cover_every_window():
    gram = np.random.default_rng(2).integers(0, 50, 200).astype(np.uint64)
    at = licenses.winnow(gram)
    assert all(any(i <= a < i + licenses.WINNOW for a in at) for i in range(len(gram) - licenses.WINNOW + 1))
    assert licenses.index_of([("a", "b c d e")]).names == ["a"] and pa.__version__


def test_whole_texts_are_found(spark):
    texts = {n: t for n, t in licenses.TEMPLATES if n.endswith("-text")}
    assert len(texts) == len(licenses.TEXTS)
    rows = [(i, f"own words first\n\nCopyright (c) 2020 A. Body\n\n{t}\nown words after", "en", "s", 1) for i, t in enumerate(texts.values())]
    got = licenses.license_scan(documents(spark, rows)).collect()
    for i, (n, t) in enumerate(texts.items()):
        assert [r.coverage for r in got if r.doc_id == i and r.license == n] == [1.0], n
    mit = texts["MIT-text"].split()
    rows = [(1, " ".join(mit[:60]), "en", "s", 1), (2, "x " + " ".join(mit[:150]), "en", "s", 1)]
    got = {(r.doc_id, r.license): r.coverage for r in licenses.license_scan(documents(spark, rows)).collect()}
    assert (1, "MIT-text") not in got and got[2, "MIT-text"] < 1


def test_regions_left_out_hold_no_match(monkeypatch):
    model, rng = "a b c d e f g h i j k l".split(), np.random.default_rng(5)
    index = licenses.index_of([("one", " ".join(model))])
    texts = [" ".join(rng.choice([*model, "x", "y"], 9)) + " " + " ".join(w for w in model if rng.random() > 0.15) + " x a b c d" for _ in range(300)]
    blocks = licenses.tk.texts_of(pa.array(texts, pa.large_string()))
    got = licenses.scan(blocks, index)
    monkeypatch.setattr(licenses, "_able", lambda doc, *_: np.ones(len(doc), bool))
    monkeypatch.setattr(licenses, "_within", lambda model, *_: len(model))
    assert got and got == licenses.scan(blocks, index)


def test_short_templates_have_no_blind_spot(spark):
    short = [(n, t) for n, t in licenses.TEMPLATES if len(t.split()) < licenses.SHORT]
    cases = [(n, " ".join(t.split()[:i] + t.split()[i + 1 :])) for n, t in short for i in range(len(t.split()))]
    index = licenses.index_of(short)
    words = {n: w for n, w in zip(index.names, index.words)}
    got = licenses.scan(licenses.tk.texts_of(pa.array([t for _, t in cases], pa.large_string())), index)
    found = {(d, index.names[t]) for d, t, *_ in got}
    for k, (n, text) in enumerate(cases):
        own, _ = licenses._words(licenses.tk.texts_of(pa.array([text], pa.large_string())))
        _, matched = plain_local(words[n].tolist(), own.tolist())
        assert ((k, n) in found) == (matched >= licenses.LEAST_COVERAGE * len(words[n])), (n, text)
    rows = [(1, "Released under MIT License.", "en", "s", 1)]
    assert [(r.license, r.coverage) for r in licenses.license_scan(documents(spark, rows)).collect()] == [("MIT", 0.8)]


def test_damaged_copies_have_the_coverage_of_the_best_alignment(spark):
    """Copies of whole licenses with single words lost or replaced, end to end against a full local alignment."""
    texts = {n: t for n, t in licenses.TEMPLATES if n in ("MIT-text", "BSD-3-Clause-text", "ISC-text")}
    rng, rows = np.random.default_rng(8), []
    for n, t in texts.items():
        for share in (0.01, 0.04, 0.09, 0.3):
            words = t.split()
            for i in rng.choice(len(words), int(share * len(words)), replace=False).tolist():
                words[i] = "" if rng.random() < 0.2 else f"changed{i}"
            rows.append((len(rows), n, "before it all " + " ".join(w for w in words if w) + " and after"))
    got = {(r.doc_id, r.license): r.coverage for r in licenses.license_scan(documents(spark, [(i, t, "en", "s", 1) for i, _, t in rows])).collect()}
    found = 0
    for i, n, t in rows:
        model, _ = licenses._words(licenses.tk.texts_of(pa.array([texts[n]], pa.large_string())))
        own, _ = licenses._words(licenses.tk.texts_of(pa.array([t], pa.large_string())))
        _, matched = plain_local(model.tolist(), own.tolist())
        if matched >= licenses.LEAST_COVERAGE * len(model):
            assert abs(got[i, n] - matched / len(model)) < 1e-9, (n, i)
            found += 1
        else:
            assert (i, n) not in got
    assert 6 <= found < len(rows)
