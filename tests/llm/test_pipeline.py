"""run() held against the stages' definitions, computed plainly from the rows."""

import numpy as np
import pytest

import corpus_pipeline
from ledgerloom.llm import quality
from tests.llm import test_decontaminate as plain_hits
from tests.llm import test_jaccard as plain_near
from tests.llm import test_linededup as plain_lines
from tests.llm import test_packing as plain_packing
from tests.llm.test_packing import tokenizer  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    return read("documents"), read("labels"), read("benchmark")


def plain_pipeline(tables):
    docs, labels, benchmark = tables
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    verdict = {r.doc_id: r.kept for r in quality.quality_rules(docs, labels).collect()}
    rows = [r for r in rows if verdict[r[0]]]
    left = {int(d): t for d, t in plain_lines.brute(rows)}
    rows = [(d, left[d]) for d, t in rows if left[d] or not t]
    near = {int(d): int(c) for d, _, c in plain_near.brute(rows)}
    rows = [r for r in rows if near[r[0]] == r[0]]
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    dirty = {int(x[0]) for x in plain_hits.brute(rows, items) if x[5]}
    return [r for r in rows if r[0] not in dirty]


def test_run_matches_the_plain_stages(spark, tables, tokenizer):  # noqa: F811
    want = plain_pipeline(tables)
    got = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(want) < tables[0].count()
    plain_packing.check(got, plain_packing.pieces(tokenizer, want))


def test_every_stage_but_the_last_keeps_the_columns(spark, tables):
    docs = tables[0]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name


def test_clean_documents_stay_and_planted_ones_go(spark, tables):
    rng = np.random.default_rng(11)
    docs, _, benchmark = tables
    source = [r.text for r in docs.collect() if r.lang == "en" and r.doc_id in (6, 7, 9, 17)]
    words = " ".join(source).split()
    clean = [(9000 + i, " ".join(rng.choice(words, 150))) for i in range(8)]
    item = max((r.text for r in benchmark.collect()), key=lambda t: len(t.split()))
    copy = (9100, clean[0][1].replace(" ", "  ", 3))
    dirty = (9101, " ".join(rng.choice(words, 30)) + " " + item)
    junk = (9102, " ".join(w.upper() + "!!%%" for w in rng.choice(words, 100)))
    rows = clean + [copy, dirty, junk]
    extra = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], docs.schema)
    out = docs.unionByName(extra)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, out, SF), "test")
    kept = {r.doc_id for r in out.select("doc_id").collect()}
    assert {d for d, _ in clean} <= kept and not {9100, 9101, 9102} & kept


def test_stages_survive_awkward_rows(spark):
    from tests.llm.common import documents

    out = documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, out, SF), "awkward")
    corpus_pipeline.STAGES[-1][1](spark, out, SF).count()
    empty = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_stages_take_any_extra_columns(spark, tables):
    docs = tables[0].limit(60)
    for name in ("__id", "__x", "__gone", "__spans", "spans", "row", "items", "class", "part", "kind", "longest"):
        docs = docs.withColumn(name, docs.doc_id.cast("string"))
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, out, SF), "clash")
        assert out.schema == docs.schema, name
    rows = out.collect()
    assert rows and all(r["__x"] == r["row"] == r["longest"] == str(r.doc_id) for r in rows)
    assert corpus_pipeline.STAGES[-1][1](spark, out, SF).count() >= len(rows)
