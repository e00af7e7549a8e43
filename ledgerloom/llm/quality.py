"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Two multinomials over hashed byte n-grams are counted: the target from the
trusted labelled rows, the raw one from every document. A document's score is
the mean over its n-grams of log(target / raw); it is kept when the score
reaches a threshold that is set once, from the labelled rows, and applied to
every document alike. Simple counts of words, symbols and repetitions are
computed beside it and reject what no ratio need judge.

The tables that reach each task hold `BUCKETS` doubles whatever the corpus
size. Labelled rows used are at most `LABELS` (those of the smallest hashed
ids), a documented bound; corpus counts cover all documents.

Cases: null text counts as no words; documents without n-grams score 0; empty
labels, or labels of one class only, give no threshold and reject nothing
beyond the counts; repeated rows give repeated results; null ids stay null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import textkit as tk
from ledgerloom.llm.runtime import documents, over_batches, table

BUCKETS = 1 << 16
LABELS = 20_000
#: A trusted row lost weighs as this many untrusted rows caught, as shares of their classes.
TRUSTED_WEIGHT = 50
GRAM = 4
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"


def _gram_buckets(texts: tk.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of every byte n-gram that lies in one document."""
    n = len(texts.data)
    if n < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.zeros(n - GRAM + 1, np.uint32)
    for k in range(GRAM):
        code |= texts.data[k : n - GRAM + 1 + k].astype(np.uint32) << np.uint32(8 * k)
    doc = np.repeat(np.arange(len(texts)), np.diff(texts.offsets))
    inside = doc[: n - GRAM + 1] == doc[GRAM - 1 :]
    with np.errstate(over="ignore"):
        bucket = ((code * np.uint32(0x9E3779B1)) ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(16)
    return bucket[inside].astype(np.int64), doc[: n - GRAM + 1][inside]


def _mean_ratio(texts: tk.Texts, ratio: np.ndarray) -> np.ndarray:
    bucket, doc = _gram_buckets(texts)
    total = np.bincount(doc, ratio[bucket], len(texts))
    return total / np.maximum(np.bincount(doc, minlength=len(texts)), 1)


def _base_counts(texts: tk.Texts) -> dict[str, np.ndarray]:
    """The counts of one block of documents; see the module's text."""
    n, data = len(texts), texts.data
    words = tk.words_of(texts)
    n_words = np.diff(words.first)
    prefix = tk.prefix_hash(data)
    point = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=point[1:])
    symbol = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOL[data], out=symbol[1:])
    out = {
        "n_words": n_words,
        "word_chars": np.bincount(words.doc, point[words.end] - point[words.start], n).astype(np.int64),
        "n_symbols": np.diff(symbol[texts.offsets]),
    }
    # lines: cut at each newline and at the documents' ends
    newline = np.flatnonzero(data == 10)
    start = np.concatenate([texts.offsets[:-1], newline + 1])
    doc = np.concatenate([np.arange(n), np.searchsorted(texts.offsets, newline, "right") - 1])
    order = np.lexsort((start, doc))
    start, doc = start[order], doc[order]
    end = np.append(start[1:] - 1, len(data))
    last = np.append(doc[1:] != doc[:-1], True)
    end[last] = texts.offsets[doc[last] + 1]
    worded = np.searchsorted(words.start, start) < np.searchsorted(words.start, end)
    doc, key = doc[worded], tk.span_hash(prefix, start[worded], end[worded])
    order = np.lexsort((key, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (key[order][1:] == key[order][:-1])
    out["n_dup_lines"] = np.bincount(doc[order][1:][same], minlength=n)
    # words in windows that occur twice or more in their document
    gram = tk.gram_hashes(tk.span_hash(prefix, words.start, words.end), WINDOW)
    at = np.flatnonzero(words.doc[: len(gram)] == words.doc[WINDOW - 1 :]) if len(gram) else np.zeros(0, np.int64)
    order = at[np.lexsort((gram[at], words.doc[at]))]
    same = (words.doc[order][1:] == words.doc[order][:-1]) & (gram[order][1:] == gram[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(edge, order[twice], 1)
    np.add.at(edge, order[twice] + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(words.doc, np.cumsum(edge)[:-1] > 0, n).astype(np.int64)
    return out


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each bucket and task: n-grams of all documents and of the trusted ones."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        trusted = np.asarray(batch.column("trusted").fill_null(False), bool)
        for first, end, texts in tk.blocks(tk.texts_of(batch.column("text"))):
            bucket, doc = _gram_buckets(texts)
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[trusted[first:end][doc]], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.record_batch({"bucket": pa.array(at, pa.int64()), "raw": pa.array(raw[at]), "target": pa.array(target[at])})


def labelled(labels: DataFrame) -> DataFrame:
    """At most LABELS rows (doc_id, trusted), one for each id: trusted if of good quality in every row."""
    return (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min(F.col("quality") == 1).alias("trusted"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(LABELS)
    )


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The log ratio of each bucket and the threshold."""
    chosen = labelled(labels)
    docs = documents(docs).join(F.broadcast(chosen), "doc_id", "left")
    rows = docs.select("text", "trusted").mapInArrow(_count_grams, "bucket long, raw long, target long")
    got = rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.full(BUCKETS, 0.5), np.full(BUCKETS, 0.5)
    raw[got["bucket"]] += got["raw"]
    target[got["bucket"]] += got["target"]
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        llr = np.concatenate([_mean_ratio(texts, ratio) for _, _, texts in tk.blocks(tk.texts_of(batch.column("text")))])
        return pa.record_batch({"trusted": batch.column("trusted"), "llr": pa.array(llr)})

    seen = over_batches(docs.where("trusted is not null").select("text", "trusted"), score, "trusted boolean, llr double").toPandas()
    return ratio, threshold(seen["llr"].to_numpy(float), seen["trusted"].to_numpy(bool))


def threshold(llr: np.ndarray, trusted: np.ndarray) -> float:
    """The cut that catches untrusted rows while it costs few trusted ones.

    Of all cuts between two neighbouring scores the one with the largest share
    of untrusted rows below it, less TRUSTED_WEIGHT times the share of trusted
    ones; of equals the one in the widest gap, at its middle. Without both
    classes no document is rejected.
    """
    good, bad = np.sort(llr[trusted]), np.sort(llr[~trusted])
    if not len(good) or not len(bad):
        return -np.inf
    at = np.unique(llr)
    cuts = np.concatenate([[at[0] - 1], (at[1:] + at[:-1]) / 2])
    gap = np.concatenate([[0], np.diff(at)])
    gain = np.searchsorted(bad, cuts) / len(bad) - TRUSTED_WEIGHT * np.searchsorted(good, cuts) / len(good)
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(cuts[best[np.argmax(gap[best])]])


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, ratio and verdict of every document; columns as in RESULT."""
    ratio, least = fit(docs, labels)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: list[dict[str, np.ndarray]] = []
        for _, _, texts in tk.blocks(tk.texts_of(batch.column("text"))):
            found.append(_base_counts(texts) | {"llr": _mean_ratio(texts, ratio)})
        out = {k: np.concatenate([f[k] for f in found]) for k in found[0]}
        failed = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
        llr = out.pop("llr")
        out |= {"base_failed": failed, "llr": llr, "kept": ~failed & (llr >= least)}
        return pa.record_batch({"doc_id": batch.column("doc_id")} | {k: pa.array(v) for k, v in out.items()})

    return over_batches(documents(docs), judge, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every column of the documents that are kept.

    The verdict is computed beside the rows themselves, so that no join is
    needed and repeated or null ids are judged row by row.
    """
    ratio, least = fit(docs, table(spark, sf_dir, "labels"))
    schema = docs.schema

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        verdict: list[np.ndarray] = []
        for _, _, texts in tk.blocks(tk.texts_of(batch.column("text"))):
            base = _base_counts(texts)
            failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])
            verdict.append(~failed & (_mean_ratio(texts, ratio) >= least))
        return batch.filter(pa.array(np.concatenate(verdict)))

    return over_batches(docs, keep, schema)
