"""Benchmark decontamination with suffix arrays over the training words.

Each task turns its share of the training documents into shards (about
`SHARD_BYTES` of text), builds a suffix array over the words of each shard, and
binary-searches every suffix of the benchmark items in it. The common prefixes
with the neighbours of the place found are the longest verbatim match of that
suffix; neighbours whose common prefix holds a whole benchmark window are its
occurrences. Words inside an occurrence are hit, and documents with enough hit
words are taken out. From the other side, the nearest benchmark suffixes of
every training suffix tell each document's longest match and where it lies.

The suffix array is sparse without loss: a word that is not in the benchmark's
vocabulary matches nothing, so it ends every suffix like a document's end, and
no suffix starts with it. Words are compared by 64-bit hashes.

The benchmark reaches the tasks in blocks of at most `BLOCK_BYTES` of text. A
larger benchmark takes more passes over the documents, one after the other in
the same narrow job; nothing is shuffled.

Cases: null or empty texts have no words and are clean; an empty benchmark hits
nothing; items without words are ignored; repeated items count once by id;
repeated rows get repeated results; null ids stay null (as an item id: "").
Other columns of the documents may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import textkit as tk
from ledgerloom.llm.runtime import documents, fresh, over_batches, table

WINDOW = 13
#: A document is contaminated if at least one in this many of its words is hit.
SHARE = 20
#: Bytes of benchmark text that one pass ships to every task.
BLOCK_BYTES = 8 << 20
#: Bytes of training text under one suffix array.
SHARD_BYTES = 2 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, spans array<bigint>, items array<string>, longest_at long, longest_item string, longest_item_at long"


def _words(texts: tk.Texts) -> tuple[np.ndarray, tk.Words]:
    lower = tk.Texts(tk.LOWER[texts.data], texts.offsets)
    words = tk.words_of(lower, _SEPARATOR)
    return tk.span_hash(tk.prefix_hash(lower.data), words.start, words.end), words


def _sequence(code: np.ndarray, words: tk.Words, n: int) -> np.ndarray:
    """The codes with a 0 after each text: word k of text d stands at k + d."""
    out = np.zeros(len(code) + n + 1, np.int64)
    out[np.arange(len(code)) + words.doc] = code
    return out


def suffix_array(sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all codes but 0 in the order of their suffixes, which end before the next 0, and ranks that only equal suffixes share.

    Places are in groups of equal first words. Each round doubles the words
    that count: a place is told from others of its group by the group of the
    place that many words on. Only groups of several places go on.
    """
    n = len(sequence)
    stop = np.append(np.flatnonzero(sequence == 0), n)
    place = np.flatnonzero(sequence)
    out = place[np.argsort(sequence[place], kind="stable")]
    rank = np.zeros(n + 1, np.int64)
    left = stop[np.searchsorted(stop, out)] - out  # words of the suffix at each place of the array
    at, key, depth = np.arange(len(out)), sequence[out], 1
    while len(at):
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        rank[out[at]] = np.repeat(at[first], size) + 1
        on = (np.repeat(size, size) > 1) & (left[at] >= depth)
        at = at[on]
        if not len(at):
            break
        head = rank[out[at]]
        key = head * (n + 1) + rank[out[at] + depth]
        order = np.argsort(key, kind="stable")
        out[at], left[at], key = out[at][order], left[at][order], key[order]
        depth *= 2
    return out, rank[out]


def _extend(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, common: np.ndarray, most: int | None = None) -> np.ndarray:
    """Common prefixes of the suffixes i of `a` and j of `b`, of which `common` words are known to be equal."""
    out = common.copy()
    on = np.arange(len(out))
    while len(on):
        one = a[i[on] + out[on]]
        on = on[(one > 0) & (one == b[j[on] + out[on]])]
        out[on] += 1
        if most is not None:
            on = on[out[on] < most]
    return out


@dataclass
class TestSet:
    """One block of the benchmark: codes of its words (1 up), its different suffixes in order, and its windows.

    Window k is the first `length[k]` words of the suffix `window[k]`; the
    items that hold it are `holder[first[k]:first[k + 1]]`.
    """

    vocabulary: np.ndarray
    maybe: np.ndarray
    sequence: np.ndarray
    suffix: np.ndarray
    window: np.ndarray
    length: np.ndarray
    holder: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    names: list[str]

    def item_of(self, place: int) -> tuple[str, int]:
        """Name of the item that holds a place of the sequence, and the word's number in it."""
        item = int(np.searchsorted(self.starts, place, "right")) - 1
        return self.names[item], int(place - self.starts[item])


def test_set(rows: list[tuple[str, str]]) -> TestSet:
    hashes, words = _words(tk.texts_of(pa.array([text for _, text in rows], pa.large_string())))
    vocabulary = np.unique(hashes)
    sequence = _sequence(np.searchsorted(vocabulary, hashes) + 1, words, len(rows))
    starts = words.first[:-1] + np.arange(len(rows))
    count = np.diff(words.first)
    maybe = np.zeros(1 << 20, bool)
    maybe[(vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    array, rank = suffix_array(sequence)
    item = np.searchsorted(starts, array, "right") - 1
    left = starts[item] + count[item] - array
    prefix = np.zeros(len(array), np.int64)  # common with the suffix before
    prefix[1:] = _extend(sequence, array[1:], sequence, array[:-1], np.zeros(max(0, len(array) - 1), np.int64), WINDOW)
    _, model, of = np.unique(rank, return_index=True, return_inverse=True)  # equal suffixes are one
    # windows, shortest first: runs of suffixes that begin alike
    window, length, holder, size = [], [], [], []
    wide = np.minimum(count, WINDOW)[item]
    for w in np.unique(wide).tolist():
        run = np.cumsum(prefix < w)
        own = np.flatnonzero((wide == w) & (left >= w))
        pairs = np.unique(np.stack([run[own], item[own]], 1), axis=0)
        _, first, times = np.unique(pairs[:, 0], return_index=True, return_counts=True)
        _, one = np.unique(run[own], return_index=True)
        window.append(array[model[of[own[one]]]])
        length.append(np.full(len(one), w))
        holder.append(pairs[:, 1])
        size.append(times)
    whole = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
    return TestSet(vocabulary, maybe, np.append(sequence, 0), array[model], whole(window), whole(length), whole(holder), np.append(0, np.cumsum(whole(size))), starts, [name for name, _ in rows])


test_set.__test__ = False
TestSet.__test__ = False


@dataclass
class Shard:
    """Training words as codes of the benchmark (0: not in it, or a document's end), and their suffix array with common prefixes up to WINDOW."""

    words: tk.Words
    sequence: np.ndarray
    array: np.ndarray
    prefix: np.ndarray


def shard_of(texts: tk.Texts, test: TestSet) -> Shard:
    hashes, words = _words(texts)
    code = np.zeros(len(hashes), np.int64)
    at = np.flatnonzero(test.maybe[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
    if len(at) and len(test.vocabulary):
        place = np.minimum(np.searchsorted(test.vocabulary, hashes[at]), len(test.vocabulary) - 1)
        code[at] = np.where(test.vocabulary[place] == hashes[at], place + 1, 0)
    sequence = _sequence(code, words, len(texts))
    array, _ = suffix_array(sequence)
    prefix = np.zeros(len(array), np.int64)
    prefix[1:] = _extend(sequence, array[1:], sequence, array[:-1], np.zeros(max(0, len(array) - 1), np.int64), WINDOW)
    return Shard(words, np.append(sequence, 0), array, prefix)


def search(shard: Shard, test: TestSet, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Binary search of benchmark suffixes: how many training suffixes are smaller, and the words in common with the last of these and with the next one."""
    low, high = np.zeros(len(suffix), np.int64), np.full(len(suffix), len(shard.array))
    before, after = np.zeros(len(suffix), np.int64), np.zeros(len(suffix), np.int64)
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        own, other = suffix[open_], shard.array[middle]
        # what both bounds share with the suffix, all between them share
        common = _extend(test.sequence, own, shard.sequence, other, np.minimum(before[open_], after[open_]))
        smaller = shard.sequence[other + common] < test.sequence[own + common]
        up, down = open_[smaller], open_[~smaller]
        low[up], before[up] = middle[smaller] + 1, common[smaller]
        high[down], after[down] = middle[~smaller], common[~smaller]
        open_ = open_[low[open_] < high[open_]]
    return low, before, after


@dataclass
class Found:
    """Occurrences of windows (first word in the shard, window), and each document's longest match: words, first word in the shard, place in the benchmark."""

    position: np.ndarray
    window: np.ndarray
    longest: np.ndarray
    at: np.ndarray
    place: np.ndarray


def find(shard: Shard, test: TestSet, n: int) -> Found:
    """All that the benchmark has in common with the n documents of a shard."""
    zero = np.zeros(0, np.int64)
    out = Found(zero, zero, np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64))
    if not len(shard.array) or not len(test.suffix):
        return out
    known = np.zeros(len(test.vocabulary) + 1, bool)
    known[shard.sequence[shard.array]] = True
    suffix = test.suffix[known[test.sequence[test.suffix]]]
    low, before, after = search(shard, test, suffix)
    # windows: all training suffixes around the place that share the window's words
    slot = np.full(len(test.sequence), -1)
    slot[suffix] = np.arange(len(suffix))
    of = np.flatnonzero(slot[test.window] >= 0)
    k = slot[test.window[of]]
    neighbour = np.where(before[k] >= test.length[of], low[k] - 1, low[k])
    hit = np.maximum(before[k], after[k]) >= test.length[of]
    of, neighbour = of[hit], neighbour[hit]
    first, last = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
    for w in np.unique(test.length[of]).tolist():
        edge = np.append(np.flatnonzero(shard.prefix < w), len(shard.array))
        own = np.flatnonzero(test.length[of] == w)
        run = np.searchsorted(edge, neighbour[own], "right")
        first[own], last[own] = edge[run - 1], edge[run]
    out.window = np.repeat(of, last - first)
    place = shard.array[tk.ranges(first, last - first)]
    # a place in the sequence is a word and the documents before it
    starts = shard.words.first[:-1] + np.arange(n)
    out.position = place - (np.searchsorted(starts, place, "right") - 1)
    # the longest match of each training suffix is with one of the two benchmark suffixes beside it
    index = np.arange(len(shard.array))
    above = np.searchsorted(low, index, "right")
    doc = np.searchsorted(starts, shard.array, "right") - 1
    for beside, there in ((above - 1, above > 0), (above, above < len(suffix))):
        i, other = shard.array[there], suffix[beside[there]]
        common = _extend(shard.sequence, i, test.sequence, other, np.zeros(len(i), np.int64))
        order = np.lexsort((i, -common, doc[there]))
        d, best = np.unique(doc[there][order], return_index=True)
        best = order[best]
        better = (common[best] > out.longest[d]) | ((common[best] == out.longest[d]) & (i[best] - d < out.at[d]))
        d, best = d[better], best[better]
        out.longest[d], out.at[d], out.place[d] = common[best], i[best] - d, other[best]
    return out


#: What the passes have found so far, beside a document: field, type, empty value.
FOUND = (("spans", "array<bigint>", "cast(array() as array<bigint>)"), ("items", "array<string>", "cast(array() as array<string>)"), ("longest", "bigint", "cast(0 as bigint)"), ("at", "bigint", "cast(null as bigint)"), ("item", "string", "cast(null as string)"), ("item_at", "bigint", "cast(null as bigint)"))
_ARROW = {"array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "bigint": pa.int64(), "string": pa.string()}


def _annotate(test: TestSet, name: dict[str, str]):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = tk.texts_of(batch.column("text"))
        had = {f: batch.column(name[f]).to_pylist() for f, _, _ in FOUND}
        for first, end, part in tk.blocks(texts, SHARD_BYTES):
            shard = shard_of(part, test)
            found = find(shard, test, end - first)
            start = shard.words.first
            doc = shard.words.doc[found.position]
            local = found.position - start[doc]
            for d, a, b in zip(*(x.tolist() for x in tk.union_length(doc, local, local + test.length[found.window]))):
                had["spans"][first + d] += [a, b]
            pairs = np.unique(np.stack([doc, found.window], 1), axis=0) if len(doc) else np.zeros((0, 2), np.int64)
            held = np.diff(test.first)[pairs[:, 1]]
            item = test.holder[tk.ranges(test.first[pairs[:, 1]], held)]
            pairs = np.unique(np.stack([np.repeat(pairs[:, 0], held), item], 1), axis=0) if len(item) else np.zeros((0, 2), np.int64)
            for d, i in pairs.tolist():
                had["items"][first + d].append(test.names[i])
            for d in np.flatnonzero(found.longest).tolist():
                length, at = int(found.longest[d]), int(found.at[d] - start[d])
                if (-length, at) < (-had["longest"][first + d], had["at"][first + d] or 0):
                    had["longest"][first + d], had["at"][first + d] = length, at
                    had["item"][first + d], had["item_at"][first + d] = test.item_of(found.place[d])
        out = {c: batch.column(c) for c in batch.schema.names if c not in name.values()}
        return pa.record_batch(out | {name[f]: pa.array(had[f], _ARROW[kind]) for f, kind, _ in FOUND})

    return run


def _digest(batch: pa.RecordBatch, name: dict[str, str]) -> dict[str, pa.Array]:
    """Words, hit words, items and verdict from what all passes found."""
    n_words = [np.diff(_words(part)[1].first) for _, _, part in tk.blocks(tk.texts_of(batch.column("text")))]
    n_words = np.concatenate(n_words)
    n_hit, names, hit = np.zeros(batch.num_rows, np.int64), [], []
    for k, (spans, items) in enumerate(zip(batch.column(name["spans"]).to_pylist(), batch.column(name["items"]).to_pylist())):
        if spans:
            pairs = np.asarray(spans, np.int64).reshape(-1, 2)
            _, a, b = tk.union_length(np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1])
            n_hit[k] = (b - a).sum()
            spans = np.stack([a, b], 1).ravel().tolist()
        hit.append(spans)
        names.append(sorted(set(items)))
    return {
        "n_words": pa.array(n_words),
        "n_hit": pa.array(n_hit),
        "n_items": pa.array([len(x) for x in names], pa.int64()),
        "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]),
        "contaminated": pa.array((n_hit > 0) & (SHARE * n_hit >= n_words)),
        "longest_match": batch.column(name["longest"]),
        "spans": pa.array(hit, pa.list_(pa.int64())),
        "items": pa.array(names, pa.list_(pa.string())),
        "longest_at": batch.column(name["at"]),
        "longest_item": batch.column(name["item"]),
        "longest_item_at": batch.column(name["item_at"]),
    }


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's items in blocks of bounded size, in a fixed order."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = -(-total // BLOCK_BYTES)
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("name"), F.lit(n)) == k).distinct().orderBy("name", "text").collect()
        if rows:
            yield [(r.name, r.text) for r in rows]


def _searched(docs: DataFrame, benchmark: DataFrame, finish: Callable[[pa.RecordBatch, dict[str, str]], pa.RecordBatch], schema: str | T.StructType) -> DataFrame:
    """Every pass over the documents, and `finish` on what they found; the last pass and `finish` are one Python stage.

    Between passes the findings are columns whose names the documents don't have.
    """
    name = {f: fresh(docs, f) for f, _, _ in FOUND}
    out = docs.select("*", *(F.expr(empty).alias(name[f]) for f, _, empty in FOUND))
    between = T.StructType([*docs.schema, *(T.StructField(name[f], T.DataType.fromDDL(kind)) for f, kind, _ in FOUND)])
    last = None
    for rows in _blocks(benchmark):
        if last is not None:
            out = over_batches(out, last, between)
        last = _annotate(test_set(rows), name)
    return over_batches(out, lambda batch: finish(last(batch) if last else batch, name), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The verdict on every document; columns as in RESULT.

    `spans` holds first and end word (exclusive, from 0) of each hit stretch in turn, `items` the ids found.
    `longest_match` counts the words of the longest run that the document shares with any item, whole windows or not; it
    starts at word `longest_at` of the document and word `longest_item_at` of `longest_item`, one of the items that hold it.
    """
    return _searched(documents(docs), benchmark, lambda batch, name: pa.record_batch({"doc_id": batch.column("doc_id")} | _digest(batch, name)), RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("longest_match", "spans", "items", "longest_at", "longest_item", "longest_item_at")


def _words_sql(source: str, key: str) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {source}"


ORACLE = f"""
WITH item AS ({_words_sql('benchmark', "coalesce(CAST(item_id AS VARCHAR), '') AS name")}), doc AS ({_words_sql('documents', 'doc_id')}),
win AS (
    SELECT DISTINCT name, n, array_to_string(w[i:i + n - 1], ' ') AS g
    FROM (SELECT name, w, least(len(w), {WINDOW}) AS n, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes WHERE len(w) >= n)),
found AS (SELECT DISTINCT doc_id, name, n, i FROM grams JOIN win USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, name FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every column of the documents that aren't contaminated."""

    def keep(batch: pa.RecordBatch, name: dict[str, str]) -> pa.RecordBatch:
        clean = pa.compute.invert(_digest(batch, name)["contaminated"])
        return batch.select(list(range(len(docs_schema)))).filter(clean)

    docs_schema = docs.schema
    return _searched(docs, table(spark, sf_dir, "benchmark"), keep, docs_schema)
