"""LM scoring by deleted interpolation.

Maximum-likelihood estimates of order 0 (uniform), 1, 2 and 3 are mixed with
weights that depend on how often the two contexts were seen: the frequencies of
the last word and of the last two words, in powers of two, name a bucket, and
each bucket has its own weights. They are learned by expectation-maximisation
on held-out counts: one fold of the training documents is deleted from the
counts, and its tokens, with what the others say of them, are the evidence.
The final counts hold all training documents.

Texts are cut into blocks of about BLOCK_BYTES, of one fold each, once. A block
sends its distinct n-grams with their counts to fragments by hash; fragments
add up and answer each block. So a frequent n-gram is one row of each block,
counts grow with the corpus and are never in one place, and a block's tokens
meet their counts without a row per token.

N-grams are told apart by fragment and KEY_BITS bits of hash; the fragments
follow the session's shuffle partitions. The evidence for the weights is a
histogram over buckets and estimates in powers of two. Up to CELLS of its cells
are taken to the driver; a larger one stays a table, and each round of
expectation-maximisation is an aggregation that gives the same sums.

Cases: null and empty texts hold one end token; null ids are in the training
part; repeated rows count as often as they stand; without training documents
every token is unknown and all weight lies on the uniform part; an empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import textkit as tk
from ledgerloom.llm.runtime import NULL_KEY, documents, key_back, parts, table, written

#: Documents whose hashed id leaves HELD_OUT are only scored; those that leave DEV are deleted from the counts for the weights.
FOLDS, HELD_OUT, DEV = 7, 2, 3
TRAIN_FOLD, DEV_FOLD, HELD_OUT_FOLD = range(3)
ORDER = 3
BLOCK_BYTES = 2 << 20
#: Bits of hash that tell words, and n-grams of two and three, apart within a fragment.
KEY_BITS = (0, 48, 40, 40)
#: Context frequencies 0, 1, 2-3, 4-7 ... and the last open.
LEVELS = 14
ROUNDS = 40
CELLS = 2_000_000
#: No weight of a usable estimate falls under this.
LEAST_WEIGHT = 1e-6

RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
BLOCKS = "block long, fold int, ids binary, offsets binary, data binary"
SENT = "part int, rank int, block long, fold int, keys binary, counts binary"
ANSWERS = "block long, part int, rank int, whole binary, deleted binary"
END, BEGIN = (tk.mix(np.asarray([x], np.uint64))[0] for x in (0xE4D0, 0xBE61))


def fold_of(doc_id: int | None) -> int:
    rest = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS
    return HELD_OUT_FOLD if rest == HELD_OUT else DEV_FOLD if rest == DEV else TRAIN_FOLD


def blocks_of(docs: DataFrame) -> DataFrame:
    """Documents in blocks, each of one fold; written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        ids: list[list[np.ndarray]] = [[], [], []]
        held: list[list[tk.Texts]] = [[], [], []]
        size = [0, 0, 0]

        def flush(fold: int) -> pa.RecordBatch:
            nonlocal number
            lengths = np.concatenate([np.diff(t.offsets) for t in held[fold]])
            row = {"block": [number], "fold": [fold], "ids": [np.concatenate(ids[fold]).tobytes()], "offsets": [np.append(0, np.cumsum(lengths)).astype("<i8").tobytes()], "data": [b"".join(t.data.tobytes() for t in held[fold])]}
            ids[fold], held[fold], size[fold], number = [], [], 0, number + 1
            return pa.record_batch({"block": pa.array(row["block"], pa.int64()), "fold": pa.array(row["fold"], pa.int32())} | {c: pa.array(row[c], pa.binary()) for c in ("ids", "offsets", "data")})

        for batch in batches:
            own = batch.column("doc_id")
            fold = np.asarray([fold_of(x) for x in own.to_pylist()])
            number_of = np.asarray(own.fill_null(NULL_KEY))
            for first, end, texts in tk.blocks(tk.texts_of(batch.column("text")), BLOCK_BYTES // 4):
                for f in range(3):
                    at = np.flatnonzero(fold[first:end] == f)
                    if len(at):
                        count = np.diff(texts.offsets)[at]
                        ids[f].append(number_of[first:end][at])
                        held[f].append(tk.Texts(texts.data[tk.ranges(texts.offsets[at], count)], np.append(0, np.cumsum(count))))
                        size[f] += int(count.sum()) + 64 * len(at)
                        if size[f] >= BLOCK_BYTES:
                            yield flush(f)
        for f in range(3):
            if held[f]:
                yield flush(f)

    return documents(docs).mapInArrow(run, BLOCKS)


def tokens_of(texts: tk.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all documents, an end token after each, and the first token of each document (n + 1 values)."""
    words = tk.words_of(texts)
    hashes = tk.word_hashes(texts, words)
    first = words.first + np.arange(len(words.first))
    token = np.full(len(hashes) + len(texts), END, np.uint64)
    token[np.arange(len(hashes)) + words.doc] = hashes
    return token, first


def grams(token: np.ndarray, first: np.ndarray, rank: int) -> np.ndarray:
    """The hash of each token with the rank - 1 before it; BEGIN stands before a document."""
    out = token.copy()
    back = np.arange(len(token)) - np.repeat(first[:-1], np.diff(first))
    with np.errstate(over="ignore"):
        for k in range(1, rank):
            before = np.full(len(token), BEGIN, np.uint64)
            before[k:] = np.where(back[k:] >= k, token[: len(token) - k], BEGIN) if len(token) > k else before[k:]
            out = out * np.uint64(0x9E3779B97F4A7C15) + before * np.uint64(2 * k + 0xD6E8FEB86659FD93)
    return tk.mix(out + np.uint64(rank))


def _places(gram: np.ndarray, fragments: int, rank: int) -> np.ndarray:
    """Fragment and key of each n-gram in one number."""
    part = (gram >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)
    return part << np.uint64(KEY_BITS[rank]) | (gram & np.uint64((1 << KEY_BITS[rank]) - 1))


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, four bytes each where they fit."""
    step = np.diff(keys, prepend=np.uint64(0))
    wide = bool(len(step)) and int(step.max()) >> 32 > 0
    return bytes([wide]) + step.astype("<u8" if wide else "<u4").tobytes()


def _unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, "<u8" if raw[0] else "<u4", offset=1).astype(np.uint64), dtype=np.uint64)


def _pack_counts(counts: np.ndarray) -> bytes:
    """One byte for counts under 255, four more for others."""
    large = counts >= 255
    return np.uint32(large.sum()).tobytes() + counts[large].astype("<u4").tobytes() + np.where(large, 255, counts).astype(np.uint8).tobytes()


def _unpack_counts(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    out = np.frombuffer(raw, np.uint8, offset=4 + 4 * n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<u4", n, 4)
    return out


def _texts(batch: pa.RecordBatch | pa.Table, k: int) -> tk.Texts:
    return tk.Texts(np.frombuffer(batch["data"][k].as_py(), np.uint8), np.frombuffer(batch["offsets"][k].as_py(), "<i8"))


def _send(fragments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                token, first = tokens_of(_texts(batch, k))
                fold, block = batch["fold"][k].as_py(), batch["block"][k].as_py()
                for rank in range(1, ORDER + 1):
                    place, bits = np.sort(_places(grams(token, first, rank), fragments, rank)), KEY_BITS[rank]
                    start = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
                    count = np.diff(np.append(start, len(place)))
                    place = place[start]
                    edge = np.searchsorted(place, np.arange(fragments + 1, dtype=np.uint64) << np.uint64(bits))
                    key = place & np.uint64((1 << bits) - 1)
                    some = np.flatnonzero(np.diff(edge)).tolist()
                    yield pa.record_batch({
                        "part": pa.array(some, pa.int32()), "rank": pa.array([rank] * len(some), pa.int32()),
                        "block": pa.array([block] * len(some), pa.int64()), "fold": pa.array([fold] * len(some), pa.int32()),
                        "keys": pa.array([_pack_keys(key[edge[f] : edge[f + 1]]) for f in some], pa.binary()),
                        "counts": pa.array([None if fold == HELD_OUT_FOLD else _pack_counts(count[edge[f] : edge[f + 1]]) for f in some], pa.binary()),
                    })

    return run


def _add_up(group: pa.Table) -> pa.Table:
    """One fragment and rank: answers to each block; and as block -1, for words, their numbers (tokens, types; with and without DEV)."""
    part, rank = group["part"][0].as_py(), group["rank"][0].as_py()
    fold, block = group["fold"].to_pylist(), group["block"].to_pylist()
    keys = [_unpack_keys(x.as_py()) for x in group["keys"]]
    counts = [np.zeros(len(k), np.int64) if not x.is_valid else _unpack_counts(x.as_py()) for k, x in zip(keys, group["counts"])]
    del group
    edge = np.append(0, np.cumsum([len(k) for k in keys]))
    key, count = np.concatenate(keys), np.concatenate(counts)
    trained = np.repeat(np.asarray(fold) == TRAIN_FOLD, np.diff(edge))
    order = np.argsort(key)
    run = np.cumsum(np.append(False, key[order][1:] != key[order][:-1]))
    total = np.bincount(run, count[order]).astype(np.int64)
    less = np.bincount(run, np.where(trained, count, 0)[order]).astype(np.int64)
    of = np.empty(len(key), np.int64)
    of[order] = run
    whole, deleted = total[of], less[of]
    rows = [(b, part, rank, _pack_counts(whole[edge[k] : edge[k + 1]]), _pack_counts(deleted[edge[k] : edge[k + 1]]) if fold[k] == DEV_FOLD else None) for k, b in enumerate(block)]
    if rank == 1:
        numbers = np.asarray([total.sum(), (total > 0).sum(), less.sum(), (less > 0).sum()], "<i8")
        rows.append((-1, part, 0, numbers.tobytes(), None))
    columns = list(zip(*rows))
    return pa.table({"block": pa.array(columns[0], pa.int64()), "part": pa.array(columns[1], pa.int32()), "rank": pa.array(columns[2], pa.int32()), "whole": pa.array(columns[3], pa.binary()), "deleted": pa.array(columns[4], pa.binary())})


def _counted(texts: tk.Texts, answers: pa.Table, column: str, fragments: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Counts of every token's n-grams of each rank, and the first token of each document."""
    token, first = tokens_of(texts)
    rank, part = answers["rank"].to_numpy(), answers["part"].to_numpy()
    out = []
    for r in range(1, ORDER + 1):
        at = np.flatnonzero(rank == r)
        at = at[np.argsort(part[at])]
        known = np.concatenate([_unpack_counts(answers[column][k].as_py()) for k in at.tolist()])
        place = _places(grams(token, first, r), fragments, r)
        order = np.argsort(place)
        run = np.cumsum(np.append(False, place[order][1:] != place[order][:-1]))
        count = np.empty(len(place), np.int64)
        count[order] = known[run]
        out.append(count)
    return out, first


def _estimates(counts: list[np.ndarray], first: np.ndarray, tokens: int, types: int, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each token, and its estimates (uniform, then order 1 up) as columns."""
    begin = np.zeros(len(counts[0]), bool)
    begin[first[:-1]] = True
    out = [np.full(len(begin), 1 / (types + 1)), counts[0] / max(tokens, 1)]
    bucket = np.zeros(len(begin), np.int64)
    for k in range(1, ORDER):
        context = np.append(0, counts[k - 1][:-1])
        context[begin] = docs
        if k == 2:  # the token after the first has BEGIN and the first as its context: a gram of rank 2 at its place
            context[begin] = docs
        out.append(np.where(context > 0, counts[k] / np.maximum(context, 1), 0))
        bucket = bucket * LEVELS + np.minimum(np.frexp(context.astype(float))[1], LEVELS - 1)
    return bucket, np.stack(out, 1)


def _evidence(fragments: int, tokens: int, types: int, docs: int):
    """Histogram of a block's tokens over bucket and estimates in powers of two."""

    def run(key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows or not answers.num_rows:
            return pa.table({"cell": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        counts, first = _counted(_texts(block, 0), answers, "deleted", fragments)
        bucket, p = _estimates(counts, first, tokens, types, docs)
        cell = bucket
        for k in range(1, ORDER + 1):
            level = np.where(p[:, k] > 0, 1 + np.clip(np.rint(-np.log2(np.maximum(p[:, k], 1e-300))), 0, 62), 0).astype(np.int64)
            cell = cell * 64 + level
        value, n = np.unique(cell, return_counts=True)
        return pa.table({"cell": pa.array(value), "n": pa.array(n.astype(np.int64))})

    return run


def _of_cells(cell: np.ndarray, types: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and estimates of each cell."""
    p, rest = [np.full(len(cell), 1 / (types + 1))], cell.copy()
    for _ in range(ORDER):
        level = rest % 64
        p.insert(1, np.where(level > 0, 0.5 ** (level - 1.0), 0))
        rest //= 64
    return rest, np.stack(p, 1)


def _expected(cell: np.ndarray, n: np.ndarray, types: int, weight: np.ndarray) -> np.ndarray:
    """What of each bucket's tokens falls to each estimate."""
    bucket, p = _of_cells(cell, types)
    share = weight[bucket] * p
    share *= (n / share.sum(1))[:, None]
    return np.stack([np.bincount(bucket, share[:, k], len(weight)) for k in range(ORDER + 1)], 1)


def learn(cell: np.ndarray, n: np.ndarray, types: int) -> np.ndarray:
    """Weights (bucket, estimate) by expectation-maximisation; buckets without evidence share what all tokens say."""
    return _maximised(lambda weight: _expected(cell, n, types, weight), len(cell) > 0)


def learn_from(cells: DataFrame, types: int) -> np.ndarray:
    """The same from a table (cell, n) of any size: each round sums within tasks, then over the tasks' few rows."""

    def expected(weight: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(weight)
            for batch in batches:
                total += _expected(np.asarray(batch.column("cell")), np.asarray(batch.column("n")).astype(float), types, weight)
            some = np.flatnonzero(total.sum(1))
            yield pa.record_batch({"bucket": pa.array(some)} | {f"w{k}": pa.array(total[some, k]) for k in range(ORDER + 1)})

        columns = [f"w{k}" for k in range(ORDER + 1)]
        rows = cells.mapInArrow(run, ", ".join(["bucket long", *(f"{c} double" for c in columns)])).groupBy("bucket").agg(*(F.sum(c).alias(c) for c in columns)).toPandas()  # a row for each bucket
        out = np.zeros_like(weight)
        out[rows["bucket"].to_numpy(np.int64)] = rows[columns].to_numpy(float)
        return out

    return _maximised(expected, not cells.isEmpty())


def _maximised(expected: Callable[[np.ndarray], np.ndarray], evidence: bool) -> np.ndarray:
    buckets = LEVELS ** (ORDER - 1)
    weight = np.full((buckets, ORDER + 1), 1 / (ORDER + 1))
    for _ in range(ROUNDS if evidence else 0):
        weight = expected(weight)
        seen = weight.sum(1)
        prior = weight.sum(0) / max(weight.sum(), 1)
        weight = (weight + 5 * prior) / (seen + 5)[:, None]
    weight = np.maximum(weight, LEAST_WEIGHT)
    bucket = np.arange(buckets)
    for k in range(1, ORDER):  # an estimate with an unseen context has no weight
        level = bucket // LEVELS ** (ORDER - 1 - k) % LEVELS
        weight[level == 0, k + 1] = 0
    return weight / weight.sum(1, keepdims=True)


def _score(fragments: int, tokens: int, types: int, docs: int, weight: np.ndarray):
    def run(key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
        names = [f.split()[0] for f in RESULT.split(", ")]
        if not block.num_rows or not answers.num_rows:
            return pa.table({c: pa.array([], t) for c, t in zip(names, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))})
        counts, first = _counted(_texts(block, 0), answers, "whole", fragments)
        bucket, p = _estimates(counts, first, tokens, types, docs)
        likely = np.log10((weight[bucket] * p).sum(1))
        base = np.log10((counts[0] + 1) / (tokens + types + 1))
        ids, start = np.frombuffer(block["ids"][0].as_py(), "<i8"), first[:-1]
        known = np.add.reduceat((counts[0] > 0).astype(np.int64), start)
        return pa.table({
            "doc_id": pa.array(ids), "held_out": pa.array(np.full(len(ids), block["fold"][0].as_py() == HELD_OUT_FOLD)), "n_tokens": pa.array(np.diff(first).astype(np.int64)), "n_known": pa.array(known),
            "train_tokens": pa.array(np.full(len(ids), tokens, np.int64)), "base_score": pa.array(np.add.reduceat(base, start)), "score": pa.array(np.add.reduceat(likely, start)),
        })

    return run


def lm_scores(docs: DataFrame) -> DataFrame:
    """Columns as in RESULT, for every document."""
    fragments = min(parts(docs.sparkSession), 60_000)
    blocks = written(blocks_of(docs), "blocks")
    sent = blocks.mapInArrow(_send(fragments), SENT)
    answers = written(sent.groupBy("part", "rank").applyInArrow(_add_up, ANSWERS), "answers")
    numbers = np.zeros(4, np.int64)
    for row in answers.where("block = -1").select("whole").collect():  # one row for each fragment
        numbers += np.frombuffer(bytes(row.whole), "<i8")
    tokens, types, less_tokens, less_types = numbers.tolist()
    held = {r.fold: r.n for r in blocks.groupBy("fold").agg(F.sum(F.octet_length("ids") / 8).cast("long").alias("n")).collect()}
    n_train = held.get(TRAIN_FOLD, 0)
    dev = blocks.where(F.col("fold") == DEV_FOLD).groupBy("block").cogroup(answers.where("deleted is not null").groupBy("block"))
    cells = written(dev.applyInArrow(_evidence(fragments, less_tokens, less_types, n_train), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), "cells")
    if cells.count() > CELLS:
        weight = learn_from(cells, less_types)
    else:
        few = cells.toPandas()
        weight = learn(few["cell"].to_numpy(np.int64), few["n"].to_numpy(float), less_types)
    if not tokens:
        weight = np.eye(1, ORDER + 1).repeat(len(weight), 0)
    scored = blocks.groupBy("block").cogroup(answers.where("block >= 0").select("block", "part", "rank", "whole").groupBy("block"))
    out = scored.applyInArrow(_score(fragments, tokens, types, n_train + held.get(DEV_FOLD, 0), weight), RESULT)
    return out.withColumn("doc_id", key_back(F.col("doc_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
