"""Suffix-array dedup: bytes under any string of LENGTH bytes that starts twice in the corpus are removed.

Sharding. A repeated string of LENGTH bytes has the same smallest hashed GRAM-byte
gram at the same place in all its occurrences: its anchor. Anchors of all texts
are counted in fragments by hash; of the repeated ones every occurrence sends
its context (all strings of LENGTH bytes whose anchor it is) to the shard of
the anchor's hash. So equal strings always meet in one shard, and unrepeated text
never travels. Equal contexts are sent once, with their number.

Each shard builds a suffix array over its contexts by two-stage sorting: only
suffixes that are smaller than their successors are sorted directly; the others
follow by one scan over the buckets of first bytes. Neighbours in the array
whose common prefix, in bytes, reaches LENGTH are repeated strings; nothing else
decides. Contexts are cut to what they share with others before, and equal ones
(by bytes) enter the array twice, however often they occur.

Texts are grouped first: equal texts are one text with a count, so a group of
copies of any size costs one row per task. Hashes of 64 bits only route:
anchors to fragments, contexts to their places, and runs back to their texts
(with the length).

Cases: null and empty texts have no bytes; strings never cross documents, but
may repeat and overlap in one; repeated rows are copies of one another, null
ids stay null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import textkit as tk
from ledgerloom.llm.runtime import documents, over_batches, parts, table, written

LENGTH, GRAM = 200, 64
#: Grams in a string of LENGTH bytes.
SPREAD = LENGTH - GRAM + 1
#: Bytes of contexts that one suffix array takes, if no single anchor needs more.
SHARD_BYTES = 1 << 20

BLOB = "part int, a binary, b binary, c binary, d binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    part, *rest = zip(*rows) if rows else ([],) * 5
    return pa.record_batch({"part": pa.array(part, pa.int32())} | {n: pa.array(c, pa.binary()) for n, c in zip("abcd", rest)})


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column if x.is_valid), kind)


def _part(value: np.ndarray, fragments: int) -> np.ndarray:
    """Fragment of each hash; mixed again, as anchors have the smallest hashes of their strings."""
    value = tk.mix(value)
    return ((value >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.uint16)


def gram_hashes(prefix: np.ndarray) -> np.ndarray:
    at = np.arange(max(0, len(prefix) - GRAM))
    return tk.span_hash(prefix, at, at + GRAM)


def anchors(texts: tk.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all strings of LENGTH bytes: place, hash, and first and number of the strings (a run) whose anchor it is.

    Of equal hashes in a string the first is its anchor.
    """
    n = len(texts.data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = gram_hashes(tk.prefix_hash(texts.data))
    key = (value & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(value), dtype=np.uint64)
    pad = -len(key) % SPREAD
    rows = np.append(key, np.full(pad, np.iinfo(np.uint64).max)).reshape(-1, SPREAD)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    strings = len(key) - SPREAD + 1
    least = np.minimum(behind[:strings], ahead[SPREAD - 1 : SPREAD - 1 + strings])
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(texts.offsets))
    start = np.flatnonzero(doc[:strings] == doc[LENGTH - 1 :])
    place = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    run = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else start
    return place[run], value[place[run]], start[run], np.diff(np.append(run, len(place)))


def _pack(at: np.ndarray, left: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """An anchor's place, how far its first string begins before it, and the number of its strings, as one number."""
    return (at << 16 | left << 8 | (strings - 1)).astype("<i8")


def _send_anchors(fragments: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, number = [], np.asarray(batch.column("k"))
        for first, end, texts in tk.blocks(tk.texts_of(batch.column("text"))):
            at, value, low, strings = anchors(texts)
            doc = np.searchsorted(texts.offsets, at, "right") - 1
            part = _part(value, fragments)
            order = np.argsort(part, kind="stable")
            edge = np.searchsorted(part[order], np.arange(fragments + 1))
            owner = number[first:end][doc]
            place = _pack(at - texts.offsets[doc], at - low, strings)
            for f in np.flatnonzero(np.diff(edge)).tolist():
                own = order[edge[f] : edge[f + 1]]
                rows.append((f, value[own].tobytes(), owner[own].tobytes(), place[own].tobytes(), None))
        return _blobs(rows)

    return run


def _repeated(group: pa.Table) -> pa.Table:
    """The anchors (k, at) whose hash has two places or more."""
    value, owner, place = _joined(group["a"], "<u8"), _joined(group["b"], "<i8"), _joined(group["c"], "<i8")
    del group
    order = np.argsort(value)
    same = value[order][1:] == value[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    keep = order[twice]
    return pa.table({"k": pa.array(owner[keep]), "at": pa.array(place[keep])})


def _send_contexts(fragments: int):
    """Of each text with anchors: contexts (hash, anchor, left, length, number), their bytes, and where they stand."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, number, copies = [], np.asarray(batch.column("k")), np.asarray(batch.column("copies"))
        lists = batch.column("at")
        first_at, flat = np.asarray(lists.offsets), np.asarray(lists.values)
        for first, end, texts in tk.blocks(tk.texts_of(batch.column("text"))):
            count = np.diff(first_at[first : end + 1])
            doc = np.repeat(np.arange(end - first), count)
            pairs = np.unique(np.stack([doc, flat[first_at[first] : first_at[end]]], 1).astype(np.int64), axis=0)
            doc, local = pairs[:, 0], pairs[:, 1] >> 16
            low = local - (pairs[:, 1] >> 8 & 255)
            high = low + (pairs[:, 1] & 255) + LENGTH
            fits = high <= np.diff(texts.offsets)[doc]  # others came from a text with an equal hash
            doc, local, low, high = doc[fits], local[fits], low[fits], high[fits]
            base = texts.offsets[doc]
            prefix = tk.prefix_hash(texts.data)
            anchor = tk.span_hash(prefix, base + local, base + local + GRAM)
            with np.errstate(over="ignore"):
                context = tk.mix(tk.span_hash(prefix, base + low, base + high) + (local - low).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            _, one, place = np.unique(context, return_index=True, return_inverse=True)
            weight = np.bincount(place, np.minimum(copies[first:end][doc], 2), len(one)).astype("<u4")
            part = _part(anchor[one], fragments)
            order = np.argsort(part, kind="stable")
            edge = np.searchsorted(part[order], np.arange(fragments + 1))
            rank = np.empty(len(one), np.int64)
            rank[order] = np.arange(len(one))
            single = np.flatnonzero(copies[first:end][doc] == 1)  # copies go as a whole, wherever they match others
            single = single[np.argsort(rank[place[single]], kind="stable")]
            held = np.searchsorted(rank[place[single]], edge)
            for f in np.flatnonzero(np.diff(edge)).tolist():
                own = order[edge[f] : edge[f + 1]]
                c = one[own]
                head = np.stack([(local - low)[c], (high - low)[c], weight[own]], 1).astype("<u4")
                text = texts.data[tk.ranges((base + low)[c], (high - low)[c])]
                at = single[held[f] : held[f + 1]]
                where = np.stack([context[at].view(np.int64), number[first:end][doc[at]], low[at]], 1)
                rows.append((f, np.concatenate([context[c], anchor[c]]).tobytes(), head.tobytes(), text.tobytes(), where.astype("<i8").tobytes()))
        return _blobs(rows)

    return run


def sort_suffixes(data: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Suffix array of the suffixes that start at `wanted` (a mask), ordered by LENGTH bytes at least.

    A suffix is of type B if it is smaller than its successor, else of type A.
    Of each run of wanted places the first B at or after its end is sorted too,
    so that every wanted A suffix has its successor at hand.
    """
    n = len(data)
    text = np.concatenate([data, np.full(LENGTH + 16, 255, np.uint8)])
    # a suffix is compared with its successor where their bytes first differ
    differ = np.flatnonzero(text[1:] != text[:-1])
    following = np.searchsorted(differ, np.arange(n))
    smaller = np.ones(n, bool)
    inside = following < len(differ)
    at = differ[following[inside]]
    smaller[inside] = text[at] < text[at + 1]
    nearest = np.append(np.flatnonzero(smaller), n)
    last = np.flatnonzero(wanted & ~np.append(wanted[1:], False))
    stop = np.minimum(nearest[np.searchsorted(nearest, last)], n - 1)
    taken = wanted.copy()
    taken[tk.ranges(last, stop - last + 1)] = True

    direct = _sort_directly(text, np.flatnonzero(taken & smaller))
    byte = text[direct]
    edge = np.searchsorted(byte, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []
    larger = taken & ~smaller

    def induce(scanned: np.ndarray, c: int) -> np.ndarray:
        """Puts the A suffixes before the scanned ones into their buckets; gives those of this bucket."""
        before = scanned - 1
        before = before[before >= 0]
        before = before[larger[before]]
        head = text[before]
        order = np.argsort(head, kind="stable")
        before, head = before[order], head[order]
        cut = np.flatnonzero(np.append(True, head[1:] != head[:-1])) if len(head) else np.zeros(0, np.int64)
        own = np.zeros(0, np.int64)
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(head)]):
            if head[a] == c:
                own = before[a:b]
            else:
                induced[head[a]].append(before[a:b])
        return own

    for c in range(256):
        row = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        while len(row):
            out.append(row)
            row = induce(row, c)
        if edge[c] < edge[c + 1]:
            out.append(direct[edge[c] : edge[c + 1]])
            induce(out[-1], c)
    whole = np.concatenate(out) if out else np.zeros(0, np.int64)
    return whole[wanted[whole]]


def _sort_directly(text: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The places in the order of their suffixes: five bytes a round, in groups that tie so far.

    A group whose suffixes are all equal for LENGTH bytes is finished.
    """
    if not len(place):
        return place
    prefix = tk.prefix_hash(text)
    string = tk.span_hash(prefix, place, place + LENGTH)
    out = np.empty(len(place), np.int64)
    slot = np.arange(len(place))  # where in `out` the places still open go
    group = np.zeros(len(place), np.uint64)
    for depth in range(0, LENGTH + 5, 5):
        key = group << np.uint64(40)
        for k in range(5):
            key |= text[place + min(depth + k, LENGTH + 8)].astype(np.uint64) << np.uint64(8 * (4 - k))
        order = np.argsort(key)
        key, place, string = key[order], place[order], string[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(key)))
        changes = np.add.reduceat(np.append(False, string[1:] != string[:-1]) & ~new, start)
        done = np.repeat((size == 1) | (changes == 0), size)
        out[slot[done]] = place[done]
        still = ~done
        slot, place, string = slot[still], place[still], string[still]
        if not len(place):
            return out
        group = (np.cumsum(new)[still] - 1).astype(np.uint64)
        group = np.unique(group, return_inverse=True)[1].astype(np.uint64)
    out[slot] = place
    return out


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Common prefix of each suffix in the array with the one before it, up to `most`; the first has none."""
    n = len(data)
    text = np.concatenate([data, np.zeros(most + 16, np.uint8)])
    word = np.zeros(n + most + 8, np.uint64)  # the eight bytes from each place on
    for k in range(8):
        word = word << np.uint64(8) | text[k : k + len(word)]
    out = np.zeros(len(order), np.int64)
    a, b, at = order[1:], order[:-1], np.arange(1, len(order))
    for depth in range(0, most, 8):
        differ = word[a + depth] ^ word[b + depth]
        equal = differ == 0
        if not equal.all():
            rest = differ[~equal]
            alike = np.zeros(len(rest), np.int64)
            for k in range(1, 8):
                alike += rest >> np.uint64(64 - 8 * k) == 0
            out[at[~equal]] = depth + alike
            a, b, at = a[equal], b[equal], at[equal]
        if not len(a):
            break
    out[at] = most
    # what follows the end is no common byte
    out[1:] = np.minimum(out[1:], n - np.maximum(order[1:], order[:-1]))
    return np.minimum(out, most)


def repeated_strings(data: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Mask of the wanted places whose string of LENGTH bytes starts at another wanted place too: neighbours in the suffix array."""
    order = sort_suffixes(data, wanted)
    same = common_prefixes(data, order) >= LENGTH
    out = np.zeros(len(data), bool)
    out[order[same]] = True
    out[order[np.flatnonzero(same) - 1]] = True
    return out


def _equal_bytes(text: np.ndarray, one: np.ndarray, two: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether text[one:one + size] is text[two:two + size], a stretch of bounded size at a time."""
    out = np.ones(len(one), bool)
    total = np.cumsum(size)
    for own in np.split(np.arange(len(one)), np.flatnonzero(np.diff(total // SHARD_BYTES)) + 1):
        if len(own):
            same = text[tk.ranges(one[own], size[own])] == text[tk.ranges(two[own], size[own])]
            out[own] = np.logical_and.reduceat(same, np.cumsum(size[own]) - size[own])
    return out


def _reach(text: np.ndarray, anchor: np.ndarray, begin: np.ndarray, length: np.ndarray, step: int) -> np.ndarray:
    """How far each string text[begin], text[begin + step] ... is common with the best other one of its anchor.

    The strings of each anchor are sorted; the best is a neighbour.
    """
    n, width = len(anchor), max(1, int(length.max(initial=0)))
    best = np.zeros(n, np.int64)
    column = np.arange(width)
    rows = np.zeros((n, width), np.uint8)  # bytes are moved up by one, so that 0 only pads
    for a in range(0, n, 4096):
        inside = column < length[a : a + 4096, None]
        at = np.where(inside, begin[a : a + 4096, None] + step * column, 0)
        rows[a : a + 4096] = np.where(inside, text[at] + np.uint8(1), 0)
    order = np.argsort(rows.view(f"S{width}").ravel(), kind="stable")
    order = order[np.argsort(anchor[order], kind="stable")]
    for a in range(0, n - 1, 4096):
        one, two = order[a : a + 4096][: n - 1 - a], order[a + 1 : a + 4097]
        same = (rows[one] == rows[two]) & (rows[one] > 0)
        common = np.where(same.all(1), width, np.argmin(same, 1))
        common[anchor[one] != anchor[two]] = 0
        np.maximum.at(best, one, common)
        np.maximum.at(best, two, common)
    return best


def _hashes(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans, which lie in order, a stretch of text at a time."""
    out = np.zeros(len(begin), np.uint64)
    for own in np.split(np.arange(len(begin)), np.flatnonzero(np.diff(begin // SHARD_BYTES)) + 1):
        if len(own):
            base = begin[own[0]]
            out[own] = tk.span_hash(tk.prefix_hash(text[base : end[own].max()]), begin[own] - base, end[own] - base)
    return out


def _shard(group: pa.Table) -> pa.Table:
    """Intervals (k, first, end) of repeated strings around the anchors of one fragment.

    Contexts are first cut to what they share with any other one of their
    anchor, to the left and to the right; so those that are common only in
    their middle become equal, or too short, however many they are.
    """
    context, anchor = [], []
    for x in group["a"]:
        both = np.frombuffer(x.as_py(), "<u8")
        context.append(both[: len(both) // 2])
        anchor.append(both[len(both) // 2 :])
    context, anchor = np.concatenate(context), np.concatenate(anchor)
    head = _joined(group["b"], "<u4").reshape(-1, 3).astype(np.int64)
    text = _joined(group["c"], "u1")
    where = _joined(group["d"], "<i8").reshape(-1, 3)
    del group
    start = np.cumsum(head[:, 1]) - head[:, 1]
    name, one, place = np.unique(context, return_index=True, return_inverse=True)
    weight = np.bincount(place, head[:, 2]).astype(np.int64)
    order = np.argsort(one)  # as the contexts lie in the text
    name, one, weight = name[order], one[order], weight[order]
    anchor, left, length, start = np.unique(anchor[one], return_inverse=True)[1], head[one, 0], head[one, 1], start[one]
    right = length - left - GRAM
    reach_right = np.where(weight > 1, right, _reach(text, anchor, start + left + GRAM, right, 1))
    reach_left = np.where(weight > 1, left, _reach(text, anchor, start + left - 1, left, -1))
    low, high = left - reach_left, left + GRAM + reach_right
    long = np.flatnonzero(high - low >= LENGTH)
    anchor, name, weight, start, low, high, reach_left = (x[long] for x in (anchor, name, weight, start, low, high, reach_left))
    with np.errstate(over="ignore"):
        cut = tk.mix(_hashes(text, start + low, start + high) + anchor.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + reach_left.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, model, of = np.unique(cut, return_index=True, return_inverse=True)
    # equal hashes of other bytes are contexts of their own
    length = high - low
    other = np.flatnonzero((length != length[model][of]) | (anchor != anchor[model][of]))
    alike = np.setdiff1d(np.flatnonzero(model[of] != np.arange(len(of))), other)
    other = np.append(other, alike[~_equal_bytes(text, (start + low)[alike], (start + low)[model[of[alike]]], length[alike])])
    of[other] = len(model) + np.arange(len(other))
    model = np.append(model, other)
    times = np.bincount(of, weight, len(model)).astype(np.int64)
    # a context that stands once and alone with its anchor repeats nothing; all others go to the array, anchor by anchor, in shards of bounded size
    held = np.bincount(anchor[model], np.minimum(times, 2), int(anchor.max(initial=0)) + 1)
    sent = np.flatnonzero(held[anchor[model]] > 1)
    sent = sent[np.argsort(anchor[model[sent]], kind="stable")]
    first, end, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(sent):
        twice = np.minimum(times[sent], 2)
        size = (length[model[sent]] + 1) * twice
        shard = (np.cumsum(size) - size) // SHARD_BYTES
        begins = np.flatnonzero(np.append(True, np.diff(anchor[model[sent]]) > 0))
        shard = np.repeat(shard[begins], np.diff(np.append(begins, len(sent))))
        for own in np.split(np.arange(len(sent)), np.flatnonzero(np.diff(shard)) + 1):
            each = np.repeat(sent[own], twice[own])
            at, span = (start + low)[model[each]], length[model[each]]
            data = np.full(int((span + 1).sum()), 255, np.uint8)
            base = np.cumsum(span + 1) - span - 1
            data[tk.ranges(base, span)] = text[tk.ranges(at, span)]
            wanted = np.zeros(len(data), bool)
            wanted[tk.ranges(base, span - LENGTH + 1)] = True
            hit = np.flatnonzero(repeated_strings(data, wanted))
            c = np.searchsorted(base, hit, "right") - 1
            c, a, b = tk.union_length(each[c], hit - base[c], hit - base[c] + LENGTH)
            owner.append(c)
            first.append(a)
            end.append(b)
    # from each model to all contexts that are equal to it
    first, end, owner = np.concatenate(first), np.concatenate(end), np.concatenate(owner)
    by = np.argsort(owner, kind="stable")
    first, end, owner = first[by], end[by], owner[by]
    left, right = np.searchsorted(owner, of, "left"), np.searchsorted(owner, of, "right")
    at, owner = tk.ranges(left, right - left), np.repeat(np.arange(len(of)), right - left)
    first, end = low[owner] + first[at], low[owner] + end[at]
    # every place of a context has its intervals
    key = name[owner]
    order = np.argsort(key, kind="stable")
    key, first, end = key[order], first[order], end[order]
    stands = where[:, 0].view(np.uint64)
    low, high = np.searchsorted(key, stands, "left"), np.searchsorted(key, stands, "right")
    n = high - low
    at, k = tk.ranges(low, n), np.repeat(np.arange(len(where)), n)
    doc, a, b = tk.union_length(where[k, 1], where[k, 2] + first[at], where[k, 2] + end[at])
    return pa.table({"k": pa.array(doc, pa.int64()), "first": pa.array(a.astype(np.int32)), "end": pa.array(b.astype(np.int32))})


def _texts(docs: DataFrame) -> DataFrame:
    """Distinct texts: k, size, text, copies; text itself is the key, so they are told apart by their bytes."""
    own = documents(docs).select(F.xxhash64("text").alias("k"), F.octet_length("text").alias("size"), "text").where(f"size >= {LENGTH}")
    return own.groupBy("k", "size", "text").agg(F.count("*").alias("copies"))


def _anchored(texts: DataFrame, fragments: int) -> DataFrame:
    """Repeated anchors of the distinct texts: k and array of places."""
    sent = over_batches(texts.select("k", "size", "text", "copies"), _send_anchors(fragments), BLOB)
    return sent.groupBy("part").applyInArrow(_repeated, "k long, at long").groupBy("k").agg(F.collect_set("at").alias("at"))


def spans(docs: DataFrame) -> DataFrame:
    """k, text, copies and `runs`, an array of intervals to remove, of every distinct text of LENGTH bytes or more."""
    fragments = min(parts(docs.sparkSession), 60_000)
    texts = _texts(docs)
    found = texts.join(_anchored(texts, fragments).hint("shuffle_hash"), "k").select("k", "text", "copies", "at")
    sent = over_batches(found, _send_contexts(fragments), BLOB)
    runs = sent.groupBy("part").applyInArrow(_shard, "k long, first int, end int")
    runs = written(runs, "runs").groupBy("k").agg(F.collect_list(F.struct("first", "end")).alias("runs"))
    return texts.join(runs.hint("shuffle_hash"), "k", "left").select("k", "size", "text", "copies", "runs")


def _kept(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in runs:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def _cut(batch: pa.RecordBatch) -> list[list[tuple[int, int]]]:
    """The maximal runs to remove of each text."""
    size = pa.compute.binary_length(batch.column("text")).to_pylist()
    lists = batch.column("runs")
    first, end = (np.asarray(lists.values.field(n)) for n in ("first", "end"))
    offsets = np.asarray(lists.offsets)
    copies = np.asarray(batch.column("copies"))
    doc = np.repeat(np.arange(len(lists)), np.diff(offsets))
    doc, a, b = tk.union_length(doc, first[offsets[0] : offsets[-1]].astype(np.int64), end[offsets[0] : offsets[-1]].astype(np.int64))
    out: list[list[tuple[int, int]]] = [[] for _ in size]
    for d, x, y in zip(doc.tolist(), a.tolist(), b.tolist()):
        out[d].append((x, y))
    for d in np.flatnonzero(copies > 1).tolist():
        out[d] = [(0, size[d])]
    return out


def _digest(batch: pa.RecordBatch) -> pa.RecordBatch:
    removed, spans_, digest = [], [], []
    for text, runs in zip(batch.column("text"), _cut(batch)):
        removed.append(sum(b - a for a, b in runs))
        spans_.append(len(runs))
        digest.append(hashlib.sha256(_kept(text.as_buffer().to_pybytes(), runs)).hexdigest())
    return pa.record_batch({"k": batch.column("k"), "size": batch.column("size"), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans_, pa.int64()), "digest": pa.array(digest, pa.string())})


def removed_spans(docs: DataFrame) -> DataFrame:
    """doc_id and array `removed` of (first, end) in bytes, of every document; null where nothing is removed."""

    def runs(batch: pa.RecordBatch) -> pa.RecordBatch:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
        return pa.record_batch({"k": batch.column("k"), "removed": pa.array([[{"first": a, "end": b} for a, b in own] for own in _cut(batch)], kind)})

    found = over_batches(spans(docs), runs, "k long, removed array<struct<first: int, end: int>>").where("size(removed) > 0")
    return documents(docs).select("doc_id", F.xxhash64("text").alias("k")).join(found, "k", "left").drop("k")


def dedup(docs: DataFrame) -> DataFrame:
    """Columns as in RESULT, for every document."""
    done = over_batches(spans(docs), _digest, "k long, size int, n_removed long, n_spans long, digest string")
    rows = documents(docs).select("doc_id", F.xxhash64("text").alias("k"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("own"))
    out = rows.join(done, ["k", "size"], "left")
    return out.select(
        "doc_id",
        F.col("size").cast("long").alias("n_bytes"),
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("digest", "own").alias("kept_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH raw AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
win AS (SELECT doc_id, i, md5(hex(b[i:i + {LENGTH - 1}])) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - {LENGTH - 2})) AS i FROM raw WHERE octet_length(b) >= {LENGTH})),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1),
runs AS (
    SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS e
    FROM (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > {LENGTH}, true) AS fresh FROM twice))
    GROUP BY doc_id, run),
gaps AS (
    SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 1) AS a, a - 1 AS e FROM runs
    UNION ALL SELECT doc_id, max(e), 1000000000 FROM runs GROUP BY doc_id
    UNION ALL SELECT doc_id, 1, 1000000000 FROM raw WHERE doc_id NOT IN (SELECT doc_id FROM runs)),
kept AS (SELECT doc_id, string_agg(CASE WHEN a <= e THEN hex(b[a:e]) ELSE '' END, '' ORDER BY a, e) AS h FROM gaps JOIN raw USING (doc_id) GROUP BY doc_id),
gone AS (SELECT doc_id, sum(e - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(h)) AS kept_sha256
FROM raw JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
"""
