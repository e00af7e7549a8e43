"""N-gram Jaccard join by vertical partitioning.

The shingles of all documents have one global order: by document frequency
(in powers of two, once for single ones), then by code. That order is cut into
vertical fragments by hash range. Every document is split among the fragments;
each counts frequencies on its own and drops shingles that only one text has.
Candidate pairs come from the rarest shingles of each document (the prefix that
a pair of the wanted similarity must share); their partial overlaps are counted
in each fragment separately and summed per pair, and the sum decides exactly.

Texts with equal shingle sets are one class from the first fragment on. In a
posting list, all members are first compared with one leader, the text with the
smallest share of shingles of its own, so a group of near copies costs one pair
for each member. What the leaders have connected needs no further links. Of the
lists that still hold several components, short ones are joined across
components; where the long ones make more work than in proportion to the input,
their members are indexed anew by what tells them from their leader
(`_by_difference`), where the common core of a group is in no list, and the
round starts again. No list is capped, and no link between components is lost;
rounds end when the work is in proportion, or no longer falls by half.

Blocks of numbers, not rows, travel in the first two shuffles, and each group
is bounded by the number of fragments, which follows the session's shuffle
partitions. Shingles are compared by 64-bit hashes.

Cases: texts of less than five words are one shingle; null or wordless texts
have none, are linked with nothing and are their own component; repeated rows
are copies of one another; null ids take part, and give a component id only to
what has no other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm import textkit as tk
from ledgerloom.llm.components import components
from ledgerloom.llm.runtime import NULL_KEY, documents, fresh, key_back, parts, table, written

WORDS = 5
PERCENT = 80
#: Vertical fragments in which the overlaps of candidate pairs are counted.
OVERLAP_FRAGMENTS = 4
BLOCK_BYTES = 1 << 20

#: Rows of numbers: a block of one kind for one fragment or bucket.
PACKED = "part int, kind int, a binary, b binary, c binary"
ENTRIES, MEMBERS, SIZES = range(3)


def shingle_sets(texts: tk.Texts, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles sorted by document and hash: (hash, document), and size and set hash of each document."""
    words = tk.words_of(texts)
    hashes = tk.word_hashes(texts, words)
    count = np.diff(words.first)
    gram = tk.gram_hashes(hashes, n)
    inside = words.doc[: len(gram)] == words.doc[n - 1 :] if len(gram) else np.zeros(0, bool)
    short = np.flatnonzero((count > 0) & (count < n))
    whole = tk.sequence_hash(hashes, words.first)
    value = np.concatenate([gram[inside], whole[short]])
    doc = np.concatenate([words.doc[: len(gram)][inside], short]).astype(np.uint16)
    order = np.argsort(value)
    order = order[np.argsort(doc[order], kind="stable")]
    value, doc = value[order], doc[order]
    if len(value):
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
        value, doc = value[new], doc[new]
    size = np.bincount(doc, minlength=len(texts))
    total = np.zeros(len(texts), np.uint64)
    np.add.at(total, doc, tk.mix(value ^ np.uint64(0x5851F42D4C957F2D)))
    with np.errstate(over="ignore"):
        return value, doc, size, tk.mix(total + size.astype(np.uint64))


def _fragment(value: np.ndarray, fragments: int) -> np.ndarray:
    return ((value >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.uint16)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    part, kind, a, b, c = zip(*rows) if rows else ([],) * 5
    return pa.record_batch({"part": pa.array(part, pa.int32()), "kind": pa.array(kind, pa.int32()), "a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "c": pa.array(c, pa.binary())})


def _split(fragments: int):
    """Documents to blocks: entries (set hashes, counts, shingles) by fragment; members (ids, set hashes, sizes); sizes (set hashes, sizes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) * 7
        for batch in batches:
            ids = np.asarray(batch.column("doc_id").fill_null(NULL_KEY))
            for first, end, texts in tk.blocks(tk.texts_of(batch.column("text")), BLOCK_BYTES):
                for at in range(0, len(texts), 1 << 15):
                    stop = min(len(texts), at + (1 << 15))
                    offsets = texts.offsets[at : stop + 1]
                    own = tk.Texts(texts.data[offsets[0] : offsets[-1]], offsets - offsets[0])
                    yield _rows(_block_rows(own, ids[first + at : first + stop], number, fragments))
                    number += 1

    return run


def _block_rows(texts: tk.Texts, ids: np.ndarray, number: int, fragments: int) -> list[tuple]:
    value, doc, size, klass = shingle_sets(texts)
    rows = [(number % fragments, MEMBERS, ids.tobytes(), klass.tobytes(), size.astype("<i4").tobytes())]
    _, one = np.unique(klass, return_index=True)
    one = np.sort(one[size[one] > 0])
    if not len(one):
        return rows
    rows.append((number % fragments, SIZES, klass[one].tobytes(), size[one].astype("<i4").tobytes(), None))
    model = np.zeros(len(texts), bool)
    model[one] = True
    keep = model[doc]
    value, doc = value[keep], doc[keep]
    part = _fragment(value, fragments)
    order = np.argsort(part, kind="stable")
    value, doc, part = value[order], doc[order], part[order]
    edge = np.searchsorted(part, np.arange(fragments + 1))
    new = np.ones(len(value), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(value))).astype("<u4")
    place = np.searchsorted(start, edge)
    for f in range(fragments):
        if edge[f] < edge[f + 1]:
            own = start[place[f] : place[f + 1]]
            rows.append((f, ENTRIES, klass[doc[own]].tobytes(), count[place[f] : place[f + 1]].tobytes(), value[edge[f] : edge[f + 1]].tobytes()))
    return rows


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), kind)


def _regrouped(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by bucket of the class, and the edges of the buckets."""
    bucket = (key % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _count_fragment(buckets: int):
    """One fragment: keeps shingles of two classes or more as codes with their frequency, dealt by class."""

    def run(group: pa.Table) -> pa.Table:
        fragment, kind = group["part"][0].as_py(), group["kind"].to_numpy()
        rows: list[tuple] = []
        for k in np.flatnonzero(kind == MEMBERS).tolist():
            rows.append((int(fragment * 31 + k) % buckets, MEMBERS, *(group[c][k].as_py() for c in "abc")))
        sizes = group.filter(pa.array(kind == SIZES))
        if sizes.num_rows:
            key, first = np.unique(_joined(sizes["a"], "<u8"), return_index=True)
            size = _joined(sizes["b"], "<i4")[first]
            order, edge = _regrouped(key, buckets)
            rows += [(b, SIZES, key[o].tobytes(), size[o].tobytes(), None) for b in range(buckets) if len(o := order[edge[b] : edge[b + 1]])]
        entries = group.filter(pa.array(kind == ENTRIES))
        if entries.num_rows:
            key, count, value = _joined(entries["a"], "<u8"), _joined(entries["b"], "<u4").astype(np.int64), _joined(entries["c"], "<u8")
            del group, entries
            _, first = np.unique(key, return_index=True)  # equal sets from other blocks say nothing new
            start = np.cumsum(count) - count
            value = value[tk.ranges(start[first], count[first])]
            owner = np.repeat(np.arange(len(first), dtype=np.int32), count[first])
            key = key[first]
            order = np.argsort(value)
            value, owner = value[order], owner[order]
            new = np.ones(len(value), bool)
            new[1:] = value[1:] != value[:-1]
            run_start = np.flatnonzero(new)
            times = np.diff(np.append(run_start, len(value)))
            shared = np.flatnonzero(times > 1)
            code = np.repeat(np.arange(len(shared), dtype="<u4"), times[shared])
            level = np.repeat(np.log2(times[shared]).astype(np.uint8), times[shared])
            owner = owner[tk.ranges(run_start[shared], times[shared])]
            order = np.argsort(owner, kind="stable")
            code, level, owner = code[order], level[order], owner[order]
            start = np.searchsorted(owner, np.arange(len(key) + 1))
            count = np.diff(start)
            some = np.flatnonzero(count)
            order, edge = _regrouped(key[some], buckets)
            for b in range(buckets):
                own = some[order[edge[b] : edge[b + 1]]]
                if len(own):
                    at = tk.ranges(start[own], count[own])
                    body = np.concatenate([np.frombuffer(code[at].tobytes(), np.uint8), level[at]])
                    head = np.concatenate([np.asarray([fragment], "<u4"), count[own].astype("<u4")])
                    rows.append((b, ENTRIES, key[own].tobytes(), head.tobytes(), body.tobytes()))
        return pa.Table.from_batches([_rows(rows)])

    return run


SETS = "kind int, doc_id long, class long, n int, m int, prefix array<long>, codes array<long>"


def _gather(group: pa.Table) -> pa.Table:
    """One bucket of classes: members as rows; of each class that can have a link, its shared codes in order and its prefix."""
    kind = group["kind"].to_numpy()
    out = {"kind": [], "doc_id": [], "class": [], "n": [], "m": []}
    members = group.filter(pa.array(kind == MEMBERS))
    n_members = 0
    if members.num_rows:
        ids, klass, size = _joined(members["a"], "<i8"), _joined(members["b"], "<i8"), _joined(members["c"], "<i4")
        n_members = len(ids)
        out = {"kind": [np.full(n_members, MEMBERS)], "doc_id": [ids], "class": [klass], "n": [size], "m": [np.zeros(n_members, np.int64)]}
    prefix, codes = [[0] * (n_members + 1)], [[0] * (n_members + 1)]
    prefix_values, code_values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    sizes, entries = group.filter(pa.array(kind == SIZES)), group.filter(pa.array(kind == ENTRIES))
    if sizes.num_rows and entries.num_rows:
        key, first = np.unique(_joined(sizes["a"], "<u8"), return_index=True)
        n = _joined(sizes["b"], "<i4")[first].astype(np.int64)
        owner, code, level = [], [], []
        for a, b, c in zip(entries["a"], entries["b"], entries["c"]):
            head = np.frombuffer(b.as_py(), "<u4")
            count = head[1:].astype(np.int64)
            total = int(count.sum())
            body = c.as_py()
            owner.append(np.repeat(np.searchsorted(key, np.frombuffer(a.as_py(), "<u8")), count))
            code.append((int(head[0]) << 32) + np.frombuffer(body, "<u4", total).astype(np.int64))
            level.append(np.frombuffer(body, np.uint8, total, 4 * total))
        owner, code, level = np.concatenate(owner), np.concatenate(code), np.concatenate(level)
        m = np.bincount(owner, minlength=len(key))
        able = 100 * m >= PERCENT * n
        keep = able[owner]
        owner, code, level = owner[keep], code[keep], level[keep]
        order = np.lexsort((code, level, owner))
        owner, code = owner[order], code[order]
        able = np.flatnonzero(able)
        start = np.searchsorted(owner, able)
        length = n[able] - -(-PERCENT * n[able] // 100) + 1 - (n[able] - m[able])
        out = {k: v + [x] for (k, v), x in zip(out.items(), (np.full(len(able), SIZES), np.full(len(able), NULL_KEY), key[able].view(np.int64), n[able], m[able]))}
        prefix.append((np.cumsum(length)).tolist())
        prefix_values.append(code[tk.ranges(start, length)])
        codes.append(np.cumsum(m[able]).tolist())
        code_values.append(code)
    lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(np.concatenate(offsets), pa.int32()), pa.array(np.concatenate(values), pa.int64()))
    whole = lambda name, kind: pa.array(np.concatenate(out[name]) if out[name] else np.zeros(0), kind)
    return pa.table({"kind": whole("kind", pa.int32()), "doc_id": whole("doc_id", pa.int64()), "class": whole("class", pa.int64()), "n": whole("n", pa.int32()), "m": whole("m", pa.int32()), "prefix": lists(prefix, prefix_values), "codes": lists(codes, code_values)})


#: Up to so many names of classes go to every task, so that only their sets are moved.
FEW = 500_000


def _named(sets: DataFrame, names: DataFrame, count: int | None = None) -> DataFrame:
    """The sets of the classes that a written table names (so often), told apart before any set is moved; all sets where it names too many for that."""
    if (names.count() if count is None else count) > FEW:
        return sets
    return sets.join(F.broadcast(names), "class", "left_semi")


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b, na, nb), a written table, whose overlap, summed over the vertical fragments, is enough."""
    count = 2 * pairs.count()
    own = _named(sets, pairs.select(F.explode(F.array("a", "b")).alias("class")), count)
    pieces = own.select("class", F.explode(F.sequence(F.lit(0), F.lit(OVERLAP_FRAGMENTS - 1))).alias("v"), "codes")
    pieces = pieces.select("class", "v", F.expr(f"filter(codes, c -> pmod(shiftright(c, 32), {OVERLAP_FRAGMENTS}) = v)").alias("own")).where("size(own) > 0")
    # few pairs go to the sets, which then move once less
    one = (F.broadcast(pairs) if count <= FEW else pairs).join(pieces.withColumnRenamed("class", "b"), "b")
    two = one.withColumnRenamed("own", "left").join(pieces.withColumnRenamed("class", "a"), ["a", "v"])
    partial = two.select("a", "b", "na", "nb", F.size(F.array_intersect("left", "own")).cast("long").alias("partial"))
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("partial").alias("overlap"))
    return total.where(F.col("overlap") * 100 >= (F.col("na") + F.col("nb") - F.col("overlap")) * PERCENT).select("a", "b", "overlap")


#: Open posting lists of more members than this may be indexed anew by differences; in shorter ones all pairs are looked at.
SHORT = 16

#: A place in a list: p elements of a set of s come before it. Pairs that differ in few enough elements (in all, the same
#: as a large enough overlap) must have enough in common from their first common element on.
_ABLE = f"2 * (100 + {PERCENT}) * least(sa - pa, sb - pb) >= (100 + {PERCENT}) * (sa + sb) - (100 - {PERCENT}) * (na + nb)"


def _side(lists: DataFrame, x: str, *more: str) -> DataFrame:
    return lists.select("code", F.col("class").alias(x), *(F.col(c).alias(f"{c}{x}") for c in ("n", "s", "p", *more)))


def _by_difference(clusters: DataFrame, sets: DataFrame) -> DataFrame:
    """Lists of the classes of each cluster (leader, class; a written table) by what tells them from the leader's set.

    Sets that link differ in at most (100 - PERCENT) / (100 + PERCENT) of their
    sizes. What x and y both have or both lack, seen from the leader, is no
    difference; so the common core of a group of near copies is in no list.
    By size and triangle inequality a link of y that doesn't follow from both
    being linked to the leader has a common element among the first
    n (100 - PERCENT) / PERCENT + 1 differences of y, rarest first.
    """
    leaders = _named(sets, clusters.select(F.col("leader").alias("class")).distinct()).select(F.col("class").alias("leader"), F.col("codes").alias("core"), F.col("n").alias("nl"), F.col("m").alias("ml"))
    most = F.floor(F.col("n") * (100 - PERCENT) / PERCENT)
    both = clusters.join(_named(sets, clusters.select("class")).select("class", "n", "m", "codes"), "class").join(leaders, "leader")
    extra, missing = F.array_except("codes", "core"), F.array_except("core", "codes")
    told = both.select("leader", "class", "n", "m", (F.size(extra) + F.size(missing) + F.col("n") - F.col("m") + F.col("nl") - F.col("ml")).alias("s"), F.concat(extra, missing).alias("d"))
    rows = written(told.select("leader", "class", "n", "m", "s", F.explode("d").alias("d")), "differences")
    times = rows.groupBy("leader", "d").agg(F.count("*").alias("times"))
    place = F.row_number().over(Window.partitionBy("leader", "class").orderBy("times", "d")) + F.col("n") - F.col("m") - 1
    ordered = rows.join(times, ["leader", "d"]).withColumn("p", place).where((F.col("p") <= most) & (F.col("times") > 1))
    return ordered.select(F.struct("leader", "d").alias("code"), "class", "n", "m", "s", "p")


def join(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, classes): members are (doc_id, class, n), every row of the documents; classes (class, label) hold what is linked."""
    spark = docs.sparkSession
    fragments = min(parts(spark), 60_000)
    split = documents(docs).mapInArrow(_split(fragments), PACKED)
    counted = split.groupBy("part").applyInArrow(_count_fragment(fragments), PACKED)
    gathered = written(counted.groupBy("part").applyInArrow(_gather, SETS), "sets")
    members = gathered.where(F.col("kind") == MEMBERS).select("doc_id", "class", "n")
    sets = gathered.where(F.col("kind") == SIZES)
    lists = sets.select("class", "n", "m", F.posexplode("prefix").alias("i", "code")).select("code", "class", "n", "m", F.col("n").alias("s"), (F.col("n") - F.col("m") + F.col("i")).alias("p"))
    postings = sets.agg(F.sum(F.size("prefix"))).first()[0] or 0
    links = labels = tested = work = None
    while True:
        # the leader is a text of few shingles of its own, or, among those indexed by difference, of few differences
        rank = F.struct((F.col("m") / F.col("n") if work is None else -F.col("s") / F.col("n")).alias("near"), F.col("class"), F.col("n"), F.col("s"), F.col("p"))
        leaders = lists.groupBy("code").agg(F.max(rank).alias("leader"), F.count("*").alias("times")).where("times > 1")
        star = leaders.select("code", *(F.col(f"leader.{c}").alias(d) for c, d in (("class", "a"), ("n", "na"), ("s", "sa"), ("p", "pa")))).join(_side(lists, "b"), "code")
        star = star.where(f"a <> b and {_ABLE}").select("a", "b", "na", "nb").dropDuplicates(["a", "b"])
        if tested is not None:
            star = _new(star, labels, tested)
        star = written(star, "pairs")
        found = written(_overlaps(star, sets), "links")
        links = found if links is None else links.unionByName(found)
        tested = star.select("a", "b") if tested is None else tested.unionByName(star.select("a", "b"))
        labels = components(links).withColumnRenamed("node", "class")
        marked = lists.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
        open_ = marked.groupBy("code").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("times"), F.max(rank).alias("leader"))
        open_ = open_.where("low <> high").select("code", "times", F.col("leader.class").alias("leader"))
        rest = written(marked.join(open_, "code"), "open")
        before, work = work, rest.where(F.col("times") > SHORT).agg(F.sum("times")).first()[0] or 0
        # not where comparing within the lists is in proportion to the postings, or one more index would not tell texts apart
        indexed = work > SHORT * postings and (before is None or 2 * work <= before)
        pairs = rest.where(F.col("times") <= SHORT) if indexed else rest
        across = _side(pairs, "a", "label").join(_side(pairs, "b", "label"), "code").where(f"labela < labelb and {_ABLE}").select("a", "b", "na", "nb").dropDuplicates(["a", "b"])
        across = written(_new(across, None, tested), "pairs")
        if not across.isEmpty():
            tested = tested.unionByName(across.select("a", "b"))
            found = written(_overlaps(across, sets), "links")
            if not found.isEmpty():
                links = links.unionByName(found)
                labels = components(links).withColumnRenamed("node", "class")
        if not indexed:
            return members, labels
        clusters = rest.where(F.col("times") > SHORT).select("leader", "class").where("leader <> class").distinct()
        lists = written(_by_difference(written(clusters, "clusters"), sets), "lists")


def _new(pairs: DataFrame, labels: DataFrame | None, tested: DataFrame) -> DataFrame:
    """The pairs that were not tested yet, in either order, and not connected by others."""
    if labels is not None:
        for end in "ab":
            pairs = pairs.join(labels.select(F.col("class").alias(end), F.col("label").alias(f"label{end}")), end, "left").withColumn(f"label{end}", F.coalesce(f"label{end}", end))
        pairs = pairs.where("labela <> labelb").drop("labela", "labelb")
    both = tested.unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.join(both, ["a", "b"], "left_anti")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, and class, which equal shingle sets share."""
    members, labels = join(docs)
    known = F.when(F.col("doc_id") != F.lit(NULL_KEY), F.col("doc_id"))
    classes = members.where("n > 0").groupBy("class").agg(F.min(known).alias("least"))
    classes = classes.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    least = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    of_class = classes.join(least, "label").select("class", "component_id")
    # wordless rows are one class of any size that needs no component: their own ids spread them over the tasks
    out = members.withColumn("class", F.when(F.col("n") > 0, F.col("class")).otherwise(F.col("doc_id"))).join(of_class, "class", "left")
    return out.select(
        key_back(F.col("doc_id")).alias("doc_id"),
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(key_back(F.col("doc_id"))).alias("component_id"),
        F.when(F.col("n") > 0, F.col("class")).alias("class"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("class")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component exactly one row stays, that with the least doc_id (one without id only if none has one).

    Rows are numbered first and told apart by their numbers, so repeated and
    null ids don't matter; rows without words all stay.
    """
    row = fresh(docs, "row")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text")).where("n_shingles > 0")
    ids = numbered.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("id"))
    told = ids.join(found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("of")), "row")
    best = told.groupBy("of").agg(F.min(F.struct(F.isnull("id"), F.col("id"), F.col("row"))).alias("best"), F.count("*").alias("rows")).where("rows > 1").select("of", F.col("best.row").alias("stays"))
    gone = told.join(best, "of").where("row <> stays").select(F.col("row").alias(row))
    return numbered.join(gone.hint("shuffle_hash"), row, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def _oracle(source: str) -> str:
    """Common table expressions that end in `near` (doc_id, n_shingles, component_id); WITH RECURSIVE."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
near_words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS w FROM {source}),
near_grams AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + {WORDS - 1}], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WORDS - 1}, 1) + 1)) AS i FROM near_words WHERE len(w) > 0)),
near_sizes AS (SELECT doc_id, count(*) AS n FROM near_grams GROUP BY doc_id),
near_both AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM near_grams a JOIN near_grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
near_links AS (SELECT a, b FROM near_both JOIN near_sizes x ON x.doc_id = a JOIN near_sizes y ON y.doc_id = b WHERE 100 * o >= {PERCENT} * (x.n + y.n - o)),
near_reach AS (SELECT a, b FROM near_links UNION SELECT r.a, l.b FROM near_reach r JOIN near_links l ON r.b = l.a),
near AS (
    SELECT d.doc_id, coalesce(max(s.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
    FROM {source} d LEFT JOIN near_sizes s USING (doc_id) LEFT JOIN near_reach r ON r.a = d.doc_id GROUP BY d.doc_id)"""


ORACLE = "WITH RECURSIVE " + _oracle("documents").strip() + "\nSELECT * FROM near"
