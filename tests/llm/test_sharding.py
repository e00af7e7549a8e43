import zlib
from collections import Counter

import pytest

from ledgerloom.llm import sharding
from tests.llm.common import awkward, documents


def check(rows, got, shards):
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    held = Counter(r.shard for r in got)
    counts = [held.get(s, 0) for s in range(shards)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    assert all(r.law == "rows" and r.grown_shard is None for r in got)


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_awkward_rows(spark, shards):
    check(awkward(), sharding.shard(documents(spark), shards, 8).collect(), shards)


def test_whole_table_is_balanced_and_mostly_at_home(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sharding.shard(docs).collect()
    check([(r.doc_id, r.text) for r in docs.collect()], got, 16)
    assert sum(r.shard == r.home_shard for r in got) > 0.8 * len(got)


def test_rows_and_order_do_not_change_the_result(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(docs).collect()}
    two = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(docs.orderBy("text").repartition(5)).collect()}
    assert one == two


def test_a_new_shard_moves_few_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one = {r.doc_id: r.shard for r in sharding.shard(docs, 16).collect()}
    two = {r.doc_id: r.shard for r in sharding.shard(docs, 17).collect()}
    assert sum(one[k] != two[k] for k in one) < 0.3 * len(one)


def test_walks_match_a_key_by_key_ring():
    points = sharding.ring(5, 4)
    counts = [(7 * i * i) % 11 for i in range(len(points))]
    room = sharding.bounds(sum(counts), 5)
    pieces = sharding.walks(counts, points, room)
    left, want = list(room), [[] for _ in counts]
    for arc, n in enumerate(counts):  # first the home shards
        k = min(n, left[points[arc][1]])
        left[points[arc][1]] -= k
        want[arc] += [points[arc][1]] * k
    for arc, n in enumerate(counts):  # then one key after the other, clockwise
        while len(want[arc]) < n:
            step = next(s for s in range(len(points)) if left[points[(arc + s) % len(points)][1]])
            left[points[(arc + step) % len(points)][1]] -= 1
            want[arc].append(points[(arc + step) % len(points)][1])
    assert [[s for a, b, s, _ in own for _ in range(b - a)] for own in pieces] == want


def test_empty(spark):
    assert sharding.shard(documents(spark, [])).count() == 0


@pytest.mark.parametrize("shards,virtual", [(5, 4), (16, sharding.VIRTUAL)])
def test_placement_of_rows_matches_a_key_by_key_ring(spark, shards, virtual):
    """Every row, not only the counts: arcs, order within an arc, overflow and slots, one key after the other."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    keyed = docs.select("doc_id", F.crc32(F.coalesce("text", F.lit(""))).alias("crc"), (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1).alias("size"), F.xxhash64(F.col("doc_id").cast("string"), F.lit(sharding.SEED)).alias("key"))
    rows = keyed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "crc", "size"), F.lit(sharding.SALTS)).cast("int")).collect()
    points = sharding.ring(shards, virtual)
    arcs = [[] for _ in points]
    for r in rows:
        arcs[next((k for k, (p, _) in enumerate(points) if p >= r.key), 0)].append(r)
    for own in arcs:
        own.sort(key=lambda r: (r.salt, r.key, r.doc_id))
    room, slot, want = sharding.bounds(len(rows), shards), [0] * shards, {}

    def put(r, shard):
        want[r.doc_id] = (shard, slot[shard])
        room[shard], slot[shard] = room[shard] - 1, slot[shard] + 1

    late = [[] for _ in points]
    for arc, own in enumerate(arcs):
        for r in own:
            put(r, points[arc][1]) if room[points[arc][1]] else late[arc].append(r)
    for arc, own in enumerate(late):
        for r in own:
            put(r, next(s for _, s in points[arc:] + points[:arc] if room[s]))
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(docs, shards, virtual).collect()}
    assert got == want
