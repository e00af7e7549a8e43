import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import kernels as k
from ledgerloom.operators import neardup, retrieval as r

ITEM = "id string, tier string, vector array<double>"
QUERY = "query_id int, vector array<double>"


def candidates(spark, items, query=(1.0, 0.0)):
    return r.scored(spark.createDataFrame([(0, list(query))], QUERY), spark.createDataFrame(items, ITEM))


def test_plain_top_k_and_ties(spark):
    rows = [("tip", "tip", [1.0, 0.0]), ("skill", "skill", [0.6, 0.8]), ("b", "tip", [2.0, 0.0])]
    got = r.top_k(candidates(spark, rows), 3).orderBy("rank").collect()
    assert [(x.id, x.rank) for x in got] == [("b", 1), ("tip", 2), ("skill", 3)]
    assert got[2].similarity == pytest.approx(0.6)


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(1)
    queries = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(7)], QUERY)
    items = spark.createDataFrame([(f"i{i}", "tip", rng.normal(size=4).tolist()) for i in range(20)], ITEM)
    key = lambda df: sorted((x.query_id, x.id, round(x.similarity, 9)) for x in df.collect())
    one = key(r.scored(queries, items))
    monkeypatch.setattr(r, "QUERY_LIMIT", 2)
    assert key(r.scored(queries, items)) == one and len(one) == 140


def unit(v):
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v]


def greedy(pool, chosen, n, weight):
    chosen = list(chosen)
    for _ in range(n):
        rest = [c for c in pool if c[0] not in {x[0] for x in chosen}]
        if not rest:
            break
        near = lambda c: max((float(np.dot(c[2], x[2])) for x in chosen), default=0.0)
        chosen.append(min(rest, key=lambda c: (-(weight * c[1] - (1 - weight) * near(c)), -c[1], c[0])))
    return chosen


def test_mmr_matches_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(f"i{i:02}", "tip", rng.normal(size=6).tolist()) for i in range(25)]
    pool = candidates(spark, rows, rng.normal(size=6).tolist()).cache()
    plain = [(x.id, x.similarity, x.vector) for x in pool.collect()]
    want = [c[0] for c in greedy(plain, [], 8, 0.65)]
    for form in (r.mmr, r.mmr_rounds):
        got = form(pool.select("query_id", "id", "similarity", "vector"), 8, 0.65).orderBy("rank").collect()
        assert [x.id for x in got] == want
    assert r.mmr_rounds(pool, 99, 0.5).count() == 25


def test_tiered_case_by_hand(spark):
    rows = [("tip-1", "tip", [1.0, 0.0]), ("tip-2", "tip", [0.99, 0.1]), ("tip-3", "tip", [0.8, 0.6]), ("skill-1", "skill", [0.9, 0.4])]
    pool = candidates(spark, rows).select("query_id", "id", "similarity", "vector", "tier")
    for form in (r.tiered, r.tiered_rounds):
        got = form(pool, 3, {"tip": 2, "skill": 1}, {"tip": 0.3, "skill": 0.8}).orderBy("rank").collect()
        assert [x.id for x in got] == ["skill-1", "tip-1", "tip-3"]
        got = form(pool, 4, {"tip": 1, "skill": 1}).orderBy("rank").collect()
        assert [x.id for x in got][:2] == ["skill-1", "tip-1"] and len(got) == 4


@pytest.mark.parametrize("top", [1, 5, 25, 46, 50])
def test_quota_table_matches_the_function(spark, top):
    table = spark.createDataFrame(list(r.QUOTAS.items()), "tier string, quota int")
    assert {x.tier: x.scaled for x in r.scaled_quota_table(table, top).collect()} == r.scaled_quotas(r.QUOTAS, top)
    assert sum(r.scaled_quotas(r.QUOTAS, top).values()) == min(top, sum(r.QUOTAS.values()))


def test_vectors(spark):
    rows = [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0]), (5, None), (6, [float("inf"), 0.0])]
    got = spark.createDataFrame(rows, "id int, v array<double>").select("id", k.valid_vector(F.col("v"), 2).alias("ok")).collect()
    assert {x.id: x.ok for x in got} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}
    row = spark.range(1).select(k.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)), -1.0).alias("c"), k.cosine(F.array(F.lit(2.0)), F.array(F.lit(1.0))).alias("d")).first()
    assert (row.c, row.d) == (-1.0, 1.0)


def test_pairs_and_blocked_pairs(spark):
    rng = np.random.default_rng(7)
    rows = [(i, "a" if i % 2 else "b", rng.normal(size=3).tolist()) for i in range(40)]
    items = spark.createDataFrame(rows, "id long, tier string, vector array<double>")
    want = {(i, j) for i, _, v in rows for j, _, w in rows if i < j and np.dot(unit(v), unit(w)) >= 0.8}
    assert {(x.left_id, x.right_id) for x in neardup.near_pairs(items, 0.8, []).collect()} == want
    assert {(x.left_id, x.right_id) for x in neardup.near_pairs_blocked(items, 0.8, 3).collect()} == want
    tiers = {i: t for i, t, _ in rows}
    assert {(x.left_id, x.right_id) for x in neardup.near_pairs(items, 0.8, ["tier"]).collect()} == {p for p in want if tiers[p[0]] == tiers[p[1]]}


def test_pages(spark):
    items = spark.createDataFrame([(i, "t") for i in range(10)], "id int, tier string")
    page = neardup.rotating_page(items, "tier", F.lit(7), 4).orderBy("position")
    assert [x.id for x in page.collect()] == [8, 9, 0, 1]
    assert [x.id for x in neardup.rotating_page(items, "tier", F.lit(99), 3).orderBy("position").collect()] == [0, 1, 2]
    first = spark.createDataFrame([(9, 0), (5, 1)], "id int, position long")
    assert [x.id for x in neardup.priority_page(first, page, 4).orderBy("position").collect()] == [9, 5, 8, 0]


def test_cache_lookup_keeps_order_and_distinct_misses(spark):
    texts = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "b")], "pos int, text string")
    cache = texts.where("text = 'a'").select(F.sha2(F.concat(F.lit("r"), F.lit("\0"), "text"), 256).alias("cache_key"), F.array(F.lit(1.0)).alias("embedding")).limit(1)
    hits, misses = r.cache_lookup(texts, cache, "r")
    assert [(x.pos, x.embedding is not None) for x in hits.orderBy("pos").collect()] == [(0, True), (1, False), (2, True), (3, False)]
    assert [x.text for x in misses.collect()] == ["b"]
