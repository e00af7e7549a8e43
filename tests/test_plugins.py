"""Searches over all items, block products, hooks, manifests, caches and read-only stores."""

import numpy as np
import pytest
from pyspark.errors import PythonException, SparkRuntimeException
from pyspark.sql import functions as F

from ledgerloom.operators import folding, hooks, metrics, mutations, neardup, retrieval, views
from ledgerloom.sources import jsonl, scratch, stores


def vectors(spark, n=400, dimension=8, seed=1):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(n, dimension))
    rows[n // 2 : n // 2 + 20] = rows[:20]  # copies
    tiers = ("skill", "tip", "tool", "trajectory")
    items = spark.createDataFrame([(i, tiers[i % 4], [float(x) for x in v]) for i, v in enumerate(rows)], "id long, tier string, vector array<double>")
    return items.where("id % 40 <> 7").select(F.col("id").alias("query_id"), "vector").where("query_id % 40 = 3"), items.repartition(5)


def units(items):
    rows = sorted((r.id, r.tier, r.vector) for r in items.collect())
    m = np.array([v for _, _, v in rows])
    return [i for i, _, _ in rows], [t for _, t, _ in rows], m / np.linalg.norm(m, axis=1, keepdims=True)


def greedy(ids, m, q, allowed, k, weight, picks):
    picks = list(picks)
    while len(picks) < k:
        best = None
        for i in allowed:
            if i in picks:
                continue
            near = max((float(m[i] @ m[j]) for j in picks), default=0.0)
            key = (-(weight * float(m[i] @ q) - (1 - weight) * near), -float(m[i] @ q), ids[i])
            best = min(best, (key, i)) if best else (key, i)
        if best is None:
            break
        picks.append(best[1])
    return picks


@pytest.mark.parametrize("pool,held", [(64, 32 << 20), (3, 3000)])
def test_searches_over_all_items(spark, monkeypatch, pool, held):
    monkeypatch.setattr(retrieval, "POOL", pool)
    monkeypatch.setattr(retrieval, "HELD_BYTES", held)
    queries, items = vectors(spark)
    ids, tiers, m = units(items)
    want_top, want_mmr, want_tiered = set(), set(), set()
    quotas, lambdas = {"skill": 4, "tip": 3, "tool": 2, "trajectory": 2}, {"skill": 0.8, "tip": 0.6, "tool": 0.85, "trajectory": 0.7}
    for r in queries.collect():
        q = np.array(r.vector) / np.linalg.norm(r.vector)
        s = m @ q
        order = sorted(range(len(ids)), key=lambda i: (-s[i], ids[i]))
        want_top |= {(r.query_id, ids[i], k + 1) for k, i in enumerate(order[:7])}
        want_mmr |= {(r.query_id, ids[i], k + 1) for k, i in enumerate(greedy(ids, m, q, range(len(ids)), 9, 0.6, []))}
        picks = [i for t in retrieval.RETRIEVAL_ORDER for i in greedy(ids, m, q, [j for j in range(len(ids)) if tiers[j] == t], quotas[t], lambdas[t], [])]
        want_tiered |= {(r.query_id, ids[i], k + 1) for k, i in enumerate(greedy(ids, m, q, range(len(ids)), 15, 0.75, picks))}
    # copies have equal scores up to the last bits, so the vectors, not the ids, are compared
    place = {i: k for k, i in enumerate(ids)}
    alike = lambda rows: sorted((q, rank, round(float(m[place[i]] @ m[0]), 9)) for q, i, rank in rows)
    rows = lambda df: {(r.query_id, r.id, r["rank"]) for r in df.collect()}
    assert alike(rows(retrieval.nearest(queries, items, 7))) == alike(want_top)
    assert alike(rows(retrieval.mmr_over(queries, items, 9, 0.6))) == alike(want_mmr)
    assert alike(rows(retrieval.tiered_over(queries, items, 15, quotas, lambdas, 0.75))) == alike(want_tiered)


def test_searches_of_little(spark):
    queries, items = vectors(spark, 60)
    few = items.where("id < 3")
    assert retrieval.nearest(queries, few, 9, ("tier",)).where("tier is not null").groupBy("query_id").count().where("count <> 3").count() == 0
    assert retrieval.mmr_over(queries, few, 9, 0.5).groupBy("query_id").count().where("count <> 3").count() == 0
    assert retrieval.nearest(queries.limit(0), items, 3).count() == 0 and retrieval.mmr_over(queries, items.limit(0), 3, 0.5).count() == 0


@pytest.mark.parametrize("block", [1024, 30])
def test_block_products(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    _, items = vectors(spark, 200)
    ids, tiers, m = units(items)
    s = np.clip(m @ m.T, -1, 1)
    pairs = {(i, j): s[a, b] for a, i in enumerate(ids) for b, j in enumerate(ids) if i < j}
    of = dict(zip(ids, tiers))
    got = {(r.left_id, r.right_id): r.similarity for r in neardup.near_pairs(items, 0.7, ["tier"]).collect()}
    want = {p: v for p, v in pairs.items() if v >= 0.7 and of[p[0]] == of[p[1]]}
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in got)
    best = [r.similarity for r in neardup.near_pairs(items, -1.0, [], best=30).collect()]
    assert np.allclose(best, sorted(pairs.values(), reverse=True)[:30])
    odd = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0, 0.0])], "id long, vector array<double>")
    assert neardup.near_pairs(odd, -1.0, []).count() == 0
    assert [tuple(r) for r in neardup.near_pairs(odd, -1.0, [], invalid=-1.0).collect()] == [(1, 2, -1.0)]
    assert neardup.near_pairs(odd.limit(0), 0.5, []).count() == 0


def test_embedding_hook_and_cache(spark):
    texts = spark.createDataFrame([("a",), ("bb",), ("bb",), (None,), ("ccc",)], "text string")
    cache = spark.createDataFrame([("a", [9.0, 9.0])], "text string, vector array<double>").select(stores.cache_key(F.lit("r"), F.col("text")).alias("key"), "vector")
    made = hooks.embedded(texts, cache, lambda: lambda batch: np.array([[len(t), 1.0] for t in batch]), "r", 2, batch=1)
    assert sorted(r.vector for r in made.collect()) == [[2.0, 1.0], [3.0, 1.0]]
    whole = stores.cache_merged(cache, made.unionByName(made).unionByName(cache))
    keys = texts.where("text is not null").select(stores.cache_key(F.lit("r"), F.col("text")).alias("key")).distinct()
    assert sorted(r.vector for r in stores.count_checked(keys, whole).collect()) == [[2.0, 1.0], [3.0, 1.0], [9.0, 9.0]]
    with pytest.raises(SparkRuntimeException):
        stores.count_checked(keys, cache).collect()
    with pytest.raises(PythonException):
        hooks.embedded(texts, cache, lambda: lambda batch: np.array([[1.0]] * len(batch)), "r", 2).collect()


def test_scripts_sinks_and_benchmarks(spark):
    prompts = spark.createDataFrame([("t", 0), ("t", 1)], "task string, turn int")
    script = spark.createDataFrame([("t", 0, "go")], "task string, turn int, output string")
    assert [(r.turn, r.output) for r in hooks.scripted(prompts, script, ["task", "turn"], "stop").orderBy("turn").collect()] == [(0, "go"), (1, "stop")]
    path = scratch.shared_folder(spark, "sink")
    for batch in ("1", "2", "1"):
        hooks.recorded(prompts, path, batch)
    assert spark.read.parquet(path).count() == 4
    known = hooks.Benchmarks()
    known.register(hooks.Benchmark("b", "retail", lambda s: s.createDataFrame([("t1", "train"), ("t2", "test")], "task_id string, split string")))
    assert [r.task_id for r in known.tasks(spark, "b", "train").collect()] == ["t1"]
    with pytest.raises(KeyError):
        known.tasks(spark, "c", "train")
    with pytest.raises(ValueError):
        known.register(hooks.Benchmark("b", "x", lambda s: None))


def test_manifests_and_read_only_stores(spark):
    root = scratch.shared_folder(spark, "store")
    rows = spark.createDataFrame([("x", 1)], "a string, b int")
    for name in "xyz":
        rows.coalesce(1).write.json(f"{root}/data/{name}")
    stores.write_manifest(spark, f"{root}/data", f"{root}/manifest")
    assert stores.manifest_faults(spark, f"{root}/data", f"{root}/manifest").count() == 0
    scratch.delete(spark, f"{root}/data/x")
    rows.withColumn("b", F.lit(2)).coalesce(1).write.json(f"{root}/data/new")
    assert sorted(r.fault for r in stores.manifest_faults(spark, f"{root}/data", f"{root}/manifest").collect()) == ["missing", "unexpected"]
    items = spark.createDataFrame([("mem_tip_x", "tip", "c", "active", 1, 0, 0, ["t"])], stores.ITEM)
    name = stores.publish_snapshot(items, f"{root}/snapshots")
    frozen = stores.ReadOnlyStore(spark, f"{root}/snapshots", name)
    assert frozen.items().count() == 1
    for write in (frozen.add, frozen.merge, frozen.delete, frozen.update, frozen.commit):
        with pytest.raises(PermissionError):
            write(items)


def test_paths_of_snapshots():
    assert stores.snapshot_path("s1", "retail", "/m") == "/m/retail/snapshots/s1"
    assert stores.snapshot_path("/m/x/snapshots/s", "retail", "/m") == "/m/x/snapshots/s"
    for value in ("../../../etc", "/other/s", " "):
        with pytest.raises(ValueError):
            stores.snapshot_path(value, "retail", "/m")


def test_runs_and_records(spark):
    root = scratch.shared_folder(spark, "run")
    stores.write_run_record(spark, '{"apiToken":"x","run":"r1"}', f"{root}/run.json")
    with pytest.raises(FileExistsError):
        stores.write_run_record(spark, "{}", f"{root}/run.json")
    spark.createDataFrame([("e1",)], "id string").coalesce(1).write.json(f"{root}/episodes.jsonl")
    record, episodes = stores.read_run(spark, root, "apiToken string, run string", "id string")
    assert [tuple(r) for r in record.collect()] == [("[REDACTED]", "r1")] and episodes.count() == 1
    spark.createDataFrame([("e1",)], "id string").write.json(f"{root}/extra")
    with pytest.raises(ValueError):
        stores.read_run(spark, root, "run string", "id string")


def test_faulty_lines_keep_their_numbers(spark):
    root = scratch.shared_folder(spark, "lines")
    text = "\n".join(["{}", "", "[1]", '{"a":1}', "oops"] * 40)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(root)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    got = {(r.line, r.fault) for r in jsonl.faults(spark, root).collect()}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {(5 * k + 3, "not_an_object") for k in range(40)} | {(5 * k + 5, "not_json") for k in range(40)}


def test_batches_and_generations(spark):
    items = spark.createDataFrame([(1, "tip", "a"), (2, "tip", "b"), (3, "tool", "c")], "id long, tier string, content string")
    batch = spark.createDataFrame([(2, "tip", "B"), (4, "tip", "d")], items.schema)
    rows, tiers = mutations.committed_batch(items, batch, items.limit(0))
    assert tiers == ["tip"] and sorted((r.id, r.content) for r in rows.collect()) == [(1, "a"), (2, "B"), (4, "d")]
    assert mutations.committed_batch(items, batch, items.limit(1))[1] == []
    states = spark.createDataFrame([("a", 3), ("b", 1)], "namespace string, generation long")
    commits = spark.createDataFrame([("a", 3, 10, "s2"), ("a", 3, 11, "s1"), ("b", 0, 5, "s0")], "namespace string, expected long, completed_tasks long, snapshot_id string")
    assert sorted(map(tuple, mutations.generation_commits(states, commits).collect())) == [("a", 4, 11, "s1", True), ("b", 1, None, None, False)]


def test_missing_results_stop_the_query(spark):
    tasks = spark.createDataFrame([("t1",), ("t2",)], "task_id string")
    results = spark.createDataFrame([("t1", 1.0)], "task_id string, reward double")
    assert folding.joined_results(tasks.where("task_id = 't1'"), results, "task_id").count() == 1
    with pytest.raises(SparkRuntimeException):
        folding.joined_results(tasks, results, "task_id").collect()


def test_maintenance_faults_and_histories(spark):
    snapshot = spark.createDataFrame([(1, "x" * 400), (2, "b")], "id long, content string")
    shown = spark.createDataFrame([("m", 1, "x" * 320), ("m", 2, "c"), ("n", 1, "x" * 400)], "maintenance_id string, id long, shown string")
    prior = spark.createDataFrame([("m", "e1"), ("m", "e9"), ("n", "e2")], "maintenance_id string, episode_id string")
    episodes = spark.createDataFrame([("e1", 1), ("e2", 8)], "episode_id string, position long")
    records = spark.createDataFrame([("m", 5), ("n", 6)], "maintenance_id string, position long")
    assert {tuple(r) for r in views.maintenance_faults(shown, snapshot, prior, episodes, records).collect()} == {("m", "content_differs"), ("m", "unknown_episode"), ("n", "later_episode")}
    rounds = spark.createDataFrame([(1, 10), (2, 70_000), (3, 140_000)], "round long, position long")
    chosen = spark.createDataFrame([("a", 3, 1.0), ("a", 10, 0.0), ("a", 11, 1.0), ("a", 139_999, 1.0), ("b", 150_000, 1.0)], "memory_id string, position long, reward double")
    assert sorted(map(tuple, views.memory_histories(rounds, chosen).collect())) == [("a", 1, 2, 1), ("a", 2, 3, 2), ("a", 3, 4, 3)]


def test_bootstrap_interval(spark):
    """The distributed draws lie where plain Poisson bootstraps lie."""
    rng = np.random.default_rng(0)
    differences = rng.normal(0.3, 1.0, 200)
    got = metrics.bootstrap_interval(spark.createDataFrame([(i, float(x)) for i, x in enumerate(differences)], "id long, difference double"), 600).first()
    weights = rng.poisson(1, (4000, 200))
    low, high = np.percentile((weights @ differences) / weights.sum(1), [2.5, 97.5])
    assert abs(got.low - low) < 0.04 and abs(got.high - high) < 0.04
