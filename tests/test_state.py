"""Commands, folds, views and audits on hand-made rows."""

from pyspark.sql import functions as F

from ledgerloom.operators import audit, folding, metrics, mutations as m, payloads, views
from ledgerloom.operators import neardup

ITEM = "id string, tier string, status string, content string, version int, updated_round int, reason string, source_task_ids array<string>"


def items(spark):
    return spark.createDataFrame([("a", "tip", "active", "A", 1, 1, None, ["t2", "t1"]), ("b", "tip", "active", "B", 1, 2, None, ["t2", "t3"]), ("c", "skill", "active", "C", 1, 1, None, ["t1"]), ("d", "tip", "retired", "D", 2, 3, "old", [])], ITEM)


def test_delete_and_replay(spark):
    commands = spark.createDataFrame([("a", 5, "unused")], "id string, updated_round int, reason string")
    once = m.retired(items(spark), commands)
    twice = m.retired(once, commands)
    row = once.where("id = 'a'").first()
    assert (row.status, row.version, row.updated_round, row.reason) == ("retired", 2, 5, "unused")
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_merge(spark):
    sources = spark.createDataFrame([(1, "a"), (1, "b")], "merge_id int, id string")
    contents = spark.createDataFrame([(1, "AB", 5)], "merge_id int, content string, updated_round int")
    new, after = m.merged(items(spark), sources, contents, F.lit("new"))
    row = new.first()
    assert (row.id, row.version, row.created_round, row.source_task_ids, row.merged_from) == ("new", 1, 5, ["t1", "t2", "t3"], ["a", "b"])
    assert {(r.source_id, r.version, r.updated_round, r.reason) for r in after.collect()} == {("a", 2, 5, "merged into new"), ("b", 2, 5, "merged into new")}
    wrong = spark.createDataFrame([(1, "a"), (1, "c"), (2, "a"), (2, "d"), (3, "a"), (4, "a"), (4, "b")], "merge_id int, id string")
    assert {r.merge_id: r.error for r in m.merge_errors(items(spark), wrong).collect()} == {1: "cross_tier", 2: "source_not_active", 3: "too_few_sources"}


def test_add_lookup_backfill_generation(spark):
    base = items(spark).select("id", "content")
    state, rejected = m.added(base, spark.createDataFrame([("a", "x"), ("z", "Z")], "id string, content string"))
    assert state.count() == 5 and [r.id for r in rejected.collect()] == ["a"]
    found = m.looked_up(items(spark), spark.createDataFrame([(0, "d"), (1, "a")], "pos int, id string")).orderBy("pos").collect()
    assert [(r.id, r.found) for r in found] == [("d", False), ("a", True)]
    state = m.next_generation(spark.createDataFrame([(3,)], "generation int"), 2).first()
    assert (state.generation, state.committed) == (3, False)


def test_command_conflicts(spark):
    rows = [(1, "merge", "a", None), (1, "merge", "b", None), (2, "merge", "c", None), (2, "merge", "d", None), (3, "delete", "a", None), (4, "delete", "e", None), (5, "delete", "e", None), (6, "delete", "d", None), (9, "review", "d", "keep")]
    got = {(r.seq, r.kind, r.id) for r in m.normalised_commands(spark.createDataFrame(rows, "seq int, kind string, id string, verdict string")).collect()}
    assert got == {(1, "merge", "a"), (1, "merge", "b"), (4, "delete", "e")}


LOG = "task string, kind string, turn int, payload string"


def test_fold(spark):
    good = [("t", "EpisodeStarted", None, "s"), ("t", "MemoryCandidatesRetrieved", None, "c"), ("t", "MemorySelected", None, "m"), ("t", "EnvironmentStepped", 0, "e"), ("t", "DecisionMade", 0, "d"), ("t", "EpisodeFinished", None, "f")]
    bad = [("u", "EpisodeStarted", None, "s"), ("u", "EpisodeFinished", None, "f"), ("u", "MemorySelected", None, "m"), ("u", "MemoryDisabled", None, "x"), ("v", "EpisodeStarted", None, "s"), ("w", "EpisodeStarted", None, "s"), ("w", "EpisodeFinished", None, "s"), ("w", "MemorySelected", None, "1"), ("w", "MemorySelected", None, "2")]
    got = {r.task: r for r in folding.episodes(spark.createDataFrame(good + bad, LOG), ["task"], "kind", "turn", "payload").collect()}
    assert got["t"].error is None and [s.kind for s in got["t"].steps] == ["DecisionMade", "EnvironmentStepped"] and got["t"].MemoryCandidatesRetrieved == "c"
    assert {k: v.error for k, v in got.items() if k != "t"} == {"u": "selected_and_disabled", "v": "not_once:EpisodeFinished", "w": "repeated:MemorySelected"}


def test_batch_ownership(spark):
    rows = spark.createDataFrame([("x", 0, "c", "t0"), ("x", 1, "c", "t1"), ("y", 1, "a", "t1"), ("y", 2, "b", "t1"), ("z", 0, "q", "t0")], "id string, episode_index int, content string, source_task string")
    got = {(r.id, r.episode_index): r.outcome for r in folding.ownership(rows, rows.where("id = 'z'").select("id")).collect()}
    assert got == {("x", 0): "created", ("x", 1): "replayed", ("y", 1): "created", ("y", 2): "replayed", ("z", 0): "replayed"}
    merged = {r.id: (r.conflict, r.source_tasks) for r in folding.coalesced_proposals(rows).collect()}
    assert merged == {"x": (False, ["t0", "t1"]), "y": (True, ["t1"]), "z": (False, ["t0"])}


def test_views(spark):
    cand = spark.createDataFrame([("e1", "a", 1), ("e1", "b", 2), ("e2", "c", 1)], "episode_id string, memory_id string, rank int")
    score = spark.createDataFrame([("a", 0.8), ("b", -0.2), ("c", None)], "memory_id string, value double")
    (row,) = views.selection_view(cand, score).collect()
    assert (row.episode_id, row.public_ids, row.privileged_values) == ("e1", ["a", "b"], [0.8, -0.2])
    best = views.valuable_selected(cand, score)
    assert [(r.memory_id, r.place) for r in best.collect()] == [("a", 1)]
    props = spark.createDataFrame([("e1", "a", "llm", "created", "e1"), ("e1", "b", "llm", "replayed", "e1"), ("e2", "c", "llm", "created", "e2"), ("e3", "a", "rule", "created", "e3")], "episode_id string, memory_id string, origin string, disposition string, creator_episode string")
    assert [(r.episode_id, r.memories) for r in views.write_view(props, score).collect()] == [("e1", ["a"])]


def test_bucket_sampler(spark):
    rows = spark.createDataFrame([("a", 3.0, 0), ("b", None, 9), ("c", -1.0, 1), ("d", 2.0, 2)], "id string, value double, usage_count int")
    ends = spark.createDataFrame([("d", 0), ("zz", 1)], "id string, position long")
    assert [r.id for r in neardup.sampled_buckets(rows, ends, 3).collect()] == ["a", "b", "c"]
    assert [r.id for r in neardup.sampled_buckets(rows, ends, 9).collect()] == ["a", "b", "c", "d"]


def test_metrics_and_comparison(spark):
    rows = spark.createDataFrame([("r", "completed", 0.4), ("r", "failed", 1.0), ("s", "completed", 0.6), ("t", "failed", 0.0)], "run string, status string, reward double")
    got = metrics.run_metrics(rows, ["run"])
    by = {r.run: r for r in got.collect()}
    assert (by["r"].task_count, by["r"].failure_count, by["r"].mean_reward, by["r"].pass_rate) == (2, 1, 0.4, 0.5)
    assert by["t"].mean_reward == 0.0
    delta = {r.run: r.delta_mean_reward for r in metrics.against_baseline(got, "run", "r").collect()}
    assert delta["s"] == 0.2


def test_schedule(spark):
    rows = spark.createDataFrame([("sel", i) for i in range(10)] + [("act", i) for i in range(3)], "kind string, id int")
    out = metrics.schedule(rows, 3, 42, 4).collect()
    assert len(out) == 39 and len({(r.kind, r.id, r.epoch) for r in out}) == 39
    sel = sorted(r.sequence_index for r in out if r.kind == "sel")
    assert sel == list(range(30)) and {r.window for r in out if r.kind == "act"} == {0, 1, 2}
    one = metrics.schedule_fingerprint(metrics.schedule(rows, 3, 42, 4)).orderBy("kind").collect()
    assert one == metrics.schedule_fingerprint(metrics.schedule(rows.orderBy(F.desc("id")).repartition(3), 3, 42, 4)).orderBy("kind").collect()
    assert one != metrics.schedule_fingerprint(metrics.schedule(rows, 3, 43, 4)).orderBy("kind").collect()


def test_audit(spark):
    runs = spark.createDataFrame([(1, "s0", "s1"), (2, "s1", "s2"), (3, "sX", "s3")], "n int, b string, a string")
    assert [r.n for r in audit.broken_lineage(runs, "n", "b", "a").collect()] == [2]
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "parent int, child int")
    assert audit.lineage_closure(edges).count() == 45
    left, right = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (3,)], "x int")
    assert sorted((r.x, r.side) for r in audit.differing(left, right).collect()) == [(1, "missing"), (2, "missing"), (3, "unexpected")]
    got = audit.errors(("b", "x", left.withColumnRenamed("x", "message")), ("a", "y", right.withColumnRenamed("x", "message"))).collect()
    assert [(r.code, r.message) for r in got] == [("a", "1"), ("a", "3"), ("b", "1"), ("b", "2")]
    assert payloads.reduction_due(241, 240) and not payloads.reduction_due(200, 200)


def test_due_rounds(spark):
    completed = spark.createDataFrame([("n", 95), ("m", 29)], "namespace string, completed int")
    done = spark.createDataFrame([("n", 2)], "namespace string, round int")
    assert [(r.namespace, r.round) for r in folding.due_rounds(completed, done, 30).collect()] == [("n", 1), ("n", 3)]


def test_merges_in_sequence_and_replayed(spark):
    items = spark.createDataFrame([(1, "tip", "active", ["b"]), (2, "tip", "active", ["a"]), (3, "tip", "active", ["c", "a"]), (4, "tip", "retired", ["d"])], "id long, tier string, status string, source_task_ids array<string>")
    merges = lambda rows: spark.createDataFrame(rows, "seq long, new_id long, id long")
    good = merges([(1, 10, 1), (1, 10, 2), (2, 11, 10), (2, 11, 3), (3, 10, 2), (3, 10, 1)])
    assert m.merge_sequence_errors(items, good).count() == 0
    got = {r.new_id: (r.source_task_ids, r.merged_from, r.status) for r in m.merged_sequence(items, good).collect()}
    assert got == {10: (["a", "b"], [1, 2], "retired"), 11: (["a", "b", "c"], [3, 10], "active")}
    bad = merges([(1, 10, 1), (1, 10, 4), (2, 11, 1), (2, 11, 12), (3, 12, 2), (4, 3, 99)])
    assert {tuple(r) for r in m.merge_sequence_errors(items, bad).collect()} == {(1, "source_not_active"), (2, "source_used"), (2, "source_not_active"), (4, "source_not_active"), (4, "result_exists")}
