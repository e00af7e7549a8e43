"""Named queries on event logs, episodes, runs and schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators import audit, folding, metrics, retrieval
from ledgerloom.plans.bindings import OBS, RUNS, observations, proposals, runs, table
from ledgerloom.plans.registry import query

# An event log: five events in a row are a task.
LOG = """log AS (SELECT event_id // 5 AS task_id, CASE event_type WHEN 'signup' THEN 'EpisodeStarted' WHEN 'error' THEN 'MemoryDisabled' WHEN 'purchase' THEN 'EpisodeFinished' WHEN 'view' THEN 'DecisionMade' ELSE 'EnvironmentStepped' END AS kind,
    event_id AS turn, CAST(value AS VARCHAR) AS payload FROM events)"""


def log(spark: SparkSession, d: str) -> DataFrame:
    kind = F.expr("CASE event_type WHEN 'signup' THEN 'EpisodeStarted' WHEN 'error' THEN 'MemoryDisabled' WHEN 'purchase' THEN 'EpisodeFinished' WHEN 'view' THEN 'DecisionMade' ELSE 'EnvironmentStepped' END")
    return table(spark, d, "events").select(F.floor(F.col("event_id") / 5).alias("task_id"), kind.alias("kind"), F.col("event_id").alias("turn"), F.col("value").cast("string").alias("payload"))


@query(
    "fold_events",
    "EV1 SRC1 SNK1",
    f"""WITH {LOG}, g AS (SELECT task_id, count(*) FILTER (WHERE kind = 'EpisodeStarted') AS s, count(*) FILTER (WHERE kind = 'EpisodeFinished') AS f, count(*) FILTER (WHERE kind = 'MemoryDisabled') AS d,
    string_agg(CASE WHEN kind IN ('DecisionMade', 'EnvironmentStepped') THEN turn || ':' || kind END, ',' ORDER BY turn) AS steps FROM log GROUP BY task_id)
    SELECT task_id, coalesce(steps, '') AS steps, CASE WHEN f <> 1 THEN 'not_once:EpisodeFinished' WHEN s <> 1 THEN 'not_once:EpisodeStarted' WHEN d > 1 THEN 'repeated:MemoryDisabled' END AS error FROM g""",
)
def fold_events(spark: SparkSession, d: str) -> DataFrame:
    out = folding.episodes(log(spark, d), ["task_id"], "kind", "turn", "payload")
    return out.select("task_id", F.array_join(F.transform("steps", lambda s: F.concat(s["turn"].cast("string"), F.lit(":"), s["kind"])), ",").alias("steps"), "error")


@query("failed_episodes", "EV4", f"WITH {RUNS} SELECT run_id, task_id, 1 AS schema_version, status, 'environment' AS stage FROM runs WHERE status = 'failed'")
def failed_episodes(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d).where("status = 'failed'").select("run_id", "task_id", F.lit(1).alias("schema_version"), "status", F.lit("environment").alias("stage"))


STEPS = """a AS (SELECT conv_id, turn + CASE WHEN conv_id % 7 = 3 AND turn = 1 THEN 1000 ELSE 0 END AS turn, CASE WHEN turn % 6 = 5 THEN 'x' ELSE role END AS action FROM conversations), b AS (SELECT conv_id, turn + CASE WHEN conv_id % 5 = 2 AND turn = 0 THEN 2000 ELSE 0 END AS turn, role AS action FROM conversations)"""


@query(
    "step_integrity",
    "JN10",
    f"""WITH {STEPS}, j AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.turn, b.turn) AS turn, a.action AS da, b.action AS sa FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn),
    f AS (SELECT conv_id, turn, CASE WHEN da IS NULL THEN 'step_without_decision' WHEN sa IS NULL THEN 'decision_without_step' WHEN da <> sa THEN 'action_differs' WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 <> turn THEN 'turn_gap' END AS fault FROM j)
    SELECT conv_id, arg_min(fault, turn) FILTER (WHERE fault IS NOT NULL) AS fault FROM f GROUP BY conv_id""",
)
def step_integrity(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    a = rows.select("conv_id", F.expr("turn + CASE WHEN conv_id % 7 = 3 AND turn = 1 THEN 1000 ELSE 0 END").alias("turn"), F.expr("CASE WHEN turn % 6 = 5 THEN 'x' ELSE role END").alias("action"))
    b = rows.select("conv_id", F.expr("turn + CASE WHEN conv_id % 5 = 2 AND turn = 0 THEN 2000 ELSE 0 END").alias("turn"), F.col("role").alias("action"))
    return folding.step_integrity(a, b, ["conv_id"])


@query("dispositions", "JN11", "SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'discarded' WHEN doc_id % 3 = 0 THEN 'replayed' WHEN doc_id % 2 = 0 THEN 'created' ELSE 'proposed' END AS disposition FROM documents")
def dispositions(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return folding.disposition(ids, ids.where("id % 2 = 0"), ids.where("id % 3 = 0"), ids.where("id % 5 = 0"))


@query("turn_contiguity", "TK12", "WITH c AS (SELECT conv_id, turn + CASE WHEN conv_id % 9 = 4 AND turn = 1 THEN 50 ELSE 0 END AS turn FROM conversations) SELECT conv_id, count(*) AS rows, min(turn) = 0 AND count(DISTINCT turn) = count(*) AND max(turn) = count(*) - 1 AS contiguous FROM c GROUP BY conv_id")
def turn_contiguity(spark: SparkSession, d: str) -> DataFrame:
    return folding.contiguous(table(spark, d, "conversations").withColumn("turn", F.expr("turn + CASE WHEN conv_id % 9 = 4 AND turn = 1 THEN 50 ELSE 0 END")), ["conv_id"], "turn")


@query(
    "chain_check",
    "TK13",
    "WITH c AS (SELECT conv_id, turn, md5(text) AS o, CASE WHEN turn % 4 = 2 THEN 'broken' ELSE lead(md5(text)) OVER (PARTITION BY conv_id ORDER BY turn) END AS n FROM conversations) SELECT conv_id, turn FROM (SELECT *, lead(o) OVER (PARTITION BY conv_id ORDER BY turn) AS x FROM c) WHERE x IS NOT NULL AND n IS DISTINCT FROM x",
)
def chain_check(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.md5("text").alias("o"))
    rows = rows.withColumn("n", F.when(F.col("turn") % 4 == 2, F.lit("broken")).otherwise(F.lead("o").over(Window.partitionBy("conv_id").orderBy("turn"))))
    return folding.chained(rows, "conv_id", "turn", "o", "n")


@query(
    "decision_rewards",
    "EV3",
    """WITH s AS (SELECT conv_id, sum(CAST(role = 'assistant' AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step, role FROM conversations), g AS (SELECT conv_id, step, count(*) FILTER (WHERE role <> 'assistant') AS between FROM s WHERE step >= 0 GROUP BY ALL)
    SELECT conv_id, CAST(step AS BIGINT) AS step, between, step = max(step) OVER (PARTITION BY conv_id) AS done, CASE WHEN step = max(step) OVER (PARTITION BY conv_id) THEN (conv_id % 2)::DOUBLE ELSE 0.0::DOUBLE END AS reward FROM g""".replace("AS between", 'AS "between"').replace(", between,", ', "between",'),
)
def decision_rewards(spark: SparkSession, d: str) -> DataFrame:
    return folding.last_step_rewards(table(spark, d, "conversations"), "conv_id", "turn", "role", (F.col("conv_id") % 2).cast("double"))


@query("maintenance_triples", "EV2", "WITH k AS (SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS kinds FROM conversations GROUP BY conv_id) SELECT conv_id, kinds = 'user,assistant,user,assistant' AS complete, sha256(kinds) AS record_sha256 FROM k")
def maintenance_triples(spark: SparkSession, d: str) -> DataFrame:
    return folding.triples(table(spark, d, "conversations"), "conv_id", "turn", "role", ("user", "assistant", "user", "assistant"))


PROPOSED = "p AS (SELECT doc_id % 300 AS id, doc_id AS episode_index, CASE WHEN doc_id % 300 < 200 THEN 'c' || (doc_id % 300) ELSE 'c' || doc_id END AS content, source AS source_task FROM documents)"


def proposed(spark: SparkSession, d: str) -> DataFrame:
    rows = proposals(spark, d).withColumn("id", F.col("episode_index") % 300)
    content = F.expr("CASE WHEN id < 200 THEN concat('c', cast(id as string)) ELSE concat('c', cast(episode_index as string)) END")
    return rows.select("id", "episode_index", content.alias("content"), "source_task")


@query(
    "proposal_coalesce",
    "AG10",
    f"WITH {PROPOSED}, t AS (SELECT id, source_task, min(episode_index) AS m FROM p GROUP BY ALL) SELECT p.id, count(DISTINCT content) > 1 AS conflict, (SELECT string_agg(source_task, ',' ORDER BY m) FROM t WHERE t.id = p.id) AS source_tasks, count(*) AS contributions, min(episode_index) AS first_episode FROM p GROUP BY p.id",
)
def proposal_coalesce(spark: SparkSession, d: str) -> DataFrame:
    return folding.coalesced_proposals(proposed(spark, d)).withColumn("source_tasks", F.array_join("source_tasks", ","))


@query("replay_ownership", "AG11", f"WITH {PROPOSED} SELECT id, episode_index, CASE WHEN id % 10 = 0 OR row_number() OVER (PARTITION BY id ORDER BY episode_index) > 1 THEN 'replayed' ELSE 'created' END AS outcome FROM (SELECT DISTINCT id, episode_index FROM p)")
def replay_ownership(spark: SparkSession, d: str) -> DataFrame:
    rows = proposed(spark, d)
    return folding.ownership(rows, rows.where("id % 10 = 0").select("id").distinct())


@query(
    "write_quota",
    "AG15 AG16",
    "WITH q AS (SELECT * FROM (VALUES ('en', 2), ('fr', 1), ('de', 1)) AS t(lang, quota)) SELECT doc_id, source, d.lang AS tier, row_number() OVER (PARTITION BY source, d.lang ORDER BY doc_id) <= coalesce(quota, 0) AS kept FROM documents d LEFT JOIN q USING (lang)",
)
def write_quota(spark: SparkSession, d: str) -> DataFrame:
    quotas = spark.createDataFrame([("en", 2), ("fr", 1), ("de", 1)], "tier string, quota int")
    rows = table(spark, d, "documents").select("doc_id", "source", F.col("lang").alias("tier"))
    return folding.within_quota(rows, "source", "tier", "doc_id", quotas)


@query("selection_limits", "AG16", f"WITH {OBS}, s AS (SELECT episode_index % 200 AS episode, tier FROM obs WHERE selected) SELECT episode, count(*) AS n, count(*) > 20 OR count(*) FILTER (WHERE tier = 'tip') > 7 OR count(*) FILTER (WHERE tier = 'skill') > 8 OR count(*) FILTER (WHERE tier = 'tool') > 3 OR count(*) FILTER (WHERE tier = 'trajectory') > 2 AS violated FROM s GROUP BY episode")
def selection_limits(spark: SparkSession, d: str) -> DataFrame:
    rows = observations(spark, d).where("selected").select((F.col("episode_index") % 200).alias("episode"), "tier")
    over = F.count("*") > 20
    for tier, most in (("tip", 7), ("skill", 8), ("tool", 3), ("trajectory", 2)):
        over = over | (F.count_if(F.col("tier") == tier) > most)
    return rows.groupBy("episode").agg(F.count("*").alias("n"), over.alias("violated"))


@query("due_rounds", "ST2", "WITH c AS (SELECT source AS namespace, count(*) AS completed FROM documents GROUP BY source) SELECT namespace, CAST(r AS INT) AS round FROM (SELECT namespace, unnest(range(1, completed // 15 + 1)) AS r FROM c) WHERE r % 2 = 0")
def due_rounds(spark: SparkSession, d: str) -> DataFrame:
    completed = table(spark, d, "documents").groupBy(F.col("source").alias("namespace")).agg(F.count("*").alias("completed"))
    last = F.greatest(F.lit(1), F.floor(F.col("completed") / 15).cast("int"))
    done = completed.select("namespace", F.explode(F.sequence(F.lit(1), last, F.lit(2))).alias("round"))
    return folding.due_rounds(completed, done, 15)


METRICS = """m AS (SELECT run_id, count(*) AS task_count, count(*) FILTER (WHERE status = 'completed') AS completed_count, count(*) FILTER (WHERE status <> 'completed') AS failure_count,
    coalesce(avg(reward) FILTER (WHERE status = 'completed'), 0) AS mean_reward, count(*) FILTER (WHERE status = 'completed' AND reward > 0) / count(*) AS pass_rate FROM runs GROUP BY run_id)"""


@query("run_metrics", "AG5", f"WITH {RUNS}, {METRICS} SELECT run_id, task_count, completed_count, failure_count, round(mean_reward, 6) AS mean_reward, round(pass_rate, 6) AS pass_rate FROM m")
def run_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.run_metrics(runs(spark, d), ["run_id"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean_reward", "pass_rate")})


@query("compare_baseline", "AG17", f"WITH {RUNS}, {METRICS}, b AS (SELECT * FROM m WHERE run_id = '3-MEDIUM') SELECT m.run_id, round(m.mean_reward - b.mean_reward, 6) AS delta_mean_reward, round(m.pass_rate - b.pass_rate, 6) AS delta_pass_rate FROM m, b")
def compare_baseline(spark: SparkSession, d: str) -> DataFrame:
    return metrics.against_baseline(metrics.run_metrics(runs(spark, d), ["run_id"]), "run_id", "3-MEDIUM", digits=6)


@query("run_summary", "AG7", f"WITH {RUNS} SELECT run_id, count(*) FILTER (WHERE status = 'completed') AS successes, count(*) FILTER (WHERE status = 'failed') AS failures, round(coalesce(sum(reward) FILTER (WHERE status = 'completed'), 0), 6) AS total_reward, min(task_id) FILTER (WHERE status = 'failed') AS first_failure FROM runs GROUP BY run_id")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    done = F.col("status") == "completed"
    return runs(spark, d).groupBy("run_id").agg(F.count_if(done).alias("successes"), F.count_if(~done).alias("failures"), F.round(F.coalesce(F.sum(F.when(done, F.col("reward"))), F.lit(0.0)), 6).alias("total_reward"), F.min(F.when(~done, F.col("task_id"))).alias("first_failure"))


@query("tier_counts", "AG6", f"WITH {OBS} SELECT tier, count(DISTINCT (episode_index, memory_id)) AS retrieved, count(DISTINCT (episode_index, memory_id)) FILTER (WHERE selected) AS chosen FROM obs GROUP BY tier")
def tier_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = observations(spark, d).groupBy("tier", "episode_index", "memory_id").agg(F.max("selected").alias("selected"))
    return rows.groupBy("tier").agg(F.count("*").alias("retrieved"), F.count_if("selected").alias("chosen"))


@query("token_totals", "AG14", f"WITH {RUNS} SELECT run_id, turns % 5 AS bucket, CASE WHEN bool_and(task_id % 97 <> 0) THEN sum(turns) END AS total_tokens FROM runs GROUP BY ALL")
def token_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = runs(spark, d).select("run_id", (F.col("turns") % 5).alias("bucket"), F.when(F.col("task_id") % 97 != 0, F.col("turns")).alias("tokens"))
    return metrics.complete_sum(rows, ["run_id", "bucket"], "tokens")


@query("first_seen_runs", "AG19", f"WITH {RUNS} SELECT run_id, min(task_id) AS first_position FROM runs GROUP BY run_id")
def first_seen_runs(spark: SparkSession, d: str) -> DataFrame:
    return metrics.first_seen(runs(spark, d), "run_id", "task_id")


@query("task_offsets", "MS16", f"WITH {RUNS}, n AS (SELECT run_id, count(*) AS n FROM runs GROUP BY run_id) SELECT run_id, CAST(coalesce(sum(n) OVER (ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS task_offset FROM n")
def task_offsets(spark: SparkSession, d: str) -> DataFrame:
    counted = runs(spark, d).groupBy("run_id").agg(F.count("*").alias("n"))
    before = Window.orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select("run_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("task_offset"))


@query("lineage_continuity", "AU3", f"WITH {RUNS}, s AS (SELECT run_id, count(*) AS \"before\", count(*) + CASE WHEN run_id = '2-HIGH' THEN 1 ELSE 0 END AS after FROM runs GROUP BY run_id), l AS (SELECT run_id, after, lead(\"before\") OVER (ORDER BY run_id) AS ahead FROM s) SELECT * FROM l WHERE ahead IS NOT NULL AND after <> ahead")
def lineage_continuity(spark: SparkSession, d: str) -> DataFrame:
    states = runs(spark, d).groupBy("run_id").agg(F.count("*").alias("before")).withColumn("after", F.col("before") + F.when(F.col("run_id") == "2-HIGH", 1).otherwise(0))
    return audit.broken_lineage(states, "run_id", "before", "after")


@query(
    "run_violations",
    "EV5 AU2",
    f"""WITH {RUNS}, {METRICS}, st AS (SELECT run_id, task_count + CAST(run_id = '1-URGENT' AS INT) AS task_count, completed_count, failure_count - CAST(run_id = '2-HIGH' AS INT) AS failure_count, mean_reward FROM m)
    SELECT run_id, 'task_count' AS rule FROM st JOIN m USING (run_id) WHERE st.task_count <> m.task_count UNION ALL SELECT run_id, 'failure_count' FROM st JOIN m USING (run_id) WHERE st.failure_count <> m.failure_count""",
)
def run_violations(spark: SparkSession, d: str) -> DataFrame:
    found = metrics.run_metrics(runs(spark, d), ["run_id"])
    stored = found.withColumn("task_count", F.col("task_count") + (F.col("run_id") == "1-URGENT").cast("int")).withColumn("failure_count", F.col("failure_count") - (F.col("run_id") == "2-HIGH").cast("int"))
    return audit.run_violations(stored, found)


SCHEDULE = """e AS (SELECT lang AS kind, doc_id AS id, unnest([0, 1, 2]) AS epoch FROM documents), sc AS (SELECT kind, id, epoch, row_number() OVER (PARTITION BY kind ORDER BY epoch, sha256('42:' || epoch || ':' || kind || ':' || id), id) - 1 AS sequence_index FROM e)"""


def examples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("lang").alias("kind"), F.col("doc_id").alias("id"))


@query("epoch_shuffle", "TK10 TK11", f'WITH {SCHEDULE} SELECT kind, id, epoch, sequence_index, sequence_index // 8 AS "window" FROM sc')
def epoch_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return metrics.schedule(examples(spark, d), 3, 42, 8)


@query("opt_windows", "TK11", f'WITH {SCHEDULE} SELECT kind, sequence_index // 8 AS "window", count(*) AS n, min(sequence_index) AS first_index FROM sc GROUP BY ALL')
def opt_windows(spark: SparkSession, d: str) -> DataFrame:
    return metrics.schedule(examples(spark, d), 3, 42, 8).groupBy("kind", "window").agg(F.count("*").alias("n"), F.min("sequence_index").alias("first_index"))


@query("schedule_fingerprint", "AU5")
def schedule_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return metrics.schedule_fingerprint(metrics.schedule(examples(spark, d), 3, 42, 8))


@query("kind_order", "TK14", "SELECT kind, n, row_number() OVER (ORDER BY n, kind) AS place FROM (SELECT lang AS kind, count(*) AS n FROM documents GROUP BY lang)")
def kind_order(spark: SparkSession, d: str) -> DataFrame:
    counted = examples(spark, d).groupBy("kind").agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.orderBy("n", "kind")))


@query("keep_latest", "TK15 ST4", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS r FROM documents) WHERE r <= 3")
def keep_latest(spark: SparkSession, d: str) -> DataFrame:
    return metrics.latest(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 3)


@query("first_tasks", "PRJ34 SRC7", "SELECT o_orderkey AS task_id FROM orders ORDER BY o_orderkey LIMIT 25")
def first_tasks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id")).orderBy("task_id").limit(25)


@query("bootstrap_interval", "AG18")
def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    pairs = runs(spark, d).select(F.col("task_id").alias("id"), (F.col("reward") - 0.5).alias("difference"))
    return metrics.bootstrap_interval(pairs, draws=200)


@query(
    "cell_interaction",
    "AG18",
    f"WITH {RUNS}, {METRICS}, p AS (SELECT max(mean_reward) FILTER (WHERE run_id = '1-URGENT') AS a, max(mean_reward) FILTER (WHERE run_id = '2-HIGH') AS b, max(mean_reward) FILTER (WHERE run_id = '3-MEDIUM') AS c, max(mean_reward) FILTER (WHERE run_id LIKE '4-%') AS d FROM m) SELECT round((d - c) - (b - a), 6) AS interaction FROM p",
)
def cell_interaction(spark: SparkSession, d: str) -> DataFrame:
    cells = metrics.run_metrics(runs(spark, d), ["run_id"]).withColumn("cell", F.substring("run_id", 1, 1))
    return metrics.interaction(cells, "1", "2", "3", "4").select(F.round("interaction", 6).alias("interaction"))


@query("namespaces", "MS2", "SELECT DISTINCT source || CASE WHEN doc_id % 2 = 0 THEN '-debug' ELSE '' END AS namespace, source <> 'src1' AS cross_domain FROM documents")
def namespaces(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.concat("source", F.when(F.col("doc_id") % 2 == 0, "-debug").otherwise("")).alias("namespace"), (F.col("source") != "src1").alias("cross_domain")).distinct()


@query("revisions", "MS14 MS15", "SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE 'g' || doc_id END), ''), nullif(trim(CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'v1' END), ''), source) AS revision FROM documents")
def revisions(spark: SparkSession, d: str) -> DataFrame:
    parts = [F.expr("CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE concat('g', cast(doc_id as string)) END"), F.expr("CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'v1' END"), F.col("source")]
    return table(spark, d, "documents").select("doc_id", F.coalesce(*(F.nullif(F.trim(p), F.lit("")) for p in parts)).alias("revision"))


@query("text_cache_misses", "JN14", "WITH t AS (SELECT doc_id, lang || (doc_id % 50) AS text FROM documents) SELECT DISTINCT text FROM t WHERE text NOT IN (SELECT text FROM t WHERE doc_id % 4 = 0)")
def text_cache_misses(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.concat("lang", (F.col("doc_id") % 50).cast("string")).alias("text"))
    cache = texts.where("pos % 4 = 0").select(F.sha2(F.concat(F.lit("r"), F.lit("\0"), F.col("text")), 256).alias("cache_key"), F.array(F.lit(1.0)).alias("embedding")).dropDuplicates(["cache_key"])
    return retrieval.cache_lookup(texts, cache, "r")[1].select("text")


@query("resumable_kinds", "MS13", "SELECT lang AS kind, count(*) AS n FROM documents WHERE lang NOT IN ('en', 'de') GROUP BY lang")
def resumable_kinds(spark: SparkSession, d: str) -> DataFrame:
    kinds = examples(spark, d).groupBy("kind").agg(F.count("*").alias("n"))
    state = spark.createDataFrame([("en", "completed"), ("de", "completed"), ("fr", "failed")], "kind string, status string")
    return metrics.remaining(kinds, state, "kind")
