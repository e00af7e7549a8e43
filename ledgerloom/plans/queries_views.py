"""Named queries on evidence, training views and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import audit, folding, neardup, views
from ledgerloom.plans.bindings import CREATORS, ITEMS, OBS, memory_items, observations, table
from ledgerloom.plans.queries_memory import FACTS, GROUPS, KEEP, PRIOR, SCORES, scores
from ledgerloom.plans.registry import query

VALUES = f"""{OBS}, {CREATORS}, {KEEP}, {GROUPS}, {SCORES}, {FACTS}, v AS (SELECT memory_id, {PRIOR} * (1 - 1 / sqrt(1 + coalesce(selected_count, 0))) * attribution AS value FROM facts LEFT JOIN s USING (memory_id)),
cand AS (SELECT episode_index % 400 AS episode_id, memory_id, min(rank) AS rank, bool_or(selected) AS selected FROM obs GROUP BY ALL)"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = observations(spark, d).withColumn("episode_id", F.col("episode_index") % 400)
    return rows.groupBy("episode_id", "memory_id").agg(F.min("rank").alias("rank"), F.max("selected").alias("selected"))


def values(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).select("memory_id", "value")


@query(
    "sel_view",
    "EX1 JN5",
    f"WITH {VALUES}, j AS (SELECT episode_id, string_agg(memory_id::VARCHAR, ',' ORDER BY rank, memory_id) AS public_ids, count(value) AS n_scored, max(abs(value)) AS most FROM cand LEFT JOIN v USING (memory_id) GROUP BY episode_id) SELECT episode_id, public_ids, n_scored FROM j WHERE most >= 5",
)
def sel_view(spark: SparkSession, d: str) -> DataFrame:
    out = views.selection_view(candidates(spark, d), values(spark, d), 5.0)
    return out.select("episode_id", F.array_join("public_ids", ",").alias("public_ids"), F.size(F.array_compact("privileged_values")).cast("long").alias("n_scored"))


@query(
    "valuable_selected",
    "TK5 JN5",
    f"WITH {VALUES} SELECT episode_id, memory_id, place FROM (SELECT episode_id, memory_id, row_number() OVER (PARTITION BY episode_id ORDER BY round(value, 9) DESC, rank, memory_id) AS place FROM cand JOIN v USING (memory_id) WHERE selected AND value >= 0.01) WHERE place <= 5",
)
def valuable_selected(spark: SparkSession, d: str) -> DataFrame:
    rounded = values(spark, d).withColumn("value", F.round("value", 9))
    return views.valuable_selected(candidates(spark, d).where("selected"), rounded, 0.01, 5).select("episode_id", "memory_id", "place")


@query(
    "act_view",
    "EX2",
    f"""WITH {VALUES}, ok AS (SELECT conv_id AS episode_id, count(*) AS n_steps FROM conversations WHERE conv_id % 3 = 0 GROUP BY conv_id), b AS (SELECT episode_id, memory_id, row_number() OVER (PARTITION BY episode_id ORDER BY round(value, 9) DESC, rank, memory_id) AS place FROM cand JOIN v USING (memory_id) WHERE selected AND value >= 0.01)
    SELECT ok.episode_id, n_steps, coalesce(string_agg(memory_id::VARCHAR, ',' ORDER BY place), '') AS memories FROM ok LEFT JOIN b ON b.episode_id = ok.episode_id AND place <= 20 GROUP BY ALL""",
)
def act_view(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "conversations").select(F.col("conv_id").alias("episode_id"), "turn")
    episodes = steps.select("episode_id").distinct().withColumn("reward", F.when(F.col("episode_id") % 3 == 0, 1.0).otherwise(0.0))
    best = views.valuable_selected(candidates(spark, d).where("selected"), values(spark, d).withColumn("value", F.round("value", 9)))
    return views.action_view(episodes, steps, best).withColumn("memories", F.array_join("memories", ","))


@query(
    "write_view",
    "EX3 JN5",
    f"WITH {VALUES}, p AS (SELECT memory_id % 40 AS episode_id, memory_id FROM facts WHERE memory_id % 4 <> 1 AND memory_id % 5 <> 2 AND memory_id % 7 <> 3) SELECT episode_id, string_agg(memory_id::VARCHAR, ',' ORDER BY memory_id) AS memories FROM p JOIN v USING (memory_id) WHERE value IS NOT NULL GROUP BY episode_id HAVING max(abs(value)) >= 1",
)
def write_view(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("memory_id")
    rows = observations(spark, d).select("memory_id").distinct().withColumn("episode_id", m % 40)
    rows = rows.withColumn("origin", F.when(m % 4 == 1, "human").otherwise("llm")).withColumn("disposition", F.when(m % 5 == 2, "replayed").otherwise("created")).withColumn("creator_episode", F.when(m % 7 == 3, -1).otherwise(F.col("episode_id")))
    return views.write_view(rows, values(spark, d), 1.0).withColumn("memories", F.array_join("memories", ","))


@query(
    "maint_diagnostics",
    "TK6 EX4",
    f"""WITH {ITEMS}, r AS (SELECT id, CASE WHEN id % 6 = 0 THEN NULL ELSE (id * 37 % 101) / 10.0 END AS value, usage_count FROM items), b AS (
    SELECT id, (row_number() OVER (ORDER BY value DESC NULLS LAST, id) - 1) * 4 AS turn FROM r UNION ALL SELECT id, (row_number() OVER (ORDER BY value ASC NULLS LAST, id) - 1) * 4 + 1 FROM r
    UNION ALL SELECT id, (row_number() OVER (ORDER BY usage_count DESC, id) - 1) * 4 + 2 FROM r UNION ALL SELECT id, (row_number() OVER (ORDER BY id) - 1) * 4 + 3 FROM r WHERE id % 50 = 7), m AS (SELECT id, min(turn) AS turn FROM b GROUP BY id)
    SELECT id FROM m ORDER BY m.turn LIMIT 40""",
)
def maint_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    rows = memory_items(spark, d).select("id", F.expr("CASE WHEN id % 6 = 0 THEN NULL ELSE (id * 37 % 101) / 10.0D END").alias("value"), "usage_count")
    ends = rows.where("id % 50 = 7").select("id", F.floor(F.col("id") / 50).alias("position"))
    return neardup.sampled_buckets(rows, ends, 40)


@query(
    "prior_history",
    "JN8 AG13",
    """WITH e AS (SELECT event_id AS position, CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END AS reward FROM events), r AS (SELECT CAST(range * 100 AS BIGINT) AS position, range AS round FROM range(1, 40))
    SELECT round, (SELECT count(*) FROM e WHERE e.position <= r.position) AS prior, (SELECT count(*) FROM e WHERE e.position <= r.position AND reward = 1) AS succeeded FROM r""",
)
def prior_history(spark: SparkSession, d: str) -> DataFrame:
    episodes = table(spark, d, "events").select(F.col("event_id").alias("position"), F.when(F.col("event_id") % 3 == 0, 1.0).otherwise(0.0).alias("reward"))
    rounds = spark.range(1, 40).select((F.col("id") * 100).alias("position"), F.col("id").alias("round"))
    return views.prior_counts(rounds, episodes)


@query(
    "skip_reasons",
    "AG9",
    """WITH e AS (SELECT conv_id, conv_id % 4 AS c, conv_id % 3 AS s, CASE WHEN conv_id % 5 < 3 THEN 1.0 ELSE 0.0 END AS reward, CASE WHEN conv_id % 6 = 0 THEN 0 ELSE 1 END AS n FROM (SELECT DISTINCT conv_id FROM conversations)), x AS (
    SELECT 'sel_no_candidates' AS reason FROM e WHERE c = 0 UNION ALL SELECT 'sel_no_scored_candidate' FROM e WHERE c > 0 AND s = 0 UNION ALL SELECT 'act_not_successful' FROM e WHERE reward <> 1 UNION ALL SELECT 'act_no_trajectory' FROM e WHERE reward = 1 AND n = 0)
    SELECT reason, count(*) AS n FROM x GROUP BY reason""",
)
def skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("conv_id")
    rows = table(spark, d, "conversations").select("conv_id").distinct()
    rows = rows.select((c % 4).alias("n_candidates"), (c % 3).alias("n_scored"), F.when(c % 5 < 3, 1.0).otherwise(0.0).alias("reward"), F.when(c % 6 == 0, 0).otherwise(1).alias("n_steps"))
    return views.skip_reasons(rows)


SNAP = f"{OBS}, snap AS (SELECT DISTINCT memory_id AS id, version, tier, 'content ' || memory_id AS content FROM obs WHERE memory_id % 10 <> 0), ca AS (SELECT episode_index, memory_id, version + CAST(memory_id % 7 = 0 AS INT) AS version, CASE WHEN memory_id % 11 = 0 THEN 'none' ELSE tier END AS tier FROM obs)"


@query(
    "candidate_snapshot",
    "JN1",
    f"""WITH {SNAP} SELECT episode_index, memory_id, sha256(content) AS content_sha256, CASE WHEN snap.id IS NULL THEN 'not_in_snapshot' WHEN ca.version <> snap.version THEN 'version_differs' WHEN ca.tier <> snap.tier THEN 'tier_differs' END AS error
    FROM ca LEFT JOIN snap ON ca.memory_id = snap.id""",
)
def candidate_snapshot(spark: SparkSession, d: str) -> DataFrame:
    obs = observations(spark, d)
    snap = obs.where("memory_id % 10 <> 0").select(F.col("memory_id").alias("id"), "version", "tier", F.concat(F.lit("content "), F.col("memory_id").cast("string")).alias("content")).distinct()
    rows = obs.select("episode_index", "memory_id", (F.col("version") + (F.col("memory_id") % 7 == 0).cast("int")).alias("version"), F.when(F.col("memory_id") % 11 == 0, "none").otherwise(F.col("tier")).alias("tier"))
    return views.with_snapshot(rows, snap).select("episode_index", "memory_id", "content_sha256", "error")


@query("prefix_matches", "JN2", "SELECT doc_id AS id, doc_id % 10 <> 3 AND (doc_id % 2 = 0 OR length(text) > 0) AS matches FROM documents")
def prefix_matches(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    shown = F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("\u0001"), F.substring("text", 1, 100))).when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.substring("text", 1, 320))
    return views.prefix_matched(docs.select(F.col("doc_id").alias("id"), shown.alias("shown")), docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content")))


@query("selected_outside", "JN3", f"WITH {OBS}, c AS (SELECT DISTINCT episode_index % 50 AS e, memory_id FROM obs WHERE rank % 3 <> 0) SELECT DISTINCT episode_index % 50 AS e, memory_id FROM obs WHERE selected AND (episode_index % 50, memory_id) NOT IN (SELECT (e, memory_id) FROM c)")
def selected_outside(spark: SparkSession, d: str) -> DataFrame:
    rows = observations(spark, d).withColumn("e", F.col("episode_index") % 50)
    return views.missing_from(rows.where("selected"), rows.where("rank % 3 <> 0"), ["e", "memory_id"])


@query("outside_split", "JN12", "SELECT DISTINCT o_orderkey AS task_id FROM orders WHERE o_orderkey % 13 = 0")
def outside_split(spark: SparkSession, d: str) -> DataFrame:
    tasks = table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"))
    return views.missing_from(tasks, tasks.where("task_id % 13 <> 0"), ["task_id"])


@query(
    "write_errors",
    "JN4",
    """WITH w AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'created' ELSE 'replayed' END AS disposition FROM documents) SELECT id, CASE WHEN disposition = 'created' AND id % 3 = 0 THEN 'created_but_known' WHEN disposition = 'replayed' AND id % 3 <> 0 THEN 'replayed_but_unknown' WHEN id % 5 = 0 THEN 'not_stored' ELSE 'content_differs' END AS error
    FROM w WHERE (disposition = 'created' AND id % 3 = 0) OR (disposition = 'replayed' AND id % 3 <> 0) OR id % 5 = 0 OR id % 7 = 0""",
)
def write_errors(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("content"))
    written = docs.withColumn("disposition", F.when(F.col("id") % 2 == 0, "created").otherwise("replayed"))
    after = docs.where("id % 5 <> 0").withColumn("content", F.when(F.col("id") % 7 == 0, "other").otherwise(F.col("content")))
    return views.write_errors(written, docs.where("id % 3 = 0"), after)


@query("boundary_errors", "EX5", "SELECT doc_id AS example_id, unnest(CASE WHEN doc_id % 4 = 0 THEN ['id_sets_differ'] ELSE [] END || CASE WHEN doc_id % 6 = 1 THEN ['memory_text_public'] ELSE [] END) AS error FROM documents")
def boundary_errors(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select(i.alias("example_id"), F.array(i, i + 1).alias("public_ids"), F.when(i % 4 == 0, F.array(i)).otherwise(F.array(i + 1, i, i)).alias("privileged_ids"), F.concat(F.lit("told: "), F.when(i % 6 == 1, F.lit("secret memory")).otherwise(F.lit("nothing"))).alias("public_text"), F.array(F.lit("secret memory"), F.lit("")).alias("memory_texts"))
    return views.boundary_errors(rows)


@query(
    "tool_compatibility",
    "PRJ29 PRJ30",
    """SELECT event_id AS id, CASE WHEN event_id % 6 = 5 THEN '' WHEN event_id % 6 = 4 THEN 'fly' ELSE event_type END AS tool_name, CASE WHEN event_id % 6 = 5 THEN 'invalid_tool_memory' WHEN event_id % 6 = 4 OR event_type = 'error' THEN 'unavailable_tool' WHEN event_id % 3 = 0 THEN 'incompatible_schema' END AS reason FROM events""",
)
def tool_compatibility(spark: SparkSession, d: str) -> DataFrame:
    registry = spark.createDataFrame([(t, ["amount", "note"], ["amount"]) for t in ("signup", "click", "view", "purchase")], "tool_name string, declared array<string>, required array<string>")
    name = F.expr("CASE WHEN event_id % 6 = 5 THEN '' WHEN event_id % 6 = 4 THEN 'fly' ELSE event_type END")
    arguments = F.expr("CASE WHEN event_id % 3 = 0 THEN array('note') ELSE array('amount') END")
    return views.tool_compatibility(table(spark, d, "events").select(F.col("event_id").alias("id"), name.alias("tool_name"), arguments.alias("arguments")), registry)


@query(
    "injected_tools",
    "MS8",
    """WITH r AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)
    SELECT source AS tool_name, 'about ' || source || chr(10) || string_agg(substr(text, 1, 1600), chr(10) ORDER BY doc_id) AS description FROM r WHERE r <= 3 GROUP BY source""",
)
def injected_tools(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    tools = docs.select(F.col("source").alias("tool_name")).distinct().withColumn("description", F.concat(F.lit("about "), "tool_name"))
    return views.injected_tools(tools, docs.select(F.col("source").alias("tool_name"), F.col("doc_id").alias("rank"), "text"))


@query("payload_violations", "MS10", "SELECT doc_id, unnest(CASE WHEN doc_id % 3 = 0 THEN ['blank'] ELSE [] END || CASE WHEN doc_id % 4 = 0 THEN ['order'] ELSE [] END || CASE WHEN doc_id % 5 = 0 THEN ['multi_step'] ELSE [] END || CASE WHEN doc_id % 7 = 0 THEN ['repeated_value'] ELSE [] END) AS rule FROM documents")
def payload_violations(spark: SparkSession, d: str) -> DataFrame:
    from ledgerloom.operators.payloads import violations

    i = F.col("doc_id")
    rows = table(spark, d, "documents").select(
        "doc_id", F.when(i % 3 == 0, F.lit(" ")).otherwise(F.lit("said")).alias("text"), F.when(i % 4 == 0, F.array(F.lit(1), F.lit(3))).otherwise(F.array(F.lit(1), F.lit(2))).alias("orders"),
        F.when(i % 5 == 0, F.lit("1. go\n2. stop")).otherwise(F.lit("go")).alias("guidance"), F.when(i % 7 == 0, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"))).alias("values"),
    )
    return violations(rows, "doc_id")


@query("review_violations", "MS6", f"WITH {ITEMS} SELECT id, CASE WHEN id >= 300 THEN 'not_shown' ELSE 'repeated' END AS rule FROM items WHERE id >= 300 OR id % 9 = 0")
def review_violations(spark: SparkSession, d: str) -> DataFrame:
    from ledgerloom.operators.payloads import review_violations as check

    items = memory_items(spark, d).select("id")
    return check(items.unionByName(items.where("id % 9 = 0 and id < 300")), items.where("id < 300"))


@query("proposal_rows", "MS11", f"SELECT doc_id AS episode_index, 'mem_' || lang || '_' || substr(sha256(lang || chr(0) || source), 1, 20) AS id, source AS content, 'llm' AS origin FROM documents")
def proposal_rows(spark: SparkSession, d: str) -> DataFrame:
    from ledgerloom.functions.kernels import stable_id

    return table(spark, d, "documents").select(F.col("doc_id").alias("episode_index"), stable_id(F.col("lang"), F.col("source")).alias("id"), F.col("source").alias("content"), F.lit("llm").alias("origin"))


@query("dup_keys", "SET4", "SELECT md5(text) AS key, count(*) AS times FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_keys(spark: SparkSession, d: str) -> DataFrame:
    return audit.duplicates(table(spark, d, "documents").select(F.md5("text").alias("key")), ["key"])


@query("set_coverage", "SET2", "WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey % 5 <> 0), e AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 7 <> 0) SELECT k, 'missing' AS side FROM e WHERE k NOT IN (SELECT k FROM a) UNION ALL SELECT k, 'unexpected' FROM a WHERE k NOT IN (SELECT k FROM e)")
def set_coverage(spark: SparkSession, d: str) -> DataFrame:
    actual = table(spark, d, "lineitem").where("l_orderkey % 5 <> 0").select(F.col("l_orderkey").alias("k"))
    return audit.set_coverage(actual, table(spark, d, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("k")), "k")


@query("evidence_union", "SET1", "SELECT 'episode' AS kind, conv_id AS key, count(*) AS turns, -1 AS round FROM conversations GROUP BY conv_id UNION ALL SELECT 'maintenance', range, -1, range FROM range(20)")
def evidence_union(spark: SparkSession, d: str) -> DataFrame:
    episodes = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("key")).agg(F.count("*").alias("turns")).withColumn("kind", F.lit("episode"))
    rounds = spark.range(20).select(F.lit("maintenance").alias("kind"), F.col("id").alias("key"), F.col("id").alias("round"))
    return episodes.unionByName(rounds, allowMissingColumns=True).fillna(-1, ["turns", "round"])


@query("recompute_compare", "AU2", "WITH m AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT source, n, 'missing' AS side FROM m WHERE source IN ('src1', 'src2') UNION ALL SELECT source, n + 1, 'unexpected' FROM m WHERE source IN ('src1', 'src2')")
def recompute_compare(spark: SparkSession, d: str) -> DataFrame:
    counted = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return audit.differing(counted, counted.withColumn("n", F.col("n") + F.col("source").isin("src1", "src2").cast("int")))


@query(
    "audit_errors",
    "AU1",
    "SELECT 'duplicate_logical_sample' AS code, 'documents' AS artifact, md5(text) AS message FROM documents GROUP BY text HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'task_level_sample_coverage', 'conversations', CAST(conv_id AS VARCHAR) FROM conversations GROUP BY conv_id HAVING count(*) <> max(turn) + 1 UNION ALL SELECT 'duplicate_memory_score', 'scores', CAST(label AS VARCHAR) FROM embeddings GROUP BY label HAVING count(*) > 1",
)
def audit_errors(spark: SparkSession, d: str) -> DataFrame:
    repeated = audit.duplicates(table(spark, d, "documents").select(F.md5("text").alias("message")), ["message"])
    gaps = folding.contiguous(table(spark, d, "conversations"), ["conv_id"], "turn").where("not contiguous").select(F.col("conv_id").alias("message"))
    labels = audit.duplicates(table(spark, d, "embeddings").select(F.col("label").alias("message")), ["message"])
    return audit.errors(("duplicate_logical_sample", "documents", repeated), ("task_level_sample_coverage", "conversations", gaps), ("duplicate_memory_score", "scores", labels))
