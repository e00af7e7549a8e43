"""Named queries on memories: attribution, retrieval, near duplicates, pages, commands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import kernels as k
from ledgerloom.operators import attribution, metrics, mutations, neardup, retrieval
from ledgerloom.plans.bindings import CREATORS, ITEMS, OBS, creators, memory_items, observations, table
from ledgerloom.plans.registry import query

KEEP = "keep AS (SELECT o.* FROM obs o LEFT JOIN creators c USING (memory_id) WHERE c.creator_index IS NULL OR o.episode_index > c.creator_index)"
GROUPS = """g AS (SELECT memory_id, task_group, count(*) FILTER (WHERE selected) AS n_selected, count(*) FILTER (WHERE NOT selected) AS n_control,
    avg(reward) FILTER (WHERE selected) AS mean_selected, avg(reward) FILTER (WHERE NOT selected) AS mean_control FROM keep GROUP BY 1, 2)"""
SCORES = """s AS (SELECT memory_id, CAST(sum(n_selected + n_control) AS BIGINT) AS retrieved_count, CAST(sum(n_selected) AS BIGINT) AS selected_count,
    sum(CASE WHEN n_selected > 0 AND n_control > 0 THEN n_selected / (n_selected + n_control) * (mean_selected - mean_control) END) AS attribution FROM g GROUP BY 1)"""
PRIOR = "CASE tier WHEN 'trajectory' THEN 0.9 WHEN 'tip' THEN 0.8 WHEN 'skill' THEN 1.0 ELSE 1.2 END"
FACTS = "facts AS (SELECT DISTINCT memory_id, tier FROM obs)"


@query("attr_antileak", "JN9", f"WITH {OBS}, {CREATORS}, {KEEP} SELECT memory_id, count(*) AS n, min(episode_index) AS first_episode FROM keep GROUP BY 1")
def attr_antileak(spark: SparkSession, d: str) -> DataFrame:
    kept = attribution.after_creation(observations(spark, d), creators(spark, d))
    return kept.groupBy("memory_id").agg(F.count("*").alias("n"), F.min("episode_index").alias("first_episode"))


@query(
    "attr_group_scores",
    "AG1 AG2",
    f"""WITH {OBS}, {CREATORS}, {KEEP}, {GROUPS} SELECT memory_id, task_group, n_selected, n_control, round(mean_selected, 6) AS mean_selected, round(mean_control, 6) AS mean_control,
    round(CASE WHEN n_selected > 0 AND n_control > 0 THEN n_selected / (n_selected + n_control) * (mean_selected - mean_control) END, 6) AS contribution FROM g""",
)
def attr_group_scores(spark: SparkSession, d: str) -> DataFrame:
    g = attribution.group_scores(attribution.after_creation(observations(spark, d), creators(spark, d)))
    return g.select("memory_id", "task_group", "n_selected", "n_control", *(F.round(c, 6).alias(c) for c in ("mean_selected", "mean_control", "contribution")))


def scores(spark: SparkSession, d: str) -> DataFrame:
    obs = observations(spark, d)
    groups = attribution.group_scores(attribution.after_creation(obs, creators(spark, d)))
    return attribution.memory_scores(groups, obs.select("memory_id", "tier").distinct(), attribution.prior_of(F.col("tier")))


@query(
    "attr_memory_scores",
    "AG3 JN9 JN5",
    f"""WITH {OBS}, {CREATORS}, {KEEP}, {GROUPS}, {SCORES}, {FACTS} SELECT f.memory_id, f.tier, coalesce(retrieved_count, 0) AS retrieved_count, coalesce(selected_count, 0) AS selected_count,
    round(attribution, 6) AS attribution, round(1 - 1 / sqrt(1 + coalesce(selected_count, 0)), 6) AS confidence, round({PRIOR} * (1 - 1 / sqrt(1 + coalesce(selected_count, 0))) * attribution, 6) AS value,
    CASE WHEN attribution IS NULL THEN 'insufficient_evidence' ELSE 'scored' END AS status FROM facts f LEFT JOIN s USING (memory_id)""",
)
def attr_memory_scores(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).select("memory_id", "tier", "retrieved_count", "selected_count", *(F.round(c, 6).alias(c) for c in ("attribution", "confidence", "value")), "status")


@query(
    "attr_memory_facts",
    "AG4",
    f"""WITH {OBS}, {CREATORS}, allof AS (SELECT memory_id, tier, version, NULL::BIGINT AS c FROM obs UNION ALL SELECT o.memory_id, o.tier, 9, c.creator_index FROM obs o JOIN creators c USING (memory_id))
    SELECT memory_id, min(tier) AS tier, array_to_string(list_sort(list_distinct(list(version))), ',') AS versions, coalesce(min(c), -1) AS creator_index, count(DISTINCT tier) = 1 AND count(DISTINCT c) <= 1 AS consistent FROM allof GROUP BY 1""",
)
def attr_memory_facts(spark: SparkSession, d: str) -> DataFrame:
    obs = observations(spark, d)
    seen = obs.select("memory_id", "tier", "version", F.lit(None).cast("long").alias("creator_index"))
    made = obs.select("memory_id", "tier", F.lit(9).alias("version")).join(creators(spark, d), "memory_id")
    facts = attribution.memory_facts(seen, made).withColumn("versions", F.concat_ws(",", F.transform("versions", lambda v: v.cast("string"))))
    return facts.withColumn("creator_index", F.coalesce("creator_index", F.lit(-1)))


@query("attr_chronology", "AU4", f"WITH {OBS}, {CREATORS} SELECT memory_id, episode_index, creator_index FROM obs JOIN creators USING (memory_id) WHERE episode_index <= creator_index")
def attr_chronology(spark: SparkSession, d: str) -> DataFrame:
    return attribution.chronology_violations(observations(spark, d), creators(spark, d))


ELIGIBLE = "status = 'active' AND NOT (polarity = 'caution' AND tier IN ('skill', 'tool')) AND revision = 'rev-0'"
SIMILAR = f"q AS (SELECT id AS query_id, vector AS qv FROM items WHERE id % 100 = 0), c AS (SELECT query_id, id, tier, vector, list_cosine_similarity(qv, vector) AS similarity FROM items, q WHERE {ELIGIBLE})"


def searches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every hundredth item as a query, and the eligible items with fresh vectors."""
    items = memory_items(spark, d)
    ok = k.eligible(F.col("polarity"), F.col("tier")) & (F.col("status") == "active") & (F.col("revision") == "rev-0") & k.valid_vector(F.col("vector"), 64)
    return items.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector"), items.where(ok).select("id", "tier", "vector")


@query(
    "retrieve_topk",
    "TK1 PRJ6",
    f"WITH {ITEMS}, {SIMILAR} SELECT query_id, id, tier, round(similarity, 5) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM c) WHERE rank <= 10",
)
def retrieve_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.nearest(*searches(spark, d), 10, ("tier",)).select("query_id", "id", "tier", F.round("similarity", 5).alias("similarity"), "rank")


POOL = "p AS (SELECT query_id, id, tier, list_transform(vector, lambda x: x / sqrt(list_dot_product(vector, vector))) AS vector, similarity FROM c)"
NONE = "none AS (SELECT query_id, id, vector, 0 AS rank FROM p WHERE false)"


def _picks(name: str, chosen: str, pool: str, n: int, weight: float) -> tuple[str, str]:
    """Greedy picks as one table expression for each step; gives them and the name of the last."""
    out = []
    for step in range(n):
        near = f"SELECT a.query_id, a.id, a.vector, a.similarity, max(list_cosine_similarity(a.vector, b.vector)) AS near, count(b.id) AS n FROM {pool} a LEFT JOIN {chosen} b ON a.query_id = b.query_id WHERE NOT EXISTS (FROM {chosen} x WHERE x.query_id = a.query_id AND x.id = a.id) GROUP BY ALL"
        best = f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {weight} * similarity - {1 - weight} * coalesce(near, 0) DESC, similarity DESC, id) AS r FROM ({near})"
        out.append(f"{name}{step} AS (SELECT query_id, id, vector, rank FROM {chosen} UNION ALL SELECT query_id, id, vector, n + 1 FROM ({best}) WHERE r = 1)")
        chosen = f"{name}{step}"
    return ", ".join(out), chosen


def _tiered_sql() -> str:
    quotas, lambdas, parts, last = {"skill": 2, "tip": 2, "tool": 1, "trajectory": 1}, retrieval.LAMBDAS, [], []
    for tier in k.RETRIEVAL_ORDER:
        parts.append(f"pool_{tier} AS (SELECT * FROM p WHERE tier = '{tier}')")
        steps, name = _picks(f"s_{tier}", "none", f"pool_{tier}", quotas[tier], lambdas[tier])
        parts.append(steps)
        last.append(name)
    union = " UNION ALL ".join(f"SELECT query_id, id, vector, {i} AS phase, rank FROM {name}" for i, name in enumerate(last))
    parts.append(f"picked AS (SELECT query_id, id, vector, row_number() OVER (PARTITION BY query_id ORDER BY phase, rank) AS rank FROM ({union}))")
    steps, name = _picks("g", "picked", "p", 2, retrieval.GLOBAL_LAMBDA)
    return f"WITH {ITEMS}, {SIMILAR}, {POOL}, {NONE}, {', '.join(parts)}, {steps} SELECT query_id, id, rank FROM {name}"


@query("retrieve_mmr", "TK2", "WITH {}, {}, {}, {}, {} SELECT query_id, id, rank FROM {}".format(ITEMS, SIMILAR, POOL, NONE, *_picks("m", "none", "p", 5, 0.65)))
def retrieve_mmr(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.mmr_over(*searches(spark, d), 5, 0.65)


@query("retrieve_tiered", "TK3", _tiered_sql())
def retrieve_tiered(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.tiered_over(*searches(spark, d), 8, {"tip": 2, "skill": 2, "tool": 1, "trajectory": 1})


QUOTA_ROWS = "(VALUES ('tip', 18), ('skill', 18), ('tool', 6), ('trajectory', 4)) AS t(tier, quota)"


@query(
    "quota_scaling",
    "TK4",
    f"""WITH t AS (SELECT * FROM {QUOTA_ROWS}), b AS (SELECT tier, (quota * 25) // sum(quota) OVER () AS base, (quota * 25) % sum(quota) OVER () AS rest FROM t)
    SELECT tier, CAST(base + CASE WHEN row_number() OVER (ORDER BY rest DESC, tier) <= 25 - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS scaled FROM b""",
)
def quota_scaling(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.scaled_quota_table(spark.sql("SELECT * FROM VALUES ('tip', 18), ('skill', 18), ('tool', 6), ('trajectory', 4) AS t(tier, quota)"), 25)


PAIRS = "pairs AS (SELECT a.id AS left_id, b.id AS right_id, a.tier, list_cosine_similarity(a.vector, b.vector) AS similarity FROM items a JOIN items b ON a.tier = b.tier AND a.id < b.id WHERE a.status = 'active' AND b.status = 'active')"


@query("neardup_pairs", "JN6", f"WITH {ITEMS}, {PAIRS} SELECT left_id, right_id, tier, round(similarity, 5) AS similarity FROM pairs WHERE similarity >= 0.3")
def neardup_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = neardup.near_pairs(memory_items(spark, d).where("status = 'active'"), 0.3, ["tier"])
    return pairs.select("left_id", "right_id", "tier", F.round("similarity", 5).alias("similarity"))


@query("neardup_blocked", "JN6 JN7", f"WITH {ITEMS} SELECT a.id AS left_id, b.id AS right_id, round(list_cosine_similarity(a.vector, b.vector), 5) AS similarity FROM items a JOIN items b ON a.id < b.id WHERE list_cosine_similarity(a.vector, b.vector) >= 0.35")
def neardup_blocked(spark: SparkSession, d: str) -> DataFrame:
    pairs = neardup.near_pairs(memory_items(spark, d), 0.35, [])
    return pairs.select("left_id", "right_id", F.round("similarity", 5).alias("similarity"))


@query(
    "redundancy_pairs",
    "JN7",
    f"""WITH {ITEMS}, p AS (SELECT a.id AS left_id, b.id AS right_id, greatest(-1.0, least(1.0, list_cosine_similarity(a.vector, b.vector))) AS similarity FROM items a JOIN items b ON a.revision = b.revision AND a.id < b.id)
    SELECT left_id, right_id, round(similarity, 5) AS similarity FROM p ORDER BY p.similarity DESC, left_id, right_id LIMIT 50""",
)
def redundancy_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = neardup.near_pairs(memory_items(spark, d), -1.0, ["revision"], best=50)
    return pairs.select("left_id", "right_id", F.round("similarity", 5).alias("similarity"))


TOP_PAIRS = "top AS (SELECT * FROM pairs ORDER BY similarity DESC, left_id, right_id LIMIT 24)"
ENDS = """ends AS (SELECT id, row_number() OVER (ORDER BY min(turn)) - 1 AS position FROM (SELECT left_id AS id, 2 * row_number() OVER (ORDER BY similarity DESC, left_id, right_id) AS turn FROM top
    UNION ALL SELECT right_id, 2 * row_number() OVER (ORDER BY similarity DESC, left_id, right_id) + 1 FROM top) GROUP BY id)"""


def top_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return neardup.endpoints(neardup.near_pairs(memory_items(spark, d).where("status = 'active'"), -1.0, ["tier"], best=24))


@query("neardup_endpoints", "JN6", f"WITH {ITEMS}, {PAIRS}, {TOP_PAIRS}, {ENDS} SELECT * FROM ends")
def neardup_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return top_endpoints(spark, d)


PAGE = """page AS (SELECT id, tier, ((pos - coalesce(start, 0)) % n + n) % n AS position FROM (
    SELECT *, max(CASE WHEN id = 101 THEN pos + 1 END) OVER (PARTITION BY tier) AS start FROM (SELECT id, tier, row_number() OVER (PARTITION BY tier ORDER BY id) - 1 AS pos, count(*) OVER (PARTITION BY tier) AS n FROM items)) WHERE position < 12)"""


def page(spark: SparkSession, d: str) -> DataFrame:
    return neardup.rotating_page(memory_items(spark, d).select("id", "tier"), "tier", F.lit(101), 12)


@query("page_rotate", "TK7 ST5", f"WITH {ITEMS}, {PAGE} SELECT id, tier, position FROM page")
def page_rotate(spark: SparkSession, d: str) -> DataFrame:
    return page(spark, d)


@query(
    "page_priority",
    "TK8",
    f"""WITH {ITEMS}, {PAIRS}, {TOP_PAIRS}, {ENDS}, {PAGE}, f AS (SELECT id, min(turn) AS turn FROM (SELECT id, position AS turn FROM ends UNION ALL SELECT id, 100000 + position FROM page WHERE tier = 'tip') GROUP BY id)
    SELECT id, row_number() OVER (ORDER BY turn, id) - 1 AS position FROM f ORDER BY turn, id LIMIT 30""",
)
def page_priority(spark: SparkSession, d: str) -> DataFrame:
    return neardup.priority_page(top_endpoints(spark, d), page(spark, d).where("tier = 'tip'"), 30)


@query("representative", "TK9", f"WITH {ITEMS} SELECT content, arg_max(id, (success_count, usage_count, updated_round, version, id)) AS representative FROM items GROUP BY content")
def representative(spark: SparkSession, d: str) -> DataFrame:
    return neardup.representative(memory_items(spark, d), "content")


@query("vector_validity", "PRJ7 PRJ8", f"WITH {ITEMS} SELECT id, len(vector) = 64 AND list_dot_product(vector, vector) > 0 AS valid, revision <> 'rev-0' OR NOT (len(vector) = 64 AND list_dot_product(vector, vector) > 0) AS stale FROM items")
def vector_validity(spark: SparkSession, d: str) -> DataFrame:
    valid = k.valid_vector(F.col("vector"), 64)
    return memory_items(spark, d).select("id", valid.alias("valid"), ((F.col("revision") != "rev-0") | ~valid).alias("stale"))


@query(
    "polarity_labels",
    "PRJ5 PRJ6",
    f"""WITH {ITEMS}, l AS (SELECT id, tier, CASE WHEN id % 4 = 0 THEN polarity ELSE 'unknown' END AS p, CASE WHEN id % 3 = 0 THEN 'success' ELSE 'strange' END AS o, CASE WHEN id % 2 = 0 THEN usage_count / 6.0 END AS r FROM items),
    m AS (SELECT id, tier, CASE WHEN p IN ('positive', 'caution') AND o = 'success' THEN p WHEN r IS NOT NULL AND abs(r - 1) > 1e-12 THEN 'caution' ELSE 'positive' END AS polarity,
    CASE WHEN p IN ('positive', 'caution') AND o = 'success' THEN o WHEN r IS NOT NULL AND abs(r - 1) > 1e-12 THEN 'task_failure' ELSE 'success' END AS outcome FROM l)
    SELECT id, polarity, outcome, NOT (polarity = 'caution' AND tier IN ('skill', 'tool')) AS eligible FROM m""",
)
def polarity_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = memory_items(spark, d).select("id", "tier", F.expr("CASE WHEN id % 4 = 0 THEN polarity ELSE 'unknown' END").alias("p"), F.expr("CASE WHEN id % 3 = 0 THEN 'success' ELSE 'strange' END").alias("o"), F.expr("CASE WHEN id % 2 = 0 THEN usage_count / 6.0D END").alias("r"))
    rows = rows.withColumn("l", k.outcome_labels(F.col("p"), F.col("o"), F.col("r")))
    return rows.select("id", "l.polarity", "l.outcome", k.eligible(F.col("l.polarity"), F.col("tier")).alias("eligible"))


@query("items_by_tier", "PRJ3 SRC3", f"WITH {ITEMS} SELECT id, version FROM items WHERE tier = 'tip' AND status = 'active'")
def items_by_tier(spark: SparkSession, d: str) -> DataFrame:
    return memory_items(spark, d).where("tier = 'tip' and status = 'active'").select("id", "version").orderBy("id")


@query("item_lookup", "PRJ4", f"WITH {ITEMS} SELECT id, tier, content FROM items WHERE id = 77")
def item_lookup(spark: SparkSession, d: str) -> DataFrame:
    return memory_items(spark, d).where("id = 77").select("id", "tier", "content")


@query("active_by_tier", "AG8", f"WITH {ITEMS}, t AS (SELECT unnest(['trajectory', 'tip', 'skill', 'tool', 'none']) AS tier) SELECT tier, count(id) FILTER (WHERE status = 'active') AS n FROM t LEFT JOIN items USING (tier) GROUP BY tier")
def active_by_tier(spark: SparkSession, d: str) -> DataFrame:
    tiers = spark.createDataFrame([(t,) for t in (*k.TIERS, "none")], "tier string")
    return metrics.tier_counts(memory_items(spark, d), tiers, F.col("status") == "active")


@query("added_items", "MUT1", f"WITH {ITEMS}, n AS (SELECT id + 200 AS id, content FROM items) SELECT id, content, id IN (SELECT id FROM items) AS rejected FROM n")
def added_items(spark: SparkSession, d: str) -> DataFrame:
    items = memory_items(spark, d).select("id", "content")
    new = items.select((F.col("id") + 200).alias("id"), "content")
    state, rejected = mutations.added(items, new)
    kept = state.exceptAll(items).withColumn("rejected", F.lit(False))
    return kept.unionByName(rejected.withColumn("rejected", F.lit(True)).select(kept.columns))


@query("lookup_command", "MUT2", f"WITH {ITEMS}, c AS (SELECT range AS pos, range * 37 AS id FROM range(20)) SELECT pos, c.id, CASE WHEN status = 'active' THEN content END AS content, coalesce(status = 'active', false) AS found FROM c LEFT JOIN items USING (id)")
def lookup_command(spark: SparkSession, d: str) -> DataFrame:
    command = spark.range(20).select(F.col("id").alias("pos"), (F.col("id") * 37).alias("id"))
    return mutations.looked_up(memory_items(spark, d), command)


@query(
    "soft_delete",
    "MUT3 PRJ33",
    f"""WITH {ITEMS}, i AS (SELECT id, status, version, updated_round, CASE WHEN status = 'retired' THEN 'old' END AS reason FROM items), c AS (SELECT id, CAST(5 AS INT) AS r, CASE WHEN id % 2 = 0 THEN 'old' ELSE 'unused' END AS why FROM i WHERE id % 3 = 0),
    x AS (SELECT i.*, c.r, c.why, c.r IS NOT NULL AND NOT (status = 'retired' AND updated_round = c.r AND coalesce(reason = c.why, false)) AS due FROM i LEFT JOIN c USING (id))
    SELECT id, CASE WHEN due THEN 'retired' ELSE status END AS status, version + CAST(due AS INT) AS version, CASE WHEN due THEN greatest(updated_round, r) ELSE updated_round END AS updated_round, CASE WHEN due THEN why ELSE reason END AS reason FROM x""",
)
def soft_delete(spark: SparkSession, d: str) -> DataFrame:
    items = memory_items(spark, d).select("id", "status", "version", "updated_round", F.expr("CASE WHEN status = 'retired' THEN 'old' END").alias("reason"))
    commands = items.where("id % 3 = 0").select("id", F.lit(5).alias("updated_round"), F.expr("CASE WHEN id % 2 = 0 THEN 'old' ELSE 'unused' END").alias("reason"))
    return mutations.retired(items, commands)


MERGE = f"""{ITEMS}, i AS (SELECT *, 'task-' || (id % 6) AS task FROM items WHERE status = 'active' AND tier = 'tip'), m AS (SELECT label AS merge_id, * FROM i),
n AS (SELECT merge_id, min(tier) AS tier, array_to_string(list_sort(list_distinct(list(task))), ',') AS tasks, array_to_string(list_sort(list_distinct(list(id))), ',') AS merged_from FROM m GROUP BY merge_id)"""


@query("merge_provenance", "MUT4 AG12", f"WITH {MERGE} SELECT merge_id, tier, tasks, merged_from, 5 AS created_round, 1 AS version FROM n")
def merge_provenance(spark: SparkSession, d: str) -> DataFrame:
    new, _ = _merge(spark, d)
    return new.select("merge_id", "tier", F.concat_ws(",", "source_task_ids").alias("tasks"), F.concat_ws(",", F.transform("merged_from", lambda x: x.cast("string"))).alias("merged_from"), "created_round", "version")


@query("merge_sources_after", "MUT4 MUT5", f"WITH {MERGE} SELECT id AS source_id, version + 1 AS version, greatest(updated_round, 5) AS updated_round, 'merged into ' || (900000 + merge_id) AS reason FROM m")
def merge_sources_after(spark: SparkSession, d: str) -> DataFrame:
    return _merge(spark, d)[1]


def _merge(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    items = memory_items(spark, d).where("status = 'active' and tier = 'tip'").withColumn("source_task_ids", F.array(F.concat(F.lit("task-"), (F.col("id") % 6).cast("string"))))
    sources = items.select(F.col("label").alias("merge_id"), "id")
    contents = sources.select("merge_id").distinct().select("merge_id", F.concat(F.lit("merged "), F.col("merge_id").cast("string")).alias("content"), F.lit(5).alias("updated_round"))
    return mutations.merged(items, sources, contents, (F.col("merge_id") + 900000).cast("string"))


@query(
    "merge_errors",
    "MUT4 MUT5",
    f"""WITH {ITEMS}, s AS (SELECT id % 60 AS merge_id, id FROM items UNION ALL SELECT 1000, 3 UNION ALL SELECT 1001, 99999999 UNION ALL SELECT 1001, 4), c AS (SELECT merge_id, count(*) FILTER (WHERE coalesce(status <> 'active', true)) AS missing, count(DISTINCT tier) AS tiers, count(DISTINCT s.id) AS n FROM s LEFT JOIN items i ON i.id = s.id GROUP BY merge_id)
    SELECT merge_id, CASE WHEN missing > 0 THEN 'source_not_active' WHEN tiers > 1 THEN 'cross_tier' WHEN n < 2 THEN 'too_few_sources' END AS error FROM c WHERE missing > 0 OR tiers > 1 OR n < 2""",
)
def merge_errors(spark: SparkSession, d: str) -> DataFrame:
    items = memory_items(spark, d)
    sources = items.select((F.col("id") % 60).alias("merge_id"), "id").unionByName(spark.createDataFrame([(1000, 3), (1001, 99999999), (1001, 4)], "merge_id long, id long"))
    return mutations.merge_errors(items, sources)


COMMANDS = f"""{ITEMS}, c AS (SELECT id % 50 AS seq, CASE WHEN id % 50 < 20 THEN 'merge' WHEN id % 50 < 40 THEN 'delete' ELSE 'review' END AS kind, id % 171 AS id, CASE WHEN id % 2 = 0 THEN 'keep' ELSE 'drop' END AS verdict FROM items),
kept AS (SELECT DISTINCT id FROM c WHERE kind = 'review' AND verdict = 'keep'), mg AS (SELECT seq, kind, id FROM (SELECT *, count(*) OVER (PARTITION BY seq) AS n FROM c WHERE kind = 'merge' AND id NOT IN (SELECT id FROM kept)) WHERE n >= 2),
dl AS (SELECT seq, kind, id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS r FROM c WHERE kind = 'delete' AND id NOT IN (SELECT id FROM kept) AND id NOT IN (SELECT id FROM mg)) WHERE r = 1)"""


@query("command_normalization", "MUT6 SET3", f"WITH {COMMANDS} SELECT * FROM mg UNION ALL SELECT * FROM dl")
def command_normalization(spark: SparkSession, d: str) -> DataFrame:
    rows = memory_items(spark, d).select((F.col("id") % 50).alias("seq"), F.expr("CASE WHEN id % 50 < 20 THEN 'merge' WHEN id % 50 < 40 THEN 'delete' ELSE 'review' END").alias("kind"), (F.col("id") % 171).alias("id"), F.expr("CASE WHEN id % 2 = 0 THEN 'keep' ELSE 'drop' END").alias("verdict"))
    return mutations.normalised_commands(rows)


@query(
    "typed_merge_payload",
    "MUT10",
    f"""WITH {ITEMS}, s AS (SELECT id % 90 AS merge_id, *, 'tool-' || (id % 2) AS tool_name FROM items), b AS (SELECT merge_id, arg_max(id, (success_count, usage_count, updated_round, version, id)) AS representative, min(tier) AS tier, count(DISTINCT tier) AS tiers, count(DISTINCT tool_name) AS tools FROM s GROUP BY merge_id),
    e AS (SELECT *, CASE WHEN tiers > 1 THEN 'cross_tier' WHEN tier = 'trajectory' THEN 'not_mergeable' WHEN tier = 'tool' AND tools > 1 THEN 'tool_names_differ' END AS error FROM b)
    SELECT merge_id, representative, tier, CASE WHEN error IS NULL THEN CASE tier WHEN 'tip' THEN 'guidance' WHEN 'skill' THEN 'goal' ELSE 'purpose' END END AS replaced_field, CASE WHEN error IS NULL THEN 'new ' || merge_id END AS replacement, error FROM e""",
)
def typed_merge_payload(spark: SparkSession, d: str) -> DataFrame:
    sources = memory_items(spark, d).withColumn("merge_id", F.col("id") % 90).withColumn("tool_name", F.concat(F.lit("tool-"), (F.col("id") % 2).cast("string")))
    return mutations.merged_payload(sources, F.concat(F.lit("new "), F.col("merge_id").cast("string")))


@query("embedding_backfill", "MUT8 JN14", f"WITH {ITEMS} SELECT id, CASE WHEN id % 13 = 0 THEN 'rev-0' ELSE revision END AS embedding_model_revision, CASE WHEN id % 13 = 0 THEN 2 ELSE 64 END AS n FROM items")
def embedding_backfill(spark: SparkSession, d: str) -> DataFrame:
    items = memory_items(spark, d).select("id", F.col("vector").alias("embedding"), F.col("revision").alias("embedding_model_revision"))
    new = items.where("id % 13 = 0").select("id", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"), F.lit("rev-0").alias("revision"))
    return mutations.backfilled(items, new).select("id", "embedding_model_revision", F.size("embedding").alias("n"))


@query("embedding_cache", "SNK8 JN14", "WITH t AS (SELECT doc_id AS pos, lang || '-' || (doc_id % 97) AS text FROM documents), c AS (SELECT DISTINCT text FROM t WHERE pos % 3 = 0) SELECT pos, text, text IN (SELECT text FROM c) AS hit FROM t")
def embedding_cache(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.concat("lang", F.lit("-"), (F.col("doc_id") % 97).cast("string")).alias("text"))
    cache = texts.where("pos % 3 = 0").select(F.sha2(F.concat(F.lit("rev"), F.lit("\0"), F.col("text")), 256).alias("cache_key"), F.array(F.lit(1.0)).alias("embedding")).dropDuplicates(["cache_key"])
    hits, _ = retrieval.cache_lookup(texts, cache, "rev")
    return hits.select("pos", "text", F.col("embedding").isNotNull().alias("hit"))


def _listed(kinds: str, first: str, more: str) -> str:
    both = f"SELECT {first} AS x WHERE kind IN ({kinds})" + (f" UNION ALL SELECT {more} WHERE kind IN ({kinds})" if more else "")
    return f"SELECT batch, string_agg(x::VARCHAR, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT batch, x FROM c, LATERAL ({both})) GROUP BY batch"


@query(
    "command_replay",
    "MUT7",
    f"""WITH {ITEMS}, c AS (SELECT id % 7 AS batch, id, CASE WHEN id % 3 = 0 THEN 'lookup' WHEN id % 3 = 1 THEN 'merge' ELSE 'delete' END AS kind FROM items),
    l AS ({_listed("'lookup'", "id", "id + 1")}), m AS ({_listed("'merge'", "id + 1000", "")}), u AS ({_listed("'merge', 'delete'", "id", "id + 1")})
    SELECT batch, l.ids AS looked_up, m.ids AS created, u.ids AS updated FROM l JOIN m USING (batch) JOIN u USING (batch)""",
)
def command_replay(spark: SparkSession, d: str) -> DataFrame:
    rows = memory_items(spark, d).select((F.col("id") % 7).alias("batch"), F.col("id").alias("seq"), F.expr("CASE WHEN id % 3 = 0 THEN 'lookup' WHEN id % 3 = 1 THEN 'merge' ELSE 'delete' END").alias("kind"), F.array("id", F.col("id") + 1).alias("ids"), (F.col("id") + 1000).alias("new_id"))
    out = mutations.replayed(rows)
    return out.select("batch", *(F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))).alias(c) for c in ("looked_up", "created", "updated")))


@query("generation_commit", "MUT9", "SELECT 8 AS generation, true AS committed")
def generation_commit(spark: SparkSession, d: str) -> DataFrame:
    return mutations.next_generation(spark.createDataFrame([(7,)], "generation int"), 7)
