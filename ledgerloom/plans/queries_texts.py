"""Named queries on texts: keys, bounded texts, actions, transcripts, renderers, leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import kernels as k
from ledgerloom.functions import leakage, rendering
from ledgerloom.operators import folding
from ledgerloom.plans.bindings import table
from ledgerloom.plans.registry import query

WS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CANON = f"trim(regexp_replace(text, '{WS}+', ' ', 'g'))"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


@query("canonical_texts", "PRJ1 PRJ22", f"SELECT doc_id, sha256({CANON}) AS content_sha256, length({CANON}) AS n FROM documents")
def canonical_texts(spark: SparkSession, d: str) -> DataFrame:
    text = k.canonical_text(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.sha2(text, 256).alias("content_sha256"), F.char_length(text).alias("n"))


@query("stable_ids", "PRJ2", f"SELECT doc_id, 'mem_' || lang || '_' || substr(sha256(lang || chr(0) || {CANON}), 1, 20) AS id FROM documents")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", k.stable_id(F.col("lang"), F.col("text")).alias("id"))


@query("bounded_texts", "PRJ12 PRJ13", f"SELECT doc_id, substr({strip_sql('text')}, 1, 320) AS shown, nullif({strip_sql('substr(' + strip_sql('text') + ', 1, 500)')}, '') AS step FROM documents")
def bounded_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", k.bounded_text(F.col("text"), 320).alias("shown"), k.step_text(F.col("text")).alias("step"))


@query("task_groups", "PRJ11", r"WITH g AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' ' || upper(source) || ' ' WHEN 1 THEN '../' || source WHEN 2 THEN source || ' x' ELSE '' END AS raw FROM documents) SELECT doc_id, CASE WHEN regexp_matches(lower(trim(raw)), '^[a-z0-9][a-z0-9_.:-]*$') THEN lower(trim(raw)) END AS task_group FROM g")
def task_groups(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("CASE doc_id % 4 WHEN 0 THEN concat(' ', upper(source), ' ') WHEN 1 THEN concat('../', source) WHEN 2 THEN concat(source, ' x') ELSE '' END")
    return table(spark, d, "documents").select("doc_id", k.task_group(raw).alias("task_group"))


@query("normal_keys", "PRJ27", "SELECT page_id, regexp_replace(lower(url), '[^a-z0-9]', '', 'g') AS name FROM pages")
def normal_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", k.normal_key(F.col("url")).alias("name"))


@query("reward_classes", "PRJ9", "SELECT event_id, CASE WHEN abs((event_id % 5) / 4.0 - 1) <= 1e-12 THEN 'success' WHEN (event_id % 5) / 4.0 <= 0 THEN 'failure' ELSE 'partial' END AS class FROM events")
def reward_classes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", k.reward_class((F.col("event_id") % 5) / 4).alias("class"))


@query(
    "outcome_classes",
    "PRJ10",
    """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'incomplete' WHEN quality IS NULL THEN 'infra_failure' WHEN quality = 1 THEN 'success' ELSE 'task_failure' END AS outcome_class,
    CASE WHEN doc_id % 7 = 0 OR quality IS NULL THEN NULL WHEN quality = 1 THEN 'positive' ELSE 'caution' END AS polarity, CASE WHEN doc_id % 7 = 0 OR quality IS NULL THEN '' WHEN quality = 1 THEN 'tip,skill,tool' ELSE 'tip' END AS tiers,
    CASE WHEN doc_id % 7 = 0 THEN 'episode_truncated' WHEN quality IS NULL THEN 'missing_terminal_evaluation' END AS skip_reason FROM documents LEFT JOIN labels USING (doc_id)""",
)
def outcome_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    policy = k.outcome_policy(F.col("quality").cast("double"), F.col("doc_id") % 7 == 0, F.col("quality").isNotNull())
    return rows.select("doc_id", policy.alias("p")).select("doc_id", "p.outcome_class", "p.polarity", F.concat_ws(",", "p.allowed_tiers").alias("tiers"), "p.skip_reason")


OUTPUTS = r"""o AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN '<think>hm' || chr(10) || 'x</think> ' || role || ' do' WHEN 1 THEN ' stop ' WHEN 2 THEN '<THINK>a</think>' WHEN 3 THEN 'pay(x=1)' ELSE '<think> open' END AS output FROM conversations)"""


def outputs(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("CASE turn % 5 WHEN 0 THEN concat('<think>hm\n', 'x</think> ', role, ' do') WHEN 1 THEN ' stop ' WHEN 2 THEN '<THINK>a</think>' WHEN 3 THEN 'pay(x=1)' ELSE '<think> open' END")
    return table(spark, d, "conversations").select("conv_id", "turn", raw.alias("output"))


@query(
    "final_actions",
    "PRJ18",
    rf"""WITH {OUTPUTS}, a AS (SELECT conv_id, turn, trim(regexp_replace(output, '(?is)<think>.*?</think>', '', 'g')) AS a FROM o)
    SELECT conv_id, turn, CASE WHEN a = '' OR contains(lower(a), '<think>') THEN NULL WHEN a = 'stop' THEN '###STOP###' ELSE a END AS action, CASE WHEN a = '' THEN 'no final action' WHEN contains(lower(a), '<think>') THEN 'unterminated thinking block' END AS error FROM a""",
)
def final_actions(spark: SparkSession, d: str) -> DataFrame:
    return outputs(spark, d).select("conv_id", "turn", k.final_action(F.col("output")).alias("a")).select("conv_id", "turn", "a.action", "a.error")


@query("structured_actions", "PRJ16", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS name, CASE WHEN event_id % 3 = 0 THEN props END AS arguments FROM events")
def structured_actions(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("""CASE event_id % 3 WHEN 0 THEN concat('{"name": " ', event_type, ' ", "arguments": ', props, '}') WHEN 1 THEN concat('{"name": "", "arguments": ', props, '}') ELSE '{"name": "x", "arguments": 3}' END""")
    rows = table(spark, d, "events").select("event_id", "props", k.structured_action(raw).alias("a"))
    return rows.select("event_id", "a.name", F.when(F.get_json_object("a.arguments", "$.k") == F.get_json_object("props", "$.k"), F.col("props")).alias("arguments"))


@query("json_repairs", "PRJ19", r"""SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN props ELSE '{"p": "a\\q\n\\u12"}' END AS repaired FROM events""")
def json_repairs(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr(r"""CASE event_id % 3 WHEN 0 THEN concat('```json\n', props, '\n```') WHEN 1 THEN concat('said: ', props, ' done') ELSE '{"p": "a\\q\\n\\u12"}' END""")
    return table(spark, d, "events").select("event_id", k.repaired_json(raw).alias("repaired"))


@query("parsed_calls", "PRJ17", """SELECT event_id, event_type AS name, '{"amount": ' || value || ', "note": "n", "tags": [1, 2]}' AS arguments FROM events""")
def parsed_calls(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat("event_type", F.lit("(amount="), F.col("value").cast("string"), F.lit(", note='n', tags=[1, 2])"))
    return table(spark, d, "events").select("event_id", rendering.parsed_call(raw).alias("c")).select("event_id", "c.name", "c.arguments")


@query("transcripts", "PRJ20", r"SELECT conv_id, sha256(string_agg(role || ': ' || trim(text), chr(10) ORDER BY turn)) AS rendered_sha256, count(*) AS n FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def transcripts(spark: SparkSession, d: str) -> DataFrame:
    out = rendering.transcript(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    return out.select("conv_id", F.sha2("rendered", 256).alias("rendered_sha256"), "n")


@query(
    "tip_renders",
    "PRJ14 PRJ15",
    "SELECT doc_id, 'Tip: ' || lang || chr(10) || 'Applies when: ' || source || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Avoid: ' || lang || '; ' || source ELSE '' END AS rendered, lang || ' ' || source AS retrieval_text FROM documents",
)
def tip_renders(spark: SparkSession, d: str) -> DataFrame:
    avoid = F.when(F.col("doc_id") % 2 == 0, F.array("lang", "source"))
    rendered = rendering.lines(("Tip", F.col("lang")), ("Applies when", F.col("source")), ("Avoid", F.array_join(avoid, "; ")))
    return table(spark, d, "documents").select("doc_id", rendered.alias("rendered"), F.concat_ws(" ", "lang", "source").alias("retrieval_text"))


@query(
    "tool_renders",
    "PRJ14",
    "SELECT event_id, 'Tool: ' || event_type || chr(10) || 'Purpose: p' || chr(10) || 'Preconditions: a; b' || chr(10) || 'Argument rules:' || chr(10) || '- amount: ' || (event_id % 9) || chr(10) || '- zone: z' || chr(10) || 'Expected effect: e' AS rendered FROM events",
)
def tool_renders(spark: SparkSession, d: str) -> DataFrame:
    rules = F.create_map(F.lit("zone"), F.lit("z"), F.lit("amount"), (F.col("event_id") % 9).cast("string"))
    return table(spark, d, "events").select("event_id", rendering.tool_text(F.col("event_type"), F.lit("p"), F.lit(None).cast("string"), F.array(F.lit("a"), F.lit("b")), rules, F.lit("e")).alias("rendered"))


@query(
    "trajectory_renders",
    "PRJ14",
    """SELECT conv_id, sha256('Case: c' || chr(10) || 'Episode: ' || conv_id || chr(10) || 'Task group: g' || chr(10) || 'Observed steps:' || chr(10) ||
    string_agg((turn + 1) || '. ' || role || ' [reward=0.0, done=false]', chr(10) ORDER BY turn) || chr(10) || 'Result: failure (final_reward=0.0)') AS rendered_sha256 FROM conversations GROUP BY conv_id""",
)
def trajectory_renders(spark: SparkSession, d: str) -> DataFrame:
    steps = F.array_sort(F.collect_list(F.struct((F.col("turn") + 1).alias("order"), F.col("role").alias("action"), F.lit(0.0).alias("reward"), F.lit(False).alias("done"))))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(steps.alias("steps"))
    return rows.select("conv_id", F.sha2(rendering.trajectory_text(F.lit("c"), F.col("conv_id").cast("string"), F.lit("g"), F.col("steps"), F.lit("failure"), F.lit(0.0)), 256).alias("rendered_sha256"))


@query("named_values", "PRJ21", "SELECT event_id, least('b', event_type) || ',' || greatest('b', event_type) AS names FROM events")
def named_values(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit('{"name": "b", "x": [{"name": "'), F.col("event_type"), F.lit('"}, {"name": 3}], "y": '), "props", F.lit("}"))
    return table(spark, d, "events").select("event_id", F.array_join(rendering.named_values(raw), ",").alias("names"))


ROW_HASH = """sha256('{"a":"é","props":{"k":' || json_extract_string(props, '$.k') || '},"z":1}')"""


@query("row_hashes", "PRJ23 PRJ24", f"SELECT event_id, {ROW_HASH} AS row_sha256, 'opd_sel_' || substr({ROW_HASH}, 1, 24) AS example_id FROM events")
def row_hashes(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit('{"z": 1, "props": '), "props", F.lit(', "a": "é"}'))
    digest = leakage.row_hash(raw)
    return table(spark, d, "events").select("event_id", digest.alias("row_sha256"), F.concat(F.lit("opd_sel_"), F.substring(digest, 1, 24)).alias("example_id"))


@query("rendered_prompts", "PRJ31", """SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || '}' AS student, '{"k":' || json_extract_string(props, '$.k') || '}' || chr(10) || '{"v":' || event_id || '}' AS teacher FROM events""")
def rendered_prompts(spark: SparkSession, d: str) -> DataFrame:
    public = leakage.canonical_json(F.col("props"))
    hindsight = leakage.canonical_json(F.concat(F.lit('{"v": '), F.col("event_id").cast("string"), F.lit("}")))
    return table(spark, d, "events").select("event_id", public.alias("student"), F.concat(public, F.lit("\n"), hindsight).alias("teacher"))


@query(
    "redacted_payloads",
    "PRJ26",
    """SELECT page_id, '{"inner":{"apiToken":"[REDACTED]","n":' || page_id || '},"url":"' || CASE WHEN regexp_matches(url, '^(?i:https?)://') AND (regexp_matches(url, '[?#].+') OR regexp_matches(url, '^[a-zA-Z]+://[^/?#]+@')) THEN '[REDACTED]' ELSE url END || '"}' AS payload FROM pages""",
)
def redacted_payloads(spark: SparkSession, d: str) -> DataFrame:
    raw = F.to_json(F.struct(F.col("url"), F.struct(F.lit("k").alias("apiToken"), F.col("page_id").alias("n")).alias("inner")))
    return table(spark, d, "pages").select("page_id", leakage.redacted(raw).alias("payload"))


@query("credential_urls", "PRJ26 LK1", "SELECT page_id, regexp_matches(url, '^(?i:https?)://') AND (regexp_matches(url, '[?#].+') OR regexp_matches(url, '^[a-zA-Z]+://[^/?#]+@')) AS carries FROM pages")
def credential_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", k.credential_url(F.col("url")).alias("carries"))


CREDENTIAL = leakage.CREDENTIAL.replace("'", "''")
LEAK_TEXT = """t AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'api_key=sk-secret-value' WHEN 1 THEN 'see mem_tip_abc123' WHEN 2 THEN 'history/evaluations/run-a' WHEN 3 THEN 'data/shop/test/tasks.json' WHEN 4 THEN 'Authorization: Bearer sk-secret-value' WHEN 5 THEN 'https://u:p@example.com/p' ELSE text END AS text FROM documents)"""


def leak_texts(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("CASE doc_id % 9 WHEN 0 THEN 'api_key=sk-secret-value' WHEN 1 THEN 'see mem_tip_abc123' WHEN 2 THEN 'history/evaluations/run-a' WHEN 3 THEN 'data/shop/test/tasks.json' WHEN 4 THEN 'Authorization: Bearer sk-secret-value' WHEN 5 THEN 'https://u:p@example.com/p' ELSE text END")
    return table(spark, d, "documents").select("doc_id", raw.alias("text"))


@query(
    "text_leaks",
    "LK1 LK3",
    f"""WITH {LEAK_TEXT} SELECT doc_id, 'credential' AS rule FROM t WHERE regexp_matches(text, '{CREDENTIAL}') UNION ALL SELECT doc_id, 'memory_id' FROM t WHERE regexp_matches(text, '{leakage.MEMORY_ID}')
    UNION ALL SELECT doc_id, 'credential_url' FROM t WHERE regexp_matches(text, '^https?://[^/?#]+@') UNION ALL SELECT doc_id, 'quarantined_path' FROM t WHERE contains('/' || lower(text) || '/', '/history/evaluations/') OR contains('/' || lower(text) || '/', '/test/') OR regexp_matches(lower(text), 'split=test([^a-z0-9]|$)')""",
)
def text_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.text_leaks(leak_texts(spark, d), "doc_id", "text")


@query(
    "payload_leaks",
    "LK1 LK2 MS7",
    """SELECT event_id, '$.a.memoryValue' AS path, 'privileged_key' AS rule FROM events WHERE event_id % 4 = 0 UNION ALL SELECT event_id, '$.a.memoryValue', 'memory_key' FROM events WHERE event_id % 4 = 0
    UNION ALL SELECT event_id, '$.x[0].nl_assertions', 'evaluator_key' FROM events WHERE event_id % 4 = 1 UNION ALL SELECT event_id, '$.x[1].Last.Used-At', 'privileged_key' FROM events WHERE event_id % 4 = 1
    UNION ALL SELECT event_id, '$.text', 'memory_id' FROM events WHERE event_id % 4 = 2""",
)
def payload_leaks(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("""CASE event_id % 4 WHEN 0 THEN '{"a": {"memoryValue": 1}}' WHEN 1 THEN '{"x": [{"nl_assertions": []}, {"Last.Used-At": "d"}]}' WHEN 2 THEN '{"text": "mem_tip_abc123"}' ELSE props END""")
    return leakage.payload_leaks(table(spark, d, "events").select("event_id", raw.alias("payload")), "event_id", "payload", public=True, act=True)


@query(
    "truncated_prompts",
    "PRJ32",
    r"SELECT conv_id, turn, array_to_string(CASE WHEN len(w) > 12 THEN w[len(w) - 11:] ELSE w END, ' ') AS tokens, least(len(w), 12) - 1 AS first_position, least(len(w), 12) + 1 AS last_position FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)",
)
def truncated_prompts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", k.truncated_prompt(F.split("text", " "), 12).alias("t"))
    positions = k.response_positions(F.size("t"), F.lit(3))
    return rows.select("conv_id", "turn", F.array_join("t", " ").alias("tokens"), F.array_min(positions).cast("long").alias("first_position"), F.array_max(positions).cast("long").alias("last_position"))


@query("compacted_transcripts", "PRJ28", "SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN count(*) OVER (PARTITION BY conv_id) > 1 ELSE false END AS cumulative, conv_id % 2 <> 0 OR count(*) OVER (PARTITION BY conv_id) = 1 OR turn = max(turn) OVER (PARTITION BY conv_id) AS kept FROM conversations")
def compacted_transcripts(spark: SparkSession, d: str) -> DataFrame:
    so_far = F.array_join(F.collect_list("role").over(Window.partitionBy("conv_id").orderBy("turn")), ",")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("conv_id") % 2 == 0, so_far).otherwise(F.concat(F.lit("x"), F.col("turn").cast("string"))).alias("observation"))
    return folding.compacted(rows, "conv_id", "turn", "observation").select("conv_id", "turn", "cumulative", F.col("kept").isNotNull().alias("kept"))


@query("public_candidates", "PRJ25", "SELECT vec_id AS memory_id, CASE label % 4 WHEN 0 THEN 'trajectory' WHEN 1 THEN 'tip' WHEN 2 THEN 'skill' ELSE 'tool' END AS tier, CAST(1 + vec_id % 3 AS INT) AS version FROM embeddings")
def public_candidates(spark: SparkSession, d: str) -> DataFrame:
    from ledgerloom.plans.bindings import memory_items

    return memory_items(spark, d).select(F.col("id").alias("memory_id"), "tier", "version")
