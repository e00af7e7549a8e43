"""The logical tables over the given parquet tables, each as a DataFrame and as a DuckDB common table expression.

Both derive by the same integer and string rules, so a query and its SQL see equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIER = "CASE {} % 4 WHEN 0 THEN 'trajectory' WHEN 1 THEN 'tip' WHEN 2 THEN 'skill' ELSE 'tool' END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Candidate rows of episodes: every event is one episode that saw the memory of its user."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select(
        F.col("user_id").alias("memory_id"), F.expr(TIER.format("user_id")).alias("tier"), (F.col("user_id") % 3).cast("int").alias("version"),
        F.col("event_type").alias("task_group"), F.col("event_id").alias("episode_index"), (k % 2 == 0).alias("selected"), F.col("value").alias("reward"), k.alias("rank"),
    )


OBS = f"""obs AS (SELECT user_id AS memory_id, {TIER.format('user_id')} AS tier, CAST(user_id % 3 AS INT) AS version, event_type AS task_group, event_id AS episode_index,
    CAST(json_extract_string(props, '$.k') AS INT) % 2 = 0 AS selected, value AS reward, CAST(json_extract_string(props, '$.k') AS INT) AS rank FROM events)"""


def creators(spark: SparkSession, d: str) -> DataFrame:
    """The episode that made a memory, for every third one."""
    return observations(spark, d).where("memory_id % 3 = 0").groupBy("memory_id").agg(F.min("episode_index").alias("creator_index"))


CREATORS = "creators AS (SELECT memory_id, min(episode_index) AS creator_index FROM obs WHERE memory_id % 3 = 0 GROUP BY memory_id)"


def memory_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.expr(TIER.format("label")).alias("tier"), F.expr("CASE WHEN vec_id % 11 = 0 THEN 'retired' ELSE 'active' END").alias("status"),
        F.expr("CASE WHEN vec_id % 5 = 0 THEN 'caution' ELSE 'positive' END").alias("polarity"), F.expr("cast(vec_id % 7 as int)").alias("usage_count"), F.expr("cast(vec_id % 4 as int)").alias("success_count"),
        F.expr("cast(vec_id % 10 as int)").alias("updated_round"), F.expr("cast(1 + vec_id % 3 as int)").alias("version"), F.expr("concat('rev-', cast(vec_id % 13 = 0 as int))").alias("revision"),
        F.expr("concat('content ', cast(vec_id % 450 as string), ' of ', cast(label as string))").alias("content"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"), F.col("label").cast("int").alias("label"),
    )


ITEMS = f"""items AS (SELECT vec_id AS id, {TIER.format('label')} AS tier, CASE WHEN vec_id % 11 = 0 THEN 'retired' ELSE 'active' END AS status,
    CASE WHEN vec_id % 5 = 0 THEN 'caution' ELSE 'positive' END AS polarity, CAST(vec_id % 7 AS INT) AS usage_count, CAST(vec_id % 4 AS INT) AS success_count,
    CAST(vec_id % 10 AS INT) AS updated_round, CAST(1 + vec_id % 3 AS INT) AS version, 'rev-' || CAST(vec_id % 13 = 0 AS INT) AS revision,
    'content ' || (vec_id % 450) || ' of ' || label AS content, CAST(embedding AS DOUBLE[]) AS vector, CAST(label AS INT) AS label FROM embeddings)"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Episodes of runs: an order is a task, its priority the run; F orders failed."""
    return table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("run_id"), F.col("o_orderkey").alias("task_id"), F.expr("CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'completed' END").alias("status"),
        F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 1.0D WHEN o_orderkey % 3 = 1 THEN 0.0D ELSE 0.5D END").alias("reward"), (F.col("o_custkey") % 40).cast("int").alias("turns"),
    )


RUNS = """runs AS (SELECT o_orderpriority AS run_id, o_orderkey AS task_id, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'completed' END AS status,
    CASE WHEN o_orderkey % 3 = 0 THEN 1.0::DOUBLE WHEN o_orderkey % 3 = 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS reward, CAST(o_custkey % 40 AS INT) AS turns FROM orders)"""


def proposals(spark: SparkSession, d: str) -> DataFrame:
    """Memory proposals: a document is what one episode proposes, its language stands for a tier."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("episode_index"), F.col("source").alias("source_task"), F.col("lang").alias("tier"), "text")
