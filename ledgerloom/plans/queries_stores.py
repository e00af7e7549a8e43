"""Named queries that write to a shared folder and read back: stores, snapshots, JSON Lines, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.kernels import stable_id
from ledgerloom.operators import folding
from ledgerloom.plans.bindings import memory_items, table
from ledgerloom.plans.registry import query
from ledgerloom.sources import jsonl, scratch, splits, stores
from ledgerloom.streaming import ledger

TIER = "CASE label % 4 WHEN 0 THEN 'trajectory' WHEN 1 THEN 'tip' WHEN 2 THEN 'skill' ELSE 'tool' END"
ID = f"'mem_' || {TIER} || '_' || substr(sha256({TIER} || chr(0) || 'item ' || vec_id), 1, 20)"


def stored_items(spark: SparkSession, d: str) -> DataFrame:
    content = F.concat(F.lit("item "), F.col("id").cast("string"))
    return memory_items(spark, d).select(
        stable_id(F.col("tier"), content).alias("id"), "tier", content.alias("content"), "status", "version", F.lit(0).alias("created_round"), "updated_round",
        F.array(F.concat(F.lit("task-"), (F.col("id") % 5).cast("string"))).alias("source_task_ids"),
    )


@query("store_roundtrip", "SRC2 SRC3", f"SELECT {ID} AS id, {TIER} AS tier, 'item ' || vec_id AS content, CAST(1 + vec_id % 3 AS INT) AS version FROM embeddings")
def store_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch.shared_folder(spark, "store")
    stores.write_store(stored_items(spark, d), path)
    return stores.read_store(spark, path).select("id", "tier", "content", "version")


@query("store_faults", "SRC2", "SELECT 'tip' AS tier, 'none' AS fault WHERE false")
def store_faults(spark: SparkSession, d: str) -> DataFrame:
    path = scratch.shared_folder(spark, "store")
    stores.write_store(stored_items(spark, d), path)
    return stores.store_faults(spark, path)


@query("snapshot_roundtrip", "SNK4 SRC4 MS4", f"SELECT {ID} AS id, {TIER} AS tier, CASE WHEN vec_id % 11 = 0 THEN 'retired' ELSE 'active' END AS status FROM embeddings")
def snapshot_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    root = scratch.shared_folder(spark, "snapshots")
    name = stores.publish_snapshot(stored_items(spark, d), root)
    if stores.publish_snapshot(stored_items(spark, d), root) != name:
        raise AssertionError("equal items have equal names")
    return stores.read_snapshot(spark, root, name).select("id", "tier", "status")


@query("jsonl_roundtrip", "SRC1 SNK1 SNK2", "SELECT event_id, event_type, value FROM events")
def jsonl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch.shared_folder(spark, "jsonl")
    jsonl.write_canonical(table(spark, d, "events").select("event_id", "event_type", "value"), path, ["event_id"])
    return jsonl.read(spark, path, "event_id long, event_type string, value double")


@query("file_facts", "SNK7")
def file_facts(spark: SparkSession, d: str) -> DataFrame:
    path = scratch.shared_folder(spark, "facts")
    jsonl.write_canonical(table(spark, d, "region").coalesce(1), path, ["r_regionkey"])
    return jsonl.file_facts(spark, path).where("name like 'part-%'").select("bytes", "sha256")


@query("published_rows", "SNK5 SNK3", "SELECT n_nationkey, n_name FROM nation")
def published_rows(spark: SparkSession, d: str) -> DataFrame:
    target = scratch.shared_folder(spark, "published")
    rows = table(spark, d, "nation").select("n_nationkey", "n_name")
    if stores.publish_checked(rows, rows.limit(1), f"{target}/refused") or not stores.publish_checked(rows, rows.limit(0), f"{target}/good"):
        raise AssertionError("rows are published exactly if they have no faults")
    return spark.read.schema(rows.schema).parquet(f"{target}/good")


@query("source_runs", "SRC5", "SELECT CAST(o_orderkey % 2 AS INT) AS run_ordinal, o_orderkey AS position, CASE WHEN o_orderkey % 2 = 0 THEN row_number() OVER (PARTITION BY o_orderkey % 2 ORDER BY o_orderkey) - 1 ELSE row_number() OVER (PARTITION BY o_orderkey % 2 ORDER BY o_orderkey) - 1 + (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0) END AS episode_index FROM orders")
def source_runs(spark: SparkSession, d: str) -> DataFrame:
    root = scratch.shared_folder(spark, "runs")
    orders = table(spark, d, "orders")
    for i in range(2):
        orders.where(F.col("o_orderkey") % 2 == i).select(F.col("o_orderkey").alias("position")).write.json(f"{root}/{i}/episodes.jsonl")
    return stores.source_runs(spark, [f"{root}/0", f"{root}/1"], "position long")


@query("split_digest", "SRC7", """SELECT o_orderstatus AS split, count(*) AS n, sha256('[' || string_agg('"' || o_orderkey || '"', ',' ORDER BY o_orderkey) || ']') AS digest FROM orders GROUP BY o_orderstatus""")
def split_digest(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_digest(table(spark, d, "orders").select(F.col("o_orderstatus").alias("split"), F.col("o_orderkey").alias("pos"), F.col("o_orderkey").cast("string").alias("task_id")))


@query("stream_append", "ST1 ST4", "SELECT event_id, event_type FROM events")
def stream_append(spark: SparkSession, d: str) -> DataFrame:
    root = scratch.shared_folder(spark, "stream")
    table(spark, d, "events").select("event_id", "event_type").repartition(4, "event_id").write.parquet(f"{root}/in")
    for _ in range(2):  # a second start finds nothing new
        ledger.appended(spark, f"{root}/in", "event_id long, event_type string", f"{root}/out", f"{root}/progress", 2).awaitTermination()
    return spark.read.schema("event_id long, event_type string").parquet(f"{root}/out")


@query("stream_rounds", "ST2 ST5", "SELECT source AS namespace, CAST(unnest(range(1, count(*) // 12 + 1)) AS INT) AS round FROM documents GROUP BY source")
def stream_rounds(spark: SparkSession, d: str) -> DataFrame:
    root = scratch.shared_folder(spark, "rounds")
    table(spark, d, "documents").select(F.col("source").alias("namespace")).repartition(3).write.parquet(f"{root}/in")
    for _ in range(2):  # a second start finds no round to run
        completed = spark.readStream.schema("namespace string").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        ledger.counted_rounds(completed, f"{root}/control", 12, lambda due: due, f"{root}/progress").awaitTermination()
    return spark.read.schema("namespace string, round int").parquet(f"{root}/control/rounds").drop("batch")


@query("stream_commits", "ST3", "SELECT conv_id, count(*) AS rows, min(turn) = 0 AND count(DISTINCT turn) = count(*) AND max(turn) = count(*) - 1 AS contiguous FROM conversations GROUP BY conv_id")
def stream_commits(spark: SparkSession, d: str) -> DataFrame:
    root = scratch.shared_folder(spark, "commits")
    table(spark, d, "conversations").select("conv_id", "turn").repartition(3, "conv_id").write.parquet(f"{root}/in")
    rows = spark.readStream.schema("conv_id long, turn long").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    ledger.committed_batches(rows, lambda b: folding.contiguous(b, ["conv_id"], "turn"), f"{root}/out", f"{root}/progress").awaitTermination()
    return spark.read.parquet(f"{root}/out").drop("generation")


@query("stream_windows", "ST1", "SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    root = scratch.shared_folder(spark, "windows")
    table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type").repartition(2).write.parquet(f"{root}/in")
    rows = spark.readStream.schema("ts timestamp, event_type string").parquet(f"{root}/in")
    name = "w" + root.rsplit("-", 1)[1]
    ledger.windowed_counts(rows, "ts", "event_type", "1 day", "40 days").writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).withColumn("start", F.col("start").cast("timestamp_ntz"))
