"""The tiered memory store on disk: one JSON document per tier, content-addressed snapshots, verified reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.kernels import TIERS, stable_id
from ledgerloom.functions.leakage import canonical_json, redacted
from ledgerloom.sources import jsonl, scratch

SCHEMA_VERSION = 1
ITEM = "id string, tier string, content string, status string, version int, created_round int, updated_round int, source_task_ids array<string>"
STORE = f"schema_version int, tier string, count int, items array<struct<{', '.join(f.replace(' ', ': ', 1) for f in ITEM.split(', '))}>>"


def write_store(items: DataFrame, path: str) -> None:
    """One folder per tier with one JSON document: header and items sorted by id. All tiers are written, empty ones too."""
    tiers = items.sparkSession.createDataFrame([(t,) for t in TIERS], "tier string")
    fields = [f.split()[0] for f in ITEM.split(", ")]
    listed = items.groupBy("tier").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("items"))
    empty = F.expr(f"cast(array() as array<struct<{', '.join(f.replace(' ', ': ', 1) for f in ITEM.split(', '))}>>)")
    rows = tiers.join(listed, "tier", "left").select("tier", F.coalesce("items", empty).alias("items"))
    whole = F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), "tier", F.size("items").alias("count"), "items")
    text = canonical_json(F.to_json(whole, {"ignoreNullFields": "false"}))
    rows.select(F.col("tier").alias("file"), text.alias("value")).write.partitionBy("file").mode("errorifexists").text(path)


def read_tier(spark: SparkSession, path: str, tier: str) -> DataFrame:
    return spark.read.schema(STORE).option("mode", "FAILFAST").json(f"{path}/file={tier}")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Items of all four tiers."""
    return reduce(DataFrame.unionByName, (read_tier(spark, path, t).select(F.inline("items")) for t in TIERS))


def store_faults(spark: SparkSession, path: str) -> DataFrame:
    """(tier, fault): headers that don't match their items, ids that don't follow from content, ids in two places."""
    heads = reduce(DataFrame.unionByName, (read_tier(spark, path, t).withColumn("file", F.lit(t)) for t in TIERS))
    own = F.array(
        F.when(F.col("schema_version") != SCHEMA_VERSION, F.lit("schema_version")),
        F.when(F.col("tier") != F.col("file"), F.lit("tier")),
        F.when(F.col("count") != F.size("items"), F.lit("count")),
        F.when(F.exists("items", lambda i: i["tier"] != F.col("file")), F.lit("item_tier")),
    )
    header = heads.select(F.col("file").alias("tier"), F.explode(F.array_compact(own)).alias("fault"))
    items = heads.select(F.col("file"), F.inline("items")).select("id", "file", "content")
    wrong = items.where(F.col("id") != stable_id(F.col("file"), F.col("content"))).select(F.col("file").alias("tier"), F.concat(F.lit("id:"), "id").alias("fault"))
    twice = items.groupBy("id").agg(F.count("*").alias("n"), F.min("file").alias("tier")).where("n > 1").select("tier", F.concat(F.lit("twice:"), "id").alias("fault"))
    return header.unionByName(wrong).unionByName(twice)


def snapshot_id(items: DataFrame) -> str:
    """Digest over counts and content of every tier: per-row digests are summed, so no list of rows is built anywhere."""
    fields = [f.split()[0] for f in ITEM.split(", ")]
    row = F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)
    part = lambda at: F.sum(F.conv(F.substring(row, at, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    facts = {r.tier: r for r in items.groupBy("tier").agg(F.count("*").alias("n"), *(part(1 + 12 * i).alias(f"s{i}") for i in range(5))).collect()}  # four rows
    text = "\n".join(f"{t} {facts[t].n} {[facts[t][f's{i}'] for i in range(5)]}" if t in facts else f"{t} 0" for t in TIERS)
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def publish_snapshot(items: DataFrame, root: str) -> str:
    """Writes a content-addressed snapshot; an equal one that is there stays, and is verified instead."""
    spark = items.sparkSession
    name = snapshot_id(items)
    target = f"{root}/snapshot_id={name}"
    if scratch.exists(spark, target):
        read_snapshot(spark, root, name)
        return name
    staging = f"{root}/_staging-{name}"
    scratch.delete(spark, staging)
    items.write.partitionBy("tier").parquet(staging)
    scratch.rename(spark, staging, target)
    return name


def read_snapshot(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A snapshot whose content still has its name."""
    if "/" in name or name.startswith("."):
        raise ValueError("a snapshot name can't be a path")
    items = spark.read.schema(ITEM).parquet(f"{root}/snapshot_id={name}")
    if snapshot_id(items) != name:
        raise ValueError(f"snapshot {name} was changed")
    return items


def publish_checked(rows: DataFrame, faults: DataFrame, target: str) -> bool:
    """Build, audit, publish: rows go to a staging folder, and become the target only if the faults are empty."""
    spark = rows.sparkSession
    staging = f"{target}.staging"
    scratch.delete(spark, staging)
    rows.write.parquet(staging)
    if not faults.isEmpty():
        scratch.delete(spark, staging)
        return False
    scratch.rename(spark, staging, target)
    return True


def source_runs(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Episodes of ordered runs (folders with episodes.jsonl) with run_ordinal and episode_index over all of them."""
    from pyspark.sql import Window

    read = [spark.read.schema(schema).option("mode", "FAILFAST").json(f"{p}/episodes.jsonl").withColumn("run_ordinal", F.lit(i)) for i, p in enumerate(paths)]
    rows = reduce(DataFrame.unionByName, read)
    counts = rows.groupBy("run_ordinal").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("run_ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("run_ordinal").orderBy("position")) - 1
    return rows.withColumn("place", place).join(F.broadcast(before), "run_ordinal").withColumn("episode_index", F.col("before") + F.col("place")).drop("before", "place")


#: What a snapshot's or a run's manifest tells of each file.
MANIFEST = "name string, bytes long, sha256 string"


def write_manifest(spark: SparkSession, folder: str, target: str) -> None:
    """Names, sizes and digests of a folder's data files, as JSON Lines beside it; files are read where they lie, none on the driver."""
    facts = jsonl.file_facts(spark, folder).where(~F.col("name").rlike(r"^[._]"))
    jsonl.write_canonical(facts, target, ["name"])


def manifest_faults(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """(name, fault) of files that the manifest doesn't have, that are gone, or whose content isn't that of the manifest."""
    now = jsonl.file_facts(spark, folder).where(~F.col("name").rlike(r"^[._]")).select("name", F.col("bytes").alias("is_bytes"), F.col("sha256").alias("is_sha256"))
    both = jsonl.read(spark, target, MANIFEST).join(now, "name", "full_outer")
    fault = F.when(F.col("sha256").isNull(), "unexpected").when(F.col("is_sha256").isNull(), "missing").when((F.col("sha256") != F.col("is_sha256")) | (F.col("bytes") != F.col("is_bytes")), "changed")
    return both.select("name", fault.alias("fault")).where("fault is not null")


class ReadOnlyStore:
    """A snapshot that can be read and nothing else: writes are refused before any job starts."""

    def __init__(self, spark: SparkSession, root: str, name: str) -> None:
        self._items, self.name = read_snapshot(spark, root, name), name

    def items(self) -> DataFrame:
        return self._items

    def _refused(self, *_: object, **__: object) -> None:
        raise PermissionError(f"snapshot {self.name} is read-only")

    add = merge = delete = update = commit = _refused


def snapshot_path(value: str, namespace: str, root: str) -> str:
    """The folder of a snapshot given as a path under the root, or by its name in a namespace; nothing outside the root."""
    from posixpath import isabs, normpath

    if not value.strip() or not namespace.strip():
        raise ValueError("a snapshot needs a name and a namespace")
    base = normpath(root)
    path = normpath(value if isabs(value) or "://" in value else f"{base}/{namespace}/snapshots/{value}")
    if not path.startswith(base + "/"):
        raise ValueError(f"{value} leads out of {root}")
    return path


def write_run_record(spark: SparkSession, record: str, path: str) -> None:
    """One redacted, canonical JSON record; a record that is there is never replaced."""
    if scratch.exists(spark, path):
        raise FileExistsError(path)
    row = spark.createDataFrame([(record,)], "record string").select(redacted(F.col("record")).alias("value"))
    row.coalesce(1).write.mode("errorifexists").text(path)


def read_run(spark: SparkSession, path: str, record_schema: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The record and the episodes of a source run: a folder with exactly run.json and episodes.jsonl."""
    names = set(scratch.listed(spark, path))
    if names != {"run.json", "episodes.jsonl"}:
        raise ValueError(f"{path} has {sorted(names)}")
    return spark.read.schema(record_schema).option("mode", "FAILFAST").json(f"{path}/run.json"), jsonl.read(spark, f"{path}/episodes.jsonl", schema)


def cache_key(revision: Column, text: Column) -> Column:
    return F.sha2(F.concat(revision, F.lit("\0"), text), 256)


def cache_merged(cache: DataFrame, new: DataFrame) -> DataFrame:
    """An embedding cache (key, vector) with new vectors put in; of equal keys the one that is there stays."""
    fresh = new.groupBy("key").agg(F.min("vector").alias("vector")).join(cache.select("key"), "key", "left_anti")
    return cache.select("key", "vector").unionByName(fresh)


def count_checked(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """The vectors (key, vector) of wanted texts (key); a key without one, or with two, stops the query."""
    counted = found.groupBy("key").agg(F.count("*").alias("n_"), F.min("vector").alias("vector"))
    both = wanted.join(counted, "key", "left")
    wrong = F.raise_error(F.concat(F.lit("vectors of "), "key", F.lit(": "), F.coalesce(F.col("n_"), F.lit(0)).cast("string"))).cast("boolean")
    return both.where(F.when(F.coalesce(F.col("n_"), F.lit(0)) == 1, F.lit(True)).otherwise(wrong)).drop("n_")
