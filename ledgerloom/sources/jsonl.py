"""JSON Lines: strict reads, line diagnostics, canonical writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.leakage import canonical_json


def read(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of JSON Lines files; a row that isn't an object of the schema fails the job. Blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def faults(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, fault) of lines that aren't JSON objects; line counts from 1.

    Files are read line by line in splits of any size. Only where there is a
    fault, the file's lines are numbered, in ranges of their byte order.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    parsed = F.try_parse_json("value")
    fault = F.when(F.trim("value") == "", None).when(parsed.isNull(), "not_json").when(~F.schema_of_variant(parsed).startswith("OBJECT"), "not_an_object")
    marked = lines.select("path", "block", "at", fault.alias("fault"))
    bad = marked.where("fault is not null")
    within = Window.partitionBy("path", "block").orderBy("at")
    numbered = marked.join(F.broadcast(bad.select("path").distinct()), "path").withColumn("place", F.row_number().over(within))
    counts = numbered.groupBy("path", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("path", "block", F.coalesce(before, F.lit(0)).alias("before"))
    return numbered.where("fault is not null").join(counts, ["path", "block"]).select("path", (F.col("before") + F.col("place")).alias("line"), "fault")


def unknown_fields(rows: DataFrame, column: str, known: list[str]) -> DataFrame:
    """Names of fields in JSON texts that aren't known, with counts."""
    return rows.select(F.explode(F.array_except(F.json_object_keys(column), F.array(*map(F.lit, known)))).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def write_canonical(rows: DataFrame, path: str, order: list[str], ascii_only: bool = False, mode: str = "errorifexists") -> None:
    """Canonical JSON Lines (sorted keys, no spaces) in the order of the named columns; range-partitioned, so that file order is row order."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select(canonical_json(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}), ascii_only).alias("value")).write.mode(mode).text(path)


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of the files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
