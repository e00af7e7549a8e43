"""Named queries on tables larger than the given ones, against their SQL; only the columns that a query reads are made."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import catalog, queries_rules
from ledgerloom.sources import scratch
from ledgerloom.streaming import ledger
from tests.test_queries import normal


@pytest.fixture
def same(spark, tmp_path):
    """Whether a query on these tables agrees with its SQL."""

    def run(name, **tables):
        con = duckdb.connect()
        for t, rows in tables.items():
            rows.write.parquet(f"{tmp_path}/{t}.parquet")
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        got, want = catalog.queries()[name](spark, str(tmp_path)).toPandas(), con.sql(catalog.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert len(want) and normal(got) == normal(want)

    return run


def embeddings(spark, n):
    return spark.range(n).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0)).cast("array<float>").alias("embedding"), (F.col("id") * 7 % 10).cast("int").alias("label"))


def test_merges_where_items_have_the_numbers_of_results(spark, same):
    same("merge_sequence", embeddings=embeddings(spark, 20_100))


@pytest.mark.parametrize("n", [3_000, 6_000, 7_010])
def test_merge_errors_where_items_have_the_numbers_of_results(spark, same, n):
    same("merge_sequence_errors", embeddings=embeddings(spark, n))


def documents(spark, n, sources):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("src"), (F.col("id") % sources).cast("string")).alias("source"))


def test_rounds_beyond_the_thousandth(spark, same):
    same("due_rounds", documents=documents(spark, 2 * 15 * 1_010, 2).unionByName(spark.createDataFrame([(-1, "few")], "doc_id long, source string")))


def test_stream_rounds_looks_at_no_single_round(spark, same, monkeypatch):
    asked = []
    there = scratch.exists
    monkeypatch.setattr(scratch, "exists", lambda session, path: asked.append(path) or there(session, path))
    same("stream_rounds", documents=documents(spark, 12 * 40, 2))  # 40 rounds in three batches
    assert len(asked) < 20


def test_failed_rounds_are_run_again_and_finished_ones_are_not(spark, tmp_path):
    ran = []

    def start(run):
        rows = spark.readStream.schema("namespace string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        ledger.counted_rounds(rows, f"{tmp_path}/control", 5, run, f"{tmp_path}/progress").awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema("namespace string, round int").parquet(f"{tmp_path}/control/rounds").drop("batch").collect())

    def run(due):
        ran.append([tuple(r) for r in due.collect()])
        return due

    def failing(due):
        raise ValueError("no round")

    add = lambda a, b: spark.createDataFrame([("a",)] * a + [("b",)] * b, "namespace string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    add(11, 4)
    assert start(run) == [("a", 1), ("a", 2)]
    add(4, 6)
    with pytest.raises(Exception, match="no round"):
        start(failing)
    assert start(run) == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2)]
    assert start(run) and ran == [[("a", 1), ("a", 2)], [("a", 3), ("b", 1), ("b", 2)]]


def test_repeated_scores_compare_one_evaluation(spark, monkeypatch):
    """Values at the edge of the sixth place, whose last places differ with each evaluation."""
    noise = F.udf(lambda: random.random() * 1e-12 - 5e-13, "double").asNondeterministic()
    edge = lambda spark, d: spark.range(400).select(F.col("id").alias("memory_id"), (F.lit(1.0000005) + noise()).alias("value"))
    monkeypatch.setattr(queries_rules, "scores", edge)
    assert catalog.queries()["repeated_scores"](spark, "").count() == 0
