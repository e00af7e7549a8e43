"""Checks that recompute what they check: duplicates, set equality, lineage, errors as one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.sources.scratch import written


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("times")).where("times > 1")


def differing(recomputed: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of one side only, with repeats, and the side: 'missing' from the stored ones, or 'unexpected' there."""
    columns = recomputed.columns
    stored = stored.select(columns)
    missing = recomputed.exceptAll(stored).withColumn("side", F.lit("missing"))
    return missing.unionByName(stored.exceptAll(recomputed).withColumn("side", F.lit("unexpected")))


def set_coverage(actual: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Keys that only one of two sets has, with the side."""
    a, e = actual.select(key).distinct(), expected.select(key).distinct()
    return e.join(a, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(a.join(e, key, "left_anti").withColumn("side", F.lit("unexpected")))


def broken_lineage(runs: DataFrame, order: str, before: str, after: str) -> DataFrame:
    """Runs whose state after isn't the state before of the next run."""
    ahead = F.lead(before).over(Window.orderBy(order))
    return runs.withColumn("ahead", ahead).where(F.col("ahead").isNotNull() & ~F.col(after).eqNullSafe(F.col("ahead"))).select(order, after, "ahead")


def errors(*checks: tuple[str, str, DataFrame]) -> DataFrame:
    """(code, artifact, message) of checks (code, artifact, rows with one column `message`): distinct, in order."""
    tables = [rows.select(F.lit(code).alias("code"), F.lit(artifact).alias("artifact"), F.col("message").cast("string").alias("message")) for code, artifact, rows in checks]
    return reduce(DataFrame.unionByName, tables).distinct().orderBy("code", "artifact", "message")


def run_violations(runs: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Stored run metrics (run_id, task_count, completed_count, failure_count, mean_reward) against recomputed ones: (run_id, rule)."""
    other = recomputed.select("run_id", *(F.col(c).alias(f"r_{c}") for c in ("task_count", "completed_count", "failure_count", "mean_reward")))
    both = runs.join(other, "run_id", "left")
    rules = F.array(
        F.when(F.col("r_task_count").isNull(), F.lit("no_episodes")),
        F.when(F.col("task_count") != F.col("r_task_count"), F.lit("task_count")),
        F.when(F.col("completed_count") != F.col("r_completed_count"), F.lit("completed_count")),
        F.when(F.col("failure_count") != F.col("r_failure_count"), F.lit("failure_count")),
        F.when(F.abs(F.col("mean_reward") - F.col("r_mean_reward")) > 1e-9, F.lit("mean_reward")),
    )
    return both.select("run_id", F.explode(F.array_compact(rules)).alias("rule"))


def lineage_closure(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """All (ancestor, descendant) of edges (parent, child) up to `rounds` doublings of the distance.

    Each round joins only the pairs that the last one found, and is a table in
    the shared folder, so the plan doesn't grow with the rounds.
    """
    reach = new = written(edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant")).distinct(), "lineage")
    for _ in range(rounds):
        ahead = reach.select(F.col("ancestor").alias("descendant"), F.col("descendant").alias("far"))
        back = reach.select(F.col("ancestor").alias("first"), F.col("descendant").alias("ancestor"))
        step = new.join(ahead, "descendant").select("ancestor", F.col("far").alias("descendant")).unionByName(back.join(new, "ancestor").select(F.col("first").alias("ancestor"), "descendant"))
        new = written(step.distinct().join(reach, ["ancestor", "descendant"], "left_anti"), "lineage")
        if new.isEmpty():
            break
        reach = written(reach.unionByName(new), "lineage")
    return reach
