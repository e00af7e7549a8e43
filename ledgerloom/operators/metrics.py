"""Run metrics, counts by tier, comparisons with a baseline, and deterministic schedules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_metrics(episodes: DataFrame, keys: list[str]) -> DataFrame:
    """Episodes (keys, status, reward) to counts, mean reward over the completed (0 if none) and pass rate (reward > 0, over all)."""
    done = F.col("status") == "completed"
    return episodes.groupBy(*keys).agg(
        F.count("*").alias("task_count"),
        F.count_if(done).alias("completed_count"),
        F.count_if(~done).alias("failure_count"),
        F.coalesce(F.avg(F.when(done, F.col("reward"))), F.lit(0.0)).alias("mean_reward"),
        (F.count_if(done & (F.col("reward") > 0)) / F.count("*")).alias("pass_rate"),
    )


def tier_counts(rows: DataFrame, tiers: DataFrame, flag: Column) -> DataFrame:
    """Rows of each tier of the dimension for which the flag holds, zeros included."""
    counted = rows.groupBy("tier").agg(F.count_if(flag).alias("n"))
    return tiers.join(counted, "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("n"))


def against_baseline(metrics: DataFrame, key: str, baseline, columns: tuple[str, ...] = ("mean_reward", "pass_rate"), digits: int = 12) -> DataFrame:
    """Differences of each row's metrics from those of the baseline row (one row, joined as such)."""
    base = metrics.where(F.col(key) == baseline).limit(1).select(*(F.col(c).alias(f"base_{c}") for c in columns))
    return metrics.crossJoin(F.broadcast(base)).select(key, *(F.round(F.col(c) - F.col(f"base_{c}"), digits).alias(f"delta_{c}") for c in columns))


def interaction(metrics: DataFrame, a: str, b: str, c: str, d: str, key: str = "cell") -> DataFrame:
    """(D - C) - (B - A) of mean rewards of four cells."""
    of = lambda name: F.max(F.when(F.col(key) == name, F.col("mean_reward")))
    return metrics.agg(((of(d) - of(c)) - (of(b) - of(a))).alias("interaction"))


def bootstrap_interval(pairs: DataFrame, draws: int = 1000, seed: int = 42, percent: float = 95.0) -> DataFrame:
    """Interval of the mean paired difference (id, difference): each draw weighs every pair by a Poisson number from a hash of seed, draw and id.

    A task adds up all draws of its pairs in two arrays and hands on one row for
    each draw, so rows don't multiply with the draws; equal pairs give equal intervals.
    """
    # The distribution function of Poisson(1).
    steps = np.asarray([0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, total = np.zeros(draws), np.zeros(draws)
        stride = np.arange(draws, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for frame in frames:
            for at in range(0, len(frame), 256):
                part = frame.iloc[at : at + 256]
                mixed = part["hash"].to_numpy().astype(np.int64).view(np.uint64)[:, None] + stride
                mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                drawn = np.searchsorted(steps, (mixed >> np.uint64(11)) / float(1 << 53))
                weight += drawn.sum(0)
                total += part["difference"].to_numpy(float) @ drawn
        yield pd.DataFrame({"draw": range(draws), "w": weight, "t": total})

    rows = pairs.select(F.xxhash64(F.lit(seed), "id").alias("hash"), F.col("difference").cast("double").alias("difference"))
    sums = rows.mapInPandas(run, "draw int, w double, t double").groupBy("draw").agg(F.sum("t").alias("t"), F.sum("w").alias("w"))
    means = sums.where("w > 0").select((F.col("t") / F.col("w")).alias("mean"))
    tail = (100 - percent) / 200
    return means.agg(F.percentile("mean", tail).alias("low"), F.percentile("mean", 1 - tail).alias("high"))


def complete_sum(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Sum that is null as soon as one value is."""
    return rows.groupBy(*keys).agg(F.when(F.count_if(F.col(column).isNull()) == 0, F.sum(column)).alias(f"total_{column}"))


def first_seen(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Distinct keys in first-seen order, with their first position."""
    return rows.groupBy(key).agg(F.min(position).alias("first_position")).orderBy("first_position", key)


def schedule(examples: DataFrame, epochs: int, seed: int, window: int) -> DataFrame:
    """Each example (kind, id) once per epoch in hashed order: epoch, kind, id, sequence_index, and the optimizer window of `window` examples.

    The order is that of a digest. It is ranked in 4096 ranges of the digest for
    each kind and epoch, so no task sorts a kind whole; the ranges' counts, of
    bounded number, are summed in one ordered pass.
    """
    rows = examples.select("kind", "id", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    digest = F.sha2(F.concat_ws(":", F.lit(seed).cast("string"), F.col("epoch").cast("string"), "kind", F.col("id").cast("string")), 256)
    rows = rows.withColumn("digest", digest).withColumn("range", F.substring("digest", 1, 3))
    counts = rows.groupBy("kind", "epoch", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("kind").orderBy("epoch", "range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("kind", "epoch", "range").orderBy("digest", "id")) - 1
    out = rows.withColumn("place", place).join(counts, ["kind", "epoch", "range"]).withColumn("sequence_index", F.col("before") + F.col("place"))
    return out.withColumn("window", F.floor(F.col("sequence_index") / window)).select("kind", "id", "epoch", "sequence_index", "window")


def schedule_fingerprint(scheduled: DataFrame) -> DataFrame:
    """Per kind the digest of its ordered schedule, built from digests of windows so that no list grows with the schedule."""
    windows = scheduled.groupBy("kind", "window").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sequence_index", F.concat_ws(":", F.col("epoch").cast("string"), F.col("id").cast("string")).alias("key")))), lambda x: x["key"]), ","), 256).alias("digest"))
    total = F.sum(F.conv(F.substring(F.sha2(F.concat_ws(":", F.col("window").cast("string"), "digest"), 256), 1, 12), 16, 10).cast("decimal(38,0)"))
    return windows.groupBy("kind").agg(F.count("*").alias("windows"), F.pmod(total, F.lit(1 << 48).cast("decimal(38,0)")).cast("long").alias("fingerprint"))


def latest(rows: DataFrame, partition: str, order: str, n: int) -> DataFrame:
    """The n latest rows of each partition."""
    place = F.row_number().over(Window.partitionBy(partition).orderBy(F.desc(order)))
    return rows.withColumn("place", place).where(F.col("place") <= n).drop("place")


def remaining(rows: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Rows whose key the control table (key, status) doesn't have as completed: what a restart still has to do."""
    return rows.join(state.where("status = 'completed'").select(key), key, "left_anti")


def run_overview(episodes: DataFrame, maintenance: DataFrame) -> DataFrame:
    """Per run the ids of succeeded and of failed tasks in order, total reward, and the maintenance rounds in order."""
    ids = lambda good: F.array_sort(F.collect_list(F.when(good, F.col("task_id"))))
    done = F.col("status") == "completed"
    out = episodes.groupBy("run_id").agg(ids(done & (F.col("reward") > 0)).alias("success_ids"), ids(~done).alias("failed_ids"), F.sum(F.when(done, F.col("reward"))).alias("total_reward"))
    rounds = maintenance.groupBy("run_id").agg(F.array_sort(F.collect_set("round")).alias("rounds"))
    return out.join(rounds, "run_id", "left").withColumn("rounds", F.coalesce("rounds", F.expr("cast(array() as array<int>)")))


def memory_usage(candidates: DataFrame, tiers: DataFrame) -> DataFrame:
    """Per tier how many candidates (tier, selected, reason) were retrieved and selected, and how many were left out as incompatible."""
    counted = candidates.groupBy("tier").agg(F.count_if(F.col("reason").isNull()).alias("retrieved"), F.count_if(F.col("reason").isNull() & F.col("selected")).alias("selected"), F.count_if(F.col("reason").isNotNull()).alias("incompatible"))
    return tiers.join(counted, "tier", "left").fillna(0)


def bundle_revision(kinds: DataFrame, bundle: str) -> DataFrame:
    """Revision of each bundle of four kinds (bundle, kind, adapter_revision, latest_checkpoint), from canonical JSON with sorted kinds."""
    text = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1), F.lit("null"))
    entry = F.concat(text(F.col("kind")), F.lit(':{"adapter_revision":'), text(F.col("adapter_revision")), F.lit(',"latest_checkpoint":'), text(F.col("latest_checkpoint")), F.lit("}"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", entry.alias("entry")))), lambda x: x["entry"]), ",")
    body = F.concat(F.lit("{"), listed, F.lit("}"))
    return kinds.groupBy(bundle).agg(F.concat(F.lit("opd-four-lora-"), F.substring(F.sha2(body, 256), 1, 16)).alias("revision"))


def committed_prefix(scheduled: DataFrame, committed: DataFrame) -> DataFrame:
    """Per kind the schedule (kind, sequence_index, id) against committed steps (kind, sequence_index, id): how many are done, and whether they are exactly its prefix."""
    both = scheduled.select("kind", "sequence_index", F.col("id").alias("wanted")).join(committed.select("kind", "sequence_index", F.col("id").alias("done")), ["kind", "sequence_index"], "full_outer")
    out = both.groupBy("kind").agg(F.count("done").alias("committed"), F.max(F.when(F.col("done").isNotNull(), F.col("sequence_index"))).alias("last"), F.count_if(F.col("done").isNotNull() & ~F.col("done").eqNullSafe(F.col("wanted"))).alias("other"))
    return out.select("kind", "committed", ((F.col("other") == 0) & (F.coalesce("last", F.lit(-1)) == F.col("committed") - 1)).alias("is_prefix"))
