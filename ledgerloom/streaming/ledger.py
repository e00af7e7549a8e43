"""Event streams: append, fold by batch, and maintenance rounds that are due after every `period` episodes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.sources import scratch


def appended(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, files_per_batch: int = 16) -> StreamingQuery:
    """Appends event files of a folder to a table, each once; a restart continues at the committed prefix."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return events.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted_rounds(completed: DataFrame, control: str, period: int, run_rounds: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Runs the rounds that are due after each batch of completed episodes (namespace): every round once, in order.

    `run_rounds` gets the rounds (namespace, round) of one batch as a sorted table
    and gives what they make, a row for each round or more; where rounds can only
    run one after the other, it walks the table. Under the control folder lie each
    batch's counts and, published at once under the batch's number, what its rounds
    made: a failed batch leaves no trace, and a repeated batch or a restart does
    nothing twice. The work is a few jobs for each batch, however many rounds are due.
    """

    def batch(rows: DataFrame, number: int) -> None:
        session = rows.sparkSession
        final, staging = f"{control}/rounds/batch={number}", f"{control}/_staging-{number}"
        if scratch.exists(session, final):
            return
        rows.groupBy("namespace").agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{control}/counts/batch={number}")
        counts = session.read.schema("namespace string, n long, batch long").parquet(f"{control}/counts").where(F.col("batch") <= number)
        done = lambda n: F.floor(F.coalesce(F.sum(n), F.lit(0)) / period).cast("int")
        totals = counts.groupBy("namespace").agg(done(F.when(F.col("batch") < number, F.col("n"))).alias("first"), done(F.col("n")).alias("last")).where("last > first")
        due = totals.select("namespace", F.explode(F.sequence(F.col("first") + 1, F.col("last"))).alias("round")).orderBy("namespace", "round")
        scratch.delete(session, staging)
        run_rounds(due).write.parquet(staging)
        scratch.rename(session, staging, final)

    return completed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, kind: str, width: str, late: str) -> DataFrame:
    """Counts of each kind in tumbling windows of event time; events later than `late` are left out by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def committed_batches(events: DataFrame, fold: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """All or nothing: each batch is folded and published as a folder of its own under the batch's number; a failed batch leaves no trace."""

    def batch(rows: DataFrame, number: int) -> None:
        final, staging = f"{target}/generation={number}", f"{target}/_staging-{number}"
        session = rows.sparkSession
        if scratch.exists(session, final):
            return
        scratch.delete(session, staging)
        fold(rows).write.parquet(staging)
        scratch.rename(session, staging, final)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed_prefix(log: DataFrame, committed: DataFrame, key: str, position: str) -> DataFrame:
    """The rows of a log (key, position, ...) up to what is committed (key, position) of each key: what a restart may keep; keys without a commit lose all."""
    last = committed.groupBy(key).agg(F.max(position).alias("last_"))
    return log.join(last, key).where(F.col(position) <= F.col("last_")).drop("last_")
