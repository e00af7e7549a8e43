"""What the corpus operators share on the Spark side: reading tables, scratch tables, batch mapping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null key inside the operators; results give null again.
NULL_KEY = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; Spark's own reader, so any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, *columns: str) -> DataFrame:
    """Only the columns that an operator looks at, so that others may be named as they like."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *columns)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def key_of(column: Column) -> Column:
    return F.coalesce(column, F.lit(NULL_KEY))


def key_back(column: Column) -> Column:
    return F.when(column != F.lit(NULL_KEY), column)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one's own only where the cluster names none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster, spark.checkpoint.dir has to name a folder that driver and executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage by a table in the shared folder: later readers don't depend on any executor's disk."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions; fragments are counted in it, so they follow the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def over_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str) -> DataFrame:
    """Maps Arrow batches one by one; `function` may return None for nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := function(batch)) is not None:
                if isinstance(out, pa.Table):
                    yield from out.to_batches()
                else:
                    yield out

    return df.mapInArrow(run, schema)
