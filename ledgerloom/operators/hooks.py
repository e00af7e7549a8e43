"""Where a caller plugs in: embedding models, scripted decisions, sinks of retrieval records, benchmarks by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.stores import cache_key

#: A model: texts to vectors, all of one dimension.
Embed = Callable[[list[str]], np.ndarray]


def embedded(texts: DataFrame, cache: DataFrame, load: Callable[[], Embed], revision: str, dimension: int, batch: int = 256) -> DataFrame:
    """Vectors (key, vector) of the distinct texts (text) that the cache (key, vector) doesn't have.

    `load` runs once in each task, so a model is loaded per task and not per
    batch; a vector of another dimension, or that isn't finite, stops the query.
    """
    misses = texts.where("text is not null").select("text").distinct().withColumn("key", cache_key(F.lit(revision), F.col("text")))
    misses = misses.join(cache.select("key"), "key", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                vectors = np.asarray(model(part["text"].tolist()), float)
                if vectors.shape != (len(part), dimension) or not np.isfinite(vectors).all():
                    raise ValueError(f"the model gave {vectors.shape} for {len(part)} texts of dimension {dimension}")
                yield pd.DataFrame({"key": part["key"], "vector": list(vectors)})

    return misses.select("key", "text").mapInPandas(run, "key string, vector array<double>")


def scripted(prompts: DataFrame, script: DataFrame, keys: list[str], default: str | None = None) -> DataFrame:
    """Prompts (keys, ...) with the decision (keys, output) that a script has for them, else the default; null where there is neither."""
    return prompts.join(script.select(*keys, "output"), keys, "left").withColumn("output", F.coalesce("output", F.lit(default)))


def recorded(records: DataFrame, path: str, batch: str) -> None:
    """Appends retrieval records as one batch; a batch that is repeated replaces itself, so a restart adds nothing twice."""
    records.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


@dataclass(frozen=True)
class Benchmark:
    """A named task set: its domain and how its tasks (task_id, split, position) are read."""

    name: str
    domain: str
    tasks: Callable[[SparkSession], DataFrame]


class Benchmarks:
    def __init__(self) -> None:
        self._known: dict[str, Benchmark] = {}

    def register(self, benchmark: Benchmark) -> None:
        if self._known.setdefault(benchmark.name, benchmark) is not benchmark:
            raise ValueError(f"benchmark {benchmark.name} is registered twice")

    def names(self) -> list[str]:
        return sorted(self._known)

    def tasks(self, spark: SparkSession, name: str, split: str) -> DataFrame:
        if name not in self._known:
            raise KeyError(f"unknown benchmark {name}; there are {self.names()}")
        return self._known[name].tasks(spark).where(F.col("split") == split)
