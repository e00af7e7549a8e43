"""Task splits: ordered ids with a digest, and configuration with dotted overrides."""

from __future__ import annotations

import copy
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_digest(tasks: DataFrame) -> DataFrame:
    """Per split (split, pos, task_id): number of tasks and sha256 of the compact JSON list of ids in order."""
    out = tasks.groupBy("split").agg(F.array_sort(F.collect_list(F.struct("pos", "task_id"))).alias("t"))
    return out.select("split", F.size("t").cast("long").alias("n"), F.sha2(F.to_json(F.transform("t", lambda x: x["task_id"])), 256).alias("digest"))


def with_overrides(config: dict[str, Any], overrides: dict[str, Any]) -> dict[str, Any]:
    """The configuration with dotted paths replaced; a path that isn't there is an error."""
    out = copy.deepcopy(config)
    for path, value in overrides.items():
        *parents, last = path.split(".")
        node = out
        for name in parents:
            if not isinstance(node, dict) or name not in node:
                raise KeyError(path)
            node = node[name]
        if not isinstance(node, dict) or last not in node:
            raise KeyError(path)
        node[last] = value
    return out
