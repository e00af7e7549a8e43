"""Connected components of an edge table, by contracting it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.runtime import written

#: Up to so many edges (16 bytes each) are contracted on the driver; with more, tables are, until no more than these are left.
FEW = 500_000


def _least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, and the smallest node that each is connected with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(a):
        low = np.minimum(a, b)
        near = label.copy()
        np.minimum.at(near, a, low)
        np.minimum.at(near, b, low)
        while (near[near] != near).any():
            near = near[near]
        label = near[label]
        a, b = near[a], near[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[label]


def _few(edges: DataFrame) -> DataFrame:
    """(node, label) of a few edges, as a written table."""
    found = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).toArrow()
    node, label = _least(*(np.asarray(found[end]) for end in "ab"))
    return written(edges.sparkSession.createDataFrame(pa.table({"node": pa.array(node, pa.int64()), "label": pa.array(label, pa.int64())})), "step")


def _renamed(edges: DataFrame, step: DataFrame) -> DataFrame:
    """The edges between what their ends were merged into; each once, the smaller end first."""
    for end in "ab":
        edges = edges.join(step.select(F.col("node").alias(end), F.col("label").alias(f"to_{end}")), end)
    return edges.where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b): the label is the smallest node that it is connected with.

    Each round merges every node into the smallest of its neighbours, and into
    what that one merges into. Edges inside a merged node are gone, so rounds
    handle fewer and fewer rows. Minima are combined before the shuffle;
    rounds are written tables. Once few edges are left, the driver does the
    remaining rounds by itself, since each round of tables costs several shuffles
    however small they are.
    """
    left = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    few = left.count() <= FEW
    if not few:
        left = written(left.distinct(), "edges")
    labels = None
    while labels is None or not left.isEmpty():
        if few:
            step = _few(left)
        else:
            ends = left.select(F.col("a").alias("node"), F.col("a").alias("near")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("near")))
            near = ends.groupBy("node").agg(F.min("near").alias("near"))
            step = near.join(near.select(F.col("node").alias("near"), F.col("near").alias("far")), "near", "left")
            step = written(step.select("node", F.coalesce("far", "near").alias("label")), "step")
        if labels is None:
            labels = step
        else:
            moved = step.select(F.col("node").alias("label"), F.col("label").alias("to"))
            labels = written(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        if few:
            break
        left = written(_renamed(left, step), "edges")
        few = left.count() <= FEW
    return labels
