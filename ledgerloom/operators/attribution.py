"""Outcome-calibrated attribution: what selecting a memory changed, against episodes that saw it and did not select it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default priors of the tiers.
PRIORS = {"trajectory": 0.9, "tip": 0.8, "skill": 1.0, "tool": 1.2}


def after_creation(observations: DataFrame, creators: DataFrame) -> DataFrame:
    """Observations (memory_id, episode_index, ...) strictly after the memory's creator (memory_id, creator_index); all where there is none."""
    joined = observations.join(creators.select("memory_id", "creator_index"), "memory_id", "left")
    return joined.where("creator_index is null or episode_index > creator_index").drop("creator_index")


def group_scores(observations: DataFrame) -> DataFrame:
    """Per memory and task group: counts and mean rewards of both sides; contribution is null for one-sided groups."""
    on, off = F.col("selected"), ~F.col("selected")
    sides = observations.groupBy("memory_id", "task_group").agg(
        F.count_if(on).alias("n_selected"),
        F.count_if(off).alias("n_control"),
        F.avg(F.when(on, F.col("reward"))).alias("mean_selected"),
        F.avg(F.when(off, F.col("reward"))).alias("mean_control"),
    )
    weight = F.col("n_selected") / (F.col("n_selected") + F.col("n_control"))
    both = (F.col("n_selected") > 0) & (F.col("n_control") > 0)
    return sides.withColumn("contribution", F.when(both, weight * (F.col("mean_selected") - F.col("mean_control"))))


def memory_scores(groups: DataFrame, facts: DataFrame, prior: Column, threshold: float = 0.01) -> DataFrame:
    """Per memory of `facts` (memory_id, tier): attribution, confidence and value; null value without a two-sided group."""
    totals = groups.groupBy("memory_id").agg(
        F.sum(F.col("n_selected") + F.col("n_control")).alias("retrieved_count"),
        F.sum("n_selected").alias("selected_count"),
        F.sum("contribution").alias("attribution"),
    )
    out = facts.join(totals, "memory_id", "left").fillna(0, ["retrieved_count", "selected_count"])
    confidence = 1 - 1 / F.sqrt(1 + F.col("selected_count"))
    out = out.withColumn("confidence", confidence).withColumn("value", prior * F.col("confidence") * F.col("attribution"))
    return out.withColumn("status", F.when(F.col("attribution").isNull(), "insufficient_evidence").otherwise("scored")).withColumn("qualified", F.coalesce(F.col("value") >= threshold, F.lit(False)))


def prior_of(tier: Column, priors: dict[str, float] = PRIORS) -> Column:
    out = F.lit(1.0)
    for name, value in priors.items():
        out = F.when(tier == name, F.lit(value)).otherwise(out)
    return out


def memory_facts(*sources: DataFrame) -> DataFrame:
    """Sources (memory_id, tier, version, creator_index or null) to one row per memory: versions, tier, creator; consistent says whether tier and creator are single."""
    seen = sources[0]
    for more in sources[1:]:
        seen = seen.unionByName(more)
    return seen.groupBy("memory_id").agg(
        F.min("tier").alias("tier"),
        F.array_sort(F.collect_set("version")).alias("versions"),
        F.min("creator_index").alias("creator_index"),
        ((F.count_distinct("tier") == 1) & (F.count_distinct("creator_index") <= 1)).alias("consistent"),
    )


def chronology_violations(observations: DataFrame, creators: DataFrame) -> DataFrame:
    """Observations counted at or before the creation of their memory."""
    return observations.join(creators.where("creator_index is not null"), "memory_id").where("episode_index <= creator_index").select("memory_id", "episode_index", "creator_index")
