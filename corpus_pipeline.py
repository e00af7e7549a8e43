"""The corpus pipeline: each stage works on all that the one before it kept.

Stages: quality rules (rejected documents go), line dedup (repeated chunks go,
and documents of which nothing is left), n-gram Jaccard join (one document of
each group of near copies stays), benchmark decontamination (contaminated
documents go), best-fit packing (where each piece of each document lies).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import decontaminate, jaccard, linededup, packing, quality
from ledgerloom.llm.runtime import table, written

STAGES = [
    ("quality_rules", quality.keep_good),
    ("line_dedup", linededup.without_repeats),
    ("jaccard_join", jaccard.one_of_each),
    ("decontaminate", decontaminate.keep_clean),
    ("best_fit_packing", packing.packed_stage),
]

#: The first and last stages (a fitted ratio, a search for few sequences) can't be told in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
