"""Hand-computed attribution cases."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import attribution as a

OBS = "memory_id string, tier string, task_group string, episode_index int, selected boolean, reward double"


def score(spark, rows, tier="tip", creators=(), threshold=0.01):
    obs = spark.createDataFrame([("m", tier, g, i, s, r) for i, (g, s, r) in enumerate(rows)], OBS)
    made = spark.createDataFrame(list(creators), "memory_id string, creator_index int")
    groups = a.group_scores(a.after_creation(obs, made))
    facts = spark.createDataFrame([("m", tier)], "memory_id string, tier string")
    (out,) = a.memory_scores(groups, facts, a.prior_of(F.col("tier")), threshold).collect()
    return out


def test_equations(spark):
    rows = [("returns", True, 1.0), ("returns", True, 0.5), ("returns", False, 0.0), ("returns", False, 0.5), ("exchange", True, 1.0), ("exchange", False, 0.0)]
    out = score(spark, rows)
    assert (out.attribution, out.confidence, out.value) == pytest.approx((0.75, 0.5, 0.3))
    assert (out.retrieved_count, out.selected_count, out.status, out.qualified) == (6, 3, "scored", True)


def test_one_sided_group(spark):
    out = score(spark, [("g", True, 1.0)])
    assert out.attribution is None and out.value is None and out.status == "insufficient_evidence" and not out.qualified
    assert out.confidence == pytest.approx(1 - 1 / 2**0.5)


def test_negative_value(spark):
    out = score(spark, [("g", True, 0.0), ("g", False, 1.0)], tier="tool")
    assert out.value < 0 and out.status == "scored" and not out.qualified


def test_threshold_is_inclusive(spark):
    rows = [("g", True, 1.0), ("g", False, 0.0)]
    value = score(spark, rows).value
    assert score(spark, rows, threshold=value).qualified


def test_creator_is_excluded(spark):
    out = score(spark, [("g", True, 100.0), ("g", True, 1.0), ("g", False, 0.0)], tier="skill", creators=[("m", 0)])
    assert out.attribution == pytest.approx(0.5) and out.retrieved_count == 2


def test_only_creator(spark):
    out = score(spark, [("g", True, 100.0)], creators=[("m", 0)])
    assert out.retrieved_count == 0 and out.selected_count == 0 and out.value is None


def test_facts_and_chronology(spark):
    one = spark.createDataFrame([("m", "tip", 1, None), ("m", "tip", 2, 3), ("n", "tip", 1, None), ("n", "tool", 1, None)], "memory_id string, tier string, version int, creator_index long")
    got = {r.memory_id: (r.versions, r.creator_index, r.consistent) for r in a.memory_facts(one).collect()}
    assert got == {"m": ([1, 2], 3, True), "n": ([1], None, False)}
    obs = spark.createDataFrame([("m", "tip", "g", 3, True, 1.0), ("m", "tip", "g", 4, True, 1.0)], OBS)
    made = spark.createDataFrame([("m", 3)], "memory_id string, creator_index int")
    assert [r.episode_index for r in a.chronology_violations(obs, made).collect()] == [3]


def test_row_order_does_not_matter(spark):
    rows = [("g", True, 0.1 * i) for i in range(7)] + [("g", False, 0.2 * i) for i in range(5)]
    assert score(spark, rows).value == pytest.approx(score(spark, rows[::-1]).value)
