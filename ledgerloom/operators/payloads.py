"""Rules that memory payloads and maintenance decisions must meet, one row for each that is broken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.kernels import reward_class, strip

#: Two numbered or bulleted lines make a text a list of steps, which a tip must not be.
STEP_LINES = r"(?ms)^\s*(?:\d+[.)]|[-*])\s+\S.*^\s*(?:\d+[.)]|[-*])\s+\S"


def violations(rows: DataFrame, key: str) -> DataFrame:
    """(key, rule) for payload rows (text, orders array, guidance, values array): blank text, orders not 1 .. n, guidance of several steps, repeated values."""
    in_order = F.col("orders") == F.when(F.size("orders") > 0, F.sequence(F.lit(1), F.size("orders"))).otherwise(F.expr("cast(array() as array<int>)"))
    rules = F.array(
        F.when(F.coalesce(strip(F.col("text")) == "", F.lit(True)), F.lit("blank")),
        F.when(~in_order, F.lit("order")),
        F.when(F.col("guidance").rlike(STEP_LINES), F.lit("multi_step")),
        F.when(F.size(F.array_distinct("values")) < F.size("values"), F.lit("repeated_value")),
    )
    return rows.select(key, F.explode(F.array_compact(rules)).alias("rule"))


def review_violations(reviews: DataFrame, shown: DataFrame) -> DataFrame:
    """(id, rule) of reviews (id) that name an id that wasn't shown, or one twice."""
    counted = reviews.groupBy("id").agg(F.count("*").alias("n")).join(shown.select("id", F.lit(True).alias("there")), "id", "left")
    rule = F.when(F.col("there").isNull(), "not_shown").when(F.col("n") > 1, "repeated")
    return counted.select("id", rule.alias("rule")).where("rule is not null")


def reduction_due(active: int, capacity: int) -> bool:
    """Whether a maintenance decision must reduce the tips (of one namespace; `tip_reduction_due` tells it of all)."""
    return active > capacity


# Results and outcome classes that a trajectory may have.
RESULTS = ("success", "partial", "failure")
OUTCOMES = ("success", "task_failure", "infra_failure", "incomplete")


def _blank(value: Column) -> Column:
    return F.coalesce(strip(value) == "", F.lit(False))


def _values(values: Column) -> Column:
    """Whether a list has blank or repeated values."""
    clean = F.transform(values, strip)
    return F.coalesce(F.exists(clean, lambda v: v == "") | (F.size(F.array_distinct(clean)) < F.size(clean)), F.lit(False))


def _orders(steps: Column) -> Column:
    """Whether steps aren't numbered 1 .. n."""
    return F.exists(F.transform(steps, lambda s, i: s["order"] != i + 1), lambda wrong: F.coalesce(wrong, F.lit(True)))


def _finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) < float("inf"))


def _rules(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    return rows.select(key, F.explode(F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items())))).alias("rule"))


def tip_violations(rows: DataFrame, key: str) -> DataFrame:
    """(key, rule) of tips: condition, guidance, rationale, scope array."""
    blank = F.col("guidance").isNull() | _blank(F.col("guidance")) | _blank(F.col("condition")) | _blank(F.col("rationale"))
    return _rules(rows, key, {"blank": blank, "scope": _values(F.col("scope")), "multi_step": F.coalesce(F.col("guidance").rlike(STEP_LINES), F.lit(False))})


def skill_violations(rows: DataFrame, key: str) -> DataFrame:
    """(key, rule) of skills: goal, preconditions, steps (order, instruction, success_signal), success_condition, recovery."""
    texts = [F.col(c).isNull() | _blank(F.col(c)) for c in ("goal", "success_condition")]
    steps = F.exists("steps", lambda s: s["instruction"].isNull() | _blank(s["instruction"]) | _blank(s["success_signal"]))
    rules = {"blank": texts[0] | texts[1] | steps, "too_few_steps": F.coalesce(F.size("steps") < 2, F.lit(True)), "order": _orders(F.col("steps"))}
    return _rules(rows, key, rules | {"repeated_value": _values(F.col("preconditions")) | _values(F.col("recovery"))})


def tool_violations(rows: DataFrame, key: str) -> DataFrame:
    """(key, rule) of tools: tool_name, purpose, method, preconditions, argument_rules map, expected_effect."""
    needed = [F.col(c).isNull() | _blank(F.col(c)) for c in ("tool_name", "purpose", "expected_effect")]
    entries = F.map_entries("argument_rules")
    names = F.transform(entries, lambda e: strip(e["key"]))
    rules = {"blank": needed[0] | needed[1] | needed[2] | _blank(F.col("method")), "no_precondition": F.coalesce(F.size("preconditions") < 1, F.lit(True)), "repeated_value": _values(F.col("preconditions"))}
    return _rules(rows, key, rules | {"argument_rule": _values(names) | F.coalesce(F.exists(entries, lambda e: _blank(e["value"])), F.lit(False))})


def trajectory_violations(rows: DataFrame, key: str) -> DataFrame:
    """(key, rule) of trajectories: source_episode_id, task_group, initial_state, steps (order, action, reward), final_reward, result, outcome_class."""
    needed = F.lit(False)
    for c in ("source_episode_id", "task_group", "initial_state"):
        needed = needed | F.col(c).isNull() | _blank(F.col(c))
    last = F.element_at("steps", -1)["reward"]
    reward = F.col("final_reward")
    rules = {
        "blank": needed | F.exists("steps", lambda s: s["action"].isNull() | _blank(s["action"])),
        "no_steps": F.coalesce(F.size("steps") < 1, F.lit(True)),
        "order": _orders(F.col("steps")),
        "not_finite": ~_finite(reward) | F.exists("steps", lambda s: ~_finite(s["reward"])),
        "final_reward": F.coalesce(F.abs(F.when(F.size("steps") > 0, last) - reward) > F.greatest(F.lit(1e-12), 1e-12 * F.abs(reward)), F.lit(False)),
        "result": ~F.coalesce(F.col("result") == reward_class(reward), F.lit(False)),
        "outcome_class": F.coalesce(~F.col("outcome_class").isin(*OUTCOMES), F.lit(False)),
    }
    return _rules(rows, key, rules)


def argument_faults(calls: DataFrame, tools: DataFrame, key: str) -> DataFrame:
    """(key, fault) of example calls (key, tool_name, example_name, arguments JSON) against tools (tool_name, types map of JSON types, required array).

    A text in angle brackets stands for any value; a type that is missing or unknown allows all.
    """
    joined = calls.withColumn("tool_name", strip(F.col("tool_name"))).join(tools, "tool_name", "left").withColumn("names", F.coalesce(F.json_object_keys("arguments"), F.expr("cast(array() as array<string>)")))
    declared = F.map_keys("types")
    values = F.from_json("arguments", "map<string, variant>")

    def wrong(name: Column) -> Column:
        value = F.element_at(values, name)
        kind, wanted = F.schema_of_variant(value), F.element_at("types", name)
        text = kind == "STRING"
        free = text & F.variant_get(value, "$", "string").rlike(r"(?s)^<.*>$")
        number = kind.rlike(r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$")
        fits = (
            F.when(wanted == "string", text).when(wanted == "integer", kind == "BIGINT").when(wanted == "number", number).when(wanted == "boolean", kind == "BOOLEAN")
            .when(wanted == "array", kind.startswith("ARRAY")).when(wanted == "object", kind.startswith("OBJECT")).when(wanted == "null", kind == "VOID").otherwise(F.lit(True))
        )
        return ~free & ~fits

    rules = {
        "unavailable_tool": F.col("types").isNull(),
        "example_name": F.col("types").isNotNull() & (F.col("example_name") != F.col("tool_name")),
        "undeclared": F.size(F.array_except("names", declared)) > 0,
        "missing_required": F.size(F.array_except("required", "names")) > 0,
        "wrong_type": F.exists(F.array_intersect("names", declared), wrong),
    }
    return _rules(joined, key, rules)


def tip_reduction_due(items: DataFrame, namespaces: list[str], capacity: int = 200) -> DataFrame:
    """Namespaces whose active tips exceed the capacity, with their number: there a maintenance decision must reduce them."""
    active = items.where("tier = 'tip' and status = 'active'").groupBy(*namespaces).agg(F.count("*").alias("active_tips"))
    return active.where(F.col("active_tips") > capacity)
