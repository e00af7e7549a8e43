"""Texts made from rows: transcripts, memories of each tier, and what is read from model output."""

from __future__ import annotations

import ast
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.kernels import strip, structured_action


def lines(*parts: tuple[str, Column]) -> Column:
    """`label: value` lines; null values leave their line out."""
    return F.concat_ws("\n", *(F.when(value.isNotNull(), F.concat(F.lit(f"{label}: "), value)) for label, value in parts))


def transcript(messages: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """One text per conversation: `role: text` for each message that isn't blank, in order."""
    said = strip(F.col(text))
    rows = messages.where(said != "").select(key, F.struct(turn, F.concat(F.col(role), F.lit(": "), said).alias("line")).alias("m"))
    out = rows.groupBy(key).agg(F.array_sort(F.collect_list("m")).alias("m"))
    return out.select(key, F.array_join(F.transform("m", lambda m: m["line"]), "\n").alias("rendered"), F.size("m").cast("long").alias("n"))


def tool_text(name: Column, purpose: Column, method: Column, preconditions: Column, rules: Column, effect: Column) -> Column:
    """A tool memory; argument rules in the order of their names."""
    listed = F.transform(F.array_sort(F.map_entries(rules)), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"]))
    return F.concat_ws(
        "\n",
        lines(("Tool", name), ("Purpose", purpose), ("Executable method", method), ("Preconditions", F.array_join(preconditions, "; "))),
        F.lit("Argument rules:"),
        F.when(F.size(rules) > 0, F.array_join(listed, "\n")),
        lines(("Expected effect", effect)),
    )


def trajectory_text(case: Column, episode: Column, group: Column, steps: Column, result: Column, reward: Column) -> Column:
    """A trajectory memory with one line for each step (order, action, reward, done)."""
    step = F.transform(steps, lambda s: F.concat(s["order"].cast("string"), F.lit(". "), s["action"], F.lit(" [reward="), s["reward"].cast("string"), F.lit(", done="), s["done"].cast("string"), F.lit("]")))
    return F.concat_ws(
        "\n",
        lines(("Case", case), ("Episode", episode), ("Task group", group)),
        F.lit("Observed steps:"),
        F.array_join(step, "\n"),
        F.concat(F.lit("Result: "), result, F.lit(" (final_reward="), reward.cast("string"), F.lit(")")),
    )


class _Literals(ast.NodeVisitor):
    """Values of literal syntax; a call by keywords at the top becomes its name and arguments, all else is refused."""

    def generic_visit(self, node: ast.AST):
        raise ValueError(f"{type(node).__name__} is no literal")

    def visit_Expression(self, node: ast.Expression) -> tuple[str, dict]:
        call = node.body
        match call:
            case ast.Call(func=ast.Name(id=name), args=[]):
                named = {k.arg: self.visit(k.value) for k in call.keywords}
                if None not in named:  # that is `**mapping`
                    return name, named
        return self.generic_visit(call)

    def visit_Constant(self, node: ast.Constant):
        return node.value

    def visit_UnaryOp(self, node: ast.UnaryOp):
        value = self.visit(node.operand)
        match node.op, value:
            case ast.USub(), int() | float() if not isinstance(value, bool):
                return -value
            case ast.UAdd(), int() | float() if not isinstance(value, bool):
                return value
        return self.generic_visit(node)

    def visit_List(self, node: ast.List | ast.Tuple) -> list:
        return [self.visit(x) for x in node.elts]

    visit_Tuple = visit_List

    def visit_Dict(self, node: ast.Dict) -> dict:
        return {self.visit(k): self.visit(v) for k, v in zip(node.keys, node.values)}


def _call(text: str) -> tuple[str | None, str | None]:
    try:
        name, arguments = _Literals().visit(ast.parse(text.strip(), mode="eval"))
        return name, json.dumps(arguments, sort_keys=True)
    except (SyntaxError, ValueError, TypeError, AttributeError, RecursionError):
        return None, None


def parsed_call(action: Column) -> Column:
    """name and arguments (canonical JSON) of `fn(key=literal)`; nulls where it is none."""

    @F.pandas_udf("name string, arguments string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            yield pd.DataFrame([_call(x) if x is not None else (None, None) for x in column], columns=["name", "arguments"])

    return run(action)


def _names(value) -> Iterator[str]:
    if isinstance(value, dict):
        if isinstance(value.get("name"), str):
            yield value["name"]
        for v in value.values():
            yield from _names(v)
    elif isinstance(value, list):
        for v in value:
            yield from _names(v)


def named_values(payload: Column) -> Column:
    """Sorted distinct texts under any key `name` in JSON."""

    @F.pandas_udf("array<string>")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda raw: sorted(set(_names(json.loads(raw)))) if raw is not None else None)

    return run(payload)


def tip_text(condition: Column, guidance: Column, rationale: Column) -> Column:
    return lines(("Condition", condition), ("Guidance", guidance), ("Rationale", rationale))


def _listed(values: Column) -> Column:
    """The values in one line, null where there are none."""
    return F.when(F.size(values) > 0, F.array_join(values, "; "))


def skill_text(goal: Column, preconditions: Column, steps: Column, success: Column, recovery: Column) -> Column:
    """A skill memory; steps are structs of order, instruction and, where there is one, success_signal."""
    signal = lambda s: F.when(s["success_signal"].isNotNull(), F.concat(F.lit(" Success signal: "), s["success_signal"]))
    step = F.transform(steps, lambda s: F.concat_ws("", s["order"].cast("string"), F.lit(". "), s["instruction"], signal(s)))
    return F.concat_ws("\n", lines(("Goal", goal), ("Preconditions", _listed(preconditions))), F.lit("Steps:"), F.array_join(step, "\n"), lines(("Success condition", success), ("Recovery", _listed(recovery))))


def observed_text(task: Column, case: Column, episode: Column, group: Column, steps: Column, result: Column, reward: Column, outcome: Column, lesson: Column) -> Column:
    """A trajectory memory of steps that keep their observation: order, observation, action, result, reward, done, terminated, truncated."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("string")

    def step(s: Column) -> Column:
        told = F.concat(F.lit("   Outcome: reward="), s["reward"].cast("string"), F.lit(", done="), flag(s["done"]), F.lit(", terminated="), flag(s["terminated"]), F.lit(", truncated="), flag(s["truncated"]))
        order = F.concat(s["order"].cast("string"), F.lit(". "))
        seen = F.concat_ws("\n", F.concat(order, F.lit("Observation: "), s["observation"]), F.concat(F.lit("   Action: "), s["action"]), F.concat(F.lit("   Result: "), s["result"]), told)
        plain = F.concat(order, s["action"], F.lit(" [reward="), s["reward"].cast("string"), F.lit(", done="), flag(s["done"]), F.lit("]"))
        return F.when(s["observation"].isNotNull(), seen).otherwise(plain)

    suffix = F.coalesce(F.concat(F.lit(", outcome_class="), outcome), F.lit(""))
    ending = F.concat(result, F.lit(" (final_reward="), reward.cast("string"), suffix, F.lit(")"))
    return F.concat_ws("\n", lines(("Task", task), ("Case", case), ("Episode", episode), ("Task group", group)), F.lit("Observed steps:"), F.array_join(F.transform(steps, step), "\n"), lines(("Result", ending), ("Lesson", lesson)))


def retrieval_text(tier: Column, *, condition: Column, guidance: Column, goal: Column, instructions: Column, tool: Column, purpose: Column, method: Column, task: Column, case: Column, outcome: Column, lesson: Column) -> Column:
    """What a memory of each tier is found by, parts that are missing or empty left out."""
    filled = lambda *parts: F.concat_ws(" ", *(F.nullif(p, F.lit("")) for p in parts))
    return (
        F.when(tier == "tip", F.concat_ws(" ", condition, guidance))
        .when(tier == "skill", F.concat(goal, F.lit(" "), F.array_join(instructions, " ")))
        .when(tier == "tool", filled(tool, purpose, method))
        .when(tier == "trajectory", filled(task, case, outcome, lesson))
    )


def decoded(output: Column, repair: Callable[[Column], Column], fallback: Column) -> Column:
    """The JSON object in a model's output, else in what `repair` makes of it, else the fallback: struct (value, how)."""
    fixed = repair(output)
    whole = lambda c: F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False))
    told = lambda c, how: F.struct(c.alias("value"), F.lit(how).alias("how"))
    return F.when(whole(output), told(output, "parsed")).when(whole(fixed), told(fixed, "repaired")).otherwise(told(fallback, "fallback"))


#: A call's name as it stands before its arguments.
CALL = r"^([A-Za-z_][A-Za-z0-9_]*)\("


def refused_action(action: Column, tools: Column) -> Column:
    """Why an action can't be run: its call, as JSON or as name(...), is malformed or of a tool that isn't there; null if it can."""
    structured = structured_action(action)
    name = F.regexp_extract(action, CALL, 1)
    return (
        F.when(action.startswith("{") & structured["name"].isNull(), F.lit("malformed_call"))
        .when(action.startswith("{") & ~F.array_contains(tools, structured["name"]), F.lit("unknown_tool"))
        .when((name != "") & ~action.endswith(")"), F.lit("malformed_call"))
        .when((name != "") & ~F.array_contains(tools, name), F.lit("unknown_tool"))
    )
