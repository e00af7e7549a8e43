"""Column expressions that operators are built from: text, keys, vectors, outcomes, actions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that Python's str.split() knows, as a regular-expression class.
WHITESPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Tiers in the order of declaration, and in that of retrieval.
TIERS = ("trajectory", "tip", "skill", "tool")
RETRIEVAL_ORDER = ("skill", "tip", "tool", "trajectory")
EXACT = 1e-12


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITESPACE}+|{WHITESPACE}+$", "")


def canonical_text(text: Column) -> Column:
    """Words joined by single spaces."""
    return F.trim(F.regexp_replace(text, f"{WHITESPACE}+", " "))


def stable_id(tier: Column, content: Column) -> Column:
    """Content-addressed key: equal tier and canonical content give the same id."""
    digest = F.sha2(F.concat(tier, F.lit("\0"), canonical_text(content)), 256)
    return F.concat(F.lit("mem_"), tier, F.lit("_"), F.substring(digest, 1, 20))


def bounded_text(text: Column, limit: int = 500) -> Column:
    return F.substring(strip(text), 1, limit)


def step_text(text: Column, limit: int = 500) -> Column:
    """Stripped, cut, stripped again; blank becomes null."""
    return F.nullif(strip(bounded_text(text, limit)), F.lit(""))


def task_group(text: Column) -> Column:
    """Canonical task group, or null where the name isn't allowed."""
    name = F.lower(strip(text))
    return F.when(name.rlike(r"^[a-z0-9][a-z0-9_.:-]*$"), name)


def normal_key(text: Column) -> Column:
    """Lower-case letters and digits of a key; for ASCII keys (others through a UDF, see leakage)."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def close_to(value: Column, target: float, tolerance: float = EXACT) -> Column:
    return F.abs(value - F.lit(target)) <= tolerance


def reward_class(reward: Column) -> Column:
    return F.when(close_to(reward, 1.0), "success").when(reward <= 0, "failure").otherwise("partial")


def outcome_policy(reward: Column, truncated: Column, evaluated: Column) -> Column:
    """Outcome class, polarity, allowed tiers and skip reason of an episode; the order of the branches matters."""

    def policy(outcome: str, polarity: str | None, tiers: Iterable[str], reason: str | None) -> Column:
        listed = F.array(*map(F.lit, tiers)) if tiers else F.expr("cast(array() as array<string>)")
        return F.struct(F.lit(outcome).alias("outcome_class"), F.lit(polarity).cast("string").alias("polarity"), listed.alias("allowed_tiers"), F.lit(reason).cast("string").alias("skip_reason"))

    return (
        F.when(truncated, policy("incomplete", None, (), "episode_truncated"))
        .when(~evaluated, policy("infra_failure", None, (), "missing_terminal_evaluation"))
        .when(close_to(reward, 1.0), policy("success", "positive", ("tip", "skill", "tool"), None))
        .otherwise(policy("task_failure", "caution", ("tip",), None))
    )


def outcome_labels(polarity: Column, outcome: Column, reward: Column) -> Column:
    """Explicit labels where both are valid; else caution for a known reward other than 1; else positive."""
    explicit = polarity.isin("positive", "caution") & outcome.isin("success", "task_failure", "incomplete", "infra_failure")
    label = lambda p, o: F.struct(p.alias("polarity"), o.alias("outcome"))
    return (
        F.when(explicit, label(polarity, outcome))
        .when(reward.isNotNull() & ~close_to(reward, 1.0), label(F.lit("caution"), F.lit("task_failure")))
        .otherwise(label(F.lit("positive"), F.lit("success")))
    )


def eligible(polarity: Column, tier: Column) -> Column:
    return ~((polarity == "caution") & tier.isin("skill", "tool"))


def as_doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def valid_vector(vector: Column, dimension: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dimension) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def cosine(left: Column, right: Column, invalid: float | None = None) -> Column:
    """Cosine of two vectors; `invalid` where they have no common dimension or no length."""
    length = norm(left) * norm(right)
    return F.when((F.size(left) == F.size(right)) & (length > 0), dot(left, right) / length).otherwise(F.lit(invalid).cast("double"))


def without_thinking(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""))


def final_action(text: Column) -> Column:
    """The action of a model's output and why it has none: struct (action, error)."""
    action = without_thinking(text)
    error = F.when(action == "", "no final action").when(F.lower(action).contains("<think>"), "unterminated thinking block")
    return F.struct(F.when(error.isNull(), F.when(action == "stop", "###STOP###").otherwise(action)).alias("action"), error.alias("error"))


def structured_action(action: Column) -> Column:
    """name and arguments (as JSON) of an action that is a JSON object; nulls where it is none."""
    parsed = F.from_json(action, "name string, arguments string", {"mode": "PERMISSIVE"})
    good = (F.trim(parsed["name"]) != "") & parsed["arguments"].startswith("{")
    return F.struct(F.when(good, F.trim(parsed["name"])).alias("name"), F.when(good, parsed["arguments"]).alias("arguments"))


def repaired_json(content: Column) -> Column:
    """JSON out of chatty text: what lies between the outermost braces, else the text without its code fence; stray backslashes doubled.

    One scan takes escapes as they come: a whole one stays, a backslash that starts none becomes two.
    """
    text = strip(content)
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    bare = strip(F.regexp_replace(text, r"(?s)^```[^\n]*\n?(.*?)(?:\s*```)?$", "$1"))
    body = F.when(braces != "", braces).otherwise(bare)
    return F.regexp_replace(body, r"""(\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})|(\\)""", "$1$2$2")


def credential_url(url: Column) -> Column:
    """Whether an http address carries user data, a query or a fragment."""
    parts = [F.try_parse_url(url, F.lit(p)) for p in ("USERINFO", "QUERY", "REF")]
    carried = F.coalesce(*parts).isNotNull() & (F.concat_ws("", *parts) != "")
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & carried, F.lit(False))


def truncated_prompt(tokens: Column, budget: int) -> Column:
    """The last `budget` tokens of a prompt."""
    return F.slice(tokens, F.greatest(F.lit(1), F.size(tokens) - budget + 1), F.lit(budget))


def response_positions(prompt_length: Column, response_length: Column) -> Column:
    """Positions whose logits predict the response: prompt - 1 up to prompt + response - 2."""
    return F.when(response_length > 0, F.sequence(prompt_length - 1, prompt_length + response_length - 2)).otherwise(F.expr("cast(array() as array<int>)"))


def script_key(text: Column) -> Column:
    """Lower-case letters and digits of any script."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def capabilities(mode: Column, memory: Column) -> Column:
    """What a run of a mode, with memory or without, may do."""
    train = mode == "train"
    return F.struct(
        memory.alias("can_read_memory"), (train & memory).alias("can_write_memory"), (train & memory).alias("can_run_maintenance"),
        train.alias("can_use_train_split"), (~train).alias("can_use_test_split"), memory.alias("source_memory_read_only"),
    )
