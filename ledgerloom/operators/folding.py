"""Event logs folded to episodes, and the checks that a fold must meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The events of one task that occur once, or once at most.
REQUIRED = ("EpisodeStarted", "EpisodeFinished")
AT_MOST_ONE = ("MemoryCandidatesRetrieved", "MemorySelected", "MemoryDisabled", "MemoryWriteProposed", "MemoryWriteCommitted")


def episodes(events: DataFrame, keys: list[str], kind: str, turn: str, payload: str, required: tuple[str, ...] = REQUIRED, single: tuple[str, ...] = AT_MOST_ONE, steps: tuple[str, ...] = ("DecisionMade", "EnvironmentStepped")) -> DataFrame:
    """One row per task: the payload of each single event, the ordered steps, and `error` where the log isn't well-formed."""
    count = {k: F.count_if(F.col(kind) == k) for k in (*required, *single)}
    of = lambda k: F.max(F.when(F.col(kind) == k, F.col(payload)))
    step = F.collect_list(F.when(F.col(kind).isin(*steps), F.struct(F.col(turn).alias("turn"), F.col(kind).alias("kind"), F.col(payload).alias("payload"))))
    out = events.groupBy(*keys).agg(*(c.alias(f"n_{k}") for k, c in count.items()), *(of(k).alias(k) for k in count), F.array_sort(step).alias("steps"))
    error = F.lit(None).cast("string")
    if "MemorySelected" in count and "MemoryDisabled" in count:
        error = F.when((F.col("n_MemorySelected") > 0) & (F.col("n_MemoryDisabled") > 0), "selected_and_disabled").otherwise(error)
    for k in single:
        error = F.when(F.col(f"n_{k}") > 1, f"repeated:{k}").otherwise(error)
    for k in required:
        error = F.when(F.col(f"n_{k}") != 1, f"not_once:{k}").otherwise(error)
    return out.select(*keys, *count, "steps", error.alias("error"))


def step_integrity(decisions: DataFrame, steps: DataFrame, keys: list[str]) -> DataFrame:
    """Decisions and environment steps (keys, turn, action) matched on turn: one row per task with its first fault or null."""
    left = decisions.select(*keys, "turn", F.col("action").alias("decided"))
    right = steps.select(*keys, "turn", F.col("action").alias("stepped"))
    both = left.join(right, [*keys, "turn"], "full_outer")
    order = Window.partitionBy(*keys).orderBy("turn")
    place = F.row_number().over(order) - 1
    fault = F.when(F.col("decided").isNull(), "step_without_decision").when(F.col("stepped").isNull(), "decision_without_step").when(F.col("decided") != F.col("stepped"), "action_differs").when(place != F.col("turn"), "turn_gap")
    return both.withColumn("fault", fault).groupBy(*keys).agg(F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("turn"))).alias("fault"))


def disposition(proposals: DataFrame, created: DataFrame, replayed: DataFrame, discarded: DataFrame) -> DataFrame:
    """Proposals (id) with what became of them; a discard outweighs a replay, that a creation."""
    mark = lambda df, name: df.select("id").distinct().withColumn(name, F.lit(True))
    out = proposals.join(mark(discarded, "d"), "id", "left").join(mark(replayed, "r"), "id", "left").join(mark(created, "c"), "id", "left")
    return out.withColumn("disposition", F.when(F.col("d"), "discarded").when(F.col("r"), "replayed").when(F.col("c"), "created").otherwise("proposed")).drop("d", "r", "c")


def contiguous(rows: DataFrame, keys: list[str], position: str, start: int = 0) -> DataFrame:
    """Per key whether positions are start, start + 1, ... without gap or repeat."""
    out = rows.groupBy(*keys).agg(F.min(position).alias("low"), F.max(position).alias("high"), F.count_distinct(position).alias("n"), F.count("*").alias("rows"))
    good = (F.col("low") == start) & (F.col("n") == F.col("rows")) & (F.col("high") == start + F.col("rows") - 1)
    return out.select(*keys, F.col("rows"), good.alias("contiguous"))


def chained(rows: DataFrame, key: str, turn: str, observation: str, following: str) -> DataFrame:
    """Links (turn t to t + 1) whose next observation isn't the observation that follows."""
    ahead = F.lead(observation).over(Window.partitionBy(key).orderBy(turn))
    return rows.withColumn("ahead", ahead).where(F.col("ahead").isNotNull() & ~F.col(following).eqNullSafe(F.col("ahead"))).select(key, turn)


def last_step_rewards(messages: DataFrame, key: str, turn: str, role: str, reward: Column) -> DataFrame:
    """Decisions (assistant messages) with their step index; reward and done on the last one only; errors counts what stands between a decision and the next."""
    order = Window.partitionBy(key).orderBy(turn)
    is_step = F.col(role) == "assistant"
    rows = messages.withColumn("step", F.sum(is_step.cast("int")).over(order) - 1)
    steps = rows.where("step >= 0").groupBy(key, "step").agg(F.count_if(~is_step).alias("between"))
    last = F.max("step").over(Window.partitionBy(key)) == F.col("step")
    return steps.withColumn("done", last).withColumn("reward", F.when(F.col("done"), reward).otherwise(F.lit(0.0)))


def compacted(rows: DataFrame, key: str, turn: str, observation: str) -> DataFrame:
    """Drops the observations of tasks whose every observation begins with the one before: the last one tells all."""
    order = Window.partitionBy(key).orderBy(turn)
    grows = F.coalesce(F.col(observation).startswith(F.lag(observation).over(order)), F.lit(True))
    every = F.min("grows").over(Window.partitionBy(key)) & (F.count("*").over(Window.partitionBy(key)) > 1)
    last = F.lead(turn).over(order).isNull()
    return rows.withColumn("grows", grows).withColumn("cumulative", every).withColumn("kept", F.when(~F.col("cumulative") | last, F.col(observation))).drop("grows")


def triples(events: DataFrame, key: str, position: str, kind: str, wanted: tuple[str, ...]) -> DataFrame:
    """Keys whose events are exactly the wanted kinds in order, with a hash of the record."""
    order = F.array_sort(F.collect_list(F.struct(position, kind)))
    out = events.groupBy(key).agg(order.alias("log")).withColumn("kinds", F.transform("log", lambda x: x[kind]))
    return out.select(key, (F.col("kinds") == F.array(*map(F.lit, wanted))).alias("complete"), F.sha2(F.concat_ws(",", "kinds"), 256).alias("record_sha256"))


def coalesced_proposals(proposals: DataFrame) -> DataFrame:
    """Proposals (id, episode_index, content, source_task) grouped by id: conflict if contents differ; source tasks in first-seen order."""
    tasks = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("episode_index", "source_task"))), lambda x: x["source_task"]))
    return proposals.groupBy("id").agg((F.count_distinct("content") > 1).alias("conflict"), tasks.alias("source_tasks"), F.count("*").alias("contributions"), F.min("episode_index").alias("first_episode"))


def ownership(proposals: DataFrame, existing: DataFrame) -> DataFrame:
    """Proposals (id, episode_index) as created or replayed: the first episode owns an id that isn't there yet."""
    place = F.row_number().over(Window.partitionBy("id").orderBy("episode_index"))
    out = proposals.select("id", "episode_index").distinct().withColumn("place", place).join(existing.select("id", F.lit(True).alias("there")), "id", "left")
    return out.select("id", "episode_index", F.when(F.col("there").isNotNull() | (F.col("place") > 1), "replayed").otherwise("created").alias("outcome"))


def within_quota(proposals: DataFrame, key: str, tier: str, position: str, quotas: DataFrame) -> DataFrame:
    """Proposals with kept: the first of each tier up to its quota (tier, quota)."""
    place = F.row_number().over(Window.partitionBy(key, tier).orderBy(position))
    return proposals.withColumn("place", place).join(F.broadcast(quotas), tier, "left").withColumn("kept", F.col("place") <= F.coalesce("quota", F.lit(0))).drop("place", "quota")


def due_rounds(completed: DataFrame, done: DataFrame, period: int) -> DataFrame:
    """Rounds 1 .. floor(completed / period) of each namespace (namespace, completed) that aren't done (namespace, round), in order."""
    n = F.floor(F.col("completed") / period).cast("int")
    rounds = completed.where(n >= 1).select("namespace", F.explode(F.sequence(F.lit(1), n)).alias("round"))
    return rounds.join(done.select("namespace", "round"), ["namespace", "round"], "left_anti").orderBy("namespace", "round")


def maintenance_records(events: DataFrame, wanted: tuple[str, ...] = ("MaintenanceStarted", "MaintenanceProposed", "MaintenanceCommitted")) -> DataFrame:
    """One row per maintenance (maintenance_id): its events (position, kind, task_id, snapshot_id, round, trigger, period) folded, with the first rule that they break."""
    order = F.array_sort(F.collect_list(F.struct("position", "kind")))
    single = {c: F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))) for c in ("task_id", "snapshot_id", "round")}
    started = lambda c: F.max(F.when(F.col("kind") == wanted[0], F.col(c))).alias(c)
    out = events.groupBy("maintenance_id").agg(F.transform(order, lambda x: x["kind"]).alias("kinds"), *(n.alias(f"n_{c}") for c, n in single.items()), *map(started, ("snapshot_id", "round", "trigger", "period")))
    bad = lambda c: F.coalesce(F.col(c) <= 0, F.lit(True))
    error = (
        F.when(F.col("kinds") != F.array(*map(F.lit, wanted)), "incomplete")
        .when((F.col("n_task_id") > 1) | (F.col("n_snapshot_id") > 1) | (F.col("n_round") > 1), "crosses_provenance")
        .when(bad("round"), "round").when(bad("trigger"), "trigger").when(bad("period"), "period")
        .when(F.coalesce(F.trim("snapshot_id") == "", F.lit(True)), "snapshot_id")
    )
    return out.select("maintenance_id", "snapshot_id", "round", "trigger", "period", error.alias("error"))


def conflicting_proposals(proposals: DataFrame, same: list[str]) -> DataFrame:
    """Ids whose proposals (id, source_task, ...) differ in any of the columns that must be identical, with the first such column."""
    counts = [F.count_distinct(F.coalesce(F.to_json(F.struct(c)), F.lit(""))).alias(f"n_{c}") for c in same]
    out = proposals.groupBy("id").agg(*counts)
    first = F.coalesce(*(F.when(F.col(f"n_{c}") > 1, F.lit(c)) for c in same))
    return out.select("id", first.alias("differs")).where("differs is not null")


def simulation_steps(messages: DataFrame, key: str, turn: str, role: str, reward: Column, truncated: Column) -> DataFrame:
    """Decisions (assistant messages) as steps: reward and the end flags on the last one only, and the tool errors up to the next decision."""
    order = Window.partitionBy(key).orderBy(turn)
    is_step = F.col(role) == "assistant"
    rows = messages.withColumn("step", F.sum(is_step.cast("int")).over(order) - 1).where("step >= 0")
    steps = rows.groupBy(key, "step").agg(F.count_if((F.col(role) == "tool") & F.col("error")).alias("errors"), F.max(reward).alias("reward_"), F.max(truncated).alias("truncated_"))
    last = F.max("step").over(Window.partitionBy(key)) == F.col("step")
    out = steps.withColumn("done", last)
    return out.select(key, "step", "errors", F.when(F.col("done"), F.col("reward_")).otherwise(F.lit(0.0)).alias("reward"), "done", (F.col("done") & ~F.col("truncated_")).alias("terminated"), (F.col("done") & F.col("truncated_")).alias("truncated"))


def joined_results(tasks: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Tasks with their results; a task without one stops the query."""
    there = results.withColumn("there_", F.lit(True))
    out = tasks.join(there, key, "left")
    checked = F.when(F.col("there_").isNull(), F.raise_error(F.concat(F.lit("no result for task "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return out.where(checked).drop("there_")
