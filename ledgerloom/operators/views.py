"""Evidence rows and the four training views over candidates, scores, proposals and maintenance states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_snapshot(candidates: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Candidates (memory_id, version, tier, ...) with content and its hash from the snapshot (id, version, tier, content), or why not."""
    snap = snapshot.select(F.col("id").alias("memory_id"), F.col("version").alias("s_version"), F.col("tier").alias("s_tier"), "content")
    out = candidates.join(snap, "memory_id", "left")
    error = F.when(F.col("s_version").isNull(), "not_in_snapshot").when(F.col("version") != F.col("s_version"), "version_differs").when(F.col("tier") != F.col("s_tier"), "tier_differs")
    return out.withColumn("error", error).withColumn("content_sha256", F.sha2("content", 256)).drop("s_version", "s_tier")


def prefix_matched(items: DataFrame, snapshot: DataFrame, limit: int = 320) -> DataFrame:
    """Items (id, shown) against contents (id, content): equal, or the first `limit` characters at most."""
    out = items.join(snapshot.select("id", "content"), "id", "left")
    good = (F.col("shown") == F.col("content")) | ((F.char_length("shown") <= limit) & F.col("content").startswith(F.col("shown")))
    return out.select("id", F.coalesce(good, F.lit(False)).alias("matches"))


def missing_from(rows: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of the rows that the base doesn't have."""
    return rows.select(*keys).distinct().join(base.select(*keys), keys, "left_anti")


def write_errors(written: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, error) of writes (id, disposition, content): created ones must be new, replayed ones known, all in the later snapshot with equal content."""
    b = before.select("id", F.lit(True).alias("was"))
    a = after.select("id", F.lit(True).alias("is"), F.col("content").alias("stored"))
    out = written.join(b, "id", "left").join(a, "id", "left")
    error = (
        F.when((F.col("disposition") == "created") & F.col("was").isNotNull(), "created_but_known")
        .when((F.col("disposition") == "replayed") & F.col("was").isNull(), "replayed_but_unknown")
        .when(F.col("is").isNull(), "not_stored")
        .when(~F.col("content").eqNullSafe(F.col("stored")), "content_differs")
    )
    return out.select("id", error.alias("error")).where("error is not null")


def prior_counts(rounds: DataFrame, episodes: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Of each maintenance round (round, position) how many episodes (position) came up to it, and how many succeeded (reward 1).

    Running sums in two levels: positions are cut to ranges of `width`, each
    summed on its own; only the ranges' totals are summed in one ordered pass.
    """
    marks = rounds.select("position", F.col("round"), F.lit(0).alias("one"), F.lit(0).alias("good"))
    rows = episodes.select("position", F.lit(None).cast("long").alias("round"), F.lit(1).alias("one"), (F.col("reward") == 1.0).cast("int").alias("good"))
    rows = marks.unionByName(rows).withColumn("range", F.floor(F.col("position") / width))
    totals = rows.groupBy("range").agg(F.sum("one").alias("all_one"), F.sum("good").alias("all_good"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("range", *(F.coalesce(F.sum(f"all_{c}").over(before), F.lit(0)).alias(f"before_{c}") for c in ("one", "good")))
    within = Window.partitionBy("range").orderBy("position").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("prior", F.sum("one").over(within)).withColumn("succeeded", F.sum("good").over(within)).where("round is not null").join(totals, "range")
    return out.select("round", (F.col("prior") + F.col("before_one")).alias("prior"), (F.col("succeeded") + F.col("before_good")).alias("succeeded"))


def selection_view(candidates: DataFrame, scores: DataFrame, threshold: float = 0.01) -> DataFrame:
    """`sel`: of episodes with a candidate of |value| >= threshold, all candidates (memory_id, rank) with value as privileged part."""
    rows = candidates.join(scores.select("memory_id", "value"), "memory_id", "left")
    item = F.struct("rank", "memory_id", "value")
    out = rows.groupBy("episode_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.max(F.abs("value")).alias("most"))
    out = out.where(F.col("most") >= threshold)
    return out.select("episode_id", F.transform("items", lambda x: x["memory_id"]).alias("public_ids"), F.transform("items", lambda x: x["value"]).alias("privileged_values"))


def valuable_selected(selected: DataFrame, scores: DataFrame, threshold: float = 0.01, cap: int = 20) -> DataFrame:
    """Selected memories (episode_id, memory_id, rank) worth at least the threshold, the best `cap` of each episode: place from 1."""
    rows = selected.join(scores.select("memory_id", "value"), "memory_id").where(F.col("value") >= threshold)
    place = F.row_number().over(Window.partitionBy("episode_id").orderBy(F.desc("value"), "rank", "memory_id"))
    return rows.withColumn("place", place).where(F.col("place") <= cap)


def action_view(episodes: DataFrame, steps: DataFrame, valuable: DataFrame) -> DataFrame:
    """`act`: successful episodes (episode_id, reward) with steps (episode_id, turn): number of steps and the valuable memories in order."""
    n = steps.groupBy("episode_id").agg(F.count("*").alias("n_steps"))
    best = valuable.groupBy("episode_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "memory_id"))), lambda x: x["memory_id"]).alias("memories"))
    out = episodes.where("reward = 1.0").join(n, "episode_id").join(best, "episode_id", "left")
    return out.select("episode_id", "n_steps", F.coalesce("memories", F.expr("cast(array() as array<bigint>)")).alias("memories"))


def write_view(proposals: DataFrame, scores: DataFrame, threshold: float = 0.01) -> DataFrame:
    """`write`: model-made, newly committed memories (episode_id, memory_id, origin, disposition, creator_episode) with a later score, of episodes with one that matters."""
    rows = proposals.where("origin = 'llm' and disposition = 'created' and creator_episode = episode_id").join(scores.where("value is not null").select("memory_id", "value"), "memory_id")
    out = rows.groupBy("episode_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("memory_id", "value"))), lambda x: x["memory_id"]).alias("memories"), F.max(F.abs("value")).alias("most"))
    return out.where(F.col("most") >= threshold).select("episode_id", "memories")


def skip_reasons(episodes: DataFrame) -> DataFrame:
    """Counts of why episodes (n_candidates, n_scored, reward, n_steps) give no example: (reason, n)."""
    reasons = F.array(
        F.when(F.col("n_candidates") == 0, F.lit("sel_no_candidates")),
        F.when((F.col("n_candidates") > 0) & (F.col("n_scored") == 0), F.lit("sel_no_scored_candidate")),
        F.when(F.col("reward") != 1.0, F.lit("act_not_successful")),
        F.when((F.col("reward") == 1.0) & (F.col("n_steps") == 0), F.lit("act_no_trajectory")),
    )
    return episodes.select(F.explode(F.array_compact(reasons)).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def boundary_errors(examples: DataFrame) -> DataFrame:
    """(example_id, error) of examples (public_ids, privileged_ids, public_text, memory_texts): id sets differ, or a memory's text is in the public part."""
    shown = F.exists("memory_texts", lambda t: (t != "") & F.contains(F.col("public_text"), t))
    errors = F.array(F.when(F.array_sort(F.array_distinct("public_ids")) != F.array_sort(F.array_distinct("privileged_ids")), F.lit("id_sets_differ")), F.when(shown, F.lit("memory_text_public")))
    return examples.select("example_id", F.explode(F.array_compact(errors)).alias("error"))


def tool_compatibility(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """Tool memories (id, tool_name, arguments array) against tools (tool_name, declared array, required array): reason, null if compatible."""
    out = candidates.join(F.broadcast(registry), "tool_name", "left")
    wrong = (F.size(F.array_except("arguments", "declared")) > 0) | (F.size(F.array_except("required", "arguments")) > 0)
    reason = F.when(F.col("tool_name").isNull() | (F.col("tool_name") == ""), "invalid_tool_memory").when(F.col("declared").isNull(), "unavailable_tool").when(wrong, "incompatible_schema")
    return out.select("id", "tool_name", reason.alias("reason"))


def injected_tools(tools: DataFrame, memories: DataFrame, limit: int = 1600, most: int = 3) -> DataFrame:
    """Tools (tool_name, description) with the texts of their selected memories (tool_name, rank, text) appended in order: each cut, and as many as a selection may hold."""
    place = F.row_number().over(Window.partitionBy("tool_name").orderBy("rank"))
    chosen = memories.withColumn("place", place).where(F.col("place") <= most)
    texts = chosen.groupBy("tool_name").agg(F.array_sort(F.collect_list(F.struct("place", F.substring("text", 1, limit).alias("text")))).alias("own"))
    joined = tools.join(texts, "tool_name", "left")
    return joined.select("tool_name", F.concat_ws("\n", "description", F.array_join(F.transform("own", lambda x: x["text"]), "\n")).alias("description"))


def memory_histories(rounds: DataFrame, selections: DataFrame) -> DataFrame:
    """Of each maintenance round (round, position) and memory how many of the episodes (memory_id, position, reward) up to it selected it, and how many of these succeeded.

    A selection counts from the first round at or after it; running sums within a memory then give all rounds from there on.
    """
    marks = rounds.select("position", F.col("round").alias("mark"))
    steps = selections.select("position", F.lit(None).cast("long").alias("mark")).distinct().unionByName(marks.select("position", F.col("mark").cast("long")))
    width = 1 << 16
    steps = steps.withColumn("range", F.floor(F.col("position") / width))
    low = steps.groupBy("range").agg(F.min("mark").alias("own"))
    later = low.withColumn("after", F.min("own").over(Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1))).select("range", "after")
    ahead = F.min("mark").over(Window.partitionBy("range").orderBy(F.desc("position")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    first = steps.withColumn("ahead", ahead).join(F.broadcast(later), "range").select("position", F.coalesce("ahead", "after").alias("round")).where("round is not null").distinct()
    counted = selections.join(first, "position").groupBy("memory_id", "round").agg(F.count("*").alias("n"), F.count_if(F.col("reward") == 1.0).alias("good"))
    so_far = Window.partitionBy("memory_id").orderBy("round")
    return counted.select("memory_id", "round", F.sum("n").over(so_far).alias("selected"), F.sum("good").over(so_far).alias("succeeded"))


def skipped(episodes: DataFrame, candidates: DataFrame, written: DataFrame, scores: DataFrame, maintenance: DataFrame, threshold: float = 0.01) -> DataFrame:
    """How often each of six reasons kept an example from being made: (reason, n).

    episodes (episode_id, reward, n_steps), candidates (episode_id, memory_id, selected), written (episode_id, memory_id), scores (memory_id, value, status).
    """
    value = scores.select("memory_id", "value")
    best = candidates.join(value, "memory_id").groupBy("episode_id").agg(F.max(F.abs("value")).alias("most"), F.max(F.when(F.col("selected"), F.col("value"))).alias("chosen"))
    later = written.join(value, "memory_id", "left").groupBy("episode_id").agg(F.max(F.abs("value")).alias("wrote"), F.lit(True).alias("writes"))
    rows = episodes.join(best, "episode_id", "left").join(later, "episode_id", "left")
    low = lambda c: F.coalesce(F.col(c) < threshold, F.lit(True))
    count = {
        "no_scored_candidate": F.count_if(low("most")), "no_qualified_selected_memory": F.count_if(low("chosen")),
        "no_future_write_evidence": F.count_if(F.col("writes").isNotNull() & low("wrote")), "act_not_successful_or_empty_trajectory": F.count_if((F.col("reward") != 1.0) | (F.col("n_steps") == 0)),
    }
    told = rows.agg(*(c.alias(name) for name, c in count.items())).select(F.explode(F.map_from_arrays(F.array(*map(F.lit, count)), F.array(*count))).alias("reason", "n"))
    thin = scores.agg(F.count_if(F.col("status") == "insufficient_evidence").alias("n")).select(F.lit("insufficient_selected_control").alias("reason"), "n")
    none = maintenance.agg((F.count("*") == 0).cast("long").alias("n")).select(F.lit("no_committed_maintenance").alias("reason"), "n")
    return told.unionByName(thin).unionByName(none)


def episode_faults(candidates: DataFrame, snapshot: DataFrame, selected: DataFrame, written: DataFrame, after: DataFrame, turns: DataFrame, observations: DataFrame) -> DataFrame:
    """(episode_id, fault) of all integrity joins that an evidence row stands on.

    candidates and selected (episode_id, memory_id, ...), snapshots as in `with_snapshot` and `write_errors` (written with episode_id),
    turns (episode_id, turn), observations (episode_id, turn, observation, next_observation).
    """
    from ledgerloom.operators import folding

    told = lambda rows, name: rows.select("episode_id", (F.lit(name) if isinstance(name, str) else name).alias("fault"))
    parts = [
        told(with_snapshot(candidates, snapshot).where("error is not null"), F.col("error")),
        told(missing_from(selected, candidates, ["episode_id", "memory_id"]), "selected_not_retrieved"),
        told(written.select("id", "episode_id").join(write_errors(written.select("id", "disposition", "content"), snapshot, after), "id"), F.col("error")),
        told(folding.contiguous(turns, ["episode_id"], "turn").where("not contiguous"), "turn_gap"),
        told(folding.chained(observations, "episode_id", "turn", "observation", "next_observation"), "observation_chain"),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.distinct()


def maintenance_faults(shown: DataFrame, snapshot: DataFrame, prior: DataFrame, episodes: DataFrame, records: DataFrame) -> DataFrame:
    """(maintenance_id, fault): shown items (maintenance_id, id, shown) that don't match the snapshot, prior episodes (maintenance_id, episode_id) that aren't there or come later than the round's position."""
    unlike = prefix_matched(shown.select("id", "shown").distinct(), snapshot).where("not matches").select("id")
    first = shown.join(unlike, "id").select("maintenance_id", F.lit("content_differs").alias("fault"))
    known = prior.join(episodes.select("episode_id", F.col("position").alias("at")), "episode_id", "left").join(records.select("maintenance_id", "position"), "maintenance_id")
    second = known.where("at is null").select("maintenance_id", F.lit("unknown_episode").alias("fault"))
    third = known.where("at > position").select("maintenance_id", F.lit("later_episode").alias("fault"))
    return first.unionByName(second).unionByName(third).distinct()


def ledger_faults(evidence: DataFrame, expected: DataFrame) -> DataFrame:
    """(run_id, fault) of a ledger (run_id, kind, position, round) against expected counts (run_id, episodes, rounds): counts, one position each, rounds 1 .. n in order."""
    own = evidence.groupBy("run_id").agg(
        F.count_if(F.col("kind") == "episode").alias("n_episodes"), F.count_if(F.col("kind") == "maintenance").alias("n_rounds"),
        (F.count_distinct("position") < F.count("*")).alias("shared"), F.min("round").alias("low"), F.max("round").alias("high"), F.count_distinct("round").alias("rounds_seen"),
    )
    order = Window.partitionBy("run_id").orderBy("position")
    back = evidence.where("kind = 'maintenance'").withColumn("last", F.lag("round").over(order)).where("last >= round").select("run_id").distinct().withColumn("back", F.lit(True))
    both = expected.join(own, "run_id", "full_outer").join(back, "run_id", "left")
    faults = F.array(
        F.when(~F.col("episodes").eqNullSafe(F.col("n_episodes")), F.lit("episode_count")), F.when(~F.col("rounds").eqNullSafe(F.col("n_rounds")), F.lit("round_count")),
        F.when(F.col("shared"), F.lit("shared_position")), F.when((F.col("n_rounds") > 0) & ((F.col("low") != 1) | (F.col("high") != F.col("rounds_seen"))), F.lit("round_gap")), F.when(F.col("back"), F.lit("round_order")),
    )
    return both.select("run_id", F.explode(F.array_compact(faults)).alias("fault"))


def public_candidate(rows: DataFrame) -> DataFrame:
    """What a prompt may show of a candidate."""
    return rows.select("episode_id", F.struct("memory_id", "tier", "version", "content", "polarity", "rank").alias("candidate"))


def public_memory(rows: DataFrame) -> DataFrame:
    """What maintenance may show of a memory: no scores, embeddings or sources."""
    return rows.select(F.struct("id", "tier", "version", "status", "content").alias("memory"))


def public_step(rows: DataFrame) -> DataFrame:
    """What a prompt may show of a step."""
    return rows.select("episode_id", F.struct("turn", "observation", "action").alias("step"))


def trajectory_view(episodes: DataFrame, steps: DataFrame, valuable: DataFrame) -> DataFrame:
    """`act` with the whole solution: successful episodes (episode_id, reward), their steps (episode_id, turn, observation, action) in order, and the valuable memories."""
    solution = steps.groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("turn", "observation", "action"))).alias("trajectory"))  # an episode's turns are bounded
    best = valuable.groupBy("episode_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "memory_id"))), lambda x: x["memory_id"]).alias("memories"))
    out = episodes.where("reward = 1.0").join(solution, "episode_id").join(best, "episode_id", "left")
    return out.select("episode_id", "trajectory", F.coalesce("memories", F.expr("cast(array() as array<bigint>)")).alias("memories"))
