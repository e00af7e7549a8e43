"""Commands over the memory table: added, retired, merged, backfilled. Every function gives the new state, nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def added(items: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with the new rows whose id is absent, and the rejected rows."""
    ids = items.select("id")
    return items.unionByName(new.join(ids, "id", "left_anti")), new.join(ids, "id", "left_semi")


def looked_up(items: DataFrame, command: DataFrame) -> DataFrame:
    """(pos, id) of a lookup with the item's content, and found: whether it is there and active."""
    active = items.where("status = 'active'").select("id", "content", F.lit(True).alias("there"))
    return command.join(active, "id", "left").select("pos", "id", "content", F.coalesce("there", F.lit(False)).alias("found"))


def retired(items: DataFrame, commands: DataFrame) -> DataFrame:
    """Soft deletes (id, updated_round, reason): version + 1, round never back; a repeated command of the same round and reason changes nothing."""
    one = commands.groupBy("id").agg(F.max(F.struct("updated_round", "reason")).alias("c"))
    joined = items.join(one.select("id", F.col("c.updated_round").alias("c_round"), F.col("c.reason").alias("c_reason")), "id", "left")
    again = (F.col("status") == "retired") & F.col("c_round").eqNullSafe(F.col("updated_round")) & F.col("c_reason").eqNullSafe(F.col("reason"))
    due = F.col("c_round").isNotNull() & ~F.coalesce(again, F.lit(False))
    return joined.select(
        *(
            F.when(due, {"status": F.lit("retired"), "version": F.col("version") + 1, "updated_round": F.greatest("updated_round", "c_round"), "reason": F.col("c_reason")}[c]).otherwise(F.col(c)).alias(c)
            if c in ("status", "version", "updated_round", "reason")
            else F.col(c)
            for c in items.columns
        )
    )


def merge_errors(items: DataFrame, sources: DataFrame) -> DataFrame:
    """(merge_id, error) of merges (merge_id, id) that break a rule: unknown or retired sources, more than one tier, fewer than two sources."""
    joined = sources.join(items.select("id", "tier", "status"), "id", "left")
    checked = joined.groupBy("merge_id").agg(F.count_if(F.coalesce(F.col("status") != "active", F.lit(True))).alias("missing"), F.count_distinct("tier").alias("tiers"), F.count_distinct("id").alias("n"))
    error = F.when(F.col("missing") > 0, "source_not_active").when(F.col("tiers") > 1, "cross_tier").when(F.col("n") < 2, "too_few_sources")
    return checked.select("merge_id", error.alias("error")).where("error is not null")


def merged(items: DataFrame, sources: DataFrame, contents: DataFrame, new_id: Column) -> tuple[DataFrame, DataFrame]:
    """Disjoint merges (merge_id, id) into contents (merge_id, content, updated_round): the new rows, and the state of the sources afterwards.

    A new row has version 1, the sorted union of the source tasks, and its sources in merged_from; sources are retired into it.
    """
    joined = sources.join(items, "id")
    made = joined.groupBy("merge_id").agg(
        F.min("tier").alias("tier"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_task_ids")))).alias("source_task_ids"),
        F.array_sort(F.collect_set("id")).alias("merged_from"),
    )
    made = made.join(contents, "merge_id").withColumn("id", new_id)
    rows = made.select("merge_id", "id", "tier", "content", "source_task_ids", "merged_from", F.col("updated_round").alias("created_round"), "updated_round", F.lit(1).alias("version"), F.lit("active").alias("status"))
    gone = joined.select("merge_id", F.col("id").alias("source_id"), F.col("version").alias("old_version"), F.col("updated_round").alias("old_round")).join(made.select("merge_id", F.col("id").alias("into"), "updated_round"), "merge_id")
    after = gone.select("source_id", (F.col("old_version") + 1).alias("version"), F.greatest("old_round", "updated_round").alias("updated_round"), F.concat(F.lit("merged into "), F.col("into")).alias("reason"))
    return rows, after


def normalised_commands(commands: DataFrame) -> DataFrame:
    """Exploded commands (seq, kind merge / delete / review, id, verdict) without conflicts.

    A merge loses sources that a review keeps as they are and needs two; deletes
    lose ids that a remaining merge uses, a review keeps, or an earlier delete named.
    """
    kept = commands.where("kind = 'review' and verdict = 'keep'").select("id").distinct()
    merges = commands.where("kind = 'merge'").join(kept, "id", "left_anti")
    merges = merges.withColumn("n", F.count("*").over(Window.partitionBy("seq"))).where("n >= 2").drop("n")
    deletes = commands.where("kind = 'delete'").join(kept, "id", "left_anti").join(merges.select("id").distinct(), "id", "left_anti")
    deletes = deletes.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("seq"))).where("k = 1").drop("k")
    return merges.unionByName(deletes).select("seq", "kind", "id")


def merged_payload(sources: DataFrame, guidance: Column) -> DataFrame:
    """Typed merge (merge_id, tier, id, tool_name, success_count, usage_count, updated_round, version): the representative's payload with replaced guidance, or why there is none."""
    rank = F.struct("success_count", "usage_count", "updated_round", "version", "id")
    best = sources.groupBy("merge_id").agg(F.max_by("id", rank).alias("representative"), F.min("tier").alias("tier"), F.count_distinct("tier").alias("tiers"), F.count_distinct("tool_name").alias("tools"))
    error = F.when(F.col("tiers") > 1, "cross_tier").when(F.col("tier") == "trajectory", "not_mergeable").when((F.col("tier") == "tool") & (F.col("tools") > 1), "tool_names_differ")
    field = F.when(F.col("tier") == "tip", "guidance").when(F.col("tier") == "skill", "goal").when(F.col("tier") == "tool", "purpose")
    return best.select("merge_id", "representative", "tier", F.when(error.isNull(), field).alias("replaced_field"), F.when(error.isNull(), guidance).alias("replacement"), error.alias("error"))


def backfilled(items: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Items with new vectors (id, embedding, revision) where there are any."""
    new = embeddings.select("id", F.col("embedding").alias("new_embedding"), F.col("revision").alias("new_revision"))
    out = items.join(new, "id", "left").withColumn("embedding", F.coalesce("new_embedding", "embedding")).withColumn("embedding_model_revision", F.coalesce("new_revision", "embedding_model_revision"))
    return out.select(items.columns)


def replayed_ids(commands: DataFrame) -> DataFrame:
    """Ordered commands of each batch (batch, seq, kind, ids array, new_id) to result rows: batch, result (looked_up, created, updated), id, each once."""
    looked = commands.where("kind = 'lookup'").select("batch", F.lit("looked_up").alias("result"), F.explode("ids").alias("id"))
    made = commands.where("kind = 'merge'").select("batch", F.lit("created").alias("result"), F.col("new_id").alias("id"))
    changed = commands.where("kind in ('merge', 'delete')").select("batch", F.lit("updated").alias("result"), F.explode("ids").alias("id"))
    return looked.unionByName(made).unionByName(changed).distinct()


def replayed(commands: DataFrame) -> DataFrame:
    """The same as one row of sorted lists per batch; a batch is what one decision holds."""
    pick = lambda result: F.array_sort(F.collect_set(F.when(F.col("result") == result, F.col("id")))).alias(result)
    return replayed_ids(commands).groupBy("batch").agg(*map(pick, ("looked_up", "created", "updated")))


def next_generation(state: DataFrame, expected: int) -> DataFrame:
    """Compare-and-set of the one control row: generation, and whether the commit holds."""
    holds = F.col("generation") == expected
    return state.select((F.col("generation") + holds.cast("int")).alias("generation"), holds.alias("committed"))


def bound_to_round(commands: DataFrame, round_: Column) -> DataFrame:
    """Commands with the runtime's round in place of any that a model gave to a merge or a delete."""
    return commands.withColumn("updated_round", F.when(F.col("kind").isin("merge", "delete"), round_).otherwise(F.col("updated_round")))


def generation_commits(states: DataFrame, commits: DataFrame) -> DataFrame:
    """Compare-and-set of control rows (namespace, generation) by commits (namespace, expected, completed_tasks, snapshot_id).

    A commit holds if it expects the generation that is there; of several that do, the one of the least snapshot id.
    Result: namespace, generation, completed_tasks, snapshot_id, committed; namespaces without a commit that holds keep their generation.
    """
    fitting = commits.join(states, "namespace").where(F.col("expected") == F.col("generation"))
    won = fitting.groupBy("namespace").agg(F.min(F.struct("snapshot_id", "completed_tasks")).alias("won"))
    out = states.join(won, "namespace", "left")
    return out.select("namespace", (F.col("generation") + F.col("won").isNotNull().cast("int")).alias("generation"), "won.completed_tasks", "won.snapshot_id", F.col("won").isNotNull().alias("committed"))


def merge_payloads(sources: DataFrame, contents: DataFrame) -> DataFrame:
    """Merges (merge_id, tier, id, payload JSON, ranks as in merged_payload) with contents (merge_id, content): the representative's payload with its main text replaced."""
    picked = merged_payload(sources, F.lit(None).cast("string")).drop("replacement")
    payloads = sources.select("merge_id", F.col("id").alias("representative"), "payload")
    out = picked.join(payloads, ["merge_id", "representative"]).join(contents, "merge_id")
    fields = F.from_json("payload", "map<string, variant>")
    rest = F.map_filter(fields, lambda k, v: k != F.col("replaced_field"))
    made = out.withColumn("content_of", F.array("content")).withColumn("payload", F.when(F.col("error").isNull(), F.to_json(F.map_concat(rest, F.create_map("replaced_field", F.variant_get(F.parse_json(F.to_json("content_of")), "$[0]", "variant"))))))
    return made.select("merge_id", "representative", "tier", "payload", "error")


def committed_batch(items: DataFrame, batch: DataFrame, faults: DataFrame) -> tuple[DataFrame, list[str]]:
    """All or nothing: with no fault, the items of the tiers that the batch (rows like items) touches, and these tiers; else nothing.

    Rows of the batch replace items of the same id. Only touched tiers are to be written again.
    """
    if not faults.isEmpty():
        return items.limit(0), []
    tiers = sorted(r.tier for r in batch.select("tier").distinct().collect())  # four at most
    kept = items.where(F.col("tier").isin(*tiers)).join(batch.select("id"), "id", "left_anti") if tiers else items.limit(0)
    return kept.select(items.columns).unionByName(batch.select(items.columns)), tiers


def _once(merges: DataFrame) -> DataFrame:
    """Merges (seq, new_id, id) without exact repeats: of equal results from equal sources the first counts."""
    whole = merges.groupBy("seq", "new_id").agg(F.array_sort(F.collect_set("id")).alias("ids"))  # a merge's sources are bounded
    first = whole.groupBy("new_id", "ids").agg(F.min("seq").alias("seq"))
    return first.select("seq", "new_id", F.explode("ids").alias("id"))


def merge_sequence_errors(items: DataFrame, merges: DataFrame) -> DataFrame:
    """(seq, error) of merges (seq, new_id, id) in order, which is all or nothing: a source that isn't there yet or not active, or that an earlier merge used; a result that is there.

    A merge may use what an earlier one made; one that only repeats an earlier one is a replay and no error.
    """
    once = _once(merges)
    there = items.select("id", F.lit(-1).cast("long").alias("since"), (F.col("status") == "active").alias("usable"))
    made = once.select(F.col("new_id").alias("id"), F.col("seq").cast("long").alias("since"), F.lit(True).alias("usable")).distinct()
    found = there.unionByName(made).groupBy("id").agg(F.min(F.when(F.col("usable"), F.col("since"))).alias("since"))
    used = once.groupBy("id").agg(F.min("seq").alias("user"))
    joined = once.join(found, "id", "left").join(used, "id")
    source = F.when(F.col("since").isNull() | (F.col("since") >= F.col("seq")), "source_not_active").when(F.col("user") < F.col("seq"), "source_used")
    wrong = joined.select("seq", source.alias("error")).where("error is not null")
    results = once.select("seq", "new_id").distinct().join(items.select(F.col("id").alias("new_id")), "new_id", "left_semi").select("seq", F.lit("result_exists").alias("error"))
    return wrong.unionByName(results).distinct()


def merged_sequence(items: DataFrame, merges: DataFrame) -> DataFrame:
    """What merges without errors make: new_id, tier, source_task_ids (sorted union over all items it goes back to), merged_from, status (retired if a later merge used it)."""
    from ledgerloom.operators.audit import lineage_closure

    once = _once(merges)
    reach = lineage_closure(once.select(F.col("id").alias("parent"), F.col("new_id").alias("child")))
    roots = reach.join(items.select(F.col("id").alias("ancestor"), "tier", "source_task_ids"), "ancestor")
    tasks = roots.select(F.col("descendant").alias("new_id"), "tier", F.explode("source_task_ids").alias("task")).groupBy("new_id").agg(F.min("tier").alias("tier"), F.array_sort(F.collect_set("task")).alias("source_task_ids"))
    direct = once.groupBy("new_id").agg(F.array_sort(F.collect_set("id")).alias("merged_from"))
    used = once.select(F.col("id").alias("new_id"), F.lit(True).alias("used")).distinct()
    out = direct.join(tasks, "new_id", "left").join(used, "new_id", "left")
    return out.select("new_id", "tier", "source_task_ids", "merged_from", F.when(F.col("used"), "retired").otherwise("active").alias("status"))
