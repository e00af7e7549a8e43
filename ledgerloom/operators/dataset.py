"""A published training dataset as tables, and its audit: 33 codes, each one declarative check.

Every check is a projection, an anti-join or an aggregate over the tables, so
none of them gathers a dataset anywhere; the checks become one table of errors.
What is stored is compared with what is recomputed by `exceptAll` on digests.

Cases: empty tables break only the rules that want rows; a null key counts as
missing; repeated errors are told once.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.leakage import canonical_json, payload_leaks
from ledgerloom.operators import attribution, audit, views

SCHEMA_VERSION = 2
# The artifacts of a dataset, and what one sample of each kind stands for.
EVIDENCE, SCORES = "evidence/episodes.jsonl", "attribution/memory_scores.jsonl"
UNITS = {"sel": "task", "act": "task", "write": "task", "maint": "maintenance_round"}
ARTIFACTS = (EVIDENCE, SCORES, *(f"datasets/{kind}.jsonl" for kind in UNITS))

LINEAGE = ("memory_generation", "model_revision", "adapter_revision", "runtime_revision", "split_sha256")
_LINEAGE = "memory_generation int, model_revision string, adapter_revision string, runtime_revision string, split_sha256 string"
#: Schemas of the tables. `line` is a row of an artifact as it was written; `digest` a hash of a whole canonical row.
TABLES = {
    "manifest": f"build_id string, schema_version int, unit_contract string, sampling_contract string, audit_passed boolean, train_task_ids array<string>, train_task_ids_sha256 string, snapshot_chain array<string>, maintenance_snapshot_ids array<string>, counts map<string,bigint>, {_LINEAGE}",
    "sources": "ordinal int, run_id string, task_ids array<string>, tasks_before int, tasks_after int, snapshot_before string, snapshot_after string",
    "artifacts": "path string, sha256 string, line_count bigint",
    "files": "path string, sha256 string, rows bigint",
    "lines": "path string, number bigint, line string",
    "evidence": f"position bigint, kind string, id string, run_id string, task_id string, task_group string, seed int, final_reward double, n_steps int, snapshot_id string, round int, prior_ids array<string>, digest string, {_LINEAGE}",
    "rebuilt": "id string, digest string",
    "candidates": "episode_id string, memory_id string, tier string, rank int, selected boolean",
    "known_memories": "memory_id string, creator_episode_id string",
    "scores": "memory_id string, tier string, creator_episode_id string, source_episode_ids array<string>, group_episode_ids array<string>, value double, attribution double, confidence double, status string",
    "examples": "file string, example_id string, kind string, sampling_contract string, sample_unit string, episode_id string, maintenance_id string, seed int, task_id string, task_group string, memory_generation int, round int, trajectory_episode_id string, step_count int, public_input string, public_ids array<string>, privileged_ids array<string>, memory_texts array<string>, digest string",
    "references": "file string, memory_id string, tier string, value double, attribution double, confidence double, status string",
    "expected": "kind string, example_id string, digest string",
}


@dataclass(frozen=True)
class Dataset:
    """The tables of TABLES: what is published, and with `rebuilt` and `expected` what sources and rules give."""

    manifest: DataFrame
    sources: DataFrame
    artifacts: DataFrame
    files: DataFrame
    lines: DataFrame
    evidence: DataFrame
    rebuilt: DataFrame
    candidates: DataFrame
    known_memories: DataFrame
    scores: DataFrame
    examples: DataFrame
    references: DataFrame
    expected: DataFrame

    def but(self, **tables: DataFrame) -> Dataset:
        return replace(self, **tables)


def _told(rows: DataFrame, broken: Column, message: Column | str) -> DataFrame:
    return rows.where(F.coalesce(broken, F.lit(False))).select((F.lit(message) if isinstance(message, str) else message.cast("string")).alias("message"))


def _blank(column: str) -> Column:
    return F.coalesce(F.trim(F.col(column)) == "", F.lit(True))


def _without(rows: DataFrame, base: DataFrame, keys: dict[str, str], message: str) -> DataFrame:
    """Messages of rows whose keys (own: the base's) aren't in the base; a null key counts as absent."""
    there = base.select(*(F.col(b).alias(f"b_{a}") for a, b in keys.items())).distinct()
    return rows.join(there, reduce(Column.__and__, (F.col(a) == F.col(f"b_{a}") for a in keys)), "left_anti").select(F.col(message).alias("message"))


def ids_sha256(ids: Column) -> Column:
    """Digest of a list of ids as compact JSON."""
    return F.sha2(F.to_json(ids), 256)


def manifest_checks(d: Dataset) -> list[tuple[str, str, DataFrame]]:
    m, s = d.manifest, d.sources
    train = m.select(F.explode("train_task_ids").alias("task_id"))
    tasks = s.select("run_id", F.explode("task_ids").alias("task_id"))
    none = s.agg(F.count("*").alias("n"))
    ahead = s.select((F.col("ordinal") - 1).alias("ordinal"), F.col("tasks_before").alias("next"))
    chain = s.agg(F.array_sort(F.collect_list(F.struct("ordinal", "snapshot_before", "snapshot_after"))).alias("c"))  # a row for each source run
    expected = F.concat(F.slice(F.transform("c", lambda x: x["snapshot_before"]), 1, 1), F.transform("c", lambda x: x["snapshot_after"]))
    named = d.artifacts.select("path").distinct().agg(F.array_sort(F.collect_list("path")).alias("paths"))
    repeats = F.size(F.array_distinct("maintenance_snapshot_ids")) < F.size("maintenance_snapshot_ids")
    return [
        ("manifest_invalid", "manifest", _told(m, _blank("build_id"), "no build id")),
        ("manifest_invalid", "manifest", _told(m, ~F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION)), "schema version")),
        ("manifest_invalid", "manifest", _told(m, ~F.coalesce("audit_passed", F.lit(False)), "not marked as audited")),
        ("manifest_invalid", "manifest", _told(none, F.col("n") == 0, "no source runs")),
        ("manifest_invalid", "manifest", _told(s, _blank("run_id") | F.col("task_ids").isNull(), F.concat(F.lit("source run "), F.col("ordinal").cast("string")))),
        ("manifest_invalid", "manifest", _told(named, F.col("paths") != F.array(*map(F.lit, sorted(ARTIFACTS))), "set of artifacts")),
        ("sample_unit_contract_invalid", "manifest", _told(m, ~F.col("unit_contract").eqNullSafe(F.lit(unit_contract())), "unit contract")),
        ("non_train_source", "manifest", _told(m, _blank("split_sha256"), "no split digest")),
        ("non_train_source", "manifest", _told(m, F.col("train_task_ids").isNull() | (F.size(F.array_distinct("train_task_ids")) < F.size("train_task_ids")), "train task ids")),
        ("non_train_source", "manifest", _told(m, ~F.col("train_task_ids_sha256").eqNullSafe(ids_sha256(F.col("train_task_ids"))), "digest of train task ids")),
        ("non_train_source", "manifest", _without(tasks, train, {"task_id": "task_id"}, "task_id")),
        ("duplicate_source_identity", "manifest", audit.duplicates(tasks, ["run_id", "task_id"]).select(F.concat_ws(":", "run_id", "task_id").alias("message"))),
        ("duplicate_source_identity", "manifest", audit.duplicates(s, ["run_id"]).select(F.col("run_id").alias("message"))),
        ("source_lineage_invalid", "manifest", _told(s.join(ahead, "ordinal"), ~F.col("tasks_after").eqNullSafe(F.col("next")), F.concat(F.lit("tasks after run "), F.col("ordinal").cast("string")))),
        ("source_lineage_invalid", "manifest", _told(m.crossJoin(F.broadcast(chain)), ~F.col("snapshot_chain").eqNullSafe(expected) | F.exists(expected, lambda x: F.coalesce(x == "", F.lit(True))), "snapshot chain")),
        ("source_lineage_invalid", "manifest", _told(m, repeats, "maintenance snapshots")),
        ("manifest_count_mismatch", "manifest", _counts(d)),
    ]


def unit_contract() -> str:
    return ",".join(f"{kind}={unit}" for kind, unit in UNITS.items())


def _counts(d: Dataset) -> DataFrame:
    """Names whose count in the manifest isn't that of the rows."""
    of = lambda name, rows: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    parts = [of("evidence_episodes", d.evidence.where("kind = 'episode'").select("id").distinct()), of("evidence_maintenance", d.evidence.where("kind = 'maintenance'").select("id").distinct()), of("memory_scores", d.scores.select("memory_id").distinct())]
    parts += [of(kind, d.examples.where(F.col("file") == f"datasets/{kind}.jsonl")) for kind in UNITS]
    actual = reduce(DataFrame.unionByName, parts)
    stated = d.manifest.select(F.explode("counts").alias("name", "stated"))
    both = actual.join(stated, "name", "full_outer")
    return both.where(~F.col("n").eqNullSafe(F.col("stated"))).select(F.col("name").alias("message"))


def artifact_checks(d: Dataset) -> list[tuple[str, str, DataFrame]]:
    wanted = d.manifest.sparkSession.createDataFrame([(p,) for p in ARTIFACTS], "path string")
    both = d.artifacts.join(d.files.withColumnsRenamed({"sha256": "actual"}), "path")
    parsed = d.lines.withColumn("value", F.try_parse_json("line"))
    bad = F.col("value").isNull() | ~F.schema_of_variant("value").startswith("OBJECT")
    place = F.concat_ws(":", "path", F.col("number").cast("string"))
    good = parsed.where(~bad).select(place.alias("place"), "line")
    return [
        ("artifact_missing", "artifacts", _without(wanted, d.artifacts, {"path": "path"}, "path")),
        ("artifact_missing", "artifacts", _without(d.artifacts, d.files, {"path": "path"}, "path")),
        ("artifact_hash_mismatch", "artifacts", _told(both, F.col("sha256") != F.col("actual"), F.col("path"))),
        ("artifact_line_count_mismatch", "artifacts", _told(both, F.col("line_count") != F.col("rows"), F.col("path"))),
        ("artifact_jsonl_invalid", "artifacts", _told(parsed, bad, place)),
        ("artifact_noncanonical", "artifacts", _told(good, F.col("line") != canonical_json(F.col("line")), F.col("place"))),
        ("artifact_forbidden_content", "artifacts", payload_leaks(good, "place", "line").select(F.concat_ws(" ", "place", "path", "rule").alias("message"))),
    ]


def evidence_checks(d: Dataset) -> list[tuple[str, str, DataFrame]]:
    e, m = d.evidence, d.manifest
    episodes, rounds = e.where("kind = 'episode'"), e.where("kind = 'maintenance'")
    known = F.coalesce(F.col("kind").isin("episode", "maintenance"), F.lit(False))
    needed = {"episode": ("id", "run_id", "task_id", "task_group", "seed", "final_reward", "n_steps"), "maintenance": ("id", "run_id", "snapshot_id", "round", "prior_ids")}
    lacks = reduce(Column.__or__, ((F.col("kind") == k) & F.col(c).isNull() for k, cs in needed.items() for c in cs))
    train = m.select(F.explode("train_task_ids").alias("task_id"))
    tasks = d.sources.select(F.explode("task_ids").alias("task_id")).distinct()
    lineage = m.select(*(F.col(c).alias(f"m_{c}") for c in LINEAGE))
    differs = reduce(Column.__or__, (~F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in LINEAGE))
    snapshots = m.select(F.explode("snapshot_chain").alias("s")).unionByName(m.select(F.explode("maintenance_snapshot_ids").alias("s")))
    prior = rounds.select("id", F.explode("prior_ids").alias("prior"))
    first = rounds.groupBy("snapshot_id").agg(F.min("position").alias("position"))
    listed = m.where("maintenance_snapshot_ids is not null").select(F.posexplode("maintenance_snapshot_ids").alias("i", "snapshot_id"))
    rank = first.agg(F.array_sort(F.collect_list(F.struct("position", "snapshot_id"))).alias("c"))  # a row for each snapshot
    order = m.where("maintenance_snapshot_ids is not null").crossJoin(F.broadcast(rank))
    gone = audit.differing(d.rebuilt, e.select("id", "digest"))
    return [
        ("evidence_schema_invalid", EVIDENCE, _told(e, ~known, F.concat(F.lit("row "), F.col("position").cast("string")))),
        ("evidence_schema_invalid", EVIDENCE, _told(e, lacks, F.coalesce("id", F.concat(F.lit("row "), F.col("position").cast("string"))))),
        ("duplicate_episode_id", EVIDENCE, audit.duplicates(episodes, ["id"]).select(F.col("id").alias("message"))),
        ("duplicate_maintenance_id", EVIDENCE, audit.duplicates(rounds, ["id"]).select(F.col("id").alias("message"))),
        ("non_train_source", EVIDENCE, _without(episodes, train, {"task_id": "task_id"}, "task_id")),
        ("non_train_source", EVIDENCE, _without(episodes, tasks, {"task_id": "task_id"}, "task_id")),
        ("evidence_lineage_mismatch", EVIDENCE, _told(episodes.crossJoin(F.broadcast(lineage)), differs, F.col("id"))),
        ("evidence_lineage_mismatch", EVIDENCE, _without(tasks, episodes, {"task_id": "task_id"}, "task_id")),
        ("evidence_lineage_mismatch", EVIDENCE, _without(e.where(known), d.sources, {"run_id": "run_id"}, "id")),
        ("evidence_lineage_mismatch", EVIDENCE, _without(rounds, snapshots, {"snapshot_id": "s"}, "id")),
        ("evidence_lineage_mismatch", EVIDENCE, _without(prior, episodes, {"prior": "id"}, "id")),
        ("evidence_lineage_mismatch", EVIDENCE, _without(listed, first, {"snapshot_id": "snapshot_id"}, "snapshot_id")),
        ("evidence_lineage_mismatch", EVIDENCE, _told(order, F.col("maintenance_snapshot_ids") != F.transform("c", lambda x: x["snapshot_id"]), "order of maintenance snapshots")),
        ("source_evidence_mismatch", EVIDENCE, gone.select(F.concat_ws(" ", "side", "id").alias("message"))),
    ]


def recomputed_scores(d: Dataset) -> DataFrame:
    """What the candidates of the evidence give: memory_id, tier, value, attribution, confidence, status."""
    episodes = d.evidence.where("kind = 'episode'").dropDuplicates(["id"]).select(F.col("id").alias("episode_id"), "task_group", F.col("final_reward").alias("reward"), F.col("position").alias("episode_index"))
    rows = d.candidates.join(episodes, "episode_id")
    creators = d.known_memories.join(episodes.select(F.col("episode_id").alias("creator_episode_id"), F.col("episode_index").alias("creator_index")), "creator_episode_id").select("memory_id", "creator_index")
    groups = attribution.group_scores(attribution.after_creation(rows, creators))
    facts = d.candidates.select("memory_id", "tier").distinct()
    out = attribution.memory_scores(groups, facts, attribution.prior_of(F.col("tier")))
    return out.select("memory_id", "tier", *(F.round(c, 9).alias(c) for c in ("value", "attribution", "confidence")), "status")


def score_checks(d: Dataset) -> list[tuple[str, str, DataFrame]]:
    s = d.scores
    episodes = d.evidence.where("kind = 'episode'").groupBy(F.col("id").alias("episode_id")).agg(F.min("position").alias("position"))
    used = s.select("memory_id", "creator_episode_id", F.explode("source_episode_ids").alias("episode_id"))
    made = episodes.select(F.col("episode_id").alias("creator_episode_id"), F.col("position").alias("made"))
    early = used.join(made, "creator_episode_id").join(episodes, "episode_id").where("position <= made")
    invalid = _blank("memory_id") | F.col("tier").isNull() | ~F.coalesce(F.col("status").isin("scored", "insufficient_evidence"), F.lit(False)) | ((F.col("status") == "scored") & F.col("value").isNull())
    stored = s.select("memory_id", "tier", *(F.round(c, 9).alias(c) for c in ("value", "attribution", "confidence")), "status")
    return [
        ("attribution_schema_invalid", SCORES, _told(s, invalid, F.coalesce("memory_id", F.lit("null")))),
        ("duplicate_memory_score", SCORES, audit.duplicates(s, ["memory_id"]).select(F.col("memory_id").alias("message"))),
        ("attribution_provenance_invalid", SCORES, _without(used, episodes, {"episode_id": "episode_id"}, "memory_id")),
        ("attribution_provenance_invalid", SCORES, _told(s, F.size(F.array_except("group_episode_ids", "source_episode_ids")) > 0, F.col("memory_id"))),
        ("attribution_chronology_invalid", SCORES, early.select(F.col("memory_id").alias("message"))),
        ("attribution_chronology_invalid", SCORES, _without(s.where("creator_episode_id is not null"), episodes, {"creator_episode_id": "episode_id"}, "memory_id")),
        ("attribution_recompute_mismatch", SCORES, audit.differing(recomputed_scores(d), stored).select(F.concat_ws(" ", "side", "memory_id").alias("message"))),
    ]


def score_provenance(d: Dataset) -> DataFrame:
    """(memory_id, fault) of scores that refer to another build: unknown memories, sources, creators, or groups outside their sources."""
    episodes = d.evidence.where("kind = 'episode'").select("id")
    known = d.candidates.select("memory_id").unionByName(d.known_memories.select("memory_id"))
    fault = lambda rows, name: rows.select(F.col("message").alias("memory_id"), F.lit(name).alias("fault"))
    used = d.scores.select("memory_id", F.explode("source_episode_ids").alias("episode_id"))
    parts = [
        fault(_without(d.scores, known, {"memory_id": "memory_id"}, "memory_id"), "unknown_memory"),
        fault(_without(used, episodes, {"episode_id": "id"}, "memory_id"), "unknown_source"),
        fault(_without(d.scores.where("creator_episode_id is not null"), episodes, {"creator_episode_id": "id"}, "memory_id"), "unknown_creator"),
        fault(_told(d.scores, F.size(F.array_except("group_episode_ids", "source_episode_ids")) > 0, F.col("memory_id")), "group_outside_sources"),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def boundary_faults(examples: DataFrame) -> DataFrame:
    """(example_id, file, fault) of public parts that show what is privileged, by the kind of example."""
    leaks = payload_leaks(examples.select(F.struct("example_id", "file").alias("key"), "public_input"), "key", "public_input", public=True)
    act = payload_leaks(examples.where("kind = 'act'").select(F.struct("example_id", "file").alias("key"), "public_input"), "key", "public_input", act=True)
    keys = leaks.unionByName(act).select("key.example_id", "key.file", F.col("rule").alias("fault"))
    inside = F.size(F.array_except("privileged_ids", "public_ids")) == 0
    equal = inside & (F.size(F.array_except("public_ids", "privileged_ids")) == 0)
    shown = F.exists("memory_texts", lambda t: (t != "") & F.contains(F.col("public_input"), t))
    faults = F.array(
        F.when((F.col("kind") == "sel") & ~equal, F.lit("candidate_sets_differ")),
        F.when((F.col("kind") == "maint") & ~inside, F.lit("ids_outside_repository")),
        F.when((F.col("kind") == "write") & F.arrays_overlap("public_ids", "privileged_ids"), F.lit("creator_as_evidence")),
        F.when((F.col("kind") == "act") & shown, F.lit("memory_text_public")),
    )
    return keys.unionByName(examples.select("example_id", "file", F.explode(F.array_compact(faults)).alias("fault"))).distinct()


def example_checks(d: Dataset) -> list[tuple[str, str, DataFrame]]:
    x = d.examples.withColumn("wanted", F.regexp_extract("file", r"datasets/(\w+)\.jsonl", 1))
    contract = d.manifest.select(F.col("sampling_contract").alias("m_contract"))
    episodes = d.evidence.where("kind = 'episode'").dropDuplicates(["id"]).select(F.col("id").alias("episode_id"), *(F.col(c).alias(f"e_{c}") for c in ("seed", "task_id", "task_group", "final_reward", "n_steps")))
    rounds = d.evidence.where("kind = 'maintenance'").dropDuplicates(["id"]).select(F.col("id").alias("maintenance_id"), F.col("memory_generation").alias("r_generation"), F.col("round").alias("r_round"))
    unit = F.element_at(F.create_map(*(F.lit(v) for pair in UNITS.items() for v in pair)), F.col("kind"))
    right = x.where(F.col("sample_unit") == unit)
    tasks = right.where("kind <> 'maint'").join(episodes, "episode_id")
    moved = reduce(Column.__or__, (~F.col(c).eqNullSafe(F.col(f"e_{c}")) for c in ("seed", "task_id", "task_group")))
    maint = right.where("kind = 'maint'").join(rounds, "maintenance_id")
    other = ~F.col("memory_generation").eqNullSafe(F.col("r_generation")) | ~F.col("round").eqNullSafe(F.col("r_round"))
    logical = tasks.where(~moved).select("file", F.concat_ws(":", "kind", F.col("seed").cast("string"), "task_id").alias("message"))
    logical = logical.unionByName(maint.where(~other).select("file", F.concat_ws(":", "kind", F.col("memory_generation").cast("string"), F.col("round").cast("string")).alias("message")))
    level = (F.col("kind") == "act") & ((F.col("e_final_reward") != 1.0) | (F.col("e_n_steps") == 0) | ~F.col("trajectory_episode_id").eqNullSafe(F.col("episode_id")) | ~F.col("step_count").eqNullSafe(F.col("e_n_steps")))
    done = d.evidence.where("kind = 'episode' and final_reward = 1.0 and n_steps > 0").select(F.col("id").alias("episode_id"))
    refs = d.references.join(d.scores.dropDuplicates(["memory_id"]).select("memory_id", *(F.col(c).alias(f"s_{c}") for c in ("tier", "value", "attribution", "confidence", "status"))), "memory_id")
    score = reduce(Column.__or__, (F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in ("tier", "value", "attribution", "confidence", "status")))
    lost = audit.differing(d.expected, d.examples.select("kind", "example_id", "digest"))
    at = "datasets"
    return [
        ("example_schema_invalid", at, _told(x, _blank("example_id") | ~F.coalesce(F.col("kind").isin(*UNITS), F.lit(False)) | F.col("public_input").isNull(), F.coalesce("example_id", F.lit("null")))),
        ("duplicate_example_id", at, audit.duplicates(x, ["example_id"]).select(F.col("example_id").alias("message"))),
        ("example_kind_mismatch", at, _told(x, F.col("kind") != F.col("wanted"), F.col("example_id"))),
        ("missing_online_sampling_contract", at, _told(x.crossJoin(F.broadcast(contract)), ~F.col("sampling_contract").eqNullSafe(F.col("m_contract")), F.col("example_id"))),
        ("public_privileged_leak", at, boundary_faults(d.examples).select(F.concat_ws(" ", "example_id", "fault").alias("message"))),
        ("sample_unit_contract_invalid", at, _told(x, ~F.col("sample_unit").eqNullSafe(unit), F.col("example_id"))),
        ("example_provenance_invalid", at, _without(x.where("episode_id is not null"), episodes, {"episode_id": "episode_id"}, "example_id")),
        ("example_provenance_invalid", at, _without(x.where("maintenance_id is not null"), rounds, {"maintenance_id": "maintenance_id"}, "example_id")),
        ("example_provenance_invalid", at, _told(tasks, moved, F.col("example_id"))),
        ("example_provenance_invalid", at, _told(maint, other, F.col("example_id"))),
        ("example_provenance_invalid", at, _without(d.references.where("memory_id is not null"), d.scores, {"memory_id": "memory_id"}, "memory_id")),
        ("example_score_mismatch", at, _told(refs, score, F.col("memory_id"))),
        ("duplicate_logical_sample", at, audit.duplicates(logical, ["message"]).select("message")),
        ("act_sample_not_task_level", at, _told(tasks.where(~moved), level, F.col("example_id"))),
        ("task_level_sample_coverage", at, audit.set_coverage(x.where("file = 'datasets/act.jsonl' and episode_id is not null"), done, "episode_id").select(F.concat_ws(" ", "side", "episode_id").alias("message"))),
        ("example_recompute_mismatch", at, lost.select(F.concat_ws(" ", "side", "kind", "example_id").alias("message"))),
    ]


def expected_examples(d: Dataset, threshold: float = 0.01, cap: int = 20) -> DataFrame:
    """kind, example_id, digest of the sel and act examples that evidence and stored scores give."""
    episodes = d.evidence.where("kind = 'episode'").dropDuplicates(["id"]).select(F.col("id").alias("episode_id"), F.col("final_reward").alias("reward"), "n_steps")
    sel = views.selection_view(d.candidates, d.scores, threshold)
    sel = sel.select(F.lit("sel").alias("kind"), "episode_id", F.to_json(F.struct("public_ids", "privileged_values")).alias("body"))
    best = views.valuable_selected(d.candidates.where("selected"), d.scores, threshold, cap).groupBy("episode_id")
    best = best.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "memory_id"))), lambda v: v["memory_id"]).alias("memories"))
    act = episodes.where("reward = 1.0 and n_steps > 0").join(best, "episode_id", "left")
    act = act.select(F.lit("act").alias("kind"), "episode_id", F.to_json(F.struct("n_steps", "memories")).alias("body"))
    rows = sel.unionByName(act)
    return rows.select("kind", example_id(F.col("kind"), F.col("episode_id")).alias("example_id"), F.sha2("body", 256).alias("digest"))


def example_id(kind: Column, *identity: Column) -> Column:
    """opd_{kind}_ and 24 digits of the digest of the identity."""
    return F.concat(F.lit("opd_"), kind, F.lit("_"), F.substring(F.sha2(F.to_json(F.array(kind, *identity)), 256), 1, 24))


def errors(d: Dataset) -> DataFrame:
    """(code, artifact, message) of everything that is wrong; a dataset without rows here has passed."""
    return audit.errors(*manifest_checks(d), *artifact_checks(d), *evidence_checks(d), *score_checks(d), *example_checks(d))
