"""The dataset audit: a sound dataset breaks no rule, and every code has a row that triggers it."""

import hashlib
import json

import pytest

from ledgerloom.operators import dataset as ds

# The codes of the audit.
CODES = """manifest_invalid sample_unit_contract_invalid non_train_source duplicate_source_identity source_lineage_invalid source_evidence_mismatch
artifact_missing artifact_hash_mismatch artifact_jsonl_invalid artifact_noncanonical artifact_forbidden_content artifact_line_count_mismatch
evidence_schema_invalid evidence_lineage_mismatch duplicate_episode_id duplicate_maintenance_id attribution_schema_invalid
attribution_provenance_invalid attribution_chronology_invalid attribution_recompute_mismatch duplicate_memory_score manifest_count_mismatch
example_schema_invalid example_kind_mismatch example_provenance_invalid example_score_mismatch example_recompute_mismatch duplicate_example_id
duplicate_logical_sample missing_online_sampling_contract public_privileged_leak act_sample_not_task_level task_level_sample_coverage""".split()

LINEAGE = dict(memory_generation=3, model_revision="m1", adapter_revision=None, runtime_revision="r1", split_sha256="abc")
TASKS = ["t1", "t2", "t3", "t4"]
CONTRACT = "online"


def sound():
    """Rows of every table but those that are computed: four episodes in two runs, one maintenance round, two memories."""
    rewards = {"e1": 1.0, "e2": 0.0, "e3": 1.0, "e4": 0.0}
    evidence = [dict(position=i, kind="episode", id=f"e{i}", run_id="run1" if i < 3 else "run2", task_id=f"t{i}", task_group="shop", seed=42, final_reward=rewards[f"e{i}"], n_steps=2, digest=f"d{i}", **LINEAGE) for i in (1, 2, 3, 4)]
    evidence.append(dict(position=5, kind="maintenance", id="m1", run_id="run2", snapshot_id="s2", round=1, prior_ids=["e1", "e2"], digest="d5", **LINEAGE))
    candidates = [dict(episode_id=f"e{i}", memory_id="mem_a", tier="skill", rank=1, selected=i in (1, 3)) for i in (1, 2, 3, 4)] + [dict(episode_id="e4", memory_id="mem_b", tier="tip", rank=2, selected=True)]
    value = 1.0 * (1 - 1 / 3**0.5) * 0.5
    scores = [
        dict(memory_id="mem_a", tier="skill", source_episode_ids=["e1", "e2", "e3", "e4"], group_episode_ids=["e1"], value=value, attribution=0.5, confidence=1 - 1 / 3**0.5, status="scored"),
        dict(memory_id="mem_b", tier="tip", creator_episode_id="e2", source_episode_ids=["e4"], group_episode_ids=[], value=None, attribution=None, confidence=1 - 1 / 2**0.5, status="insufficient_evidence"),
    ]
    common = dict(sampling_contract=CONTRACT, public_input='{"observation":"o"}', memory_texts=["secret words"])
    task = lambda i: dict(episode_id=f"e{i}", seed=42, task_id=f"t{i}", task_group="shop", sample_unit="task")
    examples = [dict(file="datasets/sel.jsonl", kind="sel", identity=f"e{i}", public_ids=["mem_a"], privileged_ids=["mem_a"], **task(i), **common) for i in (1, 2, 3, 4)]
    examples[3] |= dict(public_ids=["mem_a", "mem_b"], privileged_ids=["mem_b", "mem_a"])
    examples += [dict(file="datasets/act.jsonl", kind="act", identity=f"e{i}", trajectory_episode_id=f"e{i}", step_count=2, **task(i), **common) for i in (1, 3)]
    examples.append(dict(file="datasets/maint.jsonl", kind="maint", identity="m1", example_id="opd_maint_1", digest="x", sample_unit="maintenance_round", maintenance_id="m1", memory_generation=3, round=1, public_ids=["mem_a", "mem_b"], privileged_ids=["mem_a"], **common))
    lines = [dict(path=p, number=1, line='{"a":1,"b":"é"}') for p in ds.ARTIFACTS]
    files = [dict(path=p, sha256=f"h-{p}", rows=1) for p in ds.ARTIFACTS]
    return dict(
        manifest=[dict(build_id="b", schema_version=2, unit_contract=ds.unit_contract(), sampling_contract=CONTRACT, audit_passed=True, train_task_ids=TASKS, train_task_ids_sha256=hashlib.sha256(json.dumps(TASKS, separators=(",", ":")).encode()).hexdigest(),
                       snapshot_chain=["s0", "s1", "s2"], maintenance_snapshot_ids=["s2"], counts=dict(evidence_episodes=4, evidence_maintenance=1, memory_scores=2, sel=4, act=2, write=0, maint=1), **LINEAGE)],
        sources=[dict(ordinal=1, run_id="run1", task_ids=["t1", "t2"], tasks_before=0, tasks_after=2, snapshot_before="s0", snapshot_after="s1"), dict(ordinal=2, run_id="run2", task_ids=["t3", "t4"], tasks_before=2, tasks_after=4, snapshot_before="s1", snapshot_after="s2")],
        artifacts=[dict(path=p, sha256=f"h-{p}", line_count=1) for p in ds.ARTIFACTS],
        files=files, lines=lines, evidence=evidence, rebuilt=[dict(id=e["id"], digest=e["digest"]) for e in evidence], candidates=candidates, known_memories=[dict(memory_id="mem_b", creator_episode_id="e2")],
        scores=scores, examples=examples, references=[dict(file="datasets/sel.jsonl", memory_id="mem_a", tier="skill", value=value, status="scored")], expected=[],
    )


def as_dataset(spark, tables):
    """Digests and ids of the sel and act examples follow from the evidence, as a builder would write them."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    def frame(name):
        schema = T.DataType.fromDDL(ds.TABLES[name])
        if name == "examples":
            schema = T.StructType([*schema, T.StructField("identity", T.StringType())])
        return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in tables[name]], schema)

    d = ds.Dataset(**{name: frame(name) for name in ds.TABLES})
    expected = ds.expected_examples(d)
    made = expected.select(F.col("example_id").alias("made_id"), F.col("digest").alias("made_digest"))
    x = d.examples.withColumn("made_id", ds.example_id(F.col("kind"), F.col("identity"))).join(made, "made_id", "left")
    x = x.withColumn("example_id", F.coalesce("example_id", "made_id")).withColumn("digest", F.coalesce("digest", "made_digest"))
    columns = T.DataType.fromDDL(ds.TABLES["examples"]).names
    maint = d.examples.where("kind = 'maint' and example_id = 'opd_maint_1'").select("kind", "example_id", "digest").limit(1)
    return d.but(examples=x.select(columns), expected=expected.unionByName(maint))


def test_a_sound_dataset_passes(spark):
    d = as_dataset(spark, sound())
    assert ds.errors(d).collect() == []
    assert ds.score_provenance(d).collect() == [] and ds.boundary_faults(d.examples).collect() == []


def broken():
    t = sound()
    t["manifest"][0] |= dict(build_id=" ", schema_version=1, unit_contract="sel=turn", audit_passed=None, train_task_ids=["t1", "t2", "t3"], snapshot_chain=["s0", "s2"], maintenance_snapshot_ids=["s2", "s2"])
    t["manifest"][0]["counts"] = t["manifest"][0]["counts"] | {"act": 7}
    t["sources"][0]["task_ids"] = ["t1", "t2", "t2"]
    t["sources"][1]["tasks_before"] = 3
    t["artifacts"][1]["sha256"] = "other"
    t["artifacts"][2]["line_count"] = 9
    t["files"] = t["files"][:-1]
    t["lines"][0]["line"], t["lines"][1]["line"], t["lines"][2]["line"] = "[1]", '{"b": 1, "a": 2}', '{"api_token":"x"}'
    t["rebuilt"][0]["digest"] = "dx"
    episode, maint = t["evidence"][0], t["evidence"][4]
    t["evidence"] += [dict(episode), dict(maint), dict(position=8, kind="note", digest="n"), dict(position=9, kind="episode", id="e9", digest="d9", **LINEAGE)]
    t["evidence"][1]["model_revision"] = "m2"
    maint["prior_ids"] = ["e1", "e77"]
    a, b = t["scores"]
    t["scores"] += [dict(b), dict(memory_id="mem_c", status="scored")]
    a["group_episode_ids"] = ["e1", "e50"]
    b["source_episode_ids"] = ["e1", "e4"]
    a["attribution"] = 0.25
    x = t["examples"]
    x += [dict(x[0]), dict(file="datasets/act.jsonl", kind=None, identity="?", example_id=""), dict(x[1], file="datasets/write.jsonl", example_id="opd_sel_moved", digest="q", identity="z")]
    x[1]["sampling_contract"] = "offline"
    x[2]["public_input"] = '{"attribution_score":1}'
    x[4]["step_count"] = 5
    x[5] |= dict(seed=7)
    del t["examples"][5]
    x[-1]["task_group"] = "moved"
    t["references"] += [dict(file="datasets/sel.jsonl", memory_id="mem_a", tier="tip"), dict(file="datasets/sel.jsonl", memory_id="mem_zz")]
    return t


def test_every_code_has_a_trigger(spark):
    found = {}
    for r in ds.errors(as_dataset(spark, broken())).collect():
        found.setdefault(r.code, set()).add(r.message)
    assert set(found) == set(CODES) and len(CODES) == 33
    assert found["duplicate_episode_id"] == {"e1"} and found["duplicate_maintenance_id"] == {"m1"}
    assert found["artifact_missing"] == {"datasets/maint.jsonl"} and found["artifact_jsonl_invalid"] == {f"{ds.EVIDENCE}:1"}
    assert found["artifact_noncanonical"] == {f"{ds.SCORES}:1"} and found["artifact_forbidden_content"] == {"datasets/sel.jsonl:1 $.api_token credential_key"}
    assert {"t4", "digest of train task ids"} <= found["non_train_source"] and found["duplicate_source_identity"] == {"run1:t2"}
    assert found["attribution_chronology_invalid"] == {"mem_b"} and "mem_a" in found["attribution_provenance_invalid"]
    assert found["act_sample_not_task_level"] and found["task_level_sample_coverage"] == {"missing e3"}
    assert found["manifest_count_mismatch"] >= {"act"} and found["example_score_mismatch"] == {"mem_a"}


@pytest.mark.parametrize(
    "change,fault",
    [
        (dict(memory_id="mem_q"), ("mem_q", "unknown_memory")),
        (dict(source_episode_ids=["e1", "e2", "e3", "e4", "x"]), ("mem_a", "unknown_source")),
        (dict(creator_episode_id="x"), ("mem_a", "unknown_creator")),
        (dict(group_episode_ids=["x"]), ("mem_a", "group_outside_sources")),
    ],
)
def test_score_provenance(spark, change, fault):
    t = sound()
    t["scores"][0] |= change
    assert [tuple(r) for r in ds.score_provenance(as_dataset(spark, t)).collect()] == [fault]


def test_boundaries_by_kind(spark):
    t = sound()
    x = t["examples"]
    x[0]["privileged_ids"] = ["mem_b"]
    x[4]["public_input"] = '{"o":"here are secret words","memory_context":1}'
    x[6]["privileged_ids"] = ["mem_z"]
    x.append(dict(x[1], file="datasets/write.jsonl", kind="write", identity="w", example_id="w", digest="w", public_ids=["e1"], privileged_ids=["e1"]))
    got = {(r.file[9:-6], r.fault) for r in ds.boundary_faults(as_dataset(spark, t).examples).collect()}
    assert got == {("sel", "candidate_sets_differ"), ("act", "memory_text_public"), ("act", "memory_key"), ("maint", "ids_outside_repository"), ("write", "creator_as_evidence")}
