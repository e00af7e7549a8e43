import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import jsonl, scratch, splits, stores

ROWS = [("tip", "be brief"), ("tip", "be kind"), ("skill", "do it"), ("tool", "pay")]


def items(spark):
    from ledgerloom.functions.kernels import stable_id

    df = spark.createDataFrame(ROWS, "tier string, content string")
    return df.select(stable_id(F.col("tier"), F.col("content")).alias("id"), "tier", "content", F.lit("active").alias("status"), F.lit(1).alias("version"), F.lit(0).alias("created_round"), F.lit(0).alias("updated_round"), F.array(F.lit("t")).alias("source_task_ids"))


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    stores.write_store(items(spark), path)
    assert sorted((r.tier, r.content) for r in stores.read_store(spark, path).collect()) == sorted(ROWS)
    assert stores.read_tier(spark, path, "trajectory").first()["count"] == 0 and stores.store_faults(spark, path).count() == 0
    bad = str(tmp_path / "bad")
    stores.write_store(items(spark).withColumn("content", F.when(F.col("tier") == "tool", "changed").otherwise(F.col("content"))), bad)
    assert [r.fault[:3] for r in stores.store_faults(spark, bad).collect()] == ["id:"]


def test_snapshot(spark, tmp_path):
    root = str(tmp_path / "snapshots")
    name = stores.publish_snapshot(items(spark), root)
    assert stores.publish_snapshot(items(spark).repartition(3), root) == name
    assert stores.read_snapshot(spark, root, name).count() == 4
    assert stores.snapshot_id(items(spark).withColumn("version", F.lit(2))) != name
    items(spark).limit(1).drop("tier").write.mode("append").parquet(f"{root}/snapshot_id={name}/tier=tip")
    with pytest.raises(ValueError):
        stores.read_snapshot(spark, root, name)
    with pytest.raises(ValueError):
        stores.read_snapshot(spark, root, "../x")


def test_jsonl(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1}\n\n[1]\nnope\n{"a": 2}\n')
    assert [(r.line, r.fault) for r in jsonl.faults(spark, str(path)).orderBy("line").collect()] == [(3, "not_an_object"), (4, "not_json")]
    good = tmp_path / "good.jsonl"
    good.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r.a for r in jsonl.read(spark, str(good), "a int").orderBy("a").collect()] == [1, 2]
    with pytest.raises(Exception):
        jsonl.read(spark, str(path), "a int").collect()
    rows = spark.createDataFrame([(2, "é", None), (1, "b", 0.5)], "k int, t string, v double")
    jsonl.write_canonical(rows, str(tmp_path / "out"), ["k"])
    text = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(text) == ['{"k":1,"t":"b","v":0.5}', '{"k":2,"t":"é","v":null}']
    names = jsonl.unknown_fields(spark.createDataFrame([('{"a": 1, "b": 2}',)], "p string"), "p", ["a"])
    assert [r.field for r in names.collect()] == ["b"]


def test_publish_only_without_faults(spark, tmp_path):
    rows = spark.range(3)
    assert not stores.publish_checked(rows, spark.range(1), str(tmp_path / "no")) and not scratch.exists(spark, str(tmp_path / "no"))
    assert stores.publish_checked(rows, spark.range(0), str(tmp_path / "yes"))
    with pytest.raises(FileExistsError):
        stores.publish_checked(rows, spark.range(0), str(tmp_path / "yes"))


def test_split_and_config(spark):
    import hashlib

    rows = spark.createDataFrame([("train", i, str(i)) for i in range(3)], "split string, pos int, task_id string")
    assert splits.split_digest(rows).first().digest == hashlib.sha256(b'["0","1","2"]').hexdigest()
    config = {"memory": {"top_k": 50}}
    assert splits.with_overrides(config, {"memory.top_k": 5})["memory"]["top_k"] == 5 and config["memory"]["top_k"] == 50
    with pytest.raises(KeyError):
        splits.with_overrides(config, {"memory.other": 1})
