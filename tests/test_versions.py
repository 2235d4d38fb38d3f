"""All or nothing over several outputs, two writers, and counts taken while writing."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import metrics, normalize, score
from lodestrata.operators.validate import observed, violations
from lodestrata.sources.versions import Conflict, Versions, write_collection


def data_files(tmp_path):
    return sorted(p.name for p in Path(tmp_path).rglob("*.parquet"))


def test_three_outputs_change_together(spark, tmp_path):
    root = f"file://{tmp_path}/set"
    jobs = spark.createDataFrame([(1, ["a", None], {"x": "y"}, None), (2, [], {}, 1.5)], "id long, tags array<string>, more map<string,string>, score double")
    assert write_collection(jobs, jobs.where("id = 1"), "# one", root) == 1
    store = Versions(spark, root)
    assert sorted(map(str, store.read("run").collect())) == sorted(map(str, jobs.collect())) and store.read("history").count() == 1
    assert write_collection(jobs.limit(0), jobs, "# two", root) == 2
    assert store.read("run").count() == 0 and store.read("run").schema == jobs.schema and store.read("report").first()[0] == "# two"
    assert store.read("run", 1).count() == 2 and store.record()["outputs"]["history"]["rows"] == 2  # a pinned reader sees what it saw
    store.vacuum(keep=1)
    assert store.numbers() == [2] and store.read("history").count() == 2
    with pytest.raises(KeyError):
        store.read("absent")


def test_a_failed_task_leaves_the_old_set(spark, tmp_path):
    root = f"file://{tmp_path}/set"
    write_collection(spark.range(3), spark.range(5), "old", root)
    before = data_files(tmp_path)
    bad = spark.range(0, 1000, 1, 8).select(F.when(F.col("id") == 999, F.raise_error(F.lit("task fails")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="task fails"):
        write_collection(bad, spark.range(9), "new", root)
    with pytest.raises(Exception, match="task fails"):  # the first output is staged, the second fails
        write_collection(spark.range(9), bad, "new", root)
    store = Versions(spark, root)
    assert store.numbers() == [1] and store.read("run").count() == 3 and store.read("report").first()[0] == "old" and data_files(tmp_path) == before


def test_a_crash_before_publishing_changes_nothing(spark, tmp_path):
    store = Versions(spark, f"file://{tmp_path}/set")
    with store.begin() as t:
        t.stage("a", spark.range(2))
    assert store.record() is None and data_files(tmp_path) == []


def test_of_two_writers_one_wins_and_the_other_builds_anew(spark, tmp_path):
    store = Versions(spark, f"file://{tmp_path}/set")
    with store.begin() as t:
        t.stage("n", spark.range(1))
        t.stage("kept", spark.range(7))
        t.publish()
    tries = []

    def build(t):
        tries.append(t.parent["version"])
        t.stage("n", t.read("n").union(spark.range(100, 101)))
        if len(tries) == 1:  # another writer is faster
            with store.begin() as other:
                other.stage("n", other.read("n").union(spark.range(200, 201)))
                other.publish()

    assert store.update(build) == 3 and tries == [1, 2]
    assert sorted(r["id"] for r in store.read("n").collect()) == [0, 100, 200] and store.read("kept").count() == 7
    with store.begin() as late:
        late.stage("n", spark.range(1))
        store.update(lambda t: t.stage("n", spark.range(2)))
        with pytest.raises(Conflict):
            late.publish()
    assert store.read("n").count() == 2 and not [f for f in os.listdir(tmp_path / "set" / "versions") if not f.endswith(".json") and not f.endswith(".crc")]


def test_counts_are_taken_while_writing(spark, tmp_path):
    raw = spark.createDataFrame([(f"https://www.zhipin.com/job_detail/{c}.html", t, "上海") for c, t in (("a", "用户产品经理"), ("b", "用户产品经理"), ("b", "运营"))], "job_url string, job_title string, city string")
    records = score.score(normalize.to_contract(raw)[0])
    records = records.union(records).withColumn("city", F.when(F.col("id") == "a", F.lit("北京")).otherwise(F.col("city")))
    df, counted = observed(records)
    with Versions(spark, f"file://{tmp_path}/set").begin() as t:
        t.stage("run", df)
        t.facts = {"job_count": counted()["job_count"]}
        t.publish()
    got, want = counted(), metrics.metadata_counts(records).first()
    assert got["rules"] == {r["rule"]: r["n"] for r in metrics.counted(violations(records), "rule").collect()} and got["rules"]["city: out of scope"] > 0
    assert all(got[k] == want[k] for k in ("job_count", "review_count", "captured_count", "not_recommended_count")) and sum(got["captures"].values()) == got["job_count"]
    assert Versions(spark, f"file://{tmp_path}/set").record()["facts"]["job_count"] == records.count()
