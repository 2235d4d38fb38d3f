"""What streams leave in their audit table, and that a slow or failing batch does not end them."""

import time

import pytest

from lodestrata.streaming.audit import Audit, audited, summary


def land(spark, tmp_path, *values):
    for v in values:
        spark.createDataFrame([(v,)], "v long").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/landing")


def run(spark, tmp_path, step, name="audited"):
    stream = spark.readStream.schema("v long").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/landing")
    return stream.writeStream.queryName(name).foreachBatch(step).option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()


def test_slow_and_failing_batches_leave_a_row_and_the_stream_goes_on(spark, tmp_path):
    land(spark, tmp_path, 1, 2, 3, 4)
    seen = []

    def step(batch, n):
        v = batch.first()["v"]
        if v == 2:
            time.sleep(20)
        if v == 3:
            raise ValueError("three is bad")
        seen.append(v)

    with Audit(spark, f"file://{tmp_path}/audit", every=3) as audit:
        query = run(spark, tmp_path, audited(step, audit, timeout_s=4, dead=f"file://{tmp_path}/dead"))
        began = time.monotonic()
        query.awaitTermination()
        assert time.monotonic() - began < 60
        time.sleep(1)  # the listener is told a little later
    rows = audit.table().collect()
    kinds = [r["kind"] for r in rows]
    assert sorted(seen) == [1, 4] and kinds.count("timeout") == 1 and kinds.count("error") == 1 and kinds.count("started") == kinds.count("ended") == 1
    assert sum(r["input_rows"] for r in rows if r["kind"] == "progress") == 6  # the two that are kept are read again
    assert "three is bad" in next(r["detail"] for r in rows if r["kind"] == "error")
    assert sorted(r["v"] for r in spark.read.parquet(f"file://{tmp_path}/dead").collect()) == [2, 3]
    one = {r["run"]: r for r in summary(audit.table()).collect()}[str(query.runId)]
    assert one["batches"] == 4 and one["input_rows"] == 6


def test_a_stream_that_dies_is_noted(spark, tmp_path):
    land(spark, tmp_path, 1)

    def step(batch, n):
        raise RuntimeError("dies")

    with Audit(spark, f"file://{tmp_path}/audit") as audit:
        with pytest.raises(Exception, match="dies"):
            run(spark, tmp_path, step, "dying").awaitTermination()
        time.sleep(1)
    assert "dies" in next(r["detail"] for r in audit.table().collect() if r["kind"] == "error")
