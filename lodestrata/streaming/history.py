"""History as a stream: files of new records come in, each micro-batch merges into a snapshot that only ever grows.

History lies in buckets by key. A micro-batch rewrites the buckets that its keys fall into, in a folder of its own
number, and leaves the others where they are; a snapshot is the newest version of every bucket. A batch that runs
again after a failure reads the versions before it and writes its own anew: replays change nothing. Versions that no
replay can read any more are deleted, so disk does not grow with the number of batches.
"""

from __future__ import annotations

import json
import traceback
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import merge_history
from ..schema import INDEXED, fields
from ..sources.sinks import create_once

#: Buckets of a history that is made without saying how many.
BUCKETS = 64


def _bucket(buckets: int) -> Column:
    """The bucket of a record's key."""
    return F.pmod(F.xxhash64(F.coalesce(F.nullif(F.col("job_id"), F.lit("")), F.col("job_url"))), F.lit(buckets)).cast("int")


def buckets_of(spark: SparkSession, root: str, wanted: int = BUCKETS) -> int:
    """The history's number of buckets, which is settled when it is made."""
    create_once(spark, f"{root}/_buckets.json", json.dumps({"buckets": wanted}))
    path, fs = _folder(spark, f"{root}/_buckets.json")
    source = fs.open(path)
    try:
        return json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode())["buckets"]
    finally:
        source.close()


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, root: str) -> dict[int, list[int]]:
    """Of each bucket the batches that wrote it whole, in order."""
    p, fs = _folder(spark, f"{root}/batch=*/_SUCCESS")
    done = {x.getPath().getParent().getName() for x in fs.globStatus(p) or []}
    p, fs = _folder(spark, f"{root}/batch=*/bucket=*")
    out: dict[int, list[int]] = {}
    for x in fs.globStatus(p) or []:
        if x.getPath().getParent().getName() in done:
            batch, bucket = (int(y.getName().partition("=")[2]) for y in (x.getPath().getParent(), x.getPath()))
            out.setdefault(bucket, []).append(batch)
    return {bucket: sorted(batches) for bucket, batches in out.items()}


def snapshot(spark: SparkSession, root: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The newest snapshot (before a batch, of some buckets); empty if there is none."""
    paths = []
    for bucket, batches in _versions(spark, root).items():
        known = [n for n in batches if before is None or n < before]
        if known and (buckets is None or bucket in buckets):
            paths.append(f"{root}/batch={known[-1]}/bucket={bucket}")
    schema = fields(INDEXED)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _forget(spark: SparkSession, root: str, n: int) -> None:
    """Delete what neither a reader nor a replay of batch ``n`` or a later one reads."""
    for bucket, batches in _versions(spark, root).items():
        older = [x for x in batches if x < n]
        for batch in older[:-1]:
            p, fs = _folder(spark, f"{root}/batch={batch}/bucket={bucket}")
            fs.delete(p, True)


def upsert(root: str, merge: Callable[[DataFrame, DataFrame], DataFrame] = merge_history, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A micro-batch's step. A new history gets so many buckets: some rows of a batch for each, and a task's worth of records in each."""

    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        bucket = _bucket(buckets_of(spark, root, buckets))
        touched = [r[0] for r in batch.select(bucket.alias("bucket")).where("bucket IS NOT NULL").distinct().collect()]  # as many as there are buckets
        merged = merge(snapshot(spark, root, n, touched), batch)
        merged.withColumn("bucket", F.coalesce(bucket, F.lit(0))).write.partitionBy("bucket").mode("overwrite").parquet(f"{root}/batch={n}")
        _forget(spark, root, n)

    return run


def rebucket(spark: SparkSession, root: str, to: str, buckets: int, n: int = 0) -> None:
    """The newest snapshot as batch ``n`` of a new history with another number of buckets."""
    if buckets_of(spark, to, buckets) != buckets:
        raise ValueError(f"{to} has another number of buckets")
    snapshot(spark, root).withColumn("bucket", F.coalesce(_bucket(buckets), F.lit(0))).write.partitionBy("bucket").mode("overwrite").parquet(f"{to}/batch={n}")


def isolated(step: Callable[[DataFrame, int], None], log: Callable[[int, str], None], dead: str | None = None) -> Callable[[DataFrame, int], None]:
    """A failed micro-batch is kept in the folder ``dead``, logged, and the stream goes on with the next."""

    def run(batch: DataFrame, n: int) -> None:
        try:
            step(batch, n)
        except Exception:
            why = traceback.format_exc()
            if dead:
                batch.write.mode("overwrite").parquet(f"{dead}/batch={n}")
            log(n, why)

    return run


def history_stream(spark: SparkSession, landing: str, root: str, checkpoint: str, files_per_batch: int = 1, step=None) -> StreamingQuery:
    """Merge all files that have landed, a few at a time, then stop. Call it again for files that land later.

    Rows of one batch merge in the order of ``ord``, where files have it.
    """
    stream = spark.readStream.schema(fields(f"{INDEXED}, ord long")).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    return stream.writeStream.foreachBatch(step or upsert(root)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_until(batch: Callable[[], None], size: Callable[[], int], target: int, wait: Callable[[], None], limit: int = 1_000, pause_at: int = 3) -> tuple[int, str]:
    """Run batches until history has ``target`` rows, or three in a row bring nothing; errors are kept, not raised."""
    idle, before, note = 0, size(), ""
    for n in range(limit):
        if before >= target:
            return n, "target"
        try:
            batch()
        except Exception as e:
            note = repr(e)
        now = size()
        idle = 0 if now > before else idle + 1
        before = now
        if idle >= pause_at:
            return n + 1, note or "no growth"
        wait()
    return limit, "limit"


def with_timeout(batch: Callable[[], None], seconds: float, log: Callable[[str], None]) -> Callable[[], None]:
    """A batch that is given up after so long; its error is logged and raised, and the caller's loop goes on.

    Its Spark jobs run in a group of their own, which is cancelled.
    """

    def run() -> None:
        spark = SparkSession.getActiveSession()
        tag = f"batch-{uuid.uuid4().hex[:8]}"

        def work() -> None:
            if spark:
                spark.addTag(tag)
            batch()

        pool = ThreadPoolExecutor(1)
        try:
            pool.submit(work).result(timeout=seconds)
        except Exception as e:
            if spark:
                spark.interruptTag(tag)
            log(f"{type(e).__name__}: {e}")
            raise
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return run


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events (ts, event_type) by window and type; late ones count up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
