"""Writers: nothing replaces an old output unless the new one is whole and keeps the contract."""

from __future__ import annotations

import json
import os
import time
import urllib.parse
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SHANGHAI_PM, Profile
from ..operators.validate import assert_valid

STATUSES = ("unprocessed", "processing", "processed", "failed", "skipped")
MOVES = {"unprocessed": ("processing", "skipped"), "processing": ("processed", "failed"), "failed": ("processing", "skipped"), "processed": ("processing",), "skipped": ("processing",)}


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file whole; False if it is there already."""
    target, fs, jvm = _fs(spark, path)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(part, False)
    out.write(text.encode())
    out.close()
    try:
        if fs.getScheme() == "file":
            try:
                os.link(part.toUri().getPath(), target.toUri().getPath())
                return True
            except FileExistsError:
                return False
        return not fs.exists(target) and fs.rename(part, target)
    finally:
        fs.delete(part, False)


def recover(spark: SparkSession, path: str) -> None:
    """Bring back the old output that a crash between two renames left beside its place, or drop it if its successor is there."""
    target, fs, jvm = _fs(spark, path)
    old = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.old")
    if fs.exists(old):
        if fs.exists(target):
            fs.delete(old, True)
        else:
            fs.rename(old, target)


def replace_output(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write beside the target, then swap by two renames. A failed write changes nothing.

    Readers see the old output or the new one, but for the moment between the renames. After a crash in that moment
    the old output stands beside its place; the next write, or ``recover``, brings it back.
    """
    spark, stage = df.sparkSession, f"{path.rstrip('/')}.new-{uuid.uuid4().hex[:8]}"
    recover(spark, path)
    target, fs, jvm = _fs(spark, path)
    staged, old = jvm.org.apache.hadoop.fs.Path(stage), jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.old")
    try:
        df.write.format(fmt).save(stage)
    except Exception:
        fs.delete(staged, True)
        raise
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"cannot move {path}")
    if not fs.rename(staged, target):
        recover(spark, path)
        raise OSError(f"cannot replace {path}")
    fs.delete(old, True)


def write_valid(records: DataFrame, path: str, profile: Profile = SHANGHAI_PM, fmt: str = "parquet") -> None:
    """Validate, then replace. The records are computed once, into the staging folder, and validated as written."""
    spark, stage = records.sparkSession, f"{path.rstrip('/')}.check-{uuid.uuid4().hex[:8]}"
    staged, fs, _ = _fs(spark, stage)
    try:
        records.write.parquet(stage)
        written = spark.read.schema(records.schema).parquet(stage)
        assert_valid(written, profile)
        replace_output(written, path, fmt)
    finally:
        fs.delete(staged, True)


def _status_files(spark: SparkSession, path: str, run_id: str) -> tuple[str, int]:
    """A run's folder in the status log, and how many moves it has made."""
    folder = f"{path.rstrip('/')}/{urllib.parse.quote(run_id, safe='')}"
    pattern, fs, _ = _fs(spark, f"{folder}/*.json")
    return folder, max([0, *(int(x.getPath().getName().removesuffix(".json")) for x in fs.globStatus(pattern) or [])])


def log_status(spark: SparkSession, path: str, run_id: str, status: str, detail: str = "") -> None:
    """Move a run to a new status; only the moves of the state machine are allowed.

    A run's n-th move is a file of that number, which one writer alone can create: of two that move the run at once the
    other gets an error and the run is where the first put it.
    """
    folder, n = _status_files(spark, path, run_id)
    now = current_status(spark, path, run_id)
    if status not in MOVES[now]:
        raise ValueError(f"{run_id}: no move from {now} to {status}")
    entry = {"run_id": run_id, "n": n + 1, "status": status, "detail": detail, "at": time.time_ns()}
    if not create_once(spark, f"{folder}/{n + 1:09d}.json", json.dumps(entry, ensure_ascii=False)):
        raise ValueError(f"{run_id}: moved by another writer at the same time")


def statuses(spark: SparkSession, path: str) -> DataFrame:
    """The latest status of every run."""
    schema = "run_id string, n long, status string, detail string, at long"
    pattern, fs, _ = _fs(spark, f"{path.rstrip('/')}/*/*.json")
    log = spark.read.schema(schema).json(f"{path.rstrip('/')}/*/*.json") if fs.globStatus(pattern) else spark.createDataFrame([], schema)
    return log.groupBy("run_id").agg(F.max_by("status", "n").alias("status"), F.max_by("detail", "n").alias("detail"))


def current_status(spark: SparkSession, path: str, run_id: str) -> str:
    row = statuses(spark, path).where(F.col("run_id") == run_id).first()
    return row["status"] if row else STATUSES[0]
