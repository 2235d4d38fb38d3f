"""Datasets as a log of versions: several outputs change together or not at all, and two writers never both win.

A transaction stages each output by a Spark data source: every task writes a file of its own, the driver's ``commit``
lists the files, its ``abort`` removes them. Staged files are in no version. ``publish`` creates the record of the next
version, a small file that names all outputs' files, and creating it is the only step that readers can see: it either
succeeds whole, or another writer was there first and it fails with ``Conflict``. ``update`` then stages anew on top of
that writer's version. A reader pins a version, so what it reads stays as it was while others write.

The record's creation must be atomic: a hard link on a local file system, a rename that refuses an existing target
elsewhere (HDFS). Files are written through pyarrow's file systems, as tasks have no JVM.

Edge cases: an empty output has no file and keeps its schema; outputs that a transaction does not stage are those of its
parent; staging an output twice replaces it; reading an output that no version has is an error.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .sinks import _fs, create_once


class Conflict(RuntimeError):
    """Another writer has made the version that this one was to be."""


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@dataclass
class _Written(WriterCommitMessage):
    file: str | None
    rows: int


class _StagedWriter(DataSourceArrowWriter):
    """A Parquet file for each task that has rows; the list of them when all tasks are done."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        import pyarrow.parquet as pq

        files, folder = _files(self.path)
        writer, rows, name = None, 0, f"part-{uuid.uuid4().hex}.parquet"
        for batch in iterator:
            if batch.num_rows:
                if writer is None:
                    files.create_dir(folder, recursive=True)
                    writer = pq.ParquetWriter(f"{folder}/{name}", batch.schema, filesystem=files)
                writer.write_batch(batch)
                rows += batch.num_rows
        if writer is not None:
            writer.close()
        return _Written(name if rows else None, rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, folder = _files(self.path)
        files.create_dir(folder, recursive=True)
        done = [m for m in messages if m is not None and m.file]
        with files.open_output_stream(f"{folder}/_files.json") as f:
            f.write(json.dumps({"files": sorted(m.file for m in done), "rows": sum(m.rows for m in done)}).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        _remove(self.path)


def _remove(path: str) -> None:
    from pyarrow import fs

    files, folder = _files(path)
    if files.get_file_info(folder).type == fs.FileType.Directory:
        files.delete_dir(folder)


class StagedFiles(DataSource):
    """``df.write.format("staged_files").mode("append").option("path", folder).save()``."""

    @classmethod
    def name(cls) -> str:
        return "staged_files"

    def writer(self, schema, overwrite) -> DataSourceArrowWriter:
        return _StagedWriter(self.options["path"])


class Versions:
    """The version log under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def numbers(self) -> list[int]:
        pattern, fs, _ = _fs(self.spark, f"{self.root}/versions/*.json")
        return sorted(int(x.getPath().getName().removesuffix(".json")) for x in fs.globStatus(pattern) or [])

    def record(self, version: int | None = None) -> dict | None:
        """A version's record, the newest one's by default; None where there is no version."""
        if version is None:
            known = self.numbers()
            if not known:
                return None
            version = known[-1]
        path, fs, jvm = _fs(self.spark, f"{self.root}/versions/{version:012d}.json")
        with_close = fs.open(path)
        try:
            return json.loads(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(with_close)).decode())
        finally:
            with_close.close()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        record = self.record(version)
        if record is None or name not in record["outputs"]:
            raise KeyError(f"no version has {name}")
        output = record["outputs"][name]
        schema = T.StructType.fromJson(output["schema"])
        return self.spark.read.schema(schema).parquet(*output["files"]) if output["files"] else self.spark.createDataFrame([], schema)

    def begin(self) -> Transaction:
        return Transaction(self)

    def update(self, build: Callable[[Transaction], None], attempts: int = 5) -> int:
        """``build`` stages the next version from ``transaction.parent``; after a conflict again from the newer parent."""
        for attempt in range(1, attempts + 1):
            with self.begin() as transaction:
                build(transaction)
                try:
                    return transaction.publish()
                except Conflict:
                    if attempt == attempts:
                        raise
        raise Conflict("no attempt was allowed")

    def vacuum(self, keep: int = 2) -> None:
        """Delete all versions but the newest, and the files that only they had. Not while a transaction is open."""
        known = self.numbers()
        kept = {f for v in known[-keep:] for o in self.record(v)["outputs"].values() for f in o["files"]}
        for v in known[:-keep]:
            for output in self.record(v)["outputs"].values():
                for file in set(output["files"]) - kept:
                    path, fs, _ = _fs(self.spark, file)
                    fs.delete(path, False)
            path, fs, _ = _fs(self.spark, f"{self.root}/versions/{v:012d}.json")
            fs.delete(path, False)


class Transaction:
    """Outputs staged on top of the version that was the newest when it began."""

    def __init__(self, store: Versions):
        self.store, self.parent = store, store.record()
        self.folder = f"{store.root}/data/{uuid.uuid4().hex}"
        self.outputs: dict[str, dict] = {}
        self.facts: dict = {}
        self.published = False

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, *_: object) -> None:
        if not self.published:
            _remove(self.folder)

    def read(self, name: str) -> DataFrame:
        """The parent's output."""
        if self.parent is None:
            raise KeyError(f"no version has {name}")
        return self.store.read(name, self.parent["version"])

    def stage(self, name: str, df: DataFrame) -> None:
        folder = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        df.sparkSession.dataSource.register(StagedFiles)
        df.write.format("staged_files").mode("append").option("path", folder).save()
        files, path = _files(folder)
        with files.open_input_stream(f"{path}/_files.json") as f:
            done = json.loads(f.read())
        self.outputs[name] = {"files": [f"{folder}/{x}" for x in done["files"]], "rows": done["rows"], "schema": df.schema.jsonValue()}

    def publish(self) -> int:
        """Make the staged outputs the next version; ``facts`` stand in its record."""
        version = (self.parent["version"] if self.parent else 0) + 1
        outputs = {**(self.parent["outputs"] if self.parent else {}), **self.outputs}
        record = {"version": version, "parent": version - 1, "at": time.time(), "facts": self.facts, "outputs": outputs}
        if not create_once(self.store.spark, f"{self.store.root}/versions/{version:012d}.json", json.dumps(record)):
            raise Conflict(f"version {version} is there already")
        self.published = True
        return version


def write_collection(jobs: DataFrame, history: DataFrame, report: str, root: str) -> int:
    """A run's three outputs under one commit: its records, the history after it, and the report."""
    with Versions(jobs.sparkSession, root).begin() as transaction:
        transaction.stage("run", jobs)
        transaction.stage("history", history)
        transaction.stage("report", jobs.sparkSession.createDataFrame([(report,)], "value string"))
        return transaction.publish()
