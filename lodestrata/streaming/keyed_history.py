"""Cumulative history as keyed state of a stream: a micro-batch touches the keys that it brings, and nothing else.

Beside the rewrite of buckets in ``history``: here each key's merged record is a value in the state store and its
evidence a list that is only appended to, so what a batch reads and writes grows with the batch and not with history.
Nothing expires. The state store keeps a version for each batch, so a batch that runs again starts from the state
before it. The stream gives a row for each key that a batch touched; ``snapshot`` reads all of history from the store.

The merge is that of ``merge_history``, applied batch by batch: rows of a batch by ``ord``, the newest known value wins,
arrays unite, maps merge, seen counts add. Rows with neither id nor URL share the empty key; an empty batch changes
nothing; a key's rows of one batch are held together, its history is not.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import UNKNOWN
from ..schema import INDEX_EVIDENCE, INDEXED, conform, fields

KEY = "history_key"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _record() -> T.StructType:
    """A record without its list of evidence, which is a state of its own."""
    return T.StructType([f for f in fields(INDEXED) if f.name != "index_evidence_all"])


def _known(value: Any) -> bool:
    return value not in (None, "", UNKNOWN)


def _union(old: list | None, new: list | None) -> list:
    return list(dict.fromkeys(x for x in [*(old or []), *(new or [])] if x is not None and x != ""))


def fold(record: dict | None, rows: list[dict], kinds: T.StructType) -> tuple[dict, list]:
    """The record after a batch's rows of its key, in their order, and the evidence that they bring. A row has its known fields alone."""
    old, evidence = record, []
    record = dict(record or {})
    for f in kinds:
        name = f.name
        given = [row[name] for row in rows if name in row]
        if isinstance(f.dataType, T.ArrayType):
            record[name] = _union(record.get(name), [x for value in given for x in value])
        elif isinstance(f.dataType, T.MapType):
            record[name] = dict(record.get(name) or ())  # maps come as pairs
            for value in given:
                record[name] |= {k: v for k, v in value.items() if v is not None or k not in record[name]}
        elif name == "last_seen_at":
            record[name] = rows[-1].get(name)
        elif name == "first_seen_at":
            record[name] = next(filter(_known, [record.get(name), *given]), None)
        elif name not in ("job_id", "seen_count") and given:
            known = [*filter(_known, given)] if isinstance(f.dataType, T.StringType) else given
            record[name] = known[-1] if known else record.get(name)
    for row in rows:
        evidence += row["index_evidence_all"] if "index_evidence_all" in row else [row["index_evidence"]] if "index_evidence" in row else []
    if old is None:
        counts = [r["seen_count"] for r in rows if "seen_count" in r]
        record["job_id"], seen = rows[0].get("job_id"), min(counts) - 1 if counts else 0
    else:
        seen = old["seen_count"] if old["seen_count"] is not None else 1
    record["seen_count"] = seen + len(rows)
    return record, evidence


class _Merge(StatefulProcessor):
    def __init__(self, record: T.StructType, entry: T.DataType):
        self.kinds = record
        self.state = T.StructType([*record, T.StructField("evidence_count", T.LongType())])
        self.entry = T.StructType([T.StructField("n", T.LongType()), T.StructField("evidence", entry)])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.record = handle.getValueState("record", self.state)
        self.evidence = handle.getListState("evidence", self.entry)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        old = dict(zip(self.state.names, self.record.get())) if self.record.exists() else None
        if old and old["index_evidence"] is not None:  # from the store structs come as tuples
            old["index_evidence"] = dict(zip(self.entry["evidence"].dataType.names, old["index_evidence"]))
        listed = sorted(rows, key=lambda r: (r["ord"] is not None, r["ord"]))
        record, new = fold(old, [json.loads(r["given"]) for r in listed], self.kinds)
        entry = self.entry["evidence"].dataType.names  # JSON leaves out what is null
        new = [None if x is None else {n: x.get(n) for n in entry} for x in new]
        if isinstance(record.get("index_evidence"), dict):
            record["index_evidence"] = {n: record["index_evidence"].get(n) for n in entry}
        before = old["evidence_count"] if old else 0
        record["evidence_count"] = before + len(new)
        values = {n: record.get(n) for n in self.state.names}
        self.record.update(tuple(values.values()))
        if new:
            self.evidence.appendList([(before + i, e) for i, e in enumerate(new)])
        yield Row(**values, new_evidence=new)

    def close(self) -> None:
        pass


def merged(stream: DataFrame) -> DataFrame:
    """A stream of records: each key's merged record whenever a batch brings the key, with the evidence that is new.

    ``ord`` is the order in a batch. A row goes to Python as the JSON of its fields that are not null, as every column of a
    row costs there, most are null as a rule, and a batch brings many rows.
    """
    if "ord" not in stream.columns:
        stream = stream.withColumn("ord", F.lit(0).cast("long"))
    key = F.coalesce(F.nullif("job_id", F.lit("")), "job_url", F.lit(""))
    given = F.to_json(F.struct(*fields(INDEXED).names), {"ignoreNullFields": "true"})
    rows = conform(stream, INDEXED).select(key.alias(KEY), "ord", given.alias("given"))
    list_of = fields(f"new_evidence array<{INDEX_EVIDENCE}>")
    step = _Merge(_record(), list_of[0].dataType.elementType)
    return rows.groupBy(KEY).transformWithState(step, T.StructType([*step.state, *list_of]), "update", "none")


def write_changes(out: str) -> Callable[[DataFrame, int], None]:
    """Each batch's changed records as ``out/batch=n``; a batch that runs again replaces its own."""
    return lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")


def start(spark: SparkSession, landing: str, checkpoint: str, write: Callable[[DataFrame, int], None], files_per_batch: int = 1) -> StreamingQuery:
    """Merge all files that have landed, a few at a time, then stop."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    schema = T.StructType([*fields(INDEXED), T.StructField("ord", T.LongType())])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    return merged(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot(spark: SparkSession, checkpoint: str) -> DataFrame:
    """All of history from the state store, each key's evidence in the order in which it came."""
    state = lambda name: spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
    records = state("record").select(F.col(f"key.{KEY}").alias("k"), "value.*")
    entries = state("evidence").select(F.col(f"key.{KEY}").alias("e_k"), F.col("list_element.n").alias("n"), F.col("list_element.evidence").alias("evidence"))
    listed = entries.groupBy("e_k").agg(F.array_sort(F.collect_list(F.struct("n", "evidence"))).alias("all"))
    out = records.join(listed, F.col("k") == F.col("e_k"), "left")
    none = F.array().cast(f"array<{INDEX_EVIDENCE}>")
    return conform(out.withColumn("index_evidence_all", F.coalesce(F.transform("all", lambda x: x["evidence"]), none)).drop("k", "e_k", "all", "evidence_count"), INDEXED)
