"""An audit table of streams: what each batch did, and how a batch or a stream failed.

``Audit`` is a query listener: it turns the progress that Spark reports anyway into rows, so counting costs no job. What a
listener cannot see, a step inside ``foreachBatch`` that timed out or failed and was left behind, ``audited`` notes
itself and lets the stream go on with the next batch. Rows are kept in memory and appended to the table when there are
``every`` of them and on ``close``: one small file for many batches.

A batch that is given up has its Spark jobs cancelled by tag; its thread is not waited for. Its input is kept in a folder
of dead letters, if there is one, so that nothing is lost.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as GivenUp

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "query string, run string, batch long, kind string, at double, input_rows long, duration_ms long, detail string"
Step = Callable[[DataFrame, int], None]


class Audit(StreamingQueryListener):
    """Rows of kind started, progress, timeout, error, idle and ended."""

    def __init__(self, spark: SparkSession, path: str, every: int = 100):
        self.spark, self.path, self.every = spark, path, every
        self._rows: list[tuple] = []
        self._lock = threading.Lock()

    def note(self, kind: str, *, query: str = "", run: str = "", batch: int = -1, rows: int | None = None, ms: int | None = None, detail: str = "") -> None:
        with self._lock:
            self._rows.append((query, run, batch, kind, time.time(), rows, ms, detail[:2000]))
            full = len(self._rows) >= self.every
        if full:
            self.flush()

    def flush(self) -> None:
        with self._lock:
            rows, self._rows = self._rows, []
        if rows:
            try:
                self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
            except Exception:  # kept for the next flush: an audit must not end what it looks at
                with self._lock:
                    self._rows = rows + self._rows

    def table(self) -> DataFrame:
        """All rows so far."""
        self.flush()
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def __enter__(self) -> Audit:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.streams.removeListener(self)
        self.flush()

    # --- what Spark reports ---

    def onQueryStarted(self, event) -> None:
        self.note("started", query=str(event.id), run=str(event.runId), detail=event.name or "")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        sinks = {"sources": [s.description for s in p.sources], "sink": p.sink.description}
        self.note("progress", query=str(p.id), run=str(p.runId), batch=p.batchId, rows=p.numInputRows, ms=p.batchDuration, detail=json.dumps(sinks))

    def onQueryIdle(self, event) -> None:
        self.note("idle", query=str(event.id), run=str(event.runId))

    def onQueryTerminated(self, event) -> None:
        self.note("error" if event.exception else "ended", query=str(event.id), run=str(event.runId), detail=event.exception or "")


def audited(step: Step, audit: Audit, *, timeout_s: float = 120.0, dead: str | None = None) -> Step:
    """A batch's step that is given up after so long, and whose failures are noted and do not end the stream."""

    def run(batch: DataFrame, n: int) -> None:
        spark, tag, began = batch.sparkSession, f"batch-{uuid.uuid4().hex[:8]}", time.monotonic()

        def work() -> None:
            spark.addTag(tag)
            try:
                step(batch, n)
            finally:
                spark.removeTag(tag)

        pool = ThreadPoolExecutor(1)
        try:
            pool.submit(work).result(timeout=timeout_s)
        except GivenUp:
            spark.interruptTag(tag)
            _left_behind(batch, n, "timeout", f"more than {timeout_s:g} s", began)
        except Exception as e:
            _left_behind(batch, n, "error", f"{type(e).__name__}: {e}", began)
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    def _left_behind(batch: DataFrame, n: int, kind: str, why: str, began: float) -> None:
        if dead:
            batch.write.mode("overwrite").parquet(f"{dead}/batch={n}")
        audit.note(kind, batch=n, ms=int(1000 * (time.monotonic() - began)), detail=why)

    return run


def summary(table: DataFrame) -> DataFrame:
    """Of each run: batches, input rows, the longest batch, and how many were given up or failed."""
    kinds = {k: F.count_if(F.col("kind") == k) for k in ("timeout", "error")}
    done = F.col("kind") == "progress"
    return table.groupBy("run").agg(
        F.count_if(done).alias("batches"), F.sum(F.when(done, F.col("input_rows"))).alias("input_rows"), F.max(F.when(done, F.col("duration_ms"))).alias("longest_ms"), *(c.alias(f"{k}s") for k, c in kinds.items())
    )
