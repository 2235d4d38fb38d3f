"""One worker at a time: a lease on a folder that all workers reach.

A lease is the newest of numbered records. Taking, renewing or giving it back creates the record with the next number, a
file that one worker alone can create, so of several that try at once one wins. A holder that died is followed by the
next one that tries when its time has run out; should it come back, its next renewal fails and it must stop. A stream's
own checkpoint keeps out a second run of the same query; this is for batch writers and loops outside a stream.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from ..sources.sinks import _fs, create_once


class Held(RuntimeError):
    """Another worker has the lease."""


class Lease:
    def __init__(self, spark: SparkSession, path: str, *, ttl_s: float = 600.0, now: Callable[[], float] = time.time):
        self.spark, self.path, self.ttl, self.now = spark, path.rstrip("/"), ttl_s, now
        self.me, self.at = uuid.uuid4().hex, 0

    def _newest(self) -> tuple[int, dict]:
        pattern, fs, jvm = _fs(self.spark, f"{self.path}/*.json")
        known = sorted(int(x.getPath().getName().removesuffix(".json")) for x in fs.globStatus(pattern) or [])
        if not known:
            return 0, {"holder": "", "until": 0.0}
        source = fs.open(_fs(self.spark, f"{self.path}/{known[-1]:012d}.json")[0])
        try:
            record = json.loads(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode())
        finally:
            source.close()
        for n in known[:-2]:  # nobody reads these any more
            fs.delete(_fs(self.spark, f"{self.path}/{n:012d}.json")[0], False)
        return known[-1], record

    def _next(self, n: int, until: float) -> None:
        if not create_once(self.spark, f"{self.path}/{n + 1:012d}.json", json.dumps({"holder": self.me, "until": until})):
            raise Held(f"{self.path}: another worker was faster")
        self.at = n + 1

    def acquire(self) -> None:
        n, record = self._newest()
        if record["until"] > self.now() and record["holder"] != self.me:
            raise Held(f"{self.path}: held for another {record['until'] - self.now():.0f} s")
        self._next(n, self.now() + self.ttl)

    def renew(self) -> None:
        """Hold on for another term; ``Held`` if somebody else has taken the lease since."""
        n, record = self._newest()
        if n != self.at or record["holder"] != self.me:
            raise Held(f"{self.path}: taken by another worker")
        self._next(n, self.now() + self.ttl)

    def release(self) -> None:
        n, record = self._newest()
        if record["holder"] == self.me and n == self.at:
            self._next(n, 0.0)

    def __enter__(self) -> Lease:
        self.acquire()
        return self

    def __exit__(self, *_: object) -> None:
        self.release()
