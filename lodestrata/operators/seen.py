"""Keys seen in all runs so far, with a Bloom sketch for each bucket of them.

Keys lie in buckets by hash. Beside them stands a sketch for each bucket, merged with every run's new keys. A run's
distinct keys meet their bucket's sketch first: what the sketch denies is new, without a look at the keys of earlier
runs; only the rest is joined with the keys, and only with the buckets that it falls into. So the earlier keys, which
grow with every run, are read for keys that most likely are there, and no sketch goes to a bucket that is not its own.

A key's bits come from two hashes that Spark computes; tasks only set and test bits. Buckets and bits are chosen when the
table is made; ``rebuild`` makes a larger one when its keys outgrow the sketches.

Edge cases: a null key is never seen, and never remembered; repeated keys of a run are one key; without earlier keys all
rows are new; an empty run changes nothing. The result is that of ``merge.new_rows``, whatever the sketches' errors.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from ..sources.sinks import _fs

KEYS = "bucket int, key string"
BLOOMS = "bucket int, n long, bits binary"


def _places(first: np.ndarray, second: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    """The bits of each key, a row a key."""
    with np.errstate(over="ignore"):
        steps = np.arange(hashes, dtype=np.uint64)[None, :]
        return (first.view(np.uint64)[:, None] + steps * (second.view(np.uint64) | np.uint64(1))[:, None]) % np.uint64(bits)


class SeenKeys:
    """A table of seen keys under ``root``; the options count only when it is made."""

    def __init__(self, spark: SparkSession, root: str, *, buckets: int = 64, bits: int = 1 << 17, hashes: int = 7):
        self.spark, self.root = spark, root.rstrip("/")
        path, fs, jvm = _fs(spark, f"{self.root}/shape.json")
        if fs.exists(path):
            source = fs.open(path)
            shape = json.loads(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode())
            source.close()
        else:
            shape = {"buckets": buckets, "bits": bits, "hashes": hashes}
            out = fs.create(path, False)
            out.write(json.dumps(shape).encode())
            out.close()
        self.buckets, self.bits, self.hashes = shape["buckets"], shape["bits"], shape["hashes"]

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _batches(self, kind: str) -> list[int]:
        pattern, fs, _ = _fs(self.spark, f"{self.root}/{kind}/batch=*/_SUCCESS")
        return sorted(int(x.getPath().getParent().getName().partition("=")[2]) for x in fs.globStatus(pattern) or [])

    def keys(self) -> DataFrame:
        """bucket and key of all batches that have a sketch."""
        done = [n for n in self._batches("keys") if n in set(self._batches("blooms"))]
        if not done:
            return self.spark.createDataFrame([], KEYS)
        return self.spark.read.schema("key string, bucket int").option("basePath", f"{self.root}/keys").parquet(*(f"{self.root}/keys/batch={n}" for n in done)).select("bucket", "key")

    def blooms(self) -> DataFrame:
        done = self._batches("blooms")
        return self.spark.read.schema(BLOOMS).parquet(f"{self.root}/blooms/batch={done[-1]}") if done else self.spark.createDataFrame([], BLOOMS)

    def _hashed(self, keys: DataFrame) -> DataFrame:
        return keys.select("key", self._bucket(F.col("key")).alias("bucket"), F.xxhash64("key", F.lit(1)).alias("h1"), F.xxhash64("key", F.lit(2)).alias("h2"))

    def maybe(self, keys: DataFrame) -> DataFrame:
        """bucket and key of those distinct keys that a sketch does not deny."""
        bits, hashes = self.bits, self.hashes

        def test(asked: pa.Table, sketch: pa.Table) -> pa.Table:
            if not sketch.num_rows or not asked.num_rows:
                return asked.select(["bucket", "key"]).slice(0, 0)
            words = np.unpackbits(np.frombuffer(sketch["bits"][0].as_py(), np.uint8), bitorder="little")
            at = _places(asked["h1"].to_numpy(), asked["h2"].to_numpy(), bits, hashes)
            return asked.select(["bucket", "key"]).filter(pa.array(words[at.astype(np.int64)].all(1)))

        return self._hashed(keys).groupBy("bucket").cogroup(self.blooms().groupBy("bucket")).applyInArrow(test, KEYS)

    def _merged(self, keys: DataFrame, bits: int) -> DataFrame:
        """The sketches with these keys' bits."""
        hashes = self.hashes

        def merge(new: pa.Table, sketch: pa.Table) -> pa.Table:
            bucket = (new if new.num_rows else sketch)["bucket"][0].as_py()
            words = np.unpackbits(np.frombuffer(sketch["bits"][0].as_py(), np.uint8), bitorder="little").copy() if sketch.num_rows else np.zeros(bits, np.uint8)
            if new.num_rows:
                words[_places(new["h1"].to_numpy(), new["h2"].to_numpy(), bits, hashes).astype(np.int64).ravel()] = 1
            n = new.num_rows + (sketch["n"][0].as_py() if sketch.num_rows else 0)
            return pa.table({"bucket": pa.array([bucket], pa.int32()), "n": pa.array([n], pa.int64()), "bits": pa.array([np.packbits(words, bitorder="little").tobytes()], pa.binary())})

        return self._hashed(keys).groupBy("bucket").cogroup(self.blooms().groupBy("bucket")).applyInArrow(merge, BLOOMS)

    def add(self, keys: DataFrame) -> None:
        """Remember distinct keys (column ``key``) that are not there yet."""
        n = max([-1, *self._batches("keys")]) + 1
        path = f"{self.root}/keys/batch={n}"
        keys.select("key", self._bucket(F.col("key")).alias("bucket")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        written = self.spark.read.schema("key string, bucket int").parquet(path)
        self._merged(written.select("key"), self.bits).write.mode("overwrite").parquet(f"{self.root}/blooms/batch={n}")

    def split(self, rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        """The rows whose key is new, and a table of one row with the counts of distinct keys: asked, maybe, seen.

        asked - maybe keys were settled by sketches alone; maybe - seen are the sketches' errors.
        """
        asked = rows.select(F.col(key).cast("string").alias("key")).where(F.col("key").isNotNull()).distinct()
        found = stored(self.maybe(asked), "seen-maybe")
        hits = stored(found.join(self.keys_in(found), ["bucket", "key"], "left_semi"), "seen-hits")
        fresh = rows.join(hits.select(F.col("key").alias("__seen")), F.col(key).cast("string") == F.col("__seen"), "left_anti")
        count = lambda df, name: df.agg(F.count("*").alias(name))
        one = count(asked, "asked").join(F.broadcast(count(found, "maybe"))).join(F.broadcast(count(hits, "seen")))  # a row each
        return fresh, one

    def keys_in(self, found: DataFrame) -> DataFrame:
        """The seen keys of the buckets that occur in ``found``; other buckets' files are not read."""
        return self.keys().where(F.col("bucket").isin([r["bucket"] for r in found.select("bucket").distinct().collect()]))  # at most as many as there are buckets

    def new_rows(self, rows: DataFrame, key: str, remember: bool = True) -> DataFrame:
        """The rows whose key no run has seen; their keys are remembered."""
        fresh = stored(self.split(rows, key)[0], "seen-fresh")
        if remember:
            self.add(fresh.select(F.col(key).cast("string").alias("key")).where(F.col("key").isNotNull()).distinct())
        return fresh

    def error_rate(self) -> float:
        """The share of unseen keys that the fullest sketch lets pass, by its number of keys."""
        most = self.blooms().agg(F.max("n")).first()[0] or 0
        return (1 - math.exp(-self.hashes * most / self.bits)) ** self.hashes

    def rebuild(self, root: str, *, buckets: int, bits: int) -> SeenKeys:
        """The same keys in a new table with other buckets and bits."""
        out = SeenKeys(self.spark, root, buckets=buckets, bits=bits, hashes=self.hashes)
        out.add(self.keys().select("key"))
        return out
