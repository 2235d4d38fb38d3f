"""Shared helpers: the scratch folder, word boundaries and vectorised hashing of text."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"

_own: dict[str, tempfile.TemporaryDirectory] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session may lack the setting; it gets a folder of its own, removed at exit.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.TemporaryDirectory(prefix="lodestrata-")
        atexit.register(_own[app].cleanup)
    return f"file://{_own[app].name}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{scratch_root(spark)}/lodestrata/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What runs inside drops its shuffle files when it ends, not when the driver next collects its garbage.

    Only for actions on plans that nothing runs again: their results are in the shared folder or on the driver.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage and survives a lost executor."""
    path = scratch_path(df.sparkSession, name)
    with swept(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path of any file system that Spark reads, if it is there."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


class Scratch:
    """The tables that one call of an operator writes to the shared folder.

    ``drop`` deletes a table when its last reader has run; on leaving, all go but those that ``keep`` named, which the
    returned DataFrame still reads. Those stay until ``release``.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop(*(df for df, _ in list(self._paths.values())))

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        with swept(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = out, path
        return out

    def keep(self, df: DataFrame) -> DataFrame:
        del self._paths[id(df)]
        return df

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            if id(df) in self._paths:
                delete(self.spark, self._paths.pop(id(df))[1])


def release(spark: SparkSession) -> None:
    """Delete everything this library wrote to the shared folder in earlier calls."""
    delete(spark, f"{scratch_root(spark)}/lodestrata")


#: A key with more than this share of the rows is hot. So there are fewer hot keys than this, whatever the table.
HOT_SHARE = 1 << 14
SALTS = 64


def look_up(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join of ``rows`` with ``table``, which has a row for each key; keys are not null.

    Hot keys, of which at most ``HOT_SHARE`` come to be broadcast, are dealt over ``SALTS`` tasks, and their rows of
    ``table`` go to each of them.
    """
    name, n, salt = free([*rows.columns, *table.columns], "hot_key", "key_rows", "key_salt")
    least = max(rows.count(), 1 << 20) // HOT_SHARE
    hot = rows.groupBy(F.col(key).alias(name)).agg(F.count("*").alias(n)).where(F.col(n) > least).select(name)
    dealt = rows.join(F.broadcast(hot), F.col(key) == F.col(name), "left")
    dealt = dealt.withColumn(salt, F.when(F.col(name).isNotNull(), F.monotonically_increasing_id() % SALTS).otherwise(0)).drop(name)
    spread = table.join(F.broadcast(hot), F.col(key) == F.col(name), "left")
    every = F.when(F.col(name).isNotNull(), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    spread = spread.withColumn(salt, F.explode(every)).drop(name)
    return dealt.join(spread, [key, salt], how).drop(salt)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free(taken: Iterable[str], *names: str) -> tuple[str, ...]:
    """The names, lengthened where one is taken, so that helper columns clash with no column of the input."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return tuple(out)


def word_count(text: Column) -> Column:
    """Number of words, 0 for null: each word becomes one mark, white space goes."""
    marks = F.translate(F.regexp_replace(text, WORD, "x"), SPACES, "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


# --- hashing of words and shingles, vectorised over the bytes of a text -------------------------

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE_TABLE = np.zeros(256, bool)
_SPACE_TABLE[[32, 9, 10, 11, 12, 13]] = True
#: Each byte's value in the hash, A-Z as a-z.
_rng = np.random.default_rng(20240229)
_BYTE_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_TABLE = _BYTE_TABLE.copy()
_LOWER_TABLE[65:91] = _BYTE_TABLE[97:123]

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grow_powers(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << max(16, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            base = np.full(size, _BASE, np.uint64)
            inverse = np.full(size, _INVERSE, np.uint64)
            base[0] = inverse[0] = 1
            _powers, _inverses = np.multiply.accumulate(base), np.multiply.accumulate(inverse)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_bounds(raw: np.ndarray, between: np.ndarray = _SPACE_TABLE) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which words begin and end; ``between`` marks the bytes that part words."""
    space = np.empty(len(raw) + 2, bool)
    space[0] = space[-1] = True
    space[1:-1] = between[raw]
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(raw: np.ndarray, lower: bool = True, between: np.ndarray = _SPACE_TABLE) -> np.ndarray:
    """A 64-bit hash of each word of UTF-8 bytes, by one prefix sum modulo 2**64 over the text."""
    starts, ends = word_bounds(raw, between)
    if not len(starts):
        return np.empty(0, np.uint64)
    _grow_powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((_LOWER_TABLE if lower else _BYTE_TABLE)[raw] * _powers[: len(raw)], out=total[1:])
        return mix64((total[ends] - total[starts]) * _inverses[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every window of ``n`` words; of all words as one window where there are fewer."""
    if not len(words):
        return words
    n = min(n, len(words))
    with np.errstate(over="ignore"):
        out = np.full(len(words) - n + 1, n, np.uint64)
        for i in range(n):
            out = out * np.uint64(0xD6E8FEB86659FD93) + words[i : len(words) - n + 1 + i]
        return mix64(out)
