"""Rounds of a search until nothing new comes, as a fixed point over tables.

A round searches with what the last round found new; what it finds that no round has seen is the next delta. The seen
keys are a table in buckets with sketches (``operators.seen``), each round's delta a table under ``root``. A collection
that is started again goes on after its last whole round. The driver sees a row count a round, and no key.

Edge cases: keys that a round finds twice count once, and the first row by ``order`` stands for them; null keys are
dropped; an empty start or a round without new keys ends the rounds; ``known`` keys are never new.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedupe import keep_first
from ..operators.seen import SeenKeys
from ..session import stored
from .sinks import _fs

Search = Callable[[DataFrame, int], DataFrame]


def _done(spark: SparkSession, root: str) -> list[int]:
    pattern, fs, _ = _fs(spark, f"{root}/round=*/_SUCCESS")
    return sorted(int(x.getPath().getParent().getName().partition("=")[2]) for x in fs.globStatus(pattern) or [])


def found(spark: SparkSession, root: str) -> DataFrame:
    """All rows that were new, with the round that found them; round 0 is the start."""
    return spark.read.option("basePath", root).parquet(*(f"{root}/round={n}" for n in _done(spark, root)))


def rounds(start: DataFrame, search: Search, root: str, *, key: str, order: tuple[str, ...] = (), max_rounds: int = 10, known: DataFrame | None = None, buckets: int = 16) -> tuple[DataFrame, int]:
    """All new rows with their round, and the rounds taken. ``search(delta, n)`` gives rows with the columns of ``start``."""
    spark = start.sparkSession
    seen = SeenKeys(spark, f"{root}/seen", buckets=buckets)

    def take(rows: DataFrame, n: int) -> int:
        """Write a round's new rows; a round is whole once they are written, and its keys follow. The search runs once."""
        rows = stored(keep_first(rows.where(F.col(key).isNotNull()), key, order or (key,)).select(*start.columns), "discovery-found")
        seen.split(rows, key)[0].write.mode("overwrite").parquet(f"{root}/round={n}")
        fresh = spark.read.schema(start.schema).parquet(f"{root}/round={n}")
        size = fresh.count()
        if size:
            seen.add(fresh.select(F.col(key).cast("string").alias("key")))
        return size

    done = _done(spark, root)
    if not done:
        if known is not None:
            seen.add(known.select(F.col(key).cast("string").alias("key")).where(F.col("key").isNotNull()).distinct())
        take(start, 0)
        done = [0]
    else:
        seen.new_rows(spark.read.schema(start.schema).parquet(f"{root}/round={done[-1]}"), key)  # a crash may have come between a round and its keys
    n, size = done[-1], spark.read.parquet(f"{root}/round={done[-1]}").count()
    while size and n < max_rounds:
        n += 1
        size = take(search(spark.read.schema(start.schema).parquet(f"{root}/round={n - 1}"), n), n)
    return found(spark, root), n
