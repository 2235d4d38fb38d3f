"""Keep-first duplicates and accumulated evidence, by explicit ordinals: a DataFrame has no row order to rely on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordinal import with_position


def keep_first(df: DataFrame, key: str | Column, order: Sequence[str | Column], mark: str | None = None) -> DataFrame:
    """The first row of each key; with ``mark``, all rows and whether they are later ones."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    if mark:
        return df.withColumn(mark, nth > 1)
    return df.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def ordered_list(value: Column, order: Sequence[Column]) -> Column:
    """An aggregate: the values in the given order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), value.alias("v")))), lambda x: x["v"])


def evidence_places(df: DataFrame, key: str, order: Sequence[str], evidence: str) -> DataFrame:
    """All evidence as a table of its own: key, place (from 0, by ``order``) and entry, a row each, null entries left out.

    Unlike a list in the key's row this bounds no key: a key's rows lie in as many tasks as they need.
    """
    rows = df.where(F.col(evidence).isNotNull()).select(F.col(key).alias("key"), *(F.col(o).alias(f"o{i}") for i, o in enumerate(order)), F.col(evidence).alias("entry"))
    return with_position(rows, ["key"], [f"o{i}" for i in range(len(order))], name="place").select("key", "place", "entry")


def first_with_evidence(df: DataFrame, key: str, order: Sequence[str], evidence: str, into: str) -> DataFrame:
    """Keep-first rows that also carry the evidence of every row of their key, in order (set only where there were several)."""
    gathered = df.groupBy(F.col(key).alias("__key")).agg(ordered_list(F.col(evidence), [F.col(o) for o in order]).alias("__all"), F.count("*").alias("__n"))
    out = keep_first(df, key, order).join(gathered, F.col(key) == F.col("__key"))
    return out.withColumn(into, F.when(F.col("__n") > 1, F.col("__all"))).drop("__key", "__all", "__n")
