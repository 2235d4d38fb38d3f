"""Unknown-aware merges. Each is an aggregate over rows in an explicit order, one shuffle on the key.

- ``merge_history``: the newest known value wins; arrays unite; maps merge; seen counts add.
- ``merge_index``: the first known value wins, and a later, different one is noted as a conflict.
The order-sensitive fold of both pipelines is in ``pair_fold``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.url import detail_url
from ..functions.values import known, no_strings, unique
from ..schema import INDEXED, conform, fields
from .dedupe import ordered_list

#: Never in conflict: they name the record or say when and where it was seen.
NO_CONFLICT = ("job_id", "job_url", "collected_at", "first_seen_at", "last_seen_at", "seen_count", "index_evidence", "index_evidence_all", "field_evidence", "information_confidence")


def last_known(c: str, order: Column) -> Column:
    """An aggregate: the last value by order that is known; NULL if none is."""
    return F.max_by(known(c), F.when(known(c).isNotNull(), order))


def first_known(c: str, order: Column) -> Column:
    return F.min_by(known(c), F.when(known(c).isNotNull(), order))


def united(c: str, *order: Column) -> Column:
    """An aggregate: items of all arrays, distinct, in order of first appearance."""
    return unique(F.flatten(ordered_list(F.coalesce(F.col(c), no_strings()), order)))


def merged_maps(c: str, *order: Column) -> Column:
    """An aggregate: all maps' entries, later ones first to last."""
    empty = F.map_from_arrays(no_strings(), no_strings())
    maps = ordered_list(F.map_entries(F.coalesce(F.col(c), empty)), order)  # maps have no order of their own
    return F.aggregate(maps, empty, lambda a, b: F.map_zip_with(a, F.map_from_entries(b), lambda k, x, y: F.coalesce(y, x)))


def _evidence(df: DataFrame) -> DataFrame:
    """Every row's list of evidence, from its single entry where there is no list."""
    single = F.when(F.col("index_evidence").isNotNull(), F.array("index_evidence")).otherwise(F.array().cast(df.schema["index_evidence_all"].dataType))
    return df.withColumn("index_evidence_all", F.coalesce("index_evidence_all", single))


def merge_history(previous: DataFrame, current: DataFrame, key: str = "job_id", order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """History after a run: rows of one key merge, earlier before later, ``order`` within each side."""
    sides = [conform(side, INDEXED).withColumn("__side", F.lit(i)) for i, side in enumerate((previous, current))]
    rows = _evidence(sides[0].unionByName(sides[1], allowMissingColumns=True))
    spot = [F.col("__side"), *(F.col(o) if o in rows.columns else F.lit(0) for o in order)]
    at = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(spot)))
    whole = []
    for f in fields(INDEXED):
        if f.name in (key, "index_evidence_all", "seen_count", "first_seen_at", "last_seen_at"):
            continue
        if isinstance(f.dataType, T.ArrayType):
            whole.append(united(f.name, *spot).alias(f.name))
        elif isinstance(f.dataType, T.MapType):
            whole.append(merged_maps(f.name, *spot).alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            whole.append(last_known(f.name, at).alias(f.name))
        else:
            whole.append(F.max_by(f.name, F.when(F.col(f.name).isNotNull(), at)).alias(f.name))
    # an old row brings its count, each run that sees it again adds one
    seen = F.coalesce(F.max(F.when(F.col("__side") == 0, F.coalesce("seen_count", F.lit(1)))), F.min("seen_count") - 1, F.lit(0)) + F.sum(F.col("__side"))
    out = rows.groupBy(F.coalesce(F.nullif(F.col(key), F.lit("")), F.col("job_url")).alias("__key")).agg(
        F.min_by(key, at).alias(key),
        *whole,
        first_known("first_seen_at", at).alias("first_seen_at"),
        F.max_by("last_seen_at", at).alias("last_seen_at"),
        seen.cast("long").alias("seen_count"),
        F.flatten(ordered_list(F.col("index_evidence_all"), spot)).alias("index_evidence_all"),
    )
    return conform(out.drop("__key"), INDEXED)


def merge_index(records: DataFrame, order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """One record a detail URL; the first known value stays and ``index_conflict:<field>`` says where another differed."""
    rows = _evidence(conform(records, INDEXED)).withColumn("__url", detail_url(F.col("job_url"))).where(F.col("__url").isNotNull())
    spot = [F.col(o) for o in order]
    at = F.struct(*spot)
    columns, conflicts = [], []
    for f in fields(INDEXED):
        c = f.name
        if c in ("seen_count", "index_evidence", "index_evidence_all", "review_reasons", "first_seen_at", "last_seen_at"):
            continue
        if isinstance(f.dataType, T.ArrayType):
            columns.append(united(c, *spot).alias(c))
        elif isinstance(f.dataType, T.MapType):
            columns.append(merged_maps(c, *spot).alias(c))
        elif c in NO_CONFLICT:
            columns.append(last_known(c, at).alias(c))
        else:
            columns.append(first_known(c, at).alias(c))
            conflicts.append(F.when(F.count_distinct(known(c)) > 1, F.lit(f"index_conflict:{c}")))
    out = rows.groupBy("__url").agg(
        *columns,
        F.min(known("first_seen_at")).alias("first_seen_at"),
        F.max(known("last_seen_at")).alias("last_seen_at"),
        F.sum(F.coalesce("seen_count", F.lit(1))).alias("seen_count"),
        F.flatten(ordered_list(F.col("index_evidence_all"), spot)).alias("index_evidence_all"),
        united("review_reasons", *spot).alias("__reasons"),
        F.array_compact(F.array(*conflicts)).alias("__conflicts"),
        F.count("*").alias("merged_rows"),
    )
    out = out.withColumn("review_reasons", F.array_union("__reasons", "__conflicts")).withColumn("index_evidence", F.try_element_at("index_evidence_all", F.lit(-1)))
    return conform(out.drop("__url", "__reasons", "__conflicts"), INDEXED)


def merge_evidence(left: Column, right: Column) -> Column:
    """Entries of both, one for each (type, observed_at, url, query, detail): the place of the first, the value of the last."""
    key = lambda x: F.struct(*(x[c] for c in ("type", "observed_at", "url", "query", "detail")))
    every = F.concat(left, right)
    keys = F.array_distinct(F.transform(every, key))
    return F.transform(keys, lambda k: F.element_at(F.filter(every, lambda x: key(x).eqNullSafe(k)), -1))


def latest(df: DataFrame, key: str, value: str, order: tuple[str, ...]) -> DataFrame:
    """Each key's newest value that is not null; a later ordinal wins ties."""
    at = F.struct(*order)
    return df.groupBy(key).agg(F.max_by(value, F.when(F.col(value).isNotNull(), at)).alias(value))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows by key; a new row's values stand before the old one's, field by field."""
    n = new.select(*(F.col(c).alias(f"__n_{c}") for c in new.columns))
    joined = old.join(n, F.col(key) == F.col(f"__n_{key}"), "full_outer")
    return joined.select(*(F.coalesce(F.col(f"__n_{c}"), F.col(c)).alias(c) if c in new.columns else F.col(c) for c in old.columns))


def upsert_manifest(entries: DataFrame, order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """One entry a URL: first sequence, last known texts, all screenshots; in order of sequence."""
    at = F.struct(*order)
    spot = [F.col(o) for o in order]
    texts = [c for c in ("canonical_key", "status", "capture_status", "captured_at", "title_hint", "page_state", "card_screenshot") if c in entries.columns]
    return (
        entries.groupBy("url")
        .agg(F.min_by("sequence", at).alias("sequence"), *(last_known(c, at).alias(c) for c in texts), united("detail_screenshots", *spot).alias("detail_screenshots"))
        .orderBy("sequence")
    )


def new_rows(current: DataFrame, seen: DataFrame, *keys: str) -> DataFrame:
    """Rows of the run whose key was not seen before."""
    return current.join(seen.select(*keys).distinct(), list(keys), "left_anti")
