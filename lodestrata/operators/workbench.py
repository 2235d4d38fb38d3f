"""The workbench query: a conjunction of filters, the user's state, a stable order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import INSUFFICIENT, UNKNOWN, USER_STATUSES
from ..schema import RECORD, conform, fields

#: A user's states are as many as rows that a person has marked; more than this are joined by shuffle.
MAX_BROADCAST_STATES = 100_000


@dataclass(frozen=True)
class Filters:
    """Empty values filter nothing; a minimum of 0 is off."""

    text: str = ""
    recommendation: str = ""
    direction: str = ""
    min_score: float = 0
    user_status: str = ""
    verification: str = ""
    recruiter: str = ""


def with_states(records: DataFrame, states: DataFrame | None, default: str = USER_STATUSES[0]) -> DataFrame:
    """Records with user_status; states outside the enumeration count as none."""
    if states is None:
        return records.withColumn("user_status", F.lit(default))
    states = states.where(F.col("status").isin(*USER_STATUSES)).select(F.col("id").alias("__id"), F.col("status").alias("__status"))
    if states.limit(MAX_BROADCAST_STATES + 1).count() <= MAX_BROADCAST_STATES:
        states = F.broadcast(states)
    out = records.join(states, F.col("id") == F.col("__id"), "left")
    return out.withColumn("user_status", F.coalesce("__status", F.lit(default))).drop("__id", "__status")


def select(records: DataFrame, filters: Filters, states: DataFrame | None = None, order: str = "id") -> DataFrame:
    """Matching records, highest score first, unscored ones last, ties by ``order``."""
    df = records
    if filters.text:
        df = df.where(F.lower(F.concat_ws(" ", "title", "company", "description")).contains(filters.text.lower()))
    for column, value in (("recommendation", filters.recommendation), ("verification_status", filters.verification), ("recruiter_type", filters.recruiter)):
        if value:
            df = df.where(F.col(column) == value)
    if filters.direction:
        df = df.where(F.array_contains("directions", filters.direction))
    if filters.min_score:
        df = df.where(F.coalesce("score", F.lit(-1.0)) >= filters.min_score)
    df = with_states(df, states)
    if filters.user_status:
        df = df.where(F.col("user_status") == filters.user_status)
    return df.orderBy(F.coalesce("score", F.lit(-1.0)).desc(), order)


def top(records: DataFrame, n: int = 10) -> DataFrame:
    """The n best by match score, then confidence."""
    return records.orderBy(F.desc_nulls_last("match_score"), F.desc_nulls_last("evidence_confidence"), "id").limit(n)


def normalize_payload(records: DataFrame) -> DataFrame:
    """Imported records with the workbench's defaults: unknown texts, empty lists, a description, match_score from score."""
    df = conform(records, RECORD)
    texts = [f.name for f in fields(RECORD) if f.dataType.typeName() == "string" and f.name not in ("id", "url", "title", "city", "recommendation", "pipeline", "verification_status", "description")]
    lists = [f for f in fields(RECORD) if f.dataType.typeName() == "array" and f.name != "evidence_source"]
    return df.withColumns({
        "description": F.coalesce("description", "job_description_raw", F.lit(INSUFFICIENT)),
        **{c: F.coalesce(c, F.lit(UNKNOWN)) for c in texts},
        **{f.name: F.coalesce(f.name, F.array().cast(f.dataType)) for f in lists},
        "match_score": F.coalesce("match_score", "score"),
    })


def stale(stored: dict | None, bundled: dict) -> bool:
    """Whether a stored dataset must give way to the bundled one, by their metadata.

    An import never does. Else each part of the bundle's revision that it has (taxonomy version, time of update, number
    of records) must be the stored one's too; a bundle without a revision replaces nothing.
    """
    if stored is None:
        return True
    if stored.get("imported"):
        return False
    given = [k for k in ("direction_taxonomy_version", "updated_at") if bundled.get(k)] + [k for k in ("job_count",) if bundled.get(k) is not None]
    return any(stored.get(k) != bundled[k] for k in given)


def set_state(states: DataFrame, job_id: str, status: str) -> DataFrame:
    """States with one changed; the enumeration is closed."""
    if not job_id or status not in USER_STATUSES:
        raise ValueError("a state needs an id and a known status")
    one = states.sparkSession.createDataFrame([(job_id, status)], "id string, status string")
    return states.where(F.col("id") != job_id).select("id", "status").unionByName(one)
