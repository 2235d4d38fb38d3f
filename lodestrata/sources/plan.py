"""Query plans: terms by modes by districts, filled into templates, in a fixed order."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import squeeze


def _entries(spark: SparkSession, items: list[dict] | DataFrame) -> DataFrame:
    """Of entries (place, and what they say) one row: their list by place, and how many there are. Lists of a plan are short."""
    if isinstance(items, DataFrame):
        names = [c for c in items.columns if c != "place"]
        entry = F.struct("place", *names)
        return items.agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.struct(*(x[n].alias(n) for n in names))).alias("entries"))
    literal = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in item.items())) for item in items))
    return spark.range(1).select(literal.alias("entries"))


def query_plan(
    spark: SparkSession, config: dict, *, terms: list[str] | DataFrame | None = None, modes: list[str] | DataFrame | None = None, shards: bool = False, districts: DataFrame | None = None, limit: int = 0
) -> DataFrame:
    """place, term, district, mode, query: every term with every mode and district, which is the plan's definition.

    Terms, modes (mode, template) and districts may be tables with a column ``place``, from 0 without gaps; they stay in
    Spark. Terms are rows, dealt as they come; each meets the short lists of modes and districts, so a query's place
    follows from its entries' places and nothing is ranked. An empty list gives an empty plan.
    """
    if isinstance(terms, DataFrame):
        rows = terms.select(F.col("place").alias("i"), "term")
    else:
        rows = _entries(spark, [{"term": t} for t in terms or config["terms"]]).select(F.posexplode("entries").alias("i", "e")).select("i", "e.term")
    kept = modes if isinstance(modes, DataFrame) else [{"mode": m["id"], "template": m["template"]} for m in config["modes"] if not modes or m["id"] in modes]
    if not isinstance(kept, DataFrame) and not kept:
        rows, kept = rows.limit(0), [{"mode": "", "template": ""}]
    parts = districts if districts is not None else [{"district": x} for x in (["", *(config.get("district_shards") or [])] if shards else [""])]
    lists = {"m": _entries(spark, kept).scalar(), "d": _entries(spark, parts).scalar()}
    df = rows.select("*", *(c.alias(f"{n}s") for n, c in lists.items()))
    df = df.select("i", "term", "ds", F.size("ms").alias("m_n"), F.posexplode("ms").alias("m_i", "m"))
    df = df.select("i", "term", "m_n", "m_i", "m", F.size("ds").alias("d_n"), F.posexplode("ds").alias("d_i", "d"))
    place = ((F.col("i").cast("long") * F.col("m_n") + F.col("m_i")) * F.col("d_n") + F.col("d_i")).alias("place")
    query = F.replace(F.replace(F.replace("m.template", F.lit("{city}"), F.lit(config["city"])), F.lit("{district}"), F.col("d.district")), F.lit("{term}"), F.col("term"))
    df = df.select(place, "term", F.coalesce(F.nullif("d.district", F.lit("")), F.lit("全市")).alias("district"), F.col("m.mode").alias("mode"), squeeze(query).alias("query"))
    return (df.where(F.col("place") < limit) if limit else df).orderBy("place")


def signature(provider: str, pages: int, count: int, plan: list[dict]) -> str:
    """What a resumed collection must have in common with the stored one."""
    return hashlib.sha256(json.dumps([provider, pages, count, plan], sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def resumable(stored: dict | None, sign: str) -> bool:
    """Whether a stored collection goes on: it is the same collection and was not completed."""
    return stored is not None and stored.get("signature") == sign and not stored.get("completed_at")


def remaining(work: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("mode", "query", "page")) -> DataFrame:
    """Units of work without a checkpointed result."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def check_arguments(*, pages: int, count: int, interval_s: int = 60, concurrency: int = 8) -> None:
    """The limits that collectors and workers accept."""
    problems = [
        f"{name} must lie in {low}..{high}"
        for name, value, low, high in (("pages", pages, 1, 10), ("count", count, 1, 20), ("interval_s", interval_s, 60, 1 << 31), ("concurrency", concurrency, 1, 32))
        if not low <= value <= high
    ]
    if problems:
        raise ValueError("; ".join(problems))
