"""Counters over runs and records: one aggregation each, nothing recomputed per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import RECOMMENDATIONS, REJECT
from .ordinal import with_ordinal


def query_metrics(normalised: DataFrame, by: tuple[str, ...] = ("mode", "query")) -> DataFrame:
    """Per query: pages, raw results, distinct jobs and listings, duplicates, rejects, yield in ten-thousandths.

    ``normalised`` has a row a result (kind, job_id, job_url, batch_idx), and one with a null kind for an empty batch.
    """
    raw = F.count("kind")
    jobs = F.count_distinct(F.when(F.col("kind") == "job", F.col("job_id")))
    pages = F.count_distinct(F.when(F.col("kind") == "listing", F.col("job_url")))
    rejects = F.count_if(F.col("kind") == "rejected")
    out = normalised.groupBy(*by).agg(F.count_distinct("batch_idx").alias("pages"), raw.alias("raw_results"), jobs.alias("exact_job_links"), pages.alias("discovery_pages"), rejects.alias("rejected"))
    out = out.withColumn("duplicates", F.col("raw_results") - F.col("rejected") - F.col("exact_job_links") - F.col("discovery_pages"))
    ten_k = F.floor(F.try_divide(20_000 * F.col("exact_job_links") + F.col("raw_results"), 2 * F.col("raw_results")))
    return out.withColumn("marginal_yield", F.coalesce(ten_k, F.lit(0)).cast("long") / F.lit(10_000.0))


def rejections(normalised: DataFrame) -> DataFrame:
    return normalised.where("kind = 'rejected'").groupBy("reason").agg(F.count("*").alias("n"))


def counted(records: DataFrame, column: str) -> DataFrame:
    """Rows by value, a null value too; by item for arrays."""
    if records.schema[column].dataType.typeName() == "array":
        records = records.select(F.explode(column).alias(column))
    return records.groupBy(column).agg(F.count("*").alias("n"))


#: Runs are looked through in blocks of so many places.
BLOCK_BITS = 16


def recommendation_counts(records: DataFrame) -> DataFrame:
    """A row for every label, 0 where none has it."""
    labels = records.sparkSession.createDataFrame([(i, r) for i, r in enumerate(RECOMMENDATIONS)], "place int, recommendation string")
    return labels.join(counted(records, "recommendation"), "recommendation", "left").select("place", "recommendation", F.coalesce("n", F.lit(0)).alias("n"))


def streaks(runs: DataFrame, order: str, size: str, pause_at: int = 3) -> DataFrame:
    """Runs with delta (growth since the last one), streak (runs without growth so far) and pause.

    A null size is no growth. Each run has a place by a distributed ordinal, so the one before it is a join on places; and a run's streak is its
    distance from the last run that grew. That one is found in two levels: the last in each block of places, then the
    last block before it, so that no task holds more than a block, or a row a block.
    """
    rows = with_ordinal(runs, [order], name="__place")
    before = rows.select((F.col("__place") + 1).alias("__place"), F.col(size).alias("__before"))
    df = rows.join(before, "__place", "left").withColumn("delta", F.col(size) - F.coalesce("__before", F.lit(0))).drop("__before")
    grew = F.when(F.col("delta") > 0, F.col("__place"))
    df = df.withColumn("__block", F.shiftright("__place", BLOCK_BITS))
    line = Window.partitionBy("__block").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    blocks = df.groupBy("__block").agg(F.max(grew).alias("__last"))
    earlier = blocks.select("__block", F.max("__last").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)).alias("__earlier"))  # a row a block
    df = df.withColumn("__last", F.max(grew).over(line)).join(earlier, "__block")
    streak = F.col("__place") - F.coalesce("__last", "__earlier", F.lit(-1))
    return df.withColumn("streak", streak).withColumn("pause", F.col("streak") >= pause_at).drop("__place", "__block", "__last", "__earlier")


def directions(records: DataFrame) -> DataFrame:
    """All distinct directions, sorted."""
    return records.select(F.explode("directions").alias("direction")).distinct().orderBy("direction")


def report(metrics: DataFrame, rejected: DataFrame, title: str = "Collection") -> str:
    """Markdown of the two small aggregates."""
    rows = metrics.orderBy("mode", "query").collect()
    lines = [f"# {title}", "", "| mode | query | pages | raw | jobs | yield |", "| --- | --- | ---: | ---: | ---: | ---: |"]
    lines += [f"| {r['mode']} | {r['query']} | {r['pages']} | {r['raw_results']} | {r['exact_job_links']} | {r['marginal_yield']} |" for r in rows]
    lines += ["", "| rejected for | rows |", "| --- | ---: |", *(f"| {r['reason']} | {r['n']} |" for r in rejected.orderBy("reason").collect())]
    return "\n".join(lines) + "\n"


def metadata_counts(records: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """One row of a dataset's metadata: records, those in review, those rejected by the rubric or before it."""
    out = records.agg(
        F.count("*").alias("job_count"), F.count_if(F.col("verification_status") == "needs_review").alias("review_count"),
        F.count_if(F.col("verification_status") == "captured_jd").alias("captured_count"), F.count_if(F.col("recommendation") == REJECT).alias("not_recommended_count"),
    )
    if rejected is None:
        return out.withColumn("rejected_count", F.lit(0).cast("long"))
    return out.join(F.broadcast(rejected.agg(F.count("*").alias("rejected_count"))))  # one row each
