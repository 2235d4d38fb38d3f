"""Mixing sources to target weights by capped water-filling.

``plan_targets`` shares a number of words over the sources by weight, clamps each source at a maximum of epochs and
gives what is above to the others, by weight, until none is above. That fixed point is a water level: sources sorted
by cap per weight are clamped up to some place in that order, so running sums over the (small) table of sources find
it without iterating. All its comparisons are on integers.

``mix`` turns targets into repetitions: whole epochs for every document of a source, and for the fraction that is
left the documents that come first in a seeded order. The order's running sum takes two levels, sums by the first
four hex digits of a document's digest and then the rows of the one digit group in which the budget ends, so no task
ever orders a whole source.

Edge cases: null text has size 0; a null source is a source of its own, last; a source without words has target 0;
an empty table gives an empty result; rows with the same id are all mixed; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: More sources than this are joined by shuffle, not broadcast.
MAX_BROADCAST_SOURCES = 100_000
#: Hex digits of a document's digest that name its group within the source.
DIGITS = 4


def plan_targets(
    sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), cap: int = 2
) -> DataFrame:
    """Of (source, source_size): adds target, whole (epochs that each document gets) and budget (words beyond them).

    Weights repeat over sources by code point, null last. ``share`` is the mix's size as a fraction of all sizes.
    """
    num, den = share
    big = "decimal(38,0)"
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))
    df = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")).cast("long"))
    df = df.withColumn("cap", F.col("source_size") * cap).withColumn("all_words", F.sum("source_size").over(everything))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("clamped", (den * F.col("cap").cast(big) * after.cast(big)) <= F.col("weight").cast(big) * (num * F.col("all_words") - den * before).cast(big))
    left = num * F.col("all_words") - den * F.coalesce(F.sum(F.when(F.col("clamped"), F.col("cap"))).over(everything), F.lit(0))
    open_weight = F.sum(F.when(~F.col("clamped"), F.col("weight"))).over(everything)
    df = df.withColumn("target", F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(F.col("weight").cast("double") * left.cast("double") / (den * open_weight).cast("double")))
    whole = F.when(F.col("clamped"), F.lit(cap)).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("long")
    df = df.withColumn("whole", whole)
    return df.select("source", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"))


def seeded_order(key: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: tuple[int, int] = (3, 2),
    cap: int = 2,
    seed: str = "mix-1",
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, with mix_size, mix_source_size, mix_target and mix_copies, the times the mix takes it.

    A kept column of such a name stays as it is, and the mix's own gets a longer one.
    """
    kept = [f"kept_{i}" for i in range(len(keep))]  # own names, as any name may come in
    keyed = docs.select(
        *(F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept)),
        F.col(source_col).alias("m_source"),
        common.word_count(F.col(text_col)).alias("m_size"),
        seeded_order(F.col(id_col), seed).alias("m_place"),
    ).withColumn("m_digits", F.substring("m_place", 1, DIGITS))
    with common.Scratch(docs.sparkSession) as scratch:
        narrow = scratch.table(keyed if text_col not in keep else keyed.select("m_source", "m_size", "m_digits"), "mix-sizes")
        groups = narrow.groupBy(F.col("m_source").alias("source"), F.col("m_digits").alias("digits")).agg(F.sum("m_size").alias("words"))
        groups = scratch.table(groups, "mix-groups")  # at most 16**DIGITS rows a source
        plan = plan_targets(groups.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
        plan = scratch.table(plan, "mix-plan")
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("digits").rowsBetween(Window.unboundedPreceding, 0))
        cuts = (
            groups.withColumn("upto", upto)
            .join(plan.select(F.col("source").alias("p_source"), "budget"), F.col("source").eqNullSafe(F.col("p_source")))
            .where((F.col("upto") >= F.col("budget")) & (F.col("upto") - F.col("words") < F.col("budget")))
            .groupBy("source")
            .agg(F.min_by(F.struct("digits", (F.col("upto") - F.col("words")).alias("base")), "digits").alias("cut"))
            .select(F.col("source").alias("c_source"), "cut")
        )
        plan = plan.join(cuts, F.col("source").eqNullSafe(F.col("c_source")), "left").select(
            F.col("source").alias("p_source"), "source_size", "target", "whole", "budget", F.col("cut.digits").alias("cut"), "cut.base"
        )
        plan = scratch.keep(scratch.table(plan, "mix-cuts"))
        if text_col not in keep:
            keyed = scratch.keep(narrow)
    if plan.count() <= MAX_BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    rows = keyed.join(plan, F.col("m_source").eqNullSafe(F.col("p_source")))
    at_cut = F.coalesce(F.col("m_digits") == F.col("cut"), F.lit(False))
    clear = rows.where(~at_cut).withColumn("extra", F.coalesce(F.col("m_digits") < F.col("cut"), F.lit(False)).cast("long"))
    order = Window.partitionBy("m_source").orderBy("m_place", "m_size").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.col("base") + F.coalesce(F.sum("m_size").over(order), F.lit(0))
    split = rows.where(at_cut).withColumn("extra", (2 * upto + F.col("m_size") <= 2 * F.col("budget")).cast("long"))
    copies = (F.col("whole") + F.col("extra")).cast("int")
    out = clear.unionByName(split).select(*kept, "m_size", "source_size", "target", copies)
    return out.toDF(*keep, *common.free(keep, "mix_size", "mix_source_size", "mix_target", "mix_copies"))


def repeat(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the mix takes it. Columns stay, of any names.

    Null and empty texts have no words: they come as often as their source's whole epochs say, and once more where
    they stand before the cut. Equal rows each count; of rows equal in id and size some may be taken once more than
    others. An empty table stays empty. Words are counted once, for the plan, and again only at the cuts.
    """
    taken = mix(docs, keep=tuple(docs.columns), **options)
    copies = taken.columns[-1]
    (nth,) = common.free(taken.columns, "mix_nth")
    taken = taken.where(F.col(copies) > 0).withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return taken.select(*(F.col(f"`{c}`") for c in docs.columns))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix(common.documents(spark, sf_dir))
    taken = F.col("mix_size") * F.col("mix_copies")
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), taken.alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS place
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS weight,
             source_size * 2 AS cap, sum(source_size) OVER () AS all_words FROM s),
f AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after
      FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source IS NULL, source)),
c AS (SELECT *, 2 * cap * after <= weight * (3 * all_words - 2 * before) AS clamped FROM f),
l AS (SELECT *, 3 * all_words - 2 * coalesce(sum(CASE WHEN clamped THEN cap END) OVER (), 0) AS remains,
             sum(CASE WHEN NOT clamped THEN weight END) OVER () AS open_weight FROM c),
t AS (SELECT source, source_size, clamped, CASE WHEN clamped THEN CAST(cap AS DOUBLE)
        ELSE CAST(weight AS DOUBLE) * CAST(remains AS DOUBLE) / CAST(2 * open_weight AS DOUBLE) END AS target FROM l),
p AS (SELECT *, CASE WHEN clamped THEN 2 ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole FROM t),
r AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto
      FROM sized d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN 2 * upto + size <= 2 * budget THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
