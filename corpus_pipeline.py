"""A pipeline that turns documents into packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), docs being all rows that the stage before it kept, and returns a DataFrame;
all but the last return the columns of documents. ``run`` writes each stage's result to the shared folder and reads
it again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import common, crf_langid, mixing, ngram_jaccard, packing, secret_ledger


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go.

    Null and empty texts, and texts without a letter, have none. Repeated rows get one verdict; texts are scored whole;
    where no row has a label nothing can be recognised and all go; an empty table stays empty; further columns stay.
    """
    return crf_langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (shingles of five words, similarity of 0.8) one row stays, of the smallest id.

    Null ids come last; of equal ids the first by the digest of id and text; of equal rows any one. Texts without a word
    are copies of nothing and stay; an empty table stays empty; further columns stay.
    """
    return ngram_jaccard.keep_one(docs, n=5, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked and n_chars follows; every document stays.

    A null text stays null, an empty one empty; equal texts are scanned once and masked alike; overlapping secrets
    become one mask; an empty table stays empty; further columns stay.
    """
    out = secret_ledger.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*(F.col(f"`{c}`") for c in docs.columns))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, or go, as their source's target says.

    A null source is a source of its own, last; texts without words take the place that their id gives them; equal
    rows count each; an empty table stays empty; further columns stay.
    """
    return mixing.repeat(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces, each with its sequence and offset.

    Null and empty texts are an end id alone; repeated rows are packed each; long texts are cut into pieces; an empty
    table gives no piece.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("packing", packing_stage),
]

#: Language scores, near-copy classes of hashed shingles and token ids can't be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    with common.Scratch(spark) as scratch:
        for name, stage in STAGES[:-1]:
            before, docs = docs, scratch.table(stage(spark, docs, sf_dir), f"pipeline-{name}")
            scratch.drop(before)
        return scratch.keep(scratch.table(STAGES[-1][1](spark, docs, sf_dir), "pipeline-result"))
