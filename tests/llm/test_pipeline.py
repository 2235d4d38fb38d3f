"""The stages on the smallest tables, and each at the edges that its docstring names."""

import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from lodestrata.llm import common


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "secret_scans", "source_mixing", "packing"]
    seen = docs
    counts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.common.materialize(stage(spark, seen, sf), name)
        assert out.columns == docs.columns
        counts[name] = out.count()
        seen = out
    assert counts["language_id"] >= 0.95 * docs.count() and counts["secret_scans"] == counts["near_duplicates"] < docs.count()
    assert seen.where(F.col("text").rlike("AKIA[A-Z0-9]{14}|[0-9a-f]{16}")).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, seen, sf)
    assert packed.select("doc_id", "piece").where("piece = 0").count() == counts["source_mixing"]
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


CLASH = "score string, lang_pred string, mix_copies int, mix_size long, blob string, spans string, near_key string, secret_blob string, hot_key int"


def table(spark, rows):
    """The columns of documents and others whose names the operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + CLASH
    more = ("s", "p", 5, 6, "b", "x", "k", "sb", 1)
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), *more) for i, t, lang, src in rows], schema)


def test_stages_bear_nulls_ties_repeats_and_clashing_names(spark, sf):
    rng = random.Random(4)
    prose = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en' AND n_chars > 400").orderBy("doc_id").limit(8).collect()]
    secret = " password=abcdefgh12345678 "
    rows = [(i, t, "en", ["a", "b", None][i % 3]) for i, t in enumerate(prose)]
    rows += [(20, None, "en", "a"), (21, "", None, None), (22, " \n", "en", "b"), (23, "1234 5678", "en", "a")]
    rows += [(30, prose[0], "en", "a"), (30, prose[0], "en", "a"), (None, prose[1], None, "b"), (31, prose[2] + secret, "en", "a"), (32, " ".join(rng.sample(prose[3].split(), 40) * 500), "en", "b")]
    docs = table(spark, rows)
    stages = dict(corpus_pipeline.STAGES)
    known = common.materialize(stages["language_id"](spark, docs, sf), "t")
    assert known.columns == docs.columns and {r["doc_id"] for r in known.collect()} == {*range(8), 30, None, 31, 32}
    once = common.materialize(stages["near_duplicates"](spark, docs, sf), "t")
    assert once.columns == docs.columns
    kept = Counter(r["doc_id"] for r in once.collect())
    assert kept == Counter([*range(8), 20, 21, 22, 23, 32])  # of copies the least id; what has no words stays
    masked = {(r["doc_id"], r["text"]): r["n_chars"] for r in stages["secret_scans"](spark, docs, sf).collect()}
    assert sum(secret.strip() in (t or "") for _, t in masked) == 0 and all(n == (len(t) if t is not None else None) for (_, t), n in masked.items())
    assert (31, prose[2] + " [secret] ") in masked and (20, None) in masked
    mixed = stages["source_mixing"](spark, docs, sf)
    assert mixed.columns == docs.columns and 0 < mixed.count() <= 2 * len(rows)
    pieces = stages["packing"](spark, docs, sf)
    assert {(r["doc_id"], r["length"]) for r in pieces.where("doc_id IN (20, 21)").collect()} == {(20, 1), (21, 1)}
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_stages_bear_empty_tables(spark, sf):
    docs = table(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0, name
