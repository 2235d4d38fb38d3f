"""History as keyed state against merge_history applied batch by batch."""

import random

import pytest
from pyspark.sql import types as T

from lodestrata.operators.merge import merge_history
from lodestrata.schema import INDEXED, fields
from lodestrata.streaming import keyed_history


def make(spark, rows):
    schema = T.StructType([*fields(INDEXED), T.StructField("ord", T.LongType())])
    return spark.createDataFrame([{f.name: r.get(f.name) for f in schema} for r in rows], schema)


def records(rng, n, keys):
    """Unknown and missing values, ties of nothing, arrays, maps, evidence in both forms, ids empty or absent."""
    out = []
    for i in range(n):
        k = rng.randrange(keys)
        entry = {"provider": "p", "query": f"q{i}", "result_rank": i}
        out.append(
            {
                "ord": i, "job_id": rng.choice([f"id{k}", f"id{k}", None, ""]) if k % 3 == 0 else f"id{k}", "job_url": f"url{k}", "company_name": rng.choice([None, "", "unknown", f"c{i}"]),
                "first_seen_at": rng.choice([None, "unknown", f"2024-{i:03d}"]), "last_seen_at": rng.choice([None, f"2025-{i:03d}"]), "seen_count": rng.choice([None, 1, 1, 3]),
                "product_form_tags": rng.choice([None, [], ["a"], ["b", "a", None, ""], [f"t{i % 4}"]]), "field_evidence": rng.choice([None, {}, {"x": f"{i}"}, {"x": None, "y": f"{i}"}]),
                "index_evidence": rng.choice([None, entry]), "index_evidence_all": rng.choice([None, None, [], [entry, entry]]),
            }
        )
    return out


def told(df):
    plain = lambda v: sorted(v.items()) if isinstance(v, dict) else v
    return sorted(str([(n, plain(r[n])) for n in sorted(df.columns)]) for r in df.collect())


@pytest.fixture(scope="module")
def rocks(spark):
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.mark.parametrize("splits", [(40,), (7, 20, 13)])
def test_any_split_equals_the_batch_merge(rocks, tmp_path, splits):
    spark, rng = rocks, random.Random(sum(splits) + len(splits))
    rows, at = records(rng, 40, 9), 0
    history = spark.createDataFrame([], fields(INDEXED))
    landing, out, check = (f"file://{tmp_path}/{x}" for x in ("landing", "out", "check"))
    for n in splits:
        part = make(spark, rows[at : at + n])
        at += n
        history = merge_history(history, part)
        part.coalesce(1).write.mode("append").parquet(landing)
        keyed_history.start(spark, landing, check, keyed_history.write_changes(out)).awaitTermination()
    got = keyed_history.snapshot(spark, check)
    assert told(got) == told(history)
    last = spark.read.parquet(f"{out}/batch={len(splits) - 1}")
    touched = {r["job_id"] or r["job_url"] for r in rows[at - splits[-1] : at]}
    assert last.count() == len(touched)  # what a batch writes is what it touched


def test_replays_change_nothing(rocks, tmp_path):
    """A batch whose sink fails runs again from the state before it."""
    spark, rng = rocks, random.Random(3)
    rows = records(rng, 20, 4)
    landing, out, check = (f"file://{tmp_path}/{x}" for x in ("landing", "out", "check"))
    make(spark, rows[:10]).coalesce(1).write.parquet(landing)
    keyed_history.start(spark, landing, check, keyed_history.write_changes(out)).awaitTermination()
    make(spark, rows[10:]).coalesce(1).write.mode("append").parquet(landing)

    def failing(batch, n):
        keyed_history.write_changes(out)(batch, n)
        raise RuntimeError("the sink fails once")

    with pytest.raises(Exception, match="sink fails"):
        keyed_history.start(spark, landing, check, failing).awaitTermination()
    keyed_history.start(spark, landing, check, keyed_history.write_changes(out)).awaitTermination()
    history = merge_history(merge_history(spark.createDataFrame([], fields(INDEXED)), make(spark, rows[:10])), make(spark, rows[10:]))
    assert told(keyed_history.snapshot(spark, check)) == told(history)


def test_a_row_crosses_to_python_in_few_columns(rocks, tmp_path):
    """As its fields that are not null; entries of nulls alone, null items and escapes stay what they are (F7)."""
    spark = rocks
    nothing = {"provider": None, "query": None}
    rows = [
        {"ord": 1, "job_id": "a", "company_name": 'q"\\\n\u2028职😀', "index_evidence": nothing, "field_evidence": {"x": None, "": "e"}},
        {"ord": 0, "job_id": "a", "company_name": "c", "index_evidence_all": [nothing, {"result_rank": 3}], "product_form_tags": [None, "b", "a", "b"]},
        {"ord": 2, "job_url": "u", "seen_count": 2**40},
    ]
    landing, out, check = (f"file://{tmp_path}/{x}" for x in ("landing", "out", "check"))
    part = make(spark, rows)
    part.coalesce(1).write.parquet(landing)
    plan = keyed_history.merged(spark.readStream.schema(part.schema).parquet(landing))._jdf.queryExecution().analyzed()
    assert plan.children().head().output().size() <= 4
    keyed_history.start(spark, landing, check, keyed_history.write_changes(out)).awaitTermination()
    assert told(keyed_history.snapshot(spark, check)) == told(merge_history(spark.createDataFrame([], fields(INDEXED)), part))
