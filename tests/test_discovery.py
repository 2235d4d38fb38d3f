"""Seen keys with sketches against a plain anti join, and rounds against a breadth-first search."""

import random

from pyspark.sql import functions as F

from lodestrata.operators.merge import new_rows
from lodestrata.operators.seen import SeenKeys
from lodestrata.sources import discovery


def test_new_rows_equal_the_anti_join(spark, tmp_path):
    """Over runs with repeated, null and hot keys; with few bits most sketches err, and the rows stay the same."""
    for bits in (1 << 14, 64):
        seen, rng = SeenKeys(spark, f"file://{tmp_path}/{bits}", buckets=5, bits=bits), random.Random(4)
        before = spark.createDataFrame([], "k string")
        for run in range(3):
            rows = spark.createDataFrame([(rng.choice([None, "hot", "hot", f"k{rng.randrange(400)}"]), i) for i in range(300)], "k string, v int").repartition(3)
            fresh, counts = seen.split(rows, "k")
            want = new_rows(rows, before.where("k is not null"), "k")
            assert sorted(map(str, fresh.collect())) == sorted(map(str, want.collect()))
            n = counts.first()
            assert n["seen"] <= n["maybe"] <= n["asked"] and (run or n["maybe"] == 0)
            if bits > 64 and run:
                assert n["maybe"] - n["seen"] <= 5 and n["asked"] - n["maybe"] > 10  # settled without the keys
            seen.new_rows(rows, "k")
            before = before.union(rows.select("k")).distinct()
        assert sorted(r["key"] for r in seen.keys().collect()) == sorted(r["k"] for r in before.collect() if r["k"])
        assert (seen.error_rate() < 0.01) == (bits > 64)
    again = SeenKeys(spark, f"file://{tmp_path}/64", buckets=99, bits=8)  # the table's own shape counts
    assert again.buckets == 5 and again.new_rows(spark.createDataFrame([("hot",), ("never",)], "k string"), "k").first()["k"] == "never"
    larger = again.rebuild(f"file://{tmp_path}/larger", buckets=7, bits=1 << 14)
    assert larger.error_rate() < 0.01 and larger.keys().count() == again.keys().count()
    empty = spark.createDataFrame([], "k string")
    assert again.new_rows(empty, "k").count() == 0


def test_only_buckets_that_may_hold_a_key_are_read(spark, tmp_path):
    seen = SeenKeys(spark, f"file://{tmp_path}/s", buckets=8)
    seen.new_rows(spark.range(2000).select(F.col("id").cast("string").alias("k")), "k")
    read = seen.keys_in(seen.maybe(spark.createDataFrame([("7",), ("new",)], "key string")))
    assert {r["bucket"] for r in read.select("bucket").distinct().collect()} == {r["bucket"] for r in seen.keys().where("key = '7'").collect()}
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan


def test_rounds_are_a_breadth_first_search(spark, tmp_path):
    rng = random.Random(9)
    pairs = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(450)] + [("n0", "n1"), ("n1", "n0"), ("n1", None)]
    edges = spark.createDataFrame(pairs, "a string, b string")
    depth, frontier, n = {"n0": 0, "n5": 0}, {"n0", "n5"}, 0
    while frontier:
        n += 1
        frontier = {b for a, b in pairs if a in frontier and b and b not in depth and b != "n7"}
        depth |= {b: n for b in frontier}

    def search(delta, n):
        return delta.join(edges, delta["url"] == edges["a"]).select(F.col("b").alias("url"), F.lit(n).alias("by"))

    start = spark.createDataFrame([("n0", 0), ("n5", 0), ("n5", 0), (None, 0)], "url string, by int")
    known = spark.createDataFrame([("n7", 0)], "url string, by int")
    got, taken = discovery.rounds(start, search, f"file://{tmp_path}/a", key="url", max_rounds=40, known=known)
    assert {r["url"]: r["round"] for r in got.collect()} == depth and got.count() == len(depth) and taken == n
    # a limit of rounds, and going on after it
    some, taken = discovery.rounds(start, search, f"file://{tmp_path}/b", key="url", max_rounds=2, known=known)
    assert {r["url"]: r["round"] for r in some.collect()} == {k: v for k, v in depth.items() if v <= 2} and taken == 2
    rest, _ = discovery.rounds(start, search, f"file://{tmp_path}/b", key="url", max_rounds=40)
    assert {r["url"]: r["round"] for r in rest.collect()} == depth
    none, taken = discovery.rounds(start.limit(0), search, f"file://{tmp_path}/c", key="url")
    assert none.count() == 0 and taken == 0


def test_a_round_searches_once(spark, tmp_path):
    """The search of a round, its dearest step, runs over its rows once."""
    asked = spark.sparkContext.accumulator(0)

    def ask(batches):
        for batch in batches:
            asked.add(batch.num_rows)
            yield batch

    start = spark.createDataFrame([("a",)], "url string")
    got, _ = discovery.rounds(start, lambda delta, n: delta.mapInArrow(ask, "url string").select(F.concat("url", F.lit("a")).alias("url")), f"file://{tmp_path}/once", key="url", max_rounds=3)
    assert got.count() == 4 and asked.value == 3
