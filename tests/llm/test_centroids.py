"""Clustering against a plain version on every row, and against SQL."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from lodestrata.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, q string, n long, cluster string"


def brute(rows, k, rounds, size, scale=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-centroids.LIMIT, min(centroids.LIMIT, math.floor(scale * x))) for x in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest()))
    means = [v for _, v in order[:k]]

    def place(v):
        apart = [sum((a - b) ** 2 for a, b in zip(v, m)) for m in means]
        return apart.index(min(apart)), min(apart)

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(place(v)[0], []).append(v)
        for j, g in groups.items():
            means[j] = [sum(c) // len(g) for c in zip(*g)]
    at = [place(v) for _, v in kept]
    spread = [sum(d for c, d in at if c == j) for j in range(len(means))]
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    return sorted(str((i, c, d, spread[c], sum(spread), digest[c], sum(w == v for _, w in kept))) for (i, v), (c, d) in zip(kept, at))


def f32(x):
    return float(np.float32(x))


@pytest.fixture(scope="module")
def vectors():
    """Nulls, wrong lengths, values that are not finite, a vector of a third of all rows, ties and large values."""
    rng = random.Random(11)
    rows = [(i, [f32(rng.uniform(-1, 1)) for _ in range(4)]) for i in range(120)]
    rows += [(200 + i, [0.25, -0.5, 0.125, 0.0]) for i in range(80)]
    rows += [(300 + i, [f32(rng.choice([-1, 0, 1]) / 64) for _ in range(4)]) for i in range(30)]
    rows += [(400, None), (401, []), (402, [1.0] * 3), (403, [1.0] * 5), (404, [1.0, None, 1.0, 1.0]), (405, [math.nan] * 4), (406, [math.inf, 0.0, 0.0, 0.0])]
    rows += [(500, [300.0, -300.0, 5.0, 0.0]), (501, [1e30, -1e30, 1e6, 0.0]), (502, [f32(2e5), 0.0, 0.0, f32(-3e4)]), (None, [0.5, 0.5, 0.5, 0.5]), (7, rows[7][1])]
    return rows


def tuples(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("k, rounds", [(5, 3), (16, 1), (3, 0)])
def test_clusters(spark, vectors, k, rounds):
    table = spark.createDataFrame([(i, v, "x", 1, "y") for i, v in vectors], SCHEMA).repartition(3)
    assert tuples(centroids.cluster(table, k=k, rounds=rounds, size=4)) == brute(vectors, k, rounds, 4)


def test_few_vectors_and_none(spark, vectors):
    table = spark.createDataFrame([(i, v, "x", 1, "y") for i, v in vectors], SCHEMA)
    few = [r for r in vectors if r[0] in (1, 2, 400, 405)]
    assert tuples(centroids.cluster(table.where("vec_id in (1, 2, 400, 405)"), size=4)) == brute(few, 16, 3, 4)
    empty = centroids.cluster(table.where("vec_id = 400"), size=4)
    assert empty.count() == 0 and empty.columns[:3] == ["vec_id", "cluster", "distance"]
    assert centroids.cluster(table.limit(0), size=4).count() == 0


def test_a_shared_vector_is_dealt(spark, monkeypatch):
    """With a low bound many vectors are hot; each row still gets its assignment once."""
    monkeypatch.setattr(centroids.common, "HOT_SHARE", 1 << 19)
    rows = [(i, [f32((i % 7) / 8), 0.0]) for i in range(200)]
    table = spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], SCHEMA)
    assert tuples(centroids.cluster(table, k=3, size=2)) == brute(rows, 3, 3, 2)


def test_packing_keeps_values_and_width():
    rows = np.array([[0, -128, 127], [0, 0, 128], [-129, 0, 0], [1 << 27, -(1 << 27), 5], [-1, -1, -1]], np.int64)
    packed = centroids._pack(rows)
    assert [len(p) for p in packed] == [3, 6, 6, 12, 3] and (centroids._unpack(packed, 3) == rows).all()


def test_distances_agree_in_both_ways():
    rng = np.random.default_rng(2)
    x, c = rng.integers(-1000, 1000, (200, 8)), rng.integers(-1000, 1000, (5, 8))
    far = np.vstack([c, np.full((1, 8), centroids.EXACT * 4)])
    for a, b in zip(centroids.nearest(x, c), centroids.nearest(x, far)):
        assert (a == b).all()


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    got = centroids.op11_centroids(spark, sf)
    want = con.sql(centroids.SQL)
    assert sorted(map(str, want.select(*got.columns).fetchall())) == tuples(got) and len(got.columns) == len(want.columns)
