"""Centroid clustering over distinct vectors with multiplicities.

Vectors are quantised to integers and grouped; Lloyd's rounds run on the distinct ones alone, each weighing as many as
it stands for. A task sums its batches by centroid before anything is shuffled, so a round moves one row for each task
and centroid; sums and floors are exact integers, so neither the order of rows nor the number of tasks shows in the
result. At last every row reads its vector's assignment by a join, in which a vector that very many rows share is dealt
over tasks.

Components: a vector counts if it has the given number of components, none of them null or not finite. Quantised
components end at +/- 2**27, where squared distances still fit a long; so do sums of distances at the largest long.

Edge cases: null, short, long and non-finite vectors are left out; an empty table, or one without a valid vector,
gives an empty result; rows with the same id or vector get a row each, and equal ids start centroids in the order of
their vectors' bytes; a null id comes after all ids when centroids are chosen; with fewer vectors than centroids there are so
many centroids; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LIMIT = 1 << 27
#: Below this size all products and their sums are exact in doubles, and the distances go through a matrix product.
EXACT = 1 << 21
LARGEST = (1 << 63) - 1
#: Rows that are worked on at once in a task.
STEP = 1 << 14
WIDTHS = (np.int8, np.int16, np.int32)
SALTS = 64


def _pack(rows: np.ndarray) -> list[bytes]:
    """A vector as bytes, in the least width that holds it, so that equal vectors and no others have equal bytes."""
    most = np.maximum(rows.max(1), -1 - rows.min(1))
    out: list[bytes] = [b""] * len(rows)
    for low, high, kind in ((0, 1 << 7, WIDTHS[0]), (1 << 7, 1 << 15, WIDTHS[1]), (1 << 15, 1 << 31, WIDTHS[2])):
        at = np.flatnonzero((most >= low) & (most < high))
        narrow = rows[at].astype(kind)
        for i, v in zip(at.tolist(), narrow):
            out[i] = v.tobytes()
    return out


def _unpack(packed: list[bytes], size: int) -> np.ndarray:
    out = np.empty((len(packed), size), np.int64)
    lengths = np.array([len(p) for p in packed])
    for kind in WIDTHS:
        at = np.flatnonzero(lengths == size * np.dtype(kind).itemsize)
        if len(at):
            out[at] = np.frombuffer(b"".join([packed[i] for i in at.tolist()]), kind).reshape(-1, size)
    return out


def quantise(table: DataFrame, *, size: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and, as bytes, the quantised vector ``q`` of every valid row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column(1)
            starts, flat = vectors.offsets.to_numpy(), vectors.values
            whole = np.diff(starts) == size
            if vectors.null_count:
                whole &= vectors.is_valid().to_numpy(zero_copy_only=False)
            values = np.append(flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False), np.zeros(size))
            rows = np.flatnonzero(whole)
            got = values[starts[:-1][rows][:, None] + np.arange(size)]
            finite = np.isfinite(got).all(1)
            rows, got = rows[finite], got[finite]
            q = np.clip(np.floor(got * scale), -LIMIT, LIMIT).astype(np.int64)
            packed = _pack(q) if len(q) else []
            yield pa.record_batch([b.column(0).take(pa.array(rows, pa.int64())), pa.array(packed, pa.binary())], names=["vec_id", "q"])

    narrow = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>"))
    return narrow.mapInArrow(run, "vec_id long, q binary")


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the smaller number in ties, and its squared distance."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        cross = (c * c).sum(1)[None, :] - 2 * (a @ c.T)
        best = cross.argmin(1)
        return best, ((a * a).sum(1) + cross[np.arange(len(x)), best]).astype(np.int64)
    apart = np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)
    best = apart.argmin(1)
    return best, apart[np.arange(len(x)), best]


def _steps(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for at in range(0, batch.num_rows, STEP):
        part = batch.slice(at, STEP)
        yield at, _unpack(part.column(0).to_pylist(), size), part.column(1).to_numpy()


def _sums(distinct: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int], int]]:
    """By centroid: the rows that are nearest to it, the sum of their components, and of their distances."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, spread = [0] * k, np.zeros((k, size), object), [0] * k
        for b in batches:
            for _, x, weight in _steps(b, size):
                best, apart = nearest(x, centroids)
                for j in np.unique(best).tolist():
                    mine = best == j
                    wide = np.abs(x[mine]).max(initial=0) * int(weight[mine].sum()) >= 1 << 62
                    total[j] += (x[mine].astype(object) * weight[mine].astype(object)[:, None]).sum(0) if wide else (x[mine] * weight[mine][:, None]).sum(0).astype(object)
                    count[j] += int(weight[mine].sum())
                    spread[j] += sum(map(int.__mul__, apart[mine].tolist(), weight[mine].tolist()))
        used = [j for j in range(k) if count[j]]
        columns = [pa.array(used, pa.int32()), pa.array([str(count[j]) for j in used]), pa.array([str(spread[j]) for j in used])]
        columns += [pa.array([str(total[j][i]) for j in used]) for i in range(size)]
        yield pa.record_batch(columns, names=names)

    names = ["cluster", "n", "spread", *(f"s{i}" for i in range(size))]
    schema = "cluster int, " + ", ".join(f"{n} string" for n in names[1:])
    partial = distinct.mapInArrow(run, schema)
    found = partial.groupBy("cluster").agg(*(F.sum(F.col(n).cast("decimal(38,0)")).alias(n) for n in names[1:])).collect()
    return {r["cluster"]: (int(r["n"]), [int(r[f"s{i}"]) for i in range(size)], int(r["spread"])) for r in found}


def _first(quantised: DataFrame, k: int, size: int) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in this order."""
    mark = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = quantised.orderBy(mark.asc_nulls_last(), "q").limit(k).collect()
    return _unpack([bytes(r["q"]) for r in rows], size)


def cluster(table: DataFrame, *, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per valid row: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, copies (rows with its vector)."""
    spark = table.sparkSession
    with common.Scratch(spark) as scratch:
        quantised = scratch.table(quantise(table, size=size, scale=scale, id_col=id_col, vector_col=vector_col), "quantised")
        distinct = scratch.table(quantised.groupBy("q").agg(F.count("*").alias("n")), "distinct-vectors")
        centroids = _first(quantised, k, size)
        if len(centroids):
            for _ in range(rounds):
                for j, (n, total, _) in _sums(distinct, centroids).items():
                    centroids[j] = [t // n for t in total]
            spread = {j: s for j, (_, _, s) in _sums(distinct, centroids).items()}
        else:
            centroids, spread = np.zeros((1, size), np.int64), {}
        assigned = scratch.table(_assign(distinct, centroids), "assigned")
        rows = assigned.agg(F.sum("n")).first()[0] or 0
        out = _join_back(quantised, assigned, rows)
        digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
        inertia = {j: min(s, LARGEST) for j, s in spread.items()}
        facts = F.array(*(F.struct(F.lit(inertia.get(j, 0)).cast("long").alias("spread"), F.lit(d).alias("digest")) for j, d in enumerate(digests)))
        own = facts[F.col("cluster")]
        total = F.lit(min(sum(spread.values()), LARGEST)).cast("long")
        out = out.select("vec_id", "cluster", "distance", own["spread"].alias("cluster_inertia"), total.alias("inertia"), own["digest"].alias("centroid_sha256"), F.col("n").alias("copies"))
        return scratch.keep(scratch.table(out, "clusters"))


def _assign(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [nearest(x, centroids) for _, x, _ in _steps(b, size)]
            best, apart = (np.concatenate([np.empty(0, np.int64), *(g[i] for g in got)]).astype(kind) for i, kind in ((0, np.int32), (1, np.int64)))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(best), pa.array(apart)], names=["q", "n", "cluster", "distance"])

    return distinct.mapInArrow(run, "q binary, n long, cluster int, distance long")


def _join_back(quantised: DataFrame, assigned: DataFrame, rows: int) -> DataFrame:
    """Join by vector; those with more than a 2**14th of the rows, of which there are fewer than 2**14, are dealt over tasks."""
    hot = F.broadcast(assigned.where(F.col("n") > max(rows, 1 << 20) // common.HOT_SHARE).select(F.col("q").alias("hot")))
    deal = F.when(F.col("hot").isNotNull(), F.monotonically_increasing_id() % SALTS).otherwise(0)
    each = F.when(F.col("hot").isNotNull(), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    left = quantised.join(hot, F.col("q") == F.col("hot"), "left").withColumn("salt", deal).drop("hot")
    right = assigned.join(hot, F.col("q") == F.col("hot"), "left").withColumn("salt", F.explode(each)).drop("hot")
    return left.join(right, ["q", "salt"])


def op11_centroids(spark, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(k: int = 16, rounds: int = 3, size: int = 64) -> str:
    def nearest_sql(t: int) -> str:
        return f"""d{t} AS MATERIALIZED (SELECT r, k, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c{t} c USING (i) GROUP BY r, k),
            a{t} AS MATERIALIZED (SELECT r, min(k) AS k, min(d) AS d FROM d{t} JOIN (SELECT r, min(d) AS d FROM d{t} GROUP BY r) USING (r, d) GROUP BY r)"""

    def move_sql(t: int) -> str:
        return f"""s{t} AS (SELECT k, i, sum(x)::BIGINT AS s, count(*) AS n FROM v JOIN a{t} USING (r) GROUP BY k, i),
            c{t + 1} AS MATERIALIZED (SELECT c.k, c.i, coalesce((s - (s % n + n) % n) // n, c.x) AS x FROM c{t} c LEFT JOIN s{t} USING (k, i))"""

    body = ",\n".join(p for t in range(rounds) for p in (nearest_sql(t), move_sql(t)))
    return f"""
        WITH e AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
                   WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            v AS MATERIALIZED (SELECT r, vec_id, i, floor(64 * embedding[i]::DOUBLE)::BIGINT AS x FROM e, range(1, {size + 1}) t(i)),
            f AS (SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k FROM e QUALIFY k < {k}),
            c0 AS MATERIALIZED (SELECT k, i, x FROM v JOIN f USING (r)),
            {body},
            {nearest_sql(rounds)},
            h AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k),
            g AS (SELECT list(x ORDER BY i) AS q, r FROM v GROUP BY r)
        SELECT vec_id, k::INT AS "cluster", d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
               (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256, count(*) OVER (PARTITION BY q) AS copies
        FROM a{rounds} JOIN e USING (r) JOIN h USING (k) JOIN g USING (r)"""


SQL = _sql()
