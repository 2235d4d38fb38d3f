"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata of the text.

A document's features are its words, hashed to 2**15 buckets with weights log(1 + count) scaled to length 1, and its
statistics (of words, lines, characters, length), each as a one-hot bin between quantiles of the sample. The score is
the logistic of w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j; the pair term takes linear time by
half the sum over factors of (sum v_if x_i)**2 - sum (v_if x_i)**2.

It is learned by Adagrad on mini-batches, on the driver, from a sample of at most ``max_rows`` labelled rows drawn by
a digest of the id, evenly over the labels; rows are weighted back, so scores keep the labels' proportion. Model and
sample have fixed bounds whatever the corpus.

Edge cases: null text counts as empty, and gets a score too; without any labelled row every score is 0.5; of several
labels of one id each counts, with the least text of the rows that have the id; repeated rows keep a row each; an empty
table gives an empty result; other columns are ignored; texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .crf_langid import fold

BITS = 15
_KINDS = np.zeros(256, np.int64)  # of bytes: 1 lower, 2 upper, 3 digit, 4 point, 5 symbol, 6 line end, 7 other space
for _i in range(33, 127):
    _KINDS[_i] = 5
for _chars, _kind in (("abcdefghijklmnopqrstuvwxyz", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 3), (".,;:?'\"()-", 4), ("\n", 6), (" \t\r\f\v", 7)):
    _KINDS[[ord(c) for c in _chars]] = _kind
STATS = (
    "words", "word_bytes", "distinct", "lower", "upper", "digits", "points", "symbols", "wide", "lines", "line_words",
    "dup_lines", "top_word", "top_symbol", "pairs", "ends",
)


def features(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, their weights, and the statistics."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    words = common.word_hashes(raw)
    uniq, counts = np.unique(words, return_counts=True)
    n, size = max(len(words), 1), max(len(raw), 1)
    kinds = np.bincount(_KINDS[raw], minlength=8) / size
    lines = [x for x in text.split("\n") if x.strip(common.SPACES)]
    pairs = np.unique(common.window_hashes(words, 2)) if len(words) > 1 else words
    by_byte = np.bincount(raw[_KINDS[raw] == 5], minlength=256)
    ends = sum(x.rstrip(common.SPACES)[-1:] in ".!?:;" for x in lines)
    stats = np.array([
        np.log1p(len(words)), (size - (kinds[6] + kinds[7]) * size) / n, len(uniq) / n, kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[0],
        np.log1p(len(lines)), np.log1p(n / max(len(lines), 1)), 1 - len(set(lines)) / max(len(lines), 1), (counts.max() if len(counts) else 0) / n,
        by_byte.max() / size, len(pairs) / n, ends / max(len(lines), 1),
    ])
    bucket = (uniq >> np.uint64(64 - BITS)).astype(np.int64)
    total = np.bincount(bucket, counts) if len(bucket) else np.empty(0)
    bucket = np.flatnonzero(total)
    weight = np.log1p(total[bucket])
    return bucket, weight / max(float(np.sqrt((weight**2).sum())), 1e-9), stats


@dataclass
class Machine:
    edges: np.ndarray  # of the statistics' bins, by statistic
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def row(self, bucket: np.ndarray, weight: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bins = (stats[:, None] > self.edges).sum(1)
        at = (1 << BITS) + np.arange(len(stats)) * (self.edges.shape[1] + 1) + bins
        return np.concatenate([bucket, at]), np.concatenate([weight, np.full(len(at), len(at) ** -0.5)])

    def raw(self, index: np.ndarray, x: np.ndarray) -> float:
        vx = self.factors[index] * x[:, None]
        return float(self.bias + self.weights[index] @ x + 0.5 * ((vx.sum(0) ** 2).sum() - (vx**2).sum()))

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(*self.row(*features(text))), -30, 30))))


def train(rows: list[tuple[float, float, tuple]], *, rank: int = 8, bins: int = 12, epochs: int = 12, rate: float = 0.15, decay: float = 1e-4, batch: int = 64, seed: int = 11) -> Machine | None:
    """Of (label, weight, features): the machine, None without rows."""
    if not rows:
        return None
    rng = np.random.default_rng(seed)
    stats = np.stack([f[2] for _, _, f in rows])
    edges = np.quantile(stats, np.arange(1, bins) / bins, axis=0).T
    size = (1 << BITS) + stats.shape[1] * bins
    m = Machine(edges, 0.0, np.zeros(size), rng.normal(0, 0.02, (size, rank)))
    packed = [m.row(*f) for _, _, f in rows]
    label, sure = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    sure = sure / sure.mean()
    sum_b, sum_w, sum_v = 1e-6, np.full(size, 1e-6), np.full((size, rank), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), batch):
            part = order[start : start + batch]
            lengths = [len(packed[i][0]) for i in part]
            index, x = (np.concatenate([packed[i][k] for i in part]) for k in (0, 1))
            begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            owner = np.repeat(np.arange(len(part)), lengths)
            vx = m.factors[index] * x[:, None]
            sums = np.add.reduceat(vx, begins)
            out = m.bias + np.add.reduceat(m.weights[index] * x, begins) + 0.5 * ((sums**2).sum(1) - np.add.reduceat((vx**2).sum(1), begins))
            off = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - label[part]) * sure[part] / len(part)
            grad_w = off[owner] * x
            grad_v = grad_w[:, None] * (sums[owner] - vx)
            uniq, at = np.unique(index, return_inverse=True)
            gw = np.bincount(at, grad_w) + decay / len(part) * m.weights[uniq]
            gv = np.stack([np.bincount(at, grad_v[:, k]) for k in range(rank)], 1) + decay / len(part) * m.factors[uniq]
            sum_w[uniq] += gw**2
            sum_v[uniq] += gv**2
            m.weights[uniq] -= rate * gw / np.sqrt(sum_w[uniq])
            m.factors[uniq] -= 0.3 * rate * gv / np.sqrt(sum_v[uniq])
            sum_b += (gb := off.sum()) ** 2
            m.bias -= rate * gb / np.sqrt(sum_b)
    return m


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", max_rows: int = 4000, seed: str = "quality-1") -> Machine | None:
    """Of docs (doc_id, text) and labels (doc_id and the label, 0 or 1): a machine learned from a bounded sample."""
    place = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))), 1, 13), 16, 10).cast("double") / float(16**13)
    labels = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1)).withColumn("place", place)
    sizes = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    if not sizes:
        return None
    shares = {k: min(1.0, max_rows / len(sizes) / n) for k, n in sizes.items()}
    share = F.lit(0.0)
    for k, s in shares.items():
        share = F.when(F.col("label") == k, s).otherwise(share)
    drawn = labels.where(F.col("place") < share).orderBy("place").limit(2 * max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t or "") for t in b.column(2).to_pylist()]
            columns = [pa.array([f[i] for f in found], pa.list_(kind)) for i, kind in enumerate((pa.int32(), pa.float32(), pa.float64()))]
            yield pa.record_batch([b.column(0), b.column(1), *columns], names=["label", "place", "bucket", "weight", "stats"])

    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # 2 * max_rows at most, and so are the texts
    rows = rows.groupBy("doc_id", "label", "place").agg(F.min("text").alias("text")).select("label", "place", "text")
    rows = rows.mapInArrow(run, "label int, place double, bucket array<int>, weight array<float>, stats array<double>").toArrow()
    order = np.argsort(rows["place"].to_numpy(), kind="stable")
    out = []
    for i in order.tolist():
        label = rows["label"][i].as_py()
        bucket, weight, stats = (np.asarray(rows[c][i].values) for c in ("bucket", "weight", "stats"))
        out.append((float(label), 1 / shares[label], (bucket.astype(np.int64), weight.astype(np.float64), stats)))
    return train(out)


def predict(docs: DataFrame, machine: Machine | None, *keep: str, text_col: str = "text", cut: float = 0.7) -> DataFrame:
    """The columns ``keep`` of every row, with score and predicted."""
    narrow = docs.select(*keep, F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = np.array([machine.score(t.as_py() or "") if machine else 0.5 for t in b.column(len(keep))])
            yield pa.record_batch([*b.columns[: len(keep)], pa.array(scores, pa.float64()), pa.array((scores >= cut).astype(np.int32))], names=[*keep, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(run, f"{schema}, score double, predicted int")


def op7_fm_quality(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = fit(docs, labels.where(fold(F.col("doc_id"), 4) != 2))
    return predict(docs, machine, "doc_id").select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
