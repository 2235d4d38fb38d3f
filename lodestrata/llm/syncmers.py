"""Document fingerprints of closed syncmers.

A k-mer of a text's code points is a closed syncmer where the least of its inner s-mers, by hash, is its first or its
last. Whether a k-mer is chosen depends on itself alone, so an edit moves no anchor that it does not touch, unlike
minimizers. A fingerprint lists all anchors (hash and first place) of the whole text, so its length grows with the
text's. A caller that needs short ones gives ``most``: then only anchors are listed whose hash has z trailing zero bits,
z being the least for which at most ``most`` remain; the rule depends on hashes alone, so two fingerprints compare at the
larger z of both.

Likeness is the share of both texts' anchors at the common z that have a partner of the same hash in the other text, in
the same order: the longest run of partners whose places rise in both. So text put in or taken out costs only the
anchors that it touches, wherever it stands.

``compare_next`` needs each document's successor in descending order of ids without sorting the table into one task.
Cut points from approximate quantiles deal rows to parts by id, a few for each shuffle partition, and the rows of an id
that very many share, or of none, to several parts by their texts' digests; the first row of each part is sent to the
part before it as well, so every document finds its successor in its own part, and the order wraps around.

Edge cases: null text counts as empty; texts without an anchor (shorter than k, say) have the hash of the whole text
as their one anchor; equal texts have equal fingerprints; a null id comes last; rows with the same id follow each
other by text (by a digest of it if very many share one); one row is its own successor; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

K, S = 19, 8  # S a power of two
#: Characters of fingerprints that a task holds before it sends them on.
SENT = 8_000_000

def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def closed_syncmers(points: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the chosen k-mers."""
    n = len(points)
    if n < k:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        base = np.uint64(0x9E3779B97F4A7C15)
        h, width = points.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1), 1
        power = base
        while width < s:  # hashes of windows twice as wide
            h = h[: len(h) - width] * power + h[width:]
            power, width = power * power, width * 2
        inner = common.mix64(h)  # of every s-mer
    w = k - s + 1
    least, width = inner, 1
    while width * 2 <= w:
        least, width = np.minimum(least[: len(least) - width], least[width:]), width * 2
    if width < w:
        least = np.minimum(least[: len(least) - (w - width)], least[w - width :])
    count = n - k + 1
    at = np.flatnonzero((inner[:count] == least[:count]) | (inner[w - 1 : w - 1 + count] == least[:count]))
    with np.errstate(over="ignore"):
        return at, common.mix64(inner[at] * np.uint64(3) + inner[at + w - 1])


def _zeros(hashes: np.ndarray) -> np.ndarray:
    low = hashes & (~hashes + np.uint64(1))
    return np.where(hashes == 0, 64, np.log2(np.maximum(low, 1).astype(np.float64))).astype(np.int64)


class Fingerprint:
    """Anchors at a level, with their text's length."""

    __slots__ = ("level", "places", "hashes", "zeros", "size")

    def __init__(self, text: str, most: int | None = None):
        points = _points(text)
        self.size = len(points)
        at, hashes = closed_syncmers(points)
        if not len(at):
            whole = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()
            at, hashes = np.zeros(1, np.int64), np.frombuffer(whole, np.uint64)
        hashes, first = np.unique(hashes, return_index=True)
        at, zeros = at[first], _zeros(hashes)
        counts = np.bincount(zeros, minlength=66)[::-1].cumsum()[::-1]
        level = 0 if most is None else min(int(np.argmax(counts <= most)), int(zeros.max()))
        keep = zeros >= level
        order = np.argsort(at[keep], kind="stable")
        self.level, self.places, self.hashes, self.zeros = level, at[keep][order], hashes[keep][order], zeros[keep][order]

    def __str__(self) -> str:
        return f"{self.size}.{self.level}:" + ",".join(f"{h:016x}@{p}" for p, h in zip(self.places.tolist(), self.hashes.tolist()))

    def likeness(self, other: Fingerprint) -> float:
        """Share of anchors with a partner of the same hash in the same order, in 0..1."""
        level = max(self.level, other.level)
        sides = []
        for x in (self, other):
            keep = x.zeros >= level
            sides.append((x.hashes[keep], x.places[keep]))
        (ha, pa_), (hb, pb) = sides
        if not len(ha) or not len(hb):
            return 0.0
        _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
        return 2 * longest_rise(pb[ib[np.argsort(pa_[ia], kind="stable")]]) / (len(ha) + len(hb))


def longest_rise(x: np.ndarray) -> int:
    """Length of the longest strictly rising subsequence."""
    if (x[1:] > x[:-1]).all():
        return len(x)
    ends: list[int] = []  # the least end of a rise of each length
    for v in x.tolist():
        if not ends or v > ends[-1]:
            ends.append(v)
        else:
            ends[bisect_left(ends, v)] = v
    return len(ends)


def edited(text: str, other: str) -> str:
    """The last half of the text replaced by as many of the first code points of the other, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


#: A part's number is that of its cut point and, behind it, of its share of a hot id's rows.
SHARE_BITS = 20


def _deal(cuts: Counter, nulls: int, before: dict[tuple[int | None, int], int]):
    """A column function of (id or 0, whether it is null, digest): a row's part and, if it heads a part, the part before.

    Parts lie between cut points, in descending order. A cut point that several quantiles share is a hot id: its rows
    are dealt over so many parts by ranges of their digests, and ids below it go to a part of their own; so are null ids.
    """
    table = np.array(sorted(cuts, reverse=True), np.int64)
    shares = np.array([0, *(cuts[c] if cuts[c] > 1 else 0 for c in table.tolist()), nulls], np.int64)

    @F.pandas_udf("part long, guest long")
    def deal(ids, none, digests):
        import pandas as pd

        i, d, null = ids.to_numpy().astype(np.int64), digests.to_numpy().astype(np.int64), none.to_numpy().astype(bool)
        base = np.where(null, len(table) + 1, len(table) - np.searchsorted(table[::-1], i, "left"))
        share = shares[base]
        head = null | ((base > 0) & (base <= len(table)) & (np.append(table, [0, 0])[np.maximum(base, 1) - 1] == i))
        part = (base << SHARE_BITS) + np.where(head, ((d >> 31) * share) >> 31, share)
        guest = [before.get((None if n else x, y), -1) for x, y, n in zip(i.tolist(), d.tolist(), null.tolist())]
        return pd.DataFrame({"part": part, "guest": np.array(guest, np.int64)})

    return deal


def _with_successors(docs: DataFrame) -> DataFrame:
    """Rows of (doc_id, text, part, guest), dealt and sorted so that each row's successor in its part follows it."""
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = 4 * width  # as many as the cluster works on, whatever the rows
    steps = [i / parts for i in range(1, parts)]
    found = docs.agg(F.percentile_approx("doc_id", steps, 10 * parts).alias("q"), F.count("*").alias("n"), F.count("doc_id").alias("known")).first()
    cuts = Counter(found["q"] or [])
    nulls = -(-(found["n"] - found["known"]) * parts // max(found["n"], 1))
    hot = nulls > 1 or max(cuts.values(), default=0) > 1
    # digests part the rows of hot ids only; without one no text is read for them
    digest = F.shiftrightunsigned(F.xxhash64("text"), 2) if hot else F.lit(0).cast("long")
    own = docs.withColumn("digest", digest)
    place = lambda before: _deal(cuts, nulls, before)(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.col("digest"))
    first = F.min_by(F.struct("doc_id", "digest"), F.struct(F.col("doc_id").isNull(), F.bitwise_not("doc_id"), "digest"))
    heads = own.groupBy(place({})["part"].alias("part")).agg(first.alias("head")).orderBy("part").collect()  # a row a part
    before = {tuple(r["head"]): heads[i - 1]["part"] for i, r in enumerate(heads)}
    dealt = own.withColumn("to", place(before))
    here = F.struct(F.col("to.part").alias("part"), F.lit(False).alias("guest"))
    as_guest = F.struct(F.col("to.guest").alias("part"), F.lit(True).alias("guest"))
    dealt = dealt.select("doc_id", "text", "digest", F.explode(F.when(F.col("to.guest") >= 0, F.array(here, as_guest)).otherwise(F.array(here))).alias("at"))
    dealt = dealt.select("doc_id", "text", F.col("at.part").alias("part"), F.col("at.guest").alias("guest"), "digest")
    return dealt.repartition(width, "part").sortWithinPartitions("part", "guest", F.desc_nulls_last("doc_id"), "digest", "text").drop("digest")


def compare_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most: int | None = None) -> DataFrame:
    """Per row: doc_id (a long), n_chars, the text edited with its successor, both fingerprints, and likenesses."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # part, id, text and fingerprint of the row that waits for its successor
        out, held = [], 0
        for b in batches:
            for i, text, part, guest in zip(*(c.to_pylist() for c in b.columns)):
                if last is not None and last[0] != part:
                    last = None
                if guest and last is None:
                    continue
                mark = Fingerprint(text, most)
                if last is not None:
                    _, before_id, before_text, before_mark = last
                    new = edited(before_text, text)
                    new_mark = before_mark if new == before_text else Fingerprint(new, most)
                    digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((before_id, len(before_text), digest, str(before_mark), str(new_mark), before_mark.likeness(new_mark), before_mark.likeness(mark)))
                    held += len(out[-1][3]) + len(out[-1][4])
                    if held > SENT:
                        yield send(out)
                        out, held = [], 0
                last = None if guest else (part, i, text, mark)
        yield send(out)

    def send(out: list[tuple]) -> pa.RecordBatch:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _with_successors(narrow).mapInArrow(run, schema)


def op4_syncmers(spark, sf_dir: str) -> DataFrame:
    return compare_next(common.documents(spark, sf_dir))
