"""Best-fit packing after Martello-Toth dominance reduction.

Documents become token ids; one longer than a sequence is cut, its short piece first. Only the lengths of pieces
matter for packing and there are at most ``capacity`` different ones, so the whole instance is a histogram, whatever
the number of documents. On it, ``plan_bins`` works with counts: it fixes for good the sets that dominate every other
set with their largest piece, which shrinks the instance, and gives the rest to best-fit decreasing. The result is a
list of bin patterns with multiplicities; a piece finds its bin by its length and its rank among pieces of this
length, and the ranks come from a window over groups, as many as the length's pieces need, and running sums of their
sizes.

Edge cases: null text counts as empty and packs as its end id alone; rows with the same id or text are packed each;
an empty table gives an empty result; very long texts are tokenized in parts; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

PIECE_SCHEMA = "doc_id {}, piece int, start long, length int, ids_crc32 long"
#: Ranks are taken within groups of a length of about so many pieces.
GROUP_ROWS = 1 << 16
#: A worker's memory of pre-tokens is emptied at this size: it stays with the worker, beside what later stages need.
MEMORY = 250_000

# --- token ids ---------------------------------------------------------------------------------

#: Texts of these characters only split alike under Python's re and the byte-level pre-tokenizer.
_PLAIN = re.compile("[\t\n\r -~¡-±´-¸º»¿-ɏ–—‘’“”…€]*")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_LONG = 1 << 20


def _byte_chars() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be seen, else the next from 256."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_CHARS = _byte_chars()


class _Encoder(dict):
    """Maps pre-tokens to their ids' bytes. Merges never cross a pre-token, so each is encoded once."""

    def __init__(self, blob: bytes):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(blob.decode())
        self.model.no_truncation()
        self.model.no_padding()
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        pre = self.model.pre_tokenizer
        state = pre.__getstate__() if pre else b""
        state = state.decode() if isinstance(state, bytes) else str(state)
        self.by_word = self.model.normalizer is None and '"ByteLevel"' in state and '"add_prefix_space":false' in state and '"use_regex":true' in state

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMORY:
            self.clear()
        tokens = self.model.model.tokenize(word.encode().decode("latin-1").translate(_BYTE_CHARS))
        ids = self[word] = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        return ids

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not self.by_word or any(s in text for s in self.special) or _PLAIN.fullmatch(text) is None:
            return self.whole(text)
        if len(text) < _LONG:
            return b"".join(map(self.__getitem__, _SPLIT.findall(text)))
        words, parts = (m[0] for m in _SPLIT.finditer(text)), []
        while part := b"".join(map(self.__getitem__, itertools.islice(words, 1 << 18))):
            parts.append(part)
        return b"".join(parts)


@lru_cache(maxsize=1)
def _encoder(blob: bytes) -> _Encoder:
    return _Encoder(blob)


def pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of each row: doc_id, piece, start, length, ids_crc32."""
    with open(tokenizer_path, "rb") as f:
        blob = f.read()
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(blob)
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column(1)):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                at, size = 0, (n - 1) % capacity + 1
                for k in range(-(-n // capacity)):
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    at, size = at + size, capacity
            columns = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())]
            yield pa.record_batch(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col))
    return narrow.mapInArrow(cut, PIECE_SCHEMA.format(narrow.schema[0].dataType.simpleString()))


# --- the plan, on the histogram of lengths ------------------------------------------------------


def reduce_bins(counts: dict[int, int], capacity: int) -> tuple[Counter, dict[int, int]]:
    """Bins that some best packing has, as patterns with multiplicities, and the counts that remain.

    For each length from the longest down, with w the space beside such a piece. A set beside it can be swapped for one piece that fits
    at least as tightly without making any other bin worse (Martello and Toth's dominance), so a bin is fixed where
    - nothing else fits into w: the piece stays alone;
    - a piece of exactly w exists: it dominates every set of total w or less;
    - no two pieces fit into w together: the longest that fits dominates every other choice.
    """
    left = {n: c for n, c in counts.items() if c}
    fixed: Counter = Counter()

    def take(pattern: tuple[int, ...], times: int) -> None:
        fixed[pattern] += times
        for n in pattern:
            left[n] -= times
            if not left[n]:
                del left[n]

    for n in sorted(left, reverse=True):
        while n in left:
            w = capacity - n
            others = left | {n: left[n] - 1}  # what may lie beside one piece of n
            two = list(itertools.islice((m for m in sorted(others) for _ in range(min(2, others[m]))), 2))
            if not two or two[0] > w:
                take((n,), left[n])
            elif others.get(w):
                take((n, w), left[n] // 2 if w == n else min(left[n], left[w]))
            elif len(two) == 1 or sum(two) > w:
                k = max(m for m in others if m <= w and others[m])
                take((n, k), left[n] // 2 if k == n else min(left[n], left[k]))
            else:
                break
    return fixed, {n: c for n, c in left.items() if c}


def best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Best-fit decreasing on counts: the longest pieces first, each into the fullest bin that takes it."""
    spaces: list[int] = []
    open_bins: dict[int, list[list]] = {}

    def add(pattern: tuple[int, ...], times: int) -> None:
        space = capacity - sum(pattern)
        if space not in open_bins:
            insort(spaces, space)
            open_bins[space] = []
        open_bins[space].append([pattern, times])

    for n in sorted(counts, reverse=True):
        c = counts[n]
        while c:
            i = bisect_left(spaces, n)
            if i == len(spaces):
                each = capacity // n
                if full := c // each:
                    add((n,) * each, full)
                if rest := c % each:
                    add((n,) * rest, 1)
                break
            space = spaces[i]
            pattern, times = open_bins[space].pop()
            if not open_bins[space]:
                del open_bins[space], spaces[i]
            each = min(space // n, -(-c // times))  # a bin that took one piece is the fullest, and takes the next while it fits
            used = min(times, c // each) if each else 0
            add(pattern + (n,) * each, used)
            if used < times:
                add(pattern, times - used)
            c -= used * each
    out: Counter = Counter()
    for bins in open_bins.values():
        for pattern, times in bins:
            out[pattern] += times
    return out


def plan_bins(counts: dict[int, int], capacity: int) -> Counter:
    fixed, rest = reduce_bins(counts, capacity)
    return fixed + best_fit(rest, capacity)


def slots(plan: Counter) -> np.ndarray:
    """Rows of length, first rank, bins, first sequence, offset: runs of pieces that go to successive sequences."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for pattern, times in sorted(plan.items(), reverse=True):
        offset = 0
        for n in pattern:
            rows.append((n, used[n], times, sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


# --- all together -------------------------------------------------------------------------------


def pack(docs: DataFrame, tokenizer_path: str, *, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = common.Scratch(docs.sparkSession)
    cut = scratch.table(pieces(docs, tokenizer_path, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col), "pack-pieces")
    with common.swept(docs.sparkSession):  # at most `capacity` rows come to the driver
        counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slots(plan_bins(counts, capacity))
    groups = F.array(*(F.lit(1 + counts.get(n, 0) // GROUP_ROWS) for n in range(1, capacity + 1)))  # as many as a length's pieces need
    cut = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece"), F.element_at(groups, F.col("length"))).cast("int"))
    sizes = scratch.table(cut.groupBy("length", "group").agg(F.count("*").alias("n")), "pack-sizes")
    ahead = Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "group", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "group").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(order)).join(base, ["length", "group"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank") - 1).alias("rank"))
    shift = np.int64(1 << 40)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0] * shift + table[:, 1]
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            at = np.searchsorted(keys, length * shift + rank, "right") - 1
            sequence = table[at, 3] + rank - table[at, 1]
            columns = [*b.columns[:3], pa.array(length), b.column(4), pa.array(sequence), pa.array(table[at, 4])]
            yield pa.record_batch(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = ranked.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op8_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
