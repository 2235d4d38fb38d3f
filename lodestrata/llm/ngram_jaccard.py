"""N-gram Jaccard join by parity sketches.

A document's set holds the hashes of its distinct shingles. Its parity sketch at a size band cuts the hash space into
m blocks and keeps in each the XOR of the hashes that fall there: a bit sketch in which every shingle flips bits of
one block alone. So blocks in which two sketches differ, and with them the sketches' Hamming distance, bound the
symmetric difference from below. Two sets of sizes a and b with Jaccard similarity of at least t differ in at most
d = (1 - t) (a + b) / (1 + t) elements: at least m - d of the m blocks agree. By the pigeonhole principle the first
d + 1 blocks of both, in one order over all blocks of all sketches, share a block. Blocks that many sets have, as texts
with a common passage do, come last in this order, and the fullest first, as they agree by chance least. A band holds sizes from 2**k to 2**(k + 1) - 1; a set near its upper end also takes part in
the next band, so every pair that can link meets in one.

Sets that share a block are candidates, and all of them are settled, without all pairs of a group:
1. sets with equal shingles are one class from the start;
2. each block's members meet its least member p. A pair is verified, by intersecting the sets, only if its sizes and
   the Hamming distance of its whole sketches, a second lower bound, allow a link;
3. the links give components; in a block whose members still lie in several, they meet the member nearest to p too,
   which in a group of copies is near their original;
4. where several components remain, members outside the block's largest meet those of other components, each pair
   inside the join held against the sizes and the Hamming distance of the whole sketches; what passes is verified.
What was not compared then lies in one component, or cannot link. So components are exact with no cap on blocks or
partners. A set is known by 64 bits of its digest and a check of 64 more; sets that agree in the first alone are told
apart by the second.

Edge cases: null text and text without words have the empty set and link with nothing; with fewer words than n the
whole sequence is the one shingle; equal texts and repeated rows are one class; an empty table gives an empty result;
other columns are ignored; texts are never cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components


#: Frequent keys go to the tasks: 8 bytes each, no more than this.
MAX_USUAL = 1 << 19


def shingle_set(text: str, n: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(common.window_hashes(common.word_hashes(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)), n))


def set_id(hashes: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """The set's id, of so many bits, and its check."""
    digest = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
    first, check = (int.from_bytes(digest[i : i + 8], "little", signed=True) for i in (0, 8))
    return first >> (64 - bits), check


def most_differences(size: int, percent: int) -> int:
    """Most elements in which a set of this size and a larger one can differ and still link."""
    return (100 - percent) * (size + 100 * size // percent) // (100 + percent)


def _blocks(level: int, percent: int) -> int:
    return -(-3 * (most_differences((2 << level) - 1, percent) + 1) // 2)


def _band_keys(hashes: np.ndarray, level: int, percent: int, first: int | None, usual: np.ndarray | None) -> np.ndarray:
    """Keys of the ``first`` blocks of the sketch at a band: unusual before usual ones, then the fullest; all for None."""
    m = _blocks(level, percent)
    block = ((hashes >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # hashes are sorted, so blocks are runs
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    used = block[starts].astype(np.int64)
    parity, full = np.zeros(m, np.uint64), np.zeros(m, np.int64)
    parity[used] = np.bitwise_xor.reduceat(common.mix64(hashes), starts)
    full[used] = np.diff(np.r_[starts, len(hashes)])
    keys = common.mix64(parity ^ common.mix64(np.arange(m, dtype=np.uint64) + np.uint64((level + 1) << 40)))
    late = np.zeros(m, bool)
    if usual is not None and len(usual):
        late = usual[np.minimum(np.searchsorted(usual, keys), len(usual) - 1)] == keys
    return keys[np.lexsort((keys, -full, late))[:first]]


def sketch_keys(hashes: np.ndarray, percent: int, usual: np.ndarray | None = None, every: bool = False) -> np.ndarray:
    """The keys under which a set is looked up (``every`` for those of all blocks); none where only equal sets can link."""
    n = len(hashes)
    d = most_differences(n, percent)
    if not d:
        return np.empty(0, np.uint64)
    level, first = n.bit_length() - 1, None if every else d + 1
    keys = _band_keys(hashes, level, percent, first, usual)
    if 100 * n // percent >= 2 << level:
        keys = np.r_[keys, _band_keys(hashes, level + 1, percent, first, usual)]
    return keys


def parity_sketches(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set's parity sketch as longs, four bits or more an element, and the one of twice the size."""
    longs = max(8, (2 << (len(hashes).bit_length() - 1)) // 16)
    out = []
    for size in (longs, 2 * longs):
        bits = (common.mix64(hashes ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(64 * size - 1)).astype(np.int64)
        odd = (np.bincount(bits, minlength=64 * size) & 1).astype(np.uint8)
        out.append(np.packbits(odd, bitorder="little").view(np.int64))
    return out[0], out[1]


def _hamming(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Differing bits of two sets' sketches of the same size, 0 where they have none."""
    count = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, v: n + v)
    m, n = F.size(a[0]), F.size(b[0])
    return F.when(m == n, count(a[0], b[0])).when(n == 2 * m, count(a[1], b[0])).when(m == 2 * n, count(a[0], b[1])).otherwise(0)


def _usual_keys(docs: DataFrame, n: int, percent: int, scratch: common.Scratch) -> np.ndarray:
    """Sorted keys that several sets of one eighth of the rows have, the most frequent ``MAX_USUAL`` at most.

    They only decide the order in which a set's blocks are looked up. Any order is right if it is the same for all
    sets, so neither the sample nor the bound can lose a pair; they keep texts that merely share a passage apart.
    """
    eighth = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(n)), F.lit(8)) == 0)
    keys = _features(eighth, n, percent, None, every=True).select("set_id", F.explode("keys").alias("key")).distinct()
    counts = scratch.table(keys.groupBy("key").agg(F.count("*").alias("n")).where("n >= 4"), "jaccard-usual")
    sizes = sorted(((r["n"], r["count"]) for r in counts.groupBy("n").count().collect()), reverse=True)  # a row for each different count
    least, total = None, 0
    for count, of_it in sizes:
        total += of_it
        if total > MAX_USUAL:
            break
        least = count
    usual = np.empty(0, np.uint64)
    if least is not None:
        rows = counts.where(F.col("n") >= least).select("key").toArrow()
        usual = np.sort(rows["key"].to_numpy().astype(np.int64).view(np.uint64))
    scratch.drop(counts)
    return usual


def _features(docs: DataFrame, n: int, percent: int, usual: np.ndarray | None, every: bool = False, bits: int = 64) -> DataFrame:
    """doc_id, text_id (a hash of the text), n_shingles, set_id and check (null if empty) and keys; a task gives the keys of equal sets once."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            sizes, ids, keys, none = [], [], [], np.empty(0, np.int64)
            for text in b.column(1):
                hashes = shingle_set(text.as_py() or "", n)
                sizes.append(len(hashes))
                ids.append(set_id(hashes, bits) if len(hashes) else (None, None))
                fresh = len(hashes) and ids[-1] not in seen
                seen.add(ids[-1])
                keys.append(sketch_keys(hashes, percent, usual, every).view(np.int64) if fresh else none)
            offsets = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([none, *keys])))
            columns = [b.column(0), b.column(2), pa.array(sizes, pa.int64()), *(pa.array([x[i] for x in ids], pa.int64()) for i in (0, 1)), lists]
            yield pa.record_batch(columns, names=["doc_id", "text_id", "n_shingles", "set_id", "check", "keys"])

    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_id"))
    return docs.mapInArrow(run, f"doc_id {kind}, text_id long, n_shingles long, set_id long, check long, keys array<long>")


def _told_apart(rows: DataFrame, scratch: common.Scratch) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ids that differ wherever the checks do, and the classes: set_id, check, doc_id, size, first_id (the id as digested), text_id (of a row with the doc_id)."""
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_id"))
    sets = rows.where(F.col("set_id").isNotNull()).groupBy(F.col("set_id").alias("first_id"), "check").agg(one.alias("one"), F.first("n_shingles").alias("size"))
    sets = sets.select("first_id", "check", "one.doc_id", "one.text_id", "size")
    sets = scratch.table(sets, "jaccard-sets-by-id")
    twice = sets.groupBy("first_id").agg(F.min("check").alias("lead"), F.max("check").alias("last")).where("lead <> last").select("first_id", "lead")
    moved = sets.join(twice, "first_id").where("check <> lead").select(F.col("first_id").alias("m_id"), F.col("check").alias("m_check"), F.xxhash64("first_id", "check", F.lit(1)).alias("moved"))
    moved = scratch.table(moved, "jaccard-moved")  # a pair of ids in 2**64: hardly ever a row
    if not moved.isEmpty():
        rows = rows.join(moved, (F.col("set_id") == F.col("m_id")) & (F.col("check") == F.col("m_check")), "left")
        rows = rows.withColumn("set_id", F.coalesce("moved", "set_id")).drop("m_id", "m_check", "moved")
        sets = sets.join(moved, (F.col("first_id") == F.col("m_id")) & (F.col("check") == F.col("m_check")), "left")
    else:
        sets = sets.withColumn("moved", F.lit(None).cast("long"))
    return rows, sets.select(F.coalesce("moved", "first_id").alias("set_id"), "check", "doc_id", "size", "first_id", "text_id")


def _sets(docs: DataFrame, wanted: DataFrame, n: int, bits: int) -> DataFrame:
    """set_id, size, hashes and sketches of the sets of ``wanted``, classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sets = [], []
            for text, name, first, check in zip(b.column(0), *(b.column(i).to_pylist() for i in (1, 2, 3))):
                hashes = shingle_set(text.as_py() or "", n)
                if len(hashes) and set_id(hashes, bits) == (first, check):
                    ids.append(name)
                    sets.append(hashes)
            sketches = [parity_sketches(x) for x in sets]
            lists = [pa.array([x.view(np.int64) for x in column], pa.list_(pa.int64())) for column in (sets, [s[0] for s in sketches], [s[1] for s in sketches])]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), *lists], names=["set_id", "size", "hashes", "sketch", "double_sketch"])

    # by id and text: of rows that share an id, or have none, a class meets those with its text only
    wanted = wanted.select(F.col("doc_id").alias("w_doc_id"), "text_id", "set_id", "first_id", "check")
    docs = docs.withColumn("text_id", F.xxhash64("text"))
    found = docs.join(wanted, (docs["text_id"] == wanted["text_id"]) & F.col("doc_id").eqNullSafe(F.col("w_doc_id"))).select("text", "set_id", "first_id", "check")
    found = found.mapInArrow(run, "set_id long, size long, hashes array<long>, sketch array<long>, double_sketch array<long>")
    return found.dropDuplicates(["set_id"])  # rows may share an id and a text


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, scratch: common.Scratch) -> DataFrame:
    """Of distinct pairs (a, b) of sets, those that link, with the Jaccard distance.

    Sizes are compared first, then the sketches, then the sets of the pairs that are left. The side that many pairs
    have in common, a, is joined last, so that no shuffle holds its set once for each pair.
    """
    reach = F.col("size_a") + F.col("size_b")
    for side in "ba":
        columns = (F.col(c).alias(f"{c}_{side}") for c in ("size", "sketch", "double_sketch"))
        pairs = pairs.join(sets.select(F.col("set_id").alias(side), *columns), side)
    pairs = pairs.where(100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b"))
    apart = _hamming(*((F.col(f"sketch_{s}"), F.col(f"double_sketch_{s}")) for s in "ab"))
    pairs = pairs.where((100 + percent) * apart <= (100 - percent) * reach).select("a", "b", "size_a", "size_b")
    pairs = scratch.table(pairs, "jaccard-pairs")
    both = pairs
    for side in "ba":
        both = both.join(sets.select(F.col("set_id").alias(side), F.col("hashes").alias(f"hashes_{side}")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            common_sizes = []
            for x, y in zip(b.column(4), b.column(5)):
                x, y = (v.values.to_numpy(zero_copy_only=False).view(np.uint64) for v in (x, y))
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common_sizes.append(int(np.count_nonzero(y[at] == x)))
            yield pa.record_batch([*b.columns[:4], pa.array(common_sizes, pa.int64())], names=["a", "b", "size_a", "size_b", "both"])

    out = both.select("a", "b", "size_a", "size_b", "hashes_a", "hashes_b").mapInArrow(run, "a long, b long, size_a long, size_b long, both long")
    union = reach - F.col("both")
    out = scratch.table(out.where(100 * F.col("both") >= percent * union).select("a", "b", (1 - F.col("both") / union).alias("distance")), "jaccard-links")
    scratch.drop(pairs)
    return out


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members under keys where several components meet, with root, and main, the key's largest component."""
    placed = members.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    sums = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    mains = sums.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").drop("roots")
    return placed.join(mains, "key")


def _ordered(x: str, y: str) -> tuple:
    """The lesser as a, the other as b."""
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _meet(left: DataFrame, percent: int) -> DataFrame:
    """Of (key, set_id, root, main, size and sketches): distinct pairs of different components that may link."""
    names = ("set_id", "root", "size", "sketch", "double_sketch")
    minor = left.where("root <> main").select("key", *(F.col(c).alias(f"x_{c}") for c in names))
    sizes = 100 * F.least("size", "x_size") >= percent * F.greatest("size", "x_size")
    apart = _hamming((F.col("sketch"), F.col("double_sketch")), (F.col("x_sketch"), F.col("x_double_sketch")))
    close = (100 + percent) * apart <= (100 - percent) * (F.col("size") + F.col("x_size"))
    met = left.join(minor, (left["key"] == minor["key"]) & (F.col("root") != F.col("x_root")) & sizes & close)
    return met.select(*_ordered("set_id", "x_set_id")).distinct()


def jaccard_join(docs: DataFrame, *, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", id_bits: int = 64) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, set_id (null if empty) and component_id.

    Sets link where 100 * intersection >= percent * union; component_id is the smallest id reachable by links.
    ``id_bits`` shortens the sets' ids, to test that sets of one id are told apart.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    with common.Scratch(docs.sparkSession) as scratch:
        found = scratch.table(_features(docs, n, percent, _usual_keys(docs, n, percent, scratch), bits=id_bits), "jaccard-rows")
        rows, classes = _told_apart(found, scratch)
        keys = rows.where("size(keys) > 0").select("set_id", F.explode("keys").alias("key"))
        least = keys.groupBy("key").agg(F.min("set_id").alias("p"), F.max("set_id").alias("last")).where("p <> last").select("key", "p")
        members = scratch.table(keys.join(least, "key").where("set_id <> p").distinct(), "jaccard-members")
        rows = scratch.table(rows.drop("keys", "text_id"), "jaccard-narrow")
        scratch.drop(found)

        wanted = members.select("set_id").union(members.select("p")).distinct()
        sets = scratch.table(_sets(docs, classes.join(wanted, "set_id"), n, id_bits), "jaccard-sets")
        first = members.select(F.col("p").alias("a"), F.col("set_id").alias("b")).distinct()
        first = _verified(first, sets, percent, scratch)
        roots = components(first, scratch, rounds=1)  # pairs that it does not yet join meet a centre again, which costs a row each

        # a member that is near the least one often is near all: it is each open block's second centre
        placed = _open(members, roots).join(first.select(F.col("a").alias("p"), F.col("b").alias("set_id"), "distance"), ["p", "set_id"], "left")
        placed = scratch.table(placed.select("key", "set_id", "root", "distance"), "jaccard-open")  # no distance without a link
        second = placed.groupBy("key").agg(F.min_by(F.struct("set_id", "root"), F.struct(F.coalesce("distance", F.lit(2.0)), "set_id")).alias("c"))
        second = placed.join(second.select("key", F.col("c.set_id").alias("c"), F.col("c.root").alias("c_root")), "key").where("root <> c_root")
        second = _verified(second.select(*_ordered("set_id", "c")).distinct(), sets, percent, scratch)
        links = scratch.table(first.union(second).select("a", "b"), "jaccard-links")
        scratch.drop(members, first, second, roots)
        roots = components(links, scratch)

        left = _open(placed.select("key", "set_id"), roots).join(sets.select("set_id", "size", "sketch", "double_sketch"), "set_id")
        left = scratch.table(left, "jaccard-left")
        third = _verified(_meet(left, percent), sets, percent, scratch).select("a", "b")
        scratch.drop(placed, left, sets)
        if not third.isEmpty():
            scratch.drop(roots)
            roots = components(links.union(third), scratch)

        named = classes.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").select("set_id", "doc_id", F.coalesce("root", "set_id").alias("root"))
        names = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        names = named.join(names, "root").select(F.col("set_id").alias("c_set_id"), "component_id")
        out = rows.join(names, F.col("set_id") == F.col("c_set_id"), "left")
        out = out.select("doc_id", "n_shingles", "set_id", F.coalesce("component_id", "doc_id").alias("component_id"))
        return scratch.keep(scratch.table(out, "jaccard-result"))


def keep_one(docs: DataFrame, *, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` (with doc_id, text) without near copies: of each component one row stays, whatever ids others have.

    It is one with the smallest id (null comes last), of several the first by the digest of id and text. Rows that link
    with nothing stay, also under a repeated or null id, and all rows without words or text; of rows equal in id and text
    any one. An empty table stays empty; columns of any name are kept as they are.
    """
    name = F.concat(F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    (key,) = common.free(docs.columns, "near_key")
    keyed = docs.withColumn(key, F.md5(name))
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(key).alias("key"))
    rows = jaccard_join(keyed.select(row.alias("doc_id"), "text"), n=n, percent=percent)
    kept = rows.where(F.col("set_id").isNotNull() & (F.col("doc_id") == F.col("component_id"))).select(F.col("doc_id.key").alias(key)).distinct()
    worded = F.coalesce(F.col("text").rlike(common.WORD), F.lit(False))
    once = keyed.where(worded).dropDuplicates([key])  # a task sends equal rows once
    return once.join(kept, key, "left_semi").select(*docs.columns).unionByName(docs.where(~worded))


def op2_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(common.documents(spark, sf_dir), n=4, percent=85).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l),
r(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
c AS (SELECT u, min(v) AS v FROM r GROUP BY u)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c.v, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.u = w.doc_id
"""
