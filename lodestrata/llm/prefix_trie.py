"""The trie of conversations' beginnings, by prefix-doubling names.

A turn is known by the digest of its role and text, and each different turn gets a dense name. Blocks of 2**k turns that
begin at multiples of 2**k are named in rounds, k = 1, 2, ...: a block is the pair of its halves' names, each different
pair gets a dense name, and a join gives every block its own. A conversation of n turns has some n / 2**k blocks, so all
rounds together move about twice as many names as there are turns, and there are as many rounds as the longest
conversation's length has bits. A prefix of d turns is composed of the blocks that d's binary digits name, longest
first; going down the levels, each round adds one digit to all prefixes by the pair of the name so far and the block's.
Prefixes of d turns are equal if and only if their names are.

Rows with the same depth and name are one node. What a node sums over its subtree needs neither rounds by depth nor
pairs of nodes and their ancestors: a node's facts lie with its smallest member, which is a member of all the node's
ancestors, so a node's sum is that of its members' totals less what its smallest member has above it.

Edge cases: turns come in the order of turn (null first), then role, then digest; null role and text are empty; rows
without a conversation's id are left out; repeated rows are turns of their own; an empty table gives no node, not even a
root; very long texts are digested whole and very long conversations split by ranges; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.ordinal import with_ordinal, with_position

from . import common

#: A running sum along a conversation is taken over so many turns, and then over the sums of these.
CHUNK_BITS = 12
#: Ids of a node's last members are joined to pieces of about so many characters before one task digests them in order.
PIECE_CHARS = 1 << 16
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def turns(table: DataFrame, scratch: common.Scratch, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (c, pos, name), pos from 0, and the different turns (name, words)."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (role_col, text_col))
    unit = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = table.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), role.alias("role"), unit.alias("unit"), common.word_count(text).alias("words"))
    rows = scratch.table(rows.withColumn("tie", F.monotonically_increasing_id()), "turns")
    units = scratch.table(with_ordinal(rows.groupBy("unit").agg(F.max("words").alias("words")), name="name", write=scratch.table), "turn-names")
    placed = with_position(rows.select("c", "turn", "role", "unit", "tie"), ["c"], [F.asc_nulls_first("turn"), "role", "unit", "tie"], name="pos", unique=True, write=scratch.table)
    named = scratch.table(placed.join(units, "unit").select("c", "pos", "name"), "named-turns")
    scratch.drop(rows)
    return named, units.select("name", "words")


def graft(rows: DataFrame, scratch: common.Scratch, *, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rebuilt rows (c, pos, name), and all conversations (c, length): each begins as its neighbour c - c % every does.

    The first h = crc32(c) % heads turns are the neighbour's (all, if it has fewer; none, if there is none), the rest the
    conversation's own after its first h.
    """
    h = F.crc32(F.col("c").cast("string")) % heads
    convs = rows.groupBy("c").agg(F.count("*").alias("own"))
    # at most heads - 1 turns of a conversation, so these lists are short
    head = rows.where((F.col("c") % every == 0) & (F.col("pos") < heads - 1)).groupBy(F.col("c").alias("donor")).agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("head"))
    convs = convs.withColumn("donor", F.col("c") - F.col("c") % every).withColumn("h", h).join(head, "donor", "left")
    convs = convs.withColumn("head", F.slice(F.coalesce("head.name", F.array().cast("array<bigint>")), F.lit(1), F.col("h").cast("int")))
    convs = convs.select("c", "h", "head", F.size("head").cast("long").alias("base"), F.greatest(F.col("own") - F.col("h"), F.lit(0)).alias("rest"))
    convs = scratch.table(convs, "conversations")
    own = rows.join(convs.select("c", "h", "base"), "c").where("pos >= h").select("c", (F.col("pos") - F.col("h") + F.col("base")).alias("pos"), "name")
    borrowed = convs.select("c", F.posexplode("head").alias("pos", "name")).select("c", F.col("pos").cast("long").alias("pos"), "name")
    return scratch.table(own.union(borrowed), "rebuilt-turns"), convs.select("c", (F.col("base") + F.col("rest")).alias("length"))


def _name_pairs(pairs: DataFrame, scratch: common.Scratch) -> DataFrame:
    """The rows of ``pairs``, a table, with the dense name of their pair (a, b)."""
    names = with_ordinal(pairs.select("a", "b").distinct(), name="name", write=scratch.table)
    return pairs.join(names, ["a", "b"])


def prefixes(rows: DataFrame, convs: DataFrame, scratch: common.Scratch) -> DataFrame:
    """A table (c, d, name) of every prefix of every conversation, d = 0 being the root with name 0."""
    blocks = [rows.select("c", F.col("pos").alias("i"), "name")]
    while True:
        even = F.col("i") % 2 == 0
        pairs = blocks[-1].groupBy("c", F.shiftright("i", 1).alias("j")).agg(F.max(F.when(even, F.col("name"))).alias("a"), F.max(F.when(~even, F.col("name"))).alias("b"))
        pairs = scratch.table(pairs.where(F.col("b").isNotNull()), "block-pairs")
        if pairs.isEmpty():
            break
        blocks.append(scratch.table(_name_pairs(pairs, scratch).select("c", F.col("j").alias("i"), "name"), "blocks"))
        scratch.drop(pairs)
    found = convs.select("c", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("name"))
    for level in reversed(blocks):
        block = level.where(F.col("i") % 2 == 0).select("c", F.shiftright("i", 1).alias("d"), F.col("name").alias("b"))
        pairs = scratch.table(found.withColumnRenamed("name", "a").join(block, ["c", "d"]), "prefix-pairs")
        grown = _name_pairs(pairs, scratch).select("c", (2 * F.col("d") + 1).alias("d"), "name")
        before, found = found, scratch.table(found.select("c", (2 * F.col("d")).alias("d"), "name").union(grown), "prefixes")
        scratch.drop(pairs, before, *([] if level is blocks[0] else [level]))
    return found


def _digests(ends: DataFrame) -> DataFrame:
    """(d, name, ends_sha256) of rows (d, name, c): the digest of a node's ids in ascending order, joined by commas.

    A digest is taken in order by one task, but of pieces that many tasks have sorted and joined before.
    """
    width = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, ids, size, out = None, 0, [], 0, []
        for b in batches:
            for d, name, c in zip(*(x.to_pylist() for x in b.columns)):
                if ids and (node != (d, name) or size > PIECE_CHARS):
                    out.append((*node, first, ",".join(ids)))
                    ids, size = [], 0
                if not ids:
                    node, first = (d, name), c
                ids.append(str(c))
                size += len(ids[-1]) + 1
            yield batch(out, kinds)
            out = []
        yield batch([*out, *([(*node, first, ",".join(ids))] if ids else [])], kinds)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []
        for b in batches:
            for d, name, _, text in zip(*(x.to_pylist() for x in b.columns)):
                if node == (d, name):
                    state.update(b",")
                else:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = (d, name), hashlib.sha256()
                state.update(text.encode())
            yield batch(out, last)
            out = []
        yield batch([*out, *([(*node, state.hexdigest())] if node else [])], last)

    def batch(rows: list[tuple], columns: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(columns)], names=[n for n, _ in columns])

    long, text = pa.int64(), pa.string()
    kinds = [("d", long), ("name", long), ("first", long), ("ids", text)]
    last = [("d", long), ("name", long), ("ends_sha256", text)]
    pieces = ends.repartitionByRange(width, "d", "name", "c").sortWithinPartitions("d", "name", "c").mapInArrow(join, "d long, name long, first long, ids string")
    return pieces.repartition(width, "d", "name").sortWithinPartitions("d", "name", "first").mapInArrow(digest, "d long, name long, ends_sha256 string")


def trie(rows: DataFrame, convs: DataFrame, units: DataFrame, scratch: common.Scratch) -> DataFrame:
    """The nodes of conversations given as rows (c, pos, name), lengths (c, length) and turns (name, words)."""
    path = prefixes(rows, convs, scratch)
    nodes = scratch.table(path.groupBy("d", "name").agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs")), "nodes")
    # of its smallest member: the node above, and the words of the last turn
    above = path.select(F.col("c").alias("conv_id"), (F.col("d") + 1).alias("d"), F.col("name").alias("parent"))
    turn = rows.select(F.col("c").alias("conv_id"), (F.col("pos") + 1).alias("d"), F.col("name").alias("turn")).join(units.withColumnRenamed("name", "turn"), "turn").drop("turn")
    facts = nodes.join(above, ["conv_id", "d"], "left").join(turn, ["conv_id", "d"], "left")
    facts = scratch.table(facts.withColumn("w", (F.col("n_convs") - 1) * F.coalesce("words", F.lit(0))).drop("words"), "node-facts")
    children = facts.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    facts, before = scratch.table(facts.join(children, ["d", "name"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "node-children"), facts
    scratch.drop(before)
    # a conversation is the smallest member of one leaf at most, at its end
    own = facts.groupBy(F.col("conv_id").alias("c")).agg(F.sum("w").alias("w"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    below = path.join(own, "c").groupBy("d", "name").agg(F.sum("w").alias("w_below"), F.sum("leaf").alias("n_leaves"))
    chunk = F.shiftright("d", CHUNK_BITS)
    step = Window.partitionBy("conv_id", "chunk").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    inside = facts.select("conv_id", "d", chunk.alias("chunk"), "w").withColumn("w_in", F.coalesce(F.sum("w").over(step), F.lit(0)))
    chunks = facts.groupBy("conv_id", chunk.alias("chunk")).agg(F.sum("w").alias("w_chunk"))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("conv_id", "chunk", F.coalesce(F.sum("w_chunk").over(earlier), F.lit(0)).alias("w_before"))
    above_sum = inside.join(chunks, ["conv_id", "chunk"]).select("conv_id", "d", (F.col("w_in") + F.col("w_before")).alias("w_above"))
    ends = _digests(scratch.table(path.join(convs.withColumnRenamed("length", "d"), ["c", "d"]).select("d", "name", "c"), "ends"))
    parents = nodes.select((F.col("d") + 1).alias("d"), F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = facts.join(parents, ["d", "parent"], "left").join(below, ["d", "name"]).join(above_sum, ["conv_id", "d"]).join(ends, ["d", "name"], "left")
    saved = F.col("w_below") - F.col("w_above")
    return out.select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256")
    )


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    with common.Scratch(spark) as scratch:
        rows, units = turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"), scratch)
        rebuilt, convs = graft(rows, scratch)
        return scratch.keep(scratch.table(trie(rebuilt, convs, units, scratch), "trie"))


#: The unsigned crc32 of a text s, bit by bit: its remainder after a byte's bits is shifted out.
_BYTE_IN = "(CASE WHEN i % 8 = 0 THEN xor(a, ascii(substr(s, i // 8 + 1, 1))::BIGINT) ELSE a END)"
_CRC32 = f"xor(list_reduce(range(8 * len(s)), lambda a, i: xor({_BYTE_IN} >> 1, 3988292384 * ({_BYTE_IN} & 1)), 4294967295::BIGINT), 4294967295::BIGINT)"
SQL = rf"""
    WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
                   sha256(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS u,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
               FROM conversations WHERE conv_id IS NOT NULL),
        n AS (SELECT conv_id, own, {_CRC32} % 4 AS h FROM (SELECT conv_id, count(*) AS own, conv_id::VARCHAR AS s FROM o GROUP BY conv_id)),
        c AS (SELECT n.conv_id, n.own, n.h, d.own AS other FROM n LEFT JOIN n d ON d.conv_id = n.conv_id - n.conv_id % 20),
        r AS (SELECT c.conv_id, o.pos, o.u, o.words FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 AND o.pos < c.h
              UNION ALL
              SELECT c.conv_id, o.pos - c.h + least(c.h, coalesce(c.other, 0)), o.u, o.words FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos >= c.h),
        p AS (SELECT conv_id, 0 AS depth, '' AS p, 0 AS words FROM c
              UNION ALL
              SELECT conv_id, pos + 1, md5(string_agg(u, '') OVER (PARTITION BY conv_id ORDER BY pos)), words FROM r),
        q AS (SELECT *, lag(p) OVER w AS above, lead(p) OVER w IS NULL AS ends FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
        k AS (SELECT depth, p, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(above) AS above, (count(*) - 1) * any_value(words) AS w,
                  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
              FROM q GROUP BY depth, p),
        f AS (SELECT depth - 1 AS depth, above AS p, count(*) AS n_children FROM k WHERE depth > 0 GROUP BY depth, above),
        t AS (SELECT p.depth, p.p, sum(k.w) AS saved_tokens, count(*) FILTER (f.p IS NULL) AS n_leaves
              FROM k JOIN p ON p.conv_id = k.conv_id AND p.depth <= k.depth LEFT JOIN f ON f.depth = k.depth AND f.p = k.p GROUP BY p.depth, p.p)
    SELECT k.conv_id, k.depth::BIGINT AS depth, a.conv_id AS parent_conv_id, k.n_convs, coalesce(f.n_children, 0)::BIGINT AS n_children,
           t.n_leaves::BIGINT AS n_leaves, t.saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
    FROM k JOIN t USING (depth, p) LEFT JOIN f USING (depth, p) LEFT JOIN k a ON a.depth = k.depth - 1 AND a.p = k.above"""
