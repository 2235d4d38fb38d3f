"""The trie against one built turn by turn, and against SQL."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from lodestrata.llm import common, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, name string, d long, w string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, [])[: h[c]] + own[c][h[c] :] for c in own}


def brute(convs):
    members, children = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def below(node):
        own = (len(members[node]) - 1) * (len(WORDS.findall(node[-1][1])) if node else 0)
        leaves, saved = (1, own) if node not in children else (0, own)
        for kid in children.get(node, []):
            a, b = below(kid)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = []
    for node, ids in members.items():
        leaves, saved = below(node)
        ends = ",".join(str(c) for c in sorted(ids) if len(convs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(ids), len(node), parent, len(ids), len(children.get(node, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def tuples(df):
    return sorted(str(tuple(r)) for r in df.collect())


def built(spark, rows):
    table = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)
    with common.Scratch(spark) as scratch:
        turns, units = prefix_trie.turns(table, scratch)
        again, convs = prefix_trie.graft(turns, scratch)
        return scratch.keep(scratch.table(prefix_trie.trie(again, convs, units, scratch), "trie"))


@pytest.fixture(scope="module")
def rows():
    """Nulls in every column, no turns left, equal turns, a long conversation, one shared by a third, and ids far apart."""
    rng = random.Random(4)
    texts = ["a b c", "a b c d", "", None, "one", "Ünï  wörds\n here", "x " * 3000]
    out = []
    for c in [*range(60), 1000, 1001, 10**12 + 7]:
        out += [(c, t, rng.choice(["user", "assistant"]), rng.choice(texts[:2] if t < 2 else texts)) for t in range(rng.choice([1, 2, 2, 3, 5, 9]))]
    out += [(c, t, "user", "the same") for c in range(100, 140) for t in range(6)]
    out += [(200, t, "user" if t % 2 else None, f"turn {t % 5}") for t in range(70)] + [(201, None, "user", "first"), (201, 3, None, None), (201, 3, None, None), (201, 3, "a", "tie")]
    return out + [(None, 1, "user", "no id"), (None, None, None, None), (240, None, None, None)]


def test_nodes(spark, rows):
    got = built(spark, rows)
    assert tuples(got) == brute(rebuilt(rows)) and got.count() > 100


@pytest.mark.parametrize("seed", range(3))
def test_small_tries_of_few_turns(spark, seed):
    rng = random.Random(seed)
    rows = [(c, t, "u", rng.choice("ab")) for c in rng.sample(range(200), 40) for t in range(rng.randrange(1, 12))]
    assert tuples(built(spark, rows)) == brute(rebuilt(rows))


def test_long_conversations_and_pieces_of_ids(spark, rows, monkeypatch):
    """Sums over several chunks and digests over several pieces are those of one."""
    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", 2)
    monkeypatch.setattr(prefix_trie, "PIECE_CHARS", 12)
    assert tuples(built(spark, rows)) == brute(rebuilt(rows))


def test_an_empty_table_has_no_node(spark):
    got = built(spark, [])
    assert got.count() == 0 and got.columns[:2] == ["conv_id", "depth"]
    assert built(spark, [(None, 0, "user", "x")]).count() == 0


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    got, want = prefix_trie.op12_prefix_trie(spark, sf), con.sql(prefix_trie.SQL)
    assert sorted(map(str, want.select(*got.columns).fetchall())) == tuples(got) and len(got.columns) == len(want.columns)
