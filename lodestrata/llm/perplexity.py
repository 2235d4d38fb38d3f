"""Quality rules with n-gram perplexity under a modified Kneser-Ney model counted and estimated by Spark.

The model's tokens are code points, unfolded, so every script has a model of its own; its order is 5. It learns from
texts that it can trust: they pass the base rules, and few of their characters are symbols. Else a kind of junk that
is common would teach the model its own habits and pass. Texts are made distinct by digest, so copies count once. Tasks
count their n-grams by language, Spark sums them. At the highest order counts below ``least_count`` are pruned (what only one text says supports nobody, noise
least of all), below it stand continuation counts of what remains; three discounts an order come from the counts of
counts, and the mass of what was discounted or pruned goes to the lower order, so each context's probabilities sum to
one. All of it is joins between tables of n-grams in the shared folder: the model grows with the corpus and nothing
of it passes through the driver but the head.

The head are the ``head`` most frequent entries, stored in sorted hash arrays with log-probabilities and back-off
weights, which travel with the tasks: a bounded size. A task looks every position of a text up there. Where the head
is the whole model, what it lacks backs off at once; else the n-grams not found, a list for each text, go to the
model's tables in joins, once for each different n-gram. Either way gives the same perplexity.

A document, trusted or not, is judged by its own language's model alone. The bands are language-specific: the median
of the log-perplexity of the language's distinct trusted texts, give or take a multiple of their median distance from
it, and at least a margin, which is wider above, as clean texts with names, numbers or a foreign passage reach further
up than down; up to half of these texts being noise can't carry either away. A document below or above its band is
rejected. Documents without a language, or in one that has fewer than ``least_texts`` trusted texts, are judged by the
model and the band of all languages together.

Edge cases: null and empty text have no words and fail the base rules; equal rows keep a row each and get equal
verdicts; an empty table, or one without a text that passes, gives no bands and rejects by the base rules only; other
columns are ignored; texts are never cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

ORDER = 5
#: The name under which all languages together stand.
ALL = "*"
START, END = "\x02", "\x03"
#: A task works on about so many code points at a time: few enough for a processor's cache.
GROUP_CHARS = 1 << 16
#: A task's memory of counted n-grams is sent at this size.
MEMORY = 1 << 20

#: The model learns from no text with more symbols than this in a thousand characters of its words.
SYMBOLS_PERMILLE = 20
#: A table of bands of at most so many languages is broadcast.
MAX_BANDS_SENT = 100_000
#: So many partitions of distinct texts go to one counting task.
MERGED = 4

# --- n-grams of texts ----------------------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.uint64(pow(int(_BASE), k, 1 << 64)) for k in range(ORDER)]


def _salt(language: str) -> int:
    return int.from_bytes(hashlib.blake2b(language.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_keys(points: np.ndarray, ends: np.ndarray, size: int, salts: np.ndarray) -> np.ndarray:
    """Hash of the ``size`` code points up to each of the places ``ends``, under the language's salt."""
    with np.errstate(over="ignore"):
        h = salts + np.uint64(size)
        for k in range(size):
            h += (points[ends - k].astype(np.uint64) + np.uint64(1)) * _POWERS[k]
        return common.mix64(h)


class Group:
    """Texts side by side, each between its marks; ``ends`` are the places of all their n-grams' last code points."""

    def __init__(self, languages: list[str], texts: list[str], salts: list[int]):
        self.text = "".join(f"{START * (ORDER - 1)}{t}{END}" for t in texts)
        self.points = points_of(self.text)
        self.sizes = np.array([len(t) + 1 for t in texts])
        begins = np.concatenate([[0], np.cumsum(self.sizes + ORDER - 1)[:-1]]) + ORDER - 1
        self.firsts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.ends = np.arange(self.sizes.sum()) + np.repeat(begins - self.firsts, self.sizes)
        self.salts = np.repeat(np.array(salts, np.uint64), self.sizes)
        self.languages = languages

    def keys(self) -> np.ndarray:
        """The hashes of all n-grams of the highest order, worked out over the whole run of code points."""
        with np.errstate(over="ignore"):
            wide = self.points.astype(np.uint64)
            wide += np.uint64(1)
            n = len(wide) - ORDER + 1
            h = wide[ORDER - 1 :].copy()
            for k in range(1, ORDER):
                h += wide[ORDER - 1 - k : ORDER - 1 - k + n] * _POWERS[k]
            h = h[self.ends - (ORDER - 1)]
            h += self.salts
            h += np.uint64(ORDER)
            return common.mix64(h)

    def owner(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, place, "right") - 1

    def gram(self, place: int) -> str:
        end = int(self.ends[place])
        return self.text[end - ORDER + 1 : end + 1]


class HashArray:
    """Sorted hashes, found by the bits that they begin with."""

    def __init__(self, keys: np.ndarray):
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.append(keys, np.uint64(0))  # a place to look at behind the last
        self.starts = np.searchsorted(keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where it is not there: where its first bits begin, or a few steps behind."""
        bucket = (keys >> self.shift).astype(np.int64)
        out = self.starts[bucket]
        todo = np.flatnonzero((self.keys[out] != keys) | (out >= len(self.keys) - 1))
        place, last = out[todo], self.starts[bucket[todo] + 1]
        out[todo] = -1
        keys = keys[todo]
        while len(todo):
            on = np.flatnonzero(place < last)
            todo, place, last, keys = todo[on], place[on], last[on], keys[on]
            hit = self.keys[place] == keys
            out[todo[hit]] = place[hit]
            on = np.flatnonzero(~hit)
            todo, place, last, keys = todo[on], place[on] + 1, last[on], keys[on]
        return out


def groups(languages: list[str], texts: list[str]) -> Iterator[Group]:
    start, chars, salts = 0, 0, {x: _salt(x) for x in set(languages)}
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= GROUP_CHARS or i == len(texts) - 1:
            part = languages[start : i + 1]
            yield Group(part, texts[start : i + 1], [salts[x] for x in part])
            start, chars = i + 1, 0


class _Counts:
    """N-grams seen so far, by key: the count, the language and the gram of each; new ones wait outside the sorted array."""

    def __init__(self):
        self.table, self.counts = HashArray(np.empty(0, np.uint64)), np.empty(0, np.int64)
        self.names: list[tuple[str, str]] = []
        self.new: dict[int, list] = {}

    def __len__(self) -> int:
        return len(self.names) + len(self.new)

    def add(self, group: Group) -> None:
        keys = group.keys()
        at = self.table.find(keys)
        known = at >= 0
        np.add.at(self.counts, at[known], 1)
        rest = np.flatnonzero(~known)
        if len(rest):
            uniq, first, n = np.unique(keys[rest], return_index=True, return_counts=True)
            places = rest[first]
            for key, place, owner, times in zip(uniq.tolist(), places.tolist(), group.owner(places).tolist(), n.tolist()):
                if key in self.new:
                    self.new[key][0] += times
                else:
                    self.new[key] = [times, group.languages[owner], group.gram(place)]
            if len(self.new) > 2_000 + len(self.names) // 8:
                self.settle()

    def settle(self) -> None:
        if self.new:
            fresh = np.fromiter(self.new, np.uint64, len(self.new))
            keys = np.concatenate([self.table.keys[:-1], fresh])
            order = np.argsort(keys)
            names = self.names + [(x[1], x[2]) for x in self.new.values()]
            self.counts = np.concatenate([self.counts, np.array([x[0] for x in self.new.values()], np.int64)])[order]
            self.names = [names[i] for i in order.tolist()]
            self.table, self.new = HashArray(keys[order]), {}

    def batch(self) -> pa.RecordBatch:
        self.settle()
        columns = [pa.array([x[0] for x in self.names], pa.string()), pa.array([x[1] for x in self.names], pa.string()), pa.array(self.counts)]
        self.__init__()
        return pa.record_batch(columns, names=["language", "gram", "n"])


def count_grams(texts: DataFrame, symbols: int = SYMBOLS_PERMILLE) -> DataFrame:
    """Of (language, text): language, gram, n over the texts that the model trusts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Counts()
        for b in batches:
            pairs = [(x, t) for x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t and trusted(base_counts(t), symbols)]
            for group in groups([x for x, _ in pairs], [t for _, t in pairs]):
                seen.add(group)
                if len(seen) >= MEMORY:
                    yield seen.batch()
        yield seen.batch()

    return texts.mapInArrow(run, "language string, gram string, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))


# --- the model -----------------------------------------------------------------------------------


def _discounts(counts: DataFrame) -> DataFrame:
    """language and the discounts d1, d2, d3 of counts of 1, 2 and more."""
    t = [F.sum((F.col("n") == k).cast("double")).alias(f"t{k}") for k in (1, 2, 3, 4)]
    df = counts.groupBy("language").agg(*t)
    y = F.when((F.col("t1") > 0) & (F.col("t2") > 0), F.col("t1") / (F.col("t1") + 2 * F.col("t2"))).otherwise(0.5)
    out = [F.col("language").alias("d_language")]
    for k in (1, 2, 3):
        cut = k - (k + 1) * y * F.col(f"t{k + 1}") / F.col(f"t{k}")
        fit = F.least(F.greatest(cut, F.lit(0.1)), F.lit(k - 0.05))
        out.append(F.when((F.col(f"t{k}") > 0) & (F.col(f"t{k + 1}") > 0), fit).otherwise(0.5 * k).alias(f"d{k}"))
    return df.select(*out)


def estimate(counts: DataFrame, least_count: int, scratch: common.Scratch) -> DataFrame:
    """Of (language, gram, n) of the highest order, the model: language, gram, weight, p and spare.

    ``p`` is the probability of the gram's last code point after the others (null: the gram is a context only). ``spare`` is the mass that the gram, as a
    context, leaves to the lower order (null: all of it). The empty gram has the probability of an unknown code point.
    """
    layers, whole = [], counts
    for size in range(ORDER, 0, -1):
        least = least_count if size == ORDER else 1
        context = Window.partitionBy("language", "context")  # at most as many rows as there are code points
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = whole.join(_discounts(whole), F.col("language") == F.col("d_language")).withColumn("context", F.substring("gram", 1, size - 1))
        rows = rows.withColumn("own", F.when(F.col("n") >= least, F.col("n") - d).otherwise(0.0)).withColumn("total", F.sum("n").over(context))
        rows = rows.withColumn("spare", 1 - F.sum("own").over(context) / F.col("total")).where(F.col("n") >= least)
        layer = scratch.table(rows.select("language", "gram", "n", "context", "total", (F.col("own") / F.col("total")).alias("own"), "spare"), "lm-layer")
        layers.append(layer)
        whole = layer.groupBy("language", F.substring("gram", 2, size).alias("gram")).agg(F.count("*").alias("n"))
    # up from the empty gram
    below = layers[-1].groupBy("language").agg((1 / (F.count("*") + 1)).alias("p")).select("language", F.lit("").alias("gram"), F.lit(1 << 40).cast("long").alias("n"), "p")
    known = below
    orders = []
    for size, layer in enumerate(reversed(layers), 1):
        under = below.select(F.col("language").alias("u_language"), F.col("gram").alias("u_gram"), F.col("p").alias("u_p"))
        rows = layer.join(under, (F.col("language") == F.col("u_language")) & (F.substring("gram", 2, size) == F.col("u_gram")))
        below = scratch.table(rows.select("language", "gram", "n", (F.col("own") + F.col("spare") * F.col("u_p")).alias("p")), "lm-order")
        orders.append(below)
        known = known.unionByName(below)
    spares = [x.groupBy(F.col("language").alias("c_language"), F.col("context").alias("c_gram")).agg(F.first("total").alias("total"), F.first("spare").alias("spare")) for x in layers]
    spares = reduce(DataFrame.unionByName, spares)
    out = known.join(spares, (F.col("language") == F.col("c_language")) & (F.col("gram") == F.col("c_gram")), "full")
    names = [F.coalesce(c, f"c_{c}").alias(c) for c in ("language", "gram")]
    model = scratch.table(out.select(*names, F.coalesce("n", "total").alias("weight"), "p", "spare"), "lm-model")
    scratch.drop(*layers, *orders)
    return model


class Head(HashArray):
    """The most frequent entries of the model in sorted hash arrays; ``whole`` if there are no others."""

    def __init__(self, languages: pa.Array, grams: pa.Array, p: np.ndarray, spare: np.ndarray, whole: bool):
        coded = pc.dictionary_encode(languages)
        salt = np.array([_salt(x) for x in coded.dictionary.to_pylist()], np.uint64)[coded.indices.to_numpy()]
        sizes = pc.utf8_length(grams).to_numpy().astype(np.int64)
        ends = np.frombuffer(grams.buffers()[1], np.int32)[grams.offset : grams.offset + len(grams) + 1] if len(grams) else np.zeros(1, np.int32)
        text = grams.buffers()[2][int(ends[0]) : int(ends[-1])].to_pybytes().decode() if len(grams) else ""  # no object for each gram
        points, firsts, keys = points_of(text), np.concatenate([[0], np.cumsum(sizes)]), np.empty(len(grams), np.uint64)
        for size in range(ORDER + 1):
            at = np.flatnonzero(sizes == size)
            keys[at] = gram_keys(points, firsts[at] + size - 1, size, salt[at])
        order = np.argsort(keys)
        super().__init__(keys[order])
        # the last place of each is for what is not found
        self.told = np.append(~np.isnan(p[order]), False)
        self.logs, self.spares = (np.append(np.log(x[order]), 0).astype(np.float32) for x in (p, spare))
        self.whole = whole

    def log_probs(self, group: Group) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability at each place (0 where the head can't tell) and the places of those."""
        out = np.zeros(len(group.ends), np.float32)
        at = self.find(group.keys())
        found = self.told[at]
        out[found] = self.logs[at[found]]
        todo = np.flatnonzero(~found)
        if not self.whole:
            return out, todo
        for size in range(ORDER - 1, -1, -1):
            if not len(todo):
                break
            ends, salts = group.ends[todo], group.salts[todo]
            spare = self.find(gram_keys(group.points, ends - 1, size, salts))  # of the context that did not have it
            out[todo] += self.spares[spare]
            at = self.find(gram_keys(group.points, ends, size, salts))
            found = self.told[at]
            out[todo[found]] += self.logs[at[found]]
            todo = todo[~found]
        return out, todo  # left are languages without a model


def head_of(model: DataFrame, most: int) -> Head:
    """The ``most`` most frequent entries at most, by a count that none of them is below."""
    sizes = model.groupBy("weight").count().orderBy(F.desc("weight"))
    total, least = 0, None
    for r in sizes.toLocalIterator():  # a row for each different count
        total += r["count"]
        if total > most:
            break
        least = r["weight"]
    else:
        least = 0
    rows = model.where(F.lit(False) if least is None else F.col("weight") >= least).select("language", "gram", "p", F.coalesce("spare", F.lit(1.0)).alias("spare")).toArrow()
    one = lambda c: pa.concat_arrays(rows[c].chunks) if rows[c].num_chunks else pa.array([], pa.string())
    return Head(one("language"), one("gram"), rows["p"].to_numpy(), np.maximum(rows["spare"].to_numpy(), 1e-300), least == 0)


def look_up(grams: DataFrame, model: DataFrame) -> DataFrame:
    """Of distinct (language, gram) of the highest order: log_p, by joins with the model."""
    entry = model.where("p IS NOT NULL").select(F.col("language").alias("m_language"), F.col("gram").alias("m_gram"), "p")
    context = model.where("spare IS NOT NULL").select(F.col("language").alias("s_language"), F.col("gram").alias("s_gram"), "spare")
    rows = grams.select("language", "gram", F.lit(None).cast("double").alias("log_p"), F.lit(0.0).alias("sum"))
    for size in range(ORDER, -1, -1):
        tail = F.substring("gram", ORDER + 1 - size, size) if size else F.lit("")
        rows = rows.withColumn("tail", F.when(F.col("log_p").isNull(), tail))
        rows = rows.join(entry, (F.col("language") == F.col("m_language")) & (F.col("tail") == F.col("m_gram")), "left")
        rows = rows.withColumn("log_p", F.coalesce("log_p", F.col("sum") + F.log("p"))).drop("m_language", "m_gram", "p", "tail")
        if size:
            before = F.substring("gram", ORDER + 1 - size, size - 1) if size > 1 else F.lit("")
            rows = rows.withColumn("before", F.when(F.col("log_p").isNull(), before))
            rows = rows.join(context, (F.col("language") == F.col("s_language")) & (F.col("before") == F.col("s_gram")), "left")
            rows = rows.withColumn("sum", F.col("sum") + F.log(F.coalesce("spare", F.lit(1.0)))).drop("s_language", "s_gram", "spare", "before")
    return rows.select("language", "gram", "log_p")


# --- the base rules ------------------------------------------------------------------------------


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    words = common.word_hashes(raw, lower=False)
    chars = len(text) - int(np.count_nonzero(common._SPACE_TABLE[raw]))
    lines = [x for x in text.split("\n") if x.strip(common.SPACES)]
    repeated = 0
    if len(words) > 3:
        windows = common.window_hashes(words, 3)
        order = np.argsort(windows, kind="stable")
        same = windows[order][1:] == windows[order][:-1]
        if same.any():
            twice = np.zeros(len(windows), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            cover = np.zeros(len(words), bool)
            for i in range(3):
                cover[i : len(words) - 2 + i] |= twice
            repeated = int(np.count_nonzero(cover))
    return len(words), chars, int(np.count_nonzero(_SYMBOLS[raw])), len(lines) - len(set(lines)), repeated


def fails(counts: tuple[int, int, int, int, int]) -> bool:
    return counts[0] < 50 or 100 * counts[4] > 50 * counts[0]


def trusted(counts: tuple[int, ...], symbols: int) -> bool:
    """Whether the model may learn from a text: it passes the base rules, and few of its characters are symbols."""
    return not fails(counts) and 1000 * counts[2] <= symbols * counts[1]


_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

# --- verdicts ------------------------------------------------------------------------------------


def score(docs: DataFrame, head: Head) -> DataFrame:
    """Of (doc_id, language, text): doc_id, language, digest, the base counts, size (places), log_sum, and the n-grams
    that the head could not tell, each with its times."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    box = docs.sparkSession.sparkContext.broadcast(head)
    rest = pa.list_(pa.struct([("gram", pa.string()), ("times", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            languages, texts = b.column(1).to_pylist(), [t or "" for t in b.column(2).to_pylist()]
            counts = [base_counts(t) for t in texts]
            digests = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
            sums, sizes, unknown = [], [], []
            for group in groups(languages, texts):
                logs, places = box.value.log_probs(group)
                sums.append(np.add.reduceat(logs, group.firsts, dtype=np.float64))
                sizes.append(group.sizes)
                lists: list[dict[str, int]] = [{} for _ in group.languages]
                for i, place in zip(group.owner(places).tolist(), places.tolist()):
                    gram = group.gram(place)
                    lists[i][gram] = lists[i].get(gram, 0) + 1
                unknown += [[{"gram": g, "times": n} for g, n in x.items()] for x in lists]
            none = np.empty(0)
            columns = [b.column(0), b.column(1), pa.array(digests, pa.binary()), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(5))]
            columns += [pa.array(np.concatenate([none, *sizes]).astype(np.int64)), pa.array(np.concatenate([none, *sums])), pa.array(unknown, rest)]
            yield pa.record_batch(columns, names=["doc_id", "language", "digest", *_NAMES, "size", "log_sum", "unknown"])

    schema = f"doc_id {kind}, language string, digest binary, {', '.join(f'{n} long' for n in _NAMES)}, size long, log_sum double, unknown array<struct<gram: string, times: long>>"
    return docs.mapInArrow(run, schema)


def resolve(scored: DataFrame, model: DataFrame, scratch: common.Scratch) -> DataFrame:
    """``scored`` with the log-probabilities of what the head could not tell added to log_sum."""
    scored = scratch.table(scored.withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    rest = scored.where(F.size("unknown") > 0).select("row", "language", F.explode("unknown").alias("x")).select("row", "language", "x.gram", "x.times")
    found = scratch.table(look_up(rest.select("language", "gram").distinct(), model), "lm-found")
    more = rest.join(found, ["language", "gram"]).groupBy("row").agg(F.sum(F.col("times") * F.coalesce("log_p", F.lit(0.0))).alias("more"))
    return scored.join(more, "row", "left").withColumn("log_sum", F.col("log_sum") + F.coalesce("more", F.lit(0.0))).drop("more", "row", "unknown")


def _sent(table: DataFrame) -> DataFrame:
    """A table of a row a language: to every task, if there are not very many, so that a language's rows need not meet in one."""
    return F.broadcast(table) if table.count() <= MAX_BANDS_SENT else table


def quality_rules(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    spread: float = 25.0,
    margin: float = 0.85,
    low_margin: float = 0.4,
    least_count: int = 2,
    least_texts: int = 30,
    symbols: int = SYMBOLS_PERMILLE,
    head: int = 1 << 21,
) -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, perplexity, its band's ends, and kept."""
    language = F.coalesce(F.concat(F.lit("="), F.col(lang_col).cast("string")), F.lit(ALL))
    rows = docs.select(F.col(id_col).alias("doc_id"), language.alias("language"), F.col(text_col).alias("text"))
    with common.Scratch(docs.sparkSession) as scratch:
        distinct = rows.where("text IS NOT NULL").withColumn("digest", F.sha2("text", 256)).dropDuplicates(["language", "digest"])
        # a task counts several partitions' texts: the more it sees, the fewer sums it sends for each text
        tasks = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // MERGED)
        counts = scratch.table(count_grams(distinct.select("language", "text").coalesce(tasks), symbols), "lm-grams")
        # a text's end has a gram of its own, so the grams that end texts count the texts
        ends = counts.where(F.col("gram").endswith(END)).groupBy("language").agg(F.sum("n").alias("texts"))
        large = scratch.table(ends.where((F.col("texts") >= least_texts) & (F.col("language") != ALL)).select(F.col("language").alias("l_language")), "lm-languages")
        together = counts.groupBy("gram").agg(F.sum("n").alias("n")).select(F.lit(ALL).alias("language"), "gram", "n")
        own = counts.join(large, F.col("language") == F.col("l_language"), "left_semi")
        rows = rows.join(large, F.col("language") == F.col("l_language"), "left").withColumn("language", F.coalesce("l_language", F.lit(ALL))).drop("l_language")
        small = not rows.where(F.col("language") == ALL).select("language").limit(1).isEmpty()
        model = estimate(scratch.table(own.unionByName(together) if small else own, "lm-counts"), least_count, scratch)
        arrays = head_of(model, head)
        scored = scratch.table(score(rows, arrays), "lm-scores")
        if not arrays.whole:
            scored = scratch.table(resolve(scored, model, scratch), "lm-scores")
        scored = scored.withColumn("log_perplexity", -F.col("log_sum") / F.col("size"))
        scored = scored.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        few = 1000 * F.col("n_symbols") <= symbols * F.col("word_chars")
        judged = scored.where(~F.col("base_failed") & few).groupBy("language", "digest").agg(F.first("log_perplexity").alias("x"))
        if small:  # the band of all languages together is taken over texts of all of them
            judged = judged.where(F.col("language") != ALL)
            pool = score(distinct.select(F.col("digest").alias("doc_id"), F.lit(ALL).alias("language"), "text"), arrays)
            if not arrays.whole:
                pool = resolve(pool, model, scratch)
            pool = pool.where((F.col("n_words") >= 50) & (100 * F.col("n_repeat_words") <= 50 * F.col("n_words")) & few)
            judged = judged.unionByName(pool.groupBy("language", "digest").agg(F.first(-F.col("log_sum") / F.col("size")).alias("x")))
        judged = scratch.table(judged, "lm-judged")
        middle = F.percentile_approx("x", F.lit(0.5), F.lit(10_000))
        middles = scratch.table(judged.groupBy(F.col("language").alias("b_language")).agg(middle.alias("middle")), "lm-middles")
        away = judged.join(_sent(middles), F.col("language") == F.col("b_language")).withColumn("x", F.abs(F.col("x") - F.col("middle")))
        bands = away.groupBy("b_language").agg(F.first("middle").alias("middle"), (spread * middle).alias("wide"))
        low, high = (F.greatest(F.lit(m), F.col("wide")) for m in (low_margin, margin))
        bands = scratch.table(bands.select("b_language", F.exp(F.col("middle") - low).alias("band_low"), F.exp(F.col("middle") + high).alias("band_high")), "lm-bands")
        out = scored.join(_sent(bands), F.col("language") == F.col("b_language"), "left").withColumn("perplexity", F.exp("log_perplexity"))
        kept = ~F.col("base_failed") & F.coalesce(F.col("perplexity").between(F.col("band_low"), F.col("band_high")), F.lit(True))
        out = out.select("doc_id", *_NAMES, "base_failed", kept.alias("kept"), "perplexity", "band_low", "band_high")
        return scratch.keep(scratch.table(out, "lm-verdicts"))


def op3_perplexity(spark, sf_dir: str) -> DataFrame:
    return quality_rules(common.documents(spark, sf_dir))
