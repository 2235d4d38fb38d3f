"""Language ID with a linear-chain conditional random field over words.

A word's features are hashed character n-grams of 1 to 4 with its ends marked (so affixes are features), and whether
it stands in a language's lexicon, learned too. Transitions between the languages of neighbouring words are learned
with them, by maximum likelihood with Adam, on windows of words from a bounded sample of labelled documents; part of
the windows are spliced from two languages, as labels say nothing of switches inside a text. Forward-backward gives
every word of a text its posterior; the text's language is the one with the highest mean posterior, which is the
score.

Scoring is vectorised: texts of a batch stand in order of length and take each step of the recursion together; a word
is turned into its emissions once for each worker. Every language of the labels is learned. The sample is bounded by
three parameters: some ``per_lang`` documents of each language, drawn by a digest of id and text, ``doc_windows`` windows
of ``width`` words of each, and ``max_words`` words in all; where there are more a seeded choice stays, of whole texts.
So model and sample grow with the number of languages and not with the corpus, whatever rows share an id.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; so are all texts where nothing is
labelled; rows with the same id keep a row each; an empty table gives an empty result; other columns are ignored;
texts are scored whole. ``keep_known`` returns the columns of its input, of any names; null and empty texts go, ties
between languages fall to the first by name, and repeated rows get one verdict.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def _other_numbers() -> str:
    """Ranges, for a set of a pattern, of the characters that count as word characters and are neither letters nor digits."""
    odd = [c for c in range(sys.maxunicode + 1) if chr(c).isalnum() and unicodedata.category(chr(c))[0] != "L" and not chr(c).isdecimal()]
    cuts = [i for i, c in enumerate(odd) if not i or odd[i - 1] != c - 1] + [len(odd)]
    return "".join(f"{chr(odd[a])}-{chr(odd[b - 1])}" for a, b in zip(cuts, cuts[1:]))


#: A word is a run of letters, of Unicode's category L: number signs such as halves, squares and Roman numerals are none.
LETTERS = re.compile(rf"[^\W\d_{_other_numbers()}]+")
BITS = 16
#: A worker's memory of words is emptied at this size.
MEMORY = 300_000
#: Words that go through the recursion together.
GROUP_WORDS = 400_000


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of word number and hashed n-gram, n from 1 to 4, of the words with their ends marked."""
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    rows, features = [], []
    with np.errstate(over="ignore"):
        h = points * np.uint64(0x9E3779B97F4A7C15)
        for n in range(1, 5):
            if n > 1:
                h = h[:-1] * np.uint64(0xD6E8FEB86659FD93) + points[n - 1 :]
            if not len(h):
                break
            inside = owner[: len(h)] == owner[n - 1 :]
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(n)
            rows.append(owner[: len(h)][inside])
            features.append((mixed[inside] >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(features)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # of hashed n-grams and, behind them, of being in each language's lexicon
    lexicon: dict[str, list[int]]
    transitions: np.ndarray
    starts: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """Score of each word under each language."""
        rows, features = with_lexicon(words, self.lexicon)
        return np.stack([np.bincount(rows, w[features], len(words)) for w in self.weights.T], 1)


def with_lexicon(words: list[str], lexicon: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    rows, features = word_features(words)
    known = [(i, (1 << BITS) + k) for i, w in enumerate(words) for k in lexicon.get(w, ())]
    if known:
        more = np.array(known, np.int64)
        rows, features = np.concatenate([rows, more[:, 0]]), np.concatenate([features, more[:, 1]])
    return rows, features


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of every word, and the expected transitions, summed.

    ``scores`` holds the words of all sequences one after another; ``lengths`` fall. At step t the sequences longer
    than t, a prefix of all, move together.
    """
    size = scores.shape[1]
    offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    e = np.exp(scores - scores.max(1, keepdims=True))
    move, first = np.exp(transitions), np.exp(starts)
    alpha = np.empty_like(e)
    active = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), "right")  # sequences of t + 1 words or more
    now = e[offsets] * first
    alpha[offsets] = now = now / now.sum(1, keepdims=True)
    for t in range(1, len(active)):
        at = offsets[: active[t]] + t
        now = (now[: active[t]] @ move) * e[at]
        now /= now.sum(1, keepdims=True)
        alpha[at] = now
    flow = np.zeros((size, size))
    beta = np.ones((len(lengths), size))
    post = np.empty_like(e)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = offsets[:k] + t
        p = alpha[at] * beta[:k]
        post[at] = p / p.sum(1, keepdims=True)
        if t:
            weighted = e[at] * beta[:k]
            before = alpha[at - 1]
            scale = 1 / np.einsum("ki,ij,kj->k", before, move, weighted)
            flow += np.einsum("ki,kj->ij", before * scale[:, None], weighted) * move
            beta[:k] = weighted @ move.T
            beta[:k] /= beta[:k].sum(1, keepdims=True)
    return post, flow


def train(sample: list[tuple[str, list[list[str]]]], *, steps: int = 45, splice: float = 0.35, decay: float = 1e-3, seed: int = 7) -> Model | None:
    """Of (language, windows of words): the model, None without any."""
    languages = sorted({lang for lang, windows in sample if any(windows)})
    if not languages:
        return None
    number = {lang: i for i, lang in enumerate(languages)}
    rng = np.random.default_rng(seed)
    plain = [(number[lang], w) for lang, windows in sample for w in windows if w]
    sequences: list[tuple[list[str], np.ndarray]] = []
    for i, (label, words) in enumerate(plain):
        other, more = plain[int(rng.integers(len(plain)))]
        if rng.random() < splice and other != label:
            a, b = int(rng.integers(1, len(words) + 1)), int(rng.integers(len(more)))
            sequences.append((words[:a] + more[b:], np.r_[np.full(a, label), np.full(len(more) - b, other)]))
        else:
            sequences.append((words, np.full(len(words), label)))
    sequences.sort(key=lambda s: -len(s[0]))
    counts = [Counter() for _ in languages]
    for words, labels in sequences:
        for w, k in zip(words, labels):
            counts[k][w] += 1
    total = sum(counts, Counter())
    lexicon: dict[str, list[int]] = {}
    for k, c in enumerate(counts):
        for w, n in c.items():
            if n >= 3 and n >= 0.8 * total[w]:
                lexicon.setdefault(w, []).append(k)
    vocabulary = {w: i for i, w in enumerate(total)}
    rows, features = with_lexicon(list(vocabulary), lexicon)
    ids = np.array([vocabulary[w] for words, _ in sequences for w in words])
    labels = np.concatenate([y for _, y in sequences])
    lengths = np.array([len(words) for words, _ in sequences])
    size, begins = len(languages), np.concatenate([[0], np.cumsum(lengths)[:-1]])
    follows = np.ones(len(ids), bool)
    follows[begins] = False
    seen = np.zeros((size, size))
    np.add.at(seen, (labels[:-1][follows[1:]], labels[1:][follows[1:]]), 1)
    truth = np.eye(size)[labels]
    params = [np.zeros(((1 << BITS) + size, size)), np.zeros((size, size)), np.zeros(size)]
    means, squares = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        w, a, s = params
        by_word = np.stack([np.bincount(rows, x[features], len(vocabulary)) for x in w.T], 1)
        post, flow = forward_backward(by_word[ids], lengths, a, s)
        off = truth - post
        by_word = np.stack([np.bincount(ids, x, len(vocabulary)) for x in off.T], 1)
        grads = [np.stack([np.bincount(features, x[rows], len(w)) for x in by_word.T], 1), seen - flow, off[begins].sum(0)]
        for i, g in enumerate(grads):
            g = g / len(sequences) - decay * params[i]
            means[i] = 0.9 * means[i] + 0.1 * g
            squares[i] = 0.99 * squares[i] + 0.01 * g * g
            params[i] = params[i] + 0.1 * (means[i] / (1 - 0.9**step)) / (np.sqrt(squares[i] / (1 - 0.99**step)) + 1e-6)
    return Model(languages, params[0], lexicon, params[1], params[2])


#: A table of languages of at most so many rows is broadcast.
MAX_LANGUAGES_SENT = 100_000


def sample_windows(docs: DataFrame, *, per_lang: int, max_words: int, doc_windows: int, width: int, seed: str) -> list[tuple[str, list[list[str]]]]:
    """Of (doc_id, text, lang): the texts of a bounded sample, spread evenly over the languages, in windows of words."""
    name = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5("text"))
    place = F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") / float(16**13)
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("place", place)
    sizes = labelled.groupBy(F.col("lang").alias("s_lang")).agg(F.count("*").alias("s_n"))
    if sizes.count() <= MAX_LANGUAGES_SENT:
        sizes = F.broadcast(sizes)
    drawn = labelled.join(sizes, F.col("lang") == F.col("s_lang")).where(F.col("place") < F.lit(float(per_lang)) / F.col("s_n")).select("lang", "place", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, places, texts = (c.to_pylist() for c in b.columns)
            out = []
            for at, text in zip(places, texts):
                words = LETTERS.findall(text.lower())
                starts = range(0, len(words), width)
                if len(starts) > doc_windows:
                    starts = sorted(np.random.default_rng(int(at * 2**52)).choice(len(starts), doc_windows, replace=False) * width)
                out.append([" ".join(words[i : i + width]) for i in starts])
            yield pa.record_batch([pa.array(langs, pa.string()), pa.array(places, pa.float64()), pa.array(out, pa.list_(pa.string()))], names=["lang", "place", "windows"])

    # rows equal in id and text have one place and are one row; all others' places are independent of each other
    rows = drawn.dropDuplicates(["lang", "place"]).mapInArrow(run, "lang string, place double, windows array<string>").collect()
    rows.sort(key=lambda r: (r["place"], r["lang"]))
    windows = [(r["lang"], [w.split()]) for r in rows for w in r["windows"]]
    order = np.random.default_rng(int(hashlib.sha256(seed.encode()).hexdigest()[:8], 16)).permutation(len(windows))
    total, chosen = 0, []
    for i in order.tolist():
        total += len(windows[i][1][0])
        if total > max_words and chosen:
            break
        chosen.append(windows[i])
    return chosen


class _Words(dict):
    """Numbers words as they come."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


Verdict = tuple[str, float, list[tuple[str, int, int]]]
UNDETERMINED: Verdict = ("und", 0.0, [])


def _runs(labels: np.ndarray, languages: list[str]) -> list[tuple[str, int, int]]:
    """Language, first word and end of each run of equal labels."""
    cuts = [0, *(np.flatnonzero(labels[1:] != labels[:-1]) + 1).tolist(), len(labels)]
    return [(languages[labels[a]], a, b) for a, b in zip(cuts, cuts[1:])]


def _predict(model: Model, texts: Iterator[list[str | None]], runs: bool = False) -> Iterator[list[Verdict]]:
    """Language, score and, if asked for, runs of words of each text."""
    words, table = _Words(), np.empty((0, len(model.languages)))

    def settle(ids: list[np.ndarray]) -> Iterator[Verdict]:
        """The verdict on each sequence of word numbers, none empty, by its mean posteriors."""
        nonlocal table
        if words.new:
            parts = [words.new[i : i + 20_000] for i in range(0, len(words.new), 20_000)]
            table = np.concatenate([table, *map(model.emissions, parts)])
            words.new = []
        lengths = np.array([len(x) for x in ids])
        order = np.argsort(-lengths, kind="stable")
        flat = np.concatenate([ids[i] for i in order])
        post, _ = forward_backward(table[flat], lengths[order], model.transitions, model.starts)
        ends = np.cumsum(lengths[order])
        means = np.add.reduceat(post, np.concatenate([[0], ends[:-1]])) / lengths[order][:, None]
        labels = post.argmax(1) if runs else None
        place = np.argsort(order)
        for i in range(len(ids)):
            p, end = means[place[i]], int(ends[place[i]])
            yield model.languages[int(p.argmax())], min(1.0, float(p.max())), _runs(labels[end - lengths[i] : end], model.languages) if runs else []

    for batch in texts:
        results = [UNDETERMINED] * len(batch)
        at, ids, n = [], [], 0
        for i, text in enumerate(batch):
            if found := LETTERS.findall((text or "").lower()):
                ids.append(np.fromiter(map(words.__getitem__, found), np.int64, len(found)))
                at.append(i)
                n += len(found)
            if at and (n >= GROUP_WORDS or i == len(batch) - 1):
                for k, verdict in zip(at, settle(ids)):
                    results[k] = verdict
                at, ids, n = [], [], 0
                if len(words) > MEMORY:
                    words, table = _Words(), table[:0]
        if at:
            for k, verdict in zip(at, settle(ids)):
                results[k] = verdict
        yield results


def predict(docs: DataFrame, model: Model | None, *keep: str, text_col: str = "text", runs: bool = False) -> DataFrame:
    """The columns ``keep`` of every row, with lang_pred and score.

    With ``runs`` also how the text switches: a list of runs of words (lang, first word, end), words being those of
    ``LETTERS``; an undetermined text has none.
    """
    narrow = docs.select(*keep, F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def texts() -> Iterator[list[str | None]]:
            for b in batches:
                held.append(b)
                yield b.column(len(keep)).to_pylist()

        found = _predict(model, texts(), runs) if model else ([UNDETERMINED] * len(t) for t in texts())
        for results in found:
            b = held.pop()
            columns = [*b.columns[: len(keep)], pa.array([r[0] for r in results], pa.string()), pa.array([r[1] for r in results], pa.float64())]
            names = [*keep, "lang_pred", "score"]
            if runs:
                columns.append(pa.array([[{"lang": x, "first": i, "end": j} for x, i, j in r[2]] for r in results], pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("end", pa.int32())]))))
                names.append("runs")
            yield pa.record_batch(columns, names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    more = ", runs array<struct<lang: string, first: int, end: int>>" if runs else ""
    return narrow.mapInArrow(run, f"{schema}, lang_pred string, score double{more}")


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(n))


def fit(docs: DataFrame, *, per_lang: int = 150, max_words: int = 200_000, doc_windows: int = 200, width: int = 30, seed: str = "langid-1") -> Model | None:
    """Of (doc_id, text, lang): a model learned from all rows given, by a bounded sample."""
    return train(sample_windows(docs, per_lang=per_lang, max_words=max_words, doc_windows=doc_windows, width=width, seed=seed))


def keep_known(docs: DataFrame, *, least: float = 1.05, **sample) -> DataFrame:
    """``docs`` (with doc_id, text, lang) without the rows whose text has no language, or hardly one.

    Hardly one means that no language's posterior is ``least`` times what each would have if all were alike: a short
    text in a mixture of languages, or of names and numbers, stays. Only the text goes to Python; the other columns wait in the JVM.
    """
    model = fit(docs.select("doc_id", "text", "lang"), **sample)
    floor = min(1.0, least / len(model.languages)) if model else 0.0

    @F.pandas_udf("boolean")
    def known(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        given = ([None if t is None else str(t) for t in part] for part in texts)
        found = _predict(model, given) if model else ([UNDETERMINED] * len(t) for t in given)
        for results in found:
            yield pd.Series([lang != "und" and score >= floor for lang, score, _ in results], dtype=bool)

    return docs.where(known("text"))


def op5_crf_langid(spark, sf_dir: str) -> DataFrame:
    from . import common

    docs = common.documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = fit(docs.where(fold(F.col("doc_id"), 5) != 0))
    return predict(docs, model, "doc_id").select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
