"""Token counts through a digest cache.

What is digested is a text's normal form under its tokenizer: where the tokenizer's file says that runs of spaces
count as one and those at the ends as none, texts that differ in them alone share a digest; where its normaliser is the
identity, the normal form is the text. The cache holds one row of (digest, tokenizer version, n_tokens). The version
is a digest of the tokenizer's file and its library's version, so a new file or library never reads old counts. Texts
whose pair is not in the cache are made distinct by digest (partial aggregation first, so a text that a third of all
rows share reaches the shuffle once a task), encoded once, and appended; then all rows read their counts from the
cache, hot digests dealt over many tasks. A repeated or racing append may leave a pair more than one row, all equal;
reading makes the pairs distinct, so a result never doubles.

Edge cases: null text counts as empty; an empty table gives an empty result and an empty append; rows with the same
id or text keep a row each; other columns of the input are ignored; texts are never cut.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CACHE_SCHEMA = "digest string, tokenizer string, n_tokens long"
#: A tokenizer file goes to the executors inside the task; no larger file is taken.
MAX_FILE_BYTES = 64 << 20
#: Texts are encoded in groups of about so many characters, which bounds a worker's memory.
GROUP_CHARS = 1 << 21


@lru_cache(maxsize=2)
def _counter(kind: str, blob: bytes):
    """A function from texts to their token counts."""
    if kind == "sentencepiece":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=blob)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(blob.decode())
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(model.encode(t, add_special_tokens=False).ids) for t in texts]


class TokenizerFile:
    """A tokenizer's file, read on the driver: its library, content and version digest."""

    def __init__(self, path: str):
        self.kind = "sentencepiece" if path.endswith(".model") else "tokenizers"
        with open(path, "rb") as f:
            self.blob = f.read()
        if len(self.blob) > MAX_FILE_BYTES:
            raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} bytes")
        self.version = hashlib.sha256(f"{self.kind} {importlib.metadata.version(self.kind)}\0".encode() + self.blob).hexdigest()[:32]

    def normal_form(self, text: Column) -> Column:
        """The text as the tokenizer sees it, as far as that is sure to leave the count as it is."""
        if self.kind == "sentencepiece":
            from sentencepiece import sentencepiece_model_pb2

            model = sentencepiece_model_pb2.ModelProto()
            model.ParseFromString(self.blob)
            if model.normalizer_spec.remove_extra_whitespaces:
                return F.btrim(F.regexp_replace(text, " {2,}", " "), F.lit(" "))
        return text

    def count(self, texts: list[str]) -> list[int]:
        return _counter(self.kind, self.blob)(texts)


def groups(texts: list[str]) -> Iterator[list[str]]:
    group, chars = [], 0
    for t in texts:
        group.append(t)
        chars += len(t)
        if chars >= GROUP_CHARS:
            yield group
            group, chars = [], 0
    if group:
        yield group


def token_counts(
    docs: DataFrame, tokenizer_path: str, cache_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit; the cache at ``cache_path`` gains what it lacked."""
    spark = docs.sparkSession
    file = TokenizerFile(tokenizer_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    normal = file.normal_form(text)
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(normal, 256).alias("digest"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [n for g in groups(b.column(1).to_pylist()) for n in file.count(g)]
            yield pa.record_batch([b.column(0), pa.array([file.version] * len(counts), pa.string()), pa.array(counts, pa.int64())], names=["digest", "tokenizer", "n_tokens"])

    with common.Scratch(spark) as scratch:
        keyed = scratch.table(keyed, "token-digests")
        misses = docs.select(F.sha2(normal, 256).alias("digest"), normal.alias("text"))
        known = read_cache(spark, cache_path, file.version)
        if known is not None:
            misses = misses.join(known.select("digest"), "digest", "left_anti")
        with common.swept(spark):
            misses.dropDuplicates(["digest"]).mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
        out = common.look_up(keyed, read_cache(spark, cache_path, file.version), "digest")
        out = out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
        return scratch.keep(scratch.table(out, "token-counts"))


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame | None:
    """digest and n_tokens of the pairs with this tokenizer version, each once; None where there is no cache yet."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return None
    rows = spark.read.schema(CACHE_SCHEMA).parquet(path).where(F.col("tokenizer") == version)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(common.documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), common.scratch_path(spark, "token-cache"))
