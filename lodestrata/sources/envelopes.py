"""Readers of search results: JSON envelopes, agent logs, paged replays. Every row carries its ordinals."""

from __future__ import annotations

import io
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.values import whole_json
from ..schema import ENVELOPE, RESULT, fields


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON by schema; an absent path is an empty table, a broken file an error."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], fields(schema))
    return spark.read.schema(fields(schema)).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a document {metadata, jobs} or of a bare array, with their place as ``ord``."""
    rows = fields(schema)
    text = spark.read.text(path, wholetext=True)
    bare = F.from_json("value", f"array<struct<{', '.join(f'`{f.name}`: {f.dataType.simpleString()}' for f in rows)}>>")
    inner = F.from_json("value", f"jobs array<struct<{', '.join(f'`{f.name}`: {f.dataType.simpleString()}' for f in rows)}>>")["jobs"]
    items = F.when(F.ltrim(F.col("value")).startswith("["), bare).otherwise(inner)
    return text.select(F.posexplode(items).alias("ord", "row")).select("ord", "row.*")


def read_envelopes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A row a batch: file, batch_idx, query, mode, page, round, results. A batch without results is an error."""
    df = spark.read.schema(fields(ENVELOPE)).option("multiLine", True).json(paths).select("*", F.col("_metadata.file_name").alias("file"))
    df = df.select("file", "captured_at", F.posexplode(F.coalesce("queries", "batches")).alias("batch_idx", "batch")).select("file", "captured_at", "batch_idx", "batch.*")
    return df.withColumn("results", F.when(F.col("results").isNull(), F.raise_error(F.concat(F.lit("a batch lacks results: "), F.coalesce("query", F.lit("?"))))).otherwise(F.col("results")))


def explode_results(batches: DataFrame, provider: str, collected_at: str) -> DataFrame:
    """A row a result with batch_idx, result_idx and rank; one with null result columns for an empty batch."""
    df = batches.select(*(c for c in batches.columns if c != "results"), F.posexplode_outer("results").alias("result_idx", "r"))
    return df.select("*", "r.*", (F.col("result_idx") + 1).alias("rank"), F.lit(provider).alias("provider"), F.lit(collected_at).alias("collected_at")).drop("r")


def request_totals(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    df = spark.read.schema(fields(ENVELOPE)).option("multiLine", True).json(paths)
    return df.agg(F.sum("request_count").alias("request_count"), F.sum("query_count").alias("query_count"))


def parse_agent_output(logs: DataFrame) -> DataFrame:
    """Of (file, line_no, value), lines of an agent's log: file and its last JSON message.

    The whole text counts if it is JSON; else the last line that is a message with text; else a fenced block.
    """
    whole = logs.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda x: x["value"]), "\n").alias("text"))
    message = F.coalesce(F.get_json_object("value", "$.item.text"), F.get_json_object("value", "$.message"), F.get_json_object("value", "$.text"))
    last = logs.withColumn("m", message).groupBy("file").agg(F.max_by("m", F.when(F.col("m").isNotNull(), F.col("line_no"))).alias("last"))
    parses = lambda c: F.when(whole_json(c).isNotNull(), c)
    fenced = lambda c: F.nullif(F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    text = lambda c: F.coalesce(parses(F.col(c)), parses(fenced(F.col(c))))
    return whole.join(last, "file", "left").select("file", F.coalesce(text("last"), text("text")).alias("json"))


class ReplaySource(DataSource):
    """``spark.read.format("search_replay")``: recorded pages of a search, a file of JSON lines a query, a partition a file."""

    @classmethod
    def name(cls) -> str:
        return "search_replay"

    def schema(self) -> str:
        return "query string, page int, url string, title string, description string"

    def reader(self, schema):
        return _ReplayReader(self.options.get("paths", "").split(","))


class _ReplayReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = [p for p in paths if p]

    def partitions(self):
        return [InputPartition(p) for p in self.paths] or [InputPartition("")]

    def read(self, partition):
        from pyarrow import fs

        if not partition.value:
            return
        files, path = fs.FileSystem.from_uri(partition.value)  # tasks have no JVM and maybe no local copy
        with files.open_input_stream(path) as f:
            for line in io.TextIOWrapper(f, encoding="utf-8"):
                page = json.loads(line)
                for r in page.get("results", []):
                    yield page.get("query"), page.get("page"), r.get("url"), r.get("title"), r.get("description")


RESULT_FIELDS = RESULT
