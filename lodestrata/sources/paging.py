"""A paged search as a Spark data source, to be read as a stream or at once.

The offset of the stream is a page number: micro-batch n fetches page n of every query that is still open, in one
partition for each group of queries. A query is open until a page says that there are no more, or has fewer results than
asked for, or the limit of pages is reached. What a request brought is put under ``state`` before it is handed on, in a
file of its own that appears whole or not at all; a page that has such a file is read from it. So a batch that runs
again, or a collection that starts again, fetches no page twice, and planning needs nothing but the files' names. The
folder belongs to one signature (provider, pages, count and plan): another plan begins a collection of its own.

Network errors, 429 and 5xx are tried again after 1.5 s times the number of tries so far; any other status fails at
once. Requests of a partition keep ``delay_ms`` between them.

Options: ``plan`` (JSON: a list of {mode, query}), ``state``, ``pages``, ``count``, ``delay_ms``, ``max_attempts``,
``backoff_s``, ``concurrency`` (partitions), ``transport`` (rest, replay or module:function) and those of the transport.
Folders are reached through pyarrow's file systems, as tasks have no JVM: file, hdfs, s3 and gs paths.

Edge cases: an empty plan gives no rows; a query that comes twice in a plan is fetched for each mode; a page without
results is a row with an empty list; a null title, url or description stays null.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .plan import signature

RESULT_NAMES = ("title", "url", "description")
SCHEMA = "mode string, query string, page int, results array<struct<title: string, url: string, description: string, extra_snippets: array<string>>>, moreResultsAvailable boolean"
#: A transport answers (query, page, attempt, options) with a status and the body's text, or raises OSError.
Transport = Callable[[str, int, int, dict], tuple[int, str]]


class SourceError(RuntimeError):
    """A request failed for good."""


# --- transports ---------------------------------------------------------------------------------

#: The parameters of the web search request.
REST_PARAMETERS = {"country": "CN", "search_lang": "zh-hans", "extra_snippets": "true", "result_filter": "web"}


def rest(query: str, page: int, attempt: int, options: dict) -> tuple[int, str]:
    """GET ``endpoint``; the key stands in the environment variable that ``key_env`` names."""
    key = os.environ.get(options.get("key_env", "SEARCH_API_KEY"))
    if not key:
        raise SourceError("the search key is not set")
    asked = {"q": query, "count": options["count"], "offset": page, **REST_PARAMETERS}
    request = urllib.request.Request(f"{options['endpoint']}?{urllib.parse.urlencode(asked)}", headers={"Accept": "application/json", "X-Subscription-Token": key})
    try:
        with urllib.request.urlopen(request, timeout=float(options.get("timeout_s", 30))) as got:
            return got.status, got.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode(errors="replace")


def replay(query: str, page: int, attempt: int, options: dict) -> tuple[int, str]:
    """Recorded answers under ``replay``, as ``record`` writes them; ``fails`` are the statuses of the first tries, -1 for none.

    With ``log`` every request leaves a file there.
    """
    if options.get("log"):
        files, log = _files(options["log"])
        files.create_dir(log, recursive=True)
        with files.open_output_stream(f"{log}/{hashlib.md5(query.encode()).hexdigest()}-{page}-{attempt}-{uuid.uuid4().hex}"):
            pass
    fails, body = _recorded(options["replay"], _bucket(query, int(options.get("replay_buckets", REPLAY_BUCKETS))), query, page) or ([], None)
    if attempt <= len(fails):
        if fails[attempt - 1] < 0:
            raise ConnectionError("no answer")
        return fails[attempt - 1], "recorded failure"
    return (200, body) if body is not None else (404, "nothing recorded")


REPLAY_BUCKETS = 16


def _bucket(query: str, buckets: int) -> int:
    return zlib.crc32(query.encode()) % buckets


#: Bytes of a row group of recorded answers; a worker holds the answers of GROUPS_HELD of them and no more.
GROUP_BYTES = 1 << 20
GROUPS_HELD = 2


@lru_cache(maxsize=64)
def _groups(root: str, bucket: int) -> list[tuple[str, int, tuple | None, tuple | None]]:
    """Of a bucket's row groups: file, number, and the least and the greatest query and page, None where that is not known."""
    import pyarrow.parquet as pq

    from pyarrow import fs

    files, path = _files(f"{root}/bucket={bucket}")
    found = []
    for file in files.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if not file.base_name.endswith(".parquet"):
            continue
        with files.open_input_file(file.path) as source:
            meta = pq.ParquetFile(source).metadata
        for n in range(meta.num_row_groups):
            group = meta.row_group(n)
            ranges = {c.path_in_schema: c.statistics for c in map(group.column, range(group.num_columns)) if c.path_in_schema in ("query", "page")}
            known = [s if s is not None and s.has_min_max else None for s in (ranges.get("query"), ranges.get("page"))]
            found.append((file.path, n, *(s and (s.min, s.max) for s in known)))
    return found


@lru_cache(maxsize=GROUPS_HELD)
def _group(root: str, file: str, n: int) -> dict[tuple[str, int], tuple[list[int], str]]:
    import pyarrow.parquet as pq

    files, _ = _files(root)
    with files.open_input_file(file) as source:
        rows = pq.ParquetFile(source).read_row_group(n, ["query", "page", "fails", "body"]).to_pylist()
    return {(r["query"], r["page"]): (r["fails"] or [], r["body"]) for r in rows}


def _recorded(root: str, bucket: int, query: str, page: int) -> tuple[list[int], str] | None:
    within = lambda value, ends: ends is None or ends[0] <= value <= ends[1]
    for file, n, queries, pages in _groups(root, bucket):
        if within(query, queries) and within(page, pages):
            got = _group(root, file, n).get((query, page))
            if got is not None:
                return got
    return None


def record(pages: DataFrame, root: str, buckets: int = REPLAY_BUCKETS) -> None:
    """Write answers (query, page, fails array<int>, body) for ``replay``, dealt by query, by page and query in small row groups."""
    bucket = F.crc32("query") % buckets
    rows = pages.select("query", F.col("page").cast("long").alias("page"), F.col("fails").cast("array<int>").alias("fails"), "body", bucket.alias("bucket")).repartition(buckets, "bucket")
    small = {"parquet.block.size": str(GROUP_BYTES), "parquet.page.size.row.check.min": "10", "parquet.block.size.row.check.min": "10"}
    rows.sortWithinPartitions("bucket", "page", "query").write.options(**small).partitionBy("bucket").parquet(root)


def _replay_place(query: str, options: dict) -> tuple[int, str]:
    """Recorded answers lie by bucket and query; asked in that order, each row group is read once."""
    return _bucket(query, int(options.get("replay_buckets", REPLAY_BUCKETS))), query


#: The order in which a transport would be asked for the queries of a page; none for the plan's.
PLACES = {"replay": _replay_place}
TRANSPORTS = {"rest": rest, "replay": replay}


def _transport(name: str) -> Transport:
    if name in TRANSPORTS:
        return TRANSPORTS[name]
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


# --- pages and their files ----------------------------------------------------------------------


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def fetch(query: str, page: int, options: dict, wait: Callable[[float], None] = time.sleep) -> dict:
    """One page from the transport: {results, moreResultsAvailable}."""
    ask, most = _transport(options.get("transport", "rest")), int(options.get("max_attempts", 3))
    backoff = float(options.get("backoff_s", 1.5))
    for attempt in range(1, most + 1):
        try:
            status, text = ask(query, page, attempt, options)
        except OSError as e:
            if attempt == most:
                raise SourceError(f"no answer after {most} tries: {e}") from e
            wait(backoff * attempt)
            continue
        if 200 <= status < 300:
            body = json.loads(text)
            return {"results": (body.get("web") or {}).get("results") or [], "moreResultsAvailable": (body.get("query") or {}).get("more_results_available") is True}
        if (status == 429 or status >= 500) and attempt < most:
            wait(backoff * attempt)
            continue
        raise SourceError(f"HTTP {status} {text[:300]}")
    raise SourceError("no try was allowed")


class _Collection:
    """The plan, its limits, and the files of pages that have been fetched."""

    def __init__(self, options: dict):
        self.options = {k: v for k, v in dict(options).items() if k != "plan"}
        self.plan = json.loads(options.get("plan", "[]"))
        self.pages, self.count = int(options.get("pages", 3)), int(options.get("count", 20))
        self.options["count"] = str(self.count)
        self.sign = signature(options.get("provider", "search"), self.pages, self.count, self.plan)
        self.root = f"{options['state'].rstrip('/')}/{self.sign[:16]}"

    def fetched(self, page: int) -> dict[int, bool]:
        """Of the queries whose page is there, by place in the plan: whether a next page is to be fetched."""
        from pyarrow import fs

        files, path = _files(f"{self.root}/page={page:06d}")
        found = files.get_file_info(fs.FileSelector(path, allow_not_found=True))
        names = [f.base_name for f in found if f.base_name.endswith(".json")]
        return {int(n.split("-")[0]): n.endswith("-more.json") for n in names}

    def open_at(self, page: int) -> list[int]:
        """Queries that have this page, as far as the pages before it are there."""
        if page >= self.pages:
            return []
        return list(range(len(self.plan))) if not page else sorted(i for i, more in self.fetched(page - 1).items() if more)

    def latest(self) -> int:
        """One past the last page that can be planned."""
        for page in range(self.pages):
            want = self.open_at(page)
            if not want:
                return page
            if not set(want) <= set(self.fetched(page)):
                return page + 1
        return self.pages

    def __getstate__(self) -> dict:
        """Tasks get their queries by their partition, and so no copy of the plan."""
        return {**self.__dict__, "plan": []}

    def deal(self, queries: list[int]) -> list[list[tuple[int, dict]]]:
        """Place in the plan and entry of the queries of each partition, in the order in which the transport would be asked."""
        width = max(1, min(len(queries), int(self.options.get("concurrency", 8))))
        place = PLACES.get(self.options.get("transport", "rest"))
        if place:
            queries = sorted(queries, key=lambda i: place(self.plan[i]["query"], self.options))
        cuts = [len(queries) * k // width for k in range(width + 1)]
        parts = [queries[a:b] for a, b in zip(cuts, cuts[1:])] if place else [queries[k::width] for k in range(width)]
        return [[(i, self.plan[i]) for i in part] for part in parts if part]

    def page(self, i: int, asked: dict, page: int, fetched: dict[int, bool], pause: Callable[[], None]) -> dict:
        """The page from its file, or fetched and then kept there."""
        files, folder = _files(f"{self.root}/page={page:06d}")
        if i in fetched:
            with files.open_input_stream(f"{folder}/{i:09d}-{'more' if fetched[i] else 'last'}.json") as f:
                return json.loads(f.read())
        pause()
        got = {**asked, "page": page, **fetch(asked["query"], page, self.options)}
        more = got["moreResultsAvailable"] and len(got["results"]) >= self.count
        files.create_dir(folder, recursive=True)
        name = f"{folder}/{i:09d}-{'more' if more else 'last'}.json"
        with files.open_output_stream(part := f"{name}.{uuid.uuid4().hex}") as f:
            f.write(json.dumps(got).encode())
        files.move(part, name)
        fetched[i] = more
        return got


def _row(batch: dict) -> tuple:
    results = [tuple(r.get(n) for n in RESULT_NAMES) + (r.get("extra_snippets"),) for r in batch["results"]]
    return batch.get("mode"), batch["query"], batch["page"], results, batch["moreResultsAvailable"]


def _pacer(delay_ms: float, now: Callable[[], float] = time.monotonic, wait: Callable[[float], None] = time.sleep) -> Callable[[], None]:
    last: list[float] = []

    def pause() -> None:
        if last and (left := delay_ms / 1000 - (now() - last[0])) > 0:
            wait(left)
        last[:] = [now()]

    return pause


# --- the data source ----------------------------------------------------------------------------


class PagedSearch(DataSource):
    """``spark.readStream.format("paged_search")`` and ``spark.read.format("paged_search")``."""

    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Pages(dict(self.options))

    def reader(self, schema) -> DataSourceReader:
        return _Queries(dict(self.options))


class _Pages(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.collection = _Collection(options)

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        return {"page": self.collection.latest()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition((page, part)) for page in range(start["page"], end["page"]) for part in self.collection.deal(self.collection.open_at(page))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        page, queries = partition.value
        fetched, pause = self.collection.fetched(page), _pacer(float(self.collection.options.get("delay_ms", 0)))
        for i, asked in queries:
            yield _row(self.collection.page(i, asked, page, fetched, pause))


class _Queries(DataSourceReader):
    def __init__(self, options: dict):
        self.collection = _Collection(options)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(part) for part in self.collection.deal(list(range(len(self.collection.plan))))] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        pause, left = _pacer(float(self.collection.options.get("delay_ms", 0))), list(partition.value)
        for page in range(self.collection.pages):
            if not left:
                return
            fetched = self.collection.fetched(page)
            for i, asked in left:
                yield _row(self.collection.page(i, asked, page, fetched, pause))
            left = [(i, asked) for i, asked in left if fetched[i]]


def _with_options(reader, plan: list[dict], state: str, options: dict):
    reader = reader.format("paged_search").option("plan", json.dumps(plan, ensure_ascii=False)).option("state", state)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def search_stream(spark: SparkSession, plan: list[dict], state: str, **options) -> DataFrame:
    """Pages as a stream; see the module for the options."""
    spark.dataSource.register(PagedSearch)
    return _with_options(spark.readStream, plan, state, options)


def search_pages(spark: SparkSession, plan: list[dict], state: str, **options) -> DataFrame:
    """All pages at once; what an earlier run fetched under ``state`` is not fetched again."""
    spark.dataSource.register(PagedSearch)
    return _with_options(spark.read, plan, state, options)
