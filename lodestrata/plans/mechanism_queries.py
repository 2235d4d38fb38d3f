"""Queries that run the streaming, versioning and seen-key mechanisms, and operators that other queries only resemble."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ITEM_PATTERN, MISREADINGS, SHANGHAI_PM
from ..functions.display import display_items, display_text
from ..operators.ocr import structure
from ..operators.ordinal import with_next, with_ordinal, with_position
from ..operators.score import hard_filters as score_hard_filters
from ..operators.score import score
from ..operators.seen import SeenKeys
from ..operators.validate import observed
from ..schema import DIMENSIONS, EVALUATION, INDEXED, conform
from ..session import scratch_folder, stored
from ..sources import discovery, paging
from ..sources.versions import Versions
from ..streaming import history, keyed_history
from .record_queries import _LADDER, _STAMP, _broken_sql, _contract_rows, _records

P = SHANGHAI_PM


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_folder(spark)}/lodestrata/{name}-{uuid.uuid4().hex[:12]}"


# --- sources, streams, versions -----------------------------------------------------------------


def paged_stream(spark, d):
    """Events as the recorded answers of a search, a query a user, 20 results a page; read page by page as a stream."""
    root = _folder(spark, "paged")
    rows = with_position(_t(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], name="n", unique=True)
    page = F.floor(F.col("n") / 20).cast("long")
    sizes = rows.groupBy(F.col("user_id").alias("u"), page.alias("page")).agg(F.array_sort(F.collect_list(F.struct("n", "event_id", "event_type"))).alias("found"))  # 20 at most
    last = rows.groupBy(F.col("user_id").alias("v")).agg(F.max("n").alias("most"))
    results = F.transform("found", lambda x: F.struct(x["event_type"].alias("title"), x["event_id"].cast("string").alias("url")))
    more = F.col("most") >= 20 * (F.col("page") + 1)
    body = F.to_json(F.struct(F.struct(results.alias("results")).alias("web"), F.struct(more.alias("more_results_available")).alias("query")))
    fails = F.when(F.col("u") % 50 == 0, F.array(F.lit(503))).otherwise(F.array().cast("array<int>"))
    recorded = sizes.join(last, F.col("u") == F.col("v")).select(F.col("u").cast("string").alias("query"), "page", fails.alias("fails"), body.alias("body"))
    paging.record(recorded, f"{root}/recorded")
    plan = [{"mode": "exact", "query": str(r["user_id"])} for r in rows.select("user_id").distinct().orderBy("user_id").collect()]  # a plan lists its queries
    pages = paging.search_stream(spark, plan, f"{root}/state", transport="replay", replay=f"{root}/recorded", pages=100_000, count=20, backoff_s=0.001)
    query = pages.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/check").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    out = spark.read.schema(paging.SCHEMA).parquet(f"{root}/out")
    ids = F.array_join(F.transform("results", lambda x: x["url"]), ",")
    return out.select("query", F.col("page").cast("long").alias("page"), F.size("results").cast("long").alias("n_results"), F.md5(ids).alias("urls_md5"), F.col("moreResultsAvailable").alias("more"))


def _history_files(spark, d, landing: str, run) -> None:
    """The event users' observations in two files, even ids before odd ones, each merged before the next lands."""
    e = _t(spark, d, "events").select(
        F.col("user_id").cast("string").alias("job_id"), F.col("event_type").alias("job_title"), F.col("ts").cast("string").alias("last_seen_at"), F.col("event_id").alias("ord"), F.lit(1).cast("long").alias("seen_count")
    )
    for rest in (0, 1):
        conform(e.where(F.col("ord") % 2 == rest), INDEXED).write.mode("append").parquet(landing)
        run()


def stream_history(spark, d):
    """History in buckets, by a stream whose files land in two rounds."""
    root = _folder(spark, "history")
    # a round's files are one batch, so that its observations merge by their order
    _history_files(spark, d, f"{root}/landing", lambda: history.history_stream(spark, f"{root}/landing", f"{root}/out", f"{root}/check", files_per_batch=1_000_000).awaitTermination())
    return history.snapshot(spark, f"{root}/out").select("job_id", "job_title", "last_seen_at", "seen_count")


def keyed_stream_history(spark, d):
    """The same history as keyed state of a stream, read from the state store."""
    root = _folder(spark, "keyed")
    write = keyed_history.write_changes(f"{root}/out")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    try:
        _history_files(spark, d, f"{root}/landing", lambda: keyed_history.start(spark, f"{root}/landing", f"{root}/check", write, files_per_batch=1_000_000).awaitTermination())
    finally:
        key = "spark.sql.streaming.stateStore.providerClass"
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return keyed_history.snapshot(spark, f"{root}/check").select("job_id", "job_title", "last_seen_at", "seen_count")


def discovery_rounds(spark, d):
    """From the part of the first line on: parts that stand in an order next after a part that was found, in up to 8 rounds."""
    li = _t(spark, d, "lineitem")
    steps = with_next(li.select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey"], ["l_linenumber", "l_partkey"], ["l_partkey"], unique=True)
    edges = stored(steps.where(F.col("next_l_partkey").isNotNull()).select(F.col("l_partkey").alias("source"), F.col("next_l_partkey").alias("target")), "discovery-edges")  # every round reads them
    start = li.agg(F.min_by("l_partkey", F.struct("l_orderkey", "l_linenumber", "l_partkey")).cast("string").alias("part"))
    search = lambda delta, n: delta.select(F.col("part").cast(li.schema["l_partkey"].dataType).alias("at")).join(edges, F.col("at") == F.col("source")).select("target").distinct().select(F.col("target").cast("string").alias("part"))
    got, _ = discovery.rounds(start, search, _folder(spark, "discovery"), key="part", max_rounds=8)
    return got.select("part", F.col("round").cast("long").alias("round"))


def seen_keys(spark, d):
    """Three runs of events, by thirds of their ids; the rows of each run whose (type, user) no earlier run had."""
    e = _t(spark, d, "events")
    keyed = e.select("event_id", F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("key"), (F.col("event_id") % 3).alias("run"))
    seen, out = SeenKeys(spark, _folder(spark, "seen")), None
    for run in range(3):
        fresh = seen.new_rows(keyed.where(F.col("run") == run), "key")
        out = fresh if out is None else out.union(fresh)
    return out.groupBy("run").agg(F.count("*").alias("n_rows"), F.count_distinct("key").alias("n_keys"))


def default_sequence(spark, d):
    """Lines in the order of shipping: the running place of each over all, and within its order."""
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber"]
    lines = _t(spark, d, "lineitem").select("l_orderkey", *order)
    placed = with_ordinal(lines, [*order, "l_orderkey"], name="place", start=1)
    return with_position(placed, ["l_orderkey"], ["place"], name="sequence", start=1, unique=True).select("l_orderkey", "l_partkey", "place", "sequence")


def observed_validation(spark, d):
    """The contract's violations, counted by the one job that writes the records."""
    rows, counted = observed(_contract_rows(spark, d))
    with Versions(spark, _folder(spark, "observed")).begin() as transaction:
        transaction.stage("run", rows)
        transaction.publish()
    return spark.createDataFrame(sorted(counted()["rules"].items()), "rule string, n long")  # a row a rule


def versioned_outputs(spark, d):
    """Two versions of a set: open orders and their customers, then both with the rest; a reader of each."""
    store, orders = Versions(spark, _folder(spark, "versions")), _t(spark, d, "orders")
    people = lambda rows: rows.groupBy("o_custkey").agg(F.count("*").alias("n"))

    def first(t):
        t.stage("orders", orders.where("o_orderstatus = 'O'"))
        t.stage("customers", people(orders.where("o_orderstatus = 'O'")))

    def second(t):
        every = t.read("orders").unionByName(orders.where("o_orderstatus <> 'O'"))
        t.stage("orders", every)
        t.stage("customers", people(every))

    versions = [store.update(first), store.update(second)]
    read = lambda v: store.read("customers", v).agg(F.lit(v).cast("long").alias("version"), F.count("*").alias("customers"), F.sum("n").alias("orders"))
    return read(versions[0]).union(read(versions[1]))


# --- operators ----------------------------------------------------------------------------------

#: Customers that a hard filter rejects, each so many by their number: the field, its class, how often.
_REJECTED = (("title_fit", "excluded", 17), ("city_fit", "mismatch", 19), ("direction_fit", "excluded", 23), ("responsibility_fit", "excluded", 41), ("mandatory_requirement_fit", "unmet", 43), ("work_mode_fit", "mismatch", 29), ("risk_fit", "severe", 31))


def hard_filter_reasons(spark, d):
    n = F.col("c_custkey")
    classes = {f: F.when(n % k == 0, c).otherwise("unknown") for f, c, k in _REJECTED}
    evaluation = F.struct(*((classes.get(x, F.lit(None).cast("string"))).alias(x) for x in DIMENSIONS)).cast(EVALUATION)
    flag = F.struct(F.when(n % 2 == 0, F.col("c_mktsegment")).alias("reason"), F.lit("x").alias("severity"), (n % 37 == 0).alias("hard_reject"), F.lit(None).cast("string").alias("evidence"))
    rows = _t(spark, d, "customer").select(n, F.when(n % 13 == 0, "closed").otherwise("open").alias("job_status"), evaluation.alias("evaluation"), F.array(flag, flag).alias("risk_flags"))
    reasons = score_hard_filters(F.col("evaluation"), P, flags=True)
    return rows.select("c_custkey", F.array_join(reasons, ";").alias("reasons")).where("reasons <> ''")


def score_histogram(spark, d):
    """Scored documents by tens of their score."""
    bucket = F.coalesce(F.floor(F.col("score") / 10).cast("string"), F.lit("none"))
    return score(_records(spark, d)).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def review_reasons(spark, d):
    """Documents as captures with a bad or repeated URL, a status, a card or a text that is amiss, by their number."""
    n, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    host = F.lit(f"https://www.{P.host}/job_detail/")
    number = F.when(n % 10 == 1, n - 1).otherwise(n)
    title = F.concat(F.lit(P.role), (n % 3).cast("string"))
    body = F.when(n % 5 == 0, F.lit("")).when(n % 8 == 0, F.concat(title, F.lit("\n"), text)).when(n % 9 == 0, F.concat(F.lit("职位描述\n"), text)).otherwise(F.concat(title, F.lit("\n岗位职责：\n"), text))
    card = F.concat(F.when(n % 4 == 0, F.lit("x")).otherwise(title), F.when(n % 6 == 0, F.lit("")).otherwise(F.concat(F.lit("\n甲公司"), n.cast("string"))), F.when(n % 13 == 0, F.lit("\n徐汇区 静安区")).otherwise(F.lit("")))
    captures = _t(spark, d, "documents").select(
        n.cast("int").alias("sequence"), F.concat(F.when(n % 7 == 0, F.lit("http://x/")).otherwise(host), number.cast("string"), F.lit(".html")).alias("url"),
        F.when(n % 11 == 0, F.lit(None)).when(n % 3 == 0, "captured").when(n % 3 == 1, "detail_captured").otherwise("failed").alias("status"), card.alias("card_text"), body.alias("detail_text"),
    )
    return structure(captures)[1].select(F.col("sequence").cast("long").alias("doc_id"), F.array_join("reasons", ",").alias("reasons"))


#: What stands around a text, by the document's number, as captures have it.
_AROUND = (("", ""), ("上海 某 公 司 岗位要求 ", ""), ("不合适 分享 1、", ""), ("导航 职位描述：", " 立即沟通 后"), ("杂项 1、", ""), ("任职要求: 020 Al （ ", " ） ，HRBP x"), ("", " ？R "), ("】 ", ""), ("一、必备要求 ", " 张女士 V"))


def _captured() -> str:
    before, after = (" ".join(f"WHEN {i} THEN '{x[k]}'" for i, x in enumerate(_AROUND)) for k in (0, 1))
    return f"concat(CASE doc_id % {len(_AROUND)} {before} END, coalesce(text, ''), CASE doc_id % {len(_AROUND)} {after} END)"


def shown_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(display_text(F.expr(_captured()))).alias("shown_md5"))


def shown_items(spark, d):
    numbered = F.concat(F.lit("岗位职责：1、"), F.regexp_replace(F.coalesce("text", F.lit("")), r"\n", " 2) "), F.lit(" 3.der ABCD"))
    return _t(spark, d, "documents").select("doc_id", F.md5(F.array_join(display_items(numbered), "|")).alias("items_md5"))


# --- the SQL ------------------------------------------------------------------------------------


def _any(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(map(re.escape, words)) + ")"


def _shown(source: str) -> str:
    """CTEs from a table x(doc_id, x) to s(doc_id, s): the text for display, step by step."""
    han = r"[\x{4e00}-\x{9fff}]"
    strip = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
    one = strip.format(r"regexp_replace(x, '\s+', ' ', 'g')")
    for _ in range(3):
        one = rf"regexp_replace({one}, '({han})\s+({han})', '\1\2', 'g')"
    for pattern, right in MISREADINGS:
        pattern = pattern.replace(r"(?<!\w)", r"\b").replace(r"(?!\w)", r"\b")
        one = f"regexp_replace({one}, '{pattern}', '{right.replace('$', chr(92))}', 'g')"
    place = lambda c, p: f"CASE WHEN regexp_matches({c}, '{p}') THEN strpos({c}, regexp_extract({c}, '{p}')) ELSE 0 END"
    marks = ", ".join(f"strpos(t, '{m}')" for m in P.display_noise)
    contact = r"(?i)(?:[\x{4e00}-\x{9fa5}]{1,4}(?:女士|先生)\s*v|招聘(?:专家|HR|专员|顾问)|HRBP?\b|v\s*[•·]\s*(?:在线|今日活跃|刚刚活跃))"
    return rf"""{source},
r AS (SELECT doc_id, {one} AS t FROM x),
h AS (SELECT doc_id, t, {place('t', _any(P.display_headings))} AS h, {place('t', r'(?:^|\s)' + ITEM_PATTERN)} AS i FROM r),
b AS (SELECT doc_id, CASE WHEN h > 1 THEN substr(t, h) WHEN i > 1 AND regexp_matches(left(t, i - 1), '{P.chrome_pattern}') THEN substr(t, i) ELSE t END AS t FROM h),
e AS (SELECT doc_id, regexp_replace({strip.format(r"regexp_replace(t, '[？?]\s*R?\s*$', '')")}, '{P.page_top_pattern}', '') AS t FROM b),
m AS (SELECT doc_id, t, list_min(list_filter([{marks}, {place('t', contact)}], lambda p: p > 1)) AS stop FROM e),
s AS (SELECT doc_id, {strip.format(rf"regexp_replace(CASE WHEN stop IS NULL THEN t ELSE {strip.format('left(t, stop - 1)')} END, '^{_any(P.leading_headings)}[：:]?\s*', '')")} AS s FROM m)"""


_REASONS = ", ".join(f"CASE WHEN c_custkey % {k} = 0 THEN '{f}={c}' END" for f, c, k in sorted(_REJECTED, key=lambda x: list(P.hard_filters).index(x[0])))
QUERIES = {f.__name__: f for f in (
    paged_stream, stream_history, keyed_stream_history, discovery_rounds, seen_keys, default_sequence, observed_validation, versioned_outputs, hard_filter_reasons, score_histogram, review_reasons, shown_text, shown_items,
)}

_HISTORY = f"""
SELECT CAST(user_id AS VARCHAR) AS job_id, arg_max(event_type, (event_id % 2, event_id)) AS job_title, arg_max({_STAMP.format('ts')}, (event_id % 2, event_id)) AS last_seen_at,
  count(*) AS seen_count FROM events GROUP BY user_id"""
SQL = {
    "paged_stream": """
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, count(*) OVER (PARTITION BY user_id) AS many FROM events)
SELECT CAST(user_id AS VARCHAR) AS query, n // 20 AS page, count(*) AS n_results, md5(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id)) AS urls_md5, any_value(many) > 20 * (n // 20 + 1) AS more
FROM r GROUP BY user_id, n // 20""",
    "stream_history": _HISTORY,
    "keyed_stream_history": _HISTORY,
    "discovery_rounds": """
WITH RECURSIVE p AS (SELECT l_orderkey AS o, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem),
g AS (SELECT DISTINCT a.l_partkey AS source, b.l_partkey AS part FROM p a JOIN p b ON a.o = b.o AND b.n = a.n + 1),
r(part, round) AS (SELECT arg_min(l_partkey, (l_orderkey, l_linenumber, l_partkey)), 0 FROM lineitem UNION SELECT g.part, r.round + 1 FROM r JOIN g ON g.source = r.part WHERE r.round < 8)
SELECT CAST(part AS VARCHAR) AS part, CAST(min(round) AS BIGINT) AS round FROM r GROUP BY part""",
    "seen_keys": """
WITH k AS (SELECT event_type || '/' || user_id AS key, event_id % 3 AS run FROM events), f AS (SELECT key, min(run) AS run FROM k GROUP BY key)
SELECT run, count(*) AS n_rows, count(DISTINCT key) AS n_keys FROM k JOIN f USING (key, run) GROUP BY run""",
    "default_sequence": """
SELECT l_orderkey, l_partkey, row_number() OVER w AS place, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber) AS sequence
FROM lineitem WINDOW w AS (ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_orderkey)""",
    "observed_validation": _broken_sql(),
    "versioned_outputs": """
SELECT 1::BIGINT AS version, count(DISTINCT o_custkey) AS customers, count(*) AS orders FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT 2, count(DISTINCT o_custkey), count(*) FROM orders""",
    "hard_filter_reasons": f"""
WITH r AS (SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 13 = 0 THEN 'job_status=closed' END, {_REASONS},
  CASE WHEN c_custkey % 37 = 0 THEN 'hard_reject=' || CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'unspecified' END END], lambda x: x IS NOT NULL), ';') AS reasons FROM customer)
SELECT * FROM r WHERE reasons <> ''""",
    "score_histogram": f"WITH {_LADDER} SELECT coalesce(CAST(CAST(floor(score / 10) AS BIGINT) AS VARCHAR), 'none') AS bucket, count(*) AS n FROM s GROUP BY 1",
    "review_reasons": rf"""
WITH d AS (SELECT doc_id AS n, coalesce(text, '') AS text, CASE WHEN doc_id % 10 = 1 THEN doc_id - 1 ELSE doc_id END AS number, '{P.role}' || doc_id % 3 AS title FROM documents),
u AS (SELECT *, row_number() OVER (PARTITION BY n % 7 = 0, number ORDER BY n) AS nth, n % 5 = 0 AS no_text, n % 5 > 0 AND n % 8 = 0 AS no_heading, n % 5 > 0 AND n % 8 > 0 AND n % 9 = 0 AS no_title,
  regexp_replace(text, '[\s：:;；]', '', 'g') = '' AS blank FROM d),
q AS (SELECT *, n % 4 = 0 AND (no_text OR no_title) AS untitled, CASE WHEN n % 11 = 0 THEN 'unknown' WHEN n % 3 = 2 THEN 'failed' END AS amiss FROM u),
r AS (SELECT n AS doc_id, CASE WHEN n % 7 = 0 THEN ['invalid_job_url'] WHEN nth > 1 THEN ['duplicate_job_url'] ELSE list_filter([
  'capture_status=' || amiss, CASE WHEN untitled THEN 'title_not_confirmed_product_manager' END, CASE WHEN no_text THEN 'missing_detail_ocr' END, CASE WHEN no_heading THEN 'detail_missing_jd_heading' END,
  CASE WHEN no_title AND NOT untitled THEN 'detail_title_mismatch' END, CASE WHEN no_text OR no_heading OR blank THEN 'missing_responsibility' END,
  CASE WHEN n % 6 = 0 AND n % 13 > 0 THEN 'company_unknown' END, CASE WHEN n % 13 = 0 THEN 'district_conflict' END], lambda x: x IS NOT NULL) END AS reasons FROM q)
SELECT doc_id, array_to_string(reasons, ',') AS reasons FROM r WHERE len(reasons) > 0""",
    "shown_text": f"WITH {_shown(f'x AS (SELECT doc_id, {_captured()} AS x FROM documents)')} SELECT doc_id, md5(s) AS shown_md5 FROM s",
    "shown_items": rf"""
WITH {_shown("x AS (SELECT doc_id, '岗位职责：1、' || replace(coalesce(text, ''), chr(10), ' 2) ') || ' 3.der ABCD' AS x FROM documents)")},
l AS (SELECT doc_id, s, string_split(regexp_replace(s, '(^|\s)({ITEM_PATTERN})', chr(1) || '\1\2', 'g'), chr(1)) AS l FROM s),
i AS (SELECT doc_id, s, list_filter(list_transform(l, lambda x: regexp_replace(regexp_replace(regexp_replace(x, '^\s*{ITEM_PATTERN}\s*|[？?]\s*$', '', 'g'), '^[\s，。；：:]+', ''), '^\s+|\s+$', '', 'g')),
  lambda x: length(x) >= 4 AND NOT regexp_matches(x, '^[RABC]\s*$')) AS l FROM l),
k AS (SELECT doc_id, s, l, list_transform(l, lambda x: left(regexp_replace(x, '^\d{{1,2}}[、.)]?\s*', ''), 24)) AS k FROM i),
f AS (SELECT doc_id, s, list_filter(l, lambda x, i: list_position(k, k[i]) = i) AS l FROM k)
SELECT doc_id, md5(CASE WHEN s = '' THEN '' WHEN len(l) = 0 THEN s ELSE array_to_string(l[1:3], '|') END) AS items_md5 FROM f""",
}
