"""Queries over the readers' and the display's small operators: names, links, pages, scope, order and tallies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import INSUFFICIENT, REJECT, SHANGHAI_PM
from ..functions.display import display_value, risk_texts, verification_label
from ..functions.text import card_hint, page_text
from ..functions.url import strict_detail_url
from ..functions.values import no_strings
from ..operators import metrics, ocr, workbench
from ..operators.dedupe import evidence_places
from ..operators.normalize import evidence_entries, index_to_records
from ..operators.ordinal import with_ordinal
from ..operators.score import evidence_text, reclassify, score, score_document
from ..operators.validate import import_payload
from ..schema import EVIDENCE, INDEX_EVIDENCE, INDEXED, conform
from ..sources import captures
from .record_queries import _LADDER, _records
from .text_queries import _DIRECTIONS, _SPACE, PROSE, _decoded, _directions, _tags

P = SHANGHAI_PM


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def strict_urls(spark, d):
    n = F.col("page_id")
    host = F.element_at(F.array(*map(F.lit, ("", "www.", "m.", "x."))), (n % 4 + 1).cast("int"))
    tail = F.when(n % 5 == 0, ".HTML").when(n % 5 == 1, "/").when(n % 5 == 2, ".html#top").otherwise(".html")
    url = F.concat(F.when(n % 3 == 0, "http://").otherwise("HTTPS://"), host, F.lit(f"{P.host}/job_detail/"), n.cast("string"), tail, F.regexp_extract("url", r"\?.*$", 0))
    return _t(spark, d, "pages").select("page_id", strict_detail_url(url).alias("url"))


def manifest_only(spark, d):
    """Pages as entries of a manifest, some under a key that differs by case alone: one placeholder row a key."""
    n = F.col("page_id")
    key = F.when(n % 2 == 0, F.concat(F.when(n % 4 == 0, "Key").otherwise("KEY"), (n % 40).cast("string"))).when(n % 3 == 0, F.lit(""))
    entries = _t(spark, d, "pages").select(
        n.alias("ord"), key.alias("canonical_key"), F.concat(F.lit(f"https://m.{P.host}/job_detail/"), n.cast("string"), F.lit(".html?x=1")).alias("url"), F.when(n % 5 > 0, F.concat(F.lit("t"), n.cast("string"))).alias("title_hint"), F.lit("2024").alias("captured_at")
    )
    return captures.import_manifest(entries).select("url", "title", "verification_status", F.array_join("review_reasons", ",").alias("reasons"))


def captures_joined(spark, d):
    """Conversations as captures: the first turn is the card, under a three-digit name and, for some, a four-digit one; all turns are pages."""
    c, said = F.col("conv_id"), _t(spark, d, "conversations")
    manifest = said.select(c.cast("int").alias("sequence")).distinct()
    name = F.concat(F.lit("job_"), F.lpad(c.cast("string"), 3, "0"), F.lit("_card_context.txt"))
    first = said.where("turn = 0")
    longer = first.where(c % 3 == 0).select(c.cast("int").alias("sequence"), F.concat(F.lit("job_"), F.lpad(c.cast("string"), 9, "0"), F.lit("_card_context.txt")).alias("name"), F.concat(F.lit("new "), "text").alias("text"))
    cards = first.select(c.cast("int").alias("sequence"), name.alias("name"), "text").unionByName(longer)
    details = said.select(c.cast("int").alias("sequence"), F.format_string("job_x_detail_%06d.txt", "turn").alias("name"), "text")
    out = ocr.join_captures(manifest, cards, details)
    return out.select(F.col("sequence").cast("long").alias("conv_id"), F.md5("card_text").alias("card_md5"), F.md5("detail_text").alias("detail_md5"), F.size("detail_files").cast("long").alias("n_files"))


def page_texts(spark, d):
    """Texts as recognised pages: structured lines, a failed page, and plain text, by the document's number."""
    n, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("text"), F.lit(0.5).alias("confidence")))
    page = F.to_json(F.struct(F.when(n % 3 == 0, "ok").otherwise("error").alias("status"), lines.alias("lines")))
    return _t(spark, d, "documents").select("doc_id", F.md5(page_text(F.when(n % 3 == 2, text).otherwise(page))).alias("text_md5"))


def capture_names(spark, d):
    n, name = F.col("c_custkey"), F.concat("c_name", F.lit(" / é#"), F.col("c_mktsegment"))
    image = F.concat(F.when(n % 5 == 0, "data:text/plain;base64,").when(n % 5 == 1, "data:image/jpeg;base64,").otherwise("data:image/png;base64,"), F.base64(F.col("c_name").cast("binary")))
    urls = F.transform(F.sequence(F.lit(1), (n % 7 + 1).cast("int")), lambda i: F.concat(F.lit("u"), i.cast("string")))
    return _t(spark, d, "customer").select(
        n, captures.safe_run_id(name).alias("run_id"), captures.screenshot_name((n % 20_000).cast("int"), F.lit("detail"), F.when(n % 2 == 0, (n % 12).cast("int"))).alias("shot"),
        captures.decode_image(image).cast("string").alias("image"), F.array_join(captures.last_urls(urls, 3), ",").alias("urls"),
    )


def page_kinds(spark, d):
    n = F.col("doc_id")
    text = F.concat("text", F.when(n % 4 == 0, " 任职要求 x").when(n % 4 == 1, " CAPTCHA").when(n % 4 == 2, " 安全验证 岗位职责").otherwise(""))
    return _t(spark, d, "documents").select("doc_id", captures.is_detail_page(text).alias("detail"), captures.is_security_page(text).alias("security"))


def risk_lines(spark, d):
    n = F.col("c_custkey")
    flag = F.struct(F.when(n % 3 > 0, F.col("c_mktsegment")).alias("reason"), F.lit("s").alias("severity"), F.lit(True).alias("hard_reject"), F.when(n % 2 == 0, F.col("c_name")).otherwise("").alias("evidence"))
    status = F.when(n % 4 == 0, "captured_jd").when(n % 4 == 1, "needs_review").when(n % 4 == 2, "other")
    shown = F.when(n % 5 == 0, "unknown").when(n % 5 == 1, "").otherwise(F.col("c_mktsegment"))
    return _t(spark, d, "customer").select(n, F.array_join(risk_texts(F.array(flag)), "|").alias("risks"), display_value(shown).alias("shown"), verification_label(status).alias("label"))


def admission(spark, d):
    """Pages as public records: those of the site are admitted, with the last entry's description without its first clause."""
    n = F.col("page_id")
    none = F.lit(None).cast("string")
    entry = lambda text: F.struct(F.lit("p").alias("provider"), F.lit("q").alias("query"), none, F.lit(1), none, text, none).cast(INDEX_EVIDENCE)
    said = F.concat(F.when(n % 2 == 0, f"{P.city} 产品；").otherwise(""), F.when(n % 11 == 0, "").otherwise(F.col("html")))
    rows = _t(spark, d, "pages").select(
        F.concat(F.lit(f"https://www.{P.host}/"), F.when(n % 5 == 0, "zhaopin").otherwise("job_detail"), F.lit("/"), n.cast("string"), F.lit(".html")).alias("job_url"), F.when(n % 7 == 0, "x").otherwise(P.role).alias("job_title"),
        F.when(n % 6 == 0, "x").otherwise(P.city).alias("city"), F.when(n % 8 == 0, "closed").when(n % 8 == 1, "open").alias("job_status"), F.array(entry(F.lit("first")), entry(said)).alias("index_evidence_all"), F.lit("2024").alias("last_seen_at"),
    )
    out = index_to_records(conform(rows, INDEXED))
    return out.select("id", F.md5("description").alias("description_md5"), F.size("evidence_source").cast("long").alias("n_evidence"), F.element_at("missing_information", 1).isNotNull().alias("missing"))


# --- scored documents ---------------------------------------------------------------------------


def scope_flags(spark, d):
    n = F.col("c_custkey")
    rows = _t(spark, d, "customer").select(
        n, F.when(n % 3 == 0, "x").when(n % 3 == 1, P.city).alias("city"), F.when(n % 4 > 0, F.concat(F.col("c_mktsegment"), F.lit(P.role))).alias("title"), F.when(n % 5 > 0, "text").otherwise("unknown").alias("job_description_raw"), F.when(n % 7 > 0, "text").alias("responsibilities")
    )
    whole = ocr.in_scope(rows, only_complete=True).select(n.alias("w"))
    return rows.withColumn("outside", ocr.out_of_scope(rows)).join(whole, F.col("c_custkey") == F.col("w"), "left").select("c_custkey", "outside", F.col("w").isNotNull().alias("complete"))


def metadata_row(spark, d):
    return metrics.metadata_counts(score(_records(spark, d)))


def capture_tally(spark, d):
    status = F.when(F.col("value") < 5, "captured").when(F.col("value") < 20, "detail_captured").when(F.col("event_type") != "view", F.col("event_type"))
    return metrics.counted(_t(spark, d, "events").select(status.alias("capture_status")), "capture_status")


def direction_list(spark, d):
    return metrics.directions(_directions(spark, d))


def workbench_top(spark, d):
    return workbench.top(score(_records(spark, d)), 10).select("id", "match_score", "evidence_confidence")


def workbench_order(spark, d):
    """The places of the English records in the workbench's order."""
    found = workbench.select(score(_records(spark, d)), workbench.Filters(direction="en")).select("doc_id")
    return with_ordinal(found, name="place", start=1)


# --- records ------------------------------------------------------------------------------------


def imported_records(spark, d):
    """Customers as imported JSON documents of a hundred records, read under the strict rules for types."""
    n = F.col("c_custkey").cast("string")
    none = F.lit(None).cast("string")
    job = F.struct(
        n.alias("id"), F.concat(F.lit(f"https://www.{P.host}/job_detail/"), n, F.lit(".html")).alias("url"), F.concat("c_mktsegment", F.lit(P.role)).alias("title"), F.lit(P.city).alias("city"), F.lit(INSUFFICIENT).alias("recommendation"),
        F.lit("public_index").alias("pipeline"), F.lit("unverified_index_snapshot").alias("verification_status"), F.lit(None).cast("double").alias("score"), F.array(F.struct(F.lit("public_index").alias("type"), none.alias("detail"))).alias("evidence_source"),
        F.array(F.col("c_name")).alias("missing_information"), no_strings().alias("review_reasons"),
    )
    texts = _t(spark, d, "customer").groupBy(F.floor(F.col("c_custkey") / 100)).agg(F.to_json(F.struct(F.collect_list(job).alias("jobs")), {"ignoreNullFields": "false"}).alias("value"))
    out = import_payload(texts)
    return out.select("id", "title", F.array_join("missing_information", ",").alias("missing"), F.col("score").isNull().alias("unscored"))


def evidence_texts(spark, d):
    n = F.col("c_custkey")
    row = _t(spark, d, "customer").select(n, F.when(n % 3 == 0, "unknown").when(n % 3 == 1, F.col("c_name")).alias("a"), F.when(n % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("b"), F.lit("c").alias("c"))
    return row.select("c_custkey", evidence_text(("a", "b", "c")).alias("known"), evidence_text(("a", "b", "c"), keep_unknown=True).alias("given"))


def card_hints(spark, d):
    """Customers as the one line of a card: title, pay, experience, education, a tag for some, company, city and district."""
    n = F.col("c_custkey").cast("string")
    line = F.concat(
        F.lit(f"{P.role}"), n, F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("  "), n, F.lit("-60K·13薪"))).otherwise(""), F.lit(" 3-5年 本科 "), F.when(F.col("c_custkey") % 3 == 0, f"{P.card_tags[0]} ").otherwise(""),
        F.when(F.col("c_custkey") % 5 > 0, F.concat(F.lit("公司"), n, F.lit(" "))).otherwise(""), F.when(F.col("c_custkey") % 7 > 0, f"{P.city} {P.districts[0]}").otherwise(""),
    )
    found = card_hint(F.when(F.col("c_custkey") % 11 > 0, line), P)
    return _t(spark, d, "customer").select("c_custkey", *(c.alias(k) for k, c in found.items()))


def user_states(spark, d):
    states = _t(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("toxic") == 1, "不合适").when(F.col("quality") == 1, "候选").otherwise("no state").alias("status"))
    least = _t(spark, d, "documents").agg(F.min("doc_id").cast("string")).first()[0]
    docs = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"))
    return workbench.with_states(docs, workbench.set_state(states, least, "已投递")).groupBy("user_status").agg(F.count("*").alias("n"))


def document_metadata(spark, d):
    return score_document(_records(spark, d), {"source": "documents", "job_count": "given"})[1]


def reclassified(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", F.col("lang").alias("title"), F.col("text").alias("job_description_raw"), F.lit("unknown").alias("responsibilities"), F.lit(None).cast("string").alias("requirements"))
    return reclassify(rows, PROSE).select("doc_id", F.array_join("tags", ",").alias("tags"))


def evidence_defaults(spark, d):
    """Users' observations as lists of evidence without types or times, or none: filled in."""
    none = F.lit(None).cast("string")
    entry = F.struct(F.when(F.col("value") < 10, "seen").alias("type"), F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).alias("observed_at"), *(none.alias(c) for c in ("url", "query", "detail", "provider", "summary", "capture_status")))
    items = F.when(F.col("event_id") % 5 > 0, F.array(entry)).cast(EVIDENCE)
    rows = _t(spark, d, "events").select("event_id", evidence_entries(items, F.lit("public_index"), F.when(F.col("event_id") % 3 > 0, "then")).alias("e"))
    return rows.select("event_id", F.element_at("e", 1)["type"].alias("type"), F.element_at("e", 1)["observed_at"].alias("at"), F.size("e").cast("long").alias("n"))


def evidence_table(spark, d):
    """Events as their users' evidence, a row each with its place."""
    rows = _t(spark, d, "events").select("user_id", "ts", "event_id", F.when(F.col("value") > 1, F.concat_ws("/", "event_type", F.col("event_id").cast("string"))).alias("said"))
    return evidence_places(rows, "user_id", ["ts", "event_id"], "said").withColumnRenamed("key", "user_id")


QUERIES = {f.__name__: f for f in (
    evidence_table,
    imported_records, evidence_texts, card_hints, user_states, document_metadata, reclassified, evidence_defaults,
    strict_urls, manifest_only, captures_joined, page_texts, capture_names, page_kinds, risk_lines, admission, scope_flags, metadata_row, capture_tally, direction_list, workbench_top, workbench_order,
)}

_NOTHING = "公开索引只确认了上海、产品经理标题和具体岗位链接；完整 JD 待验证。"
SQL = {
    "evidence_table": "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place, event_type || '/' || event_id AS entry FROM events WHERE value > 1",
    "imported_records": f"SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment || '{P.role}' AS title, c_name AS missing, TRUE AS unscored FROM customer",
    "evidence_texts": """
SELECT c_custkey, concat_ws(' ', CASE WHEN c_custkey % 3 = 1 THEN c_name END, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, 'c') AS known,
  concat_ws(' ', CASE c_custkey % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN c_name ELSE '' END, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END, 'c') AS given FROM customer""",
    "card_hints": f"""
SELECT c_custkey, CASE WHEN c_custkey % 11 > 0 THEN '{P.role}' || c_custkey END AS title, CASE WHEN c_custkey % 11 > 0 AND c_custkey % 5 > 0 THEN '公司' || c_custkey END AS company,
  CASE WHEN c_custkey % 11 > 0 THEN '3-5年' END AS experience, CASE WHEN c_custkey % 11 > 0 THEN '本科' END AS education, CASE WHEN c_custkey % 11 > 0 AND c_custkey % 7 > 0 THEN '{P.districts[0]}' END AS district FROM customer""",
    "user_states": """
WITH s AS (SELECT d.doc_id, CASE WHEN d.doc_id = (SELECT min(doc_id) FROM documents) THEN '已投递' WHEN toxic = 1 THEN '不合适' WHEN quality = 1 THEN '候选' ELSE '未看' END AS user_status FROM documents d LEFT JOIN labels USING (doc_id))
SELECT user_status, count(*) AS n FROM s GROUP BY 1""",
    "document_metadata": f"SELECT 'documents' AS source, '{P.version}' AS scoring_algorithm_version, '{P.preferences_version}' AS preference_version, count(*) AS job_count FROM documents",
    "reclassified": f"""
WITH b AS (SELECT doc_id, lang || chr(10) || {_SPACE.format('text')} AS body FROM documents), t AS (SELECT doc_id, {_tags('body')} AS t FROM b)
SELECT doc_id, CASE WHEN len(t) = 0 THEN 'plain' ELSE array_to_string(t[1:4], ',') END AS tags FROM t""",
    "evidence_defaults": """
SELECT event_id, CASE WHEN event_id % 5 > 0 AND value < 10 THEN 'seen' ELSE 'public_index' END AS type,
  CASE WHEN event_id % 5 > 0 AND event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) WHEN event_id % 3 > 0 THEN 'then' ELSE 'unknown' END AS at, 1::BIGINT AS n FROM events""",
    "strict_urls": f"""
SELECT page_id, CASE WHEN page_id % 4 < 3 AND page_id % 5 <> 1 THEN 'https://www.{P.host}/job_detail/' || page_id || CASE WHEN page_id % 5 = 0 THEN '.HTML' ELSE '.html' END END AS url FROM pages""",
    "manifest_only": f"""
WITH k AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'key' || page_id % 40 ELSE 'own' || page_id END AS key FROM pages)
SELECT 'https://www.{P.host}/job_detail/' || page_id || '.html' AS url, CASE WHEN page_id % 5 > 0 THEN 't' || page_id ELSE 'unknown' END AS title, 'needs_review' AS verification_status, 'manifest_only' AS reasons
FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY page_id) = 1""",
    "captures_joined": r"""
WITH l AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM conversations),
p AS (SELECT conv_id, turn, list_filter(l, lambda x, i: list_position(l, x) = i) AS p FROM l),
g AS (SELECT conv_id, list(p ORDER BY turn) AS g, count(*) AS n FROM p GROUP BY conv_id),
m AS (SELECT conv_id, n, list_reduce(g, lambda a, b: list_concat(a, b[list_max(list_filter(range(0, 13), lambda n: n <= len(a) AND n <= len(b) AND a[len(a) - n + 1:] = b[1:n])) + 1:]), CAST([] AS VARCHAR[])) AS m FROM g),
f AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'new ' || text ELSE text END AS card FROM conversations WHERE turn = 0)
SELECT c.conv_id, md5(coalesce(card, '')) AS card_md5, md5(coalesce(array_to_string(m, chr(10)), '')) AS detail_md5, coalesce(n, 0) AS n_files
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN f USING (conv_id) LEFT JOIN m USING (conv_id)""",
    "page_texts": r"""
SELECT doc_id, md5(CASE doc_id % 3 WHEN 2 THEN coalesce(text, '') WHEN 1 THEN '' ELSE array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)),
  lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)) END) AS text_md5 FROM documents""",
    "capture_names": """
SELECT c_custkey, left(regexp_replace(c_name || ' / é#' || c_mktsegment, '[^A-Za-z0-9_-]', '-', 'g'), 80) AS run_id,
  'job_' || lpad(CAST(c_custkey % 20000 AS VARCHAR), greatest(4, length(CAST(c_custkey % 20000 AS VARCHAR)))::INT, '0') || '_detail' || CASE WHEN c_custkey % 2 = 0 THEN '_' || lpad(CAST(c_custkey % 12 AS VARCHAR), 2, '0') ELSE '' END || '.png' AS shot,
  CASE WHEN c_custkey % 5 > 0 THEN c_name END AS image, array_to_string(list_transform(range(greatest(1, c_custkey % 7 - 1), c_custkey % 7 + 2), lambda i: 'u' || i), ',') AS urls FROM customer""",
    "page_kinds": "SELECT doc_id, doc_id % 4 IN (0, 2) AS detail, doc_id % 4 IN (1, 2) OR regexp_matches(text, '(?i)captcha') AS security FROM documents",
    "risk_lines": """
SELECT c_custkey, CASE WHEN c_custkey % 6 = 3 THEN '{"severity":"s","hard_reject":true,"evidence":""}' ELSE concat_ws('：', CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END, CASE WHEN c_custkey % 2 = 0 THEN c_name END) END AS risks, CASE WHEN c_custkey % 5 < 2 THEN '未知' ELSE c_mktsegment END AS shown,
  CASE c_custkey % 4 WHEN 0 THEN '完整 JD' WHEN 1 THEN '待复核' WHEN 2 THEN 'other' END AS label FROM customer""",
    "admission": rf"""
WITH t AS (SELECT page_id, {_SPACE.format(_decoded(f"concat(CASE WHEN page_id % 2 = 0 THEN '{P.city} 产品；' ELSE '' END, CASE WHEN page_id % 11 = 0 THEN '' ELSE html END)"))} AS s FROM pages),
b AS (SELECT page_id, s, regexp_replace(regexp_replace(s, '^{P.city}[^；]*；', ''), '^\s+|\s+$', '', 'g') AS bare FROM t)
SELECT CAST(page_id AS VARCHAR) AS id, md5(CASE WHEN bare <> '' THEN bare WHEN s <> '' THEN s ELSE '{_NOTHING}' END) AS description_md5, 2::BIGINT AS n_evidence, TRUE AS missing
FROM b WHERE page_id % 5 > 0 AND page_id % 7 > 0 AND page_id % 6 > 0 AND page_id % 8 > 0""",
    "scope_flags": """
WITH s AS (SELECT c_custkey, NOT (c_custkey % 3 = 1 AND c_custkey % 4 > 0) AS outside FROM customer) SELECT *, NOT outside AND c_custkey % 5 > 0 AND c_custkey % 7 > 0 AS complete FROM s""",
    "metadata_row": f"""
WITH {_LADDER} SELECT count(*) AS job_count, count(*) FILTER (WHERE quality = 0) AS review_count, count(*) FILTER (WHERE quality IS DISTINCT FROM 0) AS captured_count,
  count(*) FILTER (WHERE recommendation = '{REJECT}') AS not_recommended_count, 0::BIGINT AS rejected_count FROM s""",
    "capture_tally": """
SELECT CASE WHEN value < 5 THEN 'captured' WHEN value < 20 THEN 'detail_captured' WHEN event_type <> 'view' THEN event_type END AS capture_status, count(*) AS n FROM events GROUP BY 1""",
    "direction_list": f"WITH {_DIRECTIONS} SELECT DISTINCT unnest(t) AS direction FROM l",
    "workbench_top": f"WITH {_LADDER} SELECT CAST(doc_id AS VARCHAR) AS id, match_score, evidence_confidence FROM s ORDER BY match_score DESC NULLS LAST, evidence_confidence DESC NULLS LAST, id LIMIT 10",
    "workbench_order": f"WITH {_LADDER} SELECT doc_id, row_number() OVER (ORDER BY coalesce(score, -1) DESC, CAST(doc_id AS VARCHAR)) AS place FROM s WHERE lang = 'en'",
}
