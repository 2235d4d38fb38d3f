"""Merge, score, metric and validation queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ARRAYS, CONSIDER, INSUFFICIENT, RECOMMENDATIONS, REJECT, SCALARS, SHANGHAI_PM, TOP
from ..functions.values import present
from ..operators import metrics
from ..operators.dedupe import ordered_list
from ..operators.merge import latest, merge_history, merge_index, new_rows, upsert_manifest
from ..operators.ordinal import with_ordinal
from ..operators.pair_fold import earliest, merge_pipelines
from ..operators.score import score, top_positives
from ..operators.validate import violations
from ..operators.workbench import Filters, select
from ..schema import DIMENSIONS, EVALUATION, EVIDENCE, INDEXED, RECORD, conform, fields
from ..sources.plan import query_plan

P = SHANGHAI_PM


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query_metrics(spark, d):
    """Events as search results: a day's query of a kind of event, whose users are jobs and cheap ones listings."""
    kind = F.when(F.col("value") < 3, "rejected").when(F.col("value") < 12, "listing").otherwise("job")
    url = F.concat(F.lit("l"), F.col("event_id") % 5)
    rows = _t(spark, d, "events").select(F.col("event_type").alias("mode"), F.to_date("ts").cast("string").alias("query"), kind.alias("kind"), F.col("user_id").cast("string").alias("job_id"), url.alias("job_url"), (F.col("event_id") % 4).alias("batch_idx"))
    out = metrics.query_metrics(rows)
    return out.withColumn("yield_10k", F.round(10_000 * F.col("marginal_yield")).cast("long")).drop("marginal_yield")


def plan_matrix(spark, d):
    """Part types as terms, regions as modes, nations as districts, whole city first: lists that stay in Spark."""
    listed = lambda table, column: with_ordinal(_t(spark, d, table).select(column).distinct(), [column], name="place", unique=True)
    modes = listed("region", "r_name").select("place", F.col("r_name").alias("mode"), F.concat(F.lit("site {city} "), "r_name", F.lit(" {district}  {term}")).alias("template"))
    nations = listed("nation", "n_name").select((F.col("place") + 1).alias("place"), F.col("n_name").alias("district"))
    districts = nations.union(spark.range(1).select(F.col("id").alias("place"), F.lit("").alias("district")))
    terms = listed("part", "p_type").withColumnRenamed("p_type", "term")
    return query_plan(spark, {"city": "X"}, terms=terms, modes=modes, districts=districts)


def resume_remaining(spark, d):
    done = _t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return new_rows(_t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), done, "o_orderkey")


def new_keys(spark, d):
    e = _t(spark, d, "events").withColumn("day", F.to_date("ts"))
    cut = e.agg(F.min("day").alias("first"), F.max("day").alias("last")).select(F.date_add("first", F.floor(F.datediff("last", "first") / 2).cast("int")).alias("cut"))
    e = e.crossJoin(F.broadcast(cut))  # one row
    keys = e.select("user_id", "event_type", "value", (F.col("day") > F.col("cut")).alias("late")).withColumn("bucket", F.floor(F.col("value")).cast("long"))
    fresh = new_rows(keys.where("late"), keys.where("NOT late"), "user_id", "bucket")
    return fresh.groupBy("event_type").agg(F.count("*").alias("n_new"), F.count_distinct("user_id").alias("users"))


def _snapshots(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return _t(spark, d, "events").select("user_id", "event_id", "ts", k.alias("k"), F.nullif(F.when(F.col("value") < 5, "unknown").otherwise(F.col("event_type")), F.lit("error")).alias("kind"))


def _indexed(spark, d) -> DataFrame:
    stamp = F.col("ts").cast("string")
    return conform(_snapshots(spark, d).select(
        F.col("user_id").cast("string").alias("job_id"), F.col("kind").alias("job_title"), stamp.alias("first_seen_at"), stamp.alias("last_seen_at"), F.lit(1).cast("long").alias("seen_count"),
        F.array("kind").alias("product_direction_tags"), F.create_map(F.lit("k"), F.col("k").cast("string"), F.col("kind"), F.lit("seen")).alias("field_evidence"), F.col("event_id").alias("ord"),
    ), INDEXED)


def history_merge(spark, d):
    rows = _indexed(spark, d).where("job_title IS NOT NULL")
    out = merge_history(rows.where("ord % 2 = 0"), rows.where("ord % 2 = 1"))
    tags, evidence = F.array_join("product_direction_tags", ","), F.array_join(F.array_sort(F.map_keys("field_evidence")), ",")
    return out.select("job_id", "job_title", "first_seen_at", "last_seen_at", "seen_count", tags.alias("tags"), evidence.alias("evidence"), F.element_at("field_evidence", "k").alias("k"))


def index_merge_conflicts(spark, d):
    url = lambda c: F.concat(F.lit(f"https://m.{P.host}/job_detail/"), F.col(c), F.lit(".html?from=x"))
    a = _t(spark, d, "customer").select(url("c_nationkey").alias("job_url"), F.col("c_nationkey").cast("string").alias("job_id"), F.lit(0).alias("side"), F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).otherwise("unknown").alias("company_name"))
    b = _t(spark, d, "supplier").select(url("s_nationkey").alias("job_url"), F.col("s_nationkey").cast("string").alias("job_id"), F.lit(1).alias("side"), F.col("s_suppkey").alias("k"), F.when(F.col("s_acctbal") > 0, F.lit("SUPPLY")).alias("company_name"))
    out = merge_index(a.unionByName(b), ("side", "k"))
    return out.select("job_id", "job_url", "company_name", F.array_join("review_reasons", ",").alias("reasons"), F.col("seen_count").alias("rows"))


def evidence_accumulate(spark, d):
    df = _t(spark, d, "events").groupBy("user_id").agg(ordered_list(F.col("event_type"), [F.col("ts"), F.col("event_id")]).alias("all"))
    return df.select("user_id", F.md5(F.array_join("all", ",")).alias("all_md5"), F.array_join(F.array_distinct("all"), ",").alias("kinds"), F.size("all").cast("long").alias("n"))


def observations(events: DataFrame) -> DataFrame:
    """Events as observations of a record for each user: views from the index, the others captured."""
    url = F.concat(F.lit(f"https://www.{P.host}/job_detail/"), F.col("user_id").cast("string"), F.lit(".html"))
    return events.select(
        F.col("event_id").alias("ord"), url.alias("url"), F.concat(F.col("event_type"), F.lit(P.role)).alias("title"), F.lit(P.city).alias("city"),
        F.when(F.col("value") > 20, F.concat(F.lit("公司"), (F.col("event_id") % 3).cast("string"))).alias("company"), F.col("ts").cast("string").alias("collected_at"),
        F.lit("产品规划 增长 交易 上线 A/B 用户研究").alias("job_description_raw"), F.when(F.col("value") > 5, "增长 转化 交易 上线").alias("responsibilities"),
        F.when(F.col("event_type") == "view", "public_index").otherwise("ocr_jd").alias("pipeline"), F.lit("captured_jd").alias("verification_status"), F.lit("captured").alias("capture_status"),
    )


def pair_fold_merge(spark, d):
    base = observations(_t(spark, d, "events"))
    good, _ = merge_pipelines(base.where("pipeline = 'public_index'").drop("verification_status"), base.where("pipeline = 'ocr_jd'"))
    return good.select("id", "title", "company", "verification_status", "recommendation", "match_score", "evidence_confidence", "first_seen_at", F.size("evidence_source").alias("n_evidence"), F.array_join("review_reasons", ",").alias("review_reasons"))


def manifest_upsert(spark, d):
    df = _t(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("url"), F.col("turn").alias("ord"), F.col("turn").alias("sequence"), F.when(F.col("role") != "user", F.col("text")).alias("title_hint"), F.array("role").alias("detail_screenshots"))
    out = upsert_manifest(df)
    return out.select("url", "sequence", F.md5("title_hint").alias("hint_md5"), F.array_join("detail_screenshots", ",").alias("shots"))


def _classes(prefix: str) -> dict[str, str]:
    """Classes of a record by its columns, as SQL that both engines read."""
    return {
        "title_fit": f"CASE WHEN {prefix} % 3 = 0 THEN 'preferred' WHEN {prefix} % 3 = 1 THEN 'conditional' ELSE 'unknown' END",
        "direction_fit": f"CASE WHEN {prefix} % 5 < 2 THEN 'priority' WHEN {prefix} % 5 = 2 THEN 'adjacent' WHEN {prefix} % 5 = 3 THEN 'unknown' ELSE 'priority' END",
        "responsibility_fit": f"CASE WHEN {prefix} % 7 < 3 THEN 'high' WHEN {prefix} % 7 < 5 THEN 'medium' ELSE 'low' END",
        "company_quality": f"CASE WHEN {prefix} % 4 = 0 THEN 'high' WHEN {prefix} % 4 = 1 THEN 'medium' ELSE 'unknown' END",
        "growth_value": f"CASE WHEN {prefix} % 11 < 6 THEN 'medium' ELSE 'unknown' END",
    }


def _hundredths(dimension: str, sql: str) -> str:
    arms = " ".join(f"WHEN '{c}' THEN {v * P.weights[dimension]}" for c, v in P.factors[dimension].items() if v is not None)
    return f"(CASE {sql} {arms} END)"


def _sums(classes: dict[str, str]) -> tuple[str, str, str]:
    """Earned hundredths, known weight and known required weight, as SQL."""
    points = {x: _hundredths(x, sql) for x, sql in classes.items()}
    earned = " + ".join(f"coalesce({p}, 0)" for p in points.values())
    known = " + ".join(f"CASE WHEN {p} IS NULL THEN 0 ELSE {P.weights[x]} END" for x, p in points.items())
    required = " + ".join(f"CASE WHEN {p} IS NULL THEN 0 ELSE {P.weights[x]} END" for x, p in points.items() if x not in P.non_blocking)
    return earned, known, required


def _classed(df: DataFrame, key: str, whole) -> DataFrame:
    """Rows as captured records whose classes follow from a number; ``whole`` ones have all their text."""
    classes = _classes(key)
    evaluation = F.struct(*((F.expr(classes[x]) if x in classes else F.lit(None).cast("string")).alias(x) for x in DIMENSIONS)).cast(EVALUATION)
    return df.select(
        key, F.col(key).cast("string").alias("id"), F.lit("ocr_jd").alias("pipeline"), F.lit("captured_jd").alias("verification_status"), F.when(whole, "x").alias("job_description_raw"),
        F.lit("x").alias("responsibilities"), evaluation.alias("evaluation"),
    )


def weighted_score(spark, d):
    out = score(_classed(_t(spark, d, "customer"), "c_custkey", F.lit(True)))
    earned = F.aggregate("score_components", F.lit(0.0), lambda n, x: n + F.coalesce(x["points"], F.lit(0.0)))
    known = F.aggregate("score_components", F.lit(0), lambda n, x: n + F.when(x["known"], x["weight"]).otherwise(0))
    return out.select("c_custkey", F.round(100 * earned).cast("long").alias("earned"), known.cast("long").alias("known"), F.round(10 * F.col("match_score")).cast("long").alias("tenths"))


def evidence_confidence(spark, d):
    out = score(_classed(_t(spark, d, "orders"), "o_orderkey", F.col("o_orderstatus") == "F"))
    return out.select("o_orderkey", F.round(1000 * F.col("evidence_confidence")).cast("long").alias("permille"))


def hard_filters(spark, d):
    reasons = present([
        (F.col("o_orderstatus") == "P", F.concat(F.lit("o_orderstatus="), "o_orderstatus")),
        (F.col("o_orderpriority").isin("5-LOW", "4-NOT SPECIFIED"), F.concat(F.lit("o_orderpriority="), "o_orderpriority")),
        (F.col("o_totalprice") < 20_000, "o_totalprice=low"),
    ])
    return _t(spark, d, "orders").select("o_orderkey", F.array_join(reasons, ";").alias("reasons")).where("reasons <> ''")


#: The flagship's classes: what labels and documents say of a record; city, role and work mode are in scope for all.
_DOC_CLASSES = {
    **_classes("doc_id"),
    "city_fit": "'match'", "work_mode_fit": "'match'", "role_fit": "'preferred'", "risk_fit": "CASE WHEN toxic = 1 THEN 'severe' WHEN toxic = 0 THEN 'clear' ELSE 'light' END",
    "mandatory_requirement_fit": "CASE WHEN quality IS NULL THEN 'conditional' ELSE 'match' END", "product_form_fit": "CASE WHEN lang = 'en' THEN 'priority' ELSE 'conditional' END",
    "product_layer_fit": "CASE WHEN n_chars > 1000 THEN 'priority' ELSE 'conditional' END", "experience_fit": "CASE WHEN n_chars > 5000 THEN 'high' ELSE 'medium' END",
    "freshness_fit": "'unknown'", "team_quality": "'unknown'",
}


def _records(spark, d) -> DataFrame:
    docs = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")
    evaluation = F.struct(*((F.expr(_DOC_CLASSES[x]) if x in _DOC_CLASSES else F.lit(None).cast("string")).alias(x) for x in DIMENSIONS)).cast(EVALUATION)
    return docs.select(
        "doc_id", "lang", F.col("doc_id").cast("string").alias("id"), F.concat(F.lit(f"https://www.{P.host}/job_detail/"), F.col("doc_id").cast("string"), F.lit(".html")).alias("url"),
        F.lit(P.role).alias("title"), F.col("source").alias("company"), F.lit(P.city).alias("city"), F.col("lang").alias("district"), F.col("text").alias("description"),
        F.when(F.col("n_chars") > 300, F.lit("text")).alias("job_description_raw"), F.lit("text").alias("responsibilities"), F.lit("text").alias("requirements"), F.lit("ocr_jd").alias("pipeline"),
        F.when(F.col("quality") == 0, "needs_review").otherwise("captured_jd").alias("verification_status"), F.lit("captured").alias("capture_status"), evaluation.alias("evaluation"),
        F.array(F.col("lang")).alias("directions"), "source", "n_chars",
    )


def recommend_ladder(spark, d):
    out = score(_records(spark, d))
    return out.select("doc_id", "match_score", "score", "evidence_confidence", "recommendation", F.array_join("hard_filter_reasons", ",").alias("hard"))


#: A supplied unknown gives way to what the title says.
_EARNED, _KNOWN, _REQUIRED = _sums({**_DOC_CLASSES, "title_fit": "CASE WHEN doc_id % 3 = 1 THEN 'conditional' ELSE 'preferred' END"})
_LADDER = f"""
b AS (SELECT doc_id, source, lang, text, n_chars, quality, toxic, {_EARNED} AS earned, {_KNOWN} AS known, {_REQUIRED} AS required, n_chars > 300 AS complete,
        coalesce(quality <> 0, TRUE) AS captured FROM documents LEFT JOIN labels USING (doc_id)),
c AS (SELECT *, CAST((20 * earned + known) // (2 * known) AS BIGINT) AS tenths,
        CAST((2 * 1000 * required * CASE WHEN complete AND captured THEN 100 ELSE {P.incomplete_percent} END + {100 * P.required_weight}) // {200 * P.required_weight} AS BIGINT) AS permille,
        CASE WHEN toxic = 1 THEN 'risk_fit=severe' ELSE '' END AS hard FROM b),
t AS (SELECT *, CASE WHEN hard <> '' THEN '{REJECT}' WHEN NOT (complete AND captured) THEN '{INSUFFICIENT}'
        WHEN tenths >= {10 * P.preferred_at} THEN CASE WHEN permille < {P.floor_permille} THEN '{CONSIDER}' ELSE '{TOP}' END
        WHEN tenths >= {10 * P.consider_at} THEN '{CONSIDER}' ELSE '{REJECT}' END AS recommendation FROM c),
s AS (SELECT *, tenths / 10.0::DOUBLE AS match_score, CASE WHEN recommendation <> '{INSUFFICIENT}' THEN tenths / 10.0::DOUBLE END AS score, permille / 1000.0::DOUBLE AS evidence_confidence FROM t)"""


def top3_positives(spark, d):
    """An order's lines as components of 50 points, returned ones unknown, in the order of their numbers."""
    part = F.struct(
        F.col("l_linenumber").cast("string").alias("dimension"), F.col("l_partkey").cast("string").alias("classification"), F.lit(50).alias("weight"),
        (F.col("l_returnflag") != "R").alias("known"), F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("points"),
    )
    lines = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(ordered_list(part, [F.col("l_linenumber"), F.col("l_partkey")]).alias("parts"))
    return lines.select("l_orderkey", F.array_join(top_positives(F.col("parts")), ",").alias("positives"))


def rescore_histogram(spark, d):
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    bucket = F.when(F.col("o_orderstatus") != "P", F.floor(cents / F.lit(5_000_000)).cast("long"))
    return _t(spark, d, "orders").groupBy(F.coalesce(bucket.cast("string"), F.lit("none")).alias("bucket")).agg(F.count("*").alias("n"))


#: Fields that are null in each so many rows, by a number of their own.
_ABSENT = {f: 60 + i for i, f in enumerate([*(f for f in SCALARS if f not in ("id", "url", "city", "title", "pipeline", "verification_status", "recommendation", "capture_status")), *(f for f in ARRAYS if f != "evidence_source")])}
#: Other defects, each so many rows'.
_BROKEN = {"id": 97, "city": 43, "title": 47, "recommendation": 37, "score": 53, "pipeline": 59, "entry": 29, "confidence": 23, "version": 19, "differs": 17, "closed": 41, "reasons": 31, "hard": 13}


def _contract_rows(spark, d) -> DataFrame:
    """Customers as records in review, with defects by their number."""
    n = F.col("c_custkey")
    hit = lambda k: n % _BROKEN[k] == 0
    number = F.when(hit("id"), F.lit("0")).otherwise(n.cast("string"))
    entry = F.struct(F.when(hit("entry"), F.lit("")).otherwise("ocr_jd").alias("type"), F.lit("2024-01-01").alias("observed_at"), *(F.lit(None).cast("string").alias(c) for c in ("url", "query", "detail", "provider", "summary", "capture_status")))
    plain = {f.name: F.lit("x") for f in fields(RECORD) if f.dataType.typeName() == "string"} | {f.name: F.array().cast(f.dataType) for f in fields(RECORD) if f.dataType.typeName() == "array"}
    given = {
        "id": number, "url": F.concat(F.lit(f"https://www.{P.host}/job_detail/"), number, F.lit(".html")), "title": F.when(hit("title"), "x").otherwise(P.role), "city": F.when(hit("city"), "x").otherwise(P.city),
        "recommendation": F.when(hit("recommendation"), "x").otherwise(REJECT), "match_score": F.when(hit("score"), 101.0).otherwise(50.0), "score": F.when(hit("score"), 101.0).when(hit("differs"), 51.0).otherwise(50.0),
        "pipeline": F.when(hit("pipeline"), "x").otherwise("ocr_jd"), "verification_status": F.lit("needs_review"), "evidence_source": F.array(entry).cast(EVIDENCE), "evidence_confidence": F.when(hit("confidence"), 1.5).otherwise(0.8),
        "scoring_config_version": F.when(hit("version"), "unknown").otherwise("v"), "job_status": F.when(hit("closed"), "closed").otherwise("open"), "review_reasons": F.when(hit("reasons"), F.array().cast("array<string>")).otherwise(F.array(F.lit("r"))),
    }
    columns = plain | given
    for f, k in _ABSENT.items():
        columns[f] = F.when(n % k != 0, columns[f])
    return _t(spark, d, "customer").select(*(c.alias(f) for f, c in columns.items()))


def contract_violations(spark, d):
    """How often each of the contract's rules is broken."""
    return violations(_contract_rows(spark, d)).groupBy("rule").agg(F.count("*").alias("n"))


def _broken_sql() -> str:
    hit, absent = (lambda k: f"c_custkey % {_BROKEN[k]} = 0"), (lambda f: f"c_custkey % {_ABSENT[f]} = 0")
    reasons = f"({hit('reasons')} OR {absent('review_reasons')})" if "review_reasons" in _ABSENT else f"({hit('reasons')})"
    rules = {
        "id: repeated": "same > 1", "url: repeated": "same > 1", "city: out of scope": hit("city"), "title: out of scope": hit("title"), "recommendation: not allowed": hit("recommendation"), "score: outside 0-100": hit("score"),
        "match_score: outside 0-100": hit("score"), "pipeline: not allowed": hit("pipeline"), "evidence_source: entry without type": hit("entry"), "evidence_confidence: outside 0-1": hit("confidence"),
        "scoring_config_version: missing": f"{hit('version')}" + (f" OR {absent('scoring_config_version')}" if "scoring_config_version" in _ABSENT else ""), "score: differs from match_score": f"NOT ({hit('score')}) AND {hit('differs')}",
        "needs_review without reasons": reasons, "closed without evidence": f"{hit('closed')}" + (f" AND NOT ({absent('job_status')})" if "job_status" in _ABSENT else ""),
    }
    rules |= {f"{f}: not a {'list' if f in ARRAYS else 'string'}": absent(f) for f in _ABSENT}
    tests = "\nUNION ALL ".join(f"SELECT '{rule}' AS rule FROM c WHERE {cond}" for rule, cond in rules.items())
    return f"""
WITH r AS (SELECT c_custkey, CASE WHEN {hit('id')} THEN 0 ELSE c_custkey END AS id FROM customer), c AS (SELECT *, count(*) OVER (PARTITION BY id) AS same FROM r),
x AS ({tests}) SELECT rule, count(*) AS n FROM x GROUP BY rule"""


def workbench_filter(spark, d):
    states = _t(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("id"), F.lit("候选").alias("status"))
    out = select(score(_records(spark, d)), Filters(text="SRC1", direction="en", min_score=70), states)
    return out.select("doc_id", "company", "score", "user_status")


def recommend_counts_zero_fill(spark, d):
    return metrics.recommendation_counts(score(_records(spark, d))).select(F.col("place").cast("long").alias("place"), "recommendation", "n")


def streak_pause(spark, d):
    runs = _t(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg((F.count_distinct("user_id") - F.count_distinct("user_id") % 3).alias("size"))
    return metrics.streaks(runs, "day", "size").select("day", "size", "delta", F.col("streak").cast("long").alias("streak"), "pause")


def first_seen_min_of_four(spark, d):
    li = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"), F.min(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))).alias("back"))
    out = _t(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    stamps = (F.when(F.col("o_orderkey") % 5 == 0, "no date").otherwise(F.col("o_orderdate").cast("string")), *(F.col(c).cast("string") for c in ("first", "last", "back")))
    return out.select("o_orderkey", earliest(*stamps).alias("first_seen"))


def latest_wins(spark, d):
    return latest(_snapshots(spark, d).withColumn("kind", F.nullif("kind", F.lit("unknown"))), "user_id", "kind", ("ts", "event_id"))


def collated_sort_rank(spark, d):
    n = _t(spark, d, "nation")
    return with_ordinal(n.select("n_name"), [F.collate("n_name", "UNICODE")], name="place", start=1)


QUERIES = {f.__name__: f for f in (
    query_metrics, plan_matrix, resume_remaining, new_keys, history_merge, index_merge_conflicts, evidence_accumulate, pair_fold_merge, manifest_upsert, weighted_score,
    evidence_confidence, hard_filters, recommend_ladder, top3_positives, rescore_histogram, contract_violations, workbench_filter, recommend_counts_zero_fill, streak_pause,
    first_seen_min_of_four, latest_wins, collated_sort_rank,
)}

#: What nothing speaks against is clear of risk.
_CE, _CK, _ = _sums(_classes("c_custkey") | {"risk_fit": "'clear'"})
_, _, _OR = _sums(_classes("o_orderkey") | {"risk_fit": "'clear'"})
#: The classes of every observation: its text says all that there is to know.
_FE, _FK, _FR = _sums({
    "title_fit": "'preferred'", "city_fit": "'match'", "direction_fit": "'priority'", "responsibility_fit": "'high'", "role_fit": "'preferred'", "work_mode_fit": "'match'", "growth_value": "'medium'", "risk_fit": "'clear'",
})
_FOLD = f"""
WITH RECURSIVE o AS (
  SELECT user_id, event_type || '{P.role}' AS title, CASE WHEN value > 20 THEN '公司' || event_id % 3 END AS company, {{stamp}} AS stamp, value > 5 AS duties, event_type <> 'view' AS ocr,
    event_type <> 'view' AND value > 5 AS whole, row_number() OVER (PARTITION BY user_id ORDER BY event_type <> 'view', event_id) AS n FROM events),
f AS (
  SELECT user_id, n, ocr, title, company, stamp, stamp AS first, duties, whole AS sure, CASE WHEN ocr AND NOT whole THEN ['incomplete_ocr:missing_responsibilities'] ELSE CAST([] AS VARCHAR[]) END AS notes FROM o WHERE n = 1
  UNION ALL
  SELECT user_id, n, ocr, CASE WHEN leads THEN title ELSE old_title END, CASE WHEN leads THEN coalesce(company, old_company) ELSE coalesce(old_company, company) END, greatest(stamp, old_stamp), least(stamp, first), duties,
    (whole OR old_sure) AND NOT (len(clash) > 0 AND heavy), list_filter(every, lambda x, i: list_position(every, x) = i)
  FROM (SELECT *, list_concat(CASE WHEN again THEN own ELSE list_concat(old_notes, own) END, list_transform(clash, lambda c: CASE WHEN heavy THEN 'field_conflict:' ELSE 'lower_evidence_conflict:' END || c)) AS every
    FROM (SELECT *, list_filter([CASE WHEN both_ocr AND NOT again AND title <> old_title THEN 'title' END, CASE WHEN both_ocr AND NOT again AND company <> old_company THEN 'company' END], lambda x: x IS NOT NULL) AS clash
      FROM (SELECT o.user_id, o.n, o.ocr OR f.ocr AS ocr, o.title, o.company, o.stamp, o.duties OR f.duties AS duties, o.whole, f.title AS old_title, f.company AS old_company, f.stamp AS old_stamp, f.first, f.sure AS old_sure, f.notes AS old_notes,
          o.whole OR (o.ocr AND NOT f.sure) AS leads, o.whole OR NOT f.sure AS heavy, o.ocr AND f.ocr AS both_ocr, o.ocr AND f.ocr AND o.stamp = f.stamp AS again,
          CASE WHEN o.ocr AND NOT o.whole THEN ['incomplete_ocr:missing_responsibilities'] ELSE CAST([] AS VARCHAR[]) END AS own
        FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)))),
l AS (SELECT f.*, count(*) OVER (PARTITION BY user_id) AS n_evidence, row_number() OVER (PARTITION BY user_id ORDER BY n DESC) AS back FROM f),
s AS (SELECT *, CASE WHEN sure THEN 'captured_jd' WHEN ocr THEN 'needs_review' ELSE 'unverified_index_snapshot' END AS status,
  CAST((20 * ({_FE}) + ({_FK})) // (2 * ({_FK})) AS BIGINT) AS tenths, CAST((2000 * ({_FR}) * CASE WHEN sure AND duties THEN 100 ELSE {P.incomplete_percent} END + {100 * P.required_weight}) // {200 * P.required_weight} AS BIGINT) AS permille FROM l WHERE back = 1)
SELECT CAST(user_id AS VARCHAR) AS id, title, coalesce(company, 'unknown') AS company, status AS verification_status,
  CASE WHEN NOT (sure AND duties) THEN '{INSUFFICIENT}' WHEN tenths >= {10 * P.preferred_at} THEN CASE WHEN permille < {P.floor_permille} THEN '{CONSIDER}' ELSE '{TOP}' END WHEN tenths >= {10 * P.consider_at} THEN '{CONSIDER}' ELSE '{REJECT}' END AS recommendation,
  CASE WHEN ocr THEN tenths / 10.0::DOUBLE END AS match_score, CASE WHEN ocr THEN permille / 1000.0::DOUBLE ELSE 0.0 END AS evidence_confidence, first AS first_seen_at, n_evidence, array_to_string(notes, ',') AS review_reasons FROM s"""
_KIND = "CASE WHEN value < 5 THEN 'unknown' WHEN event_type = 'error' THEN NULL ELSE event_type END"
_DAY = "strftime(ts, '%Y-%m-%d')"
_STAMP = r"regexp_replace(regexp_replace(strftime({}, '%Y-%m-%d %H:%M:%S.%f'), '0+$', ''), '\.$', '')"

SQL = {
    "query_metrics": f"""
WITH g AS (SELECT event_type AS mode, {_DAY} AS query, count(DISTINCT event_id % 4) AS pages, count(*) AS raw_results, count(DISTINCT user_id) FILTER (WHERE value >= 12) AS exact_job_links,
  count(DISTINCT event_id % 5) FILTER (WHERE value >= 3 AND value < 12) AS discovery_pages, count(*) FILTER (WHERE value < 3) AS rejected FROM events GROUP BY 1, 2)
SELECT *, raw_results - rejected - exact_job_links - discovery_pages AS duplicates, (20000 * exact_job_links + raw_results) // (2 * raw_results) AS yield_10k FROM g""",
    "plan_matrix": """
WITH n AS (SELECT 0 AS i, '' AS district UNION ALL SELECT row_number() OVER (ORDER BY n_name), n_name FROM (SELECT DISTINCT n_name FROM nation)), t AS (SELECT DISTINCT p_type AS term FROM part), m AS (SELECT DISTINCT r_name AS mode FROM region)
SELECT row_number() OVER (ORDER BY term, mode, i) - 1 AS place, term, CASE WHEN i = 0 THEN '全市' ELSE district END AS district, mode, 'site X ' || mode || ' ' || CASE WHEN i = 0 THEN '' ELSE district || ' ' END || term AS query FROM t, m, n""",
    "resume_remaining": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "new_keys": """
WITH c AS (SELECT min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS b FROM events),
k AS (SELECT user_id, event_type, CAST(floor(value) AS BIGINT) AS bucket, CAST(ts AS DATE) > a + CAST((b - a) // 2 AS INTEGER) AS late FROM events, c)
SELECT event_type, count(*) AS n_new, count(DISTINCT user_id) AS users FROM k x WHERE late AND NOT EXISTS (SELECT 1 FROM k y WHERE NOT y.late AND y.user_id = x.user_id AND y.bucket = x.bucket) GROUP BY 1""",
    "history_merge": f"""
WITH s AS (SELECT *, {_KIND} AS kind, event_id % 2 AS side, {_STAMP.format('ts')} AS stamp, nullif(json_extract_string(props, '$.k'), '') AS k FROM events WHERE {_KIND} IS NOT NULL),
t AS (SELECT user_id, kind, min((side, event_id)) AS spot FROM s GROUP BY 1, 2), u AS (SELECT user_id, string_agg(kind, ',' ORDER BY spot) AS tags, list_sort(list_append(list(kind), 'k')) AS keys FROM t GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS job_id, arg_max(kind, (side, event_id)) FILTER (WHERE kind <> 'unknown') AS job_title, arg_min(stamp, (side, event_id)) AS first_seen_at, arg_max(stamp, (side, event_id)) AS last_seen_at,
  count(*) FILTER (WHERE side = 1) + CASE WHEN count(*) FILTER (WHERE side = 0) > 0 THEN 1 ELSE 0 END AS seen_count, any_value(tags) AS tags, array_to_string(any_value(keys), ',') AS evidence, arg_max(k, (side, event_id)) AS k
FROM s JOIN u USING (user_id) GROUP BY user_id""",
    "index_merge_conflicts": f"""
WITH u AS (SELECT c_nationkey AS nation, 0 AS side, c_custkey AS k, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS segment FROM customer
  UNION ALL SELECT s_nationkey, 1, s_suppkey, CASE WHEN s_acctbal > 0 THEN 'SUPPLY' END FROM supplier)
SELECT CAST(nation AS VARCHAR) AS job_id, 'https://m.{P.host}/job_detail/' || nation || '.html?from=x' AS job_url, arg_min(segment, (side, k)) FILTER (WHERE segment IS NOT NULL) AS company_name,
  CASE WHEN count(DISTINCT segment) > 1 THEN 'index_conflict:company_name' ELSE '' END AS reasons, count(*) AS rows FROM u GROUP BY nation""",
    "evidence_accumulate": """
WITH f AS (SELECT user_id, event_type, min((ts, event_id)) AS spot FROM events GROUP BY 1, 2), k AS (SELECT user_id, string_agg(event_type, ',' ORDER BY spot) AS kinds FROM f GROUP BY 1)
SELECT user_id, md5(string_agg(event_type, ',' ORDER BY ts, event_id)) AS all_md5, any_value(kinds) AS kinds, count(*) AS n FROM events JOIN k USING (user_id) GROUP BY user_id""",
    "pair_fold_merge": _FOLD.replace("{stamp}", _STAMP.format("ts")),
    "manifest_upsert": """
WITH f AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY 1, 2), r AS (SELECT conv_id, string_agg(role, ',' ORDER BY t) AS shots FROM f GROUP BY 1)
SELECT CAST(conv_id AS VARCHAR) AS url, min(turn) AS sequence, md5(arg_max(text, turn) FILTER (WHERE role <> 'user' AND text <> '' AND text <> 'unknown')) AS hint_md5, any_value(shots) AS shots
FROM conversations JOIN r USING (conv_id) GROUP BY conv_id""",
    "weighted_score": f"WITH s AS (SELECT c_custkey, CAST({_CE} AS BIGINT) AS earned, CAST({_CK} AS BIGINT) AS known FROM customer) SELECT *, (20 * earned + known) // (2 * known) AS tenths FROM s",
    "evidence_confidence": f"SELECT o_orderkey, CAST((2000 * ({_OR}) * CASE WHEN o_orderstatus = 'F' THEN 100 ELSE {P.incomplete_percent} END + {100 * P.required_weight}) // {200 * P.required_weight} AS BIGINT) AS permille FROM orders",
    "hard_filters": """
WITH r AS (SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderstatus = 'P' THEN 'o_orderstatus=P' END, CASE WHEN o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED') THEN 'o_orderpriority=' || o_orderpriority END,
  CASE WHEN o_totalprice < 20000 THEN 'o_totalprice=low' END], lambda x: x IS NOT NULL), ';') AS reasons FROM orders) SELECT * FROM r WHERE reasons <> ''""",
    "recommend_ladder": f"WITH {_LADDER} SELECT doc_id, match_score, score, evidence_confidence, recommendation, hard FROM s",
    "top3_positives": """
WITH s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey) AS nth FROM lineitem WHERE l_returnflag <> 'R' AND l_quantity >= 40),
a AS (SELECT l_orderkey, string_agg(l_linenumber || '=' || l_partkey, ',' ORDER BY nth) AS positives FROM s WHERE nth <= 3 GROUP BY 1)
SELECT l_orderkey, coalesce(any_value(positives), '') AS positives FROM lineitem LEFT JOIN a USING (l_orderkey) GROUP BY 1""",
    "rescore_histogram": "SELECT coalesce(CAST(CASE WHEN o_orderstatus <> 'P' THEN CAST(round(o_totalprice * 100) AS BIGINT) // 5000000 END AS VARCHAR), 'none') AS bucket, count(*) AS n FROM orders GROUP BY 1",
    "contract_violations": _broken_sql(),
    "workbench_filter": f"""
WITH {_LADDER}
SELECT s.doc_id, source AS company, score, CASE WHEN toxic = 1 THEN '候选' ELSE '未看' END AS user_status FROM s
WHERE contains(lower('{P.role}' || ' ' || source || ' ' || text), 'src1') AND lang = 'en' AND coalesce(score, -1) >= 70""",
    "recommend_counts_zero_fill": f"""
WITH {_LADDER}, l(place, recommendation) AS (VALUES {', '.join(f"({i}, '{r}')" for i, r in enumerate(RECOMMENDATIONS))})
SELECT CAST(place AS BIGINT) AS place, l.recommendation, count(s.doc_id) AS n FROM l LEFT JOIN s ON s.recommendation = l.recommendation GROUP BY 1, 2""",
    "streak_pause": f"""
WITH r AS (SELECT {_DAY} AS day, count(DISTINCT user_id) - count(DISTINCT user_id) % 3 AS size FROM events GROUP BY 1),
g AS (SELECT *, size - coalesce(lag(size) OVER (ORDER BY day), 0) AS delta FROM r), i AS (SELECT *, sum(CASE WHEN delta > 0 THEN 1 ELSE 0 END) OVER (ORDER BY day) AS island FROM g),
s AS (SELECT day, size, delta, CAST(sum(CASE WHEN delta <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY island ORDER BY day) AS BIGINT) AS streak FROM i)
SELECT *, streak >= 3 AS pause FROM s""",
    "first_seen_min_of_four": f"""
WITH l AS (SELECT l_orderkey, min(l_shipdate) AS a, max(l_shipdate) AS b, min(l_shipdate) FILTER (WHERE l_returnflag = 'R') AS c FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce({_STAMP.format('least(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END, a, b, c)')}, 'unknown') AS first_seen FROM orders LEFT JOIN l ON o_orderkey = l_orderkey""",
    "collated_sort_rank": "SELECT n_name, row_number() OVER (ORDER BY n_name COLLATE NOCASE) AS place FROM nation",
    "latest_wins": f"""
WITH s AS (SELECT *, nullif({_KIND}, 'unknown') AS kind FROM events) SELECT user_id, arg_max(kind, (ts, event_id)) FILTER (WHERE kind IS NOT NULL) AS kind FROM s GROUP BY user_id""",
}
