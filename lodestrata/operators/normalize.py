"""Search results to public records, and records of any origin to the contract: each one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import COMPLETE_CAPTURES, INSUFFICIENT, MISSING, SHANGHAI_PM, UNKNOWN, Profile
from ..functions.text import display_summary, facts, normalize_text, normalize_title, optional_field
from ..functions.url import canonical_url, detail_url, url_job_id, url_kind
from ..functions.values import known, no_strings, or_unknown, strings, unique
from ..schema import EVIDENCE, INDEX_EVIDENCE, INDEXED, RECORD, RESULT, conform
from .dedupe import first_with_evidence


def normalize_results(results: DataFrame, profile: Profile = SHANGHAI_PM) -> DataFrame:
    """Every search result with kind (rejected, listing, job), reason, and a public record's columns.

    ``results`` has a result's columns and provider, query, mode, rank, collected_at; others stay.
    """
    df = conform(results, RESULT)
    place = [F.col(c) for c in ("location", "office_location", "city", "district", "salary_range", "experience_requirement", "education_requirement", "description")]
    given = F.filter(F.concat(F.array(*place), F.coalesce("extra_snippets", no_strings())), lambda x: x.isNotNull() & (x != ""))
    df = df.withColumn("__raw_title", normalize_text(F.col("title"))).withColumn("__text", normalize_text(F.array_join(given, " ")))
    df = df.withColumn("__url", canonical_url(F.col("url"), profile.host)).withColumn("__kind", url_kind(F.col("__url")))
    found = facts(F.col("__raw_title"), F.col("__text"), profile)
    df = df.withColumns({"__title": normalize_title(F.col("__raw_title")), **{f"__{k}": v for k, v in found.items()}})
    reason = (
        F.when(F.col("__kind").isin("unsupported", "other_boss"), "unsupported_url")
        .when(~F.col("__title").contains(profile.role), "title_not_product_manager")
        .when(~F.col("__evidence").contains(profile.city), "city_not_confirmed_shanghai")
    )
    df = df.withColumn("reason", reason).withColumn("kind", F.when(F.col("reason").isNotNull(), "rejected").when(F.col("__kind") == "listing", "listing").otherwise("job"))
    tags = lambda c: F.filter(F.transform(F.coalesce(F.col(c), no_strings()), normalize_text), lambda x: x != "")
    optional = {c: optional_field(F.col(c)) for c in (
        "industry", "financing_stage", "company_size", "office_location", "responsibility_summary", "qualification_summary", "role_type",
        "team_and_reporting", "work_mode", "travel_requirement", "recruiter_activity", "published_or_updated_at",
    )}
    evidence = F.struct(
        F.col("provider"), F.col("query"), F.col("mode").alias("query_mode"), F.col("rank").cast("int").alias("result_rank"), F.col("__raw_title").alias("result_title"),
        F.col("__text").alias("result_description"), F.lit("unverified_index_snapshot").alias("verification_status"),
    ).cast(INDEX_EVIDENCE)
    source = lambda *c: F.coalesce(F.nullif(normalize_text(F.coalesce(*map(F.col, c))), F.lit("")), F.col("__url"))
    new = {
        "job_id": url_job_id(F.col("__url")), "job_url": F.col("__url"),
        "source_url": source("source_url", "evidence_source", "url"), "evidence_source": source("evidence_source", "source_url", "url"),
        "first_seen_at": F.col("collected_at"), "last_seen_at": F.col("collected_at"), "seen_count": F.lit(1).cast("long"),
        "job_title": F.nullif(F.col("__title"), F.lit("")), "company_name": optional_field(F.coalesce("company_name", "company")),
        "city": F.lit(profile.city), "district": F.col("__district"),
        "salary_range": F.coalesce(known(optional_field(F.col("salary_range"))), F.col("__salary")),
        "experience_requirement": F.coalesce(known(optional_field(F.col("experience_requirement"))), F.col("__experience")),
        "education_requirement": F.coalesce(known(optional_field(F.col("education_requirement"))), F.col("__education")),
        "job_description_raw": F.coalesce(known(optional_field(F.col("job_description_raw"))), F.nullif(F.col("__text"), F.lit(""))),
        "product_direction_tags": unique(F.concat(F.col("__tags"), tags("product_direction_tags"))),
        "product_form_tags": tags("product_form_tags"), "product_layer_tags": tags("product_layer_tags"),
        "field_evidence": F.map_filter(F.transform_values("field_evidence", lambda k, v: normalize_text(v)), lambda k, v: v != ""),
        "missing_information": F.array(*map(F.lit, MISSING)),
        "direction_fit": F.when(F.size("__tags") > 0, "priority").otherwise(UNKNOWN), "index_evidence": evidence, **optional,
    }
    df = df.select("*", *(c.alias(f"__n_{k}") for k, c in new.items()))
    kept = [c for c in df.columns if not c.startswith("__") and c not in new]
    return df.select(*kept, *(F.col(f"__n_{k}").alias(k) for k in new))


def process_batches(results: DataFrame, order: tuple[str, ...] = ("batch_idx", "result_idx"), profile: Profile = SHANGHAI_PM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Jobs, listing pages and rejected rows of normalised results; first rows win, later ones add their evidence."""
    done = normalize_results(results, profile)
    jobs = first_with_evidence(done.where("kind = 'job'"), "job_id", order, "index_evidence", "index_evidence_all")
    pages = first_with_evidence(done.where("kind = 'listing'"), "job_url", order, "index_evidence", "index_evidence_all")
    return conform(jobs, INDEXED), conform(pages, INDEXED), done.where("kind = 'rejected'")


def evidence_entries(entries: Column, kind: Column, observed: Column) -> Column:
    """Entries with type and time filled in; one entry of this type where there is no list."""
    filled = F.transform(entries, lambda x: x.withField("type", F.coalesce(x["type"], kind)).withField("observed_at", F.coalesce(x["observed_at"], observed, F.lit(UNKNOWN))))
    single = F.array(F.struct(kind.alias("type"), F.coalesce(observed, F.lit(UNKNOWN)).alias("observed_at"), *(F.lit(None).cast("string").alias(c) for c in ("url", "query", "detail", "provider", "summary", "capture_status"))))
    return F.coalesce(filled, single.cast(EVIDENCE))


#: A contract field and the names it may come under; null, but not an empty string, falls through to the next.
ALIASES = {
    "title": ("job_title",), "company": ("company_name",), "salary": ("salary_range",),
    "workExperience": ("work_experience", "experience_requirement"), "education": ("education_requirement",),
    "description": ("job_description_raw",), "job_description_raw": ("description",), "responsibilities": ("responsibility_summary",),
    "requirements": ("qualification_summary",), "tags": ("product_direction_tags",), "directions": ("product_direction_tags", "tags"),
}


#: Scalars that are the sentinel and lists that are empty where no column gives them.
SENTINELS = (
    "title", "company", "city", "district", "office_location", "salary", "workExperience", "education", "company_size", "financing_stage",
    "industry", "recruiter_type", "description", "job_description_raw", "responsibilities", "requirements", "capture_status",
)
LISTS = ("tags", "directions", "missing_information", "review_reasons", "hard_filter_reasons")


def to_contract(records: DataFrame, pipeline: str = "public_index", profile: Profile = SHANGHAI_PM, sentinel: bool = True) -> tuple[DataFrame, DataFrame]:
    """Contract records, and the rows whose URL is no detail page.

    ``sentinel`` writes unknown scalars as the sentinel, as sinks want them.
    """
    given = set(records.columns)
    pick = lambda c: F.coalesce(*(F.col(x) for x in (c, *ALIASES.get(c, ())) if x in given)) if given & {c, *ALIASES.get(c, ())} else F.lit(None)
    raw = F.coalesce(*(F.col(c) for c in ("url", "job_url") if c in given))
    df = records.withColumn("__url", detail_url(raw, profile.host))
    bad = df.where(F.col("__url").isNull()).drop("__url")
    way = F.coalesce(pick("pipeline").cast("string"), F.lit(pipeline))
    status = pick("verification_status").cast("string")
    public = (way == "public_index") | F.coalesce(status == "unverified_index_snapshot", F.lit(False))
    scalar = or_unknown if sentinel else known
    columns = {c: scalar(pick(c).cast("string")) for c in SENTINELS}
    columns |= {c: strings(pick(c).cast("array<string>")) for c in LISTS}
    columns |= {
        "id": url_job_id(F.col("__url")), "url": F.col("__url"), "pipeline": F.when(public, "public_index").otherwise(way),
        "verification_status": F.when(public, "unverified_index_snapshot").otherwise(F.coalesce(status, F.lit("needs_review"))),
        "scoring_config_version": F.coalesce(known(pick("scoring_config_version").cast("string")), F.lit(profile.version)),
        "match_score": F.when(~public, pick("match_score").cast("double")), "score": F.when(~public, pick("score").cast("double")),
        "evidence_confidence": F.when(public, 0.0).otherwise(F.coalesce(pick("evidence_confidence").cast("double"), F.lit(0.0))),
        "recommendation": F.when(public, INSUFFICIENT).otherwise(pick("recommendation").cast("string")),
    }
    if "evidence_source" in given and records.schema["evidence_source"].dataType.typeName() == "string":
        text = F.col("evidence_source")
        entry = F.struct(F.when(public, "public_index").otherwise(way).alias("type"), F.lit(None).cast("string").alias("observed_at"), *(F.lit(None).cast("string").alias(c) for c in ("url", "query")), text.alias("detail"), *(F.lit(None).cast("string").alias(c) for c in ("provider", "summary", "capture_status")))
        entries = F.when(F.coalesce(text, F.lit("")) != "", F.array(entry)).cast(EVIDENCE)
    else:
        entries = pick("evidence_source").cast(EVIDENCE)
    seen = F.coalesce(*(F.col(c) for c in ("collected_at", "last_seen_at") if c in given)) if given & {"collected_at", "last_seen_at"} else F.lit(None).cast("string")
    columns["evidence_source"] = evidence_entries(entries, F.when(public, "public_index").otherwise(way), seen)
    good = df.where(F.col("__url").isNotNull())
    good = good.select(*(F.col(f"`{c}`") for c in records.columns if c not in columns), *(v.alias(k) for k, v in columns.items()))
    return conform(good, RECORD), bad


def is_complete_ocr() -> Column:
    return (F.col("pipeline") == "ocr_jd") & F.col("capture_status").isin(*COMPLETE_CAPTURES) & known("job_description_raw").isNotNull() & known("responsibilities").isNotNull()


def gate_captures(records: DataFrame) -> DataFrame:
    """Captured records without complete evidence go to review, with the reasons."""
    captured = (F.col("pipeline") == "ocr_jd") & (F.col("verification_status") == "captured_jd")
    down = captured & ~F.coalesce(is_complete_ocr(), F.lit(False))
    why = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("capture_status").isin(*COMPLETE_CAPTURES), F.lit(False)), F.concat(F.lit("incomplete_ocr:capture_status="), or_unknown("capture_status"))),
        F.when(known("job_description_raw").isNull(), F.lit("incomplete_ocr:missing_job_description_raw")),
        F.when(known("responsibilities").isNull(), F.lit("incomplete_ocr:missing_responsibilities")),
    ))
    reasons = F.when(down, F.concat("review_reasons", why)).otherwise(F.col("review_reasons"))
    df = records.withColumns({"verification_status": F.when(down, "needs_review").otherwise(F.col("verification_status")), "review_reasons": reasons})
    silent = (F.col("pipeline") == "ocr_jd") & (F.col("verification_status") == "needs_review") & (F.size("review_reasons") == 0)
    return df.withColumn("review_reasons", unique(F.when(silent, F.array(F.lit("incomplete_ocr:evidence_requires_review"))).otherwise(F.col("review_reasons"))))


def index_to_records(indexed: DataFrame, profile: Profile = SHANGHAI_PM) -> DataFrame:
    """Public records admitted to the site (detail page, city, role, not closed), as contract records."""
    df = conform(indexed, INDEXED)
    title = normalize_title(F.col("job_title"))
    ok = detail_url(F.col("job_url"), profile.host).isNotNull() & (F.col("city") == profile.city) & title.contains(profile.role) & ~F.coalesce(F.col("job_status") == "closed", F.lit(False))
    df = df.where(ok)
    entries = F.coalesce(F.when(F.size("index_evidence_all") > 0, F.col("index_evidence_all")), F.when(F.col("index_evidence").isNotNull(), F.array("index_evidence")), F.array().cast(df.schema["index_evidence_all"].dataType))
    df = df.withColumn("__entries", entries).withColumn("__summary", normalize_text(F.try_element_at("__entries", F.lit(-1))["result_description"]))
    nothing = "公开索引只确认了上海、产品经理标题和具体岗位链接；完整 JD 待验证。"
    seen = F.coalesce("last_seen_at", "collected_at", F.lit(UNKNOWN))
    entry = lambda x: F.struct(F.lit("public_index").alias("type"), seen.alias("observed_at"), F.lit(None).cast("string").alias("url"), or_unknown(x["query"]).alias("query"), F.lit(None).cast("string").alias("detail"), or_unknown(x["provider"]).alias("provider"), F.coalesce(F.nullif(normalize_text(x["result_description"]), F.lit("")), F.lit(UNKNOWN)).alias("summary"), F.lit(None).cast("string").alias("capture_status"))
    blank = F.array(F.lit(None).cast(INDEX_EVIDENCE))
    df = df.withColumns({
        "url": F.col("job_url"), "title": title, "pipeline": F.lit("public_index"), "capture_status": F.lit("index_snapshot"),
        "description": F.coalesce(F.nullif(display_summary(F.col("__summary"), profile), F.lit("")), F.lit(nothing)),
        "job_description_raw": F.when(F.col("__summary") != "", F.concat(F.lit("公开索引摘要（待验证）："), "__summary")).otherwise(nothing),
        "evidence_source": F.transform(F.when(F.size("__entries") > 0, F.col("__entries")).otherwise(blank), entry), "collected_at": seen,
        "missing_information": F.coalesce("missing_information", F.array(*map(F.lit, MISSING[:3]))),
    }).drop("__entries", "__summary")
    return to_contract(df, "public_index", profile)[0]
