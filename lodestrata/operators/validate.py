"""The contract's rules as a table of violations. All are found at once; a batch is good if the table is empty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..config import ARRAYS, COMPLETE_CAPTURES, HIGH, IMPORT_LISTS, IMPORT_OPTIONAL, IMPORT_OPTIONAL_LISTS, IMPORT_TEXTS, INSUFFICIENT, PIPELINES, RECOMMENDATIONS, REJECT, SCALARS, SHANGHAI_PM, TOP, UNKNOWN, VERIFICATIONS, Profile
from ..functions.url import detail_url, url_job_id
from ..functions.values import is_unknown, let, whole_json
from ..schema import RECORD, conform
from ..session import stored
from .score import computed


class ContractError(ValueError):
    """A batch that breaks the contract; the first violations are in the message."""


def _rules(p: Profile) -> list[tuple[str, Column]]:
    c = F.col
    canonical = detail_url(c("url"), p.host)
    outside = lambda x, hi: x.isNotNull() & ~x.between(0, hi)
    some = lambda cond: F.coalesce(cond, F.lit(False))
    captured, review = some(c("verification_status") == "captured_jd"), some(c("verification_status") == "needs_review")
    evidence = lambda f: F.coalesce(F.exists("evidence_source", f), F.lit(False))
    return [
        ("id: missing", is_unknown("id")),
        ("id: repeated", c("__ids") > 1),
        ("url: not a canonical detail page", ~c("url").eqNullSafe(canonical) | canonical.isNull()),
        ("url: repeated", c("__urls") > 1),
        ("id: not the URL's", canonical.isNotNull() & ~c("id").eqNullSafe(url_job_id(canonical))),
        ("city: out of scope", ~c("city").eqNullSafe(F.lit(p.city))),
        ("title: out of scope", ~some(c("title").contains(p.role))),
        *((f"{f}: not a string", c(f).isNull()) for f in SCALARS if f not in ("id", "url")),
        *((f"{f}: not a list", c(f).isNull()) for f in ARRAYS),
        ("recommendation: not allowed", ~some(c("recommendation").isin(*RECOMMENDATIONS))),
        ("score: outside 0-100", outside(c("score"), 100)),
        ("pipeline: not allowed", ~some(c("pipeline").isin(*PIPELINES))),
        ("verification_status: not allowed", ~some(c("verification_status").isin(*VERIFICATIONS))),
        ("evidence_source: empty", F.coalesce(F.size("evidence_source"), F.lit(0)) < 1),
        ("evidence_source: entry without type", evidence(lambda x: is_unknown(x["type"]))),
        ("match_score: outside 0-100", outside(c("match_score"), 100)),
        ("evidence_confidence: outside 0-1", c("evidence_confidence").isNull() | ~c("evidence_confidence").between(0, 1)),
        ("score_components: malformed", F.coalesce(F.exists("score_components", lambda x: is_unknown(x["dimension"]) | x["known"].isNull()), F.lit(False))),
        ("scoring_config_version: missing", is_unknown("scoring_config_version")),
        ("score: differs from match_score", some(c("score") != c("match_score"))),
        ("public record with a score or tier", some((c("pipeline") == "public_index") | (c("verification_status") == "unverified_index_snapshot")) & (c("score").isNotNull() | c("match_score").isNotNull() | ~c("recommendation").eqNullSafe(F.lit(INSUFFICIENT)))),
        ("pipeline and verification_status disagree", some(c("pipeline") == "public_index") != some(c("verification_status") == "unverified_index_snapshot")),
        ("needs_review without reasons", review & (F.coalesce(F.size("review_reasons"), F.lit(0)) < 1)),
        ("needs_review in a high tier", review & some(c("recommendation").isin(*HIGH))),
        ("top tier with little evidence", some((c("recommendation") == TOP) & (c("evidence_confidence") < p.floor_permille / 1000))),
        ("high tier without match_score", some(c("recommendation").isin(*HIGH)) & c("match_score").isNull()),
        ("captured_jd without text or duties", captured & (is_unknown("job_description_raw") | is_unknown("responsibilities"))),
        ("captured_jd without complete capture", captured & (~evidence(lambda x: x["type"] == "ocr_jd") | ~some(c("capture_status").isin(*COMPLETE_CAPTURES)))),
        ("hard filter without rejection", (F.coalesce(F.size("hard_filter_reasons"), F.lit(0)) > 0) & ~c("recommendation").eqNullSafe(F.lit(REJECT))),
        ("closed without evidence", some(c("job_status") == "closed") & ~evidence(lambda x: (x["type"] == "closure") & ~is_unknown(x["detail"]))),
    ]


def _with_repeats(records: DataFrame) -> DataFrame:
    df = conform(records, RECORD)
    return df.withColumn("__ids", F.count("*").over(Window.partitionBy("id"))).withColumn("__urls", F.count("*").over(Window.partitionBy("url")))


def violations(records: DataFrame, profile: Profile = SHANGHAI_PM) -> DataFrame:
    """A row (id, url, rule) for every rule that a record breaks."""
    df = _with_repeats(records)
    broken = F.array_compact(F.array(*(F.when(cond, F.lit(rule)) for rule, cond in _rules(profile))))
    return df.select("id", "url", F.explode(broken).alias("rule"))


def assert_valid(records: DataFrame, profile: Profile = SHANGHAI_PM) -> None:
    found = violations(records, profile).limit(20).collect()
    if found:
        raise ContractError("\n".join(f"{r['id'] or r['url'] or UNKNOWN}: {r['rule']}" for r in found))


def observed(records: DataFrame, profile: Profile = SHANGHAI_PM) -> tuple[DataFrame, Callable[[], dict]]:
    """The records in the contract's columns, and what the one job that runs over them next will have counted.

    Call the second when the job, as a rule the write of the records, is done: ``rules`` (violations by rule, without
    those that are 0), ``captures`` (records by capture status: those that are complete, unknown, other) and the counts of ``metrics.metadata_counts``. Counting
    needs no scan of its own; repeated ids and urls cost the shuffles that ``violations`` needs too.
    """
    rules = _rules(profile)
    statuses = [*COMPLETE_CAPTURES, UNKNOWN]
    status = F.coalesce("capture_status", F.lit(UNKNOWN))
    watch = Observation()
    df = _with_repeats(records).observe(
        watch,
        F.count("*").alias("job_count"),
        F.count_if(F.col("verification_status") == "needs_review").alias("review_count"),
        F.count_if(F.col("verification_status") == "captured_jd").alias("captured_count"),
        F.count_if(F.col("recommendation") == REJECT).alias("not_recommended_count"),
        *(F.count_if(F.coalesce(cond, F.lit(False))).alias(f"rule_{i}") for i, (_, cond) in enumerate(rules)),
        *(F.count_if(status == s).alias(f"capture_{i}") for i, s in enumerate(statuses)),
        F.count_if(~status.isin(*statuses)).alias("capture_other"),
    )

    def counted() -> dict:
        got = watch.get
        out = {k: v for k, v in got.items() if k.endswith("_count")}
        out["rules"] = {rule: got[f"rule_{i}"] for i, (rule, _) in enumerate(rules) if got[f"rule_{i}"]}
        out["captures"] = {s: n for s, n in [*((s, got[f"capture_{i}"]) for i, s in enumerate(statuses)), ("other", got["capture_other"])] if n}
        return out

    return df.drop("__ids", "__urls"), counted


#: The strict subset that an imported file must pass, and the subset that captures must pass.
IMPORT_RULES = ("id:", "url:", "city: out", "title: out", "recommendation: not allowed", "pipeline: not allowed", "verification_status: not allowed", "score: outside", "match_score: outside", "public record", "needs_review in", "captured_jd without text", "closed")
CAPTURE_RULES = ("id: missing", "id: repeated", "url:", "city:", "title:", "recommendation:", "match_score:", "evidence_confidence:", "score_components: not", "hard_filter_reasons: not", "scoring_config_version: missing", "evidence_source: empty", "review_reasons: not", "needs_review in", "top tier")


def first_violation(records: DataFrame, rules: tuple[str, ...], profile: Profile = SHANGHAI_PM) -> str | None:
    """The first broken rule among those that begin with one of ``rules``, None if there is none."""
    picked = F.col("rule").rlike("^(?:" + "|".join(r.replace("(", r"\(") for r in rules) + ")")
    row = violations(records, profile).where(picked).orderBy("id", "rule").first()
    return f"{row['id']}: {row['rule']}" if row else None


def _kind(value: Column) -> Column:
    """The kind of a variant as JSON has it: string, number, array, object, boolean, null; NULL where it is absent."""

    def told(name: Column) -> Column:
        number = name.isin("BIGINT", "DOUBLE", "FLOAT") | name.startswith("DECIMAL")
        return F.when(name == "STRING", "string").when(number, "number").when(name == "VOID", "null").when(name.startswith("ARRAY"), "array").when(name.startswith("OBJECT"), "object").otherwise(F.lower(name))

    return let(F.schema_of_variant(value), told)


def _members(value: Column) -> Column:
    """An object's fields as variants by name; NULL for what is no object."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def _import_types() -> list[tuple[str, Column]]:
    """Rules on the types of an imported record ``job``, a variant, whose fields' kinds are the map ``kinds``: nothing is coerced."""
    kind = lambda f: F.try_element_at("kinds", F.lit(f))
    text = lambda f: F.try_variant_get("job", f"$.{f}", "string")
    items = lambda f: F.try_variant_get("job", f"$.{f}", "array<variant>")
    number = lambda f: F.when(kind(f) == "number", F.try_variant_get("job", f"$.{f}", "double"))
    other = lambda f, *kinds: ~F.coalesce(kind(f).isin(*kinds), F.lit(False))
    there = lambda f: kind(f).isNotNull()
    mixed = lambda f: F.coalesce(F.exists(items(f), lambda x: _kind(x) != "string"), F.lit(False))
    evidence, parts = items("evidence_source"), items("score_components")
    untyped = lambda x: (_kind(x) != "object") | F.coalesce(_kind(F.try_variant_get(x, "$.type", "variant")) != "string", F.lit(True)) | (F.trim(F.try_variant_get(x, "$.type", "string")) == "")
    return [
        ("job: not an object", F.col("job").isNotNull() & F.col("kinds").isNull()),
        *((f"{f}: not a text", other(f, "string") | (F.trim(text(f)) == "")) for f in IMPORT_TEXTS),
        *((f"{f}: not a text", there(f) & other(f, "string")) for f in IMPORT_OPTIONAL),
        ("score: not a number or null", other("score", "number", "null")),
        ("match_score: not a number or null", there("match_score") & other("match_score", "number", "null")),
        ("evidence_confidence: not in 0-1 or null", there("evidence_confidence") & (other("evidence_confidence", "number", "null") | F.coalesce(~number("evidence_confidence").between(0, 1), F.lit(False)))),
        *((f"{f}: not a list of texts", other(f, "array") | mixed(f)) for f in IMPORT_LISTS),
        *((f"{f}: not a list of texts", there(f) & (other(f, "array") | mixed(f))) for f in IMPORT_OPTIONAL_LISTS),
        ("evidence_source: not entries with a type", other("evidence_source", "array") | (F.size(evidence) == 0) | F.coalesce(F.exists(evidence, untyped), F.lit(False))),
        ("score_components: not a list of objects", there("score_components") & (other("score_components", "array") | F.coalesce(F.exists(parts, lambda x: _kind(x) != "object"), F.lit(False)))),
        ("risk_flags: not a list", there("risk_flags") & other("risk_flags", "array")),
    ]


def import_payload(texts: DataFrame, column: str = "value", profile: Profile = SHANGHAI_PM) -> DataFrame:
    """Contract records of imported JSON documents, one a row; ContractError names the first record at fault.

    Types are checked before anything is read as a record, so a number is no id and a single text no list; then the
    rules that imports must keep. A document is an object with a list ``jobs``.
    """
    parsed = stored(texts.select(whole_json(F.col(column)).alias("doc")), "import-documents")  # three passes read it
    listed = F.try_variant_get("doc", "$.jobs", "array<variant>")
    meta = _kind(F.try_variant_get("doc", "$.metadata", "variant"))
    if not parsed.where(F.col("doc").isNull() | listed.isNull() | (meta.isNotNull() & (meta != "object"))).isEmpty():
        raise ContractError("a document is an object with a list of jobs and, maybe, an object of metadata")
    jobs = parsed.select(F.posexplode(listed).alias("place", "job"))
    kinds = computed(jobs, kinds=F.transform_values(_members(F.col("job")), lambda _, x: _kind(x)))
    broken = F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.lit(rule)) for rule, cond in _import_types())))
    fault = kinds.select("place", F.try_element_at(broken, F.lit(1)).alias("rule")).where("rule IS NOT NULL").orderBy("place").first()
    if fault:
        raise ContractError(f"jobs[{fault['place']}]: {fault['rule']}")
    records = stored(conform(jobs.select(F.from_json(F.to_json("job"), RECORD).alias("r")).select("r.*"), RECORD), "import-records")
    found = first_violation(records, IMPORT_RULES, profile)
    if found:
        raise ContractError(found)
    return records
