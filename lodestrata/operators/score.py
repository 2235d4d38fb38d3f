"""The weighted rubric as columns: classes per dimension, match score, confidence, hard filters, recommendation.

There are three ways to classify: ``js`` (public and merged records), ``py`` (the adapter's) and ``ocr`` (captured
text); they differ on purpose, see each. Points are integers in hundredths, so ties round half up exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import (
    ADJACENT_OCR, B_WORDS, B_WORDS_JS, C_WORDS, C_WORDS_JS, CONSIDER, CORE_JS, EXCLUDED_OCR, FORMS_OUT_PY, HIGH, INCOMPLETE_JD, INSUFFICIENT, LAYERS_OUT_PY, LAYERS_PY, REJECT, SEVERE_PY,
    SHANGHAI_PM, TOP, UNKNOWN, Profile, validate_profile,
)
from ..functions.values import contains_any, is_unknown, known, no_strings, present, unique
from ..schema import COMPONENTS, DIMENSIONS, RECORD, conform


def _when(*arms: tuple[Column, str]) -> Column:
    """The first arm that holds, else unknown."""
    out = F.lit(UNKNOWN)
    for cond, label in reversed(arms):
        out = F.when(F.coalesce(cond, F.lit(False)), label).otherwise(out)
    return out


def _groups(text: Column, profile: Profile) -> Column:
    return sum((contains_any(text, g).cast("int") for g in profile.duties), F.lit(0))


#: Gives a record's field by name: a column of a table, or a field of a struct.
Fields = Callable[[str], Column]


def evidence_text(fields: tuple[str, ...], keep_unknown: bool = False, of: Fields = F.col) -> Column:
    """Fields joined by spaces; unknown ones count as nothing, or as they are."""
    return F.concat_ws(" ", *(F.coalesce(of(f), F.lit("")) if keep_unknown else known(of(f)) for f in fields))


def infer_js(text: Column, profile: Profile, of: Fields = F.col) -> dict[str, Column]:
    directions = F.coalesce(of("directions"), no_strings())
    titled, here = of("title").contains(profile.role), of("city") == profile.city
    b_side, c_side = contains_any(text, B_WORDS_JS), contains_any(text, C_WORDS_JS)
    hits = lambda words: F.arrays_overlap(directions, F.array(*map(F.lit, words))) | contains_any(text, words)
    excluded = contains_any(text, profile.excluded)
    direction = _when((excluded, "excluded"), (hits(profile.priority), "priority"), (hits(profile.adjacent), "adjacent"))
    n = _groups(text, profile)
    return {
        "title_fit": _when((titled, "preferred")),
        "city_fit": _when((here, "match"), (~is_unknown(of("city")), "mismatch")),
        "direction_fit": direction,
        "product_form_fit": _when((c_side, "priority"), (b_side, "conditional")),
        "product_layer_fit": _when((contains_any(text, CORE_JS), "priority"), (b_side, "conditional")),
        "financing_fit": F.lit(UNKNOWN),
        "responsibility_fit": _when(((n >= 3) & contains_any(text, profile.delivery), "high"), (n > 0, "medium")),
        "role_fit": _when((titled, "preferred")),
        "experience_fit": _when((~is_unknown(of("workExperience")), "medium")),
        "company_quality": F.lit(UNKNOWN),
        "freshness_fit": F.lit(UNKNOWN),
        "mandatory_requirement_fit": _when((~is_unknown(of("requirements")), "match")),
        "team_quality": F.lit(UNKNOWN),
        "work_mode_fit": _when((here, "match")),
        "growth_value": _when((direction == "priority", "medium")),
        "risk_fit": F.lit("clear"),
    }


def infer_py(text: Column, profile: Profile) -> dict[str, Column]:
    """No text but the eight fields; forms and layers can exclude; a title without the role is excluded."""
    titled, here = F.col("title").contains(profile.role), F.col("city") == profile.city
    n = _groups(text, profile)
    severe = F.coalesce(F.exists("risk_flags", lambda x: F.coalesce(x["hard_reject"], F.lit(False))), F.lit(False)) | text.contains(SEVERE_PY)
    level = lambda s: F.coalesce(F.exists("risk_flags", lambda x: F.coalesce(x["severity"] == s, F.lit(False))), F.lit(False))
    has = lambda words: contains_any(text, words)
    return {
        "title_fit": _when((titled, "preferred"), (~is_unknown("title"), "excluded")),
        "city_fit": _when((here, "match"), (~is_unknown("city"), "mismatch")),
        "direction_fit": _when((has(profile.excluded), "excluded"), (has(profile.priority), "priority"), (has(profile.adjacent), "adjacent")),
        "product_form_fit": _when((has(C_WORDS), "priority"), (has(FORMS_OUT_PY), "excluded")),
        "product_layer_fit": _when((has(LAYERS_PY), "priority"), (has(LAYERS_OUT_PY), "excluded")),
        "financing_fit": F.lit(UNKNOWN),
        "responsibility_fit": _when(((n >= 3) & has(profile.delivery), "high"), (n >= 1, "medium")),
        "role_fit": _when((titled, "preferred")),
        "experience_fit": F.lit(UNKNOWN),
        "company_quality": F.lit(UNKNOWN),
        "freshness_fit": F.lit(UNKNOWN),
        "mandatory_requirement_fit": F.lit(UNKNOWN),
        "team_quality": F.lit(UNKNOWN),
        "work_mode_fit": _when((here, "match")),
        "growth_value": _when((has(profile.priority), "high"), (has(profile.adjacent), "medium")),
        "risk_fit": F.when(severe, "severe").when(level("medium"), "medium").when(level("light"), "light").otherwise("clear"),
    }


def infer_ocr(title: Column, detail: Column, directions: Column, experience: Column, duties: Column, profile: Profile = SHANGHAI_PM) -> Column:
    """Classes of captured text, duties counted in their own section alone; risk is left to the scorer."""
    text = F.concat_ws(" ", title, F.coalesce(detail, F.lit("")))
    c_side, b_side = contains_any(text, C_WORDS), contains_any(text, B_WORDS)
    excluded = contains_any(text, EXCLUDED_OCR)
    priority = F.arrays_overlap(directions, F.array(*map(F.lit, profile.priority)))
    have = known(duties).isNotNull()
    side = _when((c_side, "priority"), (b_side, "conditional"))
    found = {
        "title_fit": _when((title.contains(profile.role), "preferred")),
        "city_fit": F.lit("match"),
        "direction_fit": _when((excluded, "excluded"), (priority, "priority"), (F.array_contains(directions, ADJACENT_OCR), "adjacent")),
        "product_form_fit": side,
        "product_layer_fit": side,
        "responsibility_fit": _when((have & (_groups(duties, profile) >= 3) & contains_any(duties, profile.delivery), "high"), (have, "medium")),
        "role_fit": _when((title.contains(profile.role), "preferred")),
        "experience_fit": _when((known(experience).isNotNull(), "medium")),
        "mandatory_requirement_fit": _when((have, "match")),
        "work_mode_fit": F.lit("match"),
        "growth_value": _when((priority, "medium")),
        "risk_fit": F.lit(None).cast("string"),
    }
    return F.struct(*(found.get(d, F.lit(UNKNOWN)).alias(d) for d in DIMENSIONS))


def scored_text(flavour: str, of: Fields = F.col) -> Column:
    """What the classes are read from: known fields and directions (js), or eight fields as they are (py)."""
    if flavour == "js":
        fields = evidence_text(("title", "company", "description", "job_description_raw", "responsibilities", "requirements"), of=of)
        return F.concat_ws(" ", fields, F.filter(of("directions"), lambda x: ~x.isin("", UNKNOWN)))
    return evidence_text(("title", "company", "city", "description", "job_description_raw", "responsibilities", "requirements", "work_mode"), keep_unknown=True)


def classify(text: Column, flavour: str, profile: Profile, of: Fields = F.col) -> Column:
    """The evaluation struct. Supplied classes override what is inferred: known ones only (js), any at all (py)."""
    if flavour == "js":
        inferred = infer_js(text, profile, of)
        supplied = lambda d: F.lit(None) if d == "financing_fit" else known(of("evaluation")[d])  # noqa: E731  never inferred, so never read
    else:
        inferred = infer_py(text, profile)
        supplied = lambda d: F.col("evaluation")[d]
    return F.struct(*(F.coalesce(supplied(d), inferred[d]).alias(d) for d in DIMENSIONS))


def factor(evaluation: Column, dimension: str, profile: Profile) -> Column:
    """Hundredths for the class, NULL if it has no factor: a look-up in a constant map."""
    pairs = [F.lit(x) for label, points in profile.factors[dimension].items() if points is not None for x in (label, points)]
    return F.try_element_at(F.create_map(*pairs), evaluation[dimension])


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """The columns, computed once for each row and there only.

    A generator over one row is a fence: Catalyst neither copies the expressions into every place that reads them
    nor pushes filters on them down, either of which multiplies a rubric's expression tree beyond any bound.
    """
    fence = F.inline(F.array(F.struct(*(c.alias(f"__new_{name}") for name, c in columns.items()))))
    old = [c for c in columns if c in df.columns]
    return df.select("*", fence).drop(*old).withColumnsRenamed({f"__new_{name}": name for name in columns})


def half_up(numerator: Column, denominator: Column) -> Column:
    """Integer division, halves up, NULL by zero; both at least 0."""
    return F.floor(F.try_divide((2 * numerator + denominator).cast("decimal(38,0)"), (2 * denominator).cast("decimal(38,0)"))).cast("long")


def hard_filters(evaluation: Column, profile: Profile, flags: bool) -> Column:
    value = lambda f: F.col("job_status") if f == "job_status" else evaluation[f]
    reasons = present((value(f).isin(*rejected), F.concat(F.lit(f"{f}="), value(f))) for f, rejected in profile.hard_filters.items())
    if not flags:
        return reasons
    risks = F.transform(F.filter("risk_flags", lambda x: F.coalesce(x["hard_reject"], F.lit(False))), lambda x: F.concat(F.lit("hard_reject="), F.coalesce(x["reason"], F.lit("unspecified"))))
    return unique(F.concat(reasons, F.coalesce(risks, no_strings())))


def is_public(of: Fields = F.col) -> Column:
    """Records that no scorer looks at: their text was never captured."""
    return F.coalesce((of("pipeline") == "public_index") | (of("verification_status") == "unverified_index_snapshot"), F.lit(False))


def still_missing(prior: Column, unknown: Iterable[tuple[Column, str]], complete: Column) -> Column:
    """What was missing, without the mark of an incomplete text if it is complete now, and what is missing now."""
    rest = F.filter(F.coalesce(prior, no_strings()), lambda x: (x != INCOMPLETE_JD) | ~complete)
    return unique(F.concat(rest, present(unknown), present([(~complete, INCOMPLETE_JD)])))


def ladder(match_score: Column, permille: Column, hard: Column, complete: Column, captured: Column, review: Column, profile: Profile) -> Column:
    """Hard filters first, then the thresholds for complete records; little evidence or open review demote high tiers."""
    tier = F.when(match_score >= profile.preferred_at, TOP).when(match_score >= profile.consider_at, CONSIDER).otherwise(REJECT)
    tier = F.when(F.size(hard) > 0, REJECT).when(complete & captured, tier).otherwise(INSUFFICIENT)
    tier = F.when((permille < profile.floor_permille) & (tier == TOP), CONSIDER).otherwise(tier)
    return F.when(review & tier.isin(*HIGH), INSUFFICIENT).otherwise(tier)


def score(records: DataFrame, profile: Profile = SHANGHAI_PM, flavour: str = "js") -> DataFrame:
    """Contract records with evaluation, components, match_score, evidence_confidence, reasons and recommendation.

    ``js`` leaves public records unscored. ``py`` scores 0.0 where nothing is known, takes a text as complete from 20
    characters, keeps recommendations of records that were not captured, and adds positive_evidence.
    """
    validate_profile(profile)
    js = flavour == "js"
    df = conform(records, RECORD)
    public = is_public() if js else F.lit(False)
    captured = F.coalesce(F.col("verification_status") == "captured_jd", F.lit(False))
    raw, duties = known("job_description_raw"), known("responsibilities")
    complete = raw.isNotNull() & duties.isNotNull()
    if not js:
        complete = complete & (F.length(raw) >= 20) & (F.length(duties) >= 20)
    df = computed(df, __text=scored_text(flavour))
    df = computed(df, evaluation=F.when(public, F.col("evaluation")).otherwise(classify(F.col("__text"), flavour, profile)), __complete=F.coalesce(complete, F.lit(False)), __captured=captured)
    df = computed(df, **{f"__f_{d}": factor(F.col("evaluation"), d, profile) for d in profile.dimensions})
    f = lambda d: F.col(f"__f_{d}")
    total = lambda parts: sum(parts, F.lit(0))
    df = computed(
        df,
        __known=total(F.when(f(d).isNotNull(), w).otherwise(0) for d, w in profile.weights.items()),
        __required=total(F.when(f(d).isNotNull(), w).otherwise(0) for d, w in profile.weights.items() if d not in profile.non_blocking),
        __earned=total(F.coalesce(f(d) * w, F.lit(0)) for d, w in profile.weights.items()),
    )
    share = F.when(F.col("__complete") & F.col("__captured"), 100).otherwise(profile.incomplete_percent)
    match = half_up(10 * F.col("__earned"), F.col("__known")) / F.lit(10.0)
    df = computed(
        df,
        __permille=half_up(1000 * F.col("__required") * share, F.lit(100 * profile.required_weight)),
        __match=match if js else F.coalesce(match, F.lit(0.0)),
        __hard=hard_filters(F.col("evaluation"), profile, flags=js),
    )
    review = F.coalesce(F.col("verification_status") == "needs_review", F.lit(False)) if js else F.lit(False)
    df = computed(df, __tier=ladder(F.col("__match"), F.col("__permille"), F.col("__hard"), F.col("__complete"), F.col("__captured") if js else F.lit(True), review, profile))
    components = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col("evaluation")[d].alias("classification"), F.lit(w).alias("weight"), f(d).isNotNull().alias("known"), (f(d) * w / F.lit(100.0)).alias("points")) for d, w in profile.weights.items())).cast(COMPONENTS)
    missing = still_missing(F.col("missing_information"), ((f(d).isNull(), d) for d in profile.dimensions if d not in profile.non_blocking), F.col("__complete"))
    version = profile.version if js else f"{profile.version}+{profile.preferences_version}"
    either = lambda a, b: F.when(public, a).otherwise(b)
    nothing = F.lit(None).cast("double")
    out = computed(df, **{
        "match_score": either(nothing, F.col("__match")),
        "score": either(nothing, F.when(F.col("__tier") != INSUFFICIENT, F.col("__match"))),
        "evidence_confidence": either(F.lit(0.0), F.col("__permille") / F.lit(1000.0)),
        "score_components": either(F.array().cast(COMPONENTS), components),
        "hard_filter_reasons": either(no_strings(), F.col("__hard")),
        "scoring_config_version": F.lit(version),
        "recommendation": either(F.lit(INSUFFICIENT), F.col("__tier")),
        "missing_information": either(F.col("missing_information"), missing),
    })
    if not js:
        out = out.withColumn("positive_evidence", top_positives(F.col("score_components")))
    return out.drop(*(c for c in out.columns if c.startswith("__") and c not in records.columns))


def top_positives(components: Column, most: int = 3) -> Column:
    """The three known components with most points, of those with 0.8 of their weight or more; ties in the rubric's order."""
    ranked = F.transform(components, lambda x, i: F.struct((-F.coalesce(x["points"], F.lit(-1.0))).alias("k"), i.alias("i"), x.alias("x")))
    strong = F.filter(F.array_sort(ranked), lambda r: r["x"]["known"] & (r["x"]["points"] >= r["x"]["weight"] * 0.8))
    return F.transform(F.slice(strong, 1, most), lambda r: F.concat_ws("=", r["x"]["dimension"], r["x"]["classification"]))


def reclassify(records: DataFrame, profile: Profile = SHANGHAI_PM) -> DataFrame:
    """Records with directions and tags of the present taxonomy."""
    from ..functions.text import infer_directions

    found = infer_directions(F.col("title"), F.col("job_description_raw"), known("responsibilities"), known("requirements"), profile)
    return records.withColumn("directions", found).withColumn("tags", F.col("directions"))


def score_document(records: DataFrame, metadata: dict[str, str] | None = None, profile: Profile = SHANGHAI_PM) -> tuple[DataFrame, DataFrame]:
    """The adapter's scores, and one row of metadata: what was given, both versions and the number of records."""
    scored = score(records, profile, flavour="py")
    given = [F.lit(v).alias(k) for k, v in (metadata or {}).items() if k not in ("scoring_algorithm_version", "preference_version", "job_count")]
    return scored, scored.agg(F.count("*").alias("job_count")).select(*given, F.lit(profile.version).alias("scoring_algorithm_version"), F.lit(profile.preferences_version).alias("preference_version"), "job_count")
