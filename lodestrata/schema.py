"""Schemas of the record tables, and a helper that gives any input the columns it lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPONENTS = "array<struct<dimension: string, classification: string, weight: int, known: boolean, points: double>>"
EVIDENCE = "array<struct<type: string, observed_at: string, url: string, query: string, detail: string, provider: string, summary: string, capture_status: string>>"
RISKS = "array<struct<reason: string, severity: string, hard_reject: boolean, evidence: string>>"
DIMENSIONS = (
    "title_fit", "city_fit", "direction_fit", "product_form_fit", "product_layer_fit", "financing_fit", "responsibility_fit", "role_fit",
    "experience_fit", "company_quality", "freshness_fit", "mandatory_requirement_fit", "team_quality", "work_mode_fit", "growth_value", "risk_fit",
)
EVALUATION = f"struct<{', '.join(f'{d}: string' for d in DIMENSIONS)}>"

#: The contract record.
RECORD = f"""id string, url string, title string, company string, city string, district string, office_location string, salary string,
workExperience string, education string, company_size string, financing_stage string, industry string, recruiter_type string,
description string, job_description_raw string, responsibilities string, requirements string, pipeline string, verification_status string,
capture_status string, scoring_config_version string, job_status string, recommendation string, work_mode string, recruiter_activity string,
published_or_updated_at string, collected_at string, first_seen_at string, last_seen_at string, seen_count long, tags array<string>,
directions array<string>, missing_information array<string>, review_reasons array<string>, hard_filter_reasons array<string>,
interview_questions array<string>, risk_flags {RISKS}, score_components {COMPONENTS}, evidence_source {EVIDENCE}, evaluation {EVALUATION},
match_score double, score double, evidence_confidence double, extra map<string,string>"""

INDEX_EVIDENCE = "struct<provider: string, query: string, query_mode: string, result_rank: int, result_title: string, result_description: string, verification_status: string>"

#: A search result as it comes.
RESULT = """title string, url string, description string, extra_snippets array<string>, company string, company_name string, location string,
office_location string, city string, district string, salary_range string, experience_requirement string, education_requirement string,
industry string, company_size string, financing_stage string, job_description_raw string, responsibility_summary string,
qualification_summary string, product_direction_tags array<string>, product_form_tags array<string>, product_layer_tags array<string>,
role_type string, team_and_reporting string, work_mode string, travel_requirement string, recruiter_activity string,
published_or_updated_at string, source_url string, evidence_source string, field_evidence map<string,string>,
information_confidence map<string,string>"""

#: A file of search results: batches under either name.
_BATCH = f"array<struct<query: string, mode: string, page: int, round: int, moreResultsAvailable: boolean, results: array<struct<{', '.join(x.strip().replace(' ', ': ', 1) for x in RESULT.replace(chr(10), ' ').split(', '))}>>>>"
ENVELOPE = f"captured_at string, note string, request_count int, query_count int, queries {_BATCH}, batches {_BATCH}"

#: A public record after normalisation.
INDEXED = f"""job_id string, job_url string, source_url string, evidence_source string, collected_at string, first_seen_at string,
last_seen_at string, seen_count long, job_status string, job_title string, company_name string, company_size string, financing_stage string,
industry string, office_location string, city string, district string, salary_range string, experience_requirement string,
education_requirement string, job_description_raw string, responsibility_summary string, qualification_summary string, role_type string,
team_and_reporting string, work_mode string, travel_requirement string, recruiter_activity string, published_or_updated_at string,
product_direction_tags array<string>, product_form_tags array<string>, product_layer_tags array<string>, missing_information array<string>,
review_reasons array<string>, field_evidence map<string,string>, information_confidence map<string,string>, direction_fit string,
index_evidence {INDEX_EVIDENCE}, index_evidence_all array<{INDEX_EVIDENCE}>"""

#: A capture run.
MANIFEST = """created_at string, run_id string, source string, finalized_at string, jobs array<struct<sequence: int, canonical_key: string,
url: string, status: string, capture_status: string, captured_at: string, title_hint: string, page_state: string, card_screenshot: string,
detail_screenshots: array<string>>>"""


def fields(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """The schema's columns in its order, NULL where ``df`` has none; other columns go last."""
    schema = fields(ddl)
    have = {f.name: f.dataType for f in df.schema}

    def column(f: T.StructField):
        if have.get(f.name) == f.dataType:
            return f"`{f.name}`"
        return (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)

    wanted = [column(f) for f in schema]
    names = {f.name for f in schema}
    return df.select(*wanted, *(F.col(f"`{c}`") for c in df.columns if c not in names))
