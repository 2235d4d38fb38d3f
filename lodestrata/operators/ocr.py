"""Captured pages to records: join manifest, card and detail texts, extract fields, and say what needs review."""

from __future__ import annotations

import multiprocessing
import queue
import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import CAUTION, COMPLETE_CAPTURES, CONSIDER, INSUFFICIENT, REJECT, SALARY_K, SHANGHAI_PM, TOP, UNKNOWN, Profile
from ..functions.text import card_hint, clean_lines, first_match, infer_company, infer_directions, merge_pages, page_text, recruiter_type, sections
from ..functions.values import known, no_strings, or_unknown, present
from ..schema import DIMENSIONS, EVIDENCE, conform
from ..sources.envelopes import path_exists
from .dedupe import keep_first, ordered_list
from .score import computed, half_up, infer_ocr


def join_captures(manifest: DataFrame, cards: DataFrame, details: DataFrame) -> DataFrame:
    """Manifest rows (with sequence) with card_text, detail_text (pages merged in order) and detail_files.

    ``cards`` has sequence, name, text; ``details`` has sequence, name, text, a row a page.
    """
    cards = keep_first(cards, "sequence", [F.desc(F.length("name")), "name"])  # four-digit names before three-digit ones
    cards = cards.select("sequence", page_text(F.col("text")).alias("card_text"))
    pages = details.groupBy("sequence").agg(ordered_list(page_text(F.col("text")), [F.col("name")]).alias("pages"), F.array_sort(F.collect_set("name")).alias("detail_files"))
    pages = pages.select("sequence", "detail_files", F.array_join(merge_pages(F.col("pages")), "\n").alias("detail_text"))
    out = manifest.join(cards, "sequence", "left").join(pages, "sequence", "left")
    return out.withColumns({"card_text": F.coalesce("card_text", F.lit("")), "detail_text": F.coalesce("detail_text", F.lit("")), "detail_files": F.coalesce("detail_files", no_strings())})


def structure(captures: DataFrame, profile: Profile = SHANGHAI_PM) -> tuple[DataFrame, DataFrame]:
    """Records, and the review queue (sequence, job_id, url, capture_status, reasons).

    A bad or repeated URL drops the row; other reasons keep it and queue it; without a title it is only queued.
    """
    need = "sequence int, url string, canonical_key string, status string, capture_status string, captured_at string, title_hint string, created_at string, card_text string, detail_text string, detail_files array<string>"
    df = conform(captures, need).withColumn("url", F.trim(F.coalesce("url", F.lit(""))))
    good_url = F.col("url").rlike(rf"(?i)^https://www\.{re.escape(profile.host)}/job_detail/[^/]+\.html$")
    nth = F.row_number().over(Window.partitionBy(F.lower("url")).orderBy("sequence"))
    df = df.withColumn("__drop", F.when(~good_url, "invalid_job_url").when(nth > 1, "duplicate_job_url"))
    dropped = df.where(F.col("__drop").isNotNull()).select("sequence", F.lit(None).cast("string").alias("job_id"), "url", F.lit(None).cast("string").alias("capture_status"), F.array("__drop").alias("reasons"))
    df = df.where(F.col("__drop").isNull()).drop("__drop").withColumn("__status", F.coalesce("status", "capture_status", F.lit(UNKNOWN)))

    card = F.filter(clean_lines(F.col("card_text")), lambda x: ~x.isin("猎头", "急招", "代招") | F.lit(False))
    df = computed(df, __card=card, __detail=clean_lines(F.col("detail_text")), __sections=sections(F.col("detail_text"), profile))
    hint = card_hint(F.col("title_hint"), profile)
    df = df.withColumns({f"__h_{k}": v for k, v in hint.items()})
    titled = lambda lines: F.try_element_at(F.filter(lines, lambda x: x.contains(profile.role)), F.lit(1))
    first = F.try_element_at("__card", F.lit(1))
    title = F.coalesce("__h_title", F.when(first.contains(profile.role), first), titled(F.slice("__detail", 1, 20)))
    df = df.withColumns({"__title": title, "__duties": F.col("__sections.duties"), "__needs": F.col("__sections.needs")})
    listed = lambda values: F.try_element_at(F.filter("__card", lambda x: x.isin(*values)), F.lit(1))
    evidence = F.concat_ws("\n", "card_text", "detail_text")
    found = present((evidence.contains(d), d) for d in profile.districts)
    raw = F.nullif(F.col("detail_text"), F.lit(""))
    df = df.withColumns({
        "__company": F.coalesce("__h_company", infer_company(F.col("__card"), F.col("__title"), profile)),
        "__experience": F.coalesce("__h_experience", listed(profile.experiences)),
        "__education": F.coalesce("__h_education", listed(profile.educations)),
        "__found": found,
        "__district": F.coalesce("__h_district", F.when(F.size(found) == 1, found[0])),
        "__salary": first_match(F.coalesce(raw, F.col("card_text")), SALARY_K),
        "__recruiter": recruiter_type(F.coalesce("title_hint", F.lit("")), F.col("card_text"), F.col("detail_text")),
        "__directions": F.when(F.col("__title").isNotNull(), infer_directions(F.col("__title"), F.concat_ws(" ", F.coalesce("title_hint", F.lit("")), "detail_text"), F.lit(""), F.lit(""), profile)).otherwise(no_strings()),
    })
    marks = "|".join(map(re.escape, (*profile.duty_headings, *profile.requirement_headings)))
    headed = F.exists("__detail", lambda x: x.rlike(rf"^(?:{marks})(?:\s*[:：]|$)"))
    have = F.col("detail_text") != ""
    has_title = F.col("__title").isNotNull()
    reasons = present([
        (~F.col("__status").isin(*COMPLETE_CAPTURES), F.concat(F.lit("capture_status="), "__status")),
        (~has_title, "title_not_confirmed_product_manager"),
        (~have, "missing_detail_ocr"),
        (have & ~headed, "detail_missing_jd_heading"),
        (has_title & have & ~F.col("detail_text").contains(F.col("__title")) & ~F.col("detail_text").contains(F.left("__title", F.lit(6))), "detail_title_mismatch"),
        (F.col("__duties").isNull(), "missing_responsibility"),
        (F.col("__company").isNull(), "company_unknown"),
        (F.col("__h_district").isNull() & (F.size("__found") > 1), "district_conflict"),
    ])
    df = df.withColumn("review_reasons", reasons).withColumn("__ok", F.size("review_reasons") == 0)
    missing = present([(F.col("__company").isNull(), "公司名称"), (F.col("__needs").isNull(), "任职要求"), (F.col("__duties").isNull(), "岗位职责")])
    none = or_unknown(F.lit(None).cast("string"))
    job_id = F.coalesce(F.nullif("canonical_key", F.lit("")), "url")
    records = df.where(has_title).select(
        "sequence", job_id.alias("job_id"), F.col("url").alias("job_url"), F.coalesce(F.nullif("captured_at", F.lit("")), "created_at", F.lit(UNKNOWN)).alias("collected_at"),
        F.when(F.col("__ok"), "open").otherwise(UNKNOWN).alias("job_status"), F.col("__title").alias("job_title"), or_unknown("__company").alias("company_name"),
        F.lit(profile.city).alias("city"), or_unknown("__district").alias("district"), or_unknown("__district").alias("office_location"),
        or_unknown("__salary").alias("salary_range"), or_unknown("__experience").alias("experience_requirement"), or_unknown("__education").alias("education_requirement"),
        *(none.alias(c) for c in ("company_size", "financing_stage", "industry", "recruiter_name", "recruiter_role", "recruiter_activity", "published_or_updated_at", "team_and_reporting", "travel_requirement")),
        or_unknown("__recruiter").alias("recruiter_type"), F.coalesce(raw, F.lit(UNKNOWN)).alias("job_description_raw"),
        or_unknown("__duties").alias("responsibility_summary"), or_unknown("__needs").alias("qualification_summary"), F.col("__directions").alias("product_direction_tags"),
        F.lit(profile.role).alias("role_type"), F.lit("上海现场办公").alias("work_mode"), missing.alias("missing_information"),
        infer_ocr(F.col("__title"), F.col("detail_text"), F.col("__directions"), F.col("__experience"), F.col("__duties"), profile).alias("evaluation"),
        F.col("__status").alias("capture_status"), F.when(F.col("__ok"), "captured_jd").otherwise("needs_review").alias("verification_status"),
        "review_reasons", "detail_files",
    )
    queued = df.where(~F.col("__ok")).select("sequence", job_id.alias("job_id"), "url", F.col("__status").alias("capture_status"), F.col("review_reasons").alias("reasons"))
    return records, dropped.unionByName(queued)


def map_scored(scored: DataFrame, profile: Profile = SHANGHAI_PM) -> DataFrame:
    """Scored captures as contract rows; confidence is the plain share of required dimensions that are known."""
    required = [d for d in DIMENSIONS if d not in profile.non_blocking]
    have = [F.when(F.col("evaluation")[d].isNotNull(), 1).otherwise(0) for d in required]
    known_n = sum((F.when(known(F.col("evaluation")[d]).isNotNull(), 1).otherwise(0) for d in required), F.lit(0))
    whole = known("job_description_raw").isNotNull() & known("responsibility_summary").isNotNull()
    share = F.when((F.col("verification_status") == "captured_jd") & whole, 100).otherwise(profile.incomplete_percent)
    permille = half_up(1000 * known_n * share, 100 * F.greatest(sum(have, F.lit(0)), F.lit(1)))
    labels = {TOP: TOP, "推荐投递": TOP, CONSIDER: CONSIDER, CAUTION: REJECT, REJECT: REJECT}
    label = F.lit(INSUFFICIENT)
    for given, shown in labels.items():
        label = F.when(F.col("recommendation") == given, shown).otherwise(label)
    label = F.when((F.size("review_reasons") > 0) | (permille < 700), INSUFFICIENT).otherwise(label)
    entry = F.struct(F.lit("ocr_jd").alias("type"), F.col("collected_at").alias("observed_at"), *(F.lit(None).cast("string").alias(c) for c in ("url", "query")), F.lit("captured card and detail text, deterministic rules").alias("detail"), *(F.lit(None).cast("string").alias(c) for c in ("provider", "summary")), F.col("capture_status").alias("capture_status"))
    gone = ("公司规模", "融资阶段", *profile.non_blocking)
    return scored.withColumns({
        "evidence_confidence": permille / F.lit(1000.0), "recommendation": label, "pipeline": F.lit("ocr_jd"),
        "evidence_source": F.array(entry).cast(EVIDENCE), "hard_filter_reasons": no_strings(),
        "missing_information": F.filter("missing_information", lambda x: ~x.isin(*gone)),
    }).withColumn("score", F.when(F.col("recommendation") != INSUFFICIENT, F.col("match_score")))


def _in_child(engine: Callable[[bytes], str], sender, receiver) -> None:
    """A recogniser's process: images in, (text, error) out, one at a time."""
    while True:
        content = receiver.recv()
        if content is None:
            return
        try:
            sender.send((engine(content), None))
        except Exception as e:  # one bad image must not end the process
            sender.send((None, repr(e)[:500]))


class _Recogniser:
    """One process that recognises images. An image that takes too long costs its limit and the process, which is killed."""

    def __init__(self, engine: Callable[[bytes], str], timeout: float):
        self.engine, self.timeout, self.process = engine, timeout, None

    def _start(self) -> None:
        context = multiprocessing.get_context("fork")
        (self.got, sender), (receiver, self.asked) = context.Pipe(False), context.Pipe(False)
        self.process = context.Process(target=_in_child, args=(self.engine, sender, receiver), daemon=True)
        self.process.start()
        sender.close()
        receiver.close()

    def __call__(self, content: bytes) -> tuple[str | None, str | None]:
        if self.process is None:
            self._start()
        try:
            self.asked.send(content)
            if self.got.poll(self.timeout):
                return self.got.recv()
            why = f"more than {self.timeout:g} s"
        except (EOFError, OSError):
            why = "the recogniser's process ended"
        self.close(kill=True)
        return None, why

    def close(self, kill: bool = False) -> None:
        if self.process is not None:
            if kill:
                self.process.kill()
            else:
                self.asked.send(None)
            self.process.join()
            self.got.close()
            self.asked.close()
            self.process = None


def recognise(images: DataFrame, engine: Callable[[bytes], str], timeout: float = 120.0, workers: int = 2) -> DataFrame:
    """Of binary files (path, content): path, text, error. ``engine`` maps bytes to text; a failure is kept apart from text.

    A task has ``workers`` processes at most, each with one image at a time. The limit is enforced from outside: an
    engine that hangs is killed with its process, and the next image gets a new one. A null image is an error.
    """

    def run(batches):
        pool = [_Recogniser(engine, timeout) for _ in range(workers)]
        free: queue.SimpleQueue = queue.SimpleQueue()
        for r in pool:
            free.put(r)

        def one(content: bytes | None) -> tuple[str | None, str | None]:
            if content is None:
                return None, "no content"
            r = free.get()
            try:
                return r(content)
            finally:
                free.put(r)

        try:
            with ThreadPoolExecutor(workers) as threads:
                for b in batches:
                    found = list(threads.map(one, b.column(1).to_pylist()))
                    yield pa.record_batch([b.column(0), pa.array([t for t, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], names=["path", "text", "error"])
        finally:
            for r in pool:
                r.close()

    return images.select("path", "content").mapInArrow(run, "path string, text string, error string")


def recognise_new(images: DataFrame, done: DataFrame | None, engine: Callable[[bytes], str], timeout: float = 120.0, workers: int = 2) -> DataFrame:
    """``recognise`` of the images whose path has no text in ``done`` yet; failed ones are tried again."""
    if done is not None:
        images = images.join(done.where("text is not null").select("path").distinct(), "path", "left_anti")
    return recognise(images, engine, timeout, workers)


def recognise_stream(spark: SparkSession, landing: str, out: str, checkpoint: str, engine: Callable[[bytes], str], *, pattern: str = "*", timeout: float = 120.0, workers: int = 2) -> StreamingQuery:
    """Recognise the images that have landed, each once, then stop; ``out`` gains a row for each."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(landing)

    def step(batch: DataFrame, n: int) -> None:
        known = spark.read.schema("path string, text string, error string").parquet(out) if path_exists(spark, out) else None
        recognise_new(batch, known, engine, timeout, workers).write.mode("append").parquet(out)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def out_of_scope(records: DataFrame, profile: Profile = SHANGHAI_PM) -> Column:
    return ~(F.col("city").eqNullSafe(F.lit(profile.city)) & F.coalesce(F.col("title").contains(profile.role), F.lit(False)))


def in_scope(records: DataFrame, profile: Profile = SHANGHAI_PM, only_complete: bool = False) -> DataFrame:
    """Records of the domain; with ``only_complete`` those alone whose text and duties are known."""
    df = records.where(~out_of_scope(records, profile))
    return df.where(known("job_description_raw").isNotNull() & known("responsibilities").isNotNull()) if only_complete else df
