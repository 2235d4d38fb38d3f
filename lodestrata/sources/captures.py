"""Readers of capture runs: manifests, recognised texts, screenshots, and what pages link to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import COMPLETE_CAPTURES, SHANGHAI_PM, UNKNOWN, Profile
from ..functions.url import strict_detail_url
from ..operators.dedupe import keep_first
from ..schema import MANIFEST, fields
from .envelopes import path_exists


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """A row a captured record of every readable manifest: file, run_id, created_at, ord and the record's columns."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], fields("file string, run_id string, created_at string, ord int, sequence int, url string"))
    df = spark.read.schema(fields(MANIFEST)).option("multiLine", True).option("mode", "PERMISSIVE").json(path).select("*", F.col("_metadata.file_path").alias("file"))
    return df.select("file", "run_id", "created_at", F.posexplode("jobs").alias("ord", "job")).select("file", "run_id", "created_at", "ord", "job.*")


def seen_urls(manifests: DataFrame) -> DataFrame:
    return manifests.where(F.coalesce("url", F.lit("")) != "").select("url").distinct()


def last_urls(urls: Column, most: int) -> Column:
    """The last ``most`` items of a list."""
    return F.slice(urls, -F.least(F.size(urls), F.lit(most)), F.greatest(F.least(F.size(urls), F.lit(most)), F.lit(0)))


def read_texts(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Recognised texts named job_<sequence>_<kind>…: sequence, name, text. Three and four digits are read."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "sequence int, name string, text string")
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    pattern = rf"^job_(\d{{3,4}})_{kind}(?:_\d+)?\.txt$"
    return df.where(F.col("name").rlike(pattern)).select(F.regexp_extract("name", pattern, 1).cast("int").alias("sequence"), "name", "text")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg}").load(path).select("path", "content")


def pending_images(images: DataFrame, done: DataFrame) -> DataFrame:
    """Images without a text; failed ones (no text) are tried again."""
    return images.join(done.where(F.col("text").isNotNull()).select("path"), "path", "left_anti")


def runnable(manifests: DataFrame, prefix: str = "") -> DataFrame:
    """Runs that can be processed: a capture's folder by its name, records, and a screenshot somewhere."""
    shots = F.count_if(F.coalesce("card_screenshot", F.lit("")) != "") + F.count_if(F.size(F.coalesce("detail_screenshots", F.array().cast("array<string>"))) > 0)
    folder = F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)
    found = manifests.groupBy("file", "run_id").agg(F.count("*").alias("records"), shots.alias("shots")).where((F.col("records") > 0) & (F.col("shots") > 0))
    return found.where(folder.startswith(prefix)) if prefix else found


def decode_image(data_url: Column) -> Column:
    """Bytes of a base64 data URL of a PNG or JPEG; NULL for anything else."""
    body = F.nullif(F.regexp_extract(data_url, r"^data:image/(?:png|jpe?g);base64,([A-Za-z0-9+/]+=*)$", 1), F.lit(""))
    return F.unbase64(body)


def screenshot_name(sequence: Column, kind: Column, page: Column) -> Column:
    return F.concat(F.format_string("job_%04d_", sequence), kind, F.when(page.isNotNull(), F.format_string("_%02d", page)).otherwise(""), F.lit(".png"))


def safe_run_id(text: Column) -> Column:
    return F.left(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9_-]", "-"), F.lit(80))


def card_links(pages: DataFrame, pattern: str = r'<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', hint: int = 200) -> DataFrame:
    """Distinct links of each page (page_id, html) in order: page_id, place, href, hint."""
    found = F.arrays_zip(F.regexp_extract_all("html", F.lit(f"(?s){pattern}"), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(f"(?s){pattern}"), F.lit(2)).alias("body"))
    df = pages.select("page_id", F.posexplode(found).alias("place", "a")).select("page_id", "place", "a.href", F.left(F.regexp_replace("a.body", r"<[^>]*>|\s+", " "), F.lit(hint)).alias("hint"))
    df = df.withColumn("__key", F.struct("page_id", "href"))
    return keep_first(df, "__key", ["place"]).drop("__key")


def import_manifest(entries: DataFrame, profile: Profile = SHANGHAI_PM) -> DataFrame:
    """Placeholder rows of records known by their URL alone, one for each key whatever its case."""
    df = entries.withColumn("__key", F.lower(F.coalesce(F.nullif("canonical_key", F.lit("")), "url")))
    df = keep_first(df, "__key", ["ord"]).drop("__key")
    return df.select(
        strict_detail_url(F.col("url"), profile.host).alias("url"), F.coalesce("title_hint", F.lit(UNKNOWN)).alias("title"), F.lit(profile.city).alias("city"),
        F.lit("ocr_jd").alias("pipeline"), F.lit("needs_review").alias("verification_status"), F.col("captured_at").alias("collected_at"),
        F.array(F.lit("manifest_only")).alias("review_reasons"),
    )


def is_detail_page(text: Column, profile: Profile = SHANGHAI_PM) -> Column:
    return text.rlike("|".join((*profile.duty_headings, *profile.requirement_headings)))


def is_security_page(text: Column) -> Column:
    return text.rlike("(?i)安全验证|人机验证|访问验证|captcha|验证码")


def complete(status: Column) -> Column:
    return status.isin(*COMPLETE_CAPTURES)
