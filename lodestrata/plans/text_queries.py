"""Text, URL and extraction queries over the driver's tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SHANGHAI_PM
from ..functions.text import clean_lines, fact_evidence, facts_of, infer_directions, list_items, merge_pages, normalize_text, normalize_title, recruiter_type, sections
from ..functions.url import canonical_url, site_key, url_job_id, url_kind
from ..functions.values import present
from ..operators.dedupe import keep_first, ordered_list
from ..operators.metrics import counted, rejections
from ..operators.normalize import normalize_results
from ..operators.score import computed
from ..sources.captures import card_links

RULES = (("article", ("the ", "that ")), ("german", ("der ", "und ")), ("french", ("les ", "que ")), ("spanish", ("que ", "los ")), ("table", (" | ",)), ("marked", ("%%%", "###")), ("mail", ("@",)))
P = SHANGHAI_PM
#: The profile with lists that the test tables have words of.
PROSE = replace(P, directions=RULES, default_direction="plain", index_tags=RULES, experiences=("password", "license", "token"), educations=("the", "und", "les"), index_districts=("src", "that", "der", "que"))


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _hosted(url):
    """A page's URL under the profile's host, articles as detail pages and the rest as it is; every ninth keeps its own host."""
    path = F.regexp_replace(F.col(url), r"/[a-z]{2}/(\d+)(?:\.html)?(?=$|[?#])", "//job_detail/$1.html")
    moved = F.regexp_replace(F.regexp_replace(path, r"^(https?://)(m\.)?[^/]+", f"$1$2{P.host}:8443"), r"/en/(\d+)/", "/zhaopin/$1/")
    return F.when(F.col("page_id") % 9 == 0, F.col(url)).otherwise(moved)


def url_canonical(spark, d):
    return _t(spark, d, "pages").select("page_id", canonical_url(_hosted("url")).alias("canonical"))


def url_classify(spark, d):
    url = canonical_url(_hosted("url"))
    return _t(spark, d, "pages").select("page_id", url_kind(url).alias("kind"), url_job_id(url).alias("number"))


def url_dedupe_first(spark, d):
    df = _t(spark, d, "pages").select("page_id", site_key(F.col("url")).alias("site"))
    return keep_first(df, "site", ["page_id"])


def html_to_text(spark, d):
    return _t(spark, d, "pages").select("page_id", normalize_text(F.col("html")).alias("plain"))


def link_extract(spark, d):
    out = card_links(_t(spark, d, "pages").select("page_id", "html"))
    return out.select("page_id", F.col("place").cast("long").alias("place"), "href")


def title_strip(spark, d):
    pay = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("  "), "p_size", F.lit("-99K·13薪 "))).when(F.col("p_size") % 3 == 1, F.concat("p_size", F.lit("-900元/天"))).otherwise("")
    title = F.when(F.col("p_size") % 7 == 0, pay).otherwise(F.concat(F.lit("<b>"), "p_name", F.lit("</b> "), pay))
    return _t(spark, d, "part").select("p_partkey", normalize_title(title).alias("stem"))


def fact_extract(spark, d):
    title = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("职位 "), F.col("doc_id") % 50, F.lit("-60k·14薪")))
    found = facts_of(F.col("evidence"), PROSE)
    rows = computed(_t(spark, d, "documents"), evidence=fact_evidence(title, F.col("text")))
    return rows.select("doc_id", F.md5("evidence").alias("evidence_md5"), *(found[c].alias(c) for c in ("salary", "experience", "education", "district")), F.array_join(found["tags"], ",").alias("tags"))


def q_clean_lines(spark, d):
    lines = clean_lines(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.md5(F.array_join(lines, "\n")).alias("lines_md5"))


def page_overlap_merge(spark, d):
    df = _t(spark, d, "conversations").groupBy("conv_id").agg(ordered_list(F.col("text"), [F.col("turn")]).alias("pages"))
    return df.select("conv_id", F.size(merge_pages(F.col("pages"))).alias("n_lines"), F.md5(F.array_join(merge_pages(F.col("pages")), "\n")).alias("lines_md5"))


def section_split(spark, d):
    """Every text under headings: duties, then, for all but each fifth document, requirements."""
    need = F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("\n（任职要求）\n"), "lang", F.lit("： \n"), "source", F.lit(";")))
    page = F.concat(F.lit("公司\n【一、岗位职责：】\n"), "text", F.coalesce(need, F.lit("")))
    both = sections(F.when(F.col("doc_id") % 11 == 0, F.col("text")).otherwise(page), P)
    return computed(_t(spark, d, "documents"), both=both).select("doc_id", F.md5("both.duties").alias("duties_md5"), F.col("both.needs").alias("needs"))


def q_recruiter_type(spark, d):
    said = F.regexp_replace("text", "(?i)password|token", "猎头")
    asks = F.when(F.col("text").contains("?"), F.lit("招聘顾问"))
    return _t(spark, d, "conversations").select("conv_id", "turn", recruiter_type(said, asks).alias("kind"))


def _directions(spark, d) -> DataFrame:
    nothing = F.lit(None).cast("string")
    tags = infer_directions(F.col("lang"), F.col("text"), F.when(F.col("doc_id") % 6 == 0, F.lit("岗位职责 | der 求职工具 the")), nothing, PROSE)
    return _t(spark, d, "documents").select("doc_id", tags.alias("directions"))


def direction_tags(spark, d):
    return _directions(spark, d).select("doc_id", F.array_join("directions", ",").alias("tags"))


def direction_counts(spark, d):
    return counted(_directions(spark, d), "directions").withColumnRenamed("directions", "tag")


def item_split_top3(spark, d):
    numbered = F.concat(F.lit("1、"), F.regexp_replace("text", r"\n", F.lit(" 2) ")), F.lit("；3．der"))
    return _t(spark, d, "documents").select("doc_id", F.array_join(list_items(numbered), "|").alias("items"))


def reject_reasons(spark, d):
    """Pages as search results: every fourth of another host, every third without the role, every fifth without the city."""
    n, url = F.col("page_id"), F.concat(F.lit(f"https://m.{P.host}/job_detail/"), F.col("page_id"), F.lit(".html?ref=x"))
    results = _t(spark, d, "pages").select(
        F.when(n % 4 == 0, F.col("url")).otherwise(url).alias("url"), F.when(n % 3 == 0, "Engineer").otherwise(f"&lt;{P.role} 20-30K").alias("title"),
        F.when(n % 5 == 0, F.lit("elsewhere")).otherwise(F.lit(f"{P.city} 浦东")).alias("description"), F.lit("p").alias("provider"), F.lit("q").alias("query"),
        F.lit("exact").alias("mode"), n.alias("rank"), F.lit("2024-01-01").alias("collected_at"),
    )
    return rejections(normalize_results(results))


def review_queue(spark, d):
    docs = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")
    reasons = present([
        (F.col("quality").isNull(), "unlabelled"), (F.col("quality") == 0, "low_quality"), (F.col("toxic") == 1, "toxic"),
        (F.col("n_chars") < 200, "short"), (F.col("text").contains("password"), F.concat(F.lit("secret="), "source")),
    ])
    return docs.select("doc_id", reasons.alias("reasons")).where(F.size("reasons") > 0).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


_SPACE = r"regexp_replace(trim(regexp_replace({}, '\s+', ' ', 'g')), '^ | $', '', 'g')"


def _decoded(column: str) -> str:
    for pattern, plain, flags in (("<[^>]*>", " ", "g"), ("&nbsp;|&#160;", " ", "gi"), ("&amp;", "&", "gi"), ("&quot;|&#34;", '"', "gi"), ("&#39;|&apos;", "''", "gi"), ("&lt;", "<", "gi"), ("&gt;", ">", "gi")):
        column = f"regexp_replace({column}, '{pattern}', '{plain}', '{flags}')"
    return column


def _tags(column: str) -> str:
    has = lambda words: " OR ".join(f"contains({column}, '{w}')" for w in words)
    return "list_filter([" + ", ".join(f"CASE WHEN {has(words)} THEN '{label}' END" for label, words in RULES) + "], lambda x: x IS NOT NULL)"


_URL = r"regexp_extract(url, '^\s*(?i:https?|wss?|ftp)://([^/?#@]*@)?([^/?#:@]+)(:\d*)?([^?#]*)', {})"
_MOVED = rf"""CASE WHEN page_id % 9 = 0 THEN NULL WHEN regexp_matches(url, '^https?://[^/]+/[a-z]{{2}}/\d+(\.html)?($|[?#])') THEN '/job_detail/' || regexp_extract(url, '/[a-z]{{2}}/(\d+)', 1) || '.html'
    ELSE regexp_replace(regexp_replace(CASE WHEN {_URL.format(4)} = '' THEN '/' ELSE {_URL.format(4)} END, '/{{2,}}', '/', 'g'), '/en/(\d+)/', '/zhaopin/\1/') END"""
_DIRECTIONS = f"""b AS (SELECT doc_id, lang || chr(10) || CASE WHEN doc_id % 6 = 0 THEN '岗位职责 | der ' ELSE {_SPACE.format('text')} END AS body FROM documents),
t AS (SELECT doc_id, {_tags('body')} AS t FROM b),
l AS (SELECT doc_id, CASE WHEN len(t) = 0 THEN ['plain'] ELSE t[1:4] END AS t FROM t)"""

QUERIES = {
    "url_canonical": url_canonical, "url_classify": url_classify, "url_dedupe_first": url_dedupe_first, "html_to_text": html_to_text,
    "link_extract": link_extract, "title_strip": title_strip, "fact_extract": fact_extract, "clean_lines": q_clean_lines,
    "page_overlap_merge": page_overlap_merge, "section_split": section_split, "recruiter_type": q_recruiter_type, "direction_tags": direction_tags,
    "direction_counts": direction_counts, "item_split_top3": item_split_top3, "reject_reasons": reject_reasons, "review_queue": review_queue,
}

SQL = {
    "url_canonical": f"WITH m AS (SELECT page_id, {_MOVED} AS path FROM pages) SELECT page_id, 'https://www.{P.host}' || path AS canonical FROM m",
    "url_classify": rf"""
WITH m AS (SELECT page_id, {_MOVED} AS path FROM pages)
SELECT page_id, CASE WHEN path IS NULL THEN 'unsupported' WHEN regexp_matches(path, '^/job_detail/[^/]+\.html/?$') THEN 'job_detail' WHEN starts_with(path, '/zhaopin/') THEN 'listing' ELSE 'other_boss' END AS kind,
       nullif(regexp_extract(path, '^/job_detail/([^/]+)\.html/?$', 1), '') AS number FROM m""",
    "url_dedupe_first": rf"""
WITH k AS (SELECT page_id, regexp_replace(lower({_URL.format(2)}), '^(?:www|m|blog)\.', '') AS site FROM pages)
SELECT page_id, site FROM k QUALIFY row_number() OVER (PARTITION BY site ORDER BY page_id) = 1""",
    "html_to_text": f"SELECT page_id, {_SPACE.format(_decoded('html'))} AS plain FROM pages",
    "link_extract": r"""
WITH a AS (SELECT page_id, regexp_extract_all(html, '(?s)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1) AS l FROM pages),
u AS (SELECT page_id, unnest(l) AS href, unnest(generate_series(0, len(l) - 1)) AS place FROM a)
SELECT page_id, min(place) AS place, href FROM u GROUP BY page_id, href""",
    "title_strip": """
SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_name WHEN p_size % 3 = 0 THEN p_size || '-99K·13薪' WHEN p_size % 3 = 1 THEN p_size || '-900元/天' ELSE '' END AS stem FROM part""",
    "fact_extract": f"""
WITH e AS (SELECT doc_id, {_SPACE.format(_decoded("concat_ws(' ', CASE WHEN doc_id % 4 = 0 THEN '职位 ' || doc_id % 50 || '-60k·14薪' END, text)"))} AS e FROM documents)
SELECT doc_id, md5(e) AS evidence_md5, nullif(regexp_extract(e, '(?i)(?:[0-9]+(?:\\.[0-9]+)?-[0-9]+(?:\\.[0-9]+)?K(?:·[0-9]+薪)?|[0-9]+-[0-9]+元/(?:时|天))', 0), '') AS salary,
       nullif(regexp_extract(e, 'password|license|token', 0), '') AS experience, nullif(regexp_extract(e, 'the|und|les', 0), '') AS education,
       CASE {' '.join(f"WHEN contains(e, '{w}') THEN '{w}'" for w in ('src', 'that', 'der', 'que'))} END AS district, array_to_string({_tags('lower(e)')}, ',') AS tags FROM e""",
    "clean_lines": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents),
c AS (SELECT doc_id, i, trim(regexp_replace(x, '\s+', ' ', 'g')) AS x FROM l),
f AS (SELECT doc_id, x, min(i) AS i FROM c WHERE x <> '' GROUP BY doc_id, x)
SELECT d.doc_id, count(f.x) AS n_lines, md5(coalesce(string_agg(f.x, chr(10) ORDER BY f.i), '')) AS lines_md5 FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id""",
    "section_split": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents WHERE doc_id % 11 <> 0),
c AS (SELECT doc_id, i, trim(regexp_replace(x, '\s+', ' ', 'g')) AS x FROM l),
f AS (SELECT doc_id, x, min(i) AS i FROM c WHERE x <> '' GROUP BY doc_id, x),
s AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS s FROM f GROUP BY doc_id)
SELECT doc_id, md5(nullif(trim(left(s, 1200), ' ：:;；'), '')) AS duties_md5, CASE WHEN doc_id % 11 <> 0 AND doc_id % 5 <> 0 THEN lang || '： ' || source END AS needs FROM documents LEFT JOIN s USING (doc_id)""",
    "recruiter_type": """
SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)password|token') OR contains(text, '猎头') THEN '猎头' WHEN contains(text, '?') OR contains(lower(text), 'hr') THEN 'HR' END AS kind FROM conversations""",
    "page_overlap_merge": r"""
WITH l AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM conversations),
p AS (SELECT conv_id, turn, list_filter(l, lambda x, i: list_position(l, x) = i) AS p FROM l),
g AS (SELECT conv_id, list(p ORDER BY turn) AS g FROM p GROUP BY conv_id),
m AS (SELECT conv_id, list_reduce(g, lambda a, b: list_concat(a, b[list_max(list_filter(range(0, 13), lambda n: n <= len(a) AND n <= len(b) AND a[len(a) - n + 1:] = b[1:n])) + 1:]), CAST([] AS VARCHAR[])) AS m FROM g)
SELECT conv_id, len(m) AS n_lines, md5(array_to_string(m, chr(10))) AS lines_md5 FROM m""",
    "item_split_top3": r"""
WITH n AS (SELECT doc_id, '1、' || replace(text, chr(10), ' 2) ') || '；3．der' AS t FROM documents),
s AS (SELECT doc_id, string_split(regexp_replace(t, '(^|[\s;；。])(\d{1,2}[、.．)）])', chr(1) || '\1\2', 'g'), chr(1)) AS l FROM n),
i AS (SELECT doc_id, list_filter(list_transform(l, lambda x: regexp_replace(regexp_replace(x, '^[\s;；。]*\d{1,2}[、.．)）]\s*', ''), '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 4) AS l FROM s),
k AS (SELECT doc_id, l, list_transform(l, lambda x: left(x, 24)) AS k FROM i)
SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(k, left(x, 24)) = i)[1:3], '|') AS items FROM k""",
    "direction_tags": f"WITH {_DIRECTIONS} SELECT doc_id, array_to_string(t, ',') AS tags FROM l",
    "direction_counts": f"WITH {_DIRECTIONS}, u AS (SELECT unnest(t) AS tag FROM l) SELECT tag, count(*) AS n FROM u GROUP BY tag",
    "reject_reasons": """
WITH r AS (SELECT CASE WHEN page_id % 4 = 0 THEN 'unsupported_url' WHEN page_id % 3 = 0 THEN 'title_not_product_manager' WHEN page_id % 5 = 0 THEN 'city_not_confirmed_shanghai' END AS reason FROM pages)
SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason""",
    "review_queue": """
WITH r AS (SELECT doc_id, list_filter([CASE WHEN quality IS NULL THEN 'unlabelled' END, CASE WHEN quality = 0 THEN 'low_quality' END, CASE WHEN toxic = 1 THEN 'toxic' END,
  CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN contains(text, 'password') THEN 'secret=' || source END], lambda x: x IS NOT NULL) AS r FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, array_to_string(r, ',') AS reasons FROM r WHERE len(r) > 0""",
}
