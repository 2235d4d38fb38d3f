import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.functions.values import contains_any
from lodestrata.functions import url as U


def one(spark, value, *columns):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


@pytest.mark.parametrize("url, canonical, kind, job", [
    ("http://m.zhipin.com//job_detail//Ab1~.html?ka=x#top", "https://www.zhipin.com/job_detail/Ab1~.html", "job_detail", "Ab1~"),
    ("https://www.zhipin.com:8443/job_detail/x.html/", "https://www.zhipin.com/job_detail/x.html/", "job_detail", "x"),
    ("https://ZHIPIN.com/zhaopin/abc/?page=2", "https://www.zhipin.com/zhaopin/abc/", "listing", None),
    ("https://www.zhipin.com", "https://www.zhipin.com/", "other_boss", None),
    ("https://www.zhipin.com/a b|\"c", "https://www.zhipin.com/a%20b|%22c", "other_boss", None),
    ("https://notzhipin.com/job_detail/x.html", None, "unsupported", None),
    ("https://zhipin.com.evil.org/job_detail/x.html", None, "unsupported", None),
    ("not a url", None, "unsupported", None),
    (None, None, "unsupported", None),
])
def test_canonical_url(spark, url, canonical, kind, job):
    c = U.canonical_url(F.col("x"))
    assert tuple(one(spark, url, c, U.url_kind(c), U.url_job_id(c))) == (canonical, kind, job)


def test_strict_url_takes_fewer_hosts_and_paths(spark):
    assert one(spark, "https://m.zhipin.com/job_detail/x.html?y", U.strict_detail_url(F.col("x")))[0] == "https://www.zhipin.com/job_detail/x.html"
    assert one(spark, "https://blog.zhipin.com/job_detail/x.html", U.strict_detail_url(F.col("x")))[0] is None


def test_normalize_text_decodes_in_order(spark):
    got = one(spark, " <b>A</b>&nbsp;&amp;lt;　&quot;b&#39;﻿", T.normalize_text(F.col("x")))[0]
    assert got == "A <\"b'" or got == "A < \"b'"


def test_titles_lose_pay_but_not_everything(spark):
    assert one(spark, "用户产品经理 20-35K·15薪", T.normalize_title(F.col("x")))[0] == "用户产品经理"
    assert one(spark, "20-35K", T.normalize_title(F.col("x")))[0] == "20-35K"


def test_facts(spark):
    f = T.facts(F.col("x"), F.lit("上海徐汇 3-5年 本科 电商 订单 30-50K"))
    row = one(spark, "增长产品经理", f["salary"], f["experience"], f["education"], f["district"], f["tags"])
    assert tuple(row) == ("30-50K", "3-5年", "本科", "徐汇", ["用户增长", "交易", "电商"])


def test_pages_merge_without_their_overlap(spark):
    df = spark.createDataFrame([(["a\nb\nc", "b\nc\nd", "", "d\nd\ne"],)], "p array<string>")
    assert df.select(T.merge_pages(F.col("p"))).first()[0] == ["a", "b", "c", "d", "e"]


def test_page_text(spark):
    c = T.page_text(F.col("x"))
    assert one(spark, '{"status":"ok","lines":[{"text":" a "},{"text":""},{"text":"b"}]}', c)[0] == "a\nb"
    assert one(spark, '{"status":"error"}', c)[0] == ""
    assert one(spark, "plain text", c)[0] == "plain text"


def test_a_page_that_only_begins_as_json_is_plain_text(spark):
    c = T.page_text(F.col("x"))
    for text in ("4763 Of the", "true story", '"a" b', "[1] a note", '{"status":"ok"} b', "1] x", "1, 2", "", " "):
        assert one(spark, text, c)[0] == text
    for text in ("4763", ' {"status":"error"}\n', "[1]", "null"):
        assert one(spark, text, c)[0] == ""
    assert one(spark, None, c)[0] is None


def test_sections(spark):
    duties, needs = T.split_sections(F.col("x"))
    row = one(spark, "标题\n【岗位职责】\n一、负责增长\n二、负责转化；\n任职要求：\n本科", duties, needs)
    assert tuple(row) == ("一、负责增长 二、负责转化", "本科")
    assert tuple(one(spark, "没有标题", duties, needs)) == (None, None)


def test_white_space_as_the_patterns_have_it(spark):
    """Runs and ends against the patterns; no pattern looks for an end, as that takes a try at every run."""
    blanks = [chr(c) for c in (*range(9, 14), 0x1C, 0x1F, 32, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)]
    texts = ["", " ", "a", "a b", *(f"{x}a{x}b {x}c{x} d{x}{x}e{x}" for x in blanks), "".join(blanks), None]
    rows = spark.createDataFrame([(t,) for t in texts], "x string")
    ends = lambda c: F.regexp_replace(c, f"^{T.WS}+|{T.WS}+$", "")
    got = rows.select("x", T.strip(F.col("x")).alias("a"), T.squeeze(F.col("x")).alias("b"))
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.select("x", ends(F.col("x")).alias("a"), ends(F.regexp_replace("x", f"{T.WS}+", " ")).alias("b")).collect()))
    assert "+$" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_facts_read_evidence_that_is_made_once(spark, tmp_path):
    from lodestrata.plans.text_queries import fact_extract

    spark.createDataFrame([(4, "a &lt;b> <i>x</i>")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = fact_extract(spark, str(tmp_path))
    assert out.count() == 1 and out._jdf.queryExecution().optimizedPlan().toString().count("<[^>]*>") == 1


def test_words_by_their_first_character(spark):
    c = contains_any(F.col("x"), ("]x", "^", "-a", "的"))
    assert [one(spark, t, c)[0] for t in ("a]x", "]", "^", "-", "b-a", "x的", "")] == [True, False, True, False, True, True, False]


def test_card_hint(spark):
    h = T.card_hint(F.col("x"))
    row = one(spark, "用户产品经理 20-35K 3-5年 本科 C端产品 某某科技 上海 浦东新区 张江", *(h[k] for k in ("title", "company", "experience", "education", "district")))
    assert tuple(row) == ("用户产品经理", "某某科技", "3-5年", "本科", "浦东新区")
    assert tuple(one(spark, "", *(h[k] for k in ("title", "company", "district")))) == (None, None, None)


def test_directions_are_the_first_four_with_a_default(spark):
    make = lambda body: T.infer_directions(F.col("x"), F.lit(body), F.lit(""), F.lit(""))
    assert one(spark, "AI 产品经理", make("电商 履约 增长 搜索 社区"))[0] == ["AI应用", "交易", "履约", "用户增长"]
    assert one(spark, "产品经理", make(""))[0] == ["用户产品"]
    assert one(spark, "产品经理", make("岗位职责 增长 求职工具 物流"))[0] == ["用户增长"]


def test_recruiters_and_items(spark):
    assert one(spark, "猎头 HR", T.recruiter_type(F.col("x")))[0] == "猎头"
    assert one(spark, "资深hr", T.recruiter_type(F.col("x")))[0] == "HR"
    assert one(spark, "1、负责产品规划 2、负责数据分析 3、负责产品规划 4、短 5、推动上线落地", T.list_items(F.col("x")))[0][:2] == ["负责产品规划", "负责数据分析"]


def test_index_summary(spark):
    assert one(spark, "上海 3-5年；负责增长", T.display_summary(F.col("x")))[0] == "负责增长"
    assert one(spark, "上海；", T.display_summary(F.col("x")))[0] == "上海；"


def test_detail_urls_that_are_canonical_take_one_pattern(spark):
    """The short way gives what the long one gives, and the long one stands in a plan once (F4)."""
    head = "https://www.zhipin.com/job_detail/"
    urls = [f"{head}a.html", f"{head}A~b_1%20.html", f"{head}a.HTML", f"{head}a.html\n", f"{head}a b.html", f"{head}职.html", f"{head}.html", f"{head}a/b.html", f"{head}a.html?x", f"{head}a.html#x", f"{head}a'\\.html",
            f"{head}a.html/", "http://m.zhipin.com//job_detail/a.html", f"{head}a<b>.html", "https://www.zhipin.com/zhaopin/a.html", "https://wwwxzhipin.com/job_detail/a.html", "", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    canonical = U.canonical_url(F.col("u"))
    got = df.select(U.detail_url(F.col("u")).alias("got"), F.when(U.url_kind(canonical) == "job_detail", canonical).alias("want")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got] and got[0]["got"] == urls[0] and got[3]["got"] == urls[0]
    patterns = lambda c: df.select(c)._jdf.queryExecution().analyzed().toString().count("regexp_extract(")
    assert 2 * patterns(U.detail_url(F.col("u"))) < patterns(F.when(U.url_kind(canonical) == "job_detail", canonical))
