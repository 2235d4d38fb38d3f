"""Display texts, strict imports and dataset metadata."""

import json
import time

import pytest
from pyspark.sql import functions as F

from lodestrata.config import INSUFFICIENT
from lodestrata.functions import display
from lodestrata.operators import metrics, ocr, score, validate, workbench
from lodestrata.schema import RECORD, conform
from lodestrata.sources import plan
from lodestrata.streaming import history

URL = "https://www.zhipin.com/job_detail/{}.html"


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "x string").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text, shown",
    [
        (None, ""),
        ("unknown", ""),
        ("岗 位 职 责：负 责 020 业务", "负责 O2O 业务"),
        ("页面 分享 举报 1、负责 Al 产品 2、推动上线", "1、负责 AI 产品 2、推动上线"),
        ("杂项 1、负责产品", "杂项 1、负责产品"),
        ("任职要求：三年经验 立即沟通 其他", "三年经验"),
        ("职位描述 负责增长。张女士 V 在线", "负责增长。"),
        ("一、必备要求：本科", "本科"),
        ("上海 某公司 岗位要求 负责增长 产品", "上海某"),
        ("岗位要求：负责增长", "负责增长"),
        ("一、岗位职责：负责增长", "负责增长"),
    ],
)
def test_display_text(spark, text, shown):
    assert one(spark, text, display.display_text(F.col("x"))) == shown


def test_display_items(spark):
    items = lambda t: one(spark, t, display.display_items(F.col("x")))
    assert items("岗位职责：一、负责用户增长A 二、负责数据分析B 三、短C 四、推动项目落地D 五、第四项不再列出") == ["负责用户增长A", "负责数据分析B", "推动项目落地D"]
    assert items("1、负责用户增长 2、负责用户增长 3.负责数据分析") == ["负责用户增长", "负责数据分析"]
    assert items("没有编号的一段文字") == ["没有编号的一段文字"] and items("unknown") == []


def test_card_summary_falls_back(spark):
    rows = [
        ("a", "1、负责用户增长与转化策略 2、负责数据分析与复盘", "1、本科及以上学历优先考虑者", "x"),
        ("b", "短", "unknown", "岗位职责 1、负责用户增长与转化 任职要求 1、本科及以上学历者"),
        ("c", "unknown", "unknown", "unknown"),
    ]
    df = conform(spark.createDataFrame(rows, "id string, responsibilities string, requirements string, job_description_raw string").withColumn("salary", F.lit("20K")).withColumn("directions", F.array(F.lit("交易"))), RECORD)
    got = {r["id"]: r["s"] for r in df.select("id", display.card_summary().alias("s")).collect()}
    assert got["a"]["responsibilities"] == ["负责用户增长与转化策略", "负责数据分析与复盘"] and got["a"]["fallback"] is None
    assert got["b"]["responsibilities"] == ["负责用户增长与转化"] and got["b"]["requirements"] == ["本科及以上学历者"]
    assert got["c"]["fallback"] == "薪资：20K · 方向：交易 · JD 待补充"


def test_labels(spark):
    flags = F.expr("array(named_struct('reason', 'r', 'evidence', 'e', 'hard_reject', true), named_struct('reason', '', 'evidence', null, 'hard_reject', false))")
    row = spark.range(1).select(display.risk_texts(flags).alias("r"), display.display_value(F.lit("unknown")).alias("v"), display.verification_label(F.lit("needs_review")).alias("l"), display.verification_label(F.lit("other")).alias("o")).first()
    assert row["r"][0] == "r：e" and json.loads(row["r"][1])["hard_reject"] is False and (row["v"], row["l"], row["o"]) == ("未知", "待复核", "other")


def job(**changed):
    base = {
        "id": "a", "url": URL.format("a"), "title": "用户产品经理", "city": "上海", "recommendation": INSUFFICIENT, "pipeline": "public_index", "verification_status": "unverified_index_snapshot",
        "score": None, "evidence_source": [{"type": "public_index"}], "missing_information": [], "review_reasons": [],
    }
    return {k: v for k, v in {**base, **changed}.items() if v != "absent"}


def imported(spark, *jobs, **top):
    return validate.import_payload(spark.createDataFrame([(json.dumps({"jobs": list(jobs), **top}),)], "value string"))


@pytest.mark.parametrize(
    "changed, rule",
    [
        ({"id": 123}, "id: not a text"), ({"title": " "}, "title: not a text"), ({"company": {"name": "x"}}, "company: not a text"), ({"review_reasons": "absent"}, "review_reasons: not a list"),
        ({"tags": ["a", 1]}, "tags: not a list"), ({"score": "90"}, "score: not a number"), ({"evidence_source": ["public_index"]}, "evidence_source"), ({"evidence_source": []}, "evidence_source"),
        ({"evidence_confidence": 1.2}, "evidence_confidence"), ({"score_components": [1]}, "score_components"), ({"risk_flags": {}}, "risk_flags"), ({"city": "北京"}, "city: out of scope"),
        ({"job_status": "closed"}, "closed without evidence"), ({"id": "b"}, "id: not the URL's"), ({"pipeline": "ocr_jd", "verification_status": "captured_jd"}, "captured_jd without text"),
    ],
)
def test_strict_import_names_the_fault(spark, changed, rule):
    with pytest.raises(validate.ContractError, match=rule):
        imported(spark, job(**changed))


def test_strict_import_takes_what_is_right(spark):
    out = workbench.normalize_payload(imported(spark, job(), job(id="b", url=URL.format("b"), tags=["x"], company="甲"), metadata={"version": "1"})).collect()
    assert [(r["id"], r["company"], r["tags"], r["description"], r["review_reasons"]) for r in sorted(out, key=lambda r: r["id"])] == [("a", "unknown", [], INSUFFICIENT, []), ("b", "甲", ["x"], INSUFFICIENT, [])]
    with pytest.raises(validate.ContractError, match="a document"):
        validate.import_payload(spark.createDataFrame([('{"jobs": 1}',)], "value string"))
    with pytest.raises(validate.ContractError, match="a document"):
        validate.import_payload(spark.createDataFrame([(json.dumps({"jobs": [job()]}) + " and more",)], "value string"))
    with pytest.raises(validate.ContractError, match="repeated"):
        imported(spark, job(), job())


def test_strict_import_parses_once(spark):
    """What is returned reads a table, and a field's kind is found once for all rules (F8)."""
    out = imported(spark, job(), job(id="b", url=URL.format("b"), extra={"k": "v"}, seen_count=2, tags=[]))
    assert [(r["id"], r["seen_count"], r["extra"], r["tags"]) for r in out.orderBy("id").collect()] == [("a", None, None, None), ("b", 2, {"k": "v"}, [])]
    assert "from_json" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sum(str(cond).count("schema_of_variant") for _, cond in validate._import_types()) < 20
    for wrong in (1, "text", [job()]):
        with pytest.raises(validate.ContractError, match=r"jobs\[1\]: job: not an object"):
            imported(spark, job(), wrong)
    for jobs in (None, {}, "[]"):
        with pytest.raises(validate.ContractError, match="a document"):
            validate.import_payload(spark.createDataFrame([(json.dumps({"jobs": jobs}),)], "value string"))


def test_metadata_and_documents(spark):
    df = conform(spark.createDataFrame([("a", "needs_review", "不推荐"), ("b", "captured_jd", INSUFFICIENT)], "id string, verification_status string, recommendation string"), RECORD)
    row = metrics.metadata_counts(df, spark.range(3)).first()
    assert row.asDict() == {"job_count": 2, "review_count": 1, "captured_count": 1, "not_recommended_count": 1, "rejected_count": 3}
    scored, meta = score.score_document(df, {"source": "s", "job_count": "9"})
    assert scored.count() == 2 and meta.first()["job_count"] == 2 and meta.first()["source"] == "s"
    scoped = conform(spark.createDataFrame([("a", "上海", "产品经理", "text", "duty"), ("b", "上海", "产品经理", "text", "unknown"), ("c", "北京", "产品经理", "t", "d")], "id string, city string, title string, job_description_raw string, responsibilities string"), RECORD)
    assert [r["id"] for r in ocr.in_scope(scoped).orderBy("id").collect()] == ["a", "b"] and [r["id"] for r in ocr.in_scope(scoped, only_complete=True).collect()] == ["a"]


def test_resumable_and_timeouts(spark):
    sign = plan.signature("p", 1, 1, [])
    assert plan.resumable({"signature": sign}, sign) and not plan.resumable({"signature": sign, "completed_at": "t"}, sign) and not plan.resumable(None, sign)
    notes = []
    with pytest.raises(Exception):
        history.with_timeout(lambda: time.sleep(2), 0.1, notes.append)()
    history.with_timeout(lambda: spark.range(3).count(), 60, notes.append)()
    assert len(notes) == 1 and notes[0].startswith("TimeoutError")
