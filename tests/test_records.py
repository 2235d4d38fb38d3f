import time
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestrata.config import CONSIDER, INSUFFICIENT, REJECT, SHANGHAI_PM, TOP, validate_profile
from lodestrata.operators import merge, metrics, normalize, ocr, pair_fold, score, validate, workbench
from lodestrata.plans import record_queries
from lodestrata.schema import INDEXED, RECORD, RESULT, conform, fields

URL = "https://www.zhipin.com/job_detail/{}.html"


def record(n="a", **over):
    base = {
        "url": URL.format(n), "title": "用户产品经理", "company": "甲", "city": "上海", "job_description_raw": "负责 C端 用户增长 产品规划 交易 指标 上线 的完整描述文字若干",
        "responsibilities": "负责 用户增长 产品规划 交易 指标 上线 以及其他若干职责描述", "requirements": "本科", "pipeline": "ocr_jd", "verification_status": "captured_jd",
        "capture_status": "captured", "collected_at": "2024-01-02T00:00:00Z", "workExperience": "3-5年", "review_reasons": [], "missing_information": [], "directions": ["用户增长"],
    }
    return base | over


def frame(spark, rows):
    schema = fields(RECORD + ", ord long")
    data = [tuple(r.get(f.name) for f in schema) for r in ({"ord": i} | r for i, r in enumerate(rows))]
    return spark.createDataFrame(data, schema)


def test_profile_is_checked():
    validate_profile(SHANGHAI_PM)
    with pytest.raises(ValueError, match="thresholds"):
        validate_profile(replace(SHANGHAI_PM, preferred_at=50))
    with pytest.raises(ValueError, match="unknown"):
        validate_profile(replace(SHANGHAI_PM, factors={"x": {"unknown": 1}}))


def test_known_share_of_a_mixed_record(spark):
    """All but financing, company, freshness, team and two required dimensions known."""
    row = score.score(frame(spark, [record()])).first()
    known = [c for c in row["score_components"] if c["known"]]
    assert len(row["score_components"]) == 16 and sum(c["weight"] for c in known) == 100 - 3 - 6 - 3 - 4 - 9
    assert row["evaluation"]["responsibility_fit"] == "high" and row["evaluation"]["product_layer_fit"] == "unknown"
    assert row["evidence_confidence"] == round(75 / 84, 3)
    earned = sum(c["points"] for c in known)
    assert row["match_score"] == pytest.approx(100 * earned / 75, abs=0.05) and row["recommendation"] == TOP


def test_ladder_and_flavours(spark):
    rows = [
        record("a", pipeline="public_index", verification_status="unverified_index_snapshot"),
        record("b", city="北京"),
        record("c", verification_status="needs_review"),
        record("d", responsibilities=None),
        record("e", title="用户运营", directions=[], job_description_raw="x" * 30, responsibilities="y" * 30, workExperience=None, requirements=None),
        record("f", risk_flags=[{"reason": "虚假", "hard_reject": True}]),
    ]
    df = frame(spark, rows)
    js = {r["url"][-6]: r for r in score.score(df).collect()}
    assert js["a"]["recommendation"] == INSUFFICIENT and js["a"]["match_score"] is None and js["a"]["score_components"] == []
    assert js["b"]["recommendation"] == REJECT and js["b"]["hard_filter_reasons"] == ["city_fit=mismatch", "work_mode_fit=unknown"][:1]
    assert js["c"]["recommendation"] == INSUFFICIENT and js["c"]["score"] is None
    assert js["d"]["recommendation"] == INSUFFICIENT and "完整JD或职责证据" in js["d"]["missing_information"]
    assert js["f"]["hard_filter_reasons"] == ["hard_reject=虚假"]
    py = {r["url"][-6]: r for r in score.score(df, flavour="py").collect()}
    assert py["e"]["evaluation"]["title_fit"] == "excluded" and py["e"]["recommendation"] == REJECT
    assert js["e"]["evaluation"]["title_fit"] == "unknown"
    assert py["f"]["evaluation"]["risk_fit"] == "severe" and len(py["a"]["positive_evidence"]) == 3


def fold(spark, *rows):
    """Rows folded in order; public ones first."""
    df = frame(spark, rows)
    good, bad = pair_fold.merge_pipelines(df.where("pipeline = 'public_index'"), df.where("pipeline <> 'public_index'"))
    assert bad.count() == 0
    return {r["id"]: r for r in good.collect()}


PUBLIC = {"pipeline": "public_index", "verification_status": "unverified_index_snapshot", "capture_status": "index_snapshot"}


def test_pair_fold_matrix(spark):
    got = fold(
        spark,
        record("up", **PUBLIC, company="公开", salary="10-20K", job_description_raw="摘要", responsibilities=None),
        record("up", company=None, collected_at="2024-01-01T00:00:00Z"),
        record("down"),
        record("down", verification_status="needs_review", capture_status="detail_unchanged", responsibilities=None, collected_at="2024-02-01T00:00:00Z", company="乙"),
        record("conflict"),
        record("conflict", company="乙", collected_at="2024-02-01T00:00:00Z"),
        record("again", review_reasons=["old"], verification_status="needs_review"),
        record("again", review_reasons=["new"], verification_status="needs_review"),
        record("closed"),
        record("closed", collected_at="2024-03-01T00:00:00Z", job_status="closed"),
        record("proven"),
        record("proven", collected_at="2024-03-01T00:00:00Z", job_status="closed", evidence_source=[{"type": "closure", "detail": "已关闭"}, {"type": "ocr_jd"}]),
        record("alone"),
    )
    up = got["up"]
    assert up["verification_status"] == "captured_jd" and up["company"] == "公开" and up["salary"] == "10-20K"
    assert up["first_seen_at"] == "2024-01-01T00:00:00Z" and {e["type"] for e in up["evidence_source"]} == {"public_index", "ocr_jd"}
    assert got["down"]["verification_status"] == "captured_jd" and got["down"]["company"] == "甲"
    assert "lower_evidence_conflict:company" in got["down"]["review_reasons"]
    assert got["conflict"]["verification_status"] == "needs_review" and "field_conflict:company" in got["conflict"]["review_reasons"]
    assert got["again"]["review_reasons"] == ["new"]
    assert got["closed"]["job_status"] != "closed" and got["proven"]["job_status"] == "closed" and got["proven"]["recommendation"] == REJECT
    assert got["alone"]["recommendation"] == TOP and list(got) == sorted(got)


def test_pair_fold_carries_classes_and_missing_information(spark):
    """A class once known stays though a later text says otherwise; what was missing once stays listed."""
    bare = {"directions": [], "description": None, "requirements": None}
    got = fold(
        spark,
        record("stays", **bare, job_description_raw="商家后台 产品", responsibilities="负责", company=None),
        record("stays", **bare, job_description_raw="小程序 产品", responsibilities="负责", collected_at="2024-02-01T00:00:00Z"),
        record("alone", **bare, job_description_raw="小程序 产品", responsibilities="负责", collected_at="2024-02-01T00:00:00Z"),
    )
    first = fold(spark, record("stays", **bare, job_description_raw="商家后台 产品", responsibilities="负责", company=None))["stays"]
    assert got["stays"]["evaluation"]["product_form_fit"] == first["evaluation"]["product_form_fit"] != got["alone"]["evaluation"]["product_form_fit"]
    assert set(first["missing_information"]) <= set(got["stays"]["missing_information"])


def brute_fold(rows):
    """A URL's (title, company, status, first seen, reasons) by the rules of the merge, one row after another."""
    state = None
    for r in sorted(rows, key=lambda r: (r["pipeline"] != "public_index", r["ord"])):
        ocr, whole = r["pipeline"] == "ocr_jd", r["pipeline"] == "ocr_jd" and r["responsibilities"] is not None
        new = {"ocr": ocr, "title": r["title"], "company": r["company"], "sure": whole, "at": r["collected_at"], "first": r["collected_at"], "review": ocr and not whole, "notes": []}
        new["notes"] = ["incomplete_ocr:missing_responsibilities"] if new["review"] else []
        if state is None:
            state = new
            continue
        clash = [c for c in ("title", "company") if state["ocr"] and ocr and state["at"] != new["at"] and state[c] and new[c] and state[c] != new[c]]
        leads, other = (new, state) if whole or (not state["sure"] and ocr) else (state, new)
        notes = new["notes"] if state["ocr"] and ocr and state["at"] == new["at"] else list(dict.fromkeys(state["notes"] + new["notes"]))
        heavy = whole or not state["sure"]
        notes = list(dict.fromkeys(notes + [("field_conflict:" if heavy else "lower_evidence_conflict:") + c for c in clash]))
        sure = (whole or state["sure"]) and not (clash and heavy)
        state = {
            "ocr": state["ocr"] or ocr, "title": leads["title"] or other["title"], "company": leads["company"] or other["company"], "sure": sure, "review": not sure and (state["ocr"] or ocr),
            "at": max(state["at"], new["at"]), "first": min(state["first"], new["first"]), "notes": notes,
        }
    status = "captured_jd" if state["sure"] else "needs_review" if state["review"] else "unverified_index_snapshot"
    return state["title"], state["company"] or "unknown", status, state["first"], ",".join(state["notes"])


def test_pair_fold_query_folds_every_event(spark, tmp_path):
    """Late events and a hot user's count, in one round and in many: against a fold of each user's rows, one after another."""
    kinds, start = ("view", "click", "purchase"), datetime(2024, 1, 1)
    events = [(i, start + timedelta(hours=(i * 37) % 1500), 7 if i % 3 else i % 11, kinds[i % 7 % 3], float(i % 50)) for i in range(0, 9000, 15)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    by_user = {}
    for i, ts, user, kind, value in events:
        row = {"ord": i, "title": kind + SHANGHAI_PM.role, "company": f"公司{i % 3}" if value > 20 else None, "collected_at": str(ts), "responsibilities": value > 5 or None, "pipeline": "public_index" if kind == "view" else "ocr_jd"}
        by_user.setdefault(str(user), []).append(row)
    got = {r["id"]: r for r in record_queries.pair_fold_merge(spark, str(tmp_path)).collect()}
    assert sum(r["n_evidence"] for r in got.values()) == len(events) and set(got) == set(by_user) and len(got) > 5
    for user, rows in by_user.items():
        r = got[user]
        assert (r["title"], r["company"], r["verification_status"], r["first_seen_at"], r["review_reasons"]) == brute_fold(rows), user
    base = record_queries.observations(spark.read.parquet(f"{tmp_path}/events.parquet"))
    sides = base.where("pipeline = 'public_index'").drop("verification_status"), base.where("pipeline = 'ocr_jd'")
    again, _ = pair_fold.merge_pipelines(*sides, chunk=90)  # the hot user takes several rounds
    whole, _ = pair_fold.merge_pipelines(*sides)
    assert [r.asDict(True) for r in again.collect()] == [r.asDict(True) for r in whole.collect()]


def test_pair_fold_carries_only_what_a_side_gives_and_orders_a_table(spark):
    """Fields that no side gives are left out of the fold and are the same as if they were given as nulls; ordering folds nothing again (F4)."""
    start = datetime(2024, 1, 1)
    events = spark.createDataFrame([(i, start + timedelta(hours=(i * 37) % 1500), i % 11, ("view", "click", "purchase")[i % 7 % 3], float(i % 50)) for i in range(300)], "event_id long, ts timestamp, user_id long, event_type string, value double")
    base = record_queries.observations(events)
    sides = base.where("pipeline = 'public_index'").drop("verification_status"), base.where("pipeline = 'ocr_jd'")
    assert {"salary", "tags", "extra"} <= pair_fold.idle(*sides) and not pair_fold.idle(*(conform(s, RECORD) for s in sides))
    few, _ = pair_fold.merge_pipelines(*sides)
    whole, _ = pair_fold.merge_pipelines(*(conform(s, RECORD) for s in sides))
    assert [r.asDict(True) for r in few.collect()] == [r.asDict(True) for r in whole.collect()]
    assert "aggregate(" not in few._jdf.queryExecution().optimizedPlan().toString()


def test_gate_downgrades_with_reasons(spark):
    row = normalize.gate_captures(normalize.to_contract(frame(spark, [record(capture_status="detail_initial", responsibilities="unknown")]), "ocr_jd")[0]).first()
    assert row["verification_status"] == "needs_review"
    assert row["review_reasons"] == ["incomplete_ocr:capture_status=detail_initial", "incomplete_ocr:missing_responsibilities"]


def test_contract_aliases(spark):
    df = spark.createDataFrame([(URL.format("z"), "产品经理", "", "C", "20K"), ("https://x.org", None, None, None, None)], "job_url string, job_title string, title string, company_name string, salary_range string")
    good, bad = normalize.to_contract(df)
    row = good.first()
    assert (row["title"], row["company"], row["salary"], row["id"], row["pipeline"]) == ("unknown", "C", "20K", "z", "public_index")
    assert row["evidence_source"][0]["type"] == "public_index" and bad.count() == 1


def results(spark, rows):
    schema = fields(RESULT + ", batch_idx int, result_idx int, rank int, mode string, query string, provider string, collected_at string")
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


def result(n, i, url=None, **over):
    return {"title": "用户产品经理 20-30K", "url": url or URL.format(n), "description": "上海 电商 3-5年", "batch_idx": i, "result_idx": 0, "rank": 1, "mode": "exact", "query": "q", "provider": "p", "collected_at": "2024-01-01"} | over


def test_batches_keep_first_and_all_evidence(spark):
    df = results(spark, [
        result("a", 0), result("a", 1, query="r"), result("b", 1, title="运营"), result("c", 2, description="北京"), result("d", 3, url="https://x.org/"),
        result("l", 4, url="https://m.zhipin.com/zhaopin/x/?p=1"),
    ])
    jobs, pages, rejected = normalize.process_batches(df)
    job = jobs.first()
    assert jobs.count() == 1 and [e["query"] for e in job["index_evidence_all"]] == ["q", "r"] and job["job_title"] == "用户产品经理" and job["salary_range"] == "20-30K"
    assert pages.first()["job_url"] == "https://www.zhipin.com/zhaopin/x/"
    assert {(r["reason"], r["n"]) for r in metrics.rejections(rejected).collect()} == {("title_not_product_manager", 1), ("city_not_confirmed_shanghai", 1), ("unsupported_url", 1)}
    got = {r["query"]: r for r in metrics.query_metrics(normalize.normalize_results(df), ("mode", "query")).collect()}
    assert got["q"]["raw_results"] == 5 and got["q"]["exact_job_links"] == 1 and got["q"]["discovery_pages"] == 1 and got["q"]["marginal_yield"] == 0.2


def indexed(spark, rows):
    schema = fields(INDEXED + ", ord long")
    return spark.createDataFrame([tuple(({"ord": i} | r).get(f.name) for f in schema) for i, r in enumerate(rows)], schema)


def test_history_never_loses_the_known(spark):
    old = indexed(spark, [{"job_id": "a", "job_url": URL.format("a"), "company_name": "甲", "salary_range": "10K", "seen_count": 2, "first_seen_at": "1", "last_seen_at": "1", "product_direction_tags": ["x"], "field_evidence": {"k": "1", "m": "1"}}])
    new = indexed(spark, [{"job_id": "a", "job_url": URL.format("a"), "company_name": "unknown", "salary_range": "20K", "seen_count": 1, "first_seen_at": "2", "last_seen_at": "2", "product_direction_tags": ["y", "x"], "field_evidence": {"k": "2"}}, {"job_id": "b", "job_url": URL.format("b"), "seen_count": 1, "last_seen_at": "2"}])
    rows = {r["job_id"]: r for r in merge.merge_history(old, new).collect()}
    a = rows["a"]
    assert (a["company_name"], a["salary_range"], a["seen_count"], a["first_seen_at"], a["last_seen_at"]) == ("甲", "20K", 3, "1", "2")
    assert a["product_direction_tags"] == ["x", "y"] and a["field_evidence"] == {"k": "2", "m": "1"} and rows["b"]["seen_count"] == 1


def test_index_merge_notes_conflicts(spark):
    df = indexed(spark, [
        {"job_id": "a", "job_url": URL.format("a"), "company_name": "甲", "seen_count": 1, "first_seen_at": "2"},
        {"job_id": "a", "job_url": "http://m.zhipin.com/job_detail/a.html?x", "company_name": "乙", "education_requirement": "本科", "seen_count": 4, "first_seen_at": "1"},
        {"job_id": "p", "job_url": "https://www.zhipin.com/zhaopin/x/"},
    ])
    row = merge.merge_index(df).collect()
    assert len(row) == 1 and row[0]["company_name"] == "甲" and row[0]["education_requirement"] == "本科" and row[0]["seen_count"] == 5
    assert row[0]["review_reasons"] == ["index_conflict:company_name"] and row[0]["first_seen_at"] == "1"


def test_public_records_pass_the_contract(spark):
    jobs, _, _ = normalize.process_batches(results(spark, [result("a", 0), result("b", 1)]))
    out = score.score(normalize.index_to_records(jobs))
    assert validate.violations(out).count() == 0 and out.first()["recommendation"] == INSUFFICIENT


RULES = [
    ({"id": "other"}, "id: not the URL's"), ({"city": "北京"}, "city: out of scope"), ({"title": "运营"}, "title: out of scope"),
    ({"recommendation": "好"}, "recommendation: not allowed"), ({"match_score": 101.0, "score": None}, "match_score: outside 0-100"),
    ({"score": 1.0}, "score: differs from match_score"), ({"evidence_source": []}, "evidence_source: empty"), ({"evidence_confidence": 2.0}, "evidence_confidence: outside 0-1"),
    ({"scoring_config_version": "unknown"}, "scoring_config_version: missing"), ({"verification_status": "needs_review"}, "needs_review without reasons"),
    ({"evidence_confidence": 0.5}, "top tier with little evidence"), ({"capture_status": "detail_capped"}, "captured_jd without complete capture"),
    ({"responsibilities": "unknown"}, "captured_jd without text or duties"), ({"job_status": "closed"}, "closed without evidence"),
    ({"hard_filter_reasons": ["x"]}, "hard filter without rejection"), ({"pipeline": "public_index"}, "pipeline and verification_status disagree"),
    ({"salary": None}, "salary: not a string"), ({"tags": None}, "tags: not a list"),
]


def test_each_rule(spark):
    good = score.score(normalize.to_contract(frame(spark, [record()]), "ocr_jd")[0]).first().asDict(recursive=True)
    names = [f.name for f in fields(RECORD)]
    make = lambda over: {k: good.get(k) for k in names} | over
    rows = [make({})] + [make({"id": f"r{i}", "url": URL.format(f"r{i}")} | over) for i, (over, _) in enumerate(RULES)]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], fields(RECORD))
    found = validate.violations(df).collect()
    assert not [r for r in found if r["id"] == "a"]
    for i, (_, rule) in enumerate(RULES):
        assert rule in {r["rule"] for r in found if r["url"] == URL.format(f"r{i}")}, rule


def test_uniqueness_and_assertion(spark):
    good = score.score(normalize.to_contract(frame(spark, [record(), record()]), "ocr_jd")[0])
    assert {"id: repeated", "url: repeated"} <= {r["rule"] for r in validate.violations(good).collect()}
    with pytest.raises(validate.ContractError, match="repeated"):
        validate.assert_valid(good)
    assert validate.first_violation(good, validate.CAPTURE_RULES) == "a: id: repeated"


def test_captures(spark):
    manifest = spark.createDataFrame([
        (1, URL.format("a"), "list_detail_captured", "用户产品经理 20-35K 3-5年 本科 某科技 上海 浦东新区", "2024"), (2, URL.format("b"), "detail_unchanged", "数据产品经理 10-20K", "2024"),
        (3, URL.format("A").upper().replace("HTTPS://WWW.ZHIPIN.COM/JOB_DETAIL", "https://www.zhipin.com/job_detail").replace("HTML", "html"), "captured", None, "2024"), (4, "ftp://x", "captured", None, "2024"),
    ], "sequence int, url string, status string, title_hint string, created_at string")
    cards = spark.createDataFrame([(1, "job_0001_card_context.txt", "用户产品经理\n某科技")], "sequence int, name string, text string")
    details = spark.createDataFrame([
        (1, "job_001_detail_01.txt", "用户产品经理\n岗位职责\n负责增长和转化\n推动上线"), (1, "job_001_detail_02.txt", "推动上线\n任职要求\n本科"), (2, "job_002_detail_01.txt", "别的岗位\n没有内容"),
    ], "sequence int, name string, text string")
    records, queue = ocr.structure(ocr.join_captures(manifest, cards, details))
    got, why = {r["sequence"]: r for r in records.collect()}, {r["sequence"]: r["reasons"] for r in queue.collect()}
    assert got[1]["responsibility_summary"] == "负责增长和转化 推动上线" and got[1]["qualification_summary"] == "本科" and got[1]["district"] == "浦东新区"
    assert got[1]["company_name"] == "某科技" and got[1]["verification_status"] == "captured_jd" and got[1]["product_direction_tags"] == ["用户增长", "用户产品"]
    assert why[2] == ["capture_status=detail_unchanged", "detail_missing_jd_heading", "detail_title_mismatch", "missing_responsibility", "company_unknown"]
    assert why[3] == ["duplicate_job_url"] and why[4] == ["invalid_job_url"] and 1 not in why
    scored = ocr.map_scored(score.score(records.withColumns({"title": F.col("job_title"), "url": F.col("job_url"), "responsibilities": F.col("responsibility_summary")}), flavour="py").withColumn("job_url", F.col("url")))
    assert {r["sequence"]: r["recommendation"] for r in scored.collect()}[2] == INSUFFICIENT


def test_recognition_keeps_failures_apart_and_enforces_its_limit(spark):
    """An engine that hangs costs its limit, one that ends its process costs a process; the other images are read."""

    def engine(content):
        import os
        import time

        if content == b"slow":
            time.sleep(600)
        if content == b"dead":
            os._exit(3)
        if content == b"bad":
            raise ValueError("no picture")
        return content.decode().upper()

    rows = [(str(i), x) for i, x in enumerate([b"a", b"slow", b"b", b"bad", b"dead", b"c", None, b"slow", b"d"])]
    images = spark.createDataFrame(rows, "path string, content binary").coalesce(1)
    began = time.monotonic()
    got = {r["path"]: r for r in ocr.recognise(images, engine, timeout=1.5).collect()}
    assert time.monotonic() - began < 60
    assert [got[str(i)]["text"] for i in range(9)] == ["A", None, "B", None, None, "C", None, None, "D"]
    assert "1.5 s" in got["1"]["error"] and "no picture" in got["3"]["error"] and "ended" in got["4"]["error"] and got["6"]["error"] and got["0"]["error"] is None
    done = spark.createDataFrame([("0", "A", None), ("3", None, "x")], "path string, text string, error string")
    assert {r["path"] for r in ocr.recognise_new(images.where("path in ('0', '3', '5')"), done, engine).collect()} == {"3", "5"}


def test_images_that_land_are_recognised_once(spark, tmp_path):
    landing, out, check = (f"file://{tmp_path}/{x}" for x in ("landing", "out", "check"))
    (tmp_path / "landing").mkdir()

    def engine(content):
        return content.decode().upper()

    for name in ("a.png", "b.png"):
        (tmp_path / "landing" / name).write_bytes(name[:1].encode())
    ocr.recognise_stream(spark, landing, out, check, engine, pattern="*.png").awaitTermination()
    (tmp_path / "landing" / "c.png").write_bytes(b"c")
    ocr.recognise_stream(spark, landing, out, check, engine, pattern="*.png").awaitTermination()
    assert sorted(r["text"] for r in spark.read.parquet(out).collect()) == ["A", "B", "C"]


def test_workbench(spark):
    df = score.score(normalize.to_contract(frame(spark, [record("a"), record("b", company="乙", pipeline="public_index"), record("c", directions=["交易"])]), "ocr_jd")[0])
    states = spark.createDataFrame([("a", "已投递"), ("c", "乱写")], "id string, status string")
    assert [r["id"] for r in workbench.select(df, workbench.Filters(), states).collect()][-1] == "b"
    assert [(r["id"], r["user_status"]) for r in workbench.select(df, workbench.Filters(direction="交易"), states).collect()] == [("c", "未看")]
    assert [r["id"] for r in workbench.select(df, workbench.Filters(user_status="已投递"), states).collect()] == ["a"]
    assert [r["id"] for r in workbench.select(df, workbench.Filters(text="乙"), None).collect()] == ["b"]
    assert workbench.select(df, workbench.Filters(min_score=1)).count() == 2 and workbench.top(df, 1).count() == 1
    assert not workbench.stale({"job_count": 2}, {}) and not workbench.stale({"updated_at": "a"}, {"updated_at": "", "job_count": None})
    assert workbench.stale({"updated_at": "a", "job_count": 1}, {"job_count": 1, "updated_at": "b"}) and not workbench.stale({"updated_at": "a", "job_count": 0}, {"job_count": 0})
    assert workbench.stale(None, {}) and not workbench.stale({"imported": True}, {"job_count": 1}) and workbench.stale({"job_count": 2}, {"job_count": 1})
    with pytest.raises(ValueError):
        workbench.set_state(states, "a", "乱写")
    assert CONSIDER in {"可以考虑"}
    assert [r["n"] for r in metrics.recommendation_counts(df).orderBy("place").collect()] == [2, 0, 0, 0, 1]


def test_streaks(spark):
    runs = spark.createDataFrame(list(enumerate([5, 5, 7, 7, 7, 7])), "run int, size long")
    assert [(r["delta"], r["streak"], r["pause"]) for r in metrics.streaks(runs, "run", "size").orderBy("run").collect()] == [(5, 0, False), (0, 1, False), (2, 0, False), (0, 1, False), (0, 2, False), (0, 3, True)]


def test_conform_keeps_extra_columns(spark):
    df = conform(spark.createDataFrame([("x", 1)], "id string, other int"), "id string, name string")
    assert df.columns == ["id", "name", "other"]
