import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import normalize, score
from lodestrata.operators.validate import ContractError
from lodestrata.schema import INDEXED, fields
from lodestrata.sources import captures, envelopes, plan, sinks
from lodestrata.streaming import history

URL = "https://www.zhipin.com/job_detail/{}.html"


def test_plan_signature_and_resume(spark):
    config = {"city": "上海", "terms": ["增长", "交易"], "modes": [{"id": "exact", "template": "site:x  {city} {district} {term}"}, {"id": "listing", "template": "{term}"}], "district_shards": ["浦东"]}
    rows = plan.query_plan(spark, config, shards=True).collect()
    assert len(rows) == 8 and rows[0]["query"] == "site:x 上海 增长" and rows[1]["district"] == "浦东" and rows[0]["district"] == "全市"
    assert plan.query_plan(spark, config, modes=["exact"], limit=1).count() == 1
    assert plan.signature("p", 1, 2, [{"a": 1}]) == plan.signature("p", 1, 2, [{"a": 1}]) != plan.signature("p", 2, 2, [{"a": 1}])
    work = spark.createDataFrame([("m", "q", 1), ("m", "q", 2)], "mode string, query string, page int")
    assert [r["page"] for r in plan.remaining(work, work.where("page = 1")).collect()] == [2]
    with pytest.raises(ValueError, match="interval"):
        plan.check_arguments(pages=1, count=1, interval_s=5)


def test_envelopes_end_to_end(spark, tmp_path):
    results = [{"title": "用户产品经理", "url": URL.format("a"), "description": "上海 增长"}, {"title": "运营", "url": URL.format("b"), "description": "上海"}]
    (tmp_path / "one.json").write_text(json.dumps({"request_count": 2, "queries": [{"query": "q", "mode": "exact", "results": results}, {"query": "e", "mode": "exact", "results": []}]}, ensure_ascii=False))
    batches = envelopes.read_envelopes(spark, f"file://{tmp_path}/one.json")
    done = envelopes.explode_results(batches, "p", "2024-01-01")
    assert done.count() == 3 and envelopes.request_totals(spark, f"file://{tmp_path}/one.json").first()["request_count"] == 2
    jobs, _, rejected = normalize.process_batches(done.where(F.col("url").isNotNull()))
    assert jobs.count() == 1 and rejected.count() == 1
    (tmp_path / "bad.json").write_text('{"queries":[{"query":"q","mode":"m"}]}')
    with pytest.raises(Exception, match="lacks results"):
        envelopes.read_envelopes(spark, f"file://{tmp_path}/bad.json").collect()
    assert envelopes.read_json(spark, f"file://{tmp_path}/absent.json", "a int").count() == 0
    (tmp_path / "doc.json").write_text('{"metadata":{},"jobs":[{"id":"x"},{"id":"y"}]}')
    (tmp_path / "bare.json").write_text('[{"id":"z"}]')
    assert [r["id"] for r in envelopes.read_document(spark, f"file://{tmp_path}/doc.json", "id string").orderBy("ord").collect()] == ["x", "y"]
    assert envelopes.read_document(spark, f"file://{tmp_path}/bare.json", "id string").first()["id"] == "z"


def test_agent_logs(spark):
    logs = spark.createDataFrame([("a", 1, '{"item":{"text":"no json"}}'), ("a", 2, '{"item":{"text":"{\\"x\\":1}"}}'), ("b", 1, "say"), ("b", 2, "```json"), ("b", 3, '{"x":2}'), ("b", 4, "```")], "file string, line_no int, value string")
    got = {r["file"]: r["json"] for r in envelopes.parse_agent_output(logs).collect()}
    assert json.loads(got["a"]) == {"x": 1} and json.loads(got["b"]) == {"x": 2}


def test_agent_output_is_json_from_end_to_end(spark):
    logs = spark.createDataFrame([("a", 0, json.dumps({"text": "12 files read"}))], "file string, line_no int, value string")
    assert json.loads(envelopes.parse_agent_output(logs).first()["json"]) == {"text": "12 files read"}


def test_replay_source(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text(json.dumps({"query": "q", "page": 0, "results": [{"url": "u", "title": "t"}]}) + "\n")
    spark.dataSource.register(envelopes.ReplaySource)
    assert spark.read.format("search_replay").option("paths", str(tmp_path / "q.jsonl")).load().first()["url"] == "u"


def test_capture_files(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"run_id": "r", "created_at": "t", "jobs": [{"sequence": 1, "url": "u", "card_screenshot": "c.png"}, {"sequence": 2, "url": "u"}]}))
    (tmp_path / "job_0001_card_context.txt").write_text("card")
    (tmp_path / "job_001_detail_02.txt").write_text("two")
    manifests = captures.read_manifests(spark, f"file://{tmp_path}/m.json")
    assert manifests.count() == 2 and captures.seen_urls(manifests).count() == 1 and captures.runnable(manifests).count() == 1
    assert captures.read_texts(spark, f"file://{tmp_path}/*.txt", "card_context").first()["sequence"] == 1
    assert captures.read_texts(spark, f"file://{tmp_path}/*.txt", "detail").first()["text"] == "two"
    assert captures.read_manifests(spark, f"file://{tmp_path}/none*.json").count() == 0
    row = spark.createDataFrame([("data:image/png;base64,aGk=", "a/b c", ["1", "2", "3"])], "d string, r string, u array<string>")
    got = row.select(captures.decode_image(F.col("d")), captures.safe_run_id(F.col("r")), captures.last_urls(F.col("u"), 2), captures.screenshot_name(F.lit(3), F.lit("detail"), F.lit(1))).first()
    assert bytes(got[0]) == b"hi" and tuple(got)[1:] == ("a-b-c", ["2", "3"], "job_0003_detail_01.png")


def test_an_invalid_batch_leaves_the_old_output(spark, tmp_path):
    target = f"file://{tmp_path}/out"
    spark.range(3).write.parquet(target)
    raw = spark.createDataFrame([(URL.format("a"), "用户产品经理", "上海")], "job_url string, job_title string, city string")
    good = score.score(normalize.to_contract(raw)[0])
    with pytest.raises(ContractError):
        sinks.write_valid(good.withColumn("city", F.lit("北京")), target)
    assert spark.read.parquet(target).count() == 3
    sinks.write_valid(good, target)
    assert spark.read.parquet(target).first()["id"] == "a" and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_a_crash_between_the_renames_is_mended(spark, tmp_path):
    target = f"file://{tmp_path}/out"
    spark.range(3).write.parquet(f"{target}.old")  # the first rename was done, the second was not
    sinks.recover(spark, target)
    assert spark.read.parquet(target).count() == 3
    sinks.replace_output(spark.range(5), target)
    assert spark.read.parquet(target).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_run_status(spark, tmp_path):
    log = f"file://{tmp_path}/status"
    sinks.log_status(spark, log, "r", "processing")
    with pytest.raises(ValueError):
        sinks.log_status(spark, log, "r", "skipped")
    sinks.log_status(spark, log, "r", "failed", "why")
    assert sinks.statuses(spark, log).first()["status"] == "failed"
    sinks.log_status(spark, log, "other/run 1%", "processing")
    assert {r["run_id"]: r["status"] for r in sinks.statuses(spark, log).collect()} == {"r": "failed", "other/run 1%": "processing"}


def test_of_two_writers_one_moves_a_run(spark, tmp_path):
    log, outcome = f"file://{tmp_path}/status", []

    def move(_):
        try:
            sinks.log_status(spark, log, "r", "processing")
            outcome.append("moved")
        except ValueError:
            outcome.append("refused")

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(move, range(4)))
    assert sorted(outcome) == ["moved"] + ["refused"] * 3 and sinks.current_status(spark, log, "r") == "processing"


def test_stream_equals_batch_and_replays_change_nothing(spark, tmp_path):
    schema = fields(INDEXED + ", ord long")
    make = lambda rows: spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)
    landing, root, check = (f"file://{tmp_path}/{x}" for x in ("landing", "root", "check"))
    one = make([{"job_id": "a", "company_name": "甲", "seen_count": 1, "last_seen_at": "1", "ord": 0}])
    two = make([{"job_id": "a", "company_name": "unknown", "seen_count": 1, "last_seen_at": "2", "ord": 0}, {"job_id": "b", "seen_count": 1, "last_seen_at": "2", "ord": 1}])
    one.coalesce(1).write.mode("append").parquet(landing)
    history.history_stream(spark, landing, root, check).awaitTermination()
    two.coalesce(1).write.mode("append").parquet(landing)
    history.history_stream(spark, landing, root, check).awaitTermination()
    got = {r["job_id"]: (r["company_name"], r["seen_count"], r["last_seen_at"]) for r in history.snapshot(spark, root).collect()}
    assert got == {"a": ("甲", 2, "2"), "b": (None, 1, "2")}
    history.upsert(root)(two, 1)  # the last batch again
    assert {r["job_id"]: r["seen_count"] for r in history.snapshot(spark, root).collect()} == {"a": 2, "b": 1}
    notes = []
    history.isolated(lambda b, n: 1 / 0, lambda n, why: notes.append((n, why)), f"file://{tmp_path}/dead")(one, 7)
    assert notes[0][0] == 7 and "ZeroDivisionError" in notes[0][1] and spark.read.parquet(f"file://{tmp_path}/dead/batch=7").count() == 1
    for n in range(2, 6):  # old versions go, those that a replay of the last batch reads stay
        history.upsert(root)(make([{"job_id": "a", "seen_count": 1, "last_seen_at": str(n), "ord": 0}]), n)
    versions = history._versions(spark, root)
    assert all(len(v) <= 2 for v in versions.values()) and {r["job_id"]: r["seen_count"] for r in history.snapshot(spark, root).collect()} == {"a": 6, "b": 1}


def test_a_history_grows_by_more_buckets(spark, tmp_path):
    schema = fields(INDEXED + ", ord long")
    make = lambda rows: spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)
    one, two = f"file://{tmp_path}/one", f"file://{tmp_path}/two"
    history.upsert(one, buckets=2)(make([{"job_id": f"k{i}", "seen_count": 1, "ord": i} for i in range(20)]), 0)
    history.upsert(one, buckets=99)(make([{"job_id": "k1", "seen_count": 1, "ord": 0}]), 1)  # two buckets stay two
    assert history.buckets_of(spark, one) == 2 and set(history._versions(spark, one)) <= {0, 1}
    history.rebucket(spark, one, two, 16)
    history.upsert(two)(make([{"job_id": "k2", "seen_count": 1, "ord": 0}]), 1)
    counts = {r["job_id"]: r["seen_count"] for r in history.snapshot(spark, two).collect()}
    assert len(counts) == 20 and counts["k1"] == counts["k2"] == 2 and len(history._versions(spark, two)) > 2


def test_worker_loop():
    size = [0]

    def batch():
        size[0] += 2

    assert history.run_until(batch, lambda: size[0], 5, lambda: None) == (3, "target")
    assert history.run_until(lambda: None, lambda: 0, 5, lambda: None) == (3, "no growth")
