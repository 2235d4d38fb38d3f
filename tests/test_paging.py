"""The paged source: stops, retries, restarts. Requests are counted by the files that the replay leaves."""

import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestrata.sources import envelopes, paging

PLAN = [{"mode": "exact", "query": q} for q in ("five", "four", "none", "même")]
TOTAL = {"five": 5, "four": 4, "none": 0, "même": 1}


def recorded(spark, root, fails=None, count=2):
    """Answers of so many results in all, ``count`` a page, with the failures given by (query, page)."""
    rows = []
    for query, n in TOTAL.items():
        for page in range(n // count + 1):
            results = [{"title": f"t{i}", "url": f"{query}/{i}", "extra_snippets": ["s"] if i else None} for i in range(page * count, min(n, (page + 1) * count))]
            body = {"web": {"results": results}, "query": {"more_results_available": True}}
            rows.append((query, page, (fails or {}).get((query, page), []), json.dumps(body)))
    paging.record(spark.createDataFrame(rows, "query string, page int, fails array<int>, body string"), root)


def options(tmp_path, replay, **more):
    return {"transport": "replay", "replay": f"file://{tmp_path}/{replay}", "log": f"file://{tmp_path}/log", "pages": 10, "count": 2, "backoff_s": 0.001, "concurrency": 2, **more}


def requests(tmp_path):
    return len(os.listdir(tmp_path / "log")) if (tmp_path / "log").exists() else 0


def run(spark, tmp_path, opts, sink="out", step=None):
    stream = paging.search_stream(spark, PLAN, f"file://{tmp_path}/state", **opts).writeStream.option("checkpointLocation", f"file://{tmp_path}/check")
    stream = stream.foreachBatch(step) if step else stream.format("parquet").option("path", f"file://{tmp_path}/{sink}")
    query = stream.start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query


def pages(df):
    return Counter({(r["query"], r["page"]): len(r["results"]) for r in df.collect()})


WANT = {("five", 0): 2, ("five", 1): 2, ("five", 2): 1, ("four", 0): 2, ("four", 1): 2, ("four", 2): 0, ("none", 0): 0, ("même", 0): 1}


def test_stream_stops_on_short_pages(spark, tmp_path):
    recorded(spark, f"file://{tmp_path}/replay")
    run(spark, tmp_path, options(tmp_path, "replay"))
    out = spark.read.parquet(f"file://{tmp_path}/out")
    assert dict(pages(out)) == WANT and out.count() == len(WANT) == requests(tmp_path)
    done = envelopes.explode_results(out.withColumn("batch_idx", F.lit(0)), "p", "2024").where("url is not null")
    assert done.count() == 10 and done.where("query = 'five' and page = 2").first()["url"] == "five/4"
    run(spark, tmp_path, options(tmp_path, "replay"))  # nothing is left to do
    assert requests(tmp_path) == len(WANT)


def test_limit_of_pages_and_batch_read_share_what_was_fetched(spark, tmp_path):
    recorded(spark, f"file://{tmp_path}/replay")
    opts = options(tmp_path, "replay", pages=2)
    got = paging.search_pages(spark, PLAN, f"file://{tmp_path}/state", **opts)
    assert dict(pages(got)) == {k: v for k, v in WANT.items() if k[1] < 2} and requests(tmp_path) == 6
    assert got.count() == 6 and requests(tmp_path) == 6
    other = paging.search_pages(spark, PLAN[:1], f"file://{tmp_path}/state", **opts)  # another plan, another collection
    assert other.count() == 2 and requests(tmp_path) == 8
    assert paging.search_pages(spark, [], f"file://{tmp_path}/state", **opts).count() == 0


def test_retries_and_failures(spark, tmp_path):
    recorded(spark, f"file://{tmp_path}/a", {("five", 0): [-1, 503], ("four", 1): [429]})
    run(spark, tmp_path, options(tmp_path, "a"))
    assert dict(pages(spark.read.parquet(f"file://{tmp_path}/out"))) == WANT and requests(tmp_path) == len(WANT) + 3


@pytest.mark.parametrize("fails, tries", [([404], 1), ([401], 1), ([500] * 3, 3), ([-1] * 3, 3)])
def test_what_is_tried_again(fails, tries, monkeypatch):
    asked, waits = [], []

    def answer(query, page, attempt, opts):
        asked.append(attempt)
        if fails[attempt - 1] < 0:
            raise TimeoutError
        return fails[attempt - 1], "no"

    monkeypatch.setitem(paging.TRANSPORTS, "test", answer)
    with pytest.raises(paging.SourceError):
        paging.fetch("q", 0, {"transport": "test"}, waits.append)
    assert asked == list(range(1, tries + 1)) and waits == [1.5 * i for i in range(1, tries)]


def test_restart_between_pages_fetches_no_page_twice(spark, tmp_path):
    """The stream ends at page 2 by a 404 and once more in its sink; each page is asked for once but for the one that failed."""
    recorded(spark, f"file://{tmp_path}/bad", {("five", 2): [404]})
    with pytest.raises(Exception, match="404"):
        run(spark, tmp_path, options(tmp_path, "bad"))
    before = requests(tmp_path)
    assert before <= len(WANT)
    recorded(spark, f"file://{tmp_path}/good")
    failed = []

    def step(batch, n):
        if not failed:
            failed.append(batch.count())
            raise RuntimeError("the sink fails once")
        batch.write.mode("overwrite").parquet(f"file://{tmp_path}/again/{n}")

    with pytest.raises(Exception, match="sink fails"):
        run(spark, tmp_path, options(tmp_path, "good"), step=step)
    run(spark, tmp_path, options(tmp_path, "good"), step=step)
    log = Counter(tuple(f.split("-")[:2]) for f in os.listdir(tmp_path / "log"))
    assert sorted(log.values()) == [1] * (len(WANT) - 1) + [2] and failed == [2]
    assert paging.search_pages(spark, PLAN, f"file://{tmp_path}/state", **options(tmp_path, "good")).count() == len(WANT)
    assert sum(Counter(tuple(f.split("-")[:2]) for f in os.listdir(tmp_path / "log")).values()) == len(WANT) + 1


def test_a_replay_holds_a_few_row_groups(spark, tmp_path, monkeypatch):
    """Every answer is found, asked in any order, and what a worker holds is bounded however much is recorded."""
    rows = spark.range(3000).select(F.concat(F.lit("q"), (F.col("id") % 600).cast("string")).alias("query"), F.floor(F.col("id") / 600).alias("page"), F.array().cast("array<int>").alias("fails"), F.concat("id", F.expr("sha2(string(id), 512) || repeat(sha2(string(id + 1), 512), 3)")).alias("body"))
    monkeypatch.setattr(paging, "GROUP_BYTES", 20_000)
    root = f"file://{tmp_path}/many"
    paging.record(rows, root, 2)
    opts = {"replay": root, "replay_buckets": "2"}
    want = {(r["query"], r["page"]): r["body"] for r in rows.collect()}
    assert all(paging.replay(*key, 1, opts) == (200, body) for key, body in sorted(want.items())[::17])
    assert paging.replay("q1", 9, 1, opts)[0] == paging.replay("zz", 0, 1, opts)[0] == 404
    groups = [g for b in (0, 1) for g in paging._groups(root, b)]
    assert len(groups) > 20 and paging._group.cache_info().currsize <= paging.GROUPS_HELD
    paging._group.cache_clear()
    for q in sorted({q for q, _ in want}, key=lambda q: paging._replay_place(q, opts)):
        paging.replay(q, 1, 1, opts)
    assert paging._group.cache_info().misses < len(groups)  # of a page each group is read once


def test_requests_keep_their_distance():
    clock, waits = [0.0], []
    pause = paging._pacer(1100, lambda: clock[0], waits.append)
    pause()
    clock[0] = 0.5
    pause()
    clock[0] = 9
    pause()
    assert waits == [pytest.approx(0.6)]
