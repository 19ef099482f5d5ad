import datetime as dt
import json
import random

import pandas as pd
import pytest

from evidentia.config import Settings
from evidentia.sources import tables as T
from evidentia.streaming import calls as L
from evidentia.streaming.ingest import DOCUMENT, current_jobs, ingest_available, ingest_now, retry

CALLS = "call_id long, provider_id long, model_id long, status string, tokens long, created_at timestamp"
START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def log(spark, *rows):
    return spark.createDataFrame([(i, 1, 1, status, 10, at(s)) for i, (s, status) in enumerate(rows)], CALLS)


def test_minutes_count_successes_only(spark):
    rows = L.minute_usage(log(spark, (0, "success"), (30, "failed"), (59, "success"), (60, "success"))).collect()
    assert sorted((r.requests, r.tokens) for r in rows) == [(1, 10), (2, 20)]


def test_limits(spark):
    calls = log(spark, (0, "failed"), (1, "success"), (2, "success"), (61, "success")).selectExpr("*", "10L AS estimate")
    assert [r.admitted for r in L.admitted(calls, rpm=1).orderBy("call_id").collect()] == [True, True, False, True]
    assert [r.admitted for r in L.admitted(calls, tpm=15).orderBy("call_id").collect()] == [True, True, False, True]


def test_breaker_opens_and_recovers(spark):
    calls = log(spark, (0, "failed"), (1, "failed"), (2, "success"), (40, "success"))
    got = L.breaker_log(calls, Settings(breaker_failures=2)).orderBy("call_id").collect()
    assert [(r.allowed, r.open) for r in got] == [(True, False), (True, True), (False, True), (True, False)]


def test_a_part_passes_by_in_batches():
    read = []

    def batches():
        for k in range(3):
            read.append(k)
            yield pd.DataFrame({"provider_id": 1, "model_id": 1, "call_id": [2 * k, 2 * k + 1], "created_at": at(k), "part": ["a", "b" if k == 2 else "a"], "at": k * 1_000_000, "good": False})

    out = L._walker(3, 60)(batches())
    first = next(out)
    assert read == [0] and first.failures.tolist() == [1, 2] and first.open.tolist() == [False, False]
    second, third = out
    assert second.open.tolist() == [True, True] and second.allowed.tolist() == [True, False]
    assert third.allowed.tolist() == [False, True] and third.failures.tolist() == [3, 1]


@pytest.mark.parametrize("seed", range(2))
def test_parts_of_a_history_are_walked_as_a_whole(spark, seed):
    rng = random.Random(seed)
    rows, now = [], 0.0
    for i in range(1500):
        now += rng.choice([0, 1, 5, 20, 60, 600, 4000])
        rows.append((i, rng.randint(1, 2), 1, rng.choices(["success", "failed"], [5, 1 + 4 * (i // 100 % 2)])[0], 1, at(now)))
    calls = spark.createDataFrame(rows, CALLS)
    settings = Settings(breaker_failures=2, breaker_cooldown=30)
    got = {r.call_id: (r.allowed, r.failures, r.open) for r in L.breaker_log(calls, settings).collect()}
    for provider in (1, 2):
        breaker = L.Breaker(threshold=2, cooldown=30)
        for i, _, _, status, _, time in (r for r in rows if r[1] == provider):
            allowed = breaker.allows(time.timestamp())
            if allowed:
                breaker.record(status == "success", time.timestamp())
            assert got[i] == (allowed, breaker.failures, breaker.opened is not None)
    spans = calls.selectExpr("call_id", "provider_id", "model_id", "created_at AS started_at", "created_at + make_dt_interval(0, call_id % 3, 0, 1) AS ended_at")
    running = {r.call_id: r.running for r in L.concurrency(spans).collect()}
    spans = [(r.call_id, r.provider_id, r.started_at, r.ended_at) for r in spans.collect()]
    for i, provider, start, _ in spans:
        assert running[i] == sum(p == provider and (s, j) <= (start, i) and e > start for j, p, s, e in spans)


def test_breaker_stream_equals_the_log(spark, tmp_path):
    calls = log(spark, (0, "failed"), (1, "failed"), (2, "success"), (40, "success"))
    settings = Settings(breaker_failures=2)
    calls.where("call_id < 2").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    calls.where("call_id >= 2").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = L.breaker_stream(stream, settings).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = [tuple(r) for r in L.breaker_log(calls, settings).orderBy("call_id").collect()]
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("call_id").collect()] == want


def test_minute_stream_with_watermark(spark, tmp_path):
    log(spark, (0, "success"), (70, "success"), (300, "success")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CALLS).parquet(str(tmp_path / "in"))
    query = L.minute_usage(stream, "30 seconds").writeStream.format("memory").queryName("minutes").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("minutes").count() == 3


def test_health_expires(spark):
    probes = spark.createDataFrame([(1, True, at(0)), (1, False, at(10)), (2, True, at(-400))], "provider_id long, healthy boolean, created_at timestamp")
    assert [(r.provider_id, r.healthy) for r in L.health(probes, at(60)).collect()] == [(1, False)]


def test_concurrency(spark):
    rows = spark.createDataFrame([(1, 1, 1, at(0), at(10)), (2, 1, 1, at(5), at(6)), (3, 1, 1, at(10), at(11))], "call_id long, provider_id long, model_id long, started_at timestamp, ended_at timestamp")
    assert {r.call_id: r.running for r in L.concurrency(rows).collect()} == {1: 1, 2: 2, 3: 1}


def test_candidates():
    models = ["a@m1", "b@m2", "c@m3"]
    assert L.candidate_order(models, "round_robin", 1) == [("b", "m2"), ("c", "m3"), ("a", "m1")]
    assert L.candidate_order(models, healthy={"a": False}) == [("b", "m2"), ("c", "m3"), ("a", "m1")]
    assert L.candidate_order(models, "single", hint="x") == [("a", "x")]


def test_router_fails_over_and_guards():
    now = [0.0]

    def call(provider, model, request):
        if provider == "a":
            raise RuntimeError("down")
        return f"{provider}:{request}"

    router = L.Router(call, [("a", "m"), ("b", "m")], Settings(breaker_failures=2, requests_per_minute=2), clock=lambda: now[0])
    assert [router.dispatch(i) for i in range(2)] == ["b:0", "b:1"]
    assert router.breakers["a", "m"].opened is not None
    with pytest.raises(L.GuardError):
        router.dispatch(3)
    now[0] = 61
    assert router.dispatch(4) == "b:4"
    assert [x["status"] for x in router.log] == ["failed", "success", "failed", "success", "failed", "success"]


def test_stream_falls_over_after_partial_output():
    def call(provider, model, request):
        yield provider + "1"
        if provider == "a":
            raise RuntimeError("cut")
        yield provider + "2"

    assert list(L.Router(call, [("a", "m"), ("b", "m")]).stream("x")) == ["a1", "b1", "b2"]


def test_streams_hold_their_place():
    def call(provider, model, request):
        yield "1"
        yield "2"

    router = L.Router(call, [("a", "m")], Settings(concurrency=1))
    first = router.stream("x")
    assert next(first) == "1"
    with pytest.raises(L.GuardError):
        next(router.stream("y"))
    first.close()
    assert list(router.stream("z")) == ["1", "2"] and router.running["a", "m"] == 0


def test_breakers_close_by_the_real_clock():
    def call(provider, model, request):
        if request == "bad":
            raise RuntimeError("down")
        return request

    router = L.Router(call, [("a", "m")], Settings(breaker_failures=1, breaker_cooldown=0))
    with pytest.raises(RuntimeError):
        router.dispatch("bad")
    assert router.dispatch("good") == "good" and router.clock() > 1e9


def test_sampling_repeats(spark):
    calls = spark.range(2000).withColumnRenamed("id", "call_id")
    n = L.sampled(calls, 0.25).count()
    assert 400 < n < 600 and n == L.sampled(calls, 0.25).count() and L.sampled(calls, 1.0).count() == 2000


def test_sse(spark):
    event = lambda **x: "data: " + json.dumps(x) + "\n\n"
    body = ": hello\n\n" + event(choices=[{"delta": {"content": "Hel"}}]) + event(choices=[{"delta": {"content": "lo"}, "finish_reason": None}]) + event(choices=[{"delta": {}, "finish_reason": "stop"}], usage={"total_tokens": 7}) + event(choices=[{"delta": {}}]) + "data: [DONE]\n\n"
    chunks = T.sse_chunks(spark.createDataFrame([(1, body)], "request_id long, body string"))
    assert chunks.count() == 3
    assert [tuple(r) for r in T.sse_answers(chunks).collect()] == [(1, "Hello", "stop", 7)]
    two = 'data: {"choices":[{"delta":{"content":"a"}},{"delta":{"content":"X"}}]}\r\n  data:{"choices":[{"delta":{"content":"b"},"finish_reason":""}],"usage":{"prompt_tokens":3}}\ndata: no json\n\n'
    row = T.sse_chunks(spark.createDataFrame([(1, two)], "request_id long, body string")).collect()
    assert [(r.delta, r.finish_reason, r.usage.prompt_tokens, r.total_tokens) for r in row] == [("ab", None, 3, None)]
    raw = body.encode()
    assert len(list(T.sse_events(raw[i : i + 7] for i in range(0, len(raw), 7)))) == 6
    assert list(T.sse_lines([{"a": 1}])) == ['data: {"a": 1}\n\n', "data: [DONE]\n\n"]


def test_cases_and_reports(spark, tmp_path):
    path = tmp_path / "cases.json"
    path.write_text(json.dumps({"name": "n", "cases": [{"id": "1", "question": "q", "answerable": True, "expected_sources": ["7"]}, {"question": "r"}]}))
    rows = T.read_cases(spark, str(path)).orderBy("position").collect()
    assert [(r.dataset, r.question, r.answerable) for r in rows] == [("n", "q", True), ("n", "r", None)]
    assert T.append_logs(spark.range(3), str(tmp_path / "log")) and not T.append_logs(spark.range(3), "nowhere://x/y")
    T.write_report({"ü": 1}, str(tmp_path / "r.json"))
    assert (tmp_path / "r.json").read_text() == '{\n    "ü": 1\n}\n'


def test_ingestion_drains_the_folder(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    docs = [{"doc_id": 1, "kb_id": 1, "title": "t", "text": "word " * 500, "index_version": 1}, {"doc_id": 2, "kb_id": 1, "title": "u", "text": " ", "index_version": 1}]
    (landing / "a.json").write_text("\n".join(map(json.dumps, docs)))
    ingest_available(spark, str(landing), str(tmp_path / "out"), str(tmp_path / "ck"))
    ingest_available(spark, str(landing), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out/chunks")).count() == 3
    assert {r.doc_id: r.status for r in spark.read.parquet(str(tmp_path / "out/status")).collect()} == {1: "ready", 2: "failed"}


def test_requests_are_checked(spark):
    rows = [(1, 1, "t", "s", {"a": "b"}, "text", 1), (1, 1, "t", "s", None, "newer", 2), (2, 1, "t" * 256, None, None, "x", 1), (3, 1, "t", "s" * 2049, None, "x", 1), (4, 1, " ", None, None, "x", 1), (5, 1, "t", None, None, "\n\t", 1)]
    chunks, state = ingest_now(spark.createDataFrame(rows, DOCUMENT))
    assert [(r.doc_id, r.content, r.metadata) for r in chunks.collect()] == [(1, "newer", None)]
    assert {r.doc_id: r.status for r in state.collect()} == {1: "ready", 2: "failed", 3: "failed", 4: "failed", 5: "failed"}
    assert len({r.reason for r in state.collect()}) == 5


def test_stale_jobs_and_retries(spark):
    documents = spark.createDataFrame([(1, 2, "pending"), (2, 1, "ready"), (3, 1, "failed")], "doc_id long, index_version long, status string")
    jobs = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "doc_id long, index_version long")
    assert [tuple(r) for r in current_jobs(jobs, documents).collect()] == [(1, 2)]
    again = retry(documents, documents.select("doc_id")).orderBy("doc_id").collect()
    assert [(r.index_version, r.status) for r in again] == [(2, "pending"), (1, "ready"), (2, "pending")]
