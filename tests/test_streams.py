"""Token streams as a source and event logs as a sink: restarts, replays, killed and repeated batches."""

import json
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from evidentia.sources import streams as S
from evidentia.sources.tables import event_chunks, sse_answers, sse_chunks

CHUNK = "request_id string, seq long, delta string, finish_reason string, total_tokens long"


@pytest.fixture(scope="module", autouse=True)
def formats(spark):
    S.register(spark)


def body(i, words, line="\n", end=True):
    event = lambda **x: f"data: {json.dumps(x, ensure_ascii=False)}{line}{line}"
    told = "".join(event(choices=[{"delta": {"content": w}}]) for w in words)
    return f": hello{line}{line}" + told + (event(choices=[{"delta": {}, "finish_reason": "stop"}], usage={"total_tokens": i}) + f"data: [DONE]{line}{line}" if end else "")


def drained(spark, folder, out, checkpoint, **options):
    stream = event_chunks(spark.readStream.format("token_stream").options(path=str(folder), **options).load())
    rows = stream.select("request_id", "seq", "delta", "finish_reason", "total_tokens")
    rows.writeStream.format("event_log").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()
    return S.read_log(spark, str(out), CHUNK)


def told(rows):
    return sorted(((r.request_id, r.delta, r.finish_reason, r.total_tokens) for r in rows.collect()), key=str)


@pytest.mark.parametrize("line", ["\n", "\r\n", "\r"])
def test_a_stream_gives_the_rows_of_the_transcripts(spark, tmp_path, line):
    (tmp_path / "in").mkdir()
    texts = {f"r{i}": body(i, ["Ünï ", "x" * i, "\n\n", "end"], line) for i in range(1, 9)}
    for name, text in texts.items():
        (tmp_path / "in" / f"{name}.sse").write_bytes(text.encode())
    want = sse_chunks(spark.createDataFrame(list(texts.items()), "request_id string, body string"))
    for step in (7, 64, 1 << 20):
        got = drained(spark, tmp_path / "in", tmp_path / f"out{step}", tmp_path / f"ck{step}", range_bytes=step)
        assert told(got) == told(want)
    answers = sorted(tuple(r) for r in sse_answers(got.selectExpr("*", "named_struct('total_tokens', total_tokens) AS usage")).collect())
    assert answers == [(f"r{i}", "Ünï " + "x" * i + "\n\nend", "stop", i) for i in range(1, 9)]
    assert told(event_chunks(spark.read.format("token_stream").option("path", str(tmp_path / "in")).load())) == told(want)


def test_restarts_repeat_and_lose_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    whole = {f"r{i}": body(i, [f"w{i}-{k} " for k in range(20)]).encode() for i in range(5)}
    rng, at = random.Random(3), dict.fromkeys(whole, 0)
    while any(at[n] < len(b) for n, b in whole.items()):
        for name, data in whole.items():  # recorders append pieces that end anywhere
            more = rng.randint(0, 400)
            with (tmp_path / "in" / f"{name}.sse").open("ab") as out:
                out.write(data[at[name] : at[name] + more])
            at[name] = min(len(data), at[name] + more)
        got = drained(spark, tmp_path / "in", tmp_path / "out", tmp_path / "ck", range_bytes=150)
    want = sse_chunks(spark.createDataFrame([(n, b.decode()) for n, b in whole.items()], "request_id string, body string"))
    assert told(got) == told(want)
    batches = len(list((tmp_path / "out" / S.MARKS).glob("*.json")))
    assert batches > 2 and told(drained(spark, tmp_path / "in", tmp_path / "out", tmp_path / "ck", range_bytes=150)) == told(want)


def test_what_stands_at_the_end(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sse").write_text('id: q7\ndata: {"choices":[{"delta":{"content":"x"}}]}\n\nid: q8\ndata: {"choices":[{"delta":{"content":"y"}}]}')
    read = lambda **o: sorted((r.request_id, r.delta) for r in event_chunks(spark.read.format("token_stream").options(path=str(tmp_path / "in"), **o).load()).collect())
    assert read() == [("q7", "x")] and read(complete=True) == [("q7", "x"), ("q8", "y")] == read(complete=True, range_bytes=5)
    (tmp_path / "none").mkdir()
    assert spark.read.format("token_stream").option("path", str(tmp_path / "none")).load().count() == 0


def failing(spark, folder, broken):
    """Rows of a file stream, whose task dies at a row while the file `broken` is there."""
    marker = str(broken)

    @F.udf("long")
    def watch(i):
        from pathlib import Path

        if i == 37 and Path(marker).exists():
            raise RuntimeError("killed")
        return i

    return spark.readStream.schema("id long").parquet(str(folder)).coalesce(2).select(watch("id").alias("id"), F.lit("ü\n").alias("text"))


def test_a_killed_batch_leaves_nothing_and_is_repeated_once(spark, tmp_path):
    spark.range(100).repartition(4).write.parquet(str(tmp_path / "in"))
    broken, out = tmp_path / "broken", tmp_path / "out"
    broken.touch()
    start = lambda: failing(spark, tmp_path / "in", broken).writeStream.format("event_log").option("path", str(out)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    with pytest.raises(StreamingQueryException):
        start()
    assert S.read_log(spark, str(out), "id long, text string").count() == 0
    broken.unlink()
    start()
    S.read_log(spark, str(out), "id long, text string").createOrReplaceTempView("logged")
    assert spark.sql("SELECT count(*), count(DISTINCT id), min(text) = 'ü\n' FROM logged").first() == (100, 100, True)
    # The driver dies after the mark and before the checkpoint hears of it: the batch comes again.
    for mark in (tmp_path / "ck" / "commits").glob("*"):
        mark.unlink()
    for mark in (tmp_path / "ck" / "commits").glob(".*"):
        mark.unlink()
    start()
    S.read_log(spark, str(out), "id long, text string").createOrReplaceTempView("logged")
    assert spark.sql("SELECT count(*), count(DISTINCT id) FROM logged").first() == (100, 100)
    named = {x["name"] for m in (out / S.MARKS).glob("*.json") for x in json.loads(m.read_text())["files"]}
    assert named == {p.name for p in (out / S.DATA).iterdir()}


def test_a_batch_without_a_stream_counts_once_by_its_key(spark, tmp_path):
    rows = spark.createDataFrame([("q1", '{"a": 1}'), ("q1", "[DONE]"), ("q2", "two\nlines")], "request_id string, data string").coalesce(1)
    for _ in range(2):
        rows.write.format("event_log").mode("append").options(path=str(tmp_path / "log"), form="sse", key="once").save()
    back = spark.read.format("token_stream").option("path", str(tmp_path / "log")).load().collect()
    assert [(r.request_id, r.event) for r in sorted(back, key=lambda r: r.seq)] == [("q1", 'id: q1\ndata: {"a": 1}'), ("q1", "id: q1\ndata: [DONE]"), ("q2", "id: q2\ndata: two\ndata: lines")]
