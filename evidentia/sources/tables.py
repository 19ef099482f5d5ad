"""Datasets, reports, generators and token streams."""

from __future__ import annotations

import json
import logging
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import TRIMMED

CASES = (
    "name string, cases array<struct<id:string,question:string,mode:string,expected_mode:string,answerable:boolean,top_k:int,max_hops:int,"
    "community_top_k:int,expected_sources:array<string>,expected_answer_contains:array<string>>>"
)
EVENT = (
    "id string, model string, choices array<struct<delta:struct<content:string>,finish_reason:string>>, "
    "usage struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>"
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a JSON dataset, one row each; malformed files fail."""
    data = spark.read.schema(CASES).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return data.select(F.col("name").alias("dataset"), F.posexplode("cases").alias("position", "c")).select("dataset", "position", "c.*")


def write_report(report: dict, path: str) -> None:
    """One report as readable JSON with a final line feed."""
    Path(path).write_text(json.dumps(report, indent=4, ensure_ascii=False) + "\n")


def append_logs(logs: DataFrame, path: str) -> bool:
    """Append call records; a failure is told and logged, but never reaches the calls that are recorded."""
    try:
        logs.write.mode("append").parquet(path)
    except Exception as error:  # recording is best effort
        logging.getLogger(__name__).warning("call records were not kept: %s", error)
        return False
    return True


def sse_chunks(transcripts: DataFrame, column: str = "body") -> DataFrame:
    """Events of recorded token streams (request_id, body): deltas, finish reasons and usage, in order.

    Events are parted by blank lines; lines other than `data:` are comments. Each data line is a JSON value of its own,
    of which the first choice counts: the deltas of an event's lines are joined, the last finish reason and usage win.
    `[DONE]`, lines that are no JSON, and events that carry nothing are dropped; usage counts also without a total.
    """
    plain = F.regexp_replace(F.col(column), "\r\n?", "\n")
    events = F.split(plain, r"\n\n+")
    return event_chunks(transcripts.select("request_id", F.posexplode(events).alias("seq", "event")))


def event_chunks(rows: DataFrame) -> DataFrame:
    """What whole events (request_id, seq, event) carry, as sse_chunks tells it; for batches and streams alike."""
    lines = F.filter(F.transform(F.split("event", "\n"), lambda x: F.btrim(x, F.lit(TRIMMED))), lambda x: x.startswith("data:"))
    data = F.transform(lines, lambda x: F.btrim(F.substring(x, 6, F.length(x)), F.lit(TRIMMED)))
    parsed = rows.select("request_id", "seq", F.transform(F.filter(data, lambda x: x != "[DONE]"), lambda x: F.from_json(x, EVENT)).alias("e"))
    last = lambda values: F.try_element_at(F.filter(values, lambda v: v.isNotNull()), F.lit(-1))
    first = F.transform("e", lambda e: F.get(e["choices"], F.lit(0)))
    out = parsed.select(
        "request_id", "seq", F.array_join(F.transform(first, lambda c: F.coalesce(c["delta"]["content"], F.lit(""))), "").alias("delta"),
        last(F.transform(first, lambda c: F.nullif(c["finish_reason"], F.lit("")))).alias("finish_reason"), last(F.transform("e", lambda e: e["usage"])).alias("usage"),
    )
    return out.where("delta <> '' OR finish_reason IS NOT NULL OR usage IS NOT NULL").withColumn("total_tokens", F.col("usage.total_tokens"))


def sse_answers(chunks: DataFrame) -> DataFrame:
    """One row for each stream: the text, the last finish reason and the total of the last usage."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    parts = F.array_sort(F.collect_list(F.struct("seq", "delta")))
    return chunks.groupBy("request_id").agg(
        F.array_join(F.transform(parts, lambda p: p["delta"]), "").alias("text"), last("finish_reason").alias("finish_reason"), F.max_by("usage", F.when(F.col("usage").isNotNull(), F.col("seq")))["total_tokens"].alias("total_tokens")
    )


def sse_lines(chunks: Iterable[dict]) -> Iterator[str]:
    """Server-sent events for chunks, with the final mark; an error becomes an event of its own before it."""
    try:
        for one in chunks:
            yield f"data: {json.dumps(one, ensure_ascii=False)}\n\n"
    except Exception as error:  # the client must see the end of the stream whatever happened
        yield f"data: {json.dumps({'error': str(error)}, ensure_ascii=False)}\n\n"
    yield "data: [DONE]\n\n"


def sse_events(pieces: Iterable[bytes]) -> Iterator[str]:
    """Whole events from pieces of a byte stream; what remains at the end is the last event."""
    held = b""
    for piece in pieces:
        held = (held + piece).replace(b"\r\n", b"\n")
        while b"\n\n" in held:
            event, held = held.split(b"\n\n", 1)
            yield event.decode()
    if held.strip():
        yield held.decode()


def synthetic(spark: SparkSession, chunks: int = 20_000, entities: int = 2_000, edges: int = 6_000, dims: int = 768, seed: int = 7) -> dict[str, DataFrame]:
    """Chunks with vectors, entities and relationships of a given size; the same for the same arguments."""
    unit = lambda i, d: F.pmod(F.xxhash64(F.lit(seed), i, d), F.lit(2_000_001)) / 1_000_000 - 1
    number = F.col("id")
    vector: Column = F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda d: unit(number, d))
    name = F.when(number % 2 == 0, F.concat(F.lit("Alpha-"), number)).otherwise(F.concat(F.lit("Beta-"), number))
    target = number % entities + 1 + number % 7
    return {
        "chunks": spark.range(chunks).select(number.alias("chunk_id"), F.concat(F.lit("alpha beta gamma synthetic slice "), number).alias("content"), vector.alias("embedding")),
        "entities": spark.range(entities).select(F.lit(1).cast("bigint").alias("kb_id"), number.alias("entity_id"), name.alias("canonical_name"), F.array().cast("array<string>").alias("aliases")),
        "relationships": spark.range(edges).select(
            F.lit(1).cast("bigint").alias("kb_id"), number.alias("relationship_id"), (number % entities).alias("source"), (target % entities).alias("target"),
            (1 + number % 5).cast("double").alias("weight"), F.lit(0.9).alias("confidence"),
        ),
    }
