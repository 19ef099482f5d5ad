"""Model hooks: what an embedder and a chat model must offer, and deterministic ones for tests."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship


class Embedder(Protocol):
    """Vectors of texts, in order; instances travel to the executors."""

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class ChatModel(Protocol):
    """The answer to a list of messages (role, content)."""

    def chat(self, messages: list[dict[str, str]], temperature: float = 0.2) -> str: ...


class HashEmbedder:
    """Unit vectors from hashed words."""

    def __init__(self, dims: int = 16) -> None:
        self.dims = dims

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            vector = [0.0] * self.dims
            for word in re.findall(r"\w+", (text or "").lower()):
                digest = hashlib.sha256(word.encode()).digest()
                vector[digest[0] % self.dims] += 1.0 if digest[1] % 2 else -1.0
            norm = sum(x * x for x in vector) ** 0.5
            out.append([x / norm for x in vector] if norm else vector)
        return out


class ScriptedChat:
    """Answers by a function of the messages."""

    def __init__(self, script: Callable[[list[dict[str, str]]], str]) -> None:
        self.script = script

    def chat(self, messages: list[dict[str, str]], temperature: float = 0.2) -> str:
        return self.script(messages)


def embed_column(spark, embedder: Embedder, text: Column) -> Column:
    """The vectors of a text column, a batch for each call."""
    ship(spark)

    @F.pandas_udf("array<double>")
    def vectors(batch: pd.Series) -> pd.Series:
        return pd.Series(embedder.embed(batch.fillna("").tolist()))

    return vectors(text)


def chat_rows(prompts: DataFrame, model: ChatModel, temperature: float = 0.2) -> DataFrame:
    """(query_id, answer) for prompts (query_id, system, prompt, previous, follow_up); the last two may be null."""
    ship(prompts.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers = []
            for row in frame.itertuples(index=False):
                messages = [{"role": "system", "content": row.system}, {"role": "user", "content": row.prompt}]
                if isinstance(row.follow_up, str):
                    messages += [{"role": "assistant", "content": row.previous}, {"role": "user", "content": row.follow_up}]
                try:
                    answers.append(model.chat(messages, temperature))
                except Exception:  # a failed call leaves no answer; the caller decides what then stands
                    answers.append(None)
            yield pd.DataFrame({"query_id": frame.query_id, "answer": answers})

    return prompts.select("query_id", "system", "prompt", "previous", "follow_up").mapInPandas(run, "query_id long, answer string")


def extract_graph(chunks: DataFrame, model: ChatModel, instructions: str = "Return the entities and relationships of the text as JSON.") -> DataFrame:
    """(chunk_id, answer): the model's JSON for each chunk."""
    asked = chunks.select(F.col("chunk_id").alias("query_id"), F.lit(instructions).alias("system"), F.col("content").alias("prompt"), F.lit(None).cast("string").alias("previous"), F.lit(None).cast("string").alias("follow_up"))
    return chat_rows(asked, model).withColumnRenamed("query_id", "chunk_id")


def summarize_communities(misses: DataFrame, model: ChatModel, embedder: Embedder, names: str = "names", facts: str = "facts") -> DataFrame:
    """Title (255 characters at most), summary and vector of communities (community_id, names, facts); a model that gives
    no title or no summary is an error."""
    ship(misses.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                payload = json.dumps({"entities": list(row.names), "evidence": list(row.facts)}, ensure_ascii=False)
                told = json.loads(model.chat([{"role": "system", "content": "Summarize the community as JSON with title and summary."}, {"role": "user", "content": payload}]))
                title, summary = str(told.get("title") or "").strip(), str(told.get("summary") or "").strip()
                if not title or not summary:
                    raise RuntimeError("the community summary is incomplete")
                rows.append((row.community_id, title[:255], summary))
            made = pd.DataFrame(rows, columns=["community_id", "title", "summary"])
            yield made.assign(embedding=embedder.embed(made.summary.tolist()))

    picked = misses.select("community_id", F.col(names).alias("names"), F.col(facts).alias("facts"))
    return picked.mapInPandas(run, "community_id long, title string, summary string, embedding array<double>")
