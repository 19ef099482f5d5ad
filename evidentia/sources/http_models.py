"""A connector to model servers with the common embeddings and chat-completions interface."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from .tables import sse_events

READ_BYTES = 1024


@dataclass(frozen=True)
class HttpModels:
    """An embedder and chat model behind a URL; instances are plain values and travel to the executors."""

    url: str
    embedding_model: str = ""
    chat_model: str = ""
    key: str = ""
    timeout: float = 60.0

    def _open(self, path: str, body: dict | None = None, timeout: float | None = None):
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        data = None if body is None else json.dumps(body, ensure_ascii=False).encode()
        request = urllib.request.Request(f"{self.url.rstrip('/')}/{path}", data=data, headers=headers)
        return urllib.request.urlopen(request, timeout=timeout or self.timeout)

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        """One call for each text; an answer without a vector is an error."""
        out = []
        for text in texts:
            with self._open("embeddings", {"model": self.embedding_model, "input": text}) as answer:
                rows = json.load(answer).get("data") or [{}]
            vector = rows[0].get("embedding")
            if not isinstance(vector, list) or not vector:
                raise RuntimeError("the server returned no vector")
            out.append([float(x) for x in vector])
        return out

    def complete(self, messages: list[dict[str, str]], temperature: float = 0.2) -> dict:
        """The server's whole answer: choices, usage and whatever else it tells."""
        with self._open("chat/completions", {"model": self.chat_model, "messages": messages, "temperature": temperature, "stream": False}) as answer:
            return json.load(answer)

    def chat(self, messages: list[dict[str, str]], temperature: float = 0.2) -> str:
        choices = self.complete(messages, temperature).get("choices") or [{}]
        return (choices[0].get("message") or {}).get("content") or ""

    def stream(self, messages: list[dict[str, str]], temperature: float = 0.2) -> Iterator[str]:
        """Raw events of a streamed answer; sources.tables reads what they carry."""
        with self._open("chat/completions", {"model": self.chat_model, "messages": messages, "temperature": temperature, "stream": True}) as answer:
            yield from sse_events(iter(lambda: answer.read(READ_BYTES), b""))

    def models(self) -> list[str]:
        """Names of the server's models; none if it does not answer within three seconds."""
        try:
            with self._open("models", timeout=3) as answer:
                return [m["id"] for m in json.load(answer).get("data", []) if "id" in m]
        except (OSError, ValueError):
            return []

    def ping(self) -> bool:
        try:
            with self._open("models", timeout=3) as answer:
                return answer.status < 400
        except OSError:
            return False
