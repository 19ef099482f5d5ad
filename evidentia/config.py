"""Settings that change results, in one place."""

from __future__ import annotations

from dataclasses import dataclass


def clamp(value: float, low: float, high: float):
    """The value, held within [low, high]."""
    return min(max(value, low), high)


@dataclass(frozen=True)
class Settings:
    """Defaults of chunking, retrieval, graph search, resolution, call control and recording."""

    chunk_size: int = 1200
    chunk_overlap: int = 200
    top_k: int = 5
    graph_enabled: bool = False
    community_levels: int = 2
    task_edges: int = 2_000_000
    max_nodes: int = 50
    rerank_enabled: bool = False
    rerank_candidates: int = 20
    semantic_resolution: bool = False
    similarity_threshold: float = 0.92
    similarity_margin: float = 0.05
    temperature: float = 0.2
    requests_per_minute: int = 0
    tokens_per_minute: int = 0
    concurrency: int = 0
    health_ttl: int = 300
    breaker_failures: int = 5
    breaker_cooldown: int = 30
    record_rate: float = 1.0
    ingest_tries: int = 3
    ingest_timeout: int = 600
    build_tries: int = 1
    build_timeout: int = 1200

    @property
    def size(self) -> int:
        return max(200, self.chunk_size)

    @property
    def overlap(self) -> int:
        return min(max(0, self.chunk_overlap), self.size - 1)

    @property
    def stride(self) -> int:
        return self.size - self.overlap

    def limits(self, top_k: int | None = None, max_hops: int = 2, community_top_k: int = 5) -> dict[str, int]:
        """Arguments of a question, clamped to their ranges."""
        k = int(clamp(self.top_k if top_k is None else top_k, 1, 20))
        return {
            "top_k": k,
            "max_hops": int(clamp(max_hops, 1, 2)),
            "community_top_k": int(clamp(community_top_k, 1, 10)),
            "max_nodes": max(5, self.max_nodes),
            "levels": int(clamp(self.community_levels, 1, 5)),
            "candidates": int(clamp(self.rerank_candidates, k, 100)),
        }


DEFAULTS = Settings()
