"""Jobs: values with a lifetime, locks, retries, and the states of a build."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REASON_LENGTH = 2000
BUILD = "build_id long, kb_id long, status string, reason string"
#: What a build may become from each state.
NEXT = {"pending": ("building",), "building": ("ready", "failed"), "ready": (), "failed": ("pending",)}


@dataclass
class Cache:
    """Values by key that are forgotten after their lifetime (seconds; None: never)."""

    clock: Callable[[], float] = time.time
    held: dict[str, tuple[Any, float | None]] = field(default_factory=dict)

    def get(self, key: str, default: Any = None) -> Any:
        value, until = self.held.get(key, (default, None))
        if until is not None and self.clock() >= until:
            del self.held[key]
            return default
        return value

    def put(self, key: str, value: Any, lifetime: float | None = None) -> None:
        self.held[key] = (value, None if lifetime is None else self.clock() + lifetime)

    def add(self, key: str, value: Any, lifetime: float | None = None) -> bool:
        """Put a value if the key has none; whether it was put."""
        if self.get(key, self) is not self:
            return False
        self.put(key, value, lifetime)
        return True

    def increment(self, key: str, by: int = 1) -> int:
        """Raise a number, 0 if there is none; its lifetime stays."""
        value = int(self.get(key, 0)) + by
        self.held[key] = (value, self.held.get(key, (0, None))[1])
        return value

    def forget(self, key: str) -> None:
        self.held.pop(key, None)


class Busy(RuntimeError):
    """Another job holds the lock."""


@contextmanager
def lock(cache: Cache, key: str, lifetime: float) -> Iterator[None]:
    """Holds a key while the body runs, so that jobs of one document or knowledge base do not overlap; a lock that was
    never given back ends after its lifetime."""
    mine = object()
    if not cache.add(f"lock:{key}", mine, lifetime):
        raise Busy(f"{key} is being worked on")
    try:
        yield
    finally:
        if cache.get(f"lock:{key}") is mine:
            cache.forget(f"lock:{key}")


def attempt(run: Callable[[], Any], tries: int = 3, timeout: float | None = None, clock: Callable[[], float] = time.time, failed: Callable[[Exception], None] = lambda _: None) -> Any:
    """The result of `run`, tried up to `tries` times within `timeout` seconds; `failed` hears of the last error."""
    begin = clock()
    for n in range(1, max(1, tries) + 1):
        try:
            return run()
        except Busy:
            raise
        except Exception as error:  # any failure of a job is tried again
            if n >= tries or (timeout is not None and clock() - begin >= timeout):
                failed(error)
                raise
    return None


def advance(builds: DataFrame, changes: DataFrame) -> DataFrame:
    """Builds (build_id, kb_id, status, reason) after `changes` (build_id, status, reason); steps that no state allows
    are passed over, reasons are cut, and a build that goes on has none."""
    told = changes.select("build_id", F.col("status").alias("to"), F.substring("reason", 1, REASON_LENGTH).alias("why"))
    allowed = F.lit(False)
    for state, targets in NEXT.items():
        allowed = allowed | ((F.col("status") == state) & F.col("to").isin(*targets))
    moved = builds.join(told, "build_id", "left").withColumn("moved", F.coalesce(allowed, F.lit(False)))
    return moved.select(
        "build_id", "kb_id", F.when(F.col("moved"), F.col("to")).otherwise(F.col("status")).alias("status"),
        F.when(F.col("moved"), F.when(F.col("to") == "failed", F.col("why"))).otherwise(F.col("reason")).alias("reason"),
    )


def run_build(state: Callable[[str, str | None], None], run: Callable[[], Any], cache: Cache, key: str, tries: int = 1, timeout: float = 1200) -> Any:
    """Run a build under its lock: `state` hears `building`, then `ready`, or `failed` with a reason."""
    with lock(cache, key, timeout):
        state("building", None)
        out = attempt(run, tries, timeout, cache.clock, lambda error: state("failed", str(error)[:REASON_LENGTH]))
        state("ready", None)
        return out
