"""Rate windows, circuit breakers, health and candidate order, over logs and streams of calls.

Functions that take `calls` accept batch and streaming frames alike: (provider_id, model_id, status, tokens, created_at).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULTS, Settings
from ..session import ship

WINDOW = "60 seconds"


def minute_usage(calls: DataFrame, late: str | None = None) -> DataFrame:
    """Successful requests and their tokens by provider, model and fixed minute; `late` sets a watermark on a stream."""
    rows = calls.withWatermark("created_at", late) if late else calls
    done = rows.where(F.col("status") == "success")
    out = done.groupBy(F.window("created_at", WINDOW).alias("w"), "provider_id", "model_id").agg(F.count("*").alias("requests"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return out.select(F.col("w.start").alias("window_start"), "provider_id", "model_id", "requests", "tokens")


def admitted(calls: DataFrame, rpm: int = 0, tpm: int = 0) -> DataFrame:
    """Calls with the requests and tokens that their minute held before them, and whether the limits admit them.

    0 is no limit. Only successful calls count; a call is admitted while the count is below the limit, and, where an
    estimate (`estimate` > 0) is known, while the estimate still fits.
    """
    minute = F.date_trunc("minute", "created_at")
    earlier = Window.partitionBy("provider_id", "model_id", "minute").orderBy("created_at", "call_id").rowsBetween(Window.unboundedPreceding, -1)
    done = F.col("status") == "success"
    rows = calls.withColumn("minute", minute).withColumns({
        "used_requests": F.coalesce(F.sum(F.when(done, 1).otherwise(0)).over(earlier), F.lit(0)).cast("bigint"),
        "used_tokens": F.coalesce(F.sum(F.when(done, F.col("tokens")).otherwise(0)).over(earlier), F.lit(0)).cast("bigint"),
    })
    under = F.lit(True) if rpm <= 0 else F.col("used_requests") < rpm
    fits = F.lit(True) if tpm <= 0 else (F.col("estimate") <= 0) | (F.col("used_tokens") + F.col("estimate") <= tpm)
    return rows.withColumn("admitted", under & fits).drop("minute")


def concurrency(calls: DataFrame) -> DataFrame:
    """For each call (call_id, provider_id, model_id, started_at, ended_at) the calls that run when it starts, itself
    included: a running sum over starts and ends, ends first.

    Sums run within blocks of time, and those of earlier blocks are added, so no task holds the history of a pair.
    """
    pair = ["provider_id", "model_id"]
    marks = calls.select("call_id", "provider_id", "model_id", F.col("started_at").alias("at"), F.lit(1).alias("step")).unionByName(
        calls.select("call_id", "provider_id", "model_id", F.col("ended_at").alias("at"), F.lit(-1).alias("step")))
    marks = marks.withColumn("block", _block(F.col("at"), BLOCK_SECONDS))
    before = Window.partitionBy(*pair).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = marks.groupBy(*pair, "block").agg(F.sum("step").alias("sum")).select(*pair, "block", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("carried"))
    order = Window.partitionBy(*pair, "block").orderBy("at", "step", "call_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = marks.withColumn("running", F.sum("step").over(order)).where("step = 1").join(sums, [*pair, "block"])
    return placed.select("call_id", *pair, (F.col("running") + F.col("carried")).alias("running"))


#: Time that is looked at together where a history is cut.
BLOCK_SECONDS = 3600


def _block(at: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(at) / (seconds * 1_000_000)).cast("long")


@dataclass
class Breaker:
    """Opens after so many failures in a row, and starts anew after the cool-down or a success."""

    failures: int = 0
    opened: float | None = None
    threshold: int = DEFAULTS.breaker_failures
    cooldown: float = DEFAULTS.breaker_cooldown

    def allows(self, now: float) -> bool:
        if self.opened is None:
            return True
        if now - self.opened < self.cooldown:
            return False
        self.failures, self.opened = 0, None
        return True

    def record(self, success: bool, now: float) -> None:
        if success:
            self.failures, self.opened = 0, None
        else:
            self.failures += 1
            if self.failures >= self.threshold and self.opened is None:
                self.opened = now


BREAKER = "provider_id long, model_id long, call_id long, created_at timestamp, allowed boolean, failures long, open boolean"


def _walk(frame: pd.DataFrame, breaker: Breaker) -> pd.DataFrame:
    rows = []
    for row in frame.sort_values(["created_at", "call_id"]).itertuples(index=False):
        now = row.created_at.timestamp()
        allowed = breaker.allows(now)
        if allowed:
            breaker.record(row.status == "success", now)
        rows.append((row.provider_id, row.model_id, row.call_id, row.created_at, allowed, breaker.failures, breaker.opened is not None))
    return pd.DataFrame(rows, columns=[x.split(" ")[0] for x in BREAKER.split(", ")])


def _walker(threshold: int, cooldown: float):
    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows that come part by part, in order; of a part only its breaker is held."""
        now, breaker = None, Breaker(threshold=threshold, cooldown=cooldown)
        for frame in frames:
            allowed, failures, opened = [], [], []
            for part, at, good in zip(frame["part"].tolist(), frame["at"].tolist(), frame["good"].tolist(), strict=True):
                if part != now:
                    now, breaker = part, Breaker(threshold=threshold, cooldown=cooldown)
                seconds = at / 1_000_000
                through = breaker.allows(seconds)
                if through:
                    breaker.record(good, seconds)
                allowed.append(through)
                failures.append(breaker.failures)
                opened.append(breaker.opened is not None)
            yield frame[["provider_id", "model_id", "call_id", "created_at"]].assign(allowed=allowed, failures=failures, open=opened)

    return walk


def breaker_log(calls: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The breaker of each provider and model along a log: whether each call was let through, and the state after it.

    A log is cut into parts that are walked by themselves: after a success with no failure within a cool-down before it,
    a breaker is closed and has no failures, whatever came before. In each block of time the first such call ends a part.
    Parts are sorted by Spark and pass by in batches, so Python never holds one.
    """
    ship(calls.sparkSession)
    threshold, cooldown = settings.breaker_failures, settings.breaker_cooldown
    pair, seconds = ["provider_id", "model_id"], max(BLOCK_SECONDS, 2 * int(cooldown) + 2)
    rows = calls.select(*pair, "call_id", "created_at", "status").withColumn("block", _block(F.col("created_at"), seconds))
    failed = rows.where(~F.col("status").eqNullSafe("success")).select(*pair, "created_at", "block")
    # A failure is told to the next block too, if it is near.
    late = failed.where(_block(F.col("created_at") + F.make_dt_interval(secs=F.lit(float(cooldown + 1))), seconds) > F.col("block")).withColumn("block", F.col("block") + 1)
    marks = rows.select(*pair, "block", "created_at", "call_id", (~F.col("status").eqNullSafe("success")).cast("int").alias("bad")).unionByName(
        late.withColumns({"call_id": F.lit(None).cast("long"), "bad": F.lit(1)}))
    recent = Window.partitionBy(*pair, "block").orderBy(F.unix_micros("created_at")).rangeBetween(-int((cooldown + 1) * 1_000_000), 0)
    clean = marks.withColumn("near", F.sum("bad").over(recent)).where("call_id IS NOT NULL AND near = 0")
    first = clean.groupBy(*pair, "block").agg(F.min(F.struct("created_at", "call_id")).alias("first"))
    blocks = rows.select(*pair, "block").distinct().join(first, [*pair, "block"], "left")
    before = Window.partitionBy(*pair).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("part", F.count("first").over(before))
    after = F.coalesce(F.struct("created_at", "call_id") > F.col("first"), F.lit(False)).cast("long")
    parted = rows.join(blocks, [*pair, "block"]).select(*pair, "call_id", "created_at", "status", (F.col("part") + after).alias("part"))
    told = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in (*pair, "part")))
    good = F.col("status").eqNullSafe("success")
    parted = parted.select(*pair, "call_id", "created_at", told.alias("part"), F.unix_micros("created_at").alias("at"), good.alias("good"))
    dealt = parted.repartition("part").sortWithinPartitions("part", "at", "call_id")
    return dealt.mapInPandas(_walker(threshold, cooldown), BREAKER)


def breaker_stream(calls: DataFrame, settings: Settings = DEFAULTS, late: str = "10 minutes") -> DataFrame:
    """breaker_log over a stream; the state of a pair is dropped four cool-downs after its last call, by event time
    (a processing-time timeout would keep an availableNow run going for ever)."""
    ship(calls.sparkSession)
    threshold, cooldown = settings.breaker_failures, settings.breaker_cooldown

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        failures, opened = state.get if state.exists else (0, None)
        breaker = Breaker(int(failures), opened, threshold, cooldown)
        rows = list(frames)
        if rows:
            yield _walk(pd.concat(rows), breaker)
        state.update((breaker.failures, breaker.opened))
        if rows:
            last = max(frame.created_at.max().timestamp() for frame in rows)
            state.setTimeoutTimestamp(max(int((last + 4 * cooldown) * 1000), state.getCurrentWatermarkMs() + 1))

    picked = calls.withWatermark("created_at", late).select("provider_id", "model_id", "call_id", "created_at", "status")
    return picked.groupBy("provider_id", "model_id").applyInPandasWithState(run, BREAKER, "failures long, opened double", "append", GroupStateTimeout.EventTimeTimeout)


def health(probes: DataFrame, now: Any, ttl: int = DEFAULTS.health_ttl) -> DataFrame:
    """(provider_id, healthy): the last probe (provider_id, healthy, created_at) of each provider within the TTL."""
    live = probes.where((F.col("created_at") > F.lit(now) - F.expr(f"INTERVAL {int(ttl)} SECONDS")) & (F.col("created_at") <= F.lit(now)))
    return live.groupBy("provider_id").agg(F.max_by("healthy", "created_at").alias("healthy"))


def sampled(calls: DataFrame, rate: float = 1.0, seed: int = 11) -> DataFrame:
    """A share of the calls, by a hash of their id, so that a repeated run keeps the same ones."""
    if rate >= 1:
        return calls
    return calls.where(F.pmod(F.xxhash64(F.lit(seed), "call_id"), F.lit(1_000_000)) < int(max(rate, 0.0) * 1_000_000))


def candidate_order(models: list[str], strategy: str = "failover", counter: int = 0, healthy: dict[str, bool | None] | None = None, hint: str | None = None) -> list[tuple[str, str]]:
    """(provider, model) in the order they are tried: the first alone, in turn, or as listed; a hint replaces the first
    model; providers known to be unhealthy come last, otherwise the order stays."""
    listed = [tuple(m.split("@", 1)) if "@" in m else ("", m) for m in models]
    if hint and listed:
        listed[0] = tuple(hint.split("@", 1)) if "@" in hint else (listed[0][0], hint)
    if strategy == "single":
        listed = listed[:1]
    elif strategy == "round_robin" and listed:
        at = counter % len(listed)
        listed = listed[at:] + listed[:at]
    known = healthy or {}
    return [c for c in listed if known.get(c[0]) is not False] + [c for c in listed if known.get(c[0]) is False]


class GuardError(RuntimeError):
    """A call that limits, a breaker or a missing configuration did not let through."""


@dataclass
class Router:
    """Tries candidates in order, behind limits and breakers, and records every attempt."""

    call: Callable[[str, str, Any], Any]
    candidates: list[tuple[str, str]]
    settings: Settings = DEFAULTS
    clock: Callable[[], float] = time.time
    log: list[dict] = field(default_factory=list)
    breakers: dict = field(default_factory=dict)
    used: dict = field(default_factory=dict)
    running: dict = field(default_factory=dict)

    def _enter(self, key: tuple[str, str], estimate: int) -> tuple:
        s, now = self.settings, self.clock()
        minute = (*key, int(now // 60))
        requests, tokens = self.used.get(minute, (0, 0))
        breaker = self.breakers.setdefault(key, Breaker(threshold=s.breaker_failures, cooldown=s.breaker_cooldown))
        if not breaker.allows(now):
            raise GuardError("the circuit is open")
        if s.requests_per_minute and requests >= s.requests_per_minute:
            raise GuardError("too many requests")
        if s.tokens_per_minute and estimate > 0 and tokens + estimate > s.tokens_per_minute:
            raise GuardError("too many tokens")
        if s.concurrency and self.running.get(key, 0) >= s.concurrency:
            raise GuardError("too many calls at a time")
        return minute, breaker

    def _leave(self, key, minute, breaker, success: bool, tokens: int, error: Exception | None) -> None:
        breaker.record(success, self.clock())
        if success:
            requests, used = self.used.get(minute, (0, 0))
            self.used[minute] = (requests + 1, used + tokens)
        self.log.append({"provider_id": key[0], "model_id": key[1], "status": "success" if success else "failed", "error": str(error)[:2000] if error else None})

    def dispatch(self, request: Any, estimate: int = 0, tokens: Callable[[Any], int] = lambda _: 0) -> Any:
        """The first success; guard errors skip a candidate, and the last one is raised if none was called."""
        last: Exception | None = None
        for key in self.candidates:
            try:
                minute, breaker = self._enter(key, estimate)
            except GuardError as error:
                last = last or error
                continue
            self.running[key] = self.running.get(key, 0) + 1
            try:
                answer = self.call(*key, request)
            except Exception as error:  # any failure of a candidate moves on to the next
                self._leave(key, minute, breaker, False, 0, error)
                last = error
            else:
                self._leave(key, minute, breaker, True, tokens(answer), None)
                return answer
            finally:
                self.running[key] = max(0, self.running[key] - 1)
        raise last or GuardError("no candidate is configured")

    def stream(self, request: Any, estimate: int = 0) -> Iterator[Any]:
        """Pieces of the first candidate that ends well; after a failure the next one starts over, so pieces may repeat."""
        last: Exception | None = None
        for key in self.candidates:
            try:
                minute, breaker = self._enter(key, estimate)
            except GuardError as error:
                last = last or error
                continue
            self.running[key] = self.running.get(key, 0) + 1
            try:  # a reader that stops early gives its place back too
                pieces: Iterable = self.call(*key, request)
                yield from pieces
            except Exception as error:  # as in dispatch
                self._leave(key, minute, breaker, False, 0, error)
                last = error
            else:
                self._leave(key, minute, breaker, True, estimate, None)
                return
            finally:
                self.running[key] = max(0, self.running[key] - 1)
        raise last or GuardError("no candidate is configured")
