"""Call control as state of a stream: concurrency with leases, circuit breakers, and health that expires.

Each key keeps what arrives until the watermark has passed it and then looks at it in order of event time, so the rows
are those of the whole log whatever the order of arrival within the watermark. Timers run by event time; state is small:
what waits, the leases that run, or one value.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import DEFAULTS, Settings
from ..session import ship
from .calls import BREAKER, Breaker

PROVIDER_CLASS = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds after which a lease ends that was never given back.
LEASE = 30
GATE = "provider_id long, model_id long, call_id long, running long, admitted boolean"
HEALTH = "provider_id long, healthy boolean, since timestamp"
MS = 1000
#: Rows that wait as one value of a state: a value for each row costs far more than the row.
PACKED_ROWS = 10_000


def keep_state(spark: SparkSession) -> None:
    """Keyed state needs a store that holds several states of a key."""
    ship(spark)
    if not spark.conf.get(PROVIDER_CLASS, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(PROVIDER_CLASS, ROCKSDB)


class Pieces:
    """A list of packed rows as a state. Each piece is a value of its own, by number: adding to a list state costs as much as
    the list holds."""

    def __init__(self, handle: StatefulProcessorHandle, name: str) -> None:
        self.held, self.number = handle.getMapState(name, "number long", "packed binary"), handle.getValueState(f"{name}_pieces", "number long")

    def exists(self) -> bool:
        return self.held.exists()

    def get(self) -> Iterator[tuple]:
        return self.held.values()

    def appendList(self, more: list[tuple]) -> None:
        first = self.number.get()[0] if self.number.exists() else 0
        for k, value in enumerate(more):
            self.held.updateValue((first + k,), value)
        self.number.update((first + len(more),))

    def clear(self) -> None:
        self.held.clear()
        self.number.clear()


class Rows:
    """A key's rows as an array (at, id, flag); as tuples (at, flag, id) they are made few at a time."""

    def __init__(self, array: np.ndarray) -> None:
        self.array = array

    def __len__(self) -> int:
        return len(self.array)

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        for k in range(0, len(self.array), PACKED_ROWS):
            yield from map(tuple, self.array[k : k + PACKED_ROWS, [0, 2, 1]].tolist())

    def by_id(self) -> Rows:
        """In the order of `at` and id."""
        return Rows(self.array[np.lexsort((self.array[:, 1], self.array[:, 0]))])

    def at_once(self) -> set[tuple[int, int]]:
        """(at, id) of what ends at the instant at which it starts."""
        rows = self.array[np.lexsort((self.array[:, 2], self.array[:, 1], self.array[:, 0]))]
        same = (rows[1:, :2] == rows[:-1, :2]).all(axis=1) & (rows[1:, 2] != rows[:-1, 2])
        return set(map(tuple, rows[1:][same][:, :2].tolist()))


class InOrder(StatefulProcessor):
    """Hands a key's rows (at, id, flag) to `step` in the order of `at`, flag and id, once the watermark has passed them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = Pieces(handle, "waiting")
        self.open()

    def open(self) -> None:
        """Make further states."""

    def step(self, key: tuple, rows: Rows, now: int) -> Iterator[pd.DataFrame]:
        """Rows whose time has come, in order (none where only a timer of the key's own has run out); `now` is the watermark."""
        raise NotImplementedError

    def wake(self, at: int) -> None:
        """Call `step` once the watermark has passed a time (microseconds)."""
        self.handle.registerTimer(-(-at // MS))

    def _wait(self, parts: list[np.ndarray]) -> None:
        rows = np.concatenate(parts)
        self.waiting.appendList([(rows[k : k + PACKED_ROWS].tobytes(),) for k in range(0, len(rows), PACKED_ROWS)])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last, parts = 0, []
        for frame in rows:
            if len(frame):
                parts.append(np.ascontiguousarray(frame[["at", "id", "flag"]].to_numpy(dtype=np.int64)))
                last = max(last, int(frame["at"].max()))
                if sum(map(len, parts)) >= PACKED_ROWS:
                    self._wait(parts)
                    parts = []
        if parts:
            self._wait(parts)
        if last:
            self.wake(last)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * MS
        parts = [np.frombuffer(x[0], dtype=np.int64).reshape(-1, 3) for x in self.waiting.get()] if self.waiting.exists() else []
        held = np.concatenate([np.zeros((0, 3), dtype=np.int64), *parts])
        ready, rest = held[held[:, 0] <= now], held[held[:, 0] > now]
        if len(ready):
            self.waiting.clear()
            if len(rest):
                self._wait([rest])
        ready = ready[np.lexsort((ready[:, 1], ready[:, 2], ready[:, 0]))]
        yield from self.step(key, Rows(ready), now)

    def close(self) -> None:
        """Nothing is held outside the state."""


class Gate(InOrder):
    """Calls that run when each one starts. A mark is a start (flag 1) or an end (flag 0); a lease without an end runs out.

    At one instant ends come before starts, also that of a call that ends when it starts: it is given back before it is
    taken, and holds nothing after.
    """

    def __init__(self, limit: int, lease: float) -> None:
        self.limit, self.lease = limit, int(lease * 1_000_000)

    def open(self) -> None:
        self.leases = self.handle.getMapState("leases", "call_id long", "until long")

    def step(self, key, rows, now):
        held = {k[0]: v[0] for k, v in self.leases.iterator()} if self.leases.exists() else {}
        before, out, early = dict(held), [], set()
        ending = deque(sorted((until, call) for call, until in held.items()))  # leases last alike, so they run out in order
        starts = rows.at_once()
        for at, flag, call in rows:
            while ending and ending[0][0] <= at:
                until, other = ending.popleft()
                if held.get(other) == until:
                    del held[other]
            if flag == 0:
                if held.pop(call, None) is None and (at, call) in starts:
                    early.add((at, call))
                continue
            admitted, over = self.limit <= 0 or len(held) < self.limit, (at, call) in early
            early.discard((at, call))
            if admitted and not over:
                held[call] = at + self.lease
                ending.append((at + self.lease, call))
            out.append((*key, call, len(held) + (not admitted) - len(early), admitted))
            if len(out) == PACKED_ROWS:
                yield self.told(out)
                out = []
        held = {c: until for c, until in held.items() if until > now}
        for call in before.keys() - held.keys():
            self.leases.removeKey((call,))
        fresh = {call: until for call, until in held.items() if before.get(call) != until}
        for call, until in fresh.items():
            self.leases.updateValue((call,), (until,))
        for until in set(fresh.values()):
            self.wake(until)
        if out:
            yield self.told(out)

    @staticmethod
    def told(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[x.split(" ")[0] for x in GATE.split(", ")])


class Fuse(InOrder):
    """The breaker of a provider and model; flag 1 is a success. With `forget`, state is dropped four cool-downs after the
    last call; without it, failures in a row are counted over any silence, as in a log."""

    def __init__(self, threshold: int, cooldown: float, forget: bool) -> None:
        self.threshold, self.cooldown, self.forget = threshold, cooldown, forget

    def open(self) -> None:
        self.state = self.handle.getValueState("breaker", "failures long, opened double, last long")

    def step(self, key, rows, now):
        value = self.state.get() if self.state.exists() else None
        failures, opened, last = value or (0, None, 0)
        breaker = Breaker(int(failures), opened, self.threshold, self.cooldown)
        silence, out = int(4 * self.cooldown * 1_000_000), []
        for at, flag, call in rows.by_id():
            if self.forget and last and at - last >= silence:
                breaker = Breaker(0, None, self.threshold, self.cooldown)
            seconds, last = at / 1_000_000, at
            allowed = breaker.allows(seconds)
            if allowed:
                breaker.record(flag == 1, seconds)
            out.append((call, at, allowed, breaker.failures, breaker.opened is not None))
            if len(out) == PACKED_ROWS:
                yield self.told(key, out)
                out = []
        if len(rows):
            self.state.update((breaker.failures, breaker.opened, last))
            if self.forget:
                self.wake(last + silence)
            if out:
                yield self.told(key, out)
        elif self.forget and value and now - last >= silence:
            self.state.clear()

    @staticmethod
    def told(key, out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["call_id", "created_at", "allowed", "failures", "open"])
        return frame.assign(provider_id=key[0], model_id=key[1], created_at=pd.to_datetime(frame["created_at"], unit="us", utc=True))[[x.split(" ")[0] for x in BREAKER.split(", ")]]


class Pulse(InOrder):
    """What is known of a provider: each probe, and an unknown state once one has had no successor for its lifetime."""

    def __init__(self, ttl: float) -> None:
        self.ttl = int(ttl * 1_000_000)

    def open(self) -> None:
        self.last = self.handle.getValueState("last", "at long")

    def step(self, key, rows, now):
        last = self.last.get()[0] if self.last.exists() else None
        rows = rows.by_id().array
        at = rows[:, 0]
        known = np.concatenate([[] if last is None else [last], at]).astype(np.int64)
        ended = np.flatnonzero(np.diff(known) >= self.ttl) if len(known) else np.zeros(0, dtype=np.int64)
        since, own = np.concatenate([known[ended] + self.ttl, at]), np.concatenate([np.zeros(len(ended), dtype=bool), np.ones(len(at), dtype=bool)])
        # A probe's place is its number among the times that are known; what ends one stands between it and the next.
        place = np.concatenate([ended * 2 + 1, (np.arange(len(at)) + len(known) - len(at)) * 2])
        order, flag = np.argsort(place, kind="stable"), np.concatenate([np.zeros(len(ended), dtype=bool), rows[:, 2] == 1])
        since, own, flag = since[order], own[order], flag[order]
        if len(known) and now >= known[-1] + self.ttl:
            since, own, flag = np.append(since, known[-1] + self.ttl), np.append(own, False), np.append(flag, False)
            self.last.clear()
        elif len(rows):
            self.last.update((int(at[-1]),))
            self.wake(int(at[-1]) + self.ttl)
        for k in range(0, len(since), PACKED_ROWS):
            some = slice(k, k + PACKED_ROWS)
            healthy = pd.array(flag[some], dtype="boolean")
            healthy[~own[some]] = pd.NA
            yield pd.DataFrame({"provider_id": key[0], "healthy": healthy, "since": pd.to_datetime(since[some], unit="us", utc=True)})


def _run(rows: DataFrame, keys: list[str], processor: InOrder, schema: str, late: str, at: str) -> DataFrame:
    keep_state(rows.sparkSession)
    marked = rows.withWatermark(at, late).select(*keys, F.unix_micros(F.col(at)).alias("at"), F.col("id").cast("long").alias("id"), F.col("flag").cast("long").alias("flag"), F.col(at))
    return marked.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def concurrency_stream(marks: DataFrame, limit: int = 0, lease: float = LEASE, late: str = "10 minutes") -> DataFrame:
    """For each start among `marks` (call_id, provider_id, model_id, at, step: 1 or -1) the calls that run then, itself
    included, and whether a limit (0: none) admits it; a call that is not admitted is not counted after."""
    rows = marks.select("provider_id", "model_id", "at", F.col("call_id").alias("id"), (F.col("step") > 0).alias("flag")).withColumnRenamed("at", "marked_at")
    return _run(rows, ["provider_id", "model_id"], Gate(limit, lease), GATE, late, "marked_at")


def breaker_states(calls: DataFrame, settings: Settings = DEFAULTS, forget: bool = True, late: str = "10 minutes") -> DataFrame:
    """breaker_log over a stream of calls."""
    rows = calls.select("provider_id", "model_id", "created_at", F.col("call_id").alias("id"), F.col("status").eqNullSafe("success").alias("flag"))
    return _run(rows, ["provider_id", "model_id"], Fuse(settings.breaker_failures, settings.breaker_cooldown, forget), BREAKER, late, "created_at")


def health_changes(probes: DataFrame, ttl: float = DEFAULTS.health_ttl, late: str = "10 minutes") -> DataFrame:
    """(provider_id, healthy, since): what is known of each provider from when on, over a stream of probes (provider_id,
    probe_id, healthy, created_at); null is unknown."""
    rows = probes.select("provider_id", "created_at", F.col("probe_id").alias("id"), F.col("healthy").alias("flag"))
    return _run(rows, ["provider_id"], Pulse(ttl), HEALTH, late, "created_at")


def health_at(changes: DataFrame, now: Any) -> DataFrame:
    """(provider_id, healthy) at a time, from health_changes; providers of which nothing is known are left out."""
    seen = changes.where(F.col("since") <= F.lit(now))
    # At one instant an expiry stands before the probe that ends it.
    last = seen.groupBy("provider_id").agg(F.max(F.struct("since", F.col("healthy").isNotNull().alias("known"), "healthy")).alias("last"))
    return last.select("provider_id", "last.healthy").where("healthy IS NOT NULL")
