"""Call control as state of a stream, against plain walks of the whole log."""

import datetime as dt
import random

import pytest

from evidentia.config import Settings
from evidentia.streaming import calls as L
from evidentia.streaming import guards as G

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
FAR = START + dt.timedelta(days=60)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def streamed(spark, folder, schema, parts, run):
    """The rows that a query makes of parts that arrive one after the other; it is started anew for each on one checkpoint."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        made = run(spark.readStream.schema(schema).parquet(str(folder / "in")))
        made.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "ck")).trigger(availableNow=True).start().awaitTermination()
    return [r for r in spark.read.schema(made.schema).parquet(str(folder / "out")).collect() if r.provider_id >= 0]


def shuffled(rows, rng):
    """Two parts in which rows are out of order by less than the watermark waits."""
    rows = sorted(rows, key=lambda r: (r[-1].timestamp() + rng.uniform(0, 300)))
    return [rows[: len(rows) // 2], rows[len(rows) // 2 :]]


def drawn(seed, n=240):
    rng, now, rows = random.Random(seed), 0.0, []
    for i in range(n):
        now += rng.choice([0, 1, 5, 20, 40, 200])
        rows.append((i, rng.randint(1, 2), 1, rng.choices(["success", "failed"], [2, 1])[0], 1, at(now)))
    return rows, rng


CALLS = "call_id long, provider_id long, model_id long, status string, tokens long, created_at timestamp"
END = [(0, -1, -1, "success", 0, FAR)]


@pytest.mark.parametrize("forget", [False, True])
def test_breaker_states_equal_a_walk(spark, tmp_path, forget):
    rows, rng = drawn(1)
    settings = Settings(breaker_failures=3, breaker_cooldown=30)
    got = streamed(spark, tmp_path, CALLS, [*shuffled(rows, rng), END], lambda s: G.breaker_states(s, settings, forget))
    want = []
    for provider in (1, 2):
        breaker, last = L.Breaker(threshold=3, cooldown=30), None
        for i, _, _, status, _, time in sorted((r for r in rows if r[1] == provider), key=lambda r: (r[-1], r[0])):
            now = time.timestamp()
            if forget and last is not None and now - last >= 120:
                breaker = L.Breaker(threshold=3, cooldown=30)
            last, allowed = now, breaker.allows(now)
            if allowed:
                breaker.record(status == "success", now)
            want.append((i, allowed, breaker.failures, breaker.opened is not None))
    assert sorted((r.call_id, r.allowed, r.failures, r.open) for r in got) == sorted(want)
    if not forget:
        log = L.breaker_log(spark.createDataFrame(rows, CALLS), settings).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, log))


@pytest.mark.parametrize("limit", [0, 2])
def test_leases_run_out(spark, tmp_path, limit):
    rows, rng = drawn(2, 120)
    spans = [(i, p, m, t, t + dt.timedelta(seconds=rng.choice([2, 25, 500])), rng.random() < 0.8) for i, p, m, _, _, t in rows]
    marks = [(i, p, m, 1, s) for i, p, m, s, _, _ in spans] + [(i, p, m, -1, e) for i, p, m, _, e, told in spans if told]
    parts = [*shuffled(marks, rng), [(0, -1, -1, 1, FAR)]]
    got = streamed(spark, tmp_path, "call_id long, provider_id long, model_id long, step int, at timestamp", parts, lambda s: G.concurrency_stream(s, limit, 30))
    want = []
    for provider in (1, 2):
        held = {}
        for i, _, _, step, time in sorted((m for m in marks if m[1] == provider), key=lambda m: (m[-1], m[3], m[0])):
            held = {c: until for c, until in held.items() if until > time}
            if step < 0:
                held.pop(i, None)
                continue
            admitted = not limit or len(held) < limit
            want.append((i, len(held) + 1, admitted))
            if admitted:
                held[i] = time + dt.timedelta(seconds=30)
    assert sorted((r.call_id, r.running, r.admitted) for r in got) == sorted(want)


def test_health_is_unknown_after_its_lifetime(spark, tmp_path):
    probes = [(1, 1, True, at(0)), (1, 2, False, at(100)), (1, 3, True, at(500)), (2, 4, False, at(50)), (2, 5, True, at(350)), (3, 6, True, at(900))]
    schema = "provider_id long, probe_id long, healthy boolean, created_at timestamp"
    got = streamed(spark, tmp_path, schema, [probes[:3], probes[3:], [(-1, 0, True, FAR)]], lambda s: G.health_changes(s, 300))
    known = sorted((r.provider_id, r.since.replace(tzinfo=dt.UTC)) for r in got)
    assert known == sorted([*((1, at(s)) for s in (0, 100, 400, 500, 800)), *((2, at(s)) for s in (50, 350, 350, 650)), (3, at(900)), (3, at(1200))])
    changes = spark.createDataFrame([tuple(r) for r in got], G.HEALTH)
    plain = spark.createDataFrame([(p, h, t) for p, _, h, t in probes], "provider_id long, healthy boolean, created_at timestamp")
    for now in (0, 99, 100, 399, 400, 401, 499, 650, 1199, 1200):
        assert sorted(map(tuple, G.health_at(changes, at(now)).collect())) == sorted(map(tuple, L.health(plain, at(now), 300).collect()))


def test_calls_that_end_when_they_start_hold_nothing_after(spark, tmp_path):
    """Ends come first at one instant, as in the log's running sum; calls without length were counted for ever."""
    rows = [(1, 1, 1, 1, at(0)), (1, 1, 1, -1, at(0)), (2, 1, 1, 1, at(0)), (2, 1, 1, -1, at(5)), (3, 1, 1, 1, at(3)), (3, 1, 1, -1, at(3)), (4, 1, 1, 1, at(9)), (4, 1, 1, -1, at(12))]
    got = streamed(spark, tmp_path, "call_id long, provider_id long, model_id long, step int, at timestamp", [rows, [(0, -1, -1, 1, FAR)]], lambda s: G.concurrency_stream(s, lease=10**6))
    sums, running = {}, 0
    for call, _, _, step, _ in sorted(rows, key=lambda r: (r[4], r[3], r[0])):
        running += step
        if step > 0:
            sums[call] = running
    assert {r.call_id: r.running for r in got} == sums == {1: 0, 2: 1, 3: 1, 4: 1}


def test_waiting_rows_are_packed():
    """Rows wait as few values of the state, come out in order once the watermark has passed them, and the rest waits on."""
    import pandas as pd

    class Held:
        def __init__(self):
            self.values = []

        def exists(self):
            return bool(self.values)

        def get(self):
            return iter(self.values)

        def appendList(self, more):
            self.values += more

        def clear(self):
            self.values = []

    class Times:
        def __init__(self, now):
            self.now = now

        def getCurrentWatermarkInMs(self):
            return self.now

    seen = []

    class Kept(G.InOrder):
        def step(self, key, rows, now):
            seen.extend(rows)
            return iter(())

    kept = Kept()
    kept.waiting, kept.wake = Held(), lambda at: None
    rng = random.Random(3)
    rows = [(rng.randint(1, 9_000_000), i, rng.randint(0, 1)) for i in range(25_000)]
    list(kept.handleInputRows((1,), iter([pd.DataFrame(rows, columns=["at", "id", "flag"])]), None))
    assert len(kept.waiting.values) == 3
    list(kept.handleExpiredTimer((1,), Times(4_000), None))
    assert seen == sorted((a, f, i) for a, i, f in rows if a <= 4_000_000)
    list(kept.handleExpiredTimer((1,), Times(10_000), None))
    assert seen == sorted((a, f, i) for a, i, f in rows) and not kept.waiting.values


def test_what_waits_is_not_read_to_add_to_it():
    """Adding a piece touches that piece alone; a list state is read for each value that is added."""

    class State:
        def __init__(self):
            self.values, self.cost = {}, 0

        def exists(self, *key):
            return bool(self.values)

        def get(self):
            self.cost += sum(len(v[0]) for v in self.values.values() if isinstance(v[0], bytes))
            return iter(list(self.values.values())) if None not in self.values else self.values[None]

        def appendList(self, more):
            for v in more:
                self.cost += len(v[0]) + sum(len(x[0]) for x in self.values.values())
                self.values[len(self.values)] = v

        def updateValue(self, key, value):
            self.cost += len(value[0])
            self.values[key] = value

        def update(self, value):
            self.values = {None: value}

        def clear(self):
            self.values = {}

    class Handle:
        def __init__(self):
            self.made = []

        def _state(self, *schema):
            self.made.append(State())
            return self.made[-1]

        getListState = getMapState = getValueState = _state

    import pandas as pd

    kept, handle = G.InOrder(), Handle()
    kept.init(handle)
    kept.wake = lambda at: None
    for part in range(40):
        frames = (pd.DataFrame({"at": range(part * 10**4 + k, part * 10**4 + k + 2000), "id": range(2000), "flag": [1] * 2000}) for k in range(0, 10**4, 2000))
        list(kept.handleInputRows((1,), frames, None))
    assert sum(len(v[0]) for v in handle.made[0].values.values()) == 40 * 10**4 * 24
    assert sum(s.cost for s in handle.made) <= 2 * 40 * 10**4 * 24
    assert len(handle.made[0].values) == 40
