"""Sessions as keyed state against a fold over all events; state that empties; runs without news."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lumicat.streaming import session_state, sessions

SCHEMA = "key long, id long, ts timestamp, amount long, reset boolean"
GAP = 600
BEGIN = datetime(2024, 1, 1)


def brute(rows):
    out = {}
    for key, _, ts, amount, reset in sorted((r for r in rows if r[0] is not None and r[2] is not None), key=lambda r: (r[0], r[2], r[1])):
        own = out.setdefault(key, [])
        if not own or reset or (ts - own[-1][1]).total_seconds() > GAP:
            own.append([ts, ts, 0, 0])
        own[-1][1] = ts
        own[-1][2] += 1
        own[-1][3] += amount or 0
    return sorted((k, *s) for k, own in out.items() for s in own)


def fold(spark, base, parts):
    for part in parts:
        if part:
            spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(f"{base}/in")
        stream = sessions.event_stream(spark, f"{base}/in", spark.createDataFrame([], SCHEMA).schema, 1000)
        session_state.run(stream, f"{base}/out", f"{base}/state", GAP)
    return session_state.current(spark, f"{base}/out").collect()


def test_replay_in_parts(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.randrange(12), i, BEGIN + timedelta(seconds=i * 20 + rng.randrange(20)), rng.randrange(100), rng.random() < 0.05) for i in range(900)]
    rows += [(None, 1, BEGIN, 1, False), (3, 5000, None, 1, False), (4, 5001, BEGIN + timedelta(seconds=18_100), None, None)]
    cuts = [[r for r in rows if r[2] is None or lo <= (r[2] - BEGIN).total_seconds() < hi] for lo, hi in ((0, 5000), (5000, 12_000), (12_000, 99_999))]
    cuts[1] = [r for r in cuts[1] if r[2] is not None]
    cuts[2] = [r for r in cuts[2] if r[2] is not None]
    got = fold(spark, str(tmp_path), [*cuts, []])  # the last run has no news
    assert sorted((r.key, r.start, r.last, r.n, r.amount) for r in got) == brute(rows)
    end = max(r[2] for r in rows if r[2])
    assert all(r.closed for r in got if (end - r.last).total_seconds() > GAP + 1)


def test_timers_empty_the_state(spark, tmp_path):
    """Sessions of many keys end by timer, so the state is as large as what is open."""
    parts = [[(1000 * p + k, k, BEGIN + timedelta(hours=p, seconds=k), 1, False) for k in range(200)] for p in range(3)]
    got = fold(spark, str(tmp_path), [*parts, [(1, 9, BEGIN + timedelta(hours=9), 1, False)]])
    assert len(got) == 601 and sum(r.closed for r in got) >= 600
    log = spark.read.parquet(f"{tmp_path}/out")
    assert log.count() <= 2 * len(got)  # each batch writes what it changed
    state = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "session").load()
    assert state.count() <= 1


def test_no_events_at_all(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/in")
    assert fold(spark, str(tmp_path), [[]]) == []


def test_latest_rows_without_news(spark, tmp_path):
    schema = "k long, v long"
    base = str(tmp_path)

    def run(rows):
        if rows:
            spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        return sorted(map(tuple, sessions.upsert_latest(stream, f"{base}/out", f"{base}/offsets", ["k"], ["v"], merge_every=2).collect()))

    spark.createDataFrame([], schema).write.parquet(f"{base}/in")
    assert run([]) == []
    want = {}
    for n in range(6):
        rows = [(k, 10 * n + k) for k in range(n, n + 3)] + [(0, -n)]
        for k, v in rows:
            want[k] = max(want.get(k, v), v)
        assert run(rows) == sorted(want.items()) == run([])
    sizes = {r["batch"]: r["count"] for r in spark.read.parquet(f"{base}/out").groupBy("batch").count().collect()}
    assert min(sizes.values()) <= 4 and spark.read.parquet(f"{base}/out").where(F.col("merged") == 1).count() > 0


class Calls:
    """State and timers of one key, with a note of each call."""

    def __init__(self):
        self.value, self.notes = None, []

    def get(self):
        self.notes.append("get")
        return self.value

    def update(self, value):
        self.notes.append("update")
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):  # noqa: N802
        self.notes.append(("timer", at))


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.now


def test_events_of_an_open_session_cost_two_calls_and_its_early_timer_is_set_again():
    made = session_state.Sessions(10)
    made.handle = made.state = calls = Calls()
    event = lambda i, second: (1, i, None, second * 1_000_000, 5, False)
    assert [r.n for r in made.handleInputRows((1,), iter([event(2, 3), event(1, 0)]), Clock(0))] == [2]
    assert calls.notes == ["get", "update", ("timer", 13_001)]
    calls.notes.clear()
    assert [r.n for r in made.handleInputRows((1,), iter([event(3, 9)]), Clock(3000))] == [3]
    assert calls.notes == ["get", "update"]
    assert list(made.handleExpiredTimer((1,), Clock(14_000), None)) == [] and calls.notes[-1] == ("timer", 19_001)
    (closed,) = made.handleExpiredTimer((1,), Clock(19_001), None)
    assert closed.closed and closed.n == 3 and calls.value is None
