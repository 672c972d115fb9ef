"""Streams with state: what they forget, what comes too late, and that they go on where they stopped."""

import datetime
import time

from pyspark.sql import functions as F

from quirefold.streaming import live as V

START = datetime.datetime(2024, 1, 1)
EVENT = "job long, id long, us long, kind string, done long, total long"


def us(seconds: float) -> int:
    return int((START - datetime.datetime(1970, 1, 1)).total_seconds() * 1_000_000 + seconds * 1_000_000)


def test_lifecycles_expire(spark):
    """An ended job is forgotten behind the watermark; a running one isn't; a newer end moves the time."""
    first = spark.createDataFrame([(1, 1, us(0), "progress", 3, 9), (1, 2, us(1), "done", None, None), (2, 3, us(1), "cancel", None, None), (3, 4, us(2), "error", None, None)], EVENT)
    second = spark.createDataFrame([(3, 5, us(800), "cancelled", None, None)], EVENT)
    third = spark.createDataFrame([(9, 6, us(1200), "progress", 1, 2)], EVENT)
    rows = V.in_phases(spark, [{"events": x} for x in (first, second, third)], lambda events: V.lifecycle_states(events, keep_seconds=900, late="1 second"), "update", "t").collect()
    states = {}
    for r in sorted(rows, key=lambda r: r.batch):
        states.setdefault(r.job, []).append((r.done, r.total, r.state))
    assert states == {1: [(9, 9, "done"), (None, None, "expired")], 2: [(None, None, "cancelling")], 3: [(None, None, "error"), (None, None, "cancelled")], 9: [(1, 2, "running")]}


def test_ends_live_for_their_time(spark):
    kind = "job long, id long, us long, kind string"
    ends = spark.createDataFrame([(1, 1, us(0), "done"), (1, 2, us(5), "error"), (2, 3, us(1), "done"), (3, 4, us(1), "progress")], kind)
    ask = spark.createDataFrame([(i, 9, us(9), None) for i in (1, 3)], kind)
    rows = V.in_phases(spark, [{"events": ends}, {"events": ask}], lambda events: V.recent_ends(events, 600), "update", "t", once=True).collect()
    assert {(r.job, r.kind, r.last_id) for r in rows} == {(1, "error", 2), (3, "lost", None)}

    def slow(events):
        time.sleep(2)
        return V.recent_ends(events, 1)

    rows = V.in_phases(spark, [{"events": ends}, {"events": ask}], slow, "update", "t", once=True).collect()
    assert {(r.job, r.kind, r.last_id) for r in rows} == {(1, "lost", None), (3, "lost", None)}


def test_edits_settle(spark):
    kind = "user_id long, event_id long, ts timestamp"
    at = lambda ms: START + datetime.timedelta(milliseconds=ms)
    first = spark.createDataFrame([(1, 1, at(0)), (1, 2, at(300)), (1, 3, at(650)), (1, 4, at(1100)), (2, 5, at(10))], kind)
    tick = spark.createDataFrame([(None, None, at(60_000))], kind)
    late = spark.createDataFrame([(2, 6, at(200)), (2, 7, at(60_100))], kind)
    end = spark.createDataFrame([(None, None, at(120_000))], kind)
    rows = V.in_phases(spark, [{"edits": x} for x in (first, tick, late, end)], V.settled, "append", "t").collect()
    # Edit 6 came when its session was out already.
    assert sorted((r.user_id, r.event_id) for r in rows if r.user_id) == [(1, 3), (1, 4), (2, 5), (2, 7)]


def test_reconnection(spark):
    pending = spark.createDataFrame([(i, START + datetime.timedelta(seconds=1000)) for i in (1, 2, 3, 4)], "job long, ts timestamp")
    none = pending.limit(0)
    kind = "job long, kind string, us long, id long, ts timestamp"
    end = lambda job, name, s, i: (job, name, us(s), i, START + datetime.timedelta(seconds=s))
    early = spark.createDataFrame([end(1, "done", 500, 1), end(2, "done", 50, 2), end(3, "error", 600, 3)], kind)
    more = spark.createDataFrame([end(3, "done", 900, 4), end(4, "done", 1001, 5)], kind)
    far = START + datetime.timedelta(days=1)
    last = spark.createDataFrame([(-2, "done", us(86_400), 9, far)], kind)
    running = spark.createDataFrame([(1,)], "job long")
    phases = [{"pending": pending, "ends": early}, {"pending": none, "ends": more}, {"pending": spark.createDataFrame([(-1, far)], "job long, ts timestamp"), "ends": last}]
    rows = V.in_phases(spark, phases, lambda pending, ends: V.reconnected(pending, running, ends), "append", "t")
    got = rows.groupBy("job").agg(F.max_by("state", F.struct("us", "id")).alias("state")).filter("job > 0").collect()
    # The end of job 2 is too old, that of job 4 comes after its question.
    assert {r.job: r.state for r in got} == {1: "running", 2: "lost", 3: "done", 4: "lost"}
