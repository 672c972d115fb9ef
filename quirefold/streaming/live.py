"""Streams of job events that keep state: lifecycles, kept ends, settled edits, jobs after a lost connection.

Each has a batch twin in `quirefold.streaming.events` and gives the same rows, also when it is stopped and goes on from
its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quirefold.sources.shared import new_path

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ENDS = ("done", "cancelled", "error")
DEBOUNCE = "400 milliseconds"
RETENTION_SECONDS = 900
LIFECYCLE = "job long, events long, done long, total long, state string"


class Lifecycle(StatefulProcessor):
    """The twin of `events.lifecycles`: of a job's events the last end, the last progress and whether it was asked to stop.

    A map holds one entry of each kind. With `keep_seconds` an ended job is forgotten when the watermark is so far beyond
    its end; its last row says `expired`.
    """

    def __init__(self, keep_seconds: int | None = None) -> None:
        self.keep_ms = None if keep_seconds is None else keep_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", "sort string", "us long, id long, kind string, done long, total long")
        self.seen = handle.getValueState("seen", "events long")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        # Every look at a state asks the JVM, so rows are put together first and each state is read once.
        seen, last = self.seen.get(), {k[0]: v for k, v in self.last.iterator()}
        seen, new = seen[0] if seen else 0, {}
        for r in rows:
            seen += 1
            sort = "end" if r.kind in ENDS else r.kind
            if sort not in last or (r.us, r.id) > (last[sort][0], last[sort][1]):
                last[sort] = new[sort] = (r.us, r.id, r.kind, r.done, r.total)
        for sort, value in new.items():
            self.last.updateValue((sort,), value)
        self.seen.update((seen,))
        end, at = last.get("end"), last.get("progress")
        if end is not None and self.keep_ms is not None:
            if before := self.due.get():
                self.handle.deleteTimer(before[0])
            due = max(end[0] // 1000 + self.keep_ms, timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(due)
            self.due.update((due,))
        state = end[2] if end is not None else "cancelling" if "cancel" in last else "running"
        done, total = (at[3], at[4]) if at is not None else (None, None)
        yield Row(job=key[0], events=seen, done=total if state == "done" and (total or 0) > 0 else done, total=total, state=state)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.last.clear()
        self.due.clear()
        seen = self.seen.get()[0]
        self.seen.clear()
        yield Row(job=key[0], events=seen, done=None, total=None, state="expired")

    def close(self) -> None:
        pass


def lifecycle_states(events: DataFrame, keep_seconds: int | None = None, late: str = "1 minute") -> DataFrame:
    """Updates (job, events, done, total, state) of a stream of (job, id, us, kind, done, total); events: how many a job had."""
    if keep_seconds is not None:
        events = events.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", late)
    mode = "None" if keep_seconds is None else "EventTime"
    return events.groupBy("job").transformWithState(Lifecycle(keep_seconds), LIFECYCLE, "Update", mode)


class KeptEnd(StatefulProcessor):
    """The last end of a job, kept for a time by the clock: a state with a time to live, which Spark drops by itself.

    A row without a kind asks for the end; it gets what is kept, or `lost`.
    """

    def __init__(self, keep_seconds: float = RETENTION_SECONDS) -> None:
        self.keep_ms = int(keep_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.end = handle.getValueState("end", "us long, id long, kind string", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        asked = False
        for r in rows:
            asked = asked or r.kind is None
            if r.kind in ("done", "error"):
                old = self.end.get() if self.end.exists() else None
                if old is None or (r.us, r.id) >= (old[0], old[1]):
                    self.end.update((r.us, r.id, r.kind))
        if asked:
            kept = self.end.get() if self.end.exists() else None
            yield Row(job=key[0], kind="lost" if kept is None else kept[2], last_id=None if kept is None else kept[1])

    def close(self) -> None:
        pass


def recent_ends(events: DataFrame, keep_seconds: float = RETENTION_SECONDS) -> DataFrame:
    """Answers (job, kind, last_id) to the rows of a stream (job, id, us, kind) that have no kind."""
    return events.groupBy("job").transformWithState(KeptEnd(keep_seconds), "job long, kind string, last_id long", "Update", "ProcessingTime")


def settled(edits: DataFrame, gap: str = DEBOUNCE, late: str = "1 second") -> DataFrame:
    """(user_id, event_id) of the last edit before each pause longer than the gap, of a stream (user_id, event_id, ts).

    An edit that comes when the watermark has passed its session is dropped; a session is out when the watermark has
    passed its end.
    """
    rows = edits.withWatermark("ts", late)
    last = F.max_by("event_id", F.struct("ts", "event_id"))
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(last.alias("event_id")).select("user_id", "event_id")


def reconnected(pending: DataFrame, running: DataFrame, ends: DataFrame, keep: str = f"{RETENTION_SECONDS} seconds", late: str = "1 minute") -> DataFrame:
    """(job, us, id, state) for a stream of pending jobs (job, ts): `running` by a table of live jobs (job), else each end
    (job, kind, us, id, ts) that a stream of them has in the time before, else `lost`, once the watermark rules one out.

    A job with several ends has several rows, of which the last by (us, id) counts.
    """
    live = running.select("job", F.lit(True).alias("_live")).distinct()
    known = pending.join(live, "job", "left").withWatermark("ts", late)
    kept = ends.select(F.col("job").alias("_job"), "kind", "us", "id", F.col("ts").alias("_at")).withWatermark("_at", late)
    near = F.expr(f"_job = job and _at <= ts and _at >= ts - interval {keep}")
    joined = known.join(kept, near, "left_outer")
    state = F.when(F.col("_live"), "running").otherwise(F.coalesce("kind", F.lit("lost")))
    return joined.select("job", "us", "id", state.alias("state"))


def in_phases(spark: SparkSession, phases: list[dict[str, DataFrame]], build: Callable[..., DataFrame], mode: str, name: str, once: bool = False) -> DataFrame:
    """Everything that a stream puts out, with `batch`, when its inputs grow by phases and it starts anew in each.

    phases: by name the rows that each input gets. The stream that build makes of the inputs reads all that is there,
    stops, and goes on from its checkpoint in the next phase. A batch that is run again replaces what it wrote. once: a
    phase is one batch, as states that live by the clock need; a stream of them always has another batch to run.
    """
    at = new_path(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    before = spark.conf.get(PROVIDER, None)
    schema = None
    for phase in phases:
        for source, rows in phase.items():
            rows.write.mode("append").parquet(f"{at}/{source}")
        inputs = {source: spark.readStream.schema(rows.schema).parquet(f"{at}/{source}") for source, rows in phase.items()}
        out = build(**inputs)
        if schema is None:
            schema = out.schema
            spark.createDataFrame([], schema).write.parquet(f"{at}/out/batch=-1")
        spark.conf.set(PROVIDER, ROCKSDB)
        try:
            run = out.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{at}/log").trigger(**({"once": True} if once else {"availableNow": True})).start()
        finally:
            spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
        run.awaitTermination()
    return spark.read.option("basePath", f"{at}/out").schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in schema)}, batch int").parquet(f"{at}/out")
