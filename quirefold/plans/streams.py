"""Queries by streams, each against the SQL of its batch twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.plans import jobs  # noqa: F401  registers the twins
from quirefold.plans.registry import ORACLES, query
from quirefold.plans.states import life_events
from quirefold.sources import fixtures as S
from quirefold.streaming import events as E
from quirefold.streaming import live as V
from quirefold.streaming.source import event_log


def _halves(rows: DataFrame, us: Column) -> list[DataFrame]:
    """rows before the middle of their time, and the others."""
    low, high = rows.agg(F.min(us), F.max(us)).first()
    middle = ((low or 0) + (high or 0)) // 2
    return [rows.filter(us <= middle), rows.filter(us > middle)]


@query(ORACLES["job_lifecycles"])
def streaming_lifecycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lifecycles of `job_lifecycles` by a stream with states, stopped halfway and gone on from its checkpoint."""
    phases = [{"events": part} for part in _halves(life_events(spark, sf_dir), F.col("us"))]
    rows = V.in_phases(spark, phases, lambda events: V.lifecycle_states(events), "update", "lifecycles")
    return rows.groupBy("job").agg(F.max_by(F.struct("done", "total", "state"), "events").alias("s")).select("job", "s.done", "s.total", "s.state")


def _later(spark: SparkSession, sf_dir: str, days: int) -> Column:
    """A time so many days after all events: rows of that time move the watermark past the others."""
    return F.lit(S.table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]).cast("timestamp") + F.make_interval(days=F.lit(days))


@query(ORACLES["debounce_sessions"])
def streaming_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edits of `debounce_sessions` by a stream of sessions."""
    edits = S.table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    # A tick of no user, long after the last edit, as any later edit would be one.
    tick = spark.range(1).select(F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("long").alias("event_id"), _later(spark, sf_dir, 30).alias("ts"))
    phases = [{"edits": part} for part in (*_halves(edits, F.unix_micros("ts")), tick)]
    rows = V.in_phases(spark, phases, lambda edits: V.settled(edits, "1 hour", "1 hour"), "append", "debounce")
    return rows.filter("user_id is not null").select("user_id", "event_id")


@query(ORACLES["reconciled_jobs"])
def streaming_reconnect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs of `reconciled_jobs` by a join of the streams of pending jobs and of ends, and the table of running jobs."""
    events = E.job_events(S.table(spark, sf_dir, "events"))
    jobs = events.select("job").distinct()
    ends = events.filter("kind <> 'progress'").select("job", "kind", "us", "id", F.timestamp_micros("us").alias("ts"))
    pending = jobs.filter("job % 3 > 0").select("job", _later(spark, sf_dir, 0).alias("ts"))
    late_pending = spark.range(1).select(F.lit(-1).cast("long").alias("job"), _later(spark, sf_dir, 30).alias("ts"))
    late_end = spark.range(1).select(F.lit(-2).cast("long").alias("job"), F.lit("done").alias("kind"), F.lit(0).cast("long").alias("us"), F.lit(0).cast("long").alias("id"), _later(spark, sf_dir, 30).alias("ts"))
    first, second = _halves(ends, F.col("us"))
    phases = [{"pending": pending, "ends": first}, {"pending": pending.limit(0), "ends": second}, {"pending": late_pending, "ends": late_end}]
    rows = V.in_phases(spark, phases, lambda pending, ends: V.reconnected(pending, jobs.filter("job % 5 = 0"), ends, "86400 seconds", "1 day"), "append", "reconnect")
    last = F.max_by("state", F.struct(F.coalesce("us", F.lit(-1)), F.coalesce("id", F.lit(-1))))
    return rows.filter("job >= 0").groupBy("job").agg(last.alias("state"))


@query(ORACLES["job_state_fold"])
def replayed_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold of `job_state_fold` over the log of events, replayed from its beginning by a source with offsets."""
    return E.final_states(event_log(spark, f"{sf_dir}/events.parquet", "event_id"))
