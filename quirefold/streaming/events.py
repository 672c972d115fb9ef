"""Job events: batch folds and their Structured Streaming twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.operators.running import running
from quirefold.sources.shared import new_path

FATAL_STREAK = 5


def job_events(events: DataFrame) -> DataFrame:
    """(job, id, us, kind, done) of the driver's events: users are jobs, purchases end them, errors fail them."""
    kind = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error").otherwise("progress")
    return events.select(F.col("user_id").alias("job"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), kind.alias("kind"), F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("done"))


def latest_terminal(events: DataFrame, keep_seconds: int = 900) -> DataFrame:
    """(job, kind, last_id): the last done or error event of each job that isn't older than the last event of all by more."""
    now = events.agg(F.max("us")).first()[0] or 0
    place = F.struct("us", "id")
    ends = events.filter((F.col("kind") != "progress") & (F.col("us") >= now - keep_seconds * 1_000_000))
    return ends.groupBy("job").agg(F.max_by("kind", place).alias("kind"), F.max_by("id", place).alias("last_id"))


def folded(events: DataFrame) -> DataFrame:
    """(job, events, done, state): counters never fall; the last end decides, without one a job runs."""
    end = F.when(F.col("kind") != "progress", F.struct("us", "id"))
    return events.groupBy("job").agg(F.count("*").alias("events"), F.max("done").alias("done"), F.coalesce(F.max_by(F.when(end.isNotNull(), F.col("kind")), end), F.lit("running")).alias("state"))


def active_counts(events: DataFrame) -> DataFrame:
    """(job, id, active): the number of active jobs after each change of a job's activity, summed by ranges of time."""
    own = Window.partitionBy("job").orderBy("us", "id")
    active = F.when(F.col("kind") == "progress", 1).otherwise(0)
    steps = events.select("job", "id", "us", active.alias("a")).withColumn("step", F.col("a") - F.coalesce(F.lag("a").over(own), F.lit(0))).filter("step <> 0")
    return running(steps, [], ["us", "id"], F.col("step"), "active").select("job", "id", "active")


def failure_streaks(events: DataFrame, fatal: int = FATAL_STREAK) -> DataFrame:
    """(job, longest, fatal) of jobs with errors: the longest row of errors that nothing else interrupts."""
    failed = F.col("kind") == "error"
    island = F.row_number().over(Window.partitionBy("job").orderBy("us", "id")) - F.row_number().over(Window.partitionBy("job", failed).orderBy("us", "id"))
    runs = events.withColumn("g", island).filter(failed).groupBy("job", "g").agg(F.count("*").alias("n"))
    return runs.groupBy("job").agg(F.max("n").alias("longest"), (F.max("n") >= fatal).alias("fatal"))


def debounced(events: DataFrame, gap_seconds: float) -> DataFrame:
    """(user_id, event_id) of the last event before each pause of more than the gap."""
    following = F.lead(F.unix_micros(F.col("ts").cast("timestamp"))).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pause = following - F.unix_micros(F.col("ts").cast("timestamp")) > int(gap_seconds * 1_000_000)
    return events.withColumn("_pause", F.coalesce(pause, F.lit(True))).filter("_pause").select("user_id", "event_id")


STATE = T.StructType([T.StructField("events", T.LongType()), T.StructField("done", T.LongType()), T.StructField("us", T.LongType()), T.StructField("id", T.LongType()), T.StructField("state", T.StringType())])
OUT = "job long, events long, done long, state string"


def fold_batch(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The stateful twin of `folded`: one small row of state for each job."""
    events, done, us, last, kind = state.get if state.exists else (0, -1, -1, -1, "running")
    for pdf in batches:
        events += len(pdf)
        done = max([done, *pdf["done"].dropna().astype("int64")])
        ends = pdf[pdf["kind"] != "progress"]
        if len(ends):
            top = ends.sort_values(["us", "id"]).iloc[-1]
            if (top["us"], top["id"]) > (us, last):
                us, last, kind = int(top["us"]), int(top["id"]), top["kind"]
    state.update((int(events), int(done), int(us), int(last), kind))
    yield pd.DataFrame({"job": [key[0]], "events": [events], "done": [done if done >= 0 else None], "state": [kind]})


def job_states(events: DataFrame) -> DataFrame:
    """A streaming or batch-triggered fold of job events (job, id, us, kind, done) in update mode."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    return events.groupBy("job").applyInPandasWithState(fold_batch, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def stream_states(spark: SparkSession, path: str) -> DataFrame:
    """The final states of a stream that reads all files under path and then ends."""
    source = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, a path may be one file or a folder
    return final_states(source)


def final_states(source: DataFrame, at: str | None = None) -> DataFrame:
    """(job, events, done, state) when all that a stream of the driver's events has now is folded.

    Updates go to a table in the shared checkpoint folder, batch by batch; the last of each job counts. `at` names a
    folder of an earlier call, whose stream goes on where it ended.
    """
    spark = source.sparkSession
    at = at or new_path(spark, "job-states")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/out/of={number}")  # a batch that is tried again replaces itself

    run = job_states(job_events(source)).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.schema(f"{OUT}, batch int").parquet(f"{at}/out")
    return rows.groupBy("job").agg(F.max_by(F.struct("events", "done", "state"), "batch").alias("s")).select("job", "s.events", "s.done", "s.state")


def lifecycles(events: DataFrame) -> DataFrame:
    """(job, done, total, state) of events (job, id, us, kind, done, total).

    kinds: progress, cancel (asked for), done, cancelled, error. The last end decides; a job that was asked to stop and
    hasn't ended is cancelling, another one running. A clean end counts as all done.
    """
    place = F.struct("us", "id")
    end = F.col("kind").isin("done", "cancelled", "error")
    of = lambda c, on: F.max_by(c, F.when(on, place))
    folded = events.groupBy("job").agg(of("kind", end).alias("end"), F.max(F.col("kind") == "cancel").alias("asked"), of("done", F.col("kind") == "progress").alias("at"), of("total", F.col("kind") == "progress").alias("total"))
    state = F.coalesce("end", F.when(F.col("asked"), "cancelling").otherwise("running"))
    return folded.select("job", F.when((state == "done") & (F.col("total") > 0), F.col("total")).otherwise(F.col("at")).alias("done"), "total", state.alias("state"))


def reconciled(pending: DataFrame, running: DataFrame, ended: DataFrame) -> DataFrame:
    """(job, state) of jobs that a session waits for: still running, else as the kept result says, else lost."""
    live = running.select("job", F.lit(True).alias("_live")).distinct()
    kept = ended.select("job", F.col("kind").alias("_kind"))
    rows = pending.join(live, "job", "left").join(kept, "job", "left")
    return rows.select("job", F.when(F.col("_live"), "running").otherwise(F.coalesce("_kind", F.lit("lost"))).alias("state"))


def newest_answers(answers: DataFrame, key: str) -> DataFrame:
    """Of the answers to numbered requests (key, token, result) those of each key's last request; others came too late.

    A key whose last request has no answer yet (a null result) has none.
    """
    return answers.groupBy(key).agg(F.max_by(F.struct("token", "result"), "token").alias("a")).select(key, "a.token", "a.result").filter("result is not null")


KEPT = T.StructType([T.StructField("us", T.LongType()), T.StructField("id", T.LongType()), T.StructField("kind", T.StringType())])


def keep_end(seconds: int):
    """The stateful twin of `latest_terminal`: a job's last end, forgotten when the watermark has passed it by `seconds`."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"job": [key[0]], "kind": ["expired"], "last_id": [None]})
            return
        us, last, kind = state.get if state.exists else (-1, -1, "")
        for pdf in batches:
            for r in pdf.itertuples():
                if (r.us, r.id) > (us, last):
                    us, last, kind = int(r.us), int(r.id), r.kind
        state.update((us, last, kind))
        state.setTimeoutTimestamp(max(us // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job": [key[0]], "kind": [kind], "last_id": [last]})

    return step


def kept_ends(events: DataFrame, keep_seconds: int = 900, late: str = "1 minute") -> DataFrame:
    """(job, kind, last_id) in update mode: the last end of each job, then `expired` after its time.

    events: a stream of (job, id, us, kind). State is dropped as the watermark of the ends passes.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    ends = events.filter("kind <> 'progress'").withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", late)
    return ends.groupBy("job").applyInPandasWithState(keep_end(keep_seconds), "job long, kind string, last_id long", KEPT, "update", GroupStateTimeout.EventTimeTimeout)


def admitted(requests: DataFrame, most: int = 4) -> DataFrame:
    """requests (pool, id, start, end) with admitted: whether fewer than `most` of the pool's jobs were active at the start.

    Each decision rests on those before it, so a pool is gone through in order; jobs that end at a start make room.
    """
    import heapq

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        active: list = []
        out = []
        pdf = pdf.sort_values(["start", "id"])
        for start, end in zip(pdf["start"], pdf["end"]):
            while active and active[0] <= start:
                heapq.heappop(active)
            out.append(len(active) < most)
            if out[-1]:
                heapq.heappush(active, end)
        return pdf.assign(admitted=out)[["pool", "id", "admitted"]]

    return requests.select("pool", "id", "start", "end").groupBy("pool").applyInPandas(run, "pool long, id long, admitted boolean")
