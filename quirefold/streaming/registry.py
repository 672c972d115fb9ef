"""Running jobs: admission, cancellation, and their events as a sink takes them."""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Jobs that run at once at most; fixed value.
MOST_ACTIVE = 4


class TooManyJobs(RuntimeError):
    pass


class JobRegistry:
    """The jobs of one session. Spark work that is done inside `running` carries the job's tag and ends when it is cancelled."""

    def __init__(self, spark: SparkSession, most: int = MOST_ACTIVE):
        self.spark, self.most = spark, most
        self._jobs: dict[str, tuple[str, bool]] = {}
        self._lock = threading.Lock()

    def register(self, kind: str) -> str:
        with self._lock:
            if len(self._jobs) >= self.most:
                raise TooManyJobs(f"{self.most} jobs are running")
            job = uuid.uuid4().hex
            self._jobs[job] = (kind, False)
            return job

    def listed(self) -> list[tuple[str, str]]:
        with self._lock:
            return [(job, kind) for job, (kind, _) in self._jobs.items()]

    def cancel(self, job: str) -> bool:
        """Whether there is such a job; its Spark work ends, and work that it begins later is refused."""
        with self._lock:
            if job not in self._jobs:
                return False
            self._jobs[job] = (self._jobs[job][0], True)
        self.spark.sparkContext.cancelJobsWithTag(f"job-{job}")
        return True

    def cancelled(self, job: str) -> bool:
        with self._lock:
            return self._jobs.get(job, ("", True))[1]

    @contextlib.contextmanager
    def running(self, kind: str) -> Iterator[str]:
        job = self.register(kind)
        context = self.spark.sparkContext
        context.addJobTag(f"job-{job}")
        try:
            yield job
        finally:
            context.removeJobTag(f"job-{job}")
            with self._lock:
                self._jobs.pop(job, None)


def event_frame(name: Column, payload: Column) -> Column:
    """An event as a stream of server-sent events carries it: its name and its JSON on lines of their own."""
    return F.concat(F.lit("event: "), name, F.lit("\ndata: "), F.to_json(payload), F.lit("\n\n"))


def send(stream: DataFrame, handler: Callable[[str, str], None], checkpoint: str):
    """Start a query that hands the (name, data) rows of a stream to a handler on the driver, in order of arrival by batch.

    A batch is fetched row by row; events are few and small.
    """

    def batch(rows: DataFrame, _: int) -> None:
        for row in rows.toLocalIterator():
            handler(row["name"], row["data"])

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
