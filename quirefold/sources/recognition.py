"""Recognition services as sources: work items fanned out to an injected client, with retries and typed errors."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds before the attempts; fixed values.
DELAYS = (0.0, 2.0, 5.0)
SCHEMA = "job string, item long, status string, text string, error_kind string, error string, retryable boolean, attempts int"


@dataclass
class RecognitionError(Exception):
    kind: str
    message: str
    retryable: bool = False

    def __str__(self) -> str:
        return self.message


#: A client turns a work item (its columns as a dict) into text, or raises RecognitionError.
Client = Callable[[dict], str]


def attempt(client: Client, item: dict, delays: tuple[float, ...] = DELAYS, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The outcome of one item: retryable errors are tried again after the next delay; the last one is final."""
    error = RecognitionError("internal", "no attempt")
    tries = 0
    for tries, delay in enumerate(delays, 1):
        sleep(delay)
        try:
            return {"status": "done", "text": client(item), "error_kind": None, "error": None, "retryable": None, "attempts": tries}
        except RecognitionError as e:
            error = e
            if not e.retryable:
                break
    return {"status": "failed", "text": None, "error_kind": error.kind, "error": error.message, "retryable": False, "attempts": tries}


def recognise(items: DataFrame, client: Client, concurrency: int, delays: tuple[float, ...] = DELAYS) -> DataFrame:
    """Outcomes of items (job, item and what the client needs); `concurrency` tasks call the service at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"job": r["job"], "item": r["item"], **attempt(client, r, delays)} for r in pdf.to_dict("records")]
            yield pd.DataFrame(rows, columns=["job", "item", "status", "text", "error_kind", "error", "retryable", "attempts"])

    return items.repartition(concurrency, "job", "item").mapInPandas(run, SCHEMA)


def map_rows_to_pages(rows: list[str], pages: list[int]) -> list[tuple[int, str]]:
    """Result lines as (requested page, line): the n-th line belongs to the n-th page; numbers that differ are an error."""
    full = [r for r in rows if r.strip()]
    if len(full) != len(pages):
        raise RecognitionError("protocol", f"{len(full)} result rows for {len(pages)} pages")
    return list(zip(pages, full))


class DocumentService(Protocol):
    """A service that works through documents on its own: an injected transport."""

    def submit(self, item: dict) -> str:
        """Hand a document in; the number that it is known by from then on."""

    def poll(self, ticket: str) -> tuple[str, str]:
        """("pending", ""), ("done", where the result lies) or ("failed", why); may raise a RecognitionError."""

    def fetch(self, where: str) -> list[str]:
        """The lines of a result."""


#: Failed polls in a row that end a job, and seconds between polls; fixed values.
FAILED_POLLS, POLL_SECONDS = 5, 5.0


def document_rows(service: DocumentService, item: dict, seconds: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> list[str]:
    """Submit, poll and fetch one document. Single failed polls are passed over while the time lasts."""
    ticket, began, failed = service.submit(item), clock(), 0
    while clock() - began <= seconds:
        try:
            state, told = service.poll(ticket)
        except RecognitionError as e:
            failed += 1
            if not e.retryable or failed >= FAILED_POLLS:
                raise
        else:
            failed = 0
            if state == "done":
                return service.fetch(told)
            if state == "failed":
                raise RecognitionError("job", told)
        sleep(POLL_SECONDS)
    raise RecognitionError("timeout", "the document wasn't ready in time")


DOCUMENT = "job string, item long, page long, line string, error_kind string, error string"


def recognise_documents(items: DataFrame, service: DocumentService, concurrency: int, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(job, item, page, line, error_kind, error) of items (job, item, pages and what the service needs).

    The n-th line of a result belongs to the n-th page asked for; other numbers of lines fail the item as a whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                pages = [int(p) for p in r["pages"]]
                seconds = min(max(2.0 * len(pages), 300.0), 2400.0)
                try:
                    out += [(r["job"], r["item"], p, line, None, None) for p, line in map_rows_to_pages(document_rows(service, r, seconds, sleep=sleep), pages)]
                except RecognitionError as e:
                    out.append((r["job"], r["item"], None, None, e.kind, e.message))
            yield pd.DataFrame(out, columns=["job", "item", "page", "line", "error_kind", "error"])

    return items.repartition(concurrency, "job", "item").mapInPandas(run, DOCUMENT)


def rows_by_page(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, page, line, mismatch): the n-th line (doc, i, line) of a document with its n-th page asked for (doc, i, page).

    Documents whose numbers of lines and pages differ have one row, of a null page and line, with mismatch set.
    """
    held = lines.groupBy("doc").agg(F.count("*").alias("have"))
    asked = wanted.groupBy("doc").agg(F.count("*").alias("need"))
    counts = asked.join(held, "doc", "full").select("doc", (F.coalesce("have", F.lit(0)) != F.coalesce("need", F.lit(0))).alias("mismatch"))
    place = lambda df: df.withColumn("i", F.row_number().over(Window.partitionBy("doc").orderBy("i")))
    paired = place(wanted).join(place(lines), ["doc", "i"]).join(counts.filter("not mismatch"), "doc")
    return paired.select("doc", "page", "line", "mismatch").unionByName(counts.filter("mismatch").select("doc", F.lit(None).cast("long").alias("page"), F.lit(None).cast("string").alias("line"), "mismatch"))


def model_list(models: DataFrame, fixed: dict[str, list[str]]) -> DataFrame:
    """(provider, i, id, place): each provider's models (provider, i, id) in the order of their ids; a provider of `fixed`
    has those given there, in their order, whatever the table says."""
    rows = models.filter(~F.col("provider").isin(*fixed)) if fixed else models
    place = F.row_number().over(Window.partitionBy("provider").orderBy("id", "i")).cast("long")
    given = [(p, None, name, k) for p, names in fixed.items() for k, name in enumerate(names, 1)]
    return rows.select("provider", "i", "id", place.alias("place")).unionByName(models.sparkSession.createDataFrame(given, f"provider string, i {models.schema['i'].dataType.simpleString()}, id string, place long"))
