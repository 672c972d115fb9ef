"""The engine's entry points over layout documents, each a DataFrame in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import pages as G
from quirefold.functions.layout import ReadingOptions
from quirefold.operators import articles, pages, proofreading, reading
from quirefold.sources import layout_json, recognition
from quirefold.streaming import events


class LayoutEngine:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def import_json(self, path: str, unwrap: bool = False) -> LayoutDocuments:
        """Layout JSON files under a path; unwrap: lines of a file of lines are envelopes of pages, not pages."""
        return LayoutDocuments(layout_json.read_json(self.spark, path, unwrap))

    def plan_pages(self, requests: DataFrame) -> DataFrame:
        """requests (doc, raw, total) with pages and error."""
        total = F.col("total").cast("long")
        return requests.withColumn("error", G.range_error(F.col("raw"), total)).withColumn("pages", G.range_pages(F.col("raw"), total))

    def plan_chunks(self, page_lists: DataFrame, target: int = G.CHUNK_BYTES, most: int = G.CHUNK_PAGES) -> DataFrame:
        """page_lists (doc, page, file_bytes, file_pages) with chunk and chunk_page."""
        return pages.chunked(page_lists, "doc", "page", G.chunk_size(F.col("file_bytes"), F.col("file_pages"), target, most))

    def recognise(self, items: DataFrame, client: recognition.Client, concurrency: int = 4) -> DataFrame:
        return recognition.recognise(items, client, concurrency)

    def aggregate(self, outcomes: DataFrame, key: str, order: list[str]) -> DataFrame:
        return articles.aggregate_outcomes(outcomes, key, order)

    def apply(self, units: DataFrame) -> DataFrame:
        return proofreading.apply_suggestions(units)

    def job_states(self, job_events: DataFrame) -> DataFrame:
        return events.job_states(job_events) if job_events.isStreaming else events.folded(job_events)


class LayoutDocuments:
    """Imported layout documents."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self.blocks = layout_json.blocks(rows)

    def preflight(self) -> DataFrame:
        return layout_json.preflight(self.rows, self.blocks)

    def sizes(self) -> DataFrame:
        return layout_json.sizes(self.rows, self.blocks)

    def page_texts(self) -> DataFrame:
        return layout_json.page_texts(self.rows, self.blocks)

    def reading_items(self, options: ReadingOptions = ReadingOptions()) -> DataFrame:
        sized = self.blocks.join(self.sizes().withColumnsRenamed({"page_w": "width", "page_h": "height"}), ["doc_id", "page"])
        clean = reading.without_furniture(reading.with_furniture(sized), ["doc_id"], "page", options)
        return reading.reading_items(clean, ["doc_id", "page"], options)

    def to_markdown(self, options: ReadingOptions = ReadingOptions()) -> DataFrame:
        """(doc_id, page, markdown) of every page with text; with page numbers asked for, of every page, behind its anchor."""
        out = reading.markdown(self.reading_items(options), ["doc_id", "page"])
        if not options.include_page_number:
            return out
        anchor = F.concat(F.lit("〔Source page "), F.col("page").cast("string"), F.lit("〕\n\n"))
        every = self.rows.select("doc_id", "page").join(out, ["doc_id", "page"], "left")
        return every.select("doc_id", "page", F.concat(anchor, F.coalesce("markdown", F.lit(""))).alias("markdown"))

    def warnings(self, options: ReadingOptions = ReadingOptions()) -> DataFrame:
        """(doc_id, page, images, empty_tables, artefacts, items) of pages with blocks that a reading includes."""
        return reading.warnings(self.blocks, ["doc_id", "page"], options)

    def settings(self) -> DataFrame:
        return layout_json.model_settings(self.rows)
