"""Page lists: islands, chunks, offsets, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compacted(pages: DataFrame, doc: str, page: str) -> DataFrame:
    """(doc, ranges): distinct pages as a list of stretches, such as 1-3,7. Pages that are there twice have one rank."""
    island = F.col(page) - F.dense_rank().over(Window.partitionBy(doc).orderBy(page))
    runs = pages.select(doc, page).withColumn("_i", island).groupBy(doc, "_i").agg(F.min(page).alias("a"), F.max(page).alias("b"))
    shown = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    parts = F.sort_array(F.collect_list(F.struct("a", shown.alias("s"))))
    return runs.groupBy(doc).agg(F.array_join(F.transform(parts, lambda p: p["s"]), ",").alias("ranges"))


def chunked(pages: DataFrame, doc: str, page: str, size: Column) -> DataFrame:
    """pages with chunk (from 1) and chunk_page (from 1): consecutive groups of `size` pages."""
    at = F.row_number().over(Window.partitionBy(doc).orderBy(page)) - 1
    out = pages.withColumn("_at", at).withColumn("_size", size)
    return out.withColumn("chunk", (F.floor(F.col("_at") / F.col("_size")) + 1).cast("long")).withColumn("chunk_page", (F.col("_at") % F.col("_size") + 1).cast("long")).drop("_at", "_size")


def offsets(chunks: DataFrame, doc: str) -> DataFrame:
    """(doc, chunk, pages) with done_before: the pages of earlier chunks."""
    w = Window.partitionBy(doc).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("done_before", F.coalesce(F.sum("pages").over(w), F.lit(0)).cast("long"))


def page_list_faults(pages: DataFrame, doc: str, page: str, order: list[str], most: int) -> DataFrame:
    """(doc, pages, below_one, repeated, unordered, too_many) of page lists in their given order."""
    before = F.lag(page).over(Window.partitionBy(doc).orderBy(*order))
    return pages.withColumn("_before", before).groupBy(doc).agg(
        F.count("*").alias("pages"),
        F.max(F.col(page) < 1).alias("below_one"),
        (F.count(page) != F.countDistinct(page)).alias("repeated"),
        F.max(F.coalesce(F.col("_before") >= F.col(page), F.lit(False))).alias("unordered"),
        (F.count("*") > most).alias("too_many"),
    )


def halved(pages: DataFrame, doc: str, chunk: str, most: Column, rounds: int = 12) -> DataFrame:
    """pages (doc, chunk, page, bytes) with chunk numbered anew so that no chunk of several pages holds more than `most` bytes.

    A chunk that is too large is cut in the middle of its pages, its halves again; 2 ** rounds pages of a chunk at
    most. oversized tells single pages that are too large on their own.
    """
    out = pages.withColumn("_path", F.lit(""))
    key = [doc, chunk, "_path"]
    whole = Window.partitionBy(*key)
    for _ in range(rounds):
        n, size = F.count("*").over(whole), F.sum("bytes").over(whole)
        at = F.row_number().over(whole.orderBy("page"))
        side = F.when((size > most) & (n > 1), F.when(at <= F.floor(n / 2), "0").otherwise("1")).otherwise("")
        out = out.withColumn("_side", side).withColumn("_path", F.concat("_path", "_side")).drop("_side")
    number = F.dense_rank().over(Window.partitionBy(doc).orderBy(chunk, "_path"))
    return out.withColumn("_new", number.cast("long")).withColumn("oversized", F.sum("bytes").over(whole) > most).drop(chunk, "_path").withColumnRenamed("_new", chunk)
