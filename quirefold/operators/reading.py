"""From layout blocks to reading text: order, running headers, reading items, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import layout as L
from quirefold.functions import text as X

REPEATS = 3
SPREAD = 64  # keys over which blocks without a key are dealt in a join


def in_reading_order(blocks: DataFrame, page: list[str]) -> DataFrame:
    """blocks with seq, from 1 in each page: by ord where any block of the page has one, else top down and right to left."""
    ordered = F.max(F.col("ord").isNotNull()).over(Window.partitionBy(*page))
    far = F.lit(2**31 - 1).cast("long")
    keyed = blocks.withColumn("_by_ord", ordered)
    order = [F.when(F.col("_by_ord"), F.coalesce(F.col("ord").cast("long"), far)).otherwise(0), F.when(~F.col("_by_ord"), F.col("y0")), F.when(~F.col("_by_ord"), -F.col("x0")), F.col("pos")]
    return keyed.withColumn("seq", F.row_number().over(Window.partitionBy(*page).orderBy(*order)).cast("long")).drop("_by_ord")


def with_furniture(blocks: DataFrame) -> DataFrame:
    """blocks with role, kind and key: what is needed to tell running headers and footers.

    Only body blocks that lie where running lines are printed get a key, worked out once a row.
    """
    kind = L.furniture_kind(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.coalesce("width", F.lit(1000)).cast("double"), F.coalesce("height", F.lit(1500)).cast("double"))
    placed = blocks.withColumn("role", L.role(F.col("label"))).withColumn("kind", kind)
    key = F.when((F.col("role") == "Body") & F.col("kind").isNotNull(), X.furniture_key(F.col("text")))
    return placed.withColumn("key", F.explode(F.array(key)))  # a generated column, so that filters don't repeat it


def repeated_keys(blocks: DataFrame, doc: list[str], page: str, at_least: int = REPEATS) -> DataFrame:
    """Keys of body blocks in running-line places of three pages or more."""
    placed = blocks.filter((F.col("role") == "Body") & F.col("key").isNotNull() & F.col("kind").isNotNull())
    return placed.groupBy(*doc, "key").agg(F.countDistinct(page).alias("pages")).filter(F.col("pages") >= at_least)


def _furniture_marked(blocks: DataFrame, doc: list[str], page: str, options: L.ReadingOptions) -> DataFrame:
    """blocks with _skip: whether a block is a repeated running line of a kind that isn't included."""
    gone = [k for k, on in (("Header", options.include_header), ("Footer", options.include_footer)) if not on]
    repeated = repeated_keys(blocks, doc, page).select(*doc, "key").withColumn("_gone", F.lit(True))
    # Most blocks have no key; they are dealt evenly under keys that match nothing.
    own = F.coalesce("key", F.concat(F.lit("\0"), F.pmod(F.xxhash64("text"), F.lit(SPREAD)).cast("string")))
    marked = blocks.withColumn("_key", own).join(repeated.withColumnRenamed("key", "_key"), [*doc, "_key"], "left")
    skip = F.coalesce(F.col("_gone"), F.lit(False)) & F.coalesce(F.col("kind").isin(*gone), F.lit(False))
    return marked.withColumn("_skip", skip).drop("_gone", "_key")


def without_furniture(blocks: DataFrame, doc: list[str], page: str, options: L.ReadingOptions = L.ReadingOptions()) -> DataFrame:
    """blocks without repeated running lines of the kinds that aren't included."""
    return _furniture_marked(blocks, doc, page, options).filter(~F.col("_skip")).drop("_skip")


def furniture_counts(blocks: DataFrame, doc: list[str], page: str, options: L.ReadingOptions = L.ReadingOptions()) -> DataFrame:
    """(doc, inferred): how many running lines a reading of each document leaves out because they are repeated."""
    return _furniture_marked(blocks, doc, page, options).groupBy(*doc).agg(F.count_if("_skip").alias("inferred"))


def rendered(role: Column, text: Column, image_ref: Column | None = None) -> Column:
    """The text of a block in a reading, null where nothing is left of it."""
    caption = X.strip_html(text)
    placeholder = X.image_placeholder(image_ref if image_ref is not None else F.lit(None).cast("string"))
    picture = F.when(caption == "", placeholder).otherwise(F.concat(placeholder, F.lit(" "), caption))
    body = X.repair_short_lines(X.clean_block_text(text))
    out = F.when(role == "Image", picture).when(role == "Table", X.trim_ws(text)).otherwise(body)
    return F.when(out != "", out)


def markdown_of(role: Column, text: Column) -> Column:
    quoted = F.array_join(F.transform(X.lines(text), lambda line: F.concat(F.lit("> "), line)), "\n")
    one = X.one_line(text)
    return F.when(role == "DocTitle", F.concat(F.lit("# "), one)).when(role == "Heading", F.concat(F.lit("## "), one)).when(role == "FigureCaption", F.concat(F.lit("### "), one)).when(role.isin("Footnote", "Aside"), quoted).otherwise(text)


def reading_items(blocks: DataFrame, page: list[str], options: L.ReadingOptions = L.ReadingOptions()) -> DataFrame:
    """Included blocks in reading order with role and rendered text."""
    ordered = in_reading_order(blocks.withColumn("role", L.role(F.col("label"))), page)
    return ordered.filter(L.included(F.col("role"), options) & ~X.is_scanner_artefact(F.col("text"))).withColumn("item", F.explode(F.array(rendered(F.col("role"), F.col("text"))))).filter("item is not null")  # a generated column, so that the filter doesn't repeat it


def markdown(items: DataFrame, doc: list[str]) -> DataFrame:
    """One Markdown text for each document: paragraphs between blank lines, with a blank line at the end."""
    parts = F.sort_array(F.collect_list(F.struct("seq", markdown_of(F.col("role"), F.col("item")).alias("md"))))
    whole = F.concat(F.array_join(F.transform(parts, lambda p: F.regexp_replace(p["md"], r"^\n+", "")), "\n\n"), F.lit("\n\n"))
    return items.groupBy(*doc).agg(whole.alias("markdown"))


def resolved_sizes(pages: DataFrame, doc: str) -> DataFrame:
    """pages (width and height, null where unmeasured; ext_w and ext_h) with page_w, page_h and approximate.

    Unmeasured pages get the longest long side and the longest short side of their document, turned as they lie.
    """
    measured = F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False))
    w, h = F.when(measured, F.col("width")).otherwise(F.col("ext_w")).cast("double"), F.when(measured, F.col("height")).otherwise(F.col("ext_h")).cast("double")
    factor = F.when(measured, 1.0).otherwise(L.INFERRED_MARGIN)
    # Two numbers a document, joined back, so that no task holds all pages of one.
    sides = pages.groupBy(doc).agg(F.max(F.greatest(w, h) * factor).alias("_long"), F.max(F.least(w, h) * factor).alias("_short"))
    return (
        pages.join(sides, doc, "left")
        .withColumn("page_w", F.when(measured, w).when(w >= h, F.col("_long")).otherwise(F.col("_short")))
        .withColumn("page_h", F.when(measured, h).when(w >= h, F.col("_short")).otherwise(F.col("_long")))
        .withColumn("approximate", ~measured)
        .drop("_long", "_short")
    )


def warnings(blocks: DataFrame, page: list[str], options: L.ReadingOptions = L.ReadingOptions()) -> DataFrame:
    """(page, images, empty_tables, artefacts, items) of pages with included blocks: what a reading stands in for or leaves out.

    Pages without items are the ones of which only the page number is kept.
    """
    role, blank = F.col("role"), ~X.not_blank(F.col("text"))
    rows = blocks.withColumn("role", L.role(F.col("label"))).filter(L.included(F.col("role"), options)).withColumn("artefact", X.is_scanner_artefact(F.col("text")))
    read = ~F.col("artefact")
    return rows.groupBy(*page).agg(
        F.bool_or((role == "Image") & read).alias("images"),
        F.bool_or((role == "Table") & blank & read).alias("empty_tables"),
        F.count_if("artefact").alias("artefacts"),
        F.count_if(read & (~blank | role.isin("Image", "Table"))).alias("items"),
    )
