"""Edits of blocks, articles, selections, queues and recognised texts, as table functions over all files at once.

Tables: blocks (file, page, block and more), articles (file, article, num, title), refs (file, article, page, block,
ord), selected (file, page, block, ord). An edit takes tables and gives the tables that stand after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import text as X
from quirefold.operators.articles import DEFAULT_TITLE
from quirefold.sources.shared import store

BLOCK = ["file", "page", "block"]


def patched(rows: DataFrame, patches: DataFrame, key: list[str]) -> DataFrame:
    """rows with the fields that a patch of their key gives; null fields of a patch change nothing, unknown keys neither.

    A key has one patch at most.
    """
    fields = [c for c in patches.columns if c not in key]
    given = patches.withColumnsRenamed({c: f"_p_{c}" for c in fields})
    joined = rows.join(given, key, "left")
    return joined.select(*[F.coalesce(f"_p_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns])


def without(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(gone.select(*key).distinct(), key, "left_anti")


def compacted_refs(refs: DataFrame) -> DataFrame:
    """refs with ord from 1 without gaps in each article; equal orders keep their pages' and blocks' order."""
    place = Window.partitionBy("file", "article").orderBy("ord", "page", "block")
    return refs.withColumn("ord", F.row_number().over(place).cast("long"))


def numbered(articles: DataFrame) -> DataFrame:
    """articles with num from 1 in each file, in their present order; titles made from a number follow it."""
    out = articles.withColumn("num", F.row_number().over(Window.partitionBy("file").orderBy("num", "article")).cast("long"))
    auto = F.concat(F.lit("Article "), F.col("num").cast("string"))
    return out.withColumn("title", F.when(F.col("title").rlike(DEFAULT_TITLE), auto).otherwise(F.col("title")))


def without_empty(articles: DataFrame, refs: DataFrame) -> DataFrame:
    """Articles that some ref belongs to, renumbered."""
    return numbered(articles.join(refs.select("file", "article").distinct(), ["file", "article"], "left_semi"))


def back_pointers(blocks: DataFrame, refs: DataFrame) -> DataFrame:
    """blocks with article and article_ord, null for blocks of no article."""
    own = refs.select(*BLOCK, "article", F.col("ord").alias("article_ord"))
    return blocks.drop("article", "article_ord").join(own, BLOCK, "left")


def remove_blocks(blocks: DataFrame, articles: DataFrame, refs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks go, and with them their places in articles; articles left empty go too."""
    kept = compacted_refs(without(refs, gone, BLOCK))
    return without(blocks, gone, BLOCK), without_empty(articles, kept), kept


def _of_kind(rows: DataFrame, kind: str) -> DataFrame:
    return rows.withColumn("_kind", F.lit(kind))


def mark_selection(blocks: DataFrame, articles: DataFrame, refs: DataFrame, selected: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles, refs) after the selected blocks of each file went to one article, in the order of selection.

    targets (file, article, fresh): the article that is added to, null or unknown for a new one with the id `fresh`.
    Selected blocks that don't exist are passed over; a file without others stays as it is. Blocks leave the article
    that they were in; articles left empty go, the target apart. A new article is numbered behind the highest.
    """
    kind = F.col("_kind")
    own, file = Window.partitionBy(*BLOCK), Window.partitionBy("file")
    # Which selected blocks exist and which places in articles they leave: one exchange by block.
    marks = _of_kind(refs, "ref").unionByName(_of_kind(selected, "pick"), True).unionByName(_of_kind(blocks.select(*BLOCK), "block"), True)
    marks = marks.withColumn("_moves", F.bool_or(kind == "block").over(own) & F.bool_or(kind == "pick").over(own))
    placed = marks.filter((kind == "pick") & F.col("_moves") | (kind == "ref") & ~F.col("_moves")).drop("_moves")
    # Where they go and what becomes of the articles: one exchange by file.
    rows = placed.unionByName(_of_kind(articles, "article"), True).unionByName(_of_kind(targets, "target"), True)
    want = F.max(F.when(kind == "target", F.struct("article", "fresh"))).over(file)
    top = F.coalesce(F.max(F.when(kind == "article", F.col("num"))).over(file), F.lit(0)) + 1
    rows = rows.withColumns({"_chosen": F.bool_or(kind == "pick").over(file), "_want": want, "_top": top})
    known = F.bool_or((kind == "article") & (F.col("article") == F.col("_want.article"))).over(file)
    rows = rows.withColumn("_known", F.coalesce(known, F.lit(False)))
    rows = rows.withColumn("_to", F.when(F.col("_chosen"), F.when(F.col("_known"), F.col("_want.article")).otherwise(F.col("_want.fresh"))))
    end = F.max(F.when((kind == "ref") & (F.col("article") == F.col("_to")), F.col("ord"))).over(file)
    rank = F.row_number().over(Window.partitionBy("file", "_kind").orderBy("ord", "page", "block"))
    rows = rows.withColumn("_behind", F.coalesce(end, F.lit(0)) + rank)
    made = (kind == "target") & F.col("_chosen") & ~F.col("_known")
    rows = rows.filter(kind.isin("ref", "article") | (kind == "pick") & F.col("_to").isNotNull() | made)
    is_new = kind.isin("pick", "target")
    rows = rows.withColumns(
        {
            "article": F.when(is_new, F.col("_to")).otherwise(F.col("article")),
            "ord": F.when(kind == "pick", F.col("_behind")).otherwise(F.col("ord")),
            "num": F.when(kind == "target", F.col("_top")).otherwise(F.col("num")),
            "title": F.when(kind == "target", F.concat(F.lit("Article "), F.col("_top").cast("string"))).otherwise(F.col("title")),
        }
    )
    # In files without a selection nothing changes, so their empty articles stay as well.
    filled = F.bool_or(kind.isin("ref", "pick")).over(Window.partitionBy("file", "article"))
    rows = rows.withColumn("_alive", filled | ~F.col("_chosen") | F.coalesce(F.col("article") == F.col("_to"), F.lit(False)))
    rows = store(rows.select("file", "article", "num", "title", "page", "block", "ord", "_kind", "_alive"), "marked")  # both results are read from it
    now = compacted_refs(rows.filter(kind.isin("ref", "pick")).select("file", "article", "page", "block", F.col("ord").cast("long").alias("ord")))
    return numbered(rows.filter(kind.isin("article", "target") & F.col("_alive")).select("file", "article", "num", "title")), now


def remove_articles(blocks: DataFrame, articles: DataFrame, refs: DataFrame, texts: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Articles (file, article) go with their blocks and texts; the others are renumbered. All of a file's: it is cleared."""
    key = ["file", "article"]
    torn = refs.join(gone.select(*key).distinct(), key, "left_semi")
    return without(blocks, torn, BLOCK), numbered(without(articles, gone, key)), compacted_refs(without(refs, gone, key)), without(texts, gone, key)


def block_places(refs: DataFrame) -> DataFrame:
    """refs by article, page and order with i of n: which block of its article each is, and from 1 in the whole file."""
    order = Window.partitionBy("file", "article").orderBy("ord")
    n = F.count("*").over(Window.partitionBy("file", "article"))
    work = Window.partitionBy("file").orderBy("page", "article", "ord")
    return refs.withColumn("i", F.row_number().over(order).cast("long")).withColumn("n", n).withColumn("work", F.row_number().over(work).cast("long"))


def pushed(picks: DataFrame, at: Column) -> DataFrame:
    """Selections as they stand after picks in time: a block picked again moves to the end. ord counts from 1."""
    last = picks.groupBy(*BLOCK).agg(F.max(at).alias("_at"))
    return last.withColumn("ord", F.row_number().over(Window.partitionBy("file").orderBy("_at", "page", "block")).cast("long")).drop("_at")


def queue_add(queue: DataFrame, entries: DataFrame) -> DataFrame:
    """queue (owner, file, pos) with entries (owner, file, at) that it lacks behind its end, each once, by `at`."""
    key = ["owner", "file"]
    new = entries.groupBy(*key).agg(F.min("at").alias("at")).join(queue.select(*key), key, "left_anti")
    end = queue.groupBy("owner").agg(F.max("pos").alias("end"))
    place = F.row_number().over(Window.partitionBy("owner").orderBy("at", "file"))
    return queue.select(*key, "pos").unionByName(new.withColumn("pos", place.cast("long")).join(end, "owner", "left").select(*key, (F.coalesce("end", F.lit(0)) + F.col("pos")).alias("pos")))


def queue_remove(queue: DataFrame, current: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queue, current) without one file (owner, file) for each owner; if it was current, the next takes its place, else the one before."""
    beside = Window.partitionBy("owner").orderBy("pos")
    heirs = queue.withColumn("heir", F.coalesce(F.lead("file").over(beside), F.lag("file").over(beside)))
    lost = heirs.join(gone, ["owner", "file"], "left_semi").select("owner", "file", "heir", F.lit(True).alias("_lost"))
    now = current.join(lost, ["owner", "file"], "left").select("owner", F.when(F.col("_lost"), F.col("heir")).otherwise(F.col("file")).alias("file"))
    return without(queue, gone, ["owner", "file"]), now


def with_page_texts(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """pages (file, page, text, status, source) after edits (file, page, text): an edited page, also a new one, has edited set."""
    new = edits.select("file", "page", F.col("text").alias("_new"), F.lit(True).alias("_edit"))
    out = pages.join(new, ["file", "page"], "full")
    pick = lambda c, default: F.coalesce(c, F.when(F.col("_edit"), F.lit(default))).alias(c)
    return out.select("file", "page", F.when(F.col("_edit"), F.col("_new")).otherwise(F.col("text")).alias("text"), pick("status", "done"), pick("source", "page_image"), F.coalesce("_edit", F.lit(False)).alias("edited"))


def replaced_once(text: Column, old: Column, new: Column) -> Column:
    """text with new in place of old, if old isn't blank and stands in it exactly once; else text."""
    at = F.position(old, text)
    once = X.not_blank(old) & (at > 0) & (F.position(old, text, at + 1) == 0)
    put = F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text)))
    return F.when(once, put).otherwise(text)


def judged(suggestions: DataFrame, one: DataFrame, by_category: DataFrame) -> DataFrame:
    """suggestions (key, i, category, verdict, edited_after) after verdicts for whole categories and then for single ones.

    one: (key, i, verdict, edited_after); by_category: (key, category, verdict). Only an edited verdict keeps a text.
    """
    category = by_category.select("key", "category", F.col("verdict").alias("_c"))
    single = one.select("key", "i", F.col("verdict").alias("_s"), F.coalesce("edited_after", F.lit("")).alias("_text"))
    rows = suggestions.join(category, ["key", "category"], "left").join(single, ["key", "i"], "left")
    verdict = F.coalesce("_s", "_c", "verdict")
    text = F.when(F.col("_s") == "edited", F.col("_text")).when(F.col("_s").isNull(), F.col("edited_after"))
    return rows.select(*[c for c in suggestions.columns if c not in ("verdict", "edited_after")], verdict.alias("verdict"), F.when(verdict == "edited", text).alias("edited_after"))


def category_states(suggestions: DataFrame) -> DataFrame:
    """(key, category, suggestions, applied, state): all where every one is accepted, else mixed; edited ones are applied too."""
    return suggestions.groupBy("key", "category").agg(
        F.count("*").alias("suggestions"),
        F.count_if(F.col("verdict").isin("accepted", "edited")).alias("applied"),
        F.when(F.bool_and(F.coalesce(F.col("verdict") == "accepted", F.lit(False))), "all").otherwise("mixed").alias("state"),
    )


def reviewed(reviews: DataFrame, action: Column) -> DataFrame:
    """reviews (status, base, applied_text, output, live) after an action, with text and done.

    apply: a pending review whose base is the live text puts its output there. undo: an applied one whose own output
    still stands puts the base back. Anything else changes nothing; discard forgets the review.
    """
    fits = (action == "apply") & (F.col("status") != "applied") & (F.col("live") == F.col("base"))
    back = (action == "undo") & (F.col("status") == "applied") & F.coalesce(F.col("live") == F.col("applied_text"), F.col("applied_text").isNull())
    fits, back = F.coalesce(fits, F.lit(False)), F.coalesce(back, F.lit(False))
    text = F.when(fits, F.col("output")).when(back, F.col("base")).otherwise(F.col("live"))
    status = F.when(action == "discard", F.lit(None).cast("string")).when(fits, "applied").when(back, "pending").otherwise(F.col("status"))
    return reviews.withColumns({"text": text, "done": fits | back | (action == "discard"), "status": status}).withColumn("applied_text", F.when(F.col("status") == "applied", F.when(fits, F.col("output")).otherwise(F.col("applied_text"))))


def article_boxes(refs: DataFrame, rects: DataFrame) -> DataFrame:
    """(article, page, x0, y0, x1, y1): the box around an article's blocks on each page. rects: BLOCK, x, y, w, h.

    Sides may be negative, as they are drawn; blocks with a side that isn't finite are passed over.
    """
    good = rects.filter(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('Infinity')" for c in "xywh"))
    side = lambda f, a, b: f(F.col(a), F.col(a) + F.col(b))
    return refs.join(good, BLOCK).groupBy("article", "page").agg(F.min(side(F.least, "x", "w")).alias("x0"), F.min(side(F.least, "y", "h")).alias("y0"), F.max(side(F.greatest, "x", "w")).alias("x1"), F.max(side(F.greatest, "y", "h")).alias("y1"))


def image_plan(targets: DataFrame, boxes: DataFrame, share: float, most: int) -> DataFrame:
    """(job, key, page, left, top, right, bottom, i, too_many): the pictures that proofreading targets need, in order.

    targets (job, seq, article, page): a page needs one whole picture, with null corners; an article one crop for each
    page that its blocks lie on, with a margin in proportion to the crop (boxes of `article_boxes`). Articles without
    blocks need none. too_many tells jobs with more than `most` pictures.
    """
    corners = ("left", "top", "right", "bottom")
    whole = targets.filter("article is null").select("job", "seq", F.concat(F.lit("page:"), F.col("page").cast("string")).alias("key"), "page", *[F.lit(None).cast("double").alias(c) for c in corners])
    w, h = (F.col("x1") - F.col("x0")) * share, (F.col("y1") - F.col("y0")) * share
    crops = targets.filter("article is not null").drop("page").join(boxes.filter("x1 > x0 and y1 > y0"), "article")
    crops = crops.select("job", "seq", F.concat(F.lit("article:"), F.col("article").cast("string")).alias("key"), "page", (F.col("x0") - w).alias("left"), (F.col("y0") - h).alias("top"), (F.col("x1") + w).alias("right"), (F.col("y1") + h).alias("bottom"))
    every = whole.unionByName(crops)
    i = F.row_number().over(Window.partitionBy("job").orderBy("seq", "page"))
    return every.withColumn("i", i.cast("long")).withColumn("too_many", F.count("*").over(Window.partitionBy("job")) > most).drop("seq")


def edited_layout(pages: DataFrame, blocks: DataFrame, page: list[str]) -> DataFrame:
    """(page, pos, label, text, x0, y0, x1, y1, ord) of the pages as they were edited.

    pages (page, width, height, text, edited), blocks (page and the others). A page whose text was edited is one block over
    the whole page, or none if it is blank: it never falls back to what was read there. A page without a size has no
    layout, and so no block. Blocks of pages that aren't in the table go.
    """
    there = pages.filter("width is not null and height is not null").withColumn("_edited", F.coalesce("edited", F.lit(False)))
    cols = ["pos", "label", "text", "x0", "y0", "x1", "y1", "ord"]
    old = blocks.select(*page, *cols).join(there.filter(~F.col("_edited")).select(*page), page, "left_semi")
    kinds = {c: blocks.schema[c].dataType for c in cols}
    values = {"pos": F.lit(0), "label": F.lit("text"), "text": F.col("text"), "x0": F.lit(0), "y0": F.lit(0), "x1": F.col("width"), "y1": F.col("height"), "ord": F.lit(1)}
    new = there.filter(F.col("_edited") & X.not_blank(F.col("text"))).select(*page, *[values[c].cast(kinds[c]).alias(c) for c in cols])
    return old.unionByName(new)


def cascade(tables: dict[str, tuple[DataFrame, str]], removed: DataFrame, key: str) -> dict[str, DataFrame]:
    """Tables, each with the column that names a file, without the rows of removed files (key); null names stay."""
    return {name: rows.join(removed.select(F.col(key).alias(c)).distinct(), c, "left_anti").select(*rows.columns) for name, (rows, c) in tables.items()}
