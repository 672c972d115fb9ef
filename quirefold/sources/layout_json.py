"""Layout JSON of recognition services as tables: envelopes, pages, blocks, texts and a preflight report.

A file is one JSON value, or else a value a line. Lines are read in splits of any size and numbered by the counts of the
splits before theirs, so a file of lines of any length is never one row; only a file that is one value is put together.
Many small files may stand in a few bundles.
Values are read schema-on-read into VARIANT. Keys come in two spellings, and the first that is present counts even if
its value is null or of the wrong type; numbers in quotes are no numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.functions import layout as L
from quirefold.functions import text as X
from quirefold.operators import reading as R
from quirefold.sources.shared import store

#: Keys that make an object a page, and those of lists and settings; fixed values.
PAGE_KEYS = ("prunedResult", "pruned_result", "parsing_res_list", "page_size", "pageSize", "page_width", "pageWidth")
LIST_KEYS = ("layoutParsingResults", "layout_parsing_results")
SETTINGS_KEYS = ("modelSettings", "model_settings")
#: Keys of a block that are read, in both spellings; fixed values.
BLOCK_KEYS = ("block_label", "blockLabel", "block_content", "blockContent", "block_bbox", "blockBbox", "block_order", "blockOrder", "block_polygon_points", "blockPolygonPoints", "block_image", "blockImage")
BLOCK = "struct<" + ",".join(f"{k}:variant" for k in BLOCK_KEYS) + ",markdown:struct<text:variant>>"
MAX_ORDER = 4_294_967_295
BETWEEN = "\t"  # a file's name and its line, in a bundle


def _at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _first(v: Column, *paths: str) -> Column:
    """The first of the paths that is present, JSON null included."""
    return F.coalesce(*[_at(v, p) for p in paths])


def _text(v: Column) -> Column:
    """A JSON string; null for anything else."""
    return F.when(F.schema_of_variant(v) == "STRING", _at(v, "$", "string"))


def _number(v: Column) -> Column:
    return F.when(F.schema_of_variant(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), _at(v, "$", "double"))


def _list(v: Column) -> Column:
    """The items of a JSON list; null for anything else."""
    return _at(v, "$", "array<variant>")


def _object(v: Column) -> Column:
    """The entries of a JSON object; null for anything else."""
    return _at(v, "$", "map<string,variant>")


def _filled(v: Column) -> Column:
    """Whether a value is an object or a list that isn't empty."""
    return F.coalesce(F.size(F.map_keys(_object(v))), F.size(_list(v)), F.lit(0)) > 0


def looks_like_page(v: Column) -> Column:
    return F.coalesce(F.arrays_overlap(F.map_keys(_object(v)), F.array(*[F.lit(k) for k in PAGE_KEYS])), F.lit(False))


def _layout_results(v: Column) -> Column:
    return F.coalesce(*[_list(_at(v, f"{base}.{k}")) for base in ("$", "$.result") for k in LIST_KEYS])


def envelope_pages(v: Column) -> Column:
    """The pages of a file's value, null if it has none.

    A list is the pages; else the list under pages or results; else the layout results, if one of them looks like a
    page, and otherwise the whole value as a page; then the same under result; then the value itself if it looks like one.
    """

    def paged(other: Column) -> Callable[[Column], Column]:
        return lambda found: F.when(found.isNotNull(), F.when(F.exists(found, looks_like_page), found).otherwise(F.array(v))).otherwise(other)

    out = F.when(looks_like_page(v), F.array(v))
    for base in ("$.result", "$"):
        for key in reversed(LIST_KEYS):
            out = X.let(_list(_at(v, f"{base}.{key}")), paged(out))
        for key in ("results", "pages"):
            out = F.coalesce(_list(_at(v, f"{base}.{key}")), out)
    return F.coalesce(_list(v), out)


def _cut(text: DataFrame, bundled: bool) -> DataFrame:
    """(doc_id, block, row, value, v, parsed) of every line: its file, its split and its place there; a blank one has nothing else.

    Written once, so that each file is opened and each line parsed a single time.
    """
    name, value = F.col("_metadata.file_path"), F.col("value")
    if bundled:
        cut = F.instr("value", BETWEEN)
        name = F.when(cut > 0, F.substring(value, F.lit(1), cut - 1)).otherwise(F.raise_error(F.concat(F.lit("a line without a file's name in "), name)))
        value = F.substring(value, cut + 1, F.length(value))
    lines = text.select(name.alias("doc_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.explode(F.array(value)).alias("value"))
    lines = lines.withColumn("value", F.when(X.not_blank(F.col("value")), F.col("value")))
    return store(lines.select("*", F.explode(F.array(F.try_parse_json("value"))).alias("v")).select("*", F.when(F.col("value").isNotNull(), F.col("v").isNotNull()).alias("parsed")), "layout-lines")


def _splits(cut: DataFrame, unwrap: bool) -> DataFrame:
    """(doc_id, block, kind, base) of each split: whether its file is lines, one line or one value, and the pages before the split.

    A value that ends in the first line of several can't be the whole file's, so that file is lines.
    """
    pages = F.coalesce(F.size(envelope_pages(F.col("v"))), F.lit(0)) if unwrap else F.lit(1)
    filled = F.col("parsed").isNotNull()
    sums = cut.groupBy("doc_id", "block").agg(
        F.count_if(filled).alias("n"), F.count_if(~F.col("parsed")).alias("bad"), F.min_by("parsed", F.when(filled, F.col("row"))).alias("begins"), F.sum(F.when(filled, pages)).alias("pages")
    )
    file = Window.partitionBy("doc_id")
    order = file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    n, bad = F.sum("n").over(file), F.sum("bad").over(file)
    begins = F.min_by("begins", F.when(F.col("n") > 0, F.col("block"))).over(file)
    lines = begins & (n > 1)
    wrong = (n == 0) | (lines & (bad > 0))
    kind = F.when(wrong, F.raise_error(F.concat(F.lit("neither JSON nor JSON lines: "), F.col("doc_id")))).otherwise(F.when(lines, "lines").when((n == 1) & (bad == 0), "line").otherwise("value"))
    # Counts of each split, one row: a file's window holds as many rows as the file has splits.
    return store(sums.select("doc_id", "block", kind.alias("kind"), F.coalesce(F.sum("pages").over(order), F.lit(0)).alias("base")), "layout-splits")


def _without_rows(spark: SparkSession, text: DataFrame, splits: DataFrame) -> None:
    """Fails if a file has no line at all: scans pass over it, so only the listing of files knows it."""
    names = text.inputFiles()
    if len(names) == splits.select("doc_id").distinct().count():
        return
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+:)/+", "$1/")
    listed = spark.createDataFrame([(n,) for n in names], "name string")
    if missing := listed.join(splits.select(plain(F.col("doc_id")).alias("seen")), plain(F.col("name")) == F.col("seen"), "left_anti").head(1):
        raise ValueError(f"neither JSON nor JSON lines: {missing[0]['name']}")


def bundle(files: DataFrame, path: str) -> None:
    """Writes files (name, seq, value: their text in parts, in the order of seq) as bundles: as many as there are tasks.

    Each line stands behind its file's name, and a file is in one bundle whole. Small files cost more to be made, listed
    and opened than to be read.
    """
    dealt = files.repartition("name").sortWithinPartitions("name", "seq")
    dealt.select("name", F.explode(F.split("value", "\r\n|\r|\n", -1)).alias("line")).select(F.concat("name", F.lit(BETWEEN), "line").alias("value")).write.text(path)


def read_json(spark: SparkSession, path: str, unwrap: bool = False, bundled: bool = False) -> DataFrame:
    """(doc_id, page, v, i, info, settings): one row for each page of each file; JSON, or else one value a line.

    Every line is one page; with unwrap its envelope is opened as a file's is. A file that is neither, or has no pages,
    fails the query with its name; what stands behind a file's one value is not looked at. Bundles hold many files;
    one without any line isn't in them.
    """
    text = spark.read.text(path)
    cut = _cut(text, bundled)
    splits = _splits(cut, unwrap)
    if not bundled:
        _without_rows(spark, text, splits)
    known = cut.filter("parsed is not null").join(splits, ["doc_id", "block"])

    def opened(rows: DataFrame) -> DataFrame:
        found = rows.withColumn("pages", envelope_pages(F.col("v")))
        return found.withColumn("pages", F.when(F.col("pages").isNotNull(), F.col("pages")).otherwise(F.raise_error(F.concat(F.lit("no pages in "), F.col("doc_id")))))

    lines = known.filter("kind = 'lines'").select("doc_id", "block", "row", "base", "v")
    if unwrap:
        lines = opened(lines)
    else:
        lines = lines.withColumn("pages", F.array("v"))
    upto = F.sum(F.size("pages")).over(Window.partitionBy("doc_id", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("before", F.col("base") + upto - F.size("pages")).select("doc_id", "before", F.col("v").alias("root"), F.lit(unwrap).alias("own"), F.posexplode_outer("pages").alias("i", "v"))

    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "row", "value"))), lambda p: p["value"])
    whole = known.filter("kind = 'value'").groupBy("doc_id").agg(F.array_join(parts, "\n").alias("value")).select("doc_id", F.try_parse_json("value").alias("v"))
    whole = whole.withColumn("v", F.when(F.col("v").isNotNull(), F.col("v")).otherwise(F.raise_error(F.concat(F.lit("neither JSON nor JSON lines: "), F.col("doc_id")))))
    # A value that is told by its split's row, or else the check for pages could be made for lines of other files, before the join.
    single = known.filter("kind = 'line'").select("doc_id", F.when(F.col("base") >= 0, F.col("v")).alias("v"))
    whole = opened(single.unionByName(whole)).select("doc_id", F.lit(0).cast("long").alias("before"), F.col("v").alias("root"), F.lit(True).alias("own"), F.posexplode_outer("pages").alias("i", "v"))

    # Without `outer` the lists would be worked out once more by a filter for those that aren't empty.
    rows = lines.unionByName(whole).filter("i is not null")
    place = (F.col("before") + F.col("i") + 1).cast("int")
    # Of lines the file has no value of its own, only each page.
    root = F.when(F.col("own"), F.col("root"))
    info = F.coalesce(_data_info(F.col("v")), _data_info(root))
    at = F.when(F.col("own"), F.col("i")).otherwise(place - 1)
    return rows.select("doc_id", place.alias("page"), "v", at.alias("i"), info.alias("info"), _settings(root, "$", "$.result").alias("settings"))


def _data_info(v: Column) -> Column:
    found = [_at(v, f"{base}.{k}") for base in ("$", "$.result") for k in ("dataInfo", "data_info")]
    return F.coalesce(*[F.when(_object(x).isNotNull(), x) for x in found])


def _settings(v: Column, *bases: str) -> Column:
    """The first settings that aren't null; JSON null counts as null here."""
    found = [_at(v, f"{base}.{k}") for base in bases for k in SETTINGS_KEYS]
    return F.coalesce(*[F.when(~F.is_variant_null(x), x) for x in found])


def _pruned(v: Column) -> Column:
    return _first(v, "$.prunedResult", "$.pruned_result")


def model_settings(pages: DataFrame) -> DataFrame:
    """(doc_id, settings, ignore_labels) of documents that have model settings: the file's, its result's, or the first page's own."""
    own = F.coalesce(_settings(F.col("v"), "$"), _settings(_pruned(F.col("v")), "$"))
    rows = pages.select("doc_id", "page", F.coalesce("settings", own).alias("s")).withColumn("j", F.to_json("s"))
    first = rows.groupBy("doc_id").agg(F.min_by("j", F.when(F.col("j").isNotNull(), F.col("page"))).alias("settings")).filter("settings is not null")
    s = F.try_parse_json("settings")
    listed = F.coalesce(*[_list(_at(s, f"$.{k}")) for k in ("markdownIgnoreLabels", "markdown_ignore_labels")])
    return first.withColumn("ignore_labels", F.coalesce(F.filter(F.transform(listed, _text), lambda x: x.isNotNull()), F.array().cast("array<string>")))


def _positive(w: Column, h: Column) -> Column:
    return F.when((w > 0) & (h > 0), F.struct(w.alias("w"), h.alias("h")))


def _pair(v: Column) -> Column:
    """(w, h) from a list of two at least or an object; null unless both are positive numbers."""
    listed = _list(v)
    return F.coalesce(_positive(_number(F.get(listed, 0)), _number(F.get(listed, 1))), _positive(_number(_first(v, "$.width", "$.w")), _number(_first(v, "$.height", "$.h"))))


def page_size(v: Column, info: Column, i: Column) -> Column:
    """(w, h) of a page: the recognised part's sizes before the page's, then the file's data, by position."""
    found = []
    for base in (_pruned(v), v):
        found.append(_pair(_first(base, "$.page_size", "$.pageSize", "$.input_size")))
        found.append(_positive(_number(_first(base, "$.page_width", "$.pageWidth")), _number(_first(base, "$.page_height", "$.pageHeight"))))
    listed = _list(_at(info, "$.pages"))
    entry = F.when(listed.isNull(), info).when(F.size(listed) == 1, F.get(listed, 0)).otherwise(F.get(listed, i))
    found.append(_positive(_number(_at(entry, "$.width")), _number(_at(entry, "$.height"))))
    return F.coalesce(*found)


def _bbox(v: Column) -> Column:
    corners = lambda v: F.array(*[_number(_first(v, f"$.{a}", f"$.{b}")) for a, b in (("x0", "x_min"), ("y0", "y_min"), ("x1", "x_max"), ("y1", "y_max"))])
    four = lambda v: X.let(F.transform(_list(v), _number), lambda listed: F.when(F.size(listed) == 4, listed).when(listed.isNull(), corners(v)))
    return X.let(X.let(v, four), lambda four: F.when(~F.exists(four, lambda x: x.isNull()), four))


def _polygon(v: Column) -> Column:
    """Points of a list of pairs of numbers, or of a flat list of numbers of even length."""
    nested = lambda pairs: F.transform(pairs, lambda p: F.struct(_number(F.get(p, 0)).alias("x"), _number(F.get(p, 1)).alias("y")))
    all_pairs = lambda pairs: F.forall(pairs, lambda p: F.coalesce(F.size(p) == 2, F.lit(False)))
    sound = lambda ps: F.when(~F.exists(ps, lambda p: p["x"].isNull() | p["y"].isNull()), ps)
    flat = lambda listed: X.let(F.transform(listed, _number), lambda numbers: F.when(~F.exists(numbers, lambda x: x.isNull()), L.points(numbers)))
    either = lambda listed: X.let(F.transform(listed, _list), lambda pairs: F.when(all_pairs(pairs), X.let(nested(pairs), sound)).otherwise(flat(listed)))
    return X.let(_list(v), lambda listed: F.when(F.size(listed) > 0, either(listed)))


def _order(v: Column) -> Column:
    """A whole number from 0 to what 32 bits hold; null for anything else."""
    n = F.when(F.schema_of_variant(v) == "BIGINT", _at(v, "$", "long"))
    return F.when(n.between(0, MAX_ORDER), n)


def blocks(pages: DataFrame) -> DataFrame:
    """(doc_id, page, pos, label, text, x0, y0, x1, y1, ord, polygon, image_ref) of read_json's rows, ordered blocks first.

    A page's blocks are its parsing list, or else its layout results. Blocks without label, text, place and polygon are
    left out.
    """
    v = F.col("v")
    listed = F.coalesce(_list(F.coalesce(_at(_pruned(v), "$.parsing_res_list"), _at(v, "$.parsing_res_list"))), _layout_results(v))
    rows = pages.select("doc_id", "page", F.posexplode_outer(listed).alias("p", "b")).filter("p is not null")
    # An object is gone through once for all its keys. Generated columns, so that nothing below repeats them.
    rows = rows.select("doc_id", "page", "p", F.explode(F.array(_at(F.col("b"), "$", BLOCK))).alias("b")).filter("b is not null")
    first = lambda *keys: F.coalesce(*[F.col("b")[k] for k in keys])
    written = _text(F.col("b.markdown.text"))
    label = F.coalesce(_text(first("block_label", "blockLabel")), F.when(written.isNotNull(), "text"), F.lit(""))
    text = F.coalesce(_text(first("block_content", "blockContent")), written, F.lit(""))
    said = F.struct(
        label.alias("label"), text.alias("text"), F.coalesce(_bbox(first("block_bbox", "blockBbox")), F.array(*[F.lit(0.0)] * 4)).alias("bbox"),
        _order(first("block_order", "blockOrder")).alias("ord"), _polygon(first("block_polygon_points", "blockPolygonPoints")).alias("polygon"), _text(first("block_image", "blockImage")).alias("image"),
    )
    rows = rows.select("doc_id", "page", "p", F.explode(F.array(said)).alias("s"))
    rows = rows.select("doc_id", "page", "p", "s.*")
    empty = (F.col("label") == "") & ~X.not_blank(F.col("text")) & ~F.exists("bbox", lambda x: x != 0) & F.col("polygon").isNull()
    pos = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(F.col("ord").asc_nulls_last(), "p")) - 1
    named = [F.get("bbox", i).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]
    return rows.filter(~empty).withColumn("pos", pos).select("doc_id", "page", "pos", "label", "text", *named, "ord", "polygon", F.coalesce("image", X.img_src(F.col("text"))).alias("image_ref"))


def sizes(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, page, page_w, page_h, approximate) of each page, by its own size or the extent of its document's blocks."""
    reach = lambda c, axis: F.max(F.greatest(F.lit(0.0), F.col(f"{axis}1"), F.coalesce(F.array_max(F.transform("polygon", lambda p: p[axis])), F.lit(0.0)))).alias(c)
    extent = found.groupBy("doc_id", "page").agg(reach("ext_w", "x"), reach("ext_h", "y"))
    known = pages.select("doc_id", "page", page_size(F.col("v"), F.col("info"), F.col("i")).alias("s")).select("doc_id", "page", F.col("s.w").alias("width"), F.col("s.h").alias("height"))
    whole = known.join(extent, ["doc_id", "page"], "left").fillna(0.0, ["ext_w", "ext_h"])
    return R.resolved_sizes(whole, "doc_id").select("doc_id", "page", "page_w", "page_h", "approximate")


def _given_text(v: Column) -> tuple[Column, Column]:
    """A page's Markdown, and that of its layout results without blank parts, null if nothing is left."""
    whole = _text(_at(F.coalesce(_at(_pruned(v), "$.markdown"), _at(v, "$.markdown")), "$.text"))
    parts = F.filter(F.transform(F.transform(_layout_results(v), lambda x: _text(_at(x, "$.markdown.text"))), X.trim_ws), lambda t: t != "")
    inner = F.array_join(parts, "\n\n")
    return whole, F.when(inner != "", inner)


def page_texts(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, page, text): a page's Markdown, even if it is empty, or that of its layout results, or its blocks' texts."""
    given = F.coalesce(*_given_text(F.col("v")))
    part = F.when(X.not_blank(F.col("text")), F.struct("pos", F.col("text").alias("t")))
    made = found.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["t"]), "\n\n").alias("made"))
    return pages.select("doc_id", "page", given.alias("given")).join(made, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("given", "made", F.lit("")).alias("text"))


def preflight(pages: DataFrame, found: DataFrame) -> DataFrame:
    """One report a document: counts, labels with their counts, what is there, pages whose size is inferred, and warnings."""
    found = store(found, "layout-blocks")  # read for counts, labels and sizes
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    v = F.col("v")
    listed = _list(F.coalesce(_at(_pruned(v), "$.parsing_res_list"), _at(v, "$.parsing_res_list"))).isNotNull()
    pictures = _filled(_at(F.coalesce(_at(_pruned(v), "$.markdown"), _at(v, "$.markdown")), "$.images")) | F.coalesce(F.exists(_layout_results(v), lambda x: _filled(_at(x, "$.markdown.images"))), F.lit(False))
    whole, inner = _given_text(v)
    counted = pages.groupBy("doc_id").agg(
        F.count("*").alias("pages"), has(listed).alias("has_parsing_results"), has((whole != "") | inner.isNotNull()).alias("has_markdown"), has(pictures).alias("has_images"), has(_filled(_first(v, "$.outputImages", "$.output_images"))).alias("has_output_images")
    )
    placed = F.greatest(*[F.abs(c) for c in ("x0", "y0", "x1", "y1")]) > 0
    totals = found.groupBy("doc_id").agg(F.count("*").alias("blocks"), has(placed).alias("has_block_bbox"), has(F.col("ord").isNotNull()).alias("has_block_order"), has(F.col("polygon").isNotNull()).alias("has_polygon_points"))
    labels = found.groupBy("doc_id", "label").count().groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "count")))).alias("label_counts"))
    estimated = sizes(pages, found).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.when(F.col("approximate"), F.col("page")))).alias("estimated_pages"))
    out = counted.join(model_settings(pages), "doc_id", "left").join(totals, "doc_id", "left").join(labels, "doc_id", "left").join(estimated, "doc_id", "left").fillna(0, ["blocks"]).fillna(False, ["has_block_bbox", "has_block_order", "has_polygon_points"])
    out = out.withColumn("ignore_labels", F.coalesce("ignore_labels", F.array().cast("array<string>")))
    no = lambda c, name: F.when(~F.col(c), name)
    told = [no("has_parsing_results", "no_parsing_results"), no("has_block_bbox", "no_block_bbox"), no("has_block_order", "no_block_order"), no("has_polygon_points", "no_polygon_points"), F.when(~F.col("has_markdown") & ~F.col("has_parsing_results"), "no_text"), F.when(F.size("estimated_pages") > 0, "estimated_sizes")]
    return out.withColumn("warnings", F.filter(F.array(*told), lambda x: x.isNotNull()))
