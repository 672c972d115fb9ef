"""Reading text on pages: greedy line wrap by estimated widths, and pagination.

Widths are counted in hundredths of an em and heights in thousandths of a point, so that sums are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import text as X
from quirefold.sources.shared import store

PAGE_W, PAGE_H, MARGIN_X, MARGIN_TOP, MARGIN_BOTTOM = 595.28, 841.89, 56.0, 60.0, 56.0
#: Ranges of full-width characters; fixed values.
FULL_WIDTH = ((0x1100, 0x11FF), (0x2E80, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0xFF00, 0xFFEF), (0x20000, 0x2FFFF))
#: Size, line height, gap before, gap after, indent in sizes, of each role; fixed values.
STYLES = {
    "DocTitle": (17.0, 1.3, 18.0, 12.0, 0),
    "Heading": (13.5, 1.3, 13.0, 5.0, 0),
    "FigureCaption": (10.0, 1.35, 4.0, 6.0, 0),
    "Body": (10.5, 1.5, 0.0, 6.0, 2),
    "Header": (10.5, 1.5, 0.0, 6.0, 2),
    "Footer": (10.5, 1.5, 0.0, 6.0, 2),
    "Footnote": (9.0, 1.4, 2.0, 4.0, 0),
    "Aside": (9.0, 1.4, 2.0, 4.0, 0),
    "Table": (9.5, 1.4, 4.0, 6.0, 0),
    "Image": (9.5, 1.4, 4.0, 6.0, 0),
    "PageNumber": (9.0, 1.3, 14.0, 8.0, 0),
}
RUN = 1024  # paragraphs that are put together before runs of them are
CHARS = 1 << 20  # characters that are wrapped at once
LINES = 1 << 18  # lines that are placed at once
PAGES_A_SEGMENT = 64  # pages' heights of a document that one task looks through


def limit(width: float, size: float) -> int:
    """Hundredths of an em of a size that fit into a width."""
    return int(width * 100 / size + 1e-6)


@cache
def _widths() -> np.ndarray:
    """Hundredths of an em that characters take, by code point."""
    out = np.full(0x110000, 82, np.int16)
    out[:128] = 52
    out[[ord(c) for c in " \t\n\f\r"]] = 30
    for a, b in FULL_WIDTH:
        out[a : b + 1] = 100
    return out


def _starts(said: str, begin: np.ndarray, end: np.ndarray, first: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Where pieces start in source lines that stand one behind the other, for all lines at once: by sums of widths, each
    piece's end is the last place that its limit reaches."""
    upto = np.concatenate([[0], np.cumsum(_widths()[np.frombuffer(said.encode("utf-32-le"), "<u4")], dtype=np.int64)])
    at, room, found = begin, first, []
    while len(at):
        found.append(at)
        reached = np.maximum(np.searchsorted(upto, upto[at] + room, "right") - 1, at + 1)
        more = reached < end
        at, end, full = reached[more], end[more], full[more]
        room = full
    return np.sort(np.concatenate(found)) if found else begin


def _pieces(texts: list[str | None], firsts: np.ndarray, fulls: np.ndarray) -> list[list[str]]:
    """The lines of each text, by its limits."""
    kept = [[line for line in (t or "").split("\n") if line.strip(X.BLANKS)] for t in texts]
    of = np.array([len(lines) for lines in kept], np.int64)
    sizes = np.array([len(line) for lines in kept for line in lines], np.int64)
    said = "".join(line for lines in kept for line in lines)
    end = np.cumsum(sizes, dtype=np.int64)
    limits = np.repeat(fulls, of)
    begins = np.cumsum(of) - of
    first = limits.copy()
    first[begins[of > 0]] = firsts[of > 0]
    starts = _starts(said, end - sizes, end, first, limits)
    pieces = [said[a:b] for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(said)])]
    # Where each text's pieces begin among all of them.
    chars = np.concatenate([[0], end])
    cut = np.searchsorted(starts, chars[np.append(begins, len(sizes))], "left").tolist()
    return [pieces[a:b] or [""] for a, b in zip(cut, cut[1:])]


def _wrapped(texts: pa.Array, firsts: pa.Array, fulls: pa.Array) -> pa.Array:
    """The lines of each text of a batch; texts are put together up to a bounded number of characters."""
    said, first, full = texts.to_pylist(), np.asarray(firsts, np.int64), np.asarray(fulls, np.int64)
    out: list[list[str]] = []
    size = at = 0
    for i, t in enumerate(said):
        size += len(t or "")
        if size >= CHARS or i + 1 == len(said):
            out += _pieces(said[at : i + 1], first[at : i + 1], full[at : i + 1])
            size, at = 0, i + 1
    return pa.array(out, pa.list_(pa.string()))


def wrap(text: Column, first: Column, full: Column) -> Column:
    """Lines of at most `full` hundredths of an em; `first` holds for the very first. Blank source lines go; nothing, or null, gives ['']."""
    return F.arrow_udf(_wrapped, "array<string>")(text, first, full)


def wrapped(docs: DataFrame, size: float, first_width: float, width: float) -> DataFrame:
    """(doc_id, n_lines, longest, lines) of each text."""
    lines = docs.select("doc_id", wrap(F.col("text"), F.lit(limit(first_width, size)), F.lit(limit(width, size))).alias("l"))
    return lines.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.array_max(F.transform("l", F.length)).cast("long").alias("longest"), F.array_join("l", "\n").alias("lines"))


def milli(points: float) -> int:
    return round(points * 1000)


def measures(font_scale: float = 1.0, margin_scale: float = 1.0) -> dict[str, dict[str, int]]:
    """For each role the limits of its lines in hundredths of an em, and its step and gaps in thousandths of a point."""
    content = max(72.0, PAGE_W - 2 * MARGIN_X * margin_scale)
    out = {}
    for role, (size, height, before, after, indent) in STYLES.items():
        size *= font_scale
        out[role] = {"first": limit(max(size, content - indent * size), size), "full": limit(content, size), "step": milli(size * height), "before": milli(before), "after": milli(after)}
    return out


def _depths(paragraphs: DataFrame) -> DataFrame:
    """paragraphs with start: what stands above each in its document, by sums of runs and sums inside a run."""
    total = F.col("before") + F.col("step") * F.size("lines") + F.col("after")
    rows = paragraphs.withColumn("run", F.floor(F.col("seq") / RUN)).withColumn("total", total)
    above = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("doc", "run").agg(F.sum("total").alias("of_run"))
    runs = runs.select(F.col("doc").alias("_doc"), F.col("run").alias("_run"), F.coalesce(F.sum("of_run").over(above("doc").orderBy("run")), F.lit(0)).alias("above"))
    inside = rows.withColumn("inside", F.coalesce(F.sum("total").over(above("doc", "run").orderBy("seq")), F.lit(0)))
    return inside.join(runs, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("run") == F.col("_run"))).withColumn("start", F.col("above") + F.col("inside")).drop("run", "total", "inside", "above", "_doc", "_run")


def next_pages(lines: DataFrame, height: int, gap: int) -> DataFrame:
    """(doc, depth, to): for each line the first line that no page beginning with it holds, where there is one.

    lines (doc, depth, step): depth is where a line ends below its document's top; steps and gaps between two lines
    come to at most `gap`. A page holds a line if no more than `height` lies between its first line's top and the
    line's end. A document's lines are looked through in segments of bounded height, each with the lines that come
    right behind it, so a long document is many tasks.
    """
    segment = PAGES_A_SEGMENT * max(height, gap)
    end = F.greatest(F.col("depth"), F.col("depth") - F.col("step") + height)
    asked = lines.select("doc", end.alias("at"), F.col("depth").alias("asks"), F.lit(None).cast("long").alias("line"), F.floor(end / segment).alias("part"))
    own = F.floor(F.col("depth") / segment)
    parts = F.when(F.pmod("depth", F.lit(segment)) < gap, F.array(own, own - 1)).otherwise(F.array(own))
    there = lines.select("doc", F.col("depth").alias("at"), F.lit(None).cast("long").alias("asks"), F.col("depth").alias("line"), F.explode(parts).alias("part"))
    upwards = Window.partitionBy("doc", "part").orderBy(F.desc("at"), F.col("line").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = asked.unionByName(there).withColumn("to", F.last("line", ignorenulls=True).over(upwards))
    return found.filter("asks is not null and to is not null").select("doc", F.col("asks").alias("depth"), "to")


def page_starts(lines: DataFrame, height: int, gap: int) -> DataFrame:
    """(doc, depth) of the lines that begin pages: what is reached from each document's first line, by pointer doubling.

    Every round doubles the pages that are known and the pages that a pointer leaps over; documents with all pages
    known drop out, since pointers beyond the last page are gone.
    """
    leap = store(next_pages(lines, height, gap), "leaps")
    known = store(lines.groupBy("doc").agg(F.min("depth").alias("depth")), "page-starts")
    while not leap.isEmpty():
        known = store(known.unionByName(known.join(leap, ["doc", "depth"]).select("doc", F.col("to").alias("depth"))), "page-starts")
        onwards = leap.select("doc", F.col("depth").alias("to"), F.col("to").alias("beyond"))
        leap = store(leap.join(onwards, ["doc", "to"]).select("doc", "depth", F.col("beyond").alias("to")), "leaps")
    return known


def _along(height: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of paragraphs, a document's behind each other in their order, with each line's page and place on it.

    Of what went before only the depth, the step and the number of the page's first line are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, kept = 0, (0, 0, 0)
        for batch in batches:
            upto = np.cumsum(np.asarray(batch.column("n"), np.int64))
            cuts = np.searchsorted(upto, np.arange(LINES, upto[-1] if len(upto) else 0, LINES)) + 1
            for part in (batch.slice(a, b - a) for a, b in pairwise(sorted({0, *cuts.tolist(), len(upto)}))):
                step, before, after, n = (np.asarray(part.column(c), np.int64) for c in ("step", "before", "after", "n"))
                pages, downs, base, kept = _placed(step, before, after, n, np.asarray(part.column("opens")), height, base, kept)
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (pages, downs)]
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("seq"), *lists], ["doc", "seq", "pages", "downs"])

    return run


def _placed(step: np.ndarray, before: np.ndarray, after: np.ndarray, n: np.ndarray, opens: np.ndarray, height: int, base: int, kept: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, int, tuple[int, int, int]]:
    """Of each line of paragraphs the page and how far below the page's top it ends; what the paragraphs behind them need."""
    total = before + step * n + after
    below = np.cumsum(total)
    ends = np.cumsum(n)
    lines = np.arange(ends[-1])
    steps = np.repeat(step, n)
    depth = np.repeat(base + below - total + before, n) + steps * (lines - np.repeat(ends - n, n) + 1)
    begins = (ends - n)[opens]
    # The page's first lines: a document's first one, then the first that the page before doesn't hold, for all documents at once.
    first = np.searchsorted(depth, max(kept[0], kept[0] - kept[1] + height), "right") if not opens[0] else len(lines)
    at, end = np.append(begins, first), np.append(np.append(begins[1:], len(lines)) if len(begins) else begins, begins[0] if len(begins) else len(lines))
    found = [begins[:0]]
    at, end = at[at < end], end[at < end]
    while len(at):
        found.append(at)
        at = np.searchsorted(depth, np.maximum(depth[at], depth[at] - steps[at] + height), "right")
        at, end = at[at < end], end[at < end]
    starts = np.sort(np.concatenate(found))
    page = np.searchsorted(starts, lines, "right")  # 0 as long as the page from before goes on
    of = np.searchsorted(begins, lines, "right")
    before_it = np.append(-kept[2], np.searchsorted(starts, begins))[of]
    tops, firsts = np.append(kept[0], depth[starts])[page], np.append(kept[1], steps[starts])[page]
    numbers = page - before_it
    return numbers, depth - tops + firsts, base + int(below[-1]), (int(tops[-1]), int(firsts[-1]), int(numbers[-1]))


def _in_one_pass(paragraphs: DataFrame, height: int) -> DataFrame:
    """Placed lines of documents of bounded height: numbers alone are sorted and gone through, the lines join them once."""
    opens = F.row_number().over(Window.partitionBy("doc").orderBy("seq")) == 1
    numbers = paragraphs.select("doc", "seq", "step", "before", "after", F.col("n").cast("long").alias("n"), opens.alias("opens"))
    kind = paragraphs.schema["doc"].dataType.simpleString()
    places = numbers.mapInArrow(_along(height), f"doc {kind}, seq long, pages array<long>, downs array<long>")
    lines = paragraphs.join(places, ["doc", "seq"]).select("_id", "seq", F.posexplode(F.arrays_zip("lines", "pages", "downs")).alias("line_no", "l"))
    return lines.select("_id", F.col("l.pages").alias("page"), "seq", "line_no", F.col("l.downs").alias("down"), F.col("l.lines").alias("line"))


def _by_pointers(paragraphs: DataFrame, height: int, gap: int) -> DataFrame:
    """Placed lines of documents of any height, which are many tasks each."""
    lines = _depths(paragraphs).select("_id", "doc", "seq", "step", (F.col("start") + F.col("before")).alias("_top"), F.posexplode("lines").alias("line_no", "line"))
    lines = store(lines.withColumn("depth", F.col("_top") + F.col("step") * (F.col("line_no") + 1)).drop("_top"), "lines")
    starts = page_starts(lines.select("doc", "depth", "step"), height, gap).join(lines.select("doc", "depth", "step"), ["doc", "depth"])
    order = Window.partitionBy("doc").orderBy("depth")
    starts = starts.select("doc", F.col("depth").alias("from"), F.col("step").alias("first"), F.row_number().over(order).cast("long").alias("page"), F.lead("depth").over(order).alias("until"))
    band = F.floor(F.col("from") / height)
    starts = starts.withColumn("band", F.explode(F.array(band, band + 1)))
    here = lines.withColumn("band", F.floor(F.col("depth") / height)).join(starts, ["doc", "band"])
    here = here.filter((F.col("depth") >= F.col("from")) & (F.col("until").isNull() | (F.col("depth") < F.col("until"))))
    return here.select("_id", "page", "seq", "line_no", (F.col("depth") - F.col("from") + F.col("first")).alias("down"), "line")


def paginated(items: DataFrame, font_scale: float = 1.0, margin_scale: float = 1.0) -> DataFrame:
    """items (doc, seq, role, item) as placed lines (doc, page, seq, line_no, y, line).

    A page ends where a line would cross its bottom margin; there is no gap at its top. y is where a line ends, in
    points above the page's foot. Documents of up to PAGES_A_SEGMENT pages' heights are gone through in one pass, taller
    ones by pointers. Lines of an item count from 0; seq is a whole number that a document has once; other
    roles than those of STYLES are set as body; a null document is a document of its own; null items are empty lines.
    """
    top, bottom = milli(PAGE_H - MARGIN_TOP * margin_scale), milli(MARGIN_BOTTOM * margin_scale)
    height, style = top - bottom, measures(font_scale, margin_scale)
    gap = sum(max(m[k] for m in style.values()) for k in ("step", "before", "after"))
    cells = lambda m: F.struct(*[F.lit(v).cast("long").alias(k) for k, v in m.items()])
    styled = F.coalesce(F.try_element_at(F.create_map(*[x for role, m in style.items() for x in (F.lit(role), cells(m))]), F.coalesce("role", F.lit(""))), cells(style["Body"]))
    rows = items.select(F.col("doc").alias("_id"), F.struct("doc").alias("doc"), F.col("seq").cast("long").alias("seq"), styled.alias("m"), "item").select("_id", "doc", "seq", "m.*", "item")
    paragraphs = store(rows.select("_id", "doc", "seq", "step", "before", "after", wrap(F.col("item"), F.col("first").cast("int"), F.col("full").cast("int")).alias("lines")).withColumn("n", F.size("lines")), "paragraphs")
    total = F.col("before") + F.col("step") * F.col("n") + F.col("after")
    tall = store(paragraphs.groupBy("doc").agg(F.sum(total).alias("height")).filter(F.col("height") > PAGES_A_SEGMENT * max(height, gap)).select("doc"), "tall")
    if tall.isEmpty():
        here = _in_one_pass(paragraphs, height)
    else:
        here = _in_one_pass(paragraphs.join(tall, "doc", "left_anti"), height).unionByName(_by_pointers(paragraphs.join(tall, "doc", "left_semi"), height, gap))
    y = (F.lit(top) - F.col("down")) / F.lit(1000.0)
    return here.select(F.col("_id").alias("doc"), "page", "seq", F.col("line_no").cast("long").alias("line_no"), y.alias("y"), "line")
