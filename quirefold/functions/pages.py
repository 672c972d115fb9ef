"""Page ranges and chunk plans as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirefold.functions.text import trim_ws

CHUNK_BYTES, CHUNK_PAGES = 40 << 20, 800
DIRECT_BYTES, DIRECT_PAGES = 50 << 20, 1000


def _tokens(raw: Column) -> Column:
    return F.transform(F.split(trim_ws(raw), ",", -1), trim_ws)


def _ends(token: Column, group: int) -> Column:
    pair = F.regexp_extract(token, r"^(\d+)\s*-\s*(\d+)$", group)
    return F.when(pair != "", pair).otherwise(F.regexp_extract(token, r"^\d+$", 0)).try_cast("long")


def token_error(token: Column, total: Column) -> Column:
    first, last = _ends(token, 1), _ends(token, 2)
    shaped = token.rlike(r"^\d+(\s*-\s*\d+)?$")
    return (
        F.when(token == "", "emptySegment")
        .when(~shaped, F.when(token.rlike(r"^-\d+|\s-\d+"), "negative").otherwise("format"))
        .when((first == 0) | (last == 0), "zero")
        .when(last < first, "reversed")
        .when((first > total) | (last > total), "exceeds")
    )


def range_error(raw: Column, total: Column) -> Column:
    """The kind of the first error of a page range; null for a valid one."""
    tokens = F.filter(F.transform(_tokens(raw), lambda t: token_error(t, total)), lambda e: e.isNotNull())
    return F.when(total < 1, "totalInvalid").when(trim_ws(raw) == "", F.lit(None)).when(trim_ws(raw).rlike(r"[^0-9,\-\s]"), "charset").otherwise(F.get(tokens, 0))


def range_pages(raw: Column, total: Column) -> Column:
    """Sorted distinct pages of a valid range; all of them for a blank one; null for a wrong one."""
    each = F.flatten(F.transform(_tokens(raw), lambda t: F.sequence(_ends(t, 1), _ends(t, 2))))
    pages = F.when(trim_ws(raw) == "", F.sequence(F.lit(1).cast("long"), total)).otherwise(F.array_sort(F.array_distinct(each)))
    return F.when(range_error(raw, total).isNull(), pages)


def chunk_size(file_bytes: Column, file_pages: Column, target: int = CHUNK_BYTES, most: int = CHUNK_PAGES) -> Column:
    """Pages of a chunk by the mean size of a page."""
    mean = F.when(file_pages == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(file_bytes / file_pages)))
    by_size = F.when(mean == 0, most).otherwise(F.greatest(F.lit(1), F.floor(F.lit(target) / mean)))
    return F.greatest(F.lit(1), F.least(by_size, F.lit(most))).cast("long")


def poll_seconds(pages: Column) -> Column:
    return F.least(F.greatest(pages * 2, F.lit(300)), F.lit(2400))


def is_direct(file_bytes: Column, file_pages: Column) -> Column:
    return (file_bytes <= DIRECT_BYTES) & (file_pages <= DIRECT_PAGES)


def range_label(ranges: Column, total: Column) -> Column:
    """all of n for a list of stretches that is one stretch of every page; else the list."""
    full = F.when(total == 1, "1").otherwise(F.concat(F.lit("1-"), total.cast("string")))
    return F.when(ranges == full, F.concat(F.lit("all of "), total.cast("string"))).otherwise(F.concat(F.lit("pages "), ranges))
