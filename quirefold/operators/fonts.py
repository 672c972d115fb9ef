"""Glyphs that texts need and fonts have, as bitmaps of code points.

A set of glyphs is a row for each range of SPAN code points that it touches: (range, glyphs), glyphs a bitmap. However
long the texts are, a task passes on a few bitmaps for each group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions import text as X

#: Code points of one bitmap: what `bitmap_construct_agg` holds.
SPAN = 32768


def glyph_sets(rows: DataFrame, by: list[str], glyph: str = "glyph") -> DataFrame:
    """(by, range, glyphs) of rows with one glyph each; null and empty glyphs are none."""
    points = rows.filter(F.col(glyph) != "").select(*by, F.ascii(glyph).alias("_point"))
    return points.groupBy(*by, F.expr(f"_point div {SPAN}").alias("range")).agg(F.bitmap_construct_agg(F.col("_point") % SPAN).alias("glyphs"))


def required(texts: DataFrame, by: list[str]) -> DataFrame:
    """(by, range, glyphs): the characters of texts, whitespace apart. A text gives each of its characters once."""
    return glyph_sets(texts.select(*by, F.explode(F.array_distinct(F.split(X.delete_ws(F.col("text")), ""))).alias("glyph")), by)


def merged(sets: DataFrame, by: list[str]) -> DataFrame:
    """The union of the sets of a group, as of texts that came in several loads."""
    return sets.groupBy(*by, "range").agg(F.bitmap_or_agg("glyphs").alias("glyphs"))


def coverage(needed: DataFrame, fonts: DataFrame, by: list[str]) -> DataFrame:
    """(by, font, supported, missing): for each group the font with the most of its glyphs, of equals the first by rank.

    needed (by, range, glyphs), fonts (font, rank, range, glyphs). Groups of which no font has a glyph go.
    """
    total = needed.groupBy(*by).agg(F.sum(F.bitmap_count("glyphs")).alias("total"))
    both = needed.join(fonts.withColumnRenamed("glyphs", "_have"), "range").select(*by, "font", "rank", "range", F.explode(F.array("glyphs", "_have")).alias("glyphs"))
    common = both.groupBy(*by, "font", "rank", "range").agg(F.bitmap_count(F.bitmap_and_agg("glyphs")).alias("n"))
    hits = common.groupBy(*by, "font", "rank").agg(F.sum("n").alias("supported")).filter("supported > 0")
    best = hits.groupBy(*by).agg(F.max_by(F.struct("font", "supported"), F.struct("supported", -F.col("rank"))).alias("b"))
    return best.join(total, by).select(*by, "b.font", "b.supported", (F.col("total") - F.col("b.supported")).alias("missing"))


def _byte(bitmap: Column, at: Column) -> Column:
    return F.conv(F.hex(F.substring(bitmap, at, F.lit(1))), 16, 10).cast("int")


def glyphs_of(sets: DataFrame, by: list[str], beside: str | None = None) -> DataFrame:
    """(by, glyph): the characters of sets, without those of the bitmap `beside` (null: an empty one)."""
    at = F.sequence(F.lit(1), F.octet_length("glyphs"))
    used = sets.withColumn("_at", F.explode(F.filter(at, lambda i: F.substring(F.col("glyphs"), i, F.lit(1)) != F.lit(b"\0"))))
    bits = _byte(F.col("glyphs"), F.col("_at"))
    if beside:
        bits = bits.bitwiseAND(F.bitwise_not(F.coalesce(_byte(F.col(beside), F.col("_at")), F.lit(0))))
    ones = used.select(*by, "range", "_at", bits.alias("_bits")).withColumn("_bit", F.explode(F.sequence(F.lit(0), F.lit(7)))).filter(F.expr("getbit(_bits, _bit) = 1"))
    point = F.col("range") * SPAN + (F.col("_at") - 1) * 8 + F.col("_bit")
    return ones.select(*by, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32").alias("glyph"))


def missing(needed: DataFrame, chosen: DataFrame, fonts: DataFrame, by: list[str]) -> DataFrame:
    """(by, glyph): what the font chosen for a group lacks."""
    have = fonts.select("font", "range", F.col("glyphs").alias("_have"))
    return glyphs_of(needed.join(chosen.select(*by, "font"), by).join(have, ["font", "range"], "left"), by, "_have")
