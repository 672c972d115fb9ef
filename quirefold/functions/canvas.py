"""Canvas columns: projection, visibility, fitting, drawn rectangles, render scale, article colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirefold.functions import layout as L

#: Margin of a fitted page, least side of a drawn block on screen, zoom limits in per cent.
FIT, LEAST_SIDE, ZOOM = 0.94, 6, (10, 800)
#: Colours with a slot of their own, the hue after them and the step of the wheel.
SLOTS, ANCHOR_HUE, GOLDEN_ANGLE = 10, 220.0, 137.508


def projected(x: Column, y: Column, w: Column, h: Column, scale: Column, pan_x: Column, pan_y: Column) -> dict[str, Column]:
    """A canvas rectangle on screen."""
    return {"left": x * scale + pan_x, "top": y * scale + pan_y, "right": (x + w) * scale + pan_x, "bottom": (y + h) * scale + pan_y}


def fully_visible(rect: dict[str, Column], width: Column, height: Column) -> Column:
    return (rect["left"] >= 0) & (rect["top"] >= 0) & (rect["right"] <= width) & (rect["bottom"] <= height)


def centring_pan(x: Column, y: Column, w: Column, h: Column, scale: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """The shift that puts a rectangle's centre into the middle, at the zoom there is."""
    return width / 2 - (x + w / 2) * scale, height / 2 - (y + h / 2) * scale


def fitted(image_w: Column, image_h: Column, width: Column, height: Column, zoom: tuple[int, int] = ZOOM) -> tuple[Column, Column, Column]:
    """(per cent, shift x, shift y) that show a whole image with a margin."""
    percent = F.least(F.lit(zoom[1]), F.greatest(F.lit(zoom[0]), F.floor(F.least(width / image_w, height / image_h) * FIT * 100 + 0.5)))
    return percent, (width - image_w * (percent / 100)) / 2, (height - image_h * (percent / 100)) / 2


def drawn(x0: Column, y0: Column, x1: Column, y1: Column, scale: Column) -> Column:
    """(x, y, w, h) of a rectangle drawn between two points; null if a side is too small on screen. A scale of 0 counts as 1."""
    w, h = F.abs(x1 - x0), F.abs(y1 - y0)
    k = F.when(F.coalesce(scale, F.lit(0)) == 0, 1).otherwise(scale)
    rect = F.struct(F.least(x0, x1).alias("x"), F.least(y0, y1).alias("y"), w.alias("w"), h.alias("h"))
    return F.when((w * k >= LEAST_SIDE) & (h * k >= LEAST_SIDE), rect)


def render_scale(width: Column, height: Column, dpi: Column, most: Column) -> Column:
    """Pixels a point at a resolution, less where the long edge would be longer than `most` (null: no limit)."""
    scale, edge = dpi / 72.0, F.greatest(width, height)
    return F.when(most.isNotNull() & (edge > 0), F.least(scale, most / edge)).otherwise(scale)


def article_colour(number: Column, dark: bool = False) -> Column:
    """A slot's name for the first articles; hues a golden angle apart for the others."""
    n = F.greatest(F.lit(1), F.coalesce(number.cast("long"), F.lit(1)))
    hue = F.pmod(F.lit(ANCHOR_HUE) + (n - 1) * F.lit(GOLDEN_ANGLE), F.lit(360.0))
    sat, light = (26, 65) if dark else (18, 42)
    return F.when(n <= SLOTS, F.concat(F.lit("--article-"), n.cast("string"))).otherwise(F.concat(F.format_string("%.1f", hue), F.lit(f" {sat}% {light}%")))


def overlay(polygon: Column, x0: Column, y0: Column, x1: Column, y1: Column, mapping: Column) -> Column:
    """(points, rect): a block on the canvas, by its polygon if it has one, else by its box; null without a mapping.

    polygon: points (x, y); mapping: (sx, sy). rect is what has to be in sight.
    """
    points = L.scaled_polygon(polygon, mapping["sx"], mapping["sy"])
    box = F.struct((F.least(x0, x1) * mapping["sx"]).alias("x"), (F.least(y0, y1) * mapping["sy"]).alias("y"), (F.abs(x1 - x0) * mapping["sx"]).alias("width"), (F.abs(y1 - y0) * mapping["sy"]).alias("height"))
    return F.when(mapping.isNotNull(), F.struct(points.alias("points"), F.coalesce(L.bounds(points), box).alias("rect")))


def rgba_fault(width: Column, height: Column, size: Column) -> Column:
    """What is wrong with a raw picture of four bytes a pixel: dimensions, length, or nothing."""
    return F.when((width <= 0) | (height <= 0), "dimensions").when(size != width.cast("long") * height.cast("long") * 4, "length")


def framed(width: Column, height: Column, data: Column) -> Column:
    """Bytes behind width and height as unsigned 32-bit numbers, the lowest byte first."""
    little = lambda n: F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(4)]))
    return F.concat(little(width.cast("long")), little(height.cast("long")), data)


def unframed(data: Column) -> Column:
    """(width, height, data) of framed bytes; null for fewer than eight."""
    little = lambda at: F.conv(F.hex(F.concat(*[F.substring(data, at + k, 1) for k in (3, 2, 1, 0)])), 16, 10).cast("long")
    return F.when(F.octet_length(data) >= 8, F.struct(little(1).alias("width"), little(5).alias("height"), F.substring(data, 9, 2**31 - 1).alias("data")))
