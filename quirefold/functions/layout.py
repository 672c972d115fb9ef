"""Layout columns: block roles, reading rules, running headers, page geometry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirefold.functions.text import let

#: Labels of each role, exact ones; fixed values.
ROLES = {
    "DocTitle": ("doc_title",),
    "Heading": ("paragraph_title", "title"),
    "FigureCaption": ("figure_title", "chart_title", "table_title"),
    "Header": ("header", "doc_header", "header_image"),
    "Footer": ("footer", "doc_footer", "footer_image"),
    "PageNumber": ("number", "page_number", "page_no", "page_num"),
    "Aside": ("aside_text", "aside"),
}
TOP, BOTTOM, LOW, LEFT, RIGHT, NARROW, TALL = 0.12, 0.88, 0.10, 0.13, 0.87, 0.12, 0.50
INFERRED_MARGIN, MAPPING_TOLERANCE, RECT_PADDING = 1.02, 0.02, 0.02


@dataclass(frozen=True)
class ReadingOptions:
    include_header: bool = False
    include_footer: bool = False
    include_page_number: bool = True
    include_aside_text: bool = False
    include_footnote: bool = True
    include_tables: bool = True


def role(label: Column) -> Column:
    name = F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))
    out = F.when(F.contains(name, F.lit("footnote")), "Footnote").when(F.contains(name, F.lit("table")), "Table").when(F.contains(name, F.lit("image")) | (name == "figure"), "Image").otherwise("Body")
    for kind, labels in reversed(ROLES.items()):
        out = F.when(name.isin(*labels), kind).otherwise(out)
    return out


def gate(label: Column) -> Column:
    """The option that decides about a label, if one does."""
    kind = role(label)
    return F.when(kind.isin("Header", "Footer", "PageNumber", "Aside", "Footnote"), kind)


def included(kind: Column, options: ReadingOptions = ReadingOptions()) -> Column:
    gates = {"Header": options.include_header, "Footer": options.include_footer, "Aside": options.include_aside_text, "Footnote": options.include_footnote, "Table": options.include_tables, "PageNumber": False}
    out = F.lit(True)
    for name, on in gates.items():
        out = F.when(kind == name, F.lit(on)).otherwise(out)
    return out


def furniture_kind(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Footer or Header for a block that lies where running lines are printed; null elsewhere."""
    w, h = F.greatest(width, F.lit(1.0)), F.greatest(height, F.lit(1.0))
    left, right, top, bottom = F.least(x0, x1), F.greatest(x0, x1), F.least(y0, y1), F.greatest(y0, y1)
    low = (bottom - top) <= h * LOW
    side = ((left <= w * LEFT) | (right >= w * RIGHT)) & ((right - left) <= w * NARROW) & ((bottom - top) <= h * TALL)
    return F.when((bottom >= h * BOTTOM) & low, "Footer").when(((top <= h * TOP) & low) | side, "Header")


def canvas_mapping(layout_w: Column, layout_h: Column, canvas_w: Column, canvas_h: Column, approximate: Column) -> Column:
    """(sx, sy) from layout to canvas; null where sizes aren't positive or measured proportions don't agree."""
    valid = (layout_w > 0) & (layout_h > 0) & (canvas_w > 0) & (canvas_h > 0)
    sx, sy = canvas_w / layout_w, canvas_h / layout_h
    same = F.least(F.greatest(canvas_w, canvas_h) / F.greatest(layout_w, layout_h), F.least(canvas_w, canvas_h) / F.least(layout_w, layout_h))
    measured = F.when(F.abs(sx / sy - 1) <= MAPPING_TOLERANCE, F.struct(sx.alias("sx"), sy.alias("sy")))
    return F.when(valid, F.when(approximate, F.struct(same.alias("sx"), same.alias("sy"))).otherwise(measured))


def bounds(polygon: Column) -> Column:
    """The rectangle around a list of (x, y) points; null for fewer than two."""

    def around(xs: Column, ys: Column) -> Column:
        return F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("width"), (F.array_max(ys) - F.array_min(ys)).alias("height"))

    sides = lambda p: F.struct(F.transform(p, lambda q: q["x"]).alias("xs"), F.transform(p, lambda q: q["y"]).alias("ys"))
    return let(polygon, lambda p: F.when(F.size(p) >= 2, let(sides(p), lambda s: around(s["xs"], s["ys"]))))


def points(flat: Column) -> Column:
    """A flat list x, y, x, y... of even length as points; null for others."""

    def pairs(a: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), (F.size(a) / 2 - 1).cast("int")), lambda i: F.struct(F.get(a, i * 2).alias("x"), F.get(a, i * 2 + 1).alias("y")))

    return let(flat, lambda a: F.when((F.size(a) % 2 == 0) & (F.size(a) > 0), pairs(a)))


def clamp_crop(x: Column, y: Column, w: Column, h: Column, image_w: Column, image_h: Column) -> dict[str, Column]:
    """Whole pixels of a rectangle inside an image."""
    left, top = F.greatest(F.lit(0), F.least(F.floor(x), image_w)), F.greatest(F.lit(0), F.least(F.floor(y), image_h))
    right, bottom = F.least(image_w, F.ceil(x + w)), F.least(image_h, F.ceil(y + h))
    return {"left": left, "top": top, "crop_w": F.greatest(F.lit(0), right - left), "crop_h": F.greatest(F.lit(0), bottom - top)}


def fit_long_edge(w: Column, h: Column, most: int) -> tuple[Column, Column]:
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(w, h))
    return tuple(F.greatest(F.lit(1), F.round(side * scale).cast("long")) for side in (w, h))


def scaled_box(x0: Column, y0: Column, x1: Column, y1: Column, sx: Column, sy: Column) -> tuple[Column, Column, Column, Column]:
    """A box with its corners put right, scaled by axis."""
    return F.least(x0, x1) * sx, F.least(y0, y1) * sy, F.greatest(x0, x1) * sx, F.greatest(y0, y1) * sy


def scaled_polygon(polygon: Column, sx: Column, sy: Column) -> Column:
    """Points scaled by axis; null for fewer than two."""
    moved = F.transform(polygon, lambda p: F.struct((p["x"] * sx).alias("x"), (p["y"] * sy).alias("y")))
    return F.when(F.size(polygon) >= 2, moved)


def crop_block(x: Column, y: Column, w: Column, h: Column, scale: Column, image_w: int, image_h: int) -> tuple[Column, Column, Column, Column]:
    """Whole pixels (left, top, width, height) of a scaled block inside an image, of one pixel at least."""
    px = lambda c: F.round(c * scale).cast("long")
    left, top = F.greatest(F.lit(0), F.least(px(x), F.lit(image_w - 1))), F.greatest(F.lit(0), F.least(px(y), F.lit(image_h - 1)))
    return left, top, F.greatest(F.lit(1), F.least(px(w), F.lit(image_w) - left)), F.greatest(F.lit(1), F.least(px(h), F.lit(image_h) - top))
