"""Text columns: Unicode whitespace, Markdown and HTML clean-up, line repair, placeholders."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Entities are decoded in this order, so a doubly escaped sign is decoded once more; fixed values.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))
#: Sentences that scanning tools leave on pages; fixed values.
ARTEFACTS = ("Document generated by Anna's Archive around", "Images have been losslessly embedded.")
#: What (?U)\\s takes; Python's own whitespace holds some control characters more.
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SHORT_LINE = 4
SHOWN_REFERENCE = 80


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_ws(text: Column) -> Column:
    """Unicode whitespace off both ends; without a list of characters Spark's trim takes U+0020 alone."""
    return F.trim(text, F.lit(BLANKS))


def rtrim_ws(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def delete_ws(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s", "")


def collapse_ws(text: Column) -> Column:
    return F.regexp_replace(trim_ws(text), r"(?U)\s+", " ")


def not_blank(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def clean_line(line: Column) -> Column:
    """A line without heading and quote marks and without one pair of emphasis marks around it."""

    def unwrapped(bare: Column) -> Column:
        out = bare
        for mark in ("`", "*", "**", "***"):
            n = len(mark)
            wrapped = (F.octet_length(bare) >= 2 * n) & bare.startswith(mark) & bare.endswith(mark)
            out = F.when(wrapped, F.substring(bare, F.lit(n + 1), F.length(bare) - 2 * n)).otherwise(out)
        return out

    return let(F.regexp_replace(trim_ws(line), r"^[#>][#> ]*", ""), unwrapped)


def clean_block_text(text: Column) -> Column:
    return trim_ws(F.array_join(F.transform(lines(F.regexp_replace(text, "\r\n", "\n")), clean_line), "\n"))


def strip_html(text: Column) -> Column:
    """What stands outside all angle brackets, whitespace collapsed; brackets may nest.

    The fold runs over brackets and the stretches between them, not over characters.
    """
    tokens = F.regexp_extract_all(text, F.lit("[<>]|[^<>]+"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        depth = F.when(t == "<", s["depth"] + 1).when(t == ">", F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        out = F.when((t != "<") & (t != ">") & (s["depth"] == 0), F.concat(s["out"], F.array(t))).otherwise(s["out"])
        return F.struct(depth.alias("depth"), out.alias("out"))

    outside = F.when(text.rlike("[<>]"), F.array_join(F.aggregate(tokens, start, step, lambda s: s["out"]), "")).otherwise(text)
    return collapse_ws(outside)


def decode_entities(text: Column) -> Column:
    for code, sign in ENTITIES:
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def is_html_table(text: Column) -> Column:
    return F.lower(text).rlike(r"<(table|tr|td)")


def html_table_text(text: Column) -> Column:
    """Rows as lines and cells between bars: row and break tags become line ends, cell tags bars, other tags nothing.

    Cells are trimmed and empty cells and rows dropped, which also makes repeated bars and line ends harmless.
    """
    broken = F.regexp_replace(text, r"(?i)<\s*/?\s*(?:tr|br)(?:[\s/][^>]*)?>", "\n")
    barred = F.regexp_replace(broken, r"(?i)<\s*/?\s*t[dh](?:[\s/][^>]*)?>", "|")
    plain = decode_entities(F.regexp_replace(barred, "<[^>]*>", ""))
    cells = lambda row: F.filter(F.transform(F.split(row, r"\|"), trim_ws), lambda c: c != "")
    return F.array_join(F.filter(F.transform(lines(plain), lambda row: F.array_join(cells(row), " | ")), lambda row: row != ""), "\n")


def repair_short_lines(text: Column) -> Column:
    """Two lines or more of up to four characters each, as vertical print gives them, become one."""

    def joined(t: Column) -> Column:
        full = F.filter(F.transform(lines(t), trim_ws), lambda line: line != "")
        short = (F.size(full) >= 2) & F.forall(full, lambda line: F.length(line) <= SHORT_LINE)
        return F.when(short, F.array_join(full, "")).otherwise(t)

    return let(text, lambda t: F.when(F.instr(t, "\n") > 0, joined(t)).otherwise(t))


def furniture_key(text: Column) -> Column:
    """What a repeated block is told by: its cleaned text without whitespace, if that has 3 to 40 characters."""
    key = delete_ws(repair_short_lines(clean_block_text(strip_html(text))))
    return let(key, lambda k: F.when(F.length(k).between(3, 40), k))


def shown_reference(ref: Column) -> Column:
    """A picture's name: the last part of a URL without its query, cut at 80 characters; null for a blank one."""
    whole = trim_ws(ref)
    parts = F.filter(F.split(F.substring_index(whole, "?", 1), "/"), lambda p: p != "")
    name = F.when(F.instr(whole, "://") > 0, F.coalesce(F.try_element_at(parts, F.lit(-1)), whole)).otherwise(whole)
    cut = F.when(F.length(name) > SHOWN_REFERENCE, F.concat(F.substring(name, 1, SHOWN_REFERENCE - 1), F.lit("…"))).otherwise(name)
    return F.when(whole != "", cut)


def image_placeholder(ref: Column) -> Column:
    name = shown_reference(ref)
    return F.when(name.isNull(), F.lit("[image: not embedded]")).otherwise(F.concat(F.lit("[image: not embedded: "), name, F.lit("]")))


def img_src(text: Column) -> Column:
    """The source of the first picture tag, quoted or bare."""
    tag = r"(?is)<img\b[^>]*?\bsrc\s*=\s*"
    text = F.when(F.contains(text, F.lit("<")), text)
    parts = [F.regexp_extract(text, tag + q, 1) for q in (r'"([^"]*)"', r"'([^']*)'", r"([^\s\"'>]+)")]
    return F.coalesce(*[F.when(p != "", p) for p in parts])


def is_scanner_artefact(text: Column) -> Column:
    return text.rlike(r"(?U)\A\s*(?:" + "|".join(re.escape(a) for a in ARTEFACTS) + ")")  # looks at the beginning alone


def one_line(text: Column) -> Column:
    return F.array_join(F.filter(F.transform(lines(text), trim_ws), lambda line: line != ""), " ")


def json_array_in(text: Column) -> Column:
    """The JSON array in a reply: inside a code fence if there is one, from the first to the last square bracket."""
    whole = trim_ws(text)
    opened = F.regexp_replace(whole, r"^```(?:json)?[\r\n]*", "")
    inside = F.when(whole.startswith("```"), F.substring_index(opened, "```", 1)).otherwise(whole)
    found = F.regexp_extract(inside, r"(?s)\[.*\]", 0)
    return F.when(found != "", found)


SUGGESTIONS = "array<struct<before string, after string, category string, confidence double>>"


def suggestion_fault(reply: Column) -> Column:
    """Why a reply has no suggestions: empty, truncated (an array is opened only), prose, or an array of other things; null if it has."""
    found = json_array_in(reply)
    parsed = F.from_json(found, SUGGESTIONS, {"mode": "PERMISSIVE"})
    whole = parsed.isNotNull() & F.forall(F.coalesce(parsed, F.array().cast(SUGGESTIONS)), lambda x: x["before"].isNotNull() & x["after"].isNotNull())
    return F.when(found.isNull(), F.when(~not_blank(reply), "empty").when(F.contains(reply, F.lit("[")), "truncated").otherwise("prose")).when(~whole, "invalid")


def occurs_once(needle: Column, text: Column) -> Column:
    """Exactly one occurrence, overlapping ones counted."""
    at = F.position(needle, text)
    return (F.length(needle) > 0) & (at > 0) & (F.position(needle, text, at + 1) == 0)


def file_extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def safe_name(name: Column) -> Column:
    kept = F.translate(name, "/\\:\0", "____")
    return F.when(not_blank(kept), kept).otherwise("upload")


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


#: Extensions of files that can be opened; fixed values.
OPENED = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "dng", "pdf")


def open_paths(rows: DataFrame, by: list[str], order: str, folder: Column) -> DataFrame:
    """(by, path, place) of arguments (by, order, arg): no flags, absolute, of a known extension, each once where it came first.

    Whether a path is a file is for the reader to find out.
    """
    path = F.when(F.col("arg").startswith("/"), F.col("arg")).otherwise(F.concat(folder, F.lit("/"), F.col("arg")))
    found = rows.filter(~F.col("arg").startswith("-")).select(*by, path.alias("path"), order).filter(file_extension(F.col("path")).isin(*OPENED))
    first = found.groupBy(*by, "path").agg(F.min(order).alias("_first"))
    return first.select(*by, "path", F.row_number().over(Window.partitionBy(*by).orderBy("_first")).cast("long").alias("place"))
