"""Replies of recognition services as columns and tables: result lines, results of pictures, chat completions.

Replies are read into VARIANT, so that a value of the wrong type is told from the right one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions import text as X

#: Reasons to stop that mean a cut reply, and how much of a refusal is told; fixed values.
CUT = ("length", "max_tokens")
TOLD = 200


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _is(v: Column, kind: str) -> Column:
    """Whether a value is there and of a kind: OBJECT, ARRAY, STRING or VOID (JSON null)."""
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _string(v: Column) -> Column:
    return F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string"))


def _items(v: Column) -> Column:
    return F.when(_is(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>"))


def _texts(items: Column) -> Column:
    """The trimmed Markdown of items, without blank ones."""
    return F.filter(F.transform(items, lambda x: X.trim_ws(_string(_at(x, "$.markdown.text")))), lambda t: F.coalesce(t != "", F.lit(False)))


def line_text(line: Column) -> Column:
    """The text of a result line: its items' Markdown, trimmed, joined by single line ends.

    The result's list counts if it is there, even if it is no list; else the line's own. Null for a line that isn't JSON.
    """
    v = F.try_parse_json(line)
    items = _items(F.coalesce(_at(v, "$.result.layoutParsingResults"), _at(v, "$.layoutParsingResults")))
    return F.when(v.isNotNull(), F.coalesce(F.array_join(_texts(items), "\n"), F.lit("")))


def _keeps_protocol(v: Column) -> Column:
    """Whether a line has a result whose list, if any, holds items whose Markdown, if any, has a string for its text, if any."""
    result, listed = _at(v, "$.result"), _at(v, "$.result.layoutParsingResults")

    def good(item: Column) -> Column:
        marked, text = _at(item, "$.markdown"), _at(item, "$.markdown.text")
        return _is(item, "OBJECT") & (marked.isNull() | _is(marked, "OBJECT")) & (text.isNull() | _is(text, "STRING"))

    return _is(result, "OBJECT") & (listed.isNull() | F.coalesce(F.forall(_items(listed), good), F.lit(False)))


def picture_texts(lines: DataFrame, by: list[str]) -> DataFrame:
    """(by, text, bad_line) of the result lines (by, i, line) of pictures: the Markdown of all lines in their order.

    Blank lines are passed over. A line that breaks the protocol fails its picture: bad_line is the first such i, text null.
    """
    v = F.try_parse_json("line")
    read = lines.select(*by, "i", X.not_blank(F.col("line")).alias("_full"), v.alias("_v"))
    ok = F.coalesce(_keeps_protocol(F.col("_v")), F.lit(False))
    text = F.array_join(_texts(_items(_at(F.col("_v"), "$.result.layoutParsingResults"))), "\n")
    rows = read.select(*by, "i", (F.col("_full") & ~ok).alias("_bad"), F.when(F.col("_full") & ok & (text != ""), F.struct("i", text.alias("t"))).alias("_part"))
    out = rows.groupBy(*by).agg(F.min(F.when(F.col("_bad"), F.col("i"))).alias("bad_line"), F.sort_array(F.collect_list("_part")).alias("_parts"))
    whole = F.array_join(F.transform("_parts", lambda p: p["t"]), "\n")
    return out.select(*by, F.when(F.col("bad_line").isNull(), whole).alias("text"), "bad_line")


def chat_outcome(status: Column, body: Column) -> Column:
    """(text, error, retryable) of a chat completion: the first choice, trimmed.

    error: `HTTP <status>: ` and the beginning of the body for a refusal, which 429 and 5xx allow to try again; `parse` for a
    body in which some choice has no message with a string for its content; `empty` without choices; `truncated` for one
    that was cut by its length limit.
    """
    refused = ~status.between(200, 299)
    v = F.try_parse_json(body)
    choices = _items(_at(v, "$.choices"))

    def good(choice: Column) -> Column:
        reason = _at(choice, "$.finish_reason")
        return _is(_at(choice, "$.message.content"), "STRING") & (reason.isNull() | _is(reason, "VOID") | _is(reason, "STRING"))

    first = F.get(choices, F.lit(0))
    error = (
        F.when(refused, F.concat(F.lit("HTTP "), status.cast("string"), F.lit(": "), F.coalesce(F.substring(body, 1, TOLD), F.lit(""))))
        .when(~F.coalesce(F.forall(choices, good), F.lit(False)), "parse")
        .when(F.size(choices) == 0, "empty")
        .when(_string(_at(first, "$.finish_reason")).isin(*CUT), "truncated")
    )
    text = X.trim_ws(_string(_at(first, "$.message.content")))
    again = refused & ((status == 429) | (status >= 500))
    return X.let(error, lambda e: F.struct(F.when(e.isNull(), text).alias("text"), e.alias("error"), F.when(e.isNotNull(), again).alias("retryable")))
