"""Articles: outcomes of recognition, assembly, rectangles, numbering, overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import layout as L
from quirefold.functions import text as X

UNTITLED = "（无标题）"
DEFAULT_TITLE = r"^(?:报道\d+|Article \d+)$"


def joined(parts: Column, order: list[str], value: str, sep: str) -> Column:
    """Texts joined in order, inside an aggregation."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(parts)), lambda p: p[value]), sep)


def aggregate_outcomes(outcomes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, cancelled, error, text): any failure gives the first message, else the texts of the blocks by order."""
    place = F.struct(*[F.col(c) for c in order])
    failed = F.col("status") == "failed"
    return outcomes.groupBy(key).agg(
        F.max(F.col("status") == "cancelled").alias("cancelled"),
        F.min_by(F.when(failed, F.col("message")), F.when(failed, place)).alias("error"),
        joined(F.when(F.col("status") == "done", F.struct(*order, "text")), order, "text", "\n").alias("text"),
    ).withColumn("error", F.when(~F.col("cancelled"), F.col("error"))).withColumn("text", F.when(~F.col("cancelled") & F.col("error").isNull(), F.col("text")))


def article_part(title: Column, text: Column) -> Column:
    """Title, text and a blank line; an empty title gives way to the first line."""
    body = X.trim_ws(text)
    head = F.substring_index(body, "\n", 1)
    rest = F.when(F.instr(body, "\n") > 0, F.substring(body, F.length(head) + 2, F.length(body))).otherwise(F.lit(""))
    first = F.when(head != "", head).otherwise(F.lit(UNTITLED))
    return F.when(title == "", F.concat(first, F.lit("\n"), X.trim_ws(rest), F.lit("\n"))).otherwise(F.concat(title, F.lit("\n"), body, F.lit("\n")))


def assembled(name: Column, date: Column, parts: Column) -> Column:
    head = F.when((name != "") | (date != ""), F.concat(name, F.lit("\n"), date, F.lit("\n\n"))).otherwise("")
    return X.rtrim_ws(F.concat(head, F.array_join(parts, "\n")))


def union_rects(rects: DataFrame, by: list[str]) -> DataFrame:
    """The rectangle around all of a group's, corners put right; groups without area go."""
    left, top = F.least(F.col("x"), F.col("x") + F.col("w")), F.least(F.col("y"), F.col("y") + F.col("h"))
    right, bottom = F.greatest(F.col("x"), F.col("x") + F.col("w")), F.greatest(F.col("y"), F.col("y") + F.col("h"))
    out = rects.groupBy(*by).agg(F.min(left).alias("ux"), F.min(top).alias("uy"), (F.max(right) - F.min(left)).alias("uw"), (F.max(bottom) - F.min(top)).alias("uh"))
    return out.filter("uw > 0 and uh > 0")


def padded(rects: DataFrame, share: float = L.RECT_PADDING) -> DataFrame:
    """Rectangles with a margin in proportion to their own size on every side."""
    return rects.select("*", (F.col("ux") - F.col("uw") * share).alias("px"), (F.col("uy") - F.col("uh") * share).alias("py"), (F.col("uw") * (1 + 2 * share)).alias("pw"), (F.col("uh") * (1 + 2 * share)).alias("ph"))


def renumbered(articles: DataFrame, doc: str, order: list[Column]) -> DataFrame:
    """articles with num from 1 in each document; titles that were made from a number follow it."""
    num = F.row_number().over(Window.partitionBy(doc).orderBy(*order)).cast("long")
    out = articles.withColumn("num", num)
    return out.withColumn("title", F.when(F.col("title").rlike(DEFAULT_TITLE), F.concat(F.lit("Article "), F.col("num").cast("string"))).otherwise(F.col("title")))


def overlaid(rows: DataFrame, key: str, order: list[Column], shape: tuple[str, ...] = ("layout",), kept: tuple[str, ...] = ("text",)) -> DataFrame:
    """All rows of each key laid over one another in their order: one row a key, with the columns of its last row.

    Columns source, status, error, those of `shape` and those of `kept`. Of `kept` the last value that isn't null counts.
    A change of source or a failure drops the `shape` of all rows before, so of these the last value since then counts.
    An error lives as long as no row after it succeeds. Other columns are the last row's own.

    Nothing here needs a key's rows side by side: rows are first summed up by key and source, where the last shape of
    the last source counts if no other source and no failure comes after it.
    """
    at, failed = F.struct(*order), F.coalesce(F.col("status") == "failed", F.lit(False))
    last = lambda value, when: F.max(F.when(when, F.struct(at.alias("at"), value.alias("v"))))
    folded = {"error", *shape, *kept}
    others = [c for c in rows.columns if c not in folded]
    marks = [F.max(at).alias("_at"), F.max(F.when(failed, at)).alias("_failed"), F.max(F.when(~failed, at)).alias("_sound"), F.max_by(F.struct(*others), at).alias("_row")]
    values = [last(F.col(c), F.col(c).isNotNull()).alias(f"_{c}") for c in (*shape, *kept)] + [last(F.col("error"), F.col("error").isNotNull() & failed).alias("_error")]
    by_source = rows.withColumn("_source", F.col("source")).groupBy(key, "_source").agg(*marks, *values)

    shapes = F.struct("_at", *[F.col(f"_{c}") for c in shape])
    # The two latest sources' places: the first is the last row's, the second the last of any other source.
    both = F.reverse(F.array_sort(F.collect_list(F.struct("_at"))))
    out = by_source.groupBy(F.col(key).alias("_key")).agg(
        F.max_by("_row", "_at").alias("row"), F.max_by(shapes, "_at").alias("own"), F.get(both, 1)["_at"].alias("other"), F.max("_failed").alias("failed"), F.max("_sound").alias("sound"), *[F.max(f"_{c}").alias(f"_{c}") for c in (*kept, "error")]
    )
    since = lambda x: F.when((F.col("other").isNull() | (x["at"] > F.col("other"))) & (F.col("failed").isNull() | (x["at"] >= F.col("failed"))), x["v"])
    lives = F.col("row.status") == "failed"
    made = {c: since(F.col(f"own._{c}")) for c in shape} | {c: F.col(f"_{c}.v") for c in kept}
    made["error"] = F.when(lives & (F.col("sound").isNull() | (F.col("_error.at") > F.col("sound"))), F.col("_error.v"))
    return out.select(*[made[c].alias(c) if c in made else F.col(f"row.{c}").alias(c) for c in rows.columns])
