"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Every document waits in the queue of its source, in an order shuffled by a hash of its id, once for each pass that a
source may make. Pass e of a document has the virtual finish time (e * words of the source + words up to and with the
document) / weight of the source. The weight that serves is the reshared one, the target (`targets` reshares what sources
at their limit of passes leave over), so that all sources are due at time 1 together; the document that a target ends in
is served in two pieces. All pieces of all passes are range-sorted by finish time, the words before each are summed up
over the ranges, and the mix is truncated where the total budget of whole words is used up (`truncation`): that place
alone decides what is taken.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm import common

#: A source's weight by its place in code point order, repeating.
WEIGHTS = (1, 2, 3)
MAX_PASSES = 3
#: Rows that one window of a source's shuffled queue holds, about; more rows make more windows.
ROWS_A_WINDOW = 50_000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.BLANK_SEPARATED)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, size: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.concat(F.lit("null "), size.cast("string"))))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = MAX_PASSES, budget: int | None = None) -> DataFrame:
    """(source, source_size) with place, weight and target: the budget shared by weight, at most `passes` times a source.

    The budget is the size of all sources unless it is given. Each round fills the sources whose share lies above their
    limit and shares the rest again; the driver sees three sums a round and no source.
    """
    placed = common.ranked(sources, [F.col("source").asc_nulls_last()], "place")
    cycle = F.array(*[F.lit(w) for w in weights])
    w = F.get(cycle, ((F.col("place") - 1) % len(weights)).cast("int")).cast("long")
    placed = common.store(placed.withColumn("weight", w), "mix-sources")
    limit = F.col("source_size") * passes
    total, weight = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    whole = total if budget is None else budget
    left, active, full_before = whole, weight, -1
    while active:
        above = limit.cast("double") * active < F.lit(float(left)) * F.col("weight")
        full, used, gone = placed.filter(above).agg(F.count("*"), F.coalesce(F.sum(limit), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if full == full_before:
            break
        full_before, left, active = full, whole - used, weight - gone
    share = F.lit(float(left)) * F.col("weight").cast("double") / F.lit(float(active or 1))
    return placed.withColumn("target", F.least(share, limit.cast("double")))


def _pieces(e: int) -> list[tuple[Column, Column]]:
    """(words, finish) of pass e of a document: what lies before its source's target, and what lies behind."""
    begin = F.col("source_size") * e + F.col("_mx_start")
    before = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - begin))
    never = F.lit(math.inf)  # of a source without weight
    finish = lambda words: F.coalesce(F.try_divide((begin + words).cast("double"), F.col("weight").cast("double")), never)
    return [(before, finish(before)), (F.col("size") - before, finish(F.col("size")))]


def truncation(queued: DataFrame, budget: int, passes: int = MAX_PASSES) -> tuple[float, int, int] | None:
    """(finish, place, words) of the piece in which the budget ends: pieces before it in the order by finish time and
    place of the source are taken, of itself so many words, later ones not. None if the budget holds all.

    Pieces are range-sorted; the driver sees the range in which the budget ends, and that range's one row.
    """
    each = F.array(*[F.struct(words.alias("words"), finish.alias("finish")) for e in range(passes) for words, finish in _pieces(e)])
    rows = queued.select("place", F.explode(F.filter(each, lambda x: x["words"] > 0)).alias("p")).select("place", "p.words", "p.finish")
    order = ["finish", "place"]
    parts = common.store(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mix-order")
    sums = parts.groupBy("part").agg(F.sum("words").alias("words"))
    upto = F.sum("words").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))  # one row a range
    found = sums.withColumn("upto", upto).filter(F.col("upto") > budget).orderBy("part").first()
    if found is None:
        return None
    left = budget - (found["upto"] - found["words"])
    # Two numbers a pass: the rows of this one range, which one task sorts.
    inside = parts.filter(F.col("part") == found["part"])
    before = F.sum("words").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    row = inside.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") + F.col("words") > left).orderBy(*order).first()
    return float(row["finish"]), int(row["place"]), int(left - row["before"])


def allocate(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = MAX_PASSES, rows_a_window: int = ROWS_A_WINDOW, budget: int | None = None) -> DataFrame:
    """sized (doc_id, source, size and any other columns) with source_size, target, taken and finish.

    taken counts the words that the mix takes of a document, repeats counted; the document at a source's end is cut at
    the target. finish is the virtual finish time of the first pass. Null sources are one source; null ids are
    ordered by size; equal ids are ordered by size, and rows equal in both are taken one after the other; an empty
    table gives an empty result; input columns with the names of result columns are replaced.
    """
    rows, words = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    digits = max(1, math.ceil(math.log(max(rows, 1) / rows_a_window, 16))) if rows > rows_a_window else 1
    keyed = sized.drop("source_size", "target", "taken", "finish").withColumn("_mx_key", shuffle_key(F.col("doc_id"), F.col("size"))).withColumn("_mx_window", F.substring("_mx_key", 1, digits))
    windows = common.store(keyed.groupBy("source", "_mx_window").agg(F.sum("size").alias("_mx_size")), "mix-windows")
    plan = targets(windows.groupBy("source").agg(F.sum("_mx_size").alias("source_size")), weights, passes, budget)
    before = Window.partitionBy("source").orderBy("_mx_window").rowsBetween(Window.unboundedPreceding, -1)
    starts = windows.withColumn("_mx_before", F.coalesce(F.sum("_mx_size").over(before), F.lit(0))).drop("_mx_size")
    starts = starts.alias("w").join(plan.alias("p"), F.col("w.source").eqNullSafe(F.col("p.source"))).select(F.col("w.source").alias("_mx_source"), F.col("_mx_window").alias("_mx_window2"), "_mx_before", "source_size", "target", F.col("target").alias("weight"), "place")
    starts = common.store(starts, "mix-starts")
    queue = Window.partitionBy("source", "_mx_window").orderBy("_mx_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)

    def queued(keyed: DataFrame) -> DataFrame:
        upto = keyed.withColumn("_mx_upto", F.sum("size").over(queue))
        joined = upto.join(starts, upto["source"].eqNullSafe(starts["_mx_source"]) & (upto["_mx_window"] == starts["_mx_window2"]))
        return joined.withColumn("_mx_start", F.col("_mx_before") + F.col("_mx_upto") - F.col("size"))

    # Texts and other columns don't wait in the queue: without them it is kept for the end.
    narrow = ["doc_id", "source", "size", "_mx_key", "_mx_window"]
    line = common.store(queued(keyed.select(*narrow)), "mix-queue")
    due = plan.agg(F.coalesce(F.sum(F.floor("target")), F.lit(0))).first()[0]
    cut = truncation(line, due, passes)

    def served(words: Column, finish: Column) -> Column:
        if cut is None:
            return words
        end, place, left = cut
        earlier = (finish < end) | ((finish == end) & (F.col("place") < place))
        return F.when(earlier, words).when((finish == end) & (F.col("place") == place), F.least(words, F.lit(left))).otherwise(F.lit(0))

    taken = sum((served(*piece) for e in range(passes) for piece in _pieces(e)), F.lit(0))
    whole = line if set(keyed.columns) == set(narrow) else queued(keyed)
    finish = F.coalesce(F.try_divide((F.col("_mx_start") + F.col("size")).cast("double"), F.col("weight").cast("double")), F.lit(0.0))
    out = whole.withColumn("taken", taken.cast("long")).withColumn("finish", finish)
    return out.drop("_mx_key", "_mx_window", "_mx_window2", "_mx_source", "_mx_before", "_mx_upto", "_mx_start", "weight", "place")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = MAX_PASSES, budget: int | None = None) -> DataFrame:
    """The mixed documents in serving order: all columns of docs, size, source_size, target, taken, finish.

    budget: words of the mix, repeats counted; as many as the documents have unless it is given. Documents that the mix
    doesn't reach go. A null text has size 0 and is never taken. Columns of docs with the five names are replaced.
    """
    out = allocate(docs.withColumn("size", words_in(F.col("text"))), weights, passes, budget=budget)
    return out.filter("taken > 0").repartitionByRange("finish", "doc_id").sortWithinPartitions("finish", "doc_id")
