"""I-Match document fingerprints, in DataFrame functions only.

A term's document frequency is counted over all documents; the lexicon keeps the terms of a middle band of inverse
document frequency. A document's distinct lexicon terms, sorted, are hashed once for each of several random subsets of
the lexicon. Subsets come in four sizes, so that short and long texts both have subsets with few of their terms;
likeness is the share of equal hashes among the subsets of one size that hold a term of either text, of the smallest
subsets that enough terms fall into. A hash of all words stands in where a text has no lexicon term.

The lexicon is bounded: each of its terms lies in `low` of the documents at least, so it has at most (mean distinct
terms of a document) / low terms. It becomes a set in the expression only after its size is checked; beyond that the
terms are joined.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import found_for, in_place, store

LOW, HIGH = 0.002, 0.2
#: A subset of each size keeps one term in so many; subsets of one size have no term in common.
RATES = (16, 64, 256, 1024)
#: Subsets of each size, at most the least rate.
SUBSETS = 16
#: Subsets with a term of either text that make a size fit for comparison.
ENOUGH = 4
TERMS_IN_A_SET = 50_000
ROWS_A_RANGE = 20_000


def words(text: Column) -> Column:
    """Hashed terms in order: lower-case runs of letters and digits."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(found, lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(term): hashed terms whose document frequency lies in the band; a term is in two documents at least."""
    n = docs.count()
    counts = docs.select(F.explode(F.array_distinct(words(F.col("text")))).alias("term")).groupBy("term").count()
    return store(counts.filter(F.col("count").between(max(2, math.ceil(low * n)), math.floor(high * n))).select("term"), "lexicon")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fingerprint(found: Column, every: Column) -> Column:
    """Hashes of the sorted distinct lexicon terms, one for each subset (0 for an empty one), and the given one of all words."""

    def of_rate(rate: int) -> Column:
        place = lambda t: F.pmod(F.xxhash64(t, F.lit(rate)), F.lit(rate))
        some = F.filter(F.transform(found, lambda t: F.struct(place(t).alias("k"), t.alias("t"))), lambda x: x["k"] < SUBSETS)
        subset = lambda few, k: F.transform(F.filter(few, lambda x: x["k"] == k), lambda x: x["t"])
        each = lambda few: F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda k: let(subset(few, k), lambda s: F.when(F.size(s) == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(s))))
        return let(some, each)

    return F.concat(*[of_rate(r) for r in RATES], F.array(every))


def as_text(prints: Column) -> Column:
    return F.array_join(F.transform(prints, lambda h: F.lpad(F.hex(h.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Equal hashes among the used subsets of the smallest size of which ENOUGH are used, else among all used ones.

    Where no subset is used, 1 for texts of equal words and 0 for others.
    """
    both = F.zip_with(a, b, lambda x, y: F.struct(((x != 0) | (y != 0)).cast("int").alias("used"), ((x == y) & (x != 0)).cast("int").alias("same")))
    total = lambda part: F.aggregate(part, F.struct(F.lit(0).alias("used"), F.lit(0).alias("same")), lambda s, v: F.struct((s["used"] + v["used"]).alias("used"), (s["same"] + v["same"]).alias("same")))

    def graded(pairs: Column) -> Column:
        of_rate = [total(F.slice(pairs, i * SUBSETS + 1, SUBSETS)) for i in range(len(RATES))]
        fit = F.filter(F.array(*reversed(of_rate)), lambda t: t["used"] >= ENOUGH)
        best = F.coalesce(F.get(fit, F.lit(0)), total(F.slice(pairs, 1, len(RATES) * SUBSETS)))
        return let(best, lambda t: F.when(t["used"] > 0, t["same"] / t["used"]).otherwise(F.get(pairs, F.lit(len(RATES) * SUBSETS))["same"].cast("double")))

    return let(both, graded)


def known_terms(rows: DataFrame, lex: DataFrame, most: int = TERMS_IN_A_SET) -> DataFrame:
    """rows with the sorted distinct lexicon terms in place of the words of each list in `w`; rows need _pl_part and _pl_row."""
    size = lex.count()
    if size <= most:
        inside = ",".join(f"{r[0]}L" for r in lex.orderBy("term").collect()) or "null"  # at most `most` numbers
        return rows.withColumn("w", F.expr(f"transform(w, x -> array_sort(array_distinct(filter(x, t -> t in ({inside})))))"))
    key = ["_pl_part", "_pl_row"]
    terms = rows.select(*key, F.posexplode("w").alias("i", "x")).select(*key, "i", F.explode(F.array_distinct("x")).alias("term")).join(lex, "term")
    sets = terms.groupBy(*key).agg(*[F.array_sort(F.collect_set(F.when(F.col("i") == i, F.col("term")))).alias(f"_{i}") for i in range(3)])
    empty = F.array().cast("array<long>")
    return rows.join(sets, key, "left").withColumn("w", F.array(*[F.coalesce(f"_{i}", empty) for i in range(3)])).drop("_0", "_1", "_2")


def with_next(docs: DataFrame, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """(doc_id, text, next_text, _pl_part, _pl_row): next is the document before it in descending id order.

    After the last comes the first; null ids come last, rows of equal id are ordered by a hash of their text. Ranges of
    ids are sorted and stay in place; a range's last row gets its next text from the head of the following range, which
    is all that ranges tell each other.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(docs.count() / rows_a_range))
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_fp_tie", F.xxhash64("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("_fp_tie")]
    placed = in_place(base.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_fp_tie"), parts)
    ends = placed.groupBy("_pl_part").agg(F.min("_pl_row").alias("head"), F.max("_pl_row").alias("tail"))
    line = Window.orderBy("_pl_part")  # one row a range
    following = F.coalesce(F.lead("head").over(line), F.first("head").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ends = store(ends.select("tail", following.alias("row")), "range-ends")
    heads = found_for(placed, ends.select("row"), "left_semi").select(F.col("_pl_row").alias("row"), F.col("text").alias("_fp_head"))
    guests = store(ends.join(heads, "row").select(F.col("tail").alias("row"), "_fp_head"), "range-heads")
    beside = F.lead("text").over(Window.partitionBy("_pl_part").orderBy("_pl_row"))
    return found_for(placed, guests, "left").withColumn("next_text", F.coalesce(beside, F.col("_fp_head"), F.lit(""))).drop("_fp_head")


def compare(docs: DataFrame, rows_a_range: int = ROWS_A_RANGE, terms_in_a_set: int = TERMS_IN_A_SET) -> DataFrame:
    """Fingerprints of each document, of its half-edited text, and their likeness.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). A null text is empty;
    texts without lexicon terms are told apart by their words; repeated rows each give a row; an empty table gives no
    row; other columns are not read.
    """
    rows = with_next(docs, rows_a_range)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    texts = F.array("text", edited, "next_text")
    rows = rows.select("_pl_part", "_pl_row", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(edited.cast("binary"), 256).alias("edited_sha256"), F.transform(texts, words).alias("w"))
    rows = rows.withColumn("every", F.transform("w", lambda x: F.xxhash64(x)))
    found = known_terms(rows, lexicon(docs), terms_in_a_set)
    prints = found.select("doc_id", "n_chars", "edited_sha256", F.zip_with("w", "every", fingerprint).alias("p"))
    shown = prints.withColumn("near", F.transform(F.array(F.lit(1), F.lit(2)), lambda i: likeness(F.get("p", F.lit(0)), F.get("p", i))))
    shown = shown.withColumn("t", F.transform(F.slice("p", 1, 2), as_text))
    return shown.select("doc_id", "n_chars", "edited_sha256", F.col("t")[0].alias("fingerprint"), F.col("t")[1].alias("edited_fingerprint"), F.col("near")[0].alias("near_edited"), F.col("near")[1].alias("near_next"))
