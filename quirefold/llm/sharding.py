"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

The leaves of the tree are shards, which stand in racks, which stand in regions; a node weighs what its leaves weigh.
A key descends from the root: at each level every child draws the exponential -ln(u) / weight from a hash of key and
path, and the least draw wins. So a child gets keys in proportion to its weight, and where a weight changes, keys move
only into or out of the children whose weights changed: a draw of any other child stays as it was. A level is decided
by as many draws as it has children, not by one for each shard.

A tree that grows by one shard in a region of its own (`grown`) leaves all weights in other regions as they were, so
rows move into the new shard and nowhere else. A shard added to an old rack makes its rack and region heavier: rows
then also move inside that region.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import store
from quirefold.llm.fingerprints import let

#: Bytes that a row takes beside its text.
ROW_BYTES = 16
#: Rows that one window of a shard holds, about; more rows make more windows.
ROWS_A_WINDOW = 50_000

Tree = list[tuple[str, str, int, float]]


def regular(shards: int = 40, regions: int = 4, racks: int = 2, each: int = 5) -> Tree:
    """(region, rack, shard, weight) of equal shards: `each` in a rack, `racks` in a region, `regions` regions; every
    shard beyond these is a region of its own, so that from there on one more shard takes rows only into itself."""
    whole, out = regions * racks * each, []
    for s in range(shards):
        region, rack = (s // (racks * each), s // each % racks) if s < whole else (regions + s - whole, 0)
        out.append((f"region{region}", f"rack{rack}", s, 1.0))
    return out


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """tree with one more shard, numbered next, in a region of its own."""
    shard = max(s for _, _, s, _ in tree) + 1
    names = {region for region, _, _, _ in tree}
    region = next(f"region{i}" for i in range(len(names) + 1) if f"region{i}" not in names)
    return [*tree, (region, "rack0", shard, weight)]


def draw(key: Column, path: Column, weight: Column) -> Column:
    """The child's exponential draw: 48 bits of the md5 of key and path as u in (0, 1), -ln(u) / weight."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), path)), 1, 12), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(1 << 48)) / weight


def _least(key: Column, children: Column) -> Column:
    """The place of the child (path, weight) of least draw among its siblings."""
    drawn = F.transform(children, lambda c, i: F.struct(draw(key, c["path"], c["weight"]).alias("draw"), i.alias("at")))
    return F.array_min(drawn)["at"]


def descend(key: Column, tree: Tree) -> Column:
    """The shard to which a key descends. Shards whose weight isn't above 0 get none; a tree must have another."""
    nodes: dict[str, dict[str, list[tuple[int, float]]]] = {}
    for region, rack, shard, weight in tree:
        if weight > 0:
            nodes.setdefault(region, {}).setdefault(rack, []).append((shard, float(weight)))
    if not nodes:
        raise ValueError("the tree has no shard of a weight above 0")

    def children(found: list[tuple[str, float]]) -> Column:
        return F.array(*[F.struct(F.lit(path).alias("path"), F.lit(w).alias("weight")) for path, w in found])

    weigh = lambda shards: math.fsum(w for _, w in shards)
    regions = children([(r, math.fsum(weigh(s) for s in racks.values())) for r, racks in nodes.items()])
    racks = F.array(*[children([(f"{r}/{k}", weigh(s)) for k, s in inside.items()]) for r, inside in nodes.items()])
    shards = F.array(*[F.array(*[children([(f"{r}/{k}/{n}", w) for n, w in s]) for k, s in inside.items()]) for r, inside in nodes.items()])
    numbers = F.array(*[F.array(*[F.array(*[F.lit(n) for n, _ in s]) for s in inside.values()]) for inside in nodes.values()])
    in_rack = lambda r, k: F.get(F.get(F.get(numbers, r), k), _least(key, F.get(F.get(shards, r), k)))
    return let(_least(key, regions), lambda r: let(_least(key, F.get(racks, r)), lambda k: in_rack(r, k)))


def placed(docs: DataFrame, tree: Tree | None = None) -> DataFrame:
    """docs with size, text_crc32, law, shard and grown_shard; columns of those names are replaced.

    size: UTF-8 bytes of the text and ROW_BYTES more; text_crc32: of those bytes, unsigned. A null text has no bytes.
    The id alone decides on the shard, whatever its type, so rows of one id, or without one, share a shard; equal texts
    of different ids need not. grown_shard is the shard in the tree that has one more.
    """
    tree = tree or regular()
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns(
        {
            "size": (F.octet_length(text) + ROW_BYTES).cast("long"),
            "text_crc32": F.crc32(text.cast("binary")),
            "law": F.lit("key"),
            "shard": descend(key, tree),
            "grown_shard": descend(key, grown(tree)),
        }
    )


def numbered(rows: DataFrame, order: Column, rows_a_window: int = ROWS_A_WINDOW) -> DataFrame:
    """rows with slot, their place in their shard: gapless from 0, in the order of `order`, an md5 of what tells rows apart.

    No shard is sorted by one task: windows are cut by the first digits of the md5, and only their sums are added up
    over a shard. Rows equal in all columns are one row a task until their windows are done, so that copies without
    number spread over as many tasks as they came from. An empty table gives an empty result; a column slot is replaced.
    """
    rows = rows.drop("slot")
    keyed = rows.withColumn("_sh_key", order).withColumn("_sh_task", F.spark_partition_id())
    groups = store(keyed.groupBy(*keyed.columns).agg(F.count("*").alias("_sh_n")), "shard-rows")
    n = groups.count()
    digits = max(1, math.ceil(math.log(n / rows_a_window, 16))) if n > rows_a_window else 1
    cut = groups.withColumn("_sh_window", F.substring("_sh_key", 1, digits))
    before = Window.partitionBy("shard").orderBy("_sh_window").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("shard", "_sh_window").agg(F.sum("_sh_n").alias("_sh_sum"))
    starts = sums.select("shard", "_sh_window", F.coalesce(F.sum("_sh_sum").over(before), F.lit(0)).alias("_sh_start"))
    inside = Window.partitionBy("shard", "_sh_window").orderBy("_sh_key", "_sh_task").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("_sh_n").over(inside), F.lit(0))
    out = cut.withColumn("_sh_before", first).join(starts, ["shard", "_sh_window"])
    dealt = out.repartition("_sh_key", "_sh_task").select(*rows.columns, (F.col("_sh_start") + F.col("_sh_before")).alias("_sh_from"), "_sh_n")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_sh_n") - 1)).alias("_sh_i")
    return dealt.select(*rows.columns, "_sh_from", each).select(*rows.columns, (F.col("_sh_from") + F.col("_sh_i")).alias("slot"))


def assign(docs: DataFrame, tree: Tree | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of docs (doc_id, text and any others).

    Null ids and texts, empty and long texts, repeated ids and repeated rows all get a shard and a slot; an empty table
    gives an empty result; further columns, whatever their names, are left out.
    """
    found = placed(docs.select("doc_id", "text"), tree).drop("text")
    tells = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_crc32"), F.col("size")))
    return numbered(found, tells).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write(docs: DataFrame, path: str, tree: Tree | None = None, tasks_a_shard: int = 4) -> None:
    """All columns of docs as Parquet, in a folder `shard=<n>` a shard, by `tasks_a_shard` tasks each."""
    found = placed(docs, tree).drop("size", "text_crc32", "law", "grown_shard")
    part = F.pmod(F.xxhash64(*docs.columns), F.lit(tasks_a_shard))
    found.repartition("shard", part).write.partitionBy("shard").parquet(path)
