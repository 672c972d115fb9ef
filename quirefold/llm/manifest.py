"""A Merkle manifest of a dataset: a tree of digests a group, a tree over the groups' roots, and a proof for every row.

Rows are range-sorted by group and order. Each range counts its rows a group; prefix sums of these counts (one row a
range and group) give every row its place in its group. A run, the rows of one group in one range, builds the subtrees
that are complete and aligned inside it, and so is left with a few ragged nodes at its two edges. Only these are
shuffled, by their coordinate (group, level, place): blocks of a few ranges' width finish what lies in them and hand
one node up, until the group's root stands. On the way down again every node hands its siblings to the nodes below it.
Last, each run builds its own subtrees once more and puts its rows' siblings before those of its ragged nodes.

Of n leaves level l has ((n - 1) >> l) + 1 nodes. Two consecutive nodes become the digest of both; a last one without a
partner becomes the digest of itself alone.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quirefold.llm.common import part_of, store

#: Rows of a range, at most about; a range's rows and nodes are in memory together.
ROWS_A_RANGE = 50_000
#: Levels that a block rises above those below it: it meets 2 ** RISE of them.
RISE = 4
#: Rows whose proofs are put together at once.
ROWS_AT_ONCE = 4096

#: A step of a proof: where the sibling stands, and its digest. ALONE has none: the node is digested by itself.
RIGHT, LEFT, ALONE = 0, 1, 2
STEPS = "array<struct<side:int,digest:string>>"
ARROW_STEPS = pa.list_(pa.struct([("side", pa.int32()), ("digest", pa.string())]))
Step = tuple[int, str]


def digest(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def field(value: Column) -> Column:
    """A value as it enters a leaf: `-` for null, else its UTF-8 bytes' number, a colon, and the value."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and the steps of its proof lead to."""
    joined = lambda at, s: F.when(s["side"] == RIGHT, F.concat(at, s["digest"])).when(s["side"] == LEFT, F.concat(s["digest"], at)).otherwise(at)
    return F.aggregate(proof, start, lambda at, s: F.sha2(joined(at, s).cast("binary"), 256))


def siblings_digest(proof: Column) -> Column:
    """Digest of a proof's siblings, from the leaf's level to the root's."""
    some = F.filter(proof, lambda s: s["side"] != ALONE)
    return F.sha2(F.array_join(F.transform(some, lambda s: s["digest"]), "").cast("binary"), 256)


def top(n: int) -> int:
    """The level of the root over n leaves."""
    return (n - 1).bit_length()


def above(nodes: list[str], first: int, last: int) -> tuple[list[str], int]:
    """The complete nodes over consecutive ones that begin at place `first`, and their first place; `last` is the place
    of the level's last node."""
    skip = first & 1
    out = [digest(nodes[i], nodes[i + 1]) for i in range(skip, len(nodes) - 1, 2)]
    if first + len(nodes) - 1 == last and last & 1 == 0 and len(nodes) > skip:
        out.append(digest(nodes[-1]))
    return out, (first + 1) >> 1


def levels(leaves: list[str], first: int, n: int) -> list[tuple[int, list[str]]]:
    """(first place, nodes) of every level that a run completes by itself."""
    out = [(first, leaves)]
    while len(out) <= top(n):
        nodes, at = above(out[-1][1], out[-1][0], (n - 1) >> (len(out) - 1))
        if not nodes:
            break
        out.append((at, nodes))
    return out


def inside(found: list[tuple[int, list[str]]], level: int, place: int) -> bool:
    return level < len(found) and found[level][0] <= place < found[level][0] + len(found[level][1])


def step(place: int, last: int, sibling) -> Step:
    """The step of a node at this place; sibling(place) is the digest of its sibling."""
    other = place ^ 1
    return (ALONE, "") if other > last else (place & 1, sibling(other))


def ragged(rows: pa.Table) -> pa.Table:
    """The nodes of a run (group, part, place, leaves, leaf) whose parents it can't complete."""
    rows = rows.sort_by("_mk_place")
    group, part, first, n = (rows.column(c)[0].as_py() for c in ("_mk_group", "_mk_part", "_mk_place", "_mk_n"))
    found = levels(rows.column("_mk_leaf").to_pylist(), first, n)
    out = [(level, at + i, x) for level, (at, nodes) in enumerate(found) for i, x in enumerate(nodes) if not inside(found, level + 1, (at + i) >> 1)]
    columns = [[group] * len(out), [part] * len(out), [n] * len(out), *zip(*out)]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), *[pa.int64()] * 3, pa.string()))], ["_mk_group", "_mk_part", "_mk_n", "level", "place", "digest"])


RAGGED = "_mk_group string, _mk_part int, _mk_n long, level long, place long, digest string"
CLIMBED = f"_mk_group string, _mk_n long, level long, place long, top_level long, top_place long, top_digest string, tail {STEPS}"


def climber(height: int):
    """Finishes the nodes of a block below `height`: each comes back with its block's top node and the steps to it."""

    def run(rows: pa.Table) -> pa.Table:
        group, n = rows.column("_mk_group")[0].as_py(), rows.column("_mk_n")[0].as_py()
        given = list(zip(*[rows.column(c).to_pylist() for c in ("level", "place", "digest")]))
        end = min(height, top(n))
        at: list[dict[int, str]] = [{} for _ in range(end + 1)]
        for level, place, x in given:
            at[level][place] = x
        for level in range(end):
            last = (n - 1) >> level
            for place in list(at[level]):
                if place & 1 == 0:
                    at[level + 1][place >> 1] = digest(at[level][place]) if place == last else digest(at[level][place], at[level][place + 1])
        tails = [[step(place >> (k - level), (n - 1) >> k, at[k].__getitem__) for k in range(level, end)] for level, place, _ in given]
        root = given[0][1] >> (end - given[0][0])
        m = len(given)
        columns = [[group] * m, [n] * m, [g[0] for g in given], [g[1] for g in given], [end] * m, [root] * m, [at[end][root]] * m]
        kinds = [pa.string(), *[pa.int64()] * 5, pa.string()]
        steps = pa.array([[{"side": s, "digest": d} for s, d in t] for t in tails], ARROW_STEPS)
        return pa.table([*[pa.array(c, t) for c, t in zip(columns, kinds)], steps], ["_mk_group", "_mk_n", "level", "place", "top_level", "top_place", "top_digest", "tail"])

    return run


def finished(nodes: DataFrame, height: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(group, level, place, tail) of the given ragged nodes, and (group, digest) of the groups' roots.

    height: levels that the first blocks rise over the leaves; most: leaves of the largest group. Rounds: a RISE-th of
    the levels above.
    """
    rounds, now = [], nodes.select("_mk_group", "_mk_n", "level", "place", "digest")
    end = top(max(most, 1))
    while True:
        height = min(height, end)
        h = F.lit(height).cast("long")
        below = F.col("level") <= h
        # A node beyond its group's root's level doesn't occur, so blocks of small groups hold whole groups.
        block = F.when(below, F.expr(f"shiftright(place, cast({height} - level as int))")).otherwise(F.col("place"))
        keyed = now.withColumn("_mk_block", block).withColumn("_mk_over", F.when(below, h).otherwise(F.col("level")))
        climbed = store(keyed.filter(below).groupBy("_mk_group", "_mk_block").applyInArrow(climber(height), CLIMBED), "manifest-blocks")
        rounds.append((height, climbed))
        tops = climbed.select("_mk_group", "_mk_n", F.col("top_level").alias("level"), F.col("top_place").alias("place"), F.col("top_digest").alias("digest")).distinct()
        waiting = keyed.filter(~below).select(*now.columns)
        now = store(tops.unionByName(waiting), "manifest-nodes")
        if height == end:
            break
        height += RISE
    tails = now.select("_mk_group", "level", "place", F.lit(None).cast(STEPS).alias("rest"))
    for height, climbed in reversed(rounds):
        up = tails.select("_mk_group", F.col("level").alias("top_level"), F.col("place").alias("top_place"), "rest")
        own = climbed.join(up, ["_mk_group", "top_level", "top_place"]).select("_mk_group", "level", "place", F.concat("tail", F.coalesce("rest", F.array().cast(STEPS))).alias("rest"))
        tails = own.unionByName(tails.filter(F.col("level") > height))  # this round let those pass
    return tails, now.select("_mk_group", "digest")


def prover(carried: pa.Schema):
    """Rows of a run and its ragged nodes with their tails; out come the rows with subroot, root and proof."""
    names = carried.names

    def run(rows: pa.Table, nodes: pa.Table) -> pa.Table:
        out_schema = pa.schema([*carried, ("place", pa.int64()), ("subroot", pa.string()), ("root", pa.string()), ("proof", ARROW_STEPS)])
        if not rows.num_rows:
            return out_schema.empty_table()
        rows = rows.sort_by("_mk_place")
        first, n = rows.column("_mk_place")[0].as_py(), rows.column("_mk_n")[0].as_py()
        found = levels(rows.column("_mk_leaf").to_pylist(), first, n)
        at = {(level, place): i for i, (level, place) in enumerate(zip(nodes.column("level").to_pylist(), nodes.column("place").to_pylist()))}
        tails = [[(s["side"], s["digest"]) for s in t] for t in nodes.column("tail").to_pylist()]
        lists = []
        for low in range(0, rows.num_rows, ROWS_AT_ONCE):
            offsets, sides, digests = [0], [], []
            for place in range(first + low, first + min(low + ROWS_AT_ONCE, rows.num_rows)):
                level, here = 0, place
                while (level, here) not in at:
                    begin, row = found[level]
                    side, x = step(here, (n - 1) >> level, lambda p, b=begin, r=row: r[p - b])
                    sides.append(side)
                    digests.append(x)
                    level, here = level + 1, here >> 1
                for side, x in tails[at[level, here]]:
                    sides.append(side)
                    digests.append(x)
                offsets.append(len(sides))
            steps = pa.StructArray.from_arrays([pa.array(sides, pa.int32()), pa.array(digests, pa.string())], fields=list(ARROW_STEPS.value_type))
            lists.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), steps, type=ARROW_STEPS))
        m = rows.num_rows
        same = lambda c: pa.array([nodes.column(c)[0].as_py()] * m, pa.string())
        columns = [*rows.select(names).columns, pa.array(range(first, first + m), pa.int64()), same("subroot"), same("root"), pa.chunked_array(lists, ARROW_STEPS)]
        return pa.table(columns, schema=out_schema)

    return run


def forest(rows: DataFrame, order: str, leaf: str, group: str | None = None) -> DataFrame:
    """rows with place (in the group), subroot, root and proof (the steps from leaf to root).

    rows: any columns, of which `leaf` holds digests as hex text. Rows of a group ascend by `order`, nulls first; rows
    of one order by leaf, and rows equal in both are interchangeable. Groups ascend alike, a null group first; without a
    group there is one tree and subroot is its root. A lone row's leaf is its subroot, a lone subroot is the root, each
    with no step. An empty table gives an empty result; columns with the names of result columns are replaced.
    """
    spark = rows.sparkSession
    rows = rows.drop("place", "subroot", "root", "proof")
    by = [F.col(group).asc_nulls_first()] if group else []
    name = field(F.col(group)) if group else F.lit("")
    placed = store(rows.withColumn("_mk_row", F.monotonically_increasing_id()).withColumn("_mk_group", name), "manifest-leaves")
    n = placed.count()
    ranges = max(1, math.ceil(n / ROWS_A_RANGE), min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / 1000)))
    keys = [*by, F.col(order).asc_nulls_first(), F.col(leaf).asc(), F.col("_mk_row").asc()]
    ordered = placed.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("_mk_at", F.monotonically_increasing_id())
    ordered = store(ordered.drop("_mk_row").withColumn("_mk_part", part_of(F.col("_mk_at"))), "manifest-ranges")

    runs = ordered.groupBy("_mk_group", "_mk_part").agg(F.min("_mk_at").alias("_mk_first"), F.count("*").alias("_mk_rows"))
    before = Window.partitionBy("_mk_group").orderBy("_mk_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_mk_group")
    runs = store(runs.withColumn("_mk_before", F.coalesce(F.sum("_mk_rows").over(before), F.lit(0))).withColumn("_mk_n", F.sum("_mk_rows").over(whole)), "manifest-runs")
    place = F.col("_mk_before") + F.col("_mk_at") - F.col("_mk_first")
    leaves = ordered.join(runs.select("_mk_group", "_mk_part", "_mk_first", "_mk_before", "_mk_n"), ["_mk_group", "_mk_part"]).withColumn("_mk_place", place).withColumn("_mk_leaf", F.col(leaf)).drop("_mk_first", "_mk_before", "_mk_at")

    edges = store(leaves.select("_mk_group", "_mk_part", "_mk_place", "_mk_n", "_mk_leaf").groupBy("_mk_group", "_mk_part").applyInArrow(ragged, RAGGED), "manifest-ragged")
    most = runs.agg(F.coalesce(F.max("_mk_n"), F.lit(0))).first()[0]
    tails, roots = finished(edges, max(1, math.ceil(n / ranges)).bit_length() + RISE, most)
    if group:
        named = ordered.select("_mk_group", F.col(group).alias("named")).distinct().join(roots, "_mk_group").withColumnRenamed("_mk_group", "of")
        upper = forest(named, "named", "digest").select(F.col("of").alias("_mk_group"), F.col("digest").alias("subroot"), "root", F.col("proof").alias("_mk_up"))
    else:
        upper = roots.select("_mk_group", F.col("digest").alias("subroot"), F.col("digest").alias("root"), F.array().cast(STEPS).alias("_mk_up"))
    ends = runs.select("_mk_group", "_mk_part").join(upper, "_mk_group")
    known = edges.join(tails, ["_mk_group", "level", "place"]).join(ends, ["_mk_group", "_mk_part"]).select("_mk_group", "_mk_part", "level", "place", F.concat("rest", "_mk_up").alias("tail"), "subroot", "root")

    carried = to_arrow_schema(rows.schema)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema], "place long, subroot string, root string", f"proof {STEPS}"])
    return leaves.groupBy("_mk_group", "_mk_part").cogroup(known.groupBy("_mk_group", "_mk_part")).applyInArrow(prover(carried), schema)


def leaf_of(n_chars: Column) -> Column:
    """The leaf of a document with the given n_chars."""
    return leaf(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, place, subroot, root, proof) of every document: a tree a language, in the order of doc_id.

    Nulls in any column are fields of their own; null ids come first, rows of one id by their leaves, so repeated rows
    have leaves, places and proofs each. Further columns, whatever their names, are left out.
    """
    return forest(docs.select("doc_id", "lang", leaf_of(F.col("n_chars")).alias("leaf")), "doc_id", "leaf", "lang")


def audit(docs: DataFrame, tampered: Column, changed: Column) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): proofs of docs, held against rows that
    `tampered` marks and in which n_chars is `changed`."""
    claim = F.when(F.coalesce(tampered, F.lit(False)) & changed.isNotNull(), leaf_of(changed)).otherwise(F.col("leaf"))
    leaves = docs.withColumn("leaf", leaf_of(F.col("n_chars"))).select("doc_id", "lang", "leaf", claim.alias("claim"))
    found = forest(leaves, "doc_id", "leaf", "lang").withColumn("folded_root", fold(F.col("claim"), F.col("proof")))
    return found.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
