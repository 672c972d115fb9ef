"""N-gram Jaccard join at a threshold of 0.8 over distinct word shingles, exact, with a count-vector R-tree.

Shingles are hashed into groups. Two sets with a Jaccard similarity of t or more differ in few shingles, fewer than
there are groups, so the contents of some group agree: documents meet where a group of two shingles or more has equal
contents (`signatures`; sets with too many smaller groups for that argument also meet by the least hashes of a prefix).
Where documents meet, the counts of shingles in groups, about one shingle a group, make each a point. An R-tree over
points of eight groups put together, and then the points themselves, bound the overlap of a set with all sets under a
node by the summed minima of coordinates; the pairs that survive are verified by their shingles (`CountTree`, `linked`,
`near_pairs`).

Documents of equal shingle sets count as one from the start. The first round, a shortcut over a few of the places,
compares every document with those that share the same most frequent meeting document. Components of verified links
then stand for their members, and the second round compares only what meets in different components: of two components
first the likeliest pair, and their other pairs only if that one isn't linked. Links inside a component need no further
pair, so large groups of copies never give all their pairs, and no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.llm.common import found_for, in_place, lean, ranked, store
from quirefold.llm.components import components

WORDS, SHARE = 5, (4, 5)  # words of a shingle; Jaccard threshold as a fraction
LEAST_GROUPS, MOST_GROUPS = 64, 1 << 13  # coordinates of a count vector, a power of two
COARSER = 8  # groups of a point that are put together for the tree
MARKED = 16  # groups of a band whose places choose the partners of the first round
LEAF = 16
TILE = 1024  # documents compared in one task at once
NODES_TO_BROADCAST = 2_000_000  # 8 bytes each
SALTS = 8  # keys over which copies of one set are dealt when they get their names
#: Where a meeting place holds more documents than this, its member list is no longer compared with those of others.
LONG = 100_000

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; of all words where there are fewer; none without words."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if len(h) < WORDS:
        return mixed(np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64))
    n = len(h) - WORDS + 1
    total = h[:n] * _ODD[0]
    for i in range(1, WORDS):
        total += h[i : n + i] * _ODD[i]
    out = mixed(total)
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def bands() -> list[int]:
    """Largest sizes of the bands: each is at least as wide as the sizes that one set's partners may have."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return out


TOPS = np.array(bands(), np.int64)


def differing(n: int, other: int) -> int:
    """Most shingles in which linked sets of n and at most `other` shingles differ."""
    a, b = SHARE
    return (n + other) * (b - a) // (b + a)


def marked(places: np.ndarray, on: np.ndarray) -> np.ndarray:
    """Places with their lowest bit set where they serve the first round as well."""
    return (places & ~np.uint64(1)) | on.astype(np.uint64)


def signatures(s: np.ndarray) -> np.ndarray:
    """Places where sets meet: linked sets have one in common, if both have two shingles or more."""
    n, out = len(s), []
    a, b = SHARE
    own = int(np.searchsorted(TOPS, n))
    short = False
    for band in (own, own + 1):
        top = int(TOPS[band])
        most = differing(n, min(top, n * b // a))
        groups = differing(top, top) * 6 // 5 + 1
        group = ((s >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
        first = np.flatnonzero(np.diff(group, prepend=np.uint64(1 << 63)))
        held = np.diff(first, append=n)
        full = held > 1
        sums = np.add.reduceat(mixed(s + np.uint64(band + 1)), first)[full]
        at = group[first][full]
        out.append(marked(mixed(sums + mixed(at * np.uint64(131) + np.uint64(band))), at < MARKED))
        short |= groups - int(full.sum()) >= groups - most
    if short:  # too many groups of one or none for one of two or more to be left alone for sure
        least = mixed(s[: n - -(-n * a // b) + 1] ^ np.uint64(0x5851F42D4C957F2D))
        out.append(marked(least, np.arange(len(least)) < MARKED))
    return np.concatenate(out)


def counts(s: np.ndarray) -> np.ndarray:
    """Shingles in each of about as many groups as there are shingles, a power of two."""
    size = min(MOST_GROUPS, max(LEAST_GROUPS, 1 << (len(s) * 3 // 4).bit_length()))
    return np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.int32)


def packed(v: np.ndarray) -> bytes:
    """The number of counts, as a power of two, and the counts: two in a byte where all are small, else as planes of bytes, the lowest first."""
    log = len(v).bit_length() - 1
    if v.max() < 16:
        small = v.astype(np.uint8)
        return bytes([128 | log]) + (small[::2] | small[1::2] << 4).tobytes()
    out = [bytes([log]), (v & 255).astype(np.uint8).tobytes()]
    while (v := v >> 8).any():
        out.append((v & 255).astype(np.uint8).tobytes())
    return b"".join(out)


def unpacked(planes: bytes) -> np.ndarray:
    size = 1 << (planes[0] & 127)
    if planes[0] & 128:
        two = np.frombuffer(planes, np.uint8, size // 2, 1)
        out = np.empty(size, np.int32)
        out[::2], out[1::2] = two & 15, two >> 4
        return out
    out = np.frombuffer(planes, np.uint8, size, 1).astype(np.int32)
    for k in range(1 + size, len(planes), size):
        out += np.frombuffer(planes, np.uint8, size, k).astype(np.int32) << (8 * (k // size))
    return out


def folded(vectors: list[np.ndarray]) -> np.ndarray:
    """Count vectors as rows of a table, the finer folded to the coarsest."""
    size = min(map(len, vectors))
    return np.stack([v if len(v) == size else v.reshape(-1, size).sum(axis=0) for v in vectors])


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    a, b = SHARE
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if len(small) * b < len(large) * a:
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    same = int((large[at] == small).sum())
    return same * b >= a * (len(x) + len(y) - same)


def near_among(points: np.ndarray, sizes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The points whose overlap with q may be large enough, by the summed minima of coordinates. sizes: sums of the points."""
    a, b = SHARE
    return np.flatnonzero(np.minimum(points, q).sum(axis=1) * (a + b) >= a * (int(q.sum()) + sizes))


class CountTree:
    """A packed R-tree of count vectors: points sorted by size and tiled into leaves, boxes of the leaves above them."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.sizes = points.sum(axis=1)
        order = np.lexsort((points.argmax(axis=1), self.sizes))
        self.leaves = [order[i : i + LEAF] for i in range(0, len(order), LEAF)]
        self.top = np.stack([points[leaf].max(axis=0) for leaf in self.leaves])
        self.least = np.array([self.sizes[leaf].min() for leaf in self.leaves])

    def near(self, i: int) -> np.ndarray:
        """Points whose overlap with point i may be large enough."""
        a, b = SHARE
        q, n = self.points[i], int(self.sizes[i])
        bound = np.minimum(self.top, q).sum(axis=1)
        leaves = np.flatnonzero(bound * (a + b) >= a * (n + self.least))
        if not len(leaves):
            return leaves
        found = np.concatenate([self.leaves[k] for k in leaves])
        bound = np.minimum(self.points[found], q).sum(axis=1)
        return found[bound * (a + b) >= a * (n + self.sizes[found])]


def linked(sets: list[np.ndarray], group: list[int] | None = None) -> list[tuple[int, int]]:
    """Verified pairs that join the sets into components; sets of equal `group` count as joined before."""
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    if group is not None:
        seen: dict[int, int] = {}
        for i, g in enumerate(group):
            root[i] = seen.setdefault(g, i)
    tree = CountTree(folded([counts(s) for s in sets]))
    out = []
    for i in range(len(sets)):
        near = tree.near(i)
        for j in np.sort(near[near < i]).tolist():
            if find(i) != find(j) and similar(sets[i], sets[j]):
                root[find(i)] = find(j)
                out.append((i, j))
    return out


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, one table after the other, of batches sorted by keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for x, y in zip(cuts, cuts[1:]):
            key = tuple(c[x] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(x, y - x))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, key): the size of the shingle set, and a 128-bit hash of it."""
    for batch in batches:
        n, key = [], []
        for t in batch.column("text"):
            s = shingles(t.as_py())
            n.append(len(s))
            key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(key, pa.binary())], ["doc_id", "n", "key"])


def place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, node): signatures of every set, once a task for equal sets."""
    seen: set[bytes] = set()
    for batch in batches:
        places, nodes, held = [], [], 0
        for node, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            s = shingles(t.as_py())
            if node is None or len(s) < 2 or (key := xxhash.xxh3_128_digest(s.tobytes())) in seen:
                continue
            seen.add(key)
            places.append(signatures(s))
            nodes.append(np.full(len(places[-1]), node, np.int64))
            held += len(places[-1])
            if held > 200_000:
                yield _places(places, nodes)
                places, nodes, held = [], [], 0
        if places:
            yield _places(places, nodes)


def _places(places: list[np.ndarray], nodes: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(places).view(np.int64)), pa.array(np.concatenate(nodes))], ["place", "node"])


MET = "place long, first long, second long, size long, nodes array<long>"


def meeting_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, first, second, size, nodes) where two nodes or more meet, of (place, node) sorted.

    first and second are a hash of the nodes, so that places of equal nodes can be put together. A place that more than
    LONG nodes share comes in parts.
    """
    place, nodes = np.empty(0, np.int64), np.empty(0, np.int64)
    split: int | None = None  # the one place that is being passed on in parts

    def out(p: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(p):
            return
        first = np.flatnonzero(np.diff(p, prepend=p[0] - 1))
        size = np.diff(first, append=len(p))
        keep = size > 1
        if split is not None:
            keep |= p[first] == split
        if not keep.any():
            return
        u = n.view(np.uint64)
        one, two = (np.add.reduceat(mixed(u * _ODD[k] + _ODD[k + 1]), first)[keep].view(np.int64) for k in (0, 2))
        if split is not None:  # parts of a place are never put together with other places
            own = mixed(p[first][keep].view(np.uint64)).view(np.int64)
            one = np.where(p[first][keep] == split, one ^ own, one)
        rows = np.repeat(keep, size)
        ends = np.cumsum(size[keep], dtype=np.int64)
        lists = pa.LargeListArray.from_arrays(np.append(0, ends), pa.array(n[rows])).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(p[first][keep]), pa.array(one), pa.array(two), pa.array(size[keep].astype(np.int64)), lists], ["place", "first", "second", "size", "nodes"])

    for batch in batches:
        p, n = batch.column("place").to_numpy(), batch.column("node").to_numpy()
        p, n = np.concatenate([place, p]), np.concatenate([nodes, n])
        if not len(p):
            continue
        fresh = np.ones(len(p), bool)
        fresh[1:] = (p[1:] != p[:-1]) | (n[1:] != n[:-1])
        p, n = p[fresh], n[fresh]
        done = int(np.searchsorted(p, p[-1]))
        if len(p) - done > LONG:
            yield from out(p[:done], n[:done])
            split = int(p[-1])
            yield from out(p[done:], n[done:])
            place, nodes = p[-1:], n[-1:]  # repeated once, which does no harm
        else:
            yield from out(p[:done], n[:done])
            split = split if split == int(p[-1]) else None
            place, nodes = p[done:], n[done:]
    yield from out(place, nodes)


def hub_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, hub, n) of (place, node) sorted by place with a place's hub first: how often they meet, counted by batch."""
    place = hub = None
    for batch in batches:
        if not batch.num_rows:
            continue
        p, n = batch.column("place").to_numpy(), batch.column("node").to_numpy()
        first = np.flatnonzero(np.append(p[0] != place, p[1:] != p[:-1]))
        lead = np.repeat(n[first], np.diff(first, append=len(p)))
        lead = np.concatenate([np.full(len(p) - len(lead), hub if hub is not None else 0, np.int64), lead])
        place, hub = p[-1], lead[-1]
        order = np.lexsort((lead, n))
        a, b = n[order], lead[order]
        at = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        often = np.diff(at, append=len(a))
        kept = a[at] != b[at]
        yield pa.RecordBatch.from_arrays([pa.array(a[at][kept]), pa.array(b[at][kept]), pa.array(often[kept])], ["node", "hub", "n"])


def profile_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, shingles, vector): the sorted hashes, 8 bytes each, and their count vector."""
    for batch in batches:
        sets = [shingles(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([packed(counts(s)) for s in sets], pa.binary())], ["node", "shingles", "vector"])


def link_rows(keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, keys):
            if rows.num_rows < 2:
                continue
            nodes = rows.column("node").to_pylist()
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("shingles")]
            group = rows.column("component").to_pylist() if "component" in rows.column_names else nodes
            pairs = [(nodes[i], nodes[j]) for i, j in linked(sets, group)]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], ["a", "b"])

    return run


PAIR = ["a", "b", "ca", "cb", "share", "more"]


def likeliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the pairs of each batch the one of greatest share for every two components; more tells that there are others."""
    for batch in near_pairs(batches):
        c = np.stack([batch.column(k).to_numpy() for k in PAIR])
        c = c[:, np.lexsort((c[1], c[0], -c[4], c[3], c[2]))]
        first = np.flatnonzero(np.append(True, (c[2:4, 1:] != c[2:4, :-1]).any(axis=0)))
        other = np.append(False, (c[:2, 1:] != c[:2, :-1]).any(axis=0))
        out = c[:, first]
        out[5] = [other[i + 1 : j].any() for i, j in zip(first, np.append(first[1:], c.shape[1]))]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], PAIR)


def near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, ca, cb, share, more) of nodes in different components at one place whose count vectors let them be linked.

    ca and cb are the components, the lower first; share is the Jaccard similarity that the counts allow at most, more 0.
    Rows come sorted by (place, x, y). A place of one leaf needs no tree: its points are compared with each other.
    """
    names = ["place", "x", "y", "node", "component", "tile"]
    held: tuple[np.ndarray, list[bytes]] | None = None
    found: list[np.ndarray] = []

    def square(rows: np.ndarray, planes: list[bytes]) -> None:
        _, x, y, nodes, part, tile = rows
        if len(nodes) < 2 or (part == part[0]).all():
            return
        cross = x[0] != y[0]
        points = folded([unpacked(v) for v in planes])
        sizes = points.sum(axis=1)
        coarse = points.reshape(len(points), COARSER, -1).sum(axis=1)
        tree = CountTree(coarse) if len(points) > LEAF else None
        for i in range(1, len(nodes)):
            if tree:
                near = tree.near(i)
                near = near[near < i]
            else:
                near = near_among(coarse[:i], sizes[:i], coarse[i])
            near = near[part[near] != part[i]]
            near = near[tile[near] != tile[i]] if cross else near
            near = near[near_among(points[near], sizes[near], points[i])] if len(near) else near
            if len(near):
                common = np.minimum(points[near], points[i]).sum(axis=1)
                share = common * 1_000_000 // (sizes[near] + sizes[i] - common)
                found.append(np.stack([np.maximum(nodes[near], nodes[i]), np.minimum(nodes[near], nodes[i]), np.minimum(part[near], part[i]), np.maximum(part[near], part[i]), share, np.zeros(len(near), np.int64)]))

    def pairs() -> pa.RecordBatch:
        out = np.concatenate(found, axis=1)
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in out], PAIR)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in names])
        planes = batch.column("vector").to_pylist()
        if held is not None:
            rows, planes = np.concatenate([held[0], rows], axis=1), held[1] + planes
        cuts = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0)) + 1
        ends = [0, *cuts.tolist()]
        for lo, hi in zip(ends, ends[1:]):
            square(rows[:, lo:hi], planes[lo:hi])
        held = rows[:, ends[-1] :], planes[ends[-1] :]
        if found:
            yield pairs()
    if held is not None:
        square(*held)
    if found:
        yield pairs()


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(batch.column("sa"), batch.column("sb"))]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs (doc_id, text).

    A null or empty text has no shingles and is linked with nothing, also not with another empty one; a null id is
    linked with nothing. Rows of equal id are one document whose links unite. Repeated rows each give a row. Ids of any
    type that has an order will do: whole numbers stand for themselves, others for their ranks.
    """
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return _joined(docs)
    ids = store(ranked(docs.filter("doc_id is not null").select("doc_id").distinct(), [F.col("doc_id").asc()], "_ja_rank"), "ids")
    by_rank = docs.select("doc_id", "text").join(ids, "doc_id", "left").select(F.col("_ja_rank").alias("doc_id"), "text")
    name = lambda c: ids.select(F.col("_ja_rank").alias(c), F.col("doc_id").alias(f"_ja_{c}"))
    found = _joined(by_rank).join(name("doc_id"), "doc_id", "left").join(name("component_id"), "component_id", "left")
    return found.select(F.col("_ja_doc_id").alias("doc_id"), "n_shingles", F.col("_ja_component_id").alias("component_id"))


def _joined(docs: DataFrame) -> DataFrame:
    """`join` of whole numbers as ids."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    sets = store(texts.mapInArrow(lean(set_rows), "doc_id long, n long, key binary"), "sets")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    places = texts.mapInArrow(lean(place_rows), "place long, node long").repartition(parts, "place").sortWithinPartitions("place", "node")
    found_places = places.mapInArrow(lean(meeting_rows), MET)
    # Places of equal nodes count once; one that serves the first round stands for them if there is one.
    meetings = store(found_places.groupBy("first", "second", "size").agg(F.max_by("place", F.struct(F.col("place").bitwiseAND(F.lit(1)), "place")).alias("place"), F.first("nodes").alias("nodes")).select("place", "size", "nodes"), "meetings")
    met = meetings.select("place", "size", F.explode("nodes").alias("node"))
    known = store(met.select("node").distinct(), "met-nodes")
    small = F.broadcast(known) if known.count() <= NODES_TO_BROADCAST else known
    profiles = in_place(texts.join(small.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").mapInArrow(lean(profile_rows), "node long, shingles binary, vector binary"))
    at = store(profiles.select("node", F.col("_pl_row").alias("row")), "profile-rows")

    # First round: every node with those that share its most frequent hub, over the marked places. A place's hub is its
    # most central node, the one that meets most others: of an original and its edited copies that is the original.
    first_met = meetings.filter("place % 2 <> 0").select("place", "size", F.explode("nodes").alias("node"))
    central = first_met.groupBy("node").agg(F.sum("size").alias("meets"))
    by_meets = first_met.select("place", "node").join(central, "node").repartition(parts, "place").sortWithinPartitions("place", F.col("meets").desc(), "node")
    often = by_meets.select("place", "node").mapInArrow(lean(hub_rows), "node long, hub long, n long").groupBy("node", "hub").agg(F.sum("n").alias("n"))
    hubs = store(often.groupBy("node").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("hub")), "hubs")
    tiles = hubs.groupBy("hub").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    members = hubs.join(tiles, "hub").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).select("hub", "tile", "node")
    heads = tiles.select("hub", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.col("hub").alias("node"))
    wanted = members.unionByName(heads).join(at, "node").drop("node")
    blocks = found_for(profiles, wanted, "inner").select("hub", "tile", "node", "shingles").repartition(parts, "hub", "tile").sortWithinPartitions("hub", "tile", F.col("node") != F.col("hub"), "node")
    first = store(blocks.mapInArrow(lean(link_rows(["hub", "tile"])), "a long, b long"), "links")

    # Of equal sets only those that stand for their copies in some task take part; copies get their name at the end.
    rows = sets.filter("key is not null and doc_id is not null")
    copied = store(rows.groupBy("key", "n").agg(F.min("doc_id").alias("b"), F.count("*").alias("c")).filter("c > 1").select("key", "n", "b"), "copied")
    twice = rows.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    standing = rows.join(known.withColumnRenamed("node", "doc_id").unionByName(twice).distinct(), "doc_id", "left_semi")
    equal = standing.join(copied, ["key", "n"]).filter("doc_id <> b").select(F.col("doc_id").alias("a"), "b")
    links = store(first.unionByName(equal), "links")
    found = components(links)

    # Second round: what meets in different components.
    apart = store(met.select("place", "node").join(found, "node", "left").select("place", "node", F.coalesce("component", "node").alias("component")), "apart")
    pair = ", ".join(f"{c} long" for c in PAIR)

    def squares(rows: DataFrame) -> DataFrame:
        """Rows of places with several components, with their vectors, in squares of TILE by TILE nodes."""
        mixed_places = rows.groupBy("place").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("place", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
        left = rows.join(mixed_places, "place").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("o")
        dealt = left.select("place", "node", "component", "tile", other).select("place", "node", "component", "tile", F.least("tile", "o").alias("x"), F.greatest("tile", "o").alias("y"))
        full = found_for(profiles, dealt.join(at, "node").drop("node"), "inner").select("place", "node", "component", "tile", "x", "y", "vector")
        return full.repartition(parts, "place", "x", "y").sortWithinPartitions("place", "x", "y", "node")

    def linked_of(some: DataFrame) -> DataFrame:
        one = found_for(profiles, some.join(at, F.col("a") == F.col("node")).select("a", "b", "row"), "inner").select("a", "b", F.col("shingles").alias("sa"))
        both = found_for(profiles, one.join(at, F.col("b") == F.col("node")).select("a", "b", "sa", "row"), "inner").select("a", "b", "sa", F.col("shingles").alias("sb"))
        return store(both.mapInArrow(lean(verified), "a long, b long"), "links")

    # Of two components first the pair that looks most alike, wherever it meets; all pairs only where they stay apart.
    best = squares(apart).mapInArrow(lean(likeliest), pair).groupBy("ca", "cb").agg(F.max_by(F.struct("a", "b"), F.struct("share", "a", "b")).alias("p"), ((F.max("more") > 0) | (F.min(F.struct("a", "b")) != F.max(F.struct("a", "b")))).alias("more"))
    best = store(best, "best-pairs")
    likely = linked_of(best.select("p.a", "p.b"))
    links = links.unionByName(likely)
    final = components(links) if likely.head(1) else found
    label = lambda c: final.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    apart_still = best.filter("more").join(label("ca"), "ca", "left").join(label("cb"), "cb", "left").filter(F.coalesce("of_ca", "ca") != F.coalesce("of_cb", "cb"))
    apart_still = store(apart_still.select("ca", "cb", F.col("p.a").alias("ra"), F.col("p.b").alias("rb")), "apart-still")
    if apart_still.head(1):
        # Components that may still be linked make clusters, and each has one tree of all its nodes.
        cluster = components(apart_still.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("place"))
        members = apart.select("node", "component").distinct().join(cluster, "component").select("place", "node", "component")
        others = squares(members).mapInArrow(lean(near_pairs), pair)
        others = others.join(apart_still, ["ca", "cb"]).filter("a <> ra or b <> rb").select("a", "b").distinct()
        rest = linked_of(store(others, "pairs"))
        if rest.head(1):
            final = components(links.unionByName(rest))
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    of_key = copied.join(final, copied["b"] == final["node"], "left").select("key", "n", F.coalesce("component", "b").alias("of_key"), salt.alias("salt"))
    named = sets.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(of_key, ["key", "n", "salt"], "left").join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("of_key", "component", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the documents that are linked to one of smaller id, and without repetitions of an id with its text.

    The ids that go are found by `join`. Rows of one id are one document, whose different texts all stay; null ids
    stay.
    """
    gone = join(docs).filter("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = store(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated-ids")
    if not again.head(1):
        return kept
    once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, "doc_id", "left_anti").unionByName(once).select(*docs.columns)
