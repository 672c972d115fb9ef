"""Repeated-passage removal by a sampled suffix order: every byte under a string of 400 that also starts elsewhere.

A suffix array of all positions takes several times the text. A difference cover sorts sampled suffixes first and gets
the rest from them; here the sample is chosen by content instead of position modulus (a synchronising set), so that
equal strings are sampled at equal places:

1. sample: in each string of 400 bytes, the part of 256 bytes of least hash. Starts of strings with the same sampled
   part stand together in a run; a run is named by a hash of all bytes that its strings cover.
2. sort runs by the sampled part and then by name, and compare neighbours: strings of a run that has an equal
   neighbour are repeated. Equal runs that one batch holds are compared there, before the sort. A sampled part that
   occurs once is dropped: no string around it is repeated.
3. remaining: where a sampled part occurs in runs of different names, one run of each name is read again, its strings
   of 400 are named and sorted, and neighbours compared.

Texts are written once, in buckets as they were read, and never shuffled: what is found out about a row travels to its
bucket (`in_place`). Copies of whole documents are found first and only one of them takes part. Runs cost about 1/73 of
the text's bytes in rows of 36 bytes; sorted rows are streamed, so that a run or part that very many documents share
needs no memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import found_for, in_place, lean, store

LENGTH, SAMPLED = 400, 256
#: Bytes of a document that are hashed at once; places in it take 24 bits.
CHUNK = 4 << 20
SALTS = 16  # keys over which copies of one text are dealt
#: Rows of one run or part that are held at once; runs of one part that are compared in one task.
HELD, TOGETHER = 50_000, 50_000

_RANDOM = np.random.default_rng(20240229)
_BYTES = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64."""
    held = _powers.get(str(base))
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16), base, np.uint64)
        held[0] = 1
        held = _powers[str(base)] = np.multiply.accumulate(held)
    return held[:n]


def part_hashes(text: np.ndarray, size: int) -> np.ndarray:
    """A hash of each part of `size` bytes, by its start."""
    n = len(text)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[text] * _power(_BASE, n), out=sums[1:])
    h = (sums[size:] - sums[:-size]) * _power(pow(_BASE, -1, 1 << 64), n - size + 1)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def least_in_window(keys: np.ndarray, window: int) -> np.ndarray:
    """The least key of each window, by prefix and suffix minima of blocks."""
    n = len(keys) - window + 1
    full = -(-len(keys) // window) * window
    blocks = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(keys)] = keys
    blocks = blocks.reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[window - 1 : window - 1 + n])


def runs(text: bytes, length: int = LENGTH, sampled: int = SAMPLED) -> Iterator[tuple[int, int, int, int]]:
    """(hash of the sampled part, first start, starts, name) of each run of a text, in order."""
    for at in range(0, max(1, len(text) - length + 1), CHUNK):
        piece = text[at : at + CHUNK + length - 1]
        if len(piece) < length:
            return
        h = part_hashes(np.frombuffer(piece, np.uint8), sampled)
        keys = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        chosen = (least_in_window(keys, length - sampled + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(chosen, prepend=-1))
        count = np.diff(first, append=len(chosen))
        parts = h[chosen[first]].tolist()
        for lo, n, part, place in zip(first.tolist(), count.tolist(), parts, chosen[first].tolist()):
            yield part, at + lo, n, xxhash.xxh3_64_intdigest(piece[lo : lo + n - 1 + length], seed=place - lo)


#: What is known of a run: all its strings are repeated; nothing yet; that it is repeated, and it stands for its equals.
REPEATED, OPEN, KNOWN = 0, 1, 2
RUN = "kind int, part long, name long, row long, lo int, n int"
NAMES = ["kind", "part", "name", "row", "lo", "n"]
MARK = "row long, lo int, n int"


def run_rows(length: int, sampled: int):
    """Runs; of equal runs that a batch holds only one goes on as KNOWN, and all are passed on as REPEATED, without names."""

    def emit(rows: list, parts: list, names: list) -> pa.RecordBatch:
        ids, los, ns = (np.array(c, t) for c, t in zip(zip(*rows), (np.int64, np.int32, np.int32)))
        part, name = (np.array(c, np.uint64).view(np.int64) for c in (parts, names))
        order = np.lexsort((name, part))
        same = (part[order][1:] == part[order][:-1]) & (name[order][1:] == name[order][:-1])
        again = np.append(same, False) | np.append(False, same)
        first = again & ~np.append(False, same)
        at = np.concatenate([order[~again], order[again], order[first]])
        kind = np.repeat(np.array([OPEN, REPEATED, KNOWN], np.int32), [(~again).sum(), again.sum(), first.sum()])
        nameless = kind == REPEATED
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(part[at], mask=nameless), pa.array(name[at], mask=nameless), *[pa.array(c[at]) for c in (ids, los, ns)]], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list = []
            parts: list = []
            names: list = []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text")):
                for part, lo, n, name in runs(text.as_py(), length, sampled):
                    parts.append(part)
                    names.append(name)
                    rows.append((row, lo, n))
                if len(rows) > 100_000:
                    yield emit(rows, parts, names)
                    rows, parts, names = [], [], []
            if rows:
                yield emit(rows, parts, names)

    return run


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, part, row, lo, n) of OPEN and KNOWN runs sorted by part and name.

    REPEATED rows for OPEN runs with an equal neighbour; one OPEN or KNOWN row for each name of a part that has several.
    """
    given = ["part", "row", "lo", "n"]
    held: dict[str, np.ndarray] | None = None
    many = False  # other names of the held rows' part were passed on

    def passed(kind: int, c: dict[str, np.ndarray], at: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), *[pa.array(c[k][at]) for k in given]], ["kind", *given])

    def out(c: dict[str, np.ndarray], several: bool = False) -> Iterator[pa.RecordBatch]:
        """Pass on whole runs of whole parts, or of one part that is known to have several names."""
        if not len(c["part"]):
            return
        new_part = np.append(True, c["part"][1:] != c["part"][:-1])
        new_run = new_part | np.append(True, c["name"][1:] != c["name"][:-1])
        of_run = np.cumsum(new_run) - 1
        known = c["kind"] == KNOWN
        again = (np.bincount(of_run) > 1) | (np.bincount(of_run, known) > 0)
        of_part = (np.cumsum(new_part) - 1)[new_run]
        reread = (np.bincount(of_part)[of_part] > 1) | several
        first = np.flatnonzero(new_run)
        for kind, at in ((REPEATED, np.flatnonzero(again[of_run] & ~known)), (OPEN, first[reread & ~again]), (KNOWN, first[reread & again])):
            if len(at):
                yield passed(kind, c, at)

    for batch in batches:
        if not batch.num_rows:
            continue
        c = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in NAMES}
        if held is not None:
            c = {k: np.concatenate([held[k], c[k]]) for k in NAMES}
        cut = int(np.searchsorted(c["part"], c["part"][-1]))
        if cut:
            end = int(np.searchsorted(c["part"], c["part"][0], side="right"))
            yield from out({k: v[:end] for k, v in c.items()}, many)
            yield from out({k: v[end:cut] for k, v in c.items()})
            many = False
            c = {k: v[cut:] for k, v in c.items()}
        if len(c["part"]) > HELD:
            last = int(np.argmax(c["name"] == c["name"][-1]))
            if last:
                yield from out({k: v[:last] for k, v in c.items()}, True)
                many = True
                c = {k: v[last:] for k, v in c.items()}
            if len(c["part"]) > HELD:  # one run: its rows are passed on but for one, which stands for it
                at = np.flatnonzero(c["kind"] == OPEN)
                if len(at):
                    yield passed(REPEATED, c, at)
                c = {k: v[:1].copy() for k, v in c.items()}
                c["kind"][:] = KNOWN
        held = c
    if held is not None:
        yield from out(held, many)


SPAN = ["part", "kind", "row", "lo", "n", "span"]


def span_rows(length: int):
    """(part, kind, row, lo, n, span) of the runs that are to be read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, text, again in zip(batch.column("row").to_pylist(), batch.column("text"), batch.column("again")):
                t = text.as_py()
                rows += [(r["part"], r["kind"], row, r["lo"], r["n"], t[r["lo"] : r["lo"] + r["n"] - 1 + length]) for r in again.as_py()]
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], SPAN)

    return run


def string_names(span: bytes, n: int, length: int) -> list[int]:
    return [xxhash.xxh3_128_intdigest(span[i : i + length]) for i in range(n)]


def stretches(at: list[int]) -> Iterator[tuple[int, int]]:
    """(first, how many) of the stretches of consecutive numbers."""
    i = 0
    while i < len(at):
        j = i
        while j + 1 < len(at) and at[j + 1] == at[j] + 1:
            j += 1
        yield at[i], j - i + 1
        i = j + 1


def reread(length: int):
    """(row, lo, n) of repeated strings of OPEN runs, of spans sorted by part."""

    def settle(rows: list[tuple]) -> list[tuple]:
        names = [string_names(r[5], r[4], length) for r in rows]
        order = sorted((x, i, j) for i, of_run in enumerate(names) for j, x in enumerate(of_run))
        hit: dict[int, list[int]] = {}
        for k, (x, i, j) in enumerate(order):
            if rows[i][1] == OPEN and (k and order[k - 1][0] == x or k + 1 < len(order) and order[k + 1][0] == x):
                hit.setdefault(i, []).append(j)
        return [(rows[i][2], rows[i][3] + a, n) for i, at in hit.items() for a, n in stretches(sorted(at))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        found: list[tuple] = []
        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in SPAN]):
                if group and row[0] != group[0][0]:
                    found += settle(group)
                    group = []
                group.append(row)
            if len(found) > 10_000:
                yield _marks(found)
                found = []
        found += settle(group) if group else []
        if found:
            yield _marks(found)

    return run


def _marks(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32()))], ["row", "lo", "n"])


def name_rows(length: int):
    """(name, kind, row, at) of every string, for parts with too many runs for one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, kind, row, lo, n, span in zip(*[batch.column(k).to_pylist() for k in SPAN]):
                names = [xxhash.xxh3_128_digest(span[i : i + length]) for i in range(n)]
                arrays = [pa.array(names, pa.binary()), pa.array([kind] * n, pa.int32()), pa.array([row] * n, pa.int64()), pa.array(range(lo, lo + n), pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, ["name", "kind", "row", "at"])

    return run


def united(marks: list[tuple[int, int]], length: int) -> list[list[int]]:
    """Maximal ranges of bytes under the strings that start in (first, how many)."""
    out: list[list[int]] = []
    for lo, n in sorted(marks):
        end = lo + n - 1 + length
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([lo, end])
    return out


def kept_bytes(text: bytes, ranges: list[list[int]]) -> bytes:
    at, out = 0, []
    for a, b in ranges:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def repeats(texts: DataFrame, length: int = LENGTH, sampled: int = SAMPLED) -> DataFrame:
    """(row, marks): the starts of repeated strings, as an array of (lo, n), of texts (in place) that have some."""
    parts = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    base = texts.select("_pl_part", "_pl_row", F.coalesce("text", F.lit("")).cast("binary").alias("text")).filter(F.octet_length("text") >= length)
    digests = base.select(F.col("_pl_row").alias("row"), F.octet_length("text").alias("size"), F.unhex(F.sha2("text", 256)).alias("digest"))
    same = digests.groupBy("digest").agg(F.count("*").alias("copies"), F.min("row").alias("first")).filter("copies > 1").select("digest", "first")
    dealt = same.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a text may have very many copies
    whole = store(digests.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(dealt, ["digest", "salt"]).select("row", "size", "first"), "copies")
    once = found_for(base, whole.filter("row <> first").select("row"), "left_anti").select(F.col("_pl_row").alias("row"), "text")

    found = store(once.mapInArrow(lean(run_rows(length, sampled)), RUN), "runs")
    rows = found.filter(F.col("kind") != REPEATED).repartition(parts, "part").sortWithinPartitions("part", "name", "row", "lo")
    decided = store(rows.mapInArrow(lean(neighbours), "kind int, part long, row long, lo int, n int"), "decided")
    again = decided.filter(F.col("kind") != REPEATED)
    lists = again.groupBy("row").agg(F.collect_list(F.struct("part", "kind", "lo", "n")).alias("again"))
    spans = found_for(base, lists, "inner").select(F.col("_pl_row").alias("row"), "text", "again").mapInArrow(lean(span_rows(length)), "part long, kind int, row long, lo int, n int, span binary")
    spans = store(spans, "spans")
    large = store(again.groupBy("part").count().filter(F.col("count") > TOGETHER).select("part"), "large")
    marks = decided.select("kind", "row", "lo", "n").unionByName(found.select("kind", "row", "lo", "n")).filter(F.col("kind") == REPEATED).drop("kind")
    marks = marks.unionByName(whole.select("row", F.lit(0).alias("lo"), (F.col("size") - length + 1).alias("n")))
    few = spans
    if large.head(1):
        few = spans.join(large, "part", "left_anti")
        strings = spans.join(large, "part", "left_semi").mapInArrow(lean(name_rows(length)), "name binary, kind int, row long, at int")
        twice = strings.groupBy("name").count().filter("count > 1").select("name")
        marks = marks.unionByName(strings.filter(F.col("kind") == OPEN).join(twice, "name").select("row", F.col("at").alias("lo"), F.lit(1).alias("n")))
    settled = few.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(lean(reread(length)), MARK)
    marks = marks.unionByName(settled)
    return store(marks.groupBy("row").agg(F.collect_list(F.struct("lo", "n")).alias("marks")), "marks")


def _with_marks(docs: DataFrame, length: int, sampled: int) -> DataFrame:
    texts = in_place(docs)
    marked = found_for(texts, repeats(texts, length, sampled).withColumnRenamed("marks", "_sx_marks"), "left")
    return marked.withColumn("_sx_text", F.coalesce("text", F.lit("")).cast("binary"))


def report(docs: DataFrame, length: int = LENGTH, sampled: int = SAMPLED) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of docs.

    A null text is empty; texts of under `length` bytes lose nothing; repeated rows lose all of a text long enough. Ids
    are only passed on: they may be null, repeated, or of any type. An empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [])
            for text, marks in zip(batch.column("_sx_text"), batch.column("_sx_marks")):
                t = text.as_py()
                ranges = united([(m["lo"], m["n"]) for m in marks.as_py() or ()], length)
                for c, v in zip(cols, (len(t), sum(b - a for a, b in ranges), len(ranges), hashlib.sha256(kept_bytes(t, ranges)).hexdigest())):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_marks(docs.select("doc_id", "text"), length, sampled).select("doc_id", "_sx_text", "_sx_marks").mapInArrow(lean(run), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, length: int = LENGTH, sampled: int = SAMPLED) -> DataFrame:
    """docs with repeated bytes removed from text; characters of which only some bytes are repeated become U+FFFD."""
    fields = docs.schema.fields
    at = [f.name for f in fields].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [batch.column(f.name) for f in fields]
            marks = batch.column("_sx_marks").to_pylist()
            new = [kept_bytes(t.encode(), united([(m["lo"], m["n"]) for m in ms], length)).decode(errors="replace") if ms else t for t, ms in zip(arrays[at].to_pylist(), marks)]
            arrays[at] = pa.array(new, arrays[at].type)
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in fields])

    return _with_marks(docs, length, sampled).select(*docs.columns, "_sx_marks").mapInArrow(lean(run), docs.schema)
