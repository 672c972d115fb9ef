"""Benchmark decontamination with a generalised suffix automaton.

The words of all benchmark items make one automaton, in which every state stands for word sequences that occur in the
same places of the items. A document's words are streamed through it; at each word the automaton holds the longest
sequence ending there that occurs in an item. Where that length reaches the window, the window's words are hit, and
the state names the items. Items shorter than a window count where they occur whole.

The benchmark is split into blocks of about `block_words` words, and each block's automaton is built on the driver and
broadcast, so its size is bounded whatever the benchmark's; more blocks stream the documents again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.llm.common import lean, slices

WINDOW = 10
#: Words of one automaton, about; an item is never split, so an automaton has as many words as the longest item at least.
BLOCK_WORDS = 500_000
#: Documents of which a larger share of words is hit are dropped, not cut.
MAX_COVERAGE = 0.5
#: Bytes of text that are turned into words at once.
CHUNK_BYTES = 2 << 20

#: ASCII letters in lower case and digits stay, other ASCII becomes a blank, bytes of other characters stay.
_FOLD = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_WORD = re.compile(rb"[^\x20]+")
#: Stands between documents; 0x01 is in no word.
_STOP = b"\x01"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class SuffixAutomaton:
    """The substrings of several word sequences. Built once, then only read."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {_STOP: -2}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for item, words in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            if ids:
                coded.append((item, ids))
                self._add(ids)
        self.shortest = min([window, *(len(ids) for _, ids in coded)])
        pairs = {a * len(self.vocab) + b for _, ids in coded for a, b in zip(ids, ids[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.at_window = self._at_window()
        self.window_items: dict[int, set[str]] = {}
        self.short_items: dict[int, list[tuple[int, str]]] = {}
        for item, ids in coded:
            self._name(item, ids)
        self._inherit()

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, c: int) -> int:
        """The state after p by c, of length(p) + 1: the one there is, or a copy cut off it."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._new(self.length[p] + 1)
        self.next[copy] = dict(self.next[q])
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _add(self, ids: list[int]) -> None:
        last = 0
        for c in ids:
            if c in self.next[last]:
                last = self._split(last, c)
                continue
            state, p = self._new(self.length[last] + 1), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = state
                p = self.link[p]
            self.link[state] = 0 if p < 0 else self._split(p, c)
            last = state

    def _at_window(self) -> list[int]:
        """For each state, the state on its suffix path that holds the last `window` words; -1 where it is shorter."""
        out = [-1] * len(self.link)
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            if self.length[v] >= self.window:
                out[v] = v if self.length[self.link[v]] < self.window else out[self.link[v]]
        return out

    def _name(self, item: str, ids: list[int]) -> None:
        v = 0
        for n, c in enumerate(ids, 1):
            v = self.next[v][c]
            if n >= self.window:
                self.window_items.setdefault(self.at_window[v], set()).add(item)
        if len(ids) < self.window:
            self.short_items.setdefault(v, []).append((len(ids), item))

    def _inherit(self) -> None:
        """A state also ends in the short items that its suffixes are."""
        own, self.short_items = self.short_items, {}
        if own:
            for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
                if found := own.get(v, []) + self.short_items.get(self.link[v], []):
                    self.short_items[v] = found

    def runs(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Where every word and every two neighbours occur in items, for `shortest` words at least: no match lies elsewhere."""
        known = ids >= 0
        if self.shortest > 1 and len(ids) > 1 and len(self.pairs):
            both = np.flatnonzero(known[:-1] & known[1:])
            keys = ids[both].astype(np.int64) * len(self.vocab) + ids[both + 1]
            at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            linked = np.zeros(len(ids) + 1, bool)
            linked[both[self.pairs[at] == keys] + 1] = True  # word i follows word i - 1 in an item
            edge = np.flatnonzero(np.diff(linked.astype(np.int8), prepend=0, append=0))
            yield from ((int(a) - 1, int(b)) for a, b in zip(edge[::2], edge[1::2]) if b - a + 1 >= self.shortest)
        elif self.shortest == 1:
            edge = np.flatnonzero(np.diff(known.astype(np.int8), prepend=0, append=0))
            yield from ((int(a), int(b)) for a, b in zip(edge[::2], edge[1::2]))

    def matches(self, ids: np.ndarray) -> Iterator[tuple[int, int, list[str] | set[str]]]:
        """(start, end, items) of each window and each whole short item, in the order in which they end."""
        for a, b in self.runs(ids):
            v, n = 0, 0
            for p, c in enumerate(ids[a:b].tolist(), a + 1):
                while v and c not in self.next[v]:
                    v = self.link[v]
                    n = self.length[v]
                if c in self.next[v]:
                    v, n = self.next[v][c], n + 1
                if n >= self.window:
                    yield p - self.window, p, self.window_items[self.at_window[v]]
                for k, item in self.short_items.get(v, ()):
                    if k <= n:
                        yield p - k, p, [item]

    def scan(self, texts: list[bytes | None]) -> list[tuple[int, list[int], set[str]]]:
        """For each text: words, hit ranges of words as [start, end, start, end...], items."""
        out: list[tuple[int, list[int], set[str]]] = []
        i = 0
        while i < len(texts):
            j, held = i, 0
            while j < len(texts) and (j == i or held < CHUNK_BYTES):
                held += len(texts[j] or b"")
                j += 1
            words = (b" " + _STOP + b" ").join((t or b"").translate(_FOLD) for t in texts[i:j]).split()
            ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))
            ends = np.append(np.flatnonzero(ids == -2), len(words))
            starts = np.append(0, ends[:-1] + 1)
            part = [(int(b - a), [], set()) for a, b in zip(starts, ends)]
            for a, b, items in self.matches(ids):
                d = int(np.searchsorted(ends, a, side="right"))
                _, ranges, named = part[d]
                a, b = a - int(starts[d]), b - int(starts[d])
                while ranges and ranges[-1] >= a:  # a short item may end inside and begin before what is there
                    b, a = max(b, ranges.pop()), min(a, ranges.pop())
                ranges += [a, b]
                named.update(items)
            out += part
            i = j
        return out


def joined(a: list[int], b: list[int]) -> list[int]:
    """The union of two lists of ranges."""
    out: list[int] = []
    for x, y in sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]):
        if out and x <= out[-1]:
            out[-1] = max(out[-1], y)
        else:
            out += [x, y]
    return out


def automata(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> list:
    """Broadcast automata of the items; each is collected for itself, after the benchmark's words are counted."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text"))
    words = benchmark.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    blocks = -(-words // block_words) or 1
    found = []
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).sort("item", "text").collect()  # about block_words words
        found.append(spark.sparkContext.broadcast(SuffixAutomaton([(r[0], words_of(r[1])) for r in rows], window)))
    return found


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with n_words, hit_words (ranges of word numbers, [start, end, start, end...]) and hit_items (sorted ids).

    A null or empty text has no words; repeated rows are each scanned; a benchmark without words hits nothing; columns
    of these names are replaced.
    """
    return _scanned(docs, automata(benchmark, window, block_words))


def _scanned(docs: DataFrame, models: list, names: tuple[str, str, str] = ("n_words", "hit_words", "hit_items")) -> DataFrame:
    new = [T.StructField(names[0], T.LongType()), T.StructField(names[1], T.ArrayType(T.IntegerType())), T.StructField(names[2], T.ArrayType(T.StringType()))]
    kept = docs.drop(*names)
    fields = kept.schema.fields

    def block(model, first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [row for texts in slices(batch.column("text")) for row in model.value.scan(texts)]
                ranges, items = [r for _, r, _ in found], [s for _, _, s in found]
                if not first:
                    ranges = [joined(a, b) for a, b in zip(ranges, batch.column(names[1]).to_pylist())]
                    items = [a.union(b) for a, b in zip(items, batch.column(names[2]).to_pylist())]
                added = [pa.array([n for n, _, _ in found], pa.int64()), pa.array(ranges, pa.list_(pa.int32())), pa.array([sorted(s) for s in items], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in fields] + added, [*[f.name for f in fields], *names])

        return run

    schema = T.StructType([*fields, *new])
    for k, model in enumerate(models):
        kept = kept.mapInArrow(lean(block(model, k == 0)), schema)
    return kept


def n_hit(ranges: Column) -> Column:
    ends = F.filter(ranges, lambda x, i: i % 2 == 1)
    starts = F.filter(ranges, lambda x, i: i % 2 == 0)
    return F.aggregate(F.zip_with(ends, starts, lambda b, a: b - a), F.lit(0), lambda s, n: s + n).cast("long")


def cut(text: bytes, ranges: list[int]) -> bytes:
    """text without its words in the ranges and what stands between them; one line break stays in their place."""
    at = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    out, done = [], 0
    for a, b in zip(ranges[::2], ranges[1::2]):
        out.append(text[done : at[a][0]])
        done = at[b - 1][1]
    return b"\n".join([*out, text[done:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without benchmark passages: hit words are cut out, and documents hit over max_coverage are dropped.

    A cut text is scanned again, since what is left may meet to a new passage. Other texts, null ones too, stay as
    they are. The columns are those of docs.
    """
    models = automata(benchmark, window, block_words)
    scanned = _scanned(docs, models, ("_dc_words", "_dc_hit", "_dc_items")).filter(n_hit(F.col("_dc_hit")) <= F.col("_dc_words") * max_coverage)
    fields = docs.schema.fields
    at = [f.name for f in fields].index("text")

    def clean(text: bytes, ranges: list[int]) -> str:
        while ranges:
            text = cut(text, ranges)
            ranges = []
            for model in models:
                ranges = joined(ranges, model.value.scan([text])[0][1])
        return text.decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column("_dc_hit").to_pylist()
            arrays = [batch.column(f.name) for f in fields]
            if any(hits):
                arrays[at] = pa.array((clean(t.as_py().encode(), r) if r else t.as_py() for t, r in zip(batch.column("text"), hits)), batch.column("text").type)
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in fields])

    return scanned.select(*docs.columns, "_dc_hit").mapInArrow(lean(run), docs.schema)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each document."""
    found = scan(docs.select("doc_id", "text"), benchmark, window).withColumn("n_hit", n_hit(F.col("hit_words")))
    return found.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
