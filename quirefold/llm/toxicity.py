"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features are densities of two lexicons (a fixed list of insults; word beginnings that the training rows show to be
marks of either label), how near second-person words stand to lexicon words, capitals, punctuation and obfuscation.
Trees are grown on histograms of a bounded sample of labelled rows and calibrated on rows kept out of their growth.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import SLICE, lean, store

#: Labelled rows that are fitted at most, those of least hash.
SAMPLE = 6_000
#: Word beginnings in the learned lexicon at most.
LEARNED = 2_000
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 32

#: Words of insult and of address, in the languages that are looked at; fixed values.
INSULTS = frozenset("arschloch bastard bitch blöd cabrón clown con connard coward creep crétin cretin damn disgusting dumb dummkopf estúpido fool freak garbage hate idiot idiota idiote imbecile imbécil imbécile jerk kill liar loser miserable moron pathetic pendejo pig scum shit shut slut sucker stupid stupide trash trottel ugly useless vermin worthless".split())
SECOND = frozenset("you your yours yourself ya u ur tu te ti tú tus usted vosotros vous votre vos toi ton du dich dir dein deine ihr euch".split())
NEAR = 5  # words between address and insult

FEATURES = ("insults", "insult share", "marks", "mark share", "strongest mark", "sum of marks", "kinds of marks", "address", "address near insult", "capitals", "capital words", "exclamation", "punctuation", "digits", "obfuscated", "stretched", "length a word", "words")

_LETTERS = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"[^\W\d_]+[0-9@$*!]+[^\W\d_]+")
_SPACED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_][.\-*_]){3,}[^\W\d_](?![^\W\d_])")
_SPACED_LIKELY = re.compile(rb"[a-z][.\-*_][a-z][.\-*_][a-z]")
_STRETCHED = re.compile(rb"([a-z])\1\1")
_SHOUTED = re.compile(rb"[A-Z]{2,}")
_CAPITALS, _DIGITS, _POINTS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?!\"'()-*#%&$"
#: Digits and signs that stand for letters; fixed values.
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})


def without(text: bytes, chars: bytes) -> int:
    """How many of the characters text has."""
    return len(text) - len(text.translate(None, chars))


def beginnings(word: str) -> list[str]:
    return [word[:k] + ("-" if k < len(word) else "") for k in (3, 4, 5, 6) if k < len(word)] + [word]


class Lexicon:
    """Word beginnings that mark label 1, with their log odds."""

    def __init__(self, odds: dict[str, float]):
        self.odds = odds
        self.first = {g[:3] for g in odds}

    def __call__(self, word: str) -> float:
        return max((self.odds.get(b, 0.0) for b in beginnings(word)), default=0.0) if word[:3] in self.first else 0.0


def bag(text: str | None) -> set[str]:
    """The distinct beginnings of a text's words."""
    return {g for w in set(_LETTERS.findall((text or "").lower())) for g in beginnings(w)}


def strongest(counts: DataFrame, rows: tuple[int, int], pos: Column, neg: Column, most: int = LEARNED) -> Lexicon:
    """The lexicon of beginnings (g) that tell the labels apart best, in four rows or more; rows of label 0 and of label 1.

    At most `most` beginnings come to the driver.
    """
    odds = F.log((pos + 0.5) / (rows[1] + 1)) - F.log((neg + 0.5) / (rows[0] + 1))
    strong = counts.select("g", pos.alias("pos"), odds.alias("odds")).filter((odds > 2.0) & (pos + neg >= 4))
    best = strong.orderBy((F.col("odds") * F.sqrt("pos")).desc(), "g").limit(most).collect()
    return Lexicon({r["g"]: r["odds"] for r in best})


def features(text: str | None, marks: Lexicon) -> list[float]:
    """The dense features of a whole text, in the order of FEATURES; an empty or null text has zeros."""
    text = text or ""
    low, raw = text.lower(), text.encode()
    small = raw.lower()
    words = _LETTERS.findall(low)
    n, size = len(words) or 1, len(raw) or 1
    counts = Counter(words)
    digits, points = without(raw, _DIGITS), without(raw, _POINTS)
    obfuscated = _MIXED.findall(low) if digits or points else []
    if _SPACED_LIKELY.search(small):
        obfuscated += _SPACED.findall(low)
    hidden = sum(x.translate(_LEET) in INSULTS for x in obfuscated)
    insults = sum(counts[w] for w in INSULTS if w in counts) + hidden
    mark, kinds, strongest, total = 0, 0, 0.0, 0.0
    first = marks.first
    for w, k in counts.items():
        if w[:3] in first and (best := marks(w)):
            mark += k
            kinds += 1
            total += best * k
            strongest = max(strongest, best)
    near = 0
    if insults and not SECOND.isdisjoint(counts):
        at = [i for i, w in enumerate(words) if w in INSULTS]
        near = sum(not SECOND.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1]) for i in at)
    stretched = sum(1 for _ in _STRETCHED.finditer(small))
    shouted = sum(1 for _ in _SHOUTED.finditer(raw))
    return [insults, insults / n, mark, mark / n, strongest, total / n, kinds, sum(counts[w] for w in SECOND if w in counts) / n, near / n, without(raw, _CAPITALS) / size, shouted / n, raw.count(b"!") / size, points / size, digits / size, len(obfuscated) / n, stretched / n, size / n, len(words)]


class Trees:
    """Boosted regression trees for a 0/1 label, split on histograms; Newton steps on the logistic loss."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, least: int = 20):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.grown: list[tuple[list[int], list[float], list[float]]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        p = min(max(float(y.mean()) if len(y) else 0.0, 1e-3), 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        if len(set(y.tolist())) < 2:
            return self
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        coded = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-score))
            tree, leaf = self._grow(coded, cuts, y - q, q * (1 - q))
            self.grown.append(tree)
            score += np.array(tree[2])[leaf]
        return self

    def _grow(self, coded: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray):
        """A full binary tree as (feature, threshold, value) by heap position; feature -1 sends all to the left."""
        n = 2 ** (self.depth + 1) - 1
        feature, threshold, value = [-1] * n, [np.inf] * n, [0.0] * n
        at = np.zeros(len(g), np.int64)
        width = self.bins + 1
        for node in range(2**self.depth - 1):
            rows = np.flatnonzero(at == node)
            at[rows] = 2 * node + 1
            best = (1e-6, -1, 0)
            if len(rows) >= 2 * self.least:
                gt, ht = g[rows].sum(), h[rows].sum()
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    code = coded[rows, j]
                    gl = np.cumsum(np.bincount(code, g[rows], width))[: len(c)]
                    hl = np.cumsum(np.bincount(code, h[rows], width))[: len(c)]
                    nl = np.cumsum(np.bincount(code, minlength=width))[: len(c)]
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    gain[(nl < self.least) | (len(rows) - nl < self.least)] = -1
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k)
            if best[1] >= 0:
                feature[node], threshold[node] = best[1], float(cuts[best[1]][best[2]])
                at[rows[coded[rows, best[1]] > best[2]]] = 2 * node + 2
        for node in range(2**self.depth - 1, n):
            rows = at == node
            value[node] = float(self.rate * g[rows].sum() / (h[rows].sum() + 1))
        return (feature, threshold, value), at

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, threshold, value in self.grown:
            f, t, v = np.array(feature), np.array(threshold), np.array(value)
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                j = f[at]
                right = (j >= 0) & (x[np.arange(len(x)), np.maximum(j, 0)] > t[at])
                at = 2 * at + 1 + right
            out += v[at]
        return out


class Isotonic:
    """A non-decreasing function from scores to shares of label 1: pooled adjacent violators, straight lines between pools."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        pools: list[tuple[float, float, float, float]] = []  # lowest and highest score, sum of labels, rows
        for s, v in sorted(zip(score.tolist(), y.tolist())):
            pool = (s, s, v, 1.0)
            while pools and (pools[-1][1] == pool[0] or pools[-1][2] * pool[3] >= pool[2] * pools[-1][3]):
                low, _, labels, n = pools.pop()
                pool = (low, pool[1], labels + pool[2], n + pool[3])
            pools.append(pool)
        self.at = np.array([x for p in pools for x in p[:2]])
        self.share = np.array([p[2] / p[3] for p in pools for _ in range(2)])
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.at, self.share) if len(self.at) else np.zeros(len(score))


class Model:
    """Lexicon, trees and calibration from rows (fold, features, label), features worked out with lexicons of other folds.

    The score that calibrates a row comes from trees of the other folds, so that neither lexicon nor trees have seen
    its label.
    """

    FOLDS = 4

    def fit(self, rows: list[tuple[int, list[float], int]], marks: Lexicon) -> Model:
        fold = np.array([f for f, _, _ in rows], np.int64)
        y = np.array([label for _, _, label in rows], np.float64)
        x = np.array([v for _, v, _ in rows], np.float64).reshape(-1, len(FEATURES))
        out = np.zeros(len(rows))
        for k in range(self.FOLDS):
            out[fold == k] = Trees().fit(x[fold != k], y[fold != k]).score(x[fold == k])
        self.scale = Isotonic().fit(out, y)
        self.trees = Trees().fit(x, y)
        self.marks = marks
        return self

    def predict(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([features(t, self.marks) for t in texts], np.float64).reshape(-1, len(FEATURES))
        return np.clip(self.scale(self.trees.score(x)), 0.0, 1.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE) -> DataFrame:
    """(key, fold, text, y) of the labelled training rows, `most` of least hash. A document with more labels counts once."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("string").alias("key")).agg((F.max(label) > 0).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("key"), "key").limit(most)
    found = docs.select(F.col("doc_id").cast("string").alias("key"), "text").join(F.broadcast(chosen), "key")  # at most `most` ids
    rows = found.groupBy("key", "y").agg(F.min("text").alias("text"))
    return rows.withColumn("fold", (F.crc32(F.concat(F.lit("fold "), "key").cast("binary")) % Model.FOLDS).cast("int"))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """The model of `label` toxic. Texts stay where they are: the driver sees counts of rows, the strongest beginnings, and one row of features for each row of the sample."""
    rows = store(sample(docs, labels, "toxic", most), "toxicity-sample")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fold, y, text in zip(batch.column("fold").to_pylist(), batch.column("y").to_pylist(), batch.column("text")):
                found = sorted(bag(text.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([fold] * len(found), pa.int32()), pa.array([y] * len(found), pa.int32())], ["g", "fold", "y"])

    times = lambda y, k: F.count_if((F.col("y") == y) & (F.col("fold") == k)).alias(f"n{y}{k}")
    each = [times(y, k) for y in (0, 1) for k in range(Model.FOLDS)]
    counts = store(rows.select("fold", "y", "text").mapInArrow(lean(spread), "g string, fold int, y int").groupBy("g").agg(*each).filter(" + ".join(f"n{y}{k}" for y in (0, 1) for k in range(Model.FOLDS)) + " >= 4"), "toxicity-counts")
    size = rows.agg(*each).first()
    marks = []
    for left_out in (*range(Model.FOLDS), None):
        kept = [k for k in range(Model.FOLDS) if k != left_out]
        total = lambda y, kept=kept: sum((F.col(f"n{y}{k}") for k in kept), F.lit(0))
        marks.append(strongest(counts, tuple(sum(size[f"n{y}{k}"] for k in kept) for y in (0, 1)), total(1), total(0)))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py(), marks[f]) for t, f in zip(batch.column("text"), batch.column("fold").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("fold"), pa.array(x, pa.list_(pa.float64())), batch.column("y")], ["key", "fold", "x", "y"])

    found = rows.select("key", "fold", "text", "y").mapInArrow(lean(described), "key string, fold int, x array<double>, y int").collect()  # `most` rows at most
    return Model().fit([(r["fold"], [float(v) for v in r["x"]], r["y"]) for r in sorted(found)], marks[-1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs. Null and empty texts are scored as texts without words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            p = np.concatenate([shared.value.predict(texts.slice(i, SLICE).to_pylist()) for i in range(0, len(texts), SLICE)] or [np.empty(0)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, score double, predicted int")


def train_and_score(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs, by a model of the labelled rows that aren't held out.

    Without labels, or with one label only, every text gets the share of label 1 in the sample (0 without any). Null
    and empty texts are scored as texts without words; repeated rows are each scored and count once in the sample; a
    null id is held out; other columns, whatever their names, are not read.
    """
    return score(docs, train(docs, labels, most))
