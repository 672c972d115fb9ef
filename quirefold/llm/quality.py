"""Quality classifier from weak labels: labellers that overlap, their accuracies by EM, and a hashed linear scorer.

Each labeller looks at one trait of a text and votes good, bad or nothing. Expectation-maximisation over the counts of
vote patterns of all documents estimates, without true labels, how each labeller votes on good and on bad texts, and
so the posterior of every pattern. The posteriors of a bounded sample of documents then train a logistic scorer over
hashed features (shapes of tokens, bucketed traits), which scores all documents.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.llm.common import lean, slices

#: Documents that train the scorer at most, those of least hash.
SAMPLE = 6_000
SLOTS = 1 << 12
PRIOR_GOOD = 0.8
FIRST_ACCURACY, LEAST_ACCURACY, MOST_ACCURACY = 0.9, 0.55, 0.995
GOOD, BAD, NOTHING = "1", "0", "-"

#: (trait, from, to, vote) of the labellers: inside the range a labeller votes so, else and on short texts not at all.
RULES = (
    ("symbols", 0.03, 1.0, BAD),
    ("capitals", 0.40, 1.0, BAD),
    ("repeated", 0.15, 1.0, BAD),
    ("runs", 0.10, 1.0, BAD),
    ("packed", 0.0, 0.20, BAD),
    ("top word", 0.35, 1.0, BAD),
    ("bare signs", 0.20, 1.0, BAD),
    ("shouts", 0.08, 1e9, BAD),
    ("odd endings", 0.15, 1.0, BAD),
    ("long words", 0.10, 1.0, BAD),
    ("strain", 0.0, 1.0, GOOD),
    ("strained end", 0.0, 1.0, GOOD),
)
#: What clean prose has of a trait at most; strain is the largest share of these limits that a text uses up.
CLEAN = {"symbols": 0.01, "capitals": 0.15, "repeated": 0.05, "top word": 0.25, "bare signs": 0.05, "shouts": 0.02}
LEAST_WORDS = 8

#: Capitals become A, other letters and bytes of other characters a, digits 9, blanks a space; signs stay.
_SHAPE = bytes(0x41 if 0x41 <= c <= 0x5A else 0x61 if c >= 0x80 or 0x61 <= c <= 0x7A else 0x39 if 0x30 <= c <= 0x39 else 0x20 if c <= 0x20 else c for c in range(256))
_SYMBOLS = b"#$%&*|<>{}[]~^=\\@_+"
_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _count(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def traits(text: bytes | None) -> tuple[dict[str, float], Counter, int]:
    """The labellers' traits, the shapes of tokens with runs of equal characters cut to one, and the number of words."""
    text = text or b""
    words = text.split()
    n = len(words)
    flat = np.frombuffer(text.translate(_SHAPE), np.uint8)
    squeezed = flat[np.append(True, flat[1:] != flat[:-1])].tobytes() if len(flat) else b""
    shapes = Counter(squeezed.split())
    letters = _count(text, _LETTERS) or 1
    share = lambda k: k / (n or 1)
    found = {
        "symbols": _count(text, _SYMBOLS) / (len(text) or 1),
        "capitals": _count(text, _LETTERS[:26]) / letters,
        "repeated": share(sum(map(eq, words, words[1:]))),
        "runs": share(sum(map(eq, words, words[2:]))),
        "packed": len(zlib.compress(text, 1)) / (len(text) or 1),
        "top word": share(max(Counter(words).values(), default=0)),
        "bare signs": share(sum(k for s, k in shapes.items() if not s.translate(None, b".,;:!?-|#$%&*/\\=+~^<>()[]{}\"'_@"))),
        "shouts": share(text.count(b"!!")),
        "odd endings": share(sum(k for s, k in shapes.items() if s[-1:] in b"#$%&*|<>{}~^=\\@_+")),
        "long words": share(sum(1 for w in words if len(w) > 60)),
    }
    found["strain"] = max(found[t] / most for t, most in CLEAN.items())
    ends = share(sum(k for s, k in shapes.items() if s[-1:] in b".?!" and s[-2:-1] == b"a"))
    found["strained end"] = found["strain"] if 0.01 <= ends <= 0.4 else 9.0
    return found, shapes, n


def votes(found: dict[str, float], n: int) -> str:
    """One character a labeller. Texts of under LEAST_WORDS words get no votes."""
    if n < LEAST_WORDS:
        return NOTHING * len(RULES)
    return "".join(vote if lo <= found[t] <= hi else NOTHING for t, lo, hi, vote in RULES)


def hashed(found: dict[str, float], shapes: Counter, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted slots and values of a text's features: shapes of tokens, by their first six bytes, and traits by steps; labellers look at whole shapes."""
    values: dict[int, float] = {}
    for s, k in shapes.items():
        slot = zlib.crc32(s[:6]) % SLOTS
        values[slot] = values.get(slot, 0.0) + k / n
    if n >= LEAST_WORDS:
        for t, v in found.items():
            step = min(9, int(v * 50) if v < 0.1 else 4 + int(min(v, 1.0) * 10))
            slot = zlib.crc32(f"{t} {step}".encode()) % SLOTS
            values[slot] = values.get(slot, 0.0) + 1.0
    slots = np.array(sorted(values), np.int64)
    return slots, np.array([values[s] for s in slots.tolist()], np.float64)


class LabelModel:
    """The share of good texts and every labeller's accuracy, by EM over counts of vote patterns.

    A labeller's votes are right with one probability, whatever the text; labellers without a vote say nothing.
    """

    def fit(self, patterns: dict[str, int], rounds: int = 200) -> LabelModel:
        self.patterns = sorted(patterns)
        side = np.array([[{GOOD: 1, BAD: -1, NOTHING: 0}[c] for c in p] for p in self.patterns], np.float64).reshape(-1, len(RULES))
        weight = np.array([patterns[p] for p in self.patterns], np.float64)
        self.accuracy = np.full(len(RULES), FIRST_ACCURACY)
        self.good = PRIOR_GOOD
        self.posterior = np.full(len(side), self.good)
        for _ in range(rounds if len(side) else 0):
            odds = side @ np.log(self.accuracy / (1 - self.accuracy)) + np.log(self.good / (1 - self.good))
            before, self.posterior = self.posterior, 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
            p = self.posterior[:, None]
            right = (weight[:, None] * np.where(side > 0, p, np.where(side < 0, 1 - p, 0))).sum(axis=0)
            cast = (weight[:, None] * (side != 0)).sum(axis=0)
            self.accuracy = np.clip((right + FIRST_ACCURACY * 10) / (cast + 10), LEAST_ACCURACY, MOST_ACCURACY)
            self.good = float(np.clip((weight * self.posterior).sum() / weight.sum(), 0.5, 0.99))
            if np.abs(before - self.posterior).max() < 1e-6:
                break
        return self

    def of(self, pattern: str) -> float:
        """The posterior of good; the share of good texts where all labellers are silent."""
        return dict(zip(self.patterns, self.posterior.tolist())).get(pattern, self.good)


class Scorer:
    """Logistic regression over hashed features, fitted by gradient steps to soft labels."""

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, float]], steps: int = 400, rate: float = 2.0, ridge: float = 1e-4) -> Scorer:
        self.weights, self.bias = np.zeros(SLOTS), 0.0
        if not rows:
            self.bias = 1.0
            return self
        used = np.unique(np.concatenate([s for s, _, _ in rows]))
        x = np.zeros((len(rows), len(used)), np.float32)
        for i, (s, v, _) in enumerate(rows):
            x[i, np.searchsorted(used, s)] = v
        y = np.array([p for _, _, p in rows])
        # Both classes weigh the same, so that rare bad texts count.
        balance = np.where(y >= 0.5, 0.5 / max((y >= 0.5).mean(), 1e-9), 0.5 / max((y < 0.5).mean(), 1e-9))
        balance /= balance.sum()
        w, b, speed = np.zeros(len(used)), 0.0, np.zeros(len(used))
        for _ in range(steps):
            q = 1 / (1 + np.exp(-(x @ w + b)))
            g = (q - y) * balance
            step = x.T @ g + ridge * w
            speed = 0.9 * speed + step
            w -= rate * speed
            b -= rate * float(g.sum())
        self.weights[used], self.bias = w, b
        return self

    def score(self, slots: np.ndarray, values: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-(self.weights[slots] @ values + self.bias))))


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = Counter()
        for t in batch.column("text"):
            got, _, n = traits(t.as_py())
            found[votes(got, n)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["pattern", "n"])


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for t in batch.column("text"):
            got, shapes, n = traits(t.as_py())
            rows.append((votes(got, n), *hashed(got, shapes, n)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], ["doc_id", "pattern", "slots", "values"])


def train(docs: DataFrame, most: int = SAMPLE) -> tuple[LabelModel, Scorer]:
    """The label model from the vote patterns of all documents, at most 3 ** labellers, and the scorer from a sample."""
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    counted = texts.mapInArrow(lean(_patterns), "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    labels = LabelModel().fit({r[0]: r[1] for r in counted})
    chosen = texts.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    examples = texts.join(F.broadcast(chosen), "doc_id").mapInArrow(lean(_examples), "doc_id string, pattern string, slots array<long>, values array<double>")
    once = examples.groupBy("doc_id").agg(F.min(F.struct("pattern", "slots", "values")).alias("r"))  # of rows of one id the least
    rows = sorted(tuple(r) for r in once.select("doc_id", "r.*").collect())  # `most` rows of SLOTS numbers at most
    return labels, Scorer().fit([(np.array(s, np.int64), np.array(v), labels.of(p)) for _, p, s, v in rows])


def classify(docs: DataFrame, most: int = SAMPLE) -> DataFrame:
    """docs with votes, posterior, quality_score and keep (score of 0.5 or more).

    Texts of few words get no votes; they are kept if their shapes look like those of good texts. Null and empty texts
    score 0. Repeated rows are each scored; rows of one id count once in the sample, and null ids not at all; ids may
    be of any type. Columns of the four names are replaced. An empty table gives no row. A score of just 0.5 is kept.
    """
    labels, scorer = train(docs, most)
    shared = docs.sparkSession.sparkContext.broadcast((dict(zip(labels.patterns, labels.posterior.tolist())), labels.good, scorer))
    new = ["votes", "posterior", "quality_score", "keep"]
    kept = docs.drop(*new)
    fields = kept.schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posterior, good, model = shared.value
        for batch in batches:
            rows = []
            for t in (t for texts in slices(batch.column("text")) for t in texts):
                got, shapes, n = traits(t)
                p = votes(got, n)
                rows.append((p, posterior.get(p, good), model.score(*hashed(got, shapes, n)) if n else 0.0))
            s = np.array([r[2] for r in rows], np.float64)
            added = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array(s), pa.array(s >= 0.5)]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in fields] + added, [f.name for f in fields] + new)

    schema = T.StructType([*fields, T.StructField("votes", T.StringType()), T.StructField("posterior", T.DoubleType()), T.StructField("quality_score", T.DoubleType()), T.StructField("keep", T.BooleanType())])
    return kept.mapInArrow(lean(run), schema)
