"""Whole outputs of the fitted operators, worked out again from their models by plain loops."""

import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from quirefold.llm import fingerprints, quality, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(900_001, None), (900_002, ""), (900_003, "short text"), (900_004, "x!! " * 3000), (900_005, "é" * 5000 + " 👍 a.b.c"), (900_006, "you st.u.p.i.d F00L " * 400), (900_007, "\t\x0b\n")]


@pytest.fixture(scope="module")
def texts(spark):
    return [*((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), *ODD]


def plain_traits(text):
    raw = (text or "").encode()
    words = raw.split()
    n = max(1, len(words))
    kind = lambda c: "A" if 65 <= c <= 90 else "a" if c >= 128 or 97 <= c <= 122 else "9" if 48 <= c <= 57 else " " if c <= 32 else chr(c)
    shapes = Counter("".join(k for k, _ in groupby(map(kind, raw))).split())
    letters = [c for c in raw if chr(c).isascii() and chr(c).isalpha()]
    ends = lambda test: sum(k for s, k in shapes.items() if test(s)) / n
    t = {
        "symbols": sum(chr(c) in "#$%&*|<>{}[]~^=\\@_+" for c in raw) / max(1, len(raw)),
        "capitals": sum(c <= 90 for c in letters) / max(1, len(letters)),
        "repeated": sum(a == b for a, b in zip(words, words[1:])) / n,
        "runs": sum(a == b for a, b in zip(words, words[2:])) / n,
        "packed": len(zlib.compress(raw, 1)) / max(1, len(raw)),
        "top word": max(Counter(words).values(), default=0) / n,
        "bare signs": ends(lambda s: all(c in ".,;:!?-|#$%&*/\\=+~^<>()[]{}\"'_@" for c in s)),
        "shouts": raw.count(b"!!") / n,
        "odd endings": ends(lambda s: s[-1] in "#$%&*|<>{}~^=\\@_+"),
        "long words": sum(len(w) > 60 for w in words) / n,
    }
    t["strain"] = max(t[k] / most for k, most in quality.CLEAN.items())
    t["strained end"] = t["strain"] if 0.01 <= ends(lambda s: len(s) > 1 and s[-1] in ".?!" and s[-2] == "a") <= 0.4 else 9.0
    return t, shapes, len(words)


def test_quality_recomputed(spark, texts):
    """Votes, posteriors and scores of every document; the weights are the fitted scorer's."""
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels, scorer = quality.train(docs)
    got = {r.doc_id: r for r in quality.classify(docs).collect()}
    assert len(got) == len(texts)
    for d, text in texts:
        t, shapes, n = plain_traits(text)
        votes = "".join(v if n >= 8 and lo <= t[k] <= hi else "-" for k, lo, hi, v in quality.RULES)
        x = defaultdict(float)
        for s, k in shapes.items():
            x[zlib.crc32(s[:6].encode("latin-1")) % 4096] += k / n
        for k, v in t.items() if n >= 8 else ():
            step = int(v * 50) if v < 0.1 else 4 + int(min(v, 1.0) * 10)
            x[zlib.crc32(f"{k} {min(9, step)}".encode()) % 4096] += 1
        score = 1 / (1 + math.exp(-(scorer.bias + sum(scorer.weights[s] * v for s, v in x.items())))) if n else 0.0
        side = sum((1 if v == "1" else -1) * math.log(a / (1 - a)) for v, a in zip(votes, labels.accuracy) if v != "-")
        assert got[d].votes == votes
        assert abs(got[d].posterior - 1 / (1 + math.exp(-side) * (1 - labels.good) / labels.good)) < 1e-3
        assert abs(got[d].quality_score - score) < 1e-6 and (got[d].keep == (score >= 0.5) or abs(score - 0.5) < 1e-6)


LETTER = r"[^\W\d_]"


def plain_features(text, odds):
    text = text or ""
    low, raw = text.lower(), text.encode()
    words = re.findall(LETTER + "+", low)
    n, size = max(1, len(words)), max(1, len(raw))
    mark_of = lambda w: max(odds.get(b, 0.0) for b in [w, *(w[:k] + "-" * (k < len(w)) for k in (3, 4, 5, 6) if k <= len(w))])
    marks = [m for m in map(mark_of, words) if m]
    hidden = re.findall(rf"{LETTER}+[0-9@$*!]+{LETTER}+", low) + re.findall(rf"(?<!{LETTER})(?:{LETTER}[.\-*_]){{3,}}{LETTER}(?!{LETTER})", low)
    plain = lambda x: "".join({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}.get(c, "" if c in "*.-_" else c) for c in x)
    at = [i for i, w in enumerate(words) if w in toxicity.INSULTS]
    insults = len(at) + sum(plain(x) in toxicity.INSULTS for x in hidden)
    near = sum(any(w in toxicity.SECOND for w in words[max(0, i - 5) : i + 6]) for i in at)
    share = lambda chars: sum(chr(c) in chars for c in raw) / size
    return [
        insults, insults / n, len(marks), len(marks) / n, max(marks, default=0.0), sum(marks) / n, len({w for w in words if mark_of(w)}), sum(w in toxicity.SECOND for w in words) / n, near / n,
        share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), len(re.findall(rb"[A-Z]{2,}", raw)) / n, share("!"), share(".,;:?!\"'()-*#%&$"), share("0123456789"), len(hidden) / n, len(re.findall(rb"(?i)([a-z])\1\1", raw.lower())) / n, size / n, len(words),
    ]


def test_toxicity_recomputed(spark, texts):
    """Features, paths through the trees and calibrated scores of every document; splits and pools are the fitted model's."""
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.train_and_score(docs, labels).collect()}
    assert len(got) == len(texts) and len(model.trees.grown) > 0
    at, share = model.scale.at.tolist(), model.scale.share.tolist()
    for d, text in texts:
        x = plain_features(text, model.marks.odds)
        total = model.trees.base
        for feature, threshold, value in model.trees.grown:
            node = 0
            while 2 * node + 2 < len(feature):
                node = 2 * node + (2 if feature[node] >= 0 and x[feature[node]] > threshold[node] else 1)
            total += value[node]
        above = next((i for i, a in enumerate(at) if a > total), len(at))
        if above in (0, len(at)):
            want = share[min(above, len(at) - 1)]
        else:
            low, high = at[above - 1], at[above]
            want = share[above - 1] + (share[above] - share[above - 1]) * (total - low) / (high - low)
        assert abs(got[d].score - want) < 1e-6, (d, x)
        assert got[d].predicted == (got[d].score >= 0.5) and got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0)


def test_fingerprint_strings_recomputed(spark, texts):
    """Fingerprints of texts and edited texts, and both likenesses, over the hashes of Spark's own xxhash64."""
    order = sorted(((d, t or "") for d, t in texts), reverse=True)
    edited = {d: t[: len(t) - len(t) // 2] + following[: len(t) // 2] for (d, t), (_, following) in zip(order, [*order[1:], order[0]])}
    terms = lambda t: re.findall(r"[^\W_]+", t.lower())
    own = {d: terms(t) for d, t in order}
    cut = {d: terms(t) for d, t in edited.items()}
    often = Counter(w for ws in own.values() for w in set(ws))
    n = len(order)
    lexicon = {w for w, k in often.items() if max(2, math.ceil(0.002 * n)) <= k <= math.floor(0.2 * n)}
    vocabulary = sorted({w for side in (own, cut) for ws in side.values() for w in ws})
    frame = spark.createDataFrame([(w,) for w in vocabulary], "w string").select("w", F.xxhash64("w").alias("h"))
    of = {r[0]: r for r in frame.select("w", "h", *[F.pmod(F.xxhash64("h", F.lit(r)), F.lit(r)) for r in fingerprints.RATES]).collect()}

    def subsets(ws):
        kept = set(ws) & lexicon
        return [tuple(sorted(of[w][1] for w in kept if of[w][2 + i] == k)) for i in range(len(fingerprints.RATES)) for k in range(fingerprints.SUBSETS)]

    parts = {(side, d): [*subsets(ws), tuple(of[w][1] for w in ws)] for side, all_ in (("own", own), ("cut", cut)) for d, ws in all_.items()}
    lists = sorted({p for x in parts.values() for p in x})
    hashes = {tuple(r[0]): r[1] for r in spark.createDataFrame([(list(p),) for p in lists], "p array<long>").select("p", F.xxhash64("p")).collect()}
    shown = lambda x: "".join(f"{(0 if not p and i < len(x) - 1 else hashes[p]) & 0xFFFFFFFF:08X}" for i, p in enumerate(x))

    def like(x, y):
        runs = [list(zip(x, y))[i * fingerprints.SUBSETS : (i + 1) * fingerprints.SUBSETS] for i in range(len(fingerprints.RATES))]
        used = [[(p, q) for p, q in run if p or q] for run in runs]
        fit = next((u for u in reversed(used) if len(u) >= fingerprints.ENOUGH), [pair for u in used for pair in u])
        return sum(p == q for p, q in fit) / len(fit) if fit else float(x[-1] == y[-1])

    got = {r.doc_id: r for r in fingerprints.compare(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert len(got) == n
    for (d, _), (following, _) in zip(order, [*order[1:], order[0]]):
        x, y = parts["own", d], parts["cut", d]
        assert (got[d].fingerprint, got[d].edited_fingerprint) == (shown(x), shown(y))
        assert abs(got[d].near_edited - like(x, y)) < 1e-9 and abs(got[d].near_next - like(x, parts["own", following])) < 1e-9
