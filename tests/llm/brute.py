"""Plain versions of the corpus operators, for small tables."""

import hashlib
import re
from collections import defaultdict

UPPER = {c: c + 32 for c in range(65, 91)}


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def decontamination(docs, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i : i + size])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if at := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= at
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    places = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            places[x].append(i)
    pairs = defaultdict(int)
    for at in places.values():
        for x in range(len(at)):
            for y in range(x):
                pairs[at[y], at[x]] += 1
    for (i, j), same in pairs.items():
        (a, s), (b, t) = sets[i], sets[j]
        if 100 * same >= 80 * (len(s) + len(t) - same):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [(d, len(s), find(d)) for d, s in sets]


def repeats(docs, length=400):
    texts = [(d, (t or "").encode()) for d, t in docs]
    count = defaultdict(int)
    for _, t in texts:
        for i in range(len(t) - length + 1):
            count[hash(t[i : i + length])] += 1
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[hash(t[i : i + length])] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = bytes(gone).split(b"\x00")
        out.append((d, len(t), sum(gone), sum(1 for s in spans if s), sha(kept)))
    return out
