"""Selected blocks put into an article, against a plain walk over each file."""

import random
import re

from quirefold.operators import editing as D


def _plain(blocks, articles, refs, selected, target):
    """(articles, refs) of one file: {id: (num, title)} and {(article, page, block): ord}."""
    picks = [(p, b) for o, p, b in sorted((o, p, b) for p, b, o in selected) if (p, b) in blocks]
    keep_empty = not picks
    to, articles = None, dict(articles)
    if picks:
        to = target[0]
        if to not in articles:
            to, num = target[1], max([n for n, _ in articles.values()], default=0) + 1
            articles[to] = (num, f"Article {num}")
    places = {}
    for a, p, b, o in refs:
        if (p, b) not in picks:
            places.setdefault(a, []).append((o, p, b))
    end = max([o for o, _, _ in places.get(to, [])], default=0)
    for i, (p, b) in enumerate(picks, 1):
        places.setdefault(to, []).append((end + i, p, b))
    alive = sorted((n, a, t) for a, (n, t) in articles.items() if keep_empty or a in places or a == to)
    named = {a: (i, f"Article {i}" if re.fullmatch(r"Article \d+", t) else t) for i, (_, a, t) in enumerate(alive, 1)}
    return named, {(a, p, b): i for a, rows in places.items() for i, (_, p, b) in enumerate(sorted(rows), 1)}


def test_mark_selection(spark):
    rng = random.Random(11)
    blocks, articles, refs, selected, targets, named, placed = [], [], [], [], [], {}, {}
    for file in range(40):
        own = {(rng.randint(1, 3), b) for b in range(rng.randint(0, 12))}
        arts = {a: (n, rng.choice(["Article 7", "News", "Sport"])) for n, a in enumerate(rng.sample(range(10), rng.randint(0, 4)), 1)}
        inside = [(rng.choice(list(arts)), p, b, rng.randint(1, 5)) for p, b in sorted(own) if arts and rng.random() < 0.7]
        picks = [(p, b, o) for o, (p, b) in enumerate(rng.sample(sorted(own), rng.randint(0, len(own))) if rng.random() < 0.8 else [], 1)]
        picks += [(9, 99, 50)] if rng.random() < 0.5 else []
        target = (rng.choice([None, 77, *arts]), 100 + file)
        named[file], placed[file] = _plain(own, arts, inside, picks, target)
        blocks += [(file, *b) for b in own]
        articles += [(file, a, n, t) for a, (n, t) in arts.items()]
        refs += [(file, *r) for r in inside]
        selected += [(file, *s) for s in picks]
        targets.append((file, *target))
    table = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} {'string' if n == 'title' else 'long'}" for n in names.split()))
    got, now = D.mark_selection(table(blocks, "file page block"), table(articles, "file article num title"), table(refs, "file article page block ord"), table(selected, "file page block ord"), table(targets, "file article fresh"))
    assert {(r.file, r.article): (r.num, r.title) for r in got.collect()} == {(f, a): v for f, rows in named.items() for a, v in rows.items()}
    assert {(r.file, r.article, r.page, r.block): r.ord for r in now.collect()} == {(f, *k): o for f, rows in placed.items() for k, o in rows.items()}


def test_nothing_selected(spark):
    none = lambda names: spark.createDataFrame([], ", ".join(f"{n} long" for n in names.split()))
    arts = spark.createDataFrame([(1, 5, 3, "Article 3")], "file long, article long, num long, title string")
    got, now = D.mark_selection(none("file page block"), arts, none("file article page block ord"), none("file page block ord"), none("file article fresh"))
    assert [tuple(r) for r in got.collect()] == [(1, 5, 1, "Article 1")] and now.count() == 0
