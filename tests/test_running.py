"""Sums over ranges against plain loops."""

import random
from itertools import accumulate

from pyspark.sql import functions as F

from quirefold.operators.running import numbered, running


def test_running_sums_and_numbers(spark):
    """A group that holds most rows, a null group and an empty table."""
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 8 + ["b", "c", None]), i, rng.randrange(-3, 4)) for i in range(2000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i long, v int").repartition(7)
    got = {r.i: (r.s, r.n) for r in numbered(running(df, ["g"], ["i"], F.col("v"), "s"), ["g"], ["i"], "n").collect()}
    want = {}
    for g in {g for g, *_ in rows}:
        mine = sorted((i, v) for x, i, v in rows if x == g)
        want |= {i: (s, n) for n, ((i, _), s) in enumerate(zip(mine, accumulate(v for _, v in mine)), 1)}
    assert got == want
    whole = {r.i: r.s for r in running(df, [], ["i"], F.col("v"), "s").collect()}
    assert whole == dict(enumerate(accumulate(v for _, _, v in sorted(rows, key=lambda r: r[1]))))
    assert numbered(df.limit(0), ["g"], ["i"], "n").count() == 0
