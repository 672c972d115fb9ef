"""Measurements behind two remarks of the README: python tests/llm/measure_methods.py [folder of the tables].

1. The first level of a textbook difference-cover sort: every position of two residues modulo 3, with its triple of
   bytes, range-sorted by the triple. Prints the bytes shuffled and the CPU seconds for each GB of the documents' file.
2. One count-vector R-tree over all documents: the share of leaves whose boxes a search can't rule out, and the pairs
   left by the points, against the pairs that are really linked.
"""

import glob
import json
import os
import sys
import tempfile

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
DATA = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"


def first_level():
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    log = tempfile.mkdtemp()
    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "32").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.eventLog.enabled", "true").config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", "false").config("spark.eventLog.dir", log).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", F.col("text").cast("binary").alias("text")).repartition(32)
    at = F.explode(F.filter(F.sequence(F.lit(1), F.octet_length("text")), lambda i: i % 3 != 0)).alias("at")
    triples = docs.select("doc_id", "text", at).select("doc_id", "at", F.substring("text", F.col("at"), F.lit(3)).alias("triple"))
    triples.repartitionByRange("triple", "doc_id", "at").sortWithinPartitions("triple", "doc_id", "at").write.format("noop").mode("overwrite").save()
    spark.stop()
    written = spilled = cpu = rows = 0
    for path in glob.glob(f"{log}/*"):
        for line in open(path):
            event = json.loads(line)
            if event["Event"] == "SparkListenerTaskEnd" and (m := event.get("Task Metrics")):
                written += m["Shuffle Write Metrics"]["Shuffle Bytes Written"]
                rows += m["Shuffle Write Metrics"]["Shuffle Records Written"]
                spilled += m["Disk Bytes Spilled"]
                cpu += m["Executor CPU Time"] / 1e9
    size = os.path.getsize(f"{DATA}/documents.parquet")
    print(f"difference cover, first level: {rows} rows, shuffled and spilled {(written + spilled) / size:.1f} x input, {cpu / size * 1e9:.0f} CPU s a GB")


def one_tree():
    import pyarrow.parquet as pq

    from quirefold.llm import jaccard

    texts = pq.read_table(f"{DATA}/documents.parquet", columns=["text"]).column("text").to_pylist()
    sets = {s.tobytes(): s for t in texts if len(s := jaccard.shingles((t or "").encode()))}
    sets = list(sets.values())
    points = np.stack([np.bincount((s & np.uint64(511)).astype(np.int64), minlength=512) for s in sets]).astype(np.int32)
    tree = jaccard.CountTree(points)
    a, b = jaccard.SHARE
    rng = np.random.default_rng(0)
    queries = rng.choice(len(sets), min(500, len(sets)), replace=False)
    leaves = near = linked = 0
    for i in queries:
        bound = np.minimum(tree.top, points[i]).sum(axis=1)
        leaves += int((bound * (a + b) >= a * (int(points[i].sum()) + tree.least)).sum())
        found = tree.near(int(i))
        near += len(found) - 1
        linked += sum(jaccard.similar(sets[i], sets[j]) for j in found if j != i)
    n = len(queries)
    print(f"one R-tree over {len(sets)} sets: a search opens {leaves / n / len(tree.leaves):.1%} of {len(tree.leaves)} leaves and leaves {near / n:.1f} candidates, of which {linked / n:.2f} are linked")


if __name__ == "__main__":
    if len(sys.argv) < 3:
        one_tree()
    first_level()
