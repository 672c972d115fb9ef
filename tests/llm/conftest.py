import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def corpus(spark):
    """The smallest documents, and rows with nulls, empty and odd texts, ties, copies; doc_id stays unique."""
    real = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    words = " ".join(f"w{i}" for i in range(300))
    near = words.replace("w150", "other")
    odd = [None, "", " \n\t ", "one", "A b C d", "a  B\nc d", "é" * 500, "x" * 1000, "the end " * 200, words, words, words.upper(), near, near.replace("w20 ", "w20! "), "pre " + words + " post", "WARC/1.1\r\n", "👍" * 150 + "a"]
    return [*real, *((10_000 + i, t, None if i % 2 else "odd") for i, t in enumerate(odd))]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns that clash with names that operators make."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus, "doc_id long, text string, source string").repartition(5)
    return df.withColumn("size", F.lit("x")).withColumn("tag", F.lit(1)).withColumn("keep", F.lit("no")).withColumn("n_words", F.lit(None).cast("string")).cache()
