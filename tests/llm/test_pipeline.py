"""The pipeline's stages on the smallest tables, against plain versions where there are some."""

import brute
import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF)
        after = {r.doc_id: r.text for r in out.collect()}
        assert set(after) <= set(before)
        if name != "mixing":
            assert out.columns == docs.columns
        if name == "near duplicates":
            assert set(after) == {d for d, _, c in brute.jaccard(before.items()) if d == c}
        if name == "decontamination":
            hit = {r[0] for r in brute.decontamination(before.items(), benchmark) if r[-1]}
            assert all(after[d] == t for d, t in before.items() if d not in hit)
            assert not any(r[-1] for r in brute.decontamination(after.items(), benchmark))
        if name == "pii":
            assert len(after) == len(before)
        docs = spark.createDataFrame(out.select(*docs.columns).collect(), docs.schema)
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near duplicates", "decontamination", "pii", "mixing"]


def test_run_agrees_with_stages(spark):
    first, again = (sorted((r.doc_id, r.taken) for r in pipeline.run(spark, SF).collect()) for _ in range(2))
    assert first == again and first


def test_stages_on_odd_tables(spark):
    """Empty tables, and rows of nulls and empty texts, pass through every stage."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    for rows in ([], [(None, None, None, None, None), (1, "", None, "", 0), (1, None, "en", "s", None), (1, None, "en", "s", None)]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, SF)
            got = out.collect()
            assert len(got) <= len(rows)
            if name != "mixing":
                assert out.columns == docs.columns
