"""Queries against their SQL on small tables of odd rows."""

import duckdb

from quirefold.plans import catalogue


def agrees(spark, folder, name, **tables):
    """The query's rows, which are those of its SQL; tables: a schema and rows by name."""
    con = duckdb.connect()
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    df = catalogue.QUERIES[name](spark, str(folder))
    cols = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    want = con.sql(catalogue.ORACLES[name])
    at = [want.columns.index(c) for c in cols]
    assert got == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())
    return got


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_suggestion_rules(spark, tmp_path):
    texts = ["A.", "", None, "again and again", "Again", "日本", "cat a\ncat", "the plain word of it"]
    rows = [(40 * i + k, t, "en", "s", len(t or "")) for i, t in enumerate(texts) for k in range(40)]
    assert len(agrees(spark, tmp_path, "suggestion_rules", documents=(DOCUMENTS, rows))) == len(rows)
