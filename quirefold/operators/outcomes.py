"""What became of each piece of work that a job was asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_RESULT = "no result returned"


def _latest(rows: DataFrame, key: list[str], fields: list[str], flag: str) -> DataFrame:
    """One row a key, the last by i, as a map holds it."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*fields), "i").alias("_v")).select(*key, *[F.col("_v")[c].alias(f"_{flag}_{c}") for c in fields], F.lit(True).alias(f"_{flag}"))


def with_outcomes(asked: DataFrame, results: DataFrame, errors: DataFrame, key: list[str]) -> DataFrame:
    """asked with status, the fields of its result, and error: a result beats an error, an error beats nothing.

    results (key, i and fields), errors (key, i, message); of repeated keys the last by i counts. Pieces without a result
    have failed, with the error's message or that there is none; results and errors of pieces that weren't asked for go.
    Repeated pieces each have their outcome.
    """
    fields = [c for c in results.columns if c not in (*key, "i")]
    found, failed = _latest(results, key, fields, "r"), _latest(errors, key, ["message"], "e")
    rows = asked.join(found, key, "left").join(failed, key, "left")
    message = F.when(F.col("_r").isNull(), F.coalesce("_e_message", F.lit(NO_RESULT)))
    return rows.select(*asked.columns, F.when(F.col("_r"), "done").otherwise("failed").alias("status"), *[F.col(f"_r_{c}").alias(c) for c in fields], message.alias("error"))
