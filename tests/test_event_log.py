"""A log of events replayed from any number, and gone on with after a restart."""

import pytest

from quirefold.streaming import events as E
from quirefold.streaming.source import event_log

SF = "/root/testdata/sf0.001"
rows = lambda df: {r.job: (r.events, r.done, r.state) for r in df.collect()}


def test_replay_from_an_offset(spark):
    path = f"{SF}/events.parquet"
    whole = spark.read.parquet(path)
    ids = sorted(r.event_id for r in whole.select("event_id").collect())
    for first in (0, ids[len(ids) // 3], ids[-1], ids[-1] + 1):
        want = rows(E.folded(E.job_events(whole.filter(f"event_id >= {first}"))))
        if want:
            assert rows(E.final_states(event_log(spark, path, "event_id", first))) == want


def test_a_log_that_grows(spark, tmp_path):
    """The stream is stopped, files come, and it goes on: every event counts once."""
    whole = spark.read.parquet(f"{SF}/events.parquet")
    ids = sorted(r.event_id for r in whole.select("event_id").collect())
    cuts = [ids[0], ids[len(ids) // 2], ids[-5], ids[-1] + 1]
    log, at = str(tmp_path / "log"), str(tmp_path / "run")
    for low, high in zip(cuts, cuts[1:]):
        whole.filter(f"event_id >= {low} and event_id < {high}").repartition(3).write.mode("append").parquet(log)
        got = rows(E.final_states(event_log(spark, log, "event_id"), at))
        assert got == rows(E.folded(E.job_events(whole.filter(f"event_id < {high}"))))
    assert rows(E.final_states(event_log(spark, log, "event_id"), at)) == got  # nothing new


def test_a_log_without_numbers_is_an_error(spark, tmp_path):
    spark.range(3).selectExpr("id", "cast(id as string) as event_id").write.option("parquet.column.statistics.enabled", "false").parquet(str(tmp_path / "log"))
    with pytest.raises(Exception, match="no least and greatest"):
        E.final_states(event_log(spark, str(tmp_path / "log"), "id").selectExpr("id as user_id", "id as event_id", "'x' as event_type", "timestamp_seconds(id) as ts", "'{}' as props"))
