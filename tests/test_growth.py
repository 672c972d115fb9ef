"""What plans and written tables look like where work has to stay in proportion to the rows."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from quirefold.functions import layout as L
from quirefold.operators import pages as P
from quirefold.operators import typesetting as T
from quirefold.sources import layout_json as J
from quirefold.streaming.live import Lifecycle


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_wrapped_without_a_step_for_each_character(spark, monkeypatch):
    """Texts of several runs of characters, and pieces of a line that takes more than one."""
    rows = spark.createDataFrame([(1, "ab 甲 " * 50), (2, None), (3, "x\n \ny" * 9)], "doc_id long, text string")
    assert "aggregate(" not in plan(T.wrapped(rows, 10.0, 50.0, 60.0))
    want = {r.doc_id: r.lines for r in T.wrapped(rows, 10.0, 50.0, 60.0).collect()}
    assert want[2] == "" and all(len(line) <= 20 for line in want[1].split("\n"))
    monkeypatch.setattr(T, "CHARS", 1)
    import pyarrow as pa

    one = T._wrapped(pa.array(["ab 甲 " * 50, None, "x\n \ny" * 9]), pa.array([500] * 3), pa.array([600] * 3)).to_pylist()
    assert ["\n".join(x) for x in one] == [want[i] for i in (1, 2, 3)]


def test_corners_are_put_together_once(spark):
    rows = spark.createDataFrame([(1, 5, 4, -2)], "x long, y long, w long, h long").repartition(1)
    corners = F.array("x", "y", F.col("x") + F.col("w"), "h")
    df = rows.select(L.bounds(L.points(corners)).alias("r"))
    assert plan(df).count("array(x#") == 1
    assert tuple(df.first().r) == (1, -2, 4, 7)


def test_pages_that_repeat_are_compacted_in_one_exchange(spark):
    rows = spark.createDataFrame([(1, p) for p in (3, 1, 2, 3, 7, 7, 9)] + [(2, 5), (2, 5), (None, 1), (3, None)], "doc long, page long")
    df = P.compacted(rows, "doc", "page")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert {r.doc: r.ranges for r in df.collect()} == {1: "1-3,7,9", 2: "5", None: "1", 3: ""}


def test_layout_files_are_opened_once(spark, tmp_path):
    """Values of one line and of several, and lines: all is there when the files are gone."""
    page = '{"parsing_res_list":[{"block_label":"text","block_content":"t%d","block_polygon_points":[1,2,3,4]}]}'
    files = {"one": "[" + page % 1 + "]\n", "more": "[\n" + page % 2 + ",\n" + page % 3 + "\n]\n\n", "lines": page % 4 + "\n\n" + page % 5 + "\n", "none": '[]'}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    pages = J.read_json(spark, str(tmp_path))
    for name in files:
        (tmp_path / name).unlink()
    assert sorted((r.doc_id.rpartition("/")[2], r.page, r.text) for r in J.blocks(pages).collect()) == [("lines", 1, "t4"), ("lines", 2, "t5"), ("more", 1, "t2"), ("more", 2, "t3"), ("one", 1, "t1")]


class States:
    """A job's states in memory, with the number of times that they are asked."""

    def __init__(self):
        self.calls, self.held = 0, {}

    def of(self, name, *_):
        states, held = self, self.held.setdefault(name, {})

        class One:
            def __getattribute__(self, method):
                states.calls += 1
                return {
                    "exists": lambda: None in held, "get": lambda: held.get(None), "update": lambda v: held.update({None: v}),
                    "containsKey": lambda k: k in held, "getValue": held.get, "updateValue": lambda k, v: held.update({k: v}), "iterator": lambda: iter(list(held.items())),
                }[method]

        return One()

    getMapState = getValueState = of


def test_states_are_asked_once_a_job_and_not_once_an_event():
    states, job = States(), Lifecycle()
    job.init(states)
    event = lambda i, kind: Row(id=i, us=i // 2, kind=kind, done=i, total=1000)
    first = list(job.handleInputRows((7,), iter([event(i, "cancel" if i % 50 == 7 else "progress") for i in range(200)]), None))
    assert first == [Row(job=7, events=200, done=199, total=1000, state="cancelling")] and states.calls <= 10
    more = list(job.handleInputRows((7,), iter([event(300, "error"), event(250, "done"), event(120, "progress")]), None))
    assert more == [Row(job=7, events=203, done=199, total=1000, state="error")] and states.calls <= 20
