"""Golden rows of the operators."""

import struct

from pyspark.sql import functions as F

from quirefold.engine import LayoutEngine
from quirefold.functions.layout import ReadingOptions
from quirefold.operators import articles, proofreading, reading
from quirefold.sources import images, recognition


def test_spans_and_application():
    assert proofreading.span("本埠新聞，\n巳於昨日到達。", "巳", "本埠新聞，") == (6, 7)
    assert proofreading.span("哈哈哈", "哈哈") is None
    assert proofreading.span("一月已過，二月已過。", "已過") is None
    run = lambda text, *found: proofreading.apply_all(text, [(b, a, "") for b, a in found])
    assert run("叁月五日下芋", ("叁月五日", "三月五日"), ("五日下芋", "五日下午")) == ("三月五日下芋", 1, 1)
    assert run("甲\n巳", ("甲巳", "乙丙"))[0] == "乙\n丙"
    assert run("甲\n乙\n丙", ("甲乙", "丁"))[0] == "丁\n丙"
    assert run("於\n是\n乎", ("是乎", "是"))[0] == "於\n是\n"
    assert run("甲\n巳", ("甲巳", "甲乙巳"))[0] == "甲\n乙巳"
    assert run("甲\n乙\n丙\n丁", ("甲乙丙丁", "戊乙丙己"))[0] == "戊\n乙\n丙\n己"
    assert run("甲\n巳", ("甲巳", "甲乙巳"), ("甲巳", "甲丙巳"))[::2] == ("甲\n乙巳", 1)
    # Whitespace of a replacement is written as it is.
    assert run("x foobar y", ("foobar", "foo bar")) == ("x foo bar y", 1, 0)
    assert run("foo baz", ("foo baz", "foo,  bar"))[0] == "foo ,  bar"
    assert run("a b", ("a b", "a b"))[:2] == ("a  b", 1) and run("a b", ("a b", "ab"))[:2] == ("a b", 0)
    assert run("".join(f"{c}\n" for c in "ab" * 60), ("ab" * 60, "c" + "ba" * 59 + "cc"))[0] == "c" + "ba" * 59 + "cc\n"


def test_application_in_the_jvm(spark):
    """The same as the plain application, whatever texts, contexts and overlaps."""
    import random

    rng = random.Random(1)
    letters = "abc巳👍\\E.*\u3000"
    units = []
    for k in range(300):
        text = "".join(rng.choice(letters + " \n") for _ in range(rng.randrange(40)))
        found = []
        for _ in range(rng.randrange(5)):
            i = rng.randrange(len(text) + 1)
            j, c = i + rng.randrange(6), max(0, i - rng.randrange(8))
            found.append((text[i:j], "".join(rng.choice(letters + " \n") for _ in range(rng.randrange(6))), text[c:i] or None))
        units.append((str(k), text, found))
    df = spark.createDataFrame([*units, ("null", None, [("a", "b", "")]), ("none", "text", None)], "key string, text string, suggestions array<struct<before string, after string, context string>>")
    got = {r.key: (r.text, r.applied, r.conflicts) for r in proofreading.apply_suggestions(df).collect()}
    assert got.pop("null") == (None, 0, 0) and got.pop("none") == ("text", 0, 0)
    assert got == {k: proofreading.apply_all(t, f) for k, t, f in units} and sum(a for _, a, _ in got.values()) > 100


def test_verdicts(spark):
    kind = "key string, text string, suggestions array<struct<before string, after string, context string, verdict string, edited_after string>>"
    rows = [(v or "none", "one two", [("two", "2", "", v, e)]) for v, e in (("accepted", "x"), ("edited", "3 3"), ("rejected", "x"), ("pending", "x"), (None, "x"))] + [("cut", "one two", [("two", "2", "", "edited", None)])]
    got = {r.key: r.text for r in proofreading.apply_suggestions(spark.createDataFrame(rows, kind)).collect()}
    assert got == {"accepted": "one 2", "edited": "one 3 3", "rejected": "one two", "pending": "one two", "none": "one two", "cut": "one "}


def test_overlays(spark):
    """Chains of results, against a plain fold."""
    import random

    rng = random.Random(2)
    rows = [(rng.randrange(40) if i < 380 else None, i, rng.choice(["a", "b", None] if i % 5 else ["a"]), rng.choice(["done", "done", "failed", None]), rng.choice([None, f"t{i}"]), rng.choice([None, None, f"l{i}"]), rng.choice([None, f"e{i}"])) for i in range(400)]
    want = {}
    for key, i, source, status, text, layout, error in rows:
        old = want.get(key)
        keeps = old is not None and old[1] == source and status != "failed"
        bad = status == "failed"
        want[key] = (i, source, status, text or (old and old[3]), layout or (old[4] if keeps else None), (error or (old and old[5])) if bad else None)
    df = spark.createDataFrame(rows, "k int, i int, source string, status string, text string, layout string, error string").repartition(7)
    got = {r.k: tuple(r)[1:] for r in articles.overlaid(df, "k", [F.col("i")]).collect()}
    assert got == want


def test_sizes_inferred(spark):
    rows = [("d", i, None, None, w, h) for i, (w, h) in enumerate([(2145, 1559), (2167, 1252), (2273, 1550), (2195, 1645)])]
    schema = "doc string, page int, width double, height double, ext_w int, ext_h int"
    got = reading.resolved_sizes(spark.createDataFrame(rows, schema), "doc").collect()
    assert {(round(r.page_w, 4), round(r.page_h, 4), r.approximate) for r in got} == {(2318.46, 1677.9, True)}
    more = [*rows, ("d", 4, None, None, 1530, 2125), ("d", 5, 2382.0, 1684.0, 0, 0)]
    by = {r.page: (round(r.page_w, 4), round(r.page_h, 4)) for r in reading.resolved_sizes(spark.createDataFrame(more, schema), "doc").collect()}
    assert by[0] == (2382.0, 1684.0) and by[4] == (1684.0, 2382.0) and by[5] == (2382.0, 1684.0)


def test_assembly(spark):
    parts = [("胜利", "今晨, 日本宣布投降。\n全城欢腾。"), ("号外", "本报特刊。\n")]
    df = spark.createDataFrame(parts, "title string, text string").select(articles.article_part(F.col("title"), F.col("text")).alias("p"))
    texts = [r.p for r in df.collect()]
    whole = spark.range(1).select(articles.assembled(F.lit("申报"), F.lit("1945-08-15"), F.array(*[F.lit(t) for t in texts])).alias("v")).first().v
    assert whole == "申报\n1945-08-15\n\n胜利\n今晨, 日本宣布投降。\n全城欢腾。\n\n号外\n本报特刊。"
    odd = spark.createDataFrame([("", " first\nrest "), ("", ""), ("   ", "x")], "title string, text string").select(articles.article_part(F.col("title"), F.col("text")).alias("p"))
    assert [r.p for r in odd.collect()] == ["first\nrest\n", "（无标题）\n\n", "   \nx\n"]


def test_union_and_padding(spark):
    rows = [("a", 10, 20, 30, 40), ("a", 100, 5, 20, 20), ("b", 100, 100, -40, -60), ("c", 1, 1, 0, 5)]
    got = {r.k: tuple(r)[1:] for r in articles.union_rects(spark.createDataFrame(rows, "k string, x int, y int, w int, h int"), ["k"]).collect()}
    assert got == {"a": (10, 5, 110, 55), "b": (60, 40, 40, 60)}


def test_outcomes(spark):
    rows = [("a", 2, "done", None, "y"), ("a", 1, "done", None, "x"), ("b", 1, "failed", "m1", None), ("b", 0, "failed", "m0", None), ("c", 1, "cancelled", None, None), ("c", 2, "failed", "m", None)]
    got = {r.k: (r.cancelled, r.error, r.text) for r in articles.aggregate_outcomes(spark.createDataFrame(rows, "k string, o int, status string, message string, text string"), "k", ["o"]).collect()}
    assert got == {"a": (False, None, "x\ny"), "b": (False, "m0", None), "c": (True, None, None)}


def test_retries():
    calls = []

    def client(item):
        calls.append(1)
        raise recognition.RecognitionError("network", "down", retryable=item["retry"])

    out = recognition.attempt(client, {"retry": True}, (0, 0, 0), lambda _: None)
    assert (out["status"], out["attempts"], out["retryable"], len(calls)) == ("failed", 3, False, 3)
    assert recognition.attempt(client, {"retry": False}, (0, 0, 0), lambda _: None)["attempts"] == 1


def test_recognise_with_fake_client(spark):
    items = spark.createDataFrame([("j", 1), ("j", 2)], "job string, item long")
    got = {r.item: r.text for r in recognition.recognise(items, lambda r: f"page {r['item']}", 2, (0.0,)).collect()}
    assert got == {1: "page 1", 2: "page 2"}


def test_raw_preview():
    jpeg = b"\xff\xd8\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 1500, 1024) + b"\x01\x01\x11\x00\xff\xd9"
    fields = [(274, 3, 1, 6), (513, 4, 1, 200), (514, 4, 1, len(jpeg))]
    head = b"II*\x00" + struct.pack("<I", 8) + struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", *f) for f in fields) + struct.pack("<I", 8)
    data = head.ljust(200, b"\0") + jpeg
    assert images.best_preview(data) == (200, len(jpeg), 1500, 1024, 6)
    assert images.best_preview(b"nothing") is None
    assert images.raw_fault(data) == "maker" and images.raw_fault(b"nothing") == "format"


def test_raw_maker():
    fields = [(271, 2, 6, 100), (274, 3, 1, 1)]
    head = b"II*\x00" + struct.pack("<I", 8) + struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", *f) for f in fields) + struct.pack("<I", 0)
    data = head.ljust(100, b"\0") + b"Apple\0"
    assert images.maker(data) == "Apple" and images.raw_fault(data) == "preview"
    assert images.maker(b"") == images.maker(b"II*\0") == images.maker(data[:20]) == ""


def test_engine_over_json(spark, tmp_path):
    import json

    def page(size, blocks):
        return {"prunedResult": {"page_size": size, "parsing_res_list": blocks}}

    block = lambda label, text, order: {"block_label": label, "block_content": text, "block_bbox": [100, 700, 900, 760], "block_order": order}
    (tmp_path / "a.json").write_text(json.dumps([page([1000, 1500], [block("text", "B", 2), block("doc_title", "T", 1)]), page(None, [block("number", "7", 1)])]))
    (tmp_path / "b.json").write_text("\n".join(json.dumps({"result": {"layoutParsingResults": [page([5, 6], [block("text", f"line {i}", 1)])]}}) for i in range(2)))
    docs = LayoutEngine(spark).import_json(str(tmp_path / "*.json"), unwrap=True)
    flight = {r.doc_id[-6:]: r for r in docs.preflight().collect()}
    assert (flight["a.json"].pages, flight["a.json"].blocks, flight["a.json"].estimated_pages) == (2, 3, [2])
    assert flight["b.json"].pages == 2
    texts = {(r.doc_id[-6:], r.page): r.markdown for r in docs.to_markdown(ReadingOptions(include_page_number=False)).collect()}
    assert texts[("a.json", 1)] == "# T\n\nB\n\n" and texts[("b.json", 2)] == "line 1\n\n" and ("a.json", 2) not in texts


class Service:
    """A document service that is ready after some polls; documents named bad answer with too few lines."""

    def __init__(self, wait=2, fail=None):
        self.wait, self.fail, self.polls = wait, fail, 0

    def submit(self, item):
        self.item = item
        return f"ticket {item['item']}"

    def poll(self, ticket):
        self.polls += 1
        if self.fail and self.polls <= self.fail[0]:
            raise recognition.RecognitionError("network", "down", retryable=self.fail[1])
        return ("done", ticket) if self.polls > self.wait else ("pending", "")

    def fetch(self, where):
        return [f"line {p}" for p in self.item["pages"]][: 1 if self.item["name"] == "bad" else None]


def test_document_service():
    import pytest

    item = {"item": 1, "name": "good", "pages": [4, 7]}
    still = lambda _: None
    assert recognition.document_rows(Service(), item, 300, sleep=still) == ["line 4", "line 7"]
    assert recognition.document_rows(Service(5, (4, True)), item, 300, sleep=still) == ["line 4", "line 7"]
    for service, kind in ((Service(9, (5, True)), "network"), (Service(9, (1, False)), "network")):
        with pytest.raises(recognition.RecognitionError) as e:
            recognition.document_rows(service, item, 300, sleep=still)
        assert e.value.kind == kind
    now = iter(range(0, 10_000, 200))
    with pytest.raises(recognition.RecognitionError) as e:
        recognition.document_rows(Service(100), item, 300, clock=lambda: next(now), sleep=still)
    assert e.value.kind == "timeout"


def test_documents_recognised(spark):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    items = spark.createDataFrame([("j", 1, [4, 7], "good"), ("j", 2, [1, 2], "bad")], "job string, item long, pages array<long>, name string")
    got = recognition.recognise_documents(items, Service(0), 2, sleep=lambda _: None).collect()
    assert sorted((r.item, r.page, r.line, r.error_kind) for r in got if r.item == 1) == [(1, 4, "line 4", None), (1, 7, "line 7", None)]
    assert [(r.item, r.page, r.error_kind) for r in got if r.item == 2] == [(2, None, "protocol")]


def test_document_files(spark):
    from quirefold.sources import documents

    def probe(data):
        if not data:
            raise ValueError("no document")
        return len(data), data.decode()

    files = spark.createDataFrame([("a", bytearray(b" T ")), ("b", bytearray(b"   ")), ("c", bytearray(b""))], "path string, content binary")
    got = {r.path: (r.page_count, r.title, r.error) for r in documents.information(files, probe).collect()}
    assert got == {"a": (3, "T", None), "b": (3, None, None), "c": (None, None, "no document")}
    asked = spark.createDataFrame([("a", 1, 144, 500.0, 700.0, 3, None), ("a", 2, 144, 500.0, 700.0, 3, 700), ("a", 4, 144, 1.0, 1.0, 3, None), ("a", 1, 601, 1.0, 1.0, 3, None)], "path string, page long, dpi int, width_pt double, height_pt double, page_count long, most int")
    plan = documents.render_plan(asked)
    assert sorted((str(r.fault), r.scale) for r in plan.collect() if r.scale) == [("None", 1.0), ("None", 2.0)]
    assert sorted(r.fault for r in plan.collect() if r.fault) == ["dpi", "page"]
    assert {bytes(r.picture) for r in documents.rendered(plan, files, lambda data, page, scale: f"{page} {scale}".encode()).collect()} == {b"1 2.0", b"2 1.0"}
    assert documents.with_defaults({"a": 1, "b": None, "x": 3}, {"a": 0, "b": 2}) == {"a": 1, "b": 2} and documents.with_defaults(None, {"a": 0}) == {"a": 0}


def test_chunks_halved(spark):
    from quirefold.operators import pages as P

    sizes = [30, 10, 10, 10, 90, 5, 5, 5, 5]

    def split(chunk):
        return [chunk] if len(chunk) == 1 or sum(sizes[p] for p in chunk) <= 40 else split(chunk[: len(chunk) // 2]) + split(chunk[len(chunk) // 2 :])

    rows = [("d", 1 if i < 5 else 2, i, n) for i, n in enumerate(sizes)]
    got = P.halved(spark.createDataFrame(rows, "doc string, chunk long, page long, bytes long"), "doc", "chunk", F.lit(40)).collect()
    want = split(list(range(5))) + split(list(range(5, 9)))
    assert {r.page: r.chunk for r in got} == {p: i for i, c in enumerate(want, 1) for p in c}
    assert {r.page for r in got if r.oversized} == {4}


def test_job_registry(spark):
    import pytest

    from quirefold.streaming import registry

    jobs = registry.JobRegistry(spark, most=2)
    with jobs.running("a") as a, jobs.running("b"):
        assert jobs.listed()[0] == (a, "a") and not jobs.cancelled(a)
        with pytest.raises(registry.TooManyJobs):
            jobs.register("c")
        assert jobs.cancel(a) and jobs.cancelled(a)
    assert jobs.listed() == [] and not jobs.cancel("x")
    frame = spark.range(1).select(registry.event_frame(F.lit("done"), F.struct(F.lit(1).alias("id"))).alias("f")).first().f
    assert frame == 'event: done\ndata: {"id":1}\n\n'


def test_admission(spark):
    from quirefold.streaming import events

    rows = [(1, i, i, i + 10) for i in range(8)] + [(1, 8, 10, 12), (2, 9, 0, 1)]
    got = {r.id for r in events.admitted(spark.createDataFrame(rows, "pool long, id long, start long, end long")).collect() if r.admitted}
    assert got == {0, 1, 2, 3, 8, 9}


def test_ends_are_kept_for_a_time(spark, tmp_path):
    """The stream's last ends, and their expiry once the watermark has passed them."""
    from quirefold.streaming import events

    schema, minute = "job long, id long, us long, kind string", 60_000_000
    parts = [[(1, 1, 0, "done"), (1, 2, minute, "error"), (2, 3, 0, "progress")], [(3, 4, 40 * minute, "done")], [(3, 5, 41 * minute, "done")]]
    seen = []
    at = tmp_path / "in"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(at))
        run = events.kept_ends(spark.readStream.schema(schema).parquet(str(at))).writeStream.outputMode("update").foreachBatch(lambda b, _: seen.extend((r.job, r.kind, r.last_id) for r in b.collect())).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        run.awaitTermination()
    assert (1, "error", 2) in seen and (3, "done", 5) in seen and (1, "expired", None) in seen
    assert all(job != 2 for job, _, _ in seen)


def test_engine_settings_and_anchors(spark, tmp_path):
    import json

    page = lambda *blocks, **more: {"prunedResult": {"parsing_res_list": [{"block_label": a, "block_content": b, "block_bbox": [1, 700, 9, 760]} for a, b in blocks]}, **more}
    (tmp_path / "a.json").write_text(json.dumps([page(("text", "x")), page(("number", "2"), modelSettings={"markdown_ignore_labels": ["header"]}), page(("image", ""), modelSettings={"markdownIgnoreLabels": ["no"]})]))
    (tmp_path / "b.json").write_text(json.dumps({"result": {"model_settings": {"k": 1}, "layoutParsingResults": [page(("text", "y"), modelSettings={"k": 2})]}}))
    docs = LayoutEngine(spark).import_json(str(tmp_path / "*.json"))
    got = {r.doc_id[-6:]: (json.loads(r.settings), r.ignore_labels) for r in docs.settings().collect()}
    assert got == {"a.json": ({"markdown_ignore_labels": ["header"]}, ["header"]), "b.json": ({"k": 1}, [])}
    texts = {(r.doc_id[-6:], r.page): r.markdown for r in docs.to_markdown(ReadingOptions(include_page_number=True)).collect()}
    assert texts[("a.json", 2)] == "〔Source page 2〕\n\n" and texts[("a.json", 1)].endswith("x\n\n") and len(texts) == 4
    assert {(r.doc_id[-6:], r.page): (r.images, r["items"]) for r in docs.warnings().collect()}[("a.json", 3)] == (True, 1)


def test_block_of_a_suggestion(spark):
    blocks = spark.createDataFrame([(1, 5, "c d"), (1, 2, " a\u3000b "), (1, 3, "  "), (1, 7, "a b"), (2, 1, "e")], "page long, pos long, text string")
    asked = [(1, "b", "a", "x"), (1, "d", "c", "x"), (1, "d", "never", "x"), (1, "bc", None, "x"), (1, " ", "", "x"), (1, "d", "a", "x"), (2, "f", None, "x"), (3, "e", None, "x"), (1, "b", "a", "x")]
    found = proofreading.block_of(spark.createDataFrame(asked, "page long, before string, context string, note string"), blocks, ["page"])
    assert found.columns == ["page", "before", "context", "note", "block"]
    got = {(r.page, r.before, r.context or ""): r.block for r in found.collect()}
    assert got == {(1, "b", "a"): 2, (1, "d", "c"): 5, (1, "d", "never"): 5, (1, "bc", ""): None, (1, " ", ""): None, (1, "d", "a"): 5, (2, "f", ""): None, (3, "e", ""): None}
    assert found.count() == len(asked)
