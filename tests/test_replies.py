"""Replies against plain readings of their JSON, and outcomes against plain maps."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quirefold.operators import outcomes as O
from quirefold.sources import replies as R


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "line, text",
    [
        ('{"result":{"layoutParsingResults":[{"markdown":{"text":" a\\n"}},{"markdown":{"text":"  "}},{"markdown":{"text":"b"}}]}}', "a\nb"),
        ('{"layoutParsingResults":[{"markdown":{"text":"a"}},{"markdown":"b"},{"markdown":{"text":5}},{},3]}', "a"),
        ('{"result":{"other":1},"layoutParsingResults":[{"markdown":{"text":"a"}}]}', "a"),
        ('{"result":{"layoutParsingResults":null},"layoutParsingResults":[{"markdown":{"text":"a"}}]}', ""),
        ('{"result":{"layoutParsingResults":"x"}}', ""),
        ("[]", ""),
        ("5", ""),
        ("{", None),
        (None, None),
    ],
)
def test_line_text(spark, line, text):
    assert one(spark, R.line_text(F.col("v")), line) == text


def test_picture_texts(spark):
    full = lambda *texts: json.dumps({"result": {"layoutParsingResults": [{"markdown": {"text": t}} for t in texts]}})
    bad = ["{", "{}", "[]", '{"result":null}', '{"result":{"layoutParsingResults":null}}', '{"result":{"layoutParsingResults":[5]}}', '{"result":{"layoutParsingResults":[{"markdown":null}]}}', '{"result":{"layoutParsingResults":[{"markdown":{"text":null}}]}}']
    good = {"whole": [full(" a ", "b"), None, "  ", full(), full("c")], "items without text": ['{"result":{"layoutParsingResults":[{},{"markdown":{}}]},"x":1}'], "no list": ['{"result":{}}'], "blank": [""]}
    pictures = good | {b: [full("a"), b, full("c"), "{"] for b in bad}
    rows = [(p, i, line) for p, lines in pictures.items() for i, line in enumerate(lines)]
    random.Random(3).shuffle(rows)
    got = {r.p: (r.text, r.bad_line) for r in R.picture_texts(spark.createDataFrame(rows, "p string, i int, line string"), ["p"]).collect()}
    assert got == {"whole": ("a\nb\nc", None), "items without text": ("", None), "no list": ("", None), "blank": ("", None)} | {b: (None, 1) for b in bad}


@pytest.mark.parametrize(
    "status, body, want",
    [
        (200, '{"choices":[{"message":{"content":" a \\n"},"finish_reason":"stop"}]}', ("a", None, None)),
        (200, '{"choices":[{"message":{"content":""}}]}', ("", None, None)),
        (200, '{"choices":[{"message":{"content":"a"},"finish_reason":"length"}]}', (None, "truncated", False)),
        (200, '{"choices":[{"message":{"content":"a"}},{"message":{}}]}', (None, "parse", False)),
        (200, '{"choices":[{"message":{"content":"a"},"finish_reason":1}]}', (None, "parse", False)),
        (200, '{"choices":[]}', (None, "empty", False)),
        (200, '{"choices":null}', (None, "parse", False)),
        (200, None, (None, "parse", False)),
        (429, "slow", (None, "HTTP 429: slow", True)),
        (500, None, (None, "HTTP 500: ", True)),
        (401, "x" * 300, (None, "HTTP 401: " + "x" * 200, False)),
    ],
)
def test_chat_outcome(spark, status, body, want):
    assert tuple(one(spark, R.chat_outcome(F.lit(status), F.col("v")), body)) == want


def test_outcomes(spark):
    asked = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 3), (2, 1), (None, 1)], "job int, page int")
    results = spark.createDataFrame([(1, 1, 0, "old"), (1, 1, 1, "new"), (2, 1, 0, None), (9, 9, 0, "not asked for")], "job int, page int, i int, text string")
    errors = spark.createDataFrame([(1, 1, 0, "beaten"), (1, 2, 0, "first"), (1, 2, 5, "last"), (2, 7, 0, "not asked for")], "job int, page int, i int, message string")
    got = sorted((tuple(r) for r in O.with_outcomes(asked, results, errors, ["job", "page"]).collect()), key=str)
    none = O.NO_RESULT
    assert got == sorted([(1, 1, "done", "new", None), (1, 2, "failed", None, "last"), (1, 3, "failed", None, none), (1, 3, "failed", None, none), (2, 1, "done", None, None), (None, 1, "failed", None, none)], key=str)


def test_no_outcomes(spark):
    none = lambda more: spark.createDataFrame([], f"job int, i int, {more} string")
    assert O.with_outcomes(none("x").select("job"), none("text"), none("message"), ["job"]).count() == 0
