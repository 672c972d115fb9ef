"""Queries over replies of services and over what became of work: replies that Spark writes from the documents and reads back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.operators import outcomes as O
from quirefold.plans.registry import query
from quirefold.sources import fixtures as S
from quirefold.sources import replies as R


def _quoted(v: Column) -> Column:
    """A string as JSON."""
    inside = F.to_json(F.array(v))
    return F.substring(inside, F.lit(2), F.length(inside) - 2)


def _around(before: str, v: Column, after: str) -> Column:
    return F.concat(F.lit(before), v, F.lit(after))


def _listed(items: Column) -> Column:
    return _around("[", F.array_join(items, ","), "]")


def _kept(turn: str) -> str:
    """SQL for the trimmed lines of a text at some places, without blank ones, as one text."""
    return f"array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x, i: case when {turn} then {S.sql_trim('x')} end), lambda x: x <> ''), chr(10))"


@query(f"select doc_id, case when text is null then null when doc_id % 5 in (2, 4) then '' else {_kept('i % 4 in (1, 3)')} end as text from documents")
def result_line_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of result lines under every envelope, with items of no text or of the wrong type."""
    text = lambda t: _around('{"markdown":{"text":', _quoted(t), "}}")
    items = F.transform(F.split("text", "\n", -1), lambda t, i: F.when(i % 4 == 0, text(t)).when(i % 4 == 1, '{"markdown":{"text":7}}').when(i % 4 == 2, text(_around(" \t", t, "　"))).otherwise('{"prunedResult":{}}'))
    listed, k = _listed(items), F.col("doc_id") % 5
    line = (
        F.when(k == 0, _around('{"result":{"layoutParsingResults":', listed, "}}"))
        .when(k == 1, _around('{"layoutParsingResults":', listed, "}"))
        .when(k == 2, _around('{"result":{"layoutParsingResults":null},"layoutParsingResults":', listed, "}"))
        .when(k == 3, _around('{"result":5,"layoutParsingResults":', listed, "}"))
        .otherwise(_around('{"result":{"layoutParsingResults":{"a":1}},"layoutParsingResults":', listed, "}"))
    )
    return S.table(spark, sf_dir, "documents").select("doc_id", R.line_text(line).alias("text"))


@query(
    f"""with l as (select doc_id, doc_id // 4 as picture, doc_id % 50 in (7, 13, 34) as bad, case when doc_id % 50 not in (21, 33) then {_kept('i % 3 = 1')} end as part from documents where doc_id is not null),
      p as (select picture, min(doc_id) filter (where bad) as bad_line, coalesce(string_agg(part, chr(10) order by doc_id) filter (where part <> ''), '') as text from l group by picture)
    select picture, bad_line, case when bad_line is null then text end as text from p"""
)
def picture_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of pictures of four result lines each; blank lines are passed over, and a line against the protocol fails its picture."""
    docs = S.table(spark, sf_dir, "documents").filter("doc_id is not null")
    items = F.transform(F.split("text", "\n", -1), lambda t, i: F.when(i % 3 == 0, _around('{"markdown":{"text":', _quoted(t), "}}")).when(i % 3 == 1, '{"markdown":{}}').otherwise("{}"))
    k = F.col("doc_id") % 50
    line = (
        F.when(k == 7, '{"result":{"layoutParsingResults":[{"markdown":{"text":5}}]}}')
        .when(k == 13, "no JSON")
        .when(k == 21, " \t")
        .when(k == 33, '{"result":{}}')
        .when(k == 34, '{"layoutParsingResults":[]}')
        .otherwise(_around('{"result":{"layoutParsingResults":', _listed(items), "}}"))
    )
    return R.picture_texts(docs.select(F.floor(F.col("doc_id") / 4).alias("picture"), F.col("doc_id").alias("i"), line.alias("line")), ["picture"])


@query(
    f"""with c as (select doc_id, doc_id % 11 as k, text from documents),
      e as (select doc_id, k, text, case when k in (5, 6, 9) then 'HTTP ' || case k when 5 then 503 when 6 then 404 else 429 end || ': ' || coalesce(substring(text, 1, 200), '') when k in (4, 7) or text is null and k <> 3 then 'parse' when k = 3 then 'empty' when k in (1, 8) then 'truncated' end as error from c)
    select doc_id, error, case when error is null then {S.sql_trim('text')} end as text, case when error is not null then k in (5, 9) end as retryable from e"""
)
def chat_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat completions: whole and cut ones, refusals that may and may not be tried again, bodies of the wrong shape."""
    k, said = F.col("doc_id") % 11, _quoted(F.col("text"))
    choice = lambda reason: _around('{"message":{"content":', said, "}" + reason + "}")
    one = lambda reason: _around('{"choices":[', choice(reason), "]}")
    body = (
        F.when(k == 1, one(',"finish_reason":"length"'))
        .when(k == 2, F.concat(F.lit('{"choices":['), choice(',"finish_reason":null'), F.lit(","), choice(',"finish_reason":"length"'), F.lit("]}")))
        .when(k == 3, '{"choices":[]}')
        .when(k == 4, '{"choices":[{"message":{"content":null},"finish_reason":"stop"}]}')
        .when(k.isin(5, 6, 9), F.col("text"))
        .when(k == 7, _around('{"error":', said, "}"))
        .when(k == 8, one(',"finish_reason":"max_tokens"'))
        .when(k == 10, one(""))
        .otherwise(one(',"finish_reason":"stop"'))
    )
    status = F.when(k == 5, 503).when(k == 6, 404).when(k == 9, 429).otherwise(200)
    return S.table(spark, sf_dir, "documents").select("doc_id", R.chat_outcome(status, body).alias("c")).select("doc_id", "c.*")


@query(
    f"""with a as (select o_orderkey as file, unnest(range(1, o_orderkey % 7 + 2)) as page from orders),
      l as (select l_orderkey as file, l_linenumber as page, l_returnflag as flag, max(l_suppkey) as s from lineitem group by all)
    select a.file, a.page, case when r.s is null then 'failed' else 'done' end as status, 'supplier ' || r.s as text, r.s * 2 as chunk, case when r.s is null then coalesce('failed at ' || e.s, '{O.NO_RESULT}') end as error
    from a left join l r on r.file = a.file and r.page = a.page and r.flag = 'R' left join l e on e.file = a.file and e.page = a.page and e.flag = 'A'"""
)
def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each page that a file's recognition was asked for."""
    asked = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("o_orderkey") % 7 + 1)).alias("page"))
    lines = S.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("long").alias("page"), F.col("l_suppkey").alias("i"), "l_returnflag")
    told = lambda word: F.concat(F.lit(word), F.col("i").cast("string"))
    results = lines.filter("l_returnflag = 'R'").select("file", "page", "i", told("supplier ").alias("text"), (F.col("i") * 2).alias("chunk"))
    errors = lines.filter("l_returnflag = 'A'").select("file", "page", "i", told("failed at ").alias("message"))
    return O.with_outcomes(asked, results, errors, ["file", "page"])


@query(
    f"""with r as (select doc_id, max(toxic) as m from labels where quality = 1 group by 1), e as (select doc_id, max(quality) as q from labels where toxic = 1 or quality = 0 group by 1)
    select 'page:' || d.doc_id as key, length(text) as base_chars, case when m is null then 'failed' else 'done' end as status, 'model ' || m as model, case when m is null then coalesce('error ' || q, '{O.NO_RESULT}') end as error
    from documents d left join r on r.doc_id = d.doc_id left join e on e.doc_id = d.doc_id"""
)
def unit_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each unit that was sent to be proofread, beside the text that was sent."""
    key = F.concat(F.lit("page:"), F.col("doc_id").cast("string")).alias("key")
    units = S.table(spark, sf_dir, "documents").select(key, F.length("text").cast("long").alias("base_chars"))
    labels = S.table(spark, sf_dir, "labels")
    results = labels.filter("quality = 1").select(key, F.col("toxic").alias("i"), F.concat(F.lit("model "), F.col("toxic").cast("string")).alias("model"))
    errors = labels.filter("toxic = 1 or quality = 0").select(key, F.col("quality").alias("i"), F.concat(F.lit("error "), F.col("quality").cast("string")).alias("message"))
    return O.with_outcomes(units, results, errors, ["key"])
