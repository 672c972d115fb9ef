"""Layout tables over the driver's tables, in Spark and, word for word, in SQL.

All geometry is integer arithmetic on ids and positions, so both engines agree exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.operators.running import numbered

LABELS = ("doc_title", "paragraph_title", "text", "vertical_text", "header", "footer", "number", "aside_text", "vision_footnote", "table", "image", "figure_title", "content")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block for each line of a document; a document is a page of its source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.split("text", "\n", -1).alias("a"))
    rows = docs.select("doc_id", "source", F.size("a").cast("long").alias("n"), F.posexplode("a").alias("p", "text")).withColumn("pos", F.col("p").cast("long")).drop("p")
    d, p = F.col("doc_id"), F.col("pos")
    label = F.get(F.array(*[F.lit(x) for x in LABELS]), ((d + p) % len(LABELS)).cast("int"))
    rows = rows.select("doc_id", "source", "pos", "text", label.alias("label"), ((d * 37 + p * 101) % 900).alias("x0"), ((p * 97) % 1400).alias("y0"), (20 + (d + p * 13) % 80).alias("w"), (10 + (p * 7) % 60).alias("h"), F.when(d % 5 != 0, F.col("n") - p).alias("ord"), F.when(d % 4 == 0, 1000).cast("long").alias("width"), F.when(d % 4 == 0, 1500).cast("long").alias("height"))
    return rows.withColumn("x1", F.col("x0") + F.col("w")).withColumn("y1", F.col("y0") + F.col("h")).drop("w", "h")


V_BLOCKS = f"""v_blocks as (
  select doc_id, source, pos, text, label, x0, y0, x0 + w as x1, y0 + h as y1,
         case when doc_id % 5 <> 0 then n - pos end as ord,
         case when doc_id % 4 = 0 then 1000::bigint end as width, case when doc_id % 4 = 0 then 1500::bigint end as height
  from (select doc_id, source, pos, n, text, list_extract({list(LABELS)!r}, (((doc_id + pos) % {len(LABELS)}) + 1)::int) as label,
               (doc_id * 37 + pos * 101) % 900 as x0, (pos * 97) % 1400 as y0, 20 + (doc_id + pos * 13) % 80 as w, 10 + (pos * 7) % 60 as h
        from (select doc_id, source, u.i - 1 as pos, len(a)::bigint as n, a[u.i] as text
              from (select doc_id, source, string_split(text, chr(10)) as a from documents) t, lateral (select unnest(range(1, len(a) + 1)) as i) u)))"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of their source, numbered from 1; three of four without a size."""
    docs = table(spark, sf_dir, "documents")
    pages = numbered(docs.select("doc_id", "source"), ["source"], ["doc_id"], "page")
    return docs.drop("source").join(pages, "doc_id").select("doc_id", "source", "page", "text", F.when(F.col("doc_id") % 4 == 0, 1000).cast("long").alias("width"), F.when(F.col("doc_id") % 4 == 0, 1500).cast("long").alias("height"))


V_PAGES = """v_pages as (
  select doc_id, source, row_number() over (partition by source order by doc_id) as page, text,
         case when doc_id % 4 = 0 then 1000::bigint end as width, case when doc_id % 4 = 0 then 1500::bigint end as height from documents)"""


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of an article (order) on a page (line number), some drawn from right to left or upwards."""
    k = F.col
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(k("l_orderkey").alias("article"), k("l_linenumber").cast("long").alias("page"), (k("l_partkey") % 1000).alias("x"), (k("l_suppkey") % 700).alias("y"), ((k("l_partkey") * 7 + k("l_suppkey")) % 400 - 100).alias("w"), ((k("l_suppkey") * 11 + k("l_linenumber")) % 300 - 80).alias("h"))


V_RECTS = """v_rects as (
  select l_orderkey as article, l_linenumber::bigint as page, l_partkey % 1000 as x, l_suppkey % 700 as y,
         (l_partkey * 7 + l_suppkey) % 400 - 100 as w, (l_suppkey * 11 + l_linenumber) % 300 - 80 as h from lineitem)"""


def page_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested pages of a document (order), some of them twice."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_partkey") % 50 + 1).alias("page"))


def page_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct requested pages of a document (order)."""
    return page_requests(spark, sf_dir).distinct()


V_PAGE_LISTS = "v_page_lists as (select distinct l_orderkey as doc, l_partkey % 50 + 1 as page from lineitem)"


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of work items: jobs are users, items are events."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "cancelled").otherwise("done")
    return e.select(F.col("user_id").alias("job"), F.col("event_id").alias("item"), status.alias("status"), F.concat(F.lit("failed at "), F.col("event_id").cast("string")).alias("message"), F.concat(F.lit("text "), F.col("event_id").cast("string")).alias("text"), F.date_trunc("day", "ts").alias("day"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_type"))


V_OUTCOMES = """v_outcomes as (
  select user_id as job, event_id as item, case event_type when 'error' then 'failed' when 'signup' then 'cancelled' else 'done' end as status,
         'failed at ' || event_id as message, 'text ' || event_id as text, date_trunc('day', ts) as day, epoch_us(ts) as us, event_type from events)"""

WS = r"[\s\x{000b}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_delete(x: str) -> str:
    return f"regexp_replace({x}, '{WS}', '', 'g')"


def sql_role(x: str) -> str:
    name = f"lower(trim({x}))"
    return f"""case when {name} = 'doc_title' then 'DocTitle' when {name} in ('paragraph_title', 'title') then 'Heading'
      when {name} in ('figure_title', 'chart_title', 'table_title') then 'FigureCaption' when {name} in ('header', 'doc_header', 'header_image') then 'Header'
      when {name} in ('footer', 'doc_footer', 'footer_image') then 'Footer' when {name} in ('number', 'page_number', 'page_no', 'page_num') then 'PageNumber'
      when {name} in ('aside_text', 'aside') then 'Aside' when contains({name}, 'footnote') then 'Footnote' when contains({name}, 'table') then 'Table'
      when contains({name}, 'image') or {name} = 'figure' then 'Image' else 'Body' end"""


def sql_clean_line(x: str) -> str:
    bare = f"regexp_replace({sql_trim(x)}, '^[#>][#> ]*', '')"
    return f"""(select case when strlen(b) >= 6 and starts_with(b, '***') and ends_with(b, '***') then substr(b, 4, length(b) - 6)
      when strlen(b) >= 4 and starts_with(b, '**') and ends_with(b, '**') then substr(b, 3, length(b) - 4)
      when strlen(b) >= 2 and starts_with(b, '*') and ends_with(b, '*') then substr(b, 2, length(b) - 2)
      when strlen(b) >= 2 and starts_with(b, '`') and ends_with(b, '`') then substr(b, 2, length(b) - 2) else b end from (select {bare} as b))"""


def sql_strip_html(x: str, depth: int = 8) -> str:
    """What stands outside of angle brackets, which nest `depth` deep at most: pairs go from the inside out."""
    for _ in range(depth):
        x = f"regexp_replace({x}, '<[^<>]*>', '', 'g')"
    return f"regexp_replace({sql_trim(f"replace(regexp_replace({x}, '(?s)<.*$', ''), '>', '')")}, '{WS}+', ' ', 'g')"


def running_lines(rows: DataFrame) -> DataFrame:
    """blocks with a volume, and a line that names it at the top of every page."""
    volume = F.col("doc_id") % 5
    named = F.concat(F.lit("## *Volume "), volume.cast("string"), F.lit(" <b>x</b> ("), F.lit("of five)*"))
    return rows.withColumn("volume", volume).withColumn("text", F.when(F.col("pos") == 0, named).otherwise(F.col("text")))


V_RUNNING = """v_running as (select * replace (case when pos = 0 then '## *Volume ' || doc_id % 5 || ' <b>x</b> (of five)*' else text end as text), doc_id % 5 as volume from v_blocks)"""
