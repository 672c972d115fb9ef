"""Queries over edited pages, errors, endpoints, running lines and removed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import net as N
from quirefold.operators import editing as E
from quirefold.operators import reading as R
from quirefold.operators import validation as V
from quirefold.plans import layout as P
from quirefold.plans.registry import query
from quirefold.sources import fixtures as S


@query(f"""with {S.V_BLOCKS}, p as (select doc_id, case when doc_id % 4 <> 3 then 1000 end as width, doc_id % 3 = 0 as edited, case when doc_id % 6 = 0 then ' ' || chr(10) else text end as text from documents)
  select b.doc_id, pos, label, b.text, x0, y0, x1, y1, ord from v_blocks b join p using (doc_id) where p.width is not null and not p.edited
  union all select doc_id, 0, 'text', text, 0, 0, 1000, 1500, 1 from p where width is not null and edited and {S.sql_trim("text")} <> ''""")
def edited_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of which some were edited, some of these to nothing; pages without a size have no layout."""
    i = F.col("doc_id")
    text = F.when(i % 6 == 0, " \n").otherwise(F.col("text"))
    size = lambda n: F.when(i % 4 != 3, n).cast("long")
    pages = S.table(spark, sf_dir, "documents").select("doc_id", size(1000).alias("width"), size(1500).alias("height"), text.alias("text"), (i % 3 == 0).alias("edited"))
    return E.edited_layout(pages, S.blocks(spark, sf_dir), ["doc_id"])


@query("""with e as (select event_id, event_type, event_id % 7 as k, coalesce(props::varchar, '') as props from events)
  select event_id, case k when 0 then 'Ocr' when 1 then 'Network' when 2 then 'Config' else 'Internal' end as kind,
    case k when 0 then 'read ' || event_type when 1 then event_type when 2 then event_type when 3 then event_type when 4 then 'no json: ' || event_type when 5 then props else '{"kind":"Ocr","data":7}' end as message,
    k = 1 or (k = 0 and event_id % 2 = 0) as retryable, case when k = 0 then 'p' || event_id end as provider from e""")
def error_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as services hand them on: tagged with data of either form, bare strings, and texts that are no error's JSON."""
    i, name = F.col("event_id"), F.col("event_type")
    tagged = lambda kind: F.to_json(F.struct(F.lit(kind).alias("kind"), name.alias("data")))
    ocr = F.to_json(F.struct(F.lit("Ocr").alias("kind"), F.struct(F.concat(F.lit("read "), name).alias("message"), (i % 2 == 0).alias("retryable"), F.concat(F.lit("p"), i.cast("string")).alias("provider")).alias("data")))
    k = i % 7
    payload = F.when(k == 0, ocr).when(k == 1, tagged("Network")).when(k == 2, tagged("Config")).when(k == 3, F.concat(F.lit('"'), name, F.lit('"'))).when(k == 4, F.concat(F.lit("no json: "), name)).when(k == 5, F.coalesce("props", F.lit(""))).otherwise('{"kind":"Ocr","data":7}')
    return S.table(spark, sf_dir, "events").select("event_id", N.parsed_error(payload).alias("e")).select("event_id", "e.kind", "e.message", "e.retryable", "e.provider")


@query(f"""with {S.V_BLOCKS}, {S.V_RUNNING}, {P.V_PLACED}, rep as (select volume, key from v_keyed where key is not null group by volume, key having count(distinct doc_id) >= 3)
  select b.volume, count(*) filter (where exists (select 1 from rep r where r.volume = b.volume and r.key = b.key)) as inferred from v_keyed b group by b.volume""")
def furniture_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many running lines each volume's reading leaves out."""
    return R.furniture_counts(R.with_furniture(S.running_lines(S.blocks(spark, sf_dir))), ["volume"], "doc_id")


@query("""select page_id as job, case when page_id % 4 > 0 then null when page_id % 3 = 0 then 'no endpoint' when page_id % 5 = 0 then 'endpoint' when not regexp_matches(url, '^https://[^/?#@:]*[.][^/?#@:]*(/|$)') then 'endpoint' end as fault, length(url) + 4 as budget from pages""")
def endpoint_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of providers with and without an endpoint of their own, set or not, safe or not."""
    i = F.col("page_id")
    pages = S.table(spark, sf_dir, "pages")
    base = F.when(i % 3 == 0, "").when(i % 5 == 0, F.concat(F.lit("https://10.0.0.7/"), "url")).otherwise(F.col("url"))
    requests = pages.select(i.alias("job"), F.when(i % 4 == 0, "openai_compatible").otherwise("openai").alias("provider"), F.lit("m").alias("model"), F.lit("read").alias("prompt"), base.alias("base_url"))
    units = pages.select(i.alias("job"), F.lit("page:1").alias("key"), F.col("url").alias("text"))
    none = spark.createDataFrame([], "job long, data string")
    return V.proofread_faults(requests, units, none)


@query("""with g as (select c_custkey as k from customer where c_custkey % 10 = 0)
  select 'customer' as tbl, count(*) as kept from customer where c_custkey not in (select k from g) union all select 'orders', count(*) from orders where o_custkey not in (select k from g)
  union all select 'events', count(*) from events where user_id not in (select k from g) union all select 'documents', count(*) from documents where doc_id not in (select k from g)""")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are removed, and with them their rows in every table that names them."""
    table = lambda name: S.table(spark, sf_dir, name)
    removed = table("customer").filter("c_custkey % 10 = 0").select(F.col("c_custkey").alias("file"))
    left = E.cascade({name: (table(name), c) for name, c in (("customer", "c_custkey"), ("orders", "o_custkey"), ("events", "user_id"), ("documents", "doc_id"))}, removed, "file")
    parts = [rows.agg(F.count("*").alias("kept")).select(F.lit(name).alias("tbl"), "kept") for name, rows in left.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
