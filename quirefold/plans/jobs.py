"""Queries over articles, page lists, jobs and their events, and the join shapes of the workbench."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.functions import net as N
from quirefold.functions import pages as G
from quirefold.operators import articles as A
from quirefold.operators import pages as P
from quirefold.plans.registry import ORACLES, query
from quirefold.sources import fixtures as S
from quirefold.sources.recognition import rows_by_page as rows_of_pages
from quirefold.streaming import events as E

NL = "chr(10)"


@query(f"""with p as (select conv_id, turn, case when turn % 2 = 0 then role || ' ' || turn else '' end as title, {S.sql_trim('text')} as body from conversations where text <> ''),
  q as (select conv_id, turn, case when title <> '' then title || {NL} || body || {NL} else coalesce(nullif(split_part(body, {NL}, 1), ''), '（无标题）') || {NL} ||
      {S.sql_trim(f"case when strpos(body, {NL}) > 0 then substr(body, strpos(body, {NL}) + 1) else '' end")} || {NL} end as part from p)
  select conv_id, regexp_replace('Paper' || {NL} || '1945-08-15' || {NL} || {NL} || string_agg(part, {NL} order by turn), '{S.WS}+$', '') as document from q group by conv_id""")
def article_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as articles of a paper: title or first line, text, blank line."""
    title = F.when(F.col("turn") % 2 == 0, F.concat("role", F.lit(" "), F.col("turn").cast("string"))).otherwise("")
    rows = S.table(spark, sf_dir, "conversations").filter("text <> ''").select("conv_id", "turn", A.article_part(title, F.col("text")).alias("part"))
    parts = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "part"))).alias("p"))
    return parts.select("conv_id", A.assembled(F.lit("Paper"), F.lit("1945-08-15"), F.transform("p", lambda p: p["part"])).alias("document"))


@query(f"""with {S.V_OUTCOMES}, g as (select job, day, bool_or(status = 'cancelled') as cancelled, arg_min(message, item) filter (where status = 'failed') as error,
    coalesce(string_agg(text, {NL} order by item) filter (where status = 'done'), '') as text from v_outcomes group by job, day)
  select job, day, cancelled, case when not cancelled then error end as error, case when not cancelled and error is null then text end as text from g""")
def outcome_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.outcomes(spark, sf_dir).withColumn("key", F.struct("job", "day"))
    return A.aggregate_outcomes(rows, "key", ["item"]).select("key.job", "key.day", "cancelled", "error", "text")


@query(f"with {S.V_OUTCOMES} select job, count(*) filter (where status = 'done') as results, count(*) filter (where status = 'failed') as errors, bool_or(status = 'cancelled') as cancelled from v_outcomes group by job")
def outcome_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, failed = F.col("status") == "done", F.col("status") == "failed"
    return S.outcomes(spark, sf_dir).groupBy("job").agg(F.count_if(done).alias("results"), F.count_if(failed).alias("errors"), F.bool_or(F.col("status") == "cancelled").alias("cancelled"))


@query("""with r as (select l_orderkey, sum(l_quantity) as qty from lineitem where l_returnflag = 'R' group by 1), e as (select l_orderkey, count(*) as n from lineitem where l_returnflag = 'A' group by 1)
  select o_orderkey, case when r.l_orderkey is not null then 'result' when e.l_orderkey is not null then 'error' else 'not recognised' end as state, round(qty, 6) as qty, n as errors
  from orders left join r on r.l_orderkey = o_orderkey left join e on e.l_orderkey = o_orderkey""")
def request_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with their results and errors: a result beats an error, an error beats nothing."""
    lines = S.table(spark, sf_dir, "lineitem")
    results = lines.filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty")).withColumnRenamed("l_orderkey", "r")
    errors = lines.filter("l_returnflag = 'A'").groupBy("l_orderkey").agg(F.count("*").alias("errors")).withColumnRenamed("l_orderkey", "e")
    rows = S.table(spark, sf_dir, "orders").select("o_orderkey").join(results, F.col("o_orderkey") == F.col("r"), "left").join(errors, F.col("o_orderkey") == F.col("e"), "left")
    state = F.when(F.col("r").isNotNull(), "result").when(F.col("e").isNotNull(), "error").otherwise("not recognised")
    return rows.select("o_orderkey", state.alias("state"), F.round("qty", 6).alias("qty"), "errors")


@query("""select l_orderkey as article, count(*) as refs, count(p_partkey) as found, bool_or(p_partkey is null) as incomplete from lineitem left join (select p_partkey from part where p_size > 5) on l_partkey = p_partkey group by 1""")
def refs_inner_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = S.table(spark, sf_dir, "part").filter("p_size > 5").select("p_partkey")
    rows = S.table(spark, sf_dir, "lineitem").join(blocks, F.col("l_partkey") == F.col("p_partkey"), "left")
    return rows.groupBy(F.col("l_orderkey").alias("article")).agg(F.count("*").alias("refs"), F.count("p_partkey").alias("found"), F.bool_or(F.col("p_partkey").isNull()).alias("incomplete"))


@query("""select 'selected' as side, c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')
  union all select 'left out', c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')""")
def semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = S.table(spark, sf_dir, "customer").select("c_custkey")
    picked = S.table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    inside = customers.join(picked, "c_custkey", "left_semi").select(F.lit("selected").alias("side"), "c_custkey")
    return inside.unionByName(customers.join(picked, "c_custkey", "left_anti").select(F.lit("left out").alias("side"), "c_custkey"))


@query(f"""with {S.V_PAGE_LISTS}, w as (select doc, page, row_number() over (partition by doc order by page) as i from v_page_lists),
  r as (select l_orderkey as doc, l_linenumber::bigint as line, row_number() over (partition by l_orderkey order by l_linenumber) as i from lineitem)
  select w.doc, w.page, r.line from w join r on w.doc = r.doc and w.i = r.i""")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-th returned row belongs to the n-th requested page."""
    wanted = S.page_lists(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("doc").orderBy("page")))
    lines = S.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("line"))
    got = lines.withColumn("i", F.row_number().over(Window.partitionBy("doc").orderBy("line")))
    return wanted.join(got, ["doc", "i"]).select("doc", "page", "line")


RANGE_SQL = "(o_orderkey % 20 + 1)::varchar || '-' || (o_orderkey % 20 + o_custkey % 9 + 1)::varchar || ', ' || (o_custkey % 30 + 1)::varchar"


@query("""select o_orderkey, array_to_string(list_sort(list_distinct(list_concat(range(o_orderkey % 20 + 1, o_orderkey % 20 + o_custkey % 9 + 2), [o_custkey % 30 + 1]))), ',') as pages from orders""")
def page_range_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    raw = F.concat((k % 20 + 1).cast("string"), F.lit(" - "), (k % 20 + c % 9 + 1).cast("string"), F.lit(", "), (c % 30 + 1).cast("string"))
    return S.table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(G.range_pages(raw, F.lit(40).cast("long")).cast("array<string>"), ",").alias("pages"))


@query(f"""with {S.V_PAGE_LISTS}, i as (select doc, page, page - row_number() over (partition by doc order by page) as g from v_page_lists),
  r as (select doc, min(page) as a, max(page) as b from i group by doc, g) select doc, string_agg(case when a = b then a::varchar else a || '-' || b end, ',' order by a) as ranges from r group by doc""")
def page_range_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.compacted(S.page_requests(spark, sf_dir), "doc", "page")


@query(f"""with {S.V_PAGE_LISTS}, l as (select doc, case when doc % 4 = 0 then i.p else page end as page from v_page_lists, lateral (select unnest(range(1, 4)) as p) i), d as (select distinct doc, page from l),
  i as (select doc, page, page - row_number() over (partition by doc order by page) as g from d), r as (select doc, min(page) as a, max(page) as b from i group by doc, g),
  s as (select doc, string_agg(case when a = b then a::varchar else a || '-' || b end, ',' order by a) as ranges from r group by doc) select doc, case when ranges = '1-3' then 'all of 3' else 'pages ' || ranges end as label from s""")
def page_range_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page lists as they are shown; one of every page has a label of its own."""
    lists = S.page_lists(spark, sf_dir).withColumn("p", F.explode(F.sequence(F.lit(1), F.lit(3)))).select("doc", F.when(F.col("doc") % 4 == 0, F.col("p")).otherwise(F.col("page")).alias("page"))
    return P.compacted(lists, "doc", "page").select("doc", G.range_label(F.col("ranges"), F.lit(3)).alias("label"))


@query(f"""with {S.V_PAGE_LISTS}, w as (select doc, page, row_number() over (partition by doc order by page) as i, count(*) over (partition by doc) as need from v_page_lists),
  r as (select l_orderkey as doc, 'line ' || l_partkey as line, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as i, count(*) over (partition by l_orderkey) as have from lineitem)
  select w.doc, w.page, r.line, false as mismatch from w join r on w.doc = r.doc and w.i = r.i where need = have union all select distinct w.doc, null, null, true from w join r on w.doc = r.doc where need <> have""")
def rows_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result lines with the pages asked for; documents with another number of lines fail as a whole."""
    wanted = S.page_lists(spark, sf_dir).withColumn("i", F.col("page"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = S.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.row_number().over(order).alias("i"), F.concat(F.lit("line "), F.col("l_partkey").cast("string")).alias("line"))
    return rows_of_pages(lines, wanted)


@query("""select n_nationkey, ['zero', 'reversed', 'exceeds', 'charset', 'emptySegment', 'negative', 'format', null, null][n_nationkey % 9 + 1] as error from nation""")
def page_range_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = F.array(*[F.lit(x) for x in ("0,1", "9-3", "1-11", "1;2", "1,,2", "-3", "1-2-3", "2, 4-6", "  ")])
    rows = S.table(spark, sf_dir, "nation").select("n_nationkey", F.get(forms, F.col("n_nationkey") % 9).alias("raw"))
    return rows.select("n_nationkey", G.range_error(F.col("raw"), F.lit(10)).alias("error"))


@query("""with b as (select l_orderkey as doc, l_partkey % 50 as page, lag(l_partkey % 50) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as before from lineitem)
  select doc, count(*) as pages, bool_or(page < 1) as below_one, count(page) <> count(distinct page) as repeated, bool_or(coalesce(before >= page, false)) as unordered, count(*) > 6 as too_many from b group by doc""")
def strict_ascending(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") % 50).alias("page"))
    return P.page_list_faults(rows, "doc", "page", ["l_linenumber", "l_partkey", "l_suppkey"], 6)


CHUNKS = f"""{S.V_PAGE_LISTS}, v_sized as (select *, greatest(1, least(greatest(1, 4096 // greatest(1, (doc % 97 * 1024) // 20)), 3)) as k from v_page_lists),
  v_chunks as (select doc, page, (i - 1) // k + 1 as chunk, (i - 1) % k + 1 as chunk_page from (select *, row_number() over (partition by doc order by page) as i from v_sized))"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.chunked(S.page_lists(spark, sf_dir), "doc", "page", G.chunk_size(F.col("doc") % 97 * 1024, F.lit(20), 4096, 3))


@query(f"with {CHUNKS} select doc, chunk, string_agg(page::varchar, ',' order by page) as pages from v_chunks group by doc, chunk")
def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).groupBy("doc", "chunk").agg(F.array_join(F.sort_array(F.collect_list("page")).cast("array<string>"), ",").alias("pages"))


@query(f"with {CHUNKS} select doc, chunk, chunk_page, page from v_chunks")
def chunk_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The original page of every page of a chunk, looked up in the chunk's list."""
    lists = _chunks(spark, sf_dir).groupBy("doc", "chunk").agg(F.sort_array(F.collect_list("page")).alias("pages"))
    placed = lists.select("doc", "chunk", "pages", F.explode(F.sequence(F.lit(1), F.size("pages"))).alias("p"))
    return placed.select("doc", "chunk", F.col("p").cast("long").alias("chunk_page"), F.get("pages", F.col("p") - 1).alias("page"))


@query(f"with {CHUNKS}, n as (select doc, chunk, count(*) as pages from v_chunks group by doc, chunk) select doc, chunk, pages, coalesce(sum(pages) over (partition by doc order by chunk rows between unbounded preceding and 1 preceding), 0)::bigint as done_before from n")
def chunk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.offsets(_chunks(spark, sf_dir).groupBy("doc", "chunk").agg(F.count("*").alias("pages")), "doc")


@query("""select o_orderkey, (o_totalprice * 400)::bigint <= 52428800 and o_custkey % 1500 <= 1000 as direct, least(greatest(o_custkey % 1500 * 2, 300), 2400) as poll_seconds from (select *, floor(o_totalprice) as x from orders) where true""")
def chunk_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, n = F.round(F.col("o_totalprice") * 400).cast("long"), F.col("o_custkey") % 1500
    return S.table(spark, sf_dir, "orders").select("o_orderkey", G.is_direct(size, n).alias("direct"), G.poll_seconds(n).alias("poll_seconds"))


@query("""with e as (select *, case event_type when 'error' then 'network' else 'http' end as kind, 400 + event_id % 130 as status, 9999 + event_id % 13 as code from events)
  select event_type, count(*) as errors, count(*) filter (where kind = 'network' or status = 429 or status between 500 and 599 or code in (500, 10010)) as retryable from e group by event_type""")
def retry_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "network").otherwise("http")
    rows = S.table(spark, sf_dir, "events").select("event_type", N.is_retryable(kind, 400 + F.col("event_id") % 130, 9999 + F.col("event_id") % 13).alias("r"))
    return rows.groupBy("event_type").agg(F.count("*").alias("errors"), F.count_if("r").alias("retryable"))


@query("""with recursive r as (select user_id, event_id, event_type as source, case when event_type = 'error' then 'failed' else 'done' end as status, case when event_id % 3 > 0 then 'text ' || event_id end as text,
    case when event_id % 2 = 0 then 'layout ' || event_id end as layout, case when event_id % 5 = 0 then event_id end as chunk, case when event_id % 4 > 0 then 'error ' || event_id end as error, event_id % 7 = 0 as text_edited, row_number() over (partition by user_id order by event_id) as k from events),
  fold as (
    select user_id, event_id, source, status, text, layout, chunk, case when status = 'failed' then error end as error, text_edited, k from r where k = 1
    union all
    select n.user_id, n.event_id, n.source, n.status, coalesce(n.text, p.text), coalesce(n.layout, case when p.source = n.source and n.status <> 'failed' then p.layout end), coalesce(n.chunk, case when p.source = n.source and n.status <> 'failed' then p.chunk end),
           case when n.status = 'failed' then coalesce(n.error, p.error) end, n.text_edited, n.k from fold p join r n on n.user_id = p.user_id and n.k = p.k + 1)
  select user_id, event_id, source, status, text, layout, chunk, error, text_edited from fold qualify row_number() over (partition by user_id order by k desc) = 1""")
def overlay_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of one page laid over one another, one after the other."""
    i = F.col("event_id")
    word = lambda w: F.concat(F.lit(w + " "), i.cast("string"))
    status = F.when(F.col("event_type") == "error", "failed").otherwise("done")
    rows = S.table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("source"), status.alias("status"), F.when(i % 3 > 0, word("text")).alias("text"), F.when(i % 2 == 0, word("layout")).alias("layout"), F.when(i % 5 == 0, i).alias("chunk"), F.when(i % 4 > 0, word("error")).alias("error"), (i % 7 == 0).alias("text_edited"))
    return A.overlaid(rows, "user_id", [i], shape=("layout", "chunk"))


@query("""with a as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as num, case when o_orderkey % 3 = 0 then 'Article 99' else o_orderpriority end as title from orders)
  select o_custkey, o_orderkey, num, case when title = 'Article 99' then 'Article ' || num else title end as title from a""")
def renumber_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("o_orderkey") % 3 == 0, "Article 99").otherwise(F.col("o_orderpriority"))
    rows = S.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", title.alias("title"))
    return A.renumbered(rows, "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")]).drop("o_orderdate")


@query("""select o_custkey, o_orderkey, coalesce(m, 0) + row_number() over (partition by o_custkey order by o_orderkey) as ord from orders
  left join (select o_custkey as c, count(*) as m from orders where o_orderstatus = 'F' group by 1) on c = o_custkey where o_orderstatus <> 'F'""")
def append_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New members get numbers behind the highest that their article has."""
    orders = S.table(spark, sf_dir, "orders")
    top = orders.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("m"))
    new = orders.filter("o_orderstatus <> 'F'").join(top, "o_custkey", "left")
    return new.select("o_custkey", "o_orderkey", (F.coalesce("m", F.lit(0)) + F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).alias("ord"))


V_JOB = "v_job as (select user_id as job, event_id as id, epoch_us(ts) as us, case event_type when 'purchase' then 'done' when 'error' then 'error' else 'progress' end as kind, (props->>'$.k')::bigint as done from events)"


@query(f"with {V_JOB}, m as (select max(us) as now from v_job) select job, arg_max(kind, (us, id)) as kind, arg_max(id, (us, id)) as last_id from v_job, m where kind <> 'progress' and us >= now - 900000000::bigint * 96 group by job")
def latest_terminal_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last end of each job within a day before the last event; the batch twin of the stream's kept results."""
    return E.latest_terminal(E.job_events(S.table(spark, sf_dir, "events")), keep_seconds=86_400)


@query(f"with {V_JOB} select job, count(*) as events, max(done) as done, coalesce(arg_max(kind, (us, id)) filter (where kind <> 'progress'), 'running') as state from v_job group by job")
def job_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.folded(E.job_events(S.table(spark, sf_dir, "events")))


@query(f"""with {V_JOB}, s as (select job, us, id, case when kind = 'progress' then 1 else 0 end as active from v_job), c as (select *, active - coalesce(lag(active) over (partition by job order by us, id), 0) as step from s)
  select job, id, sum(step) over (order by us, id rows unbounded preceding)::bigint as active from c where step <> 0""")
def active_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many jobs are active after each start and end."""
    return E.active_counts(E.job_events(S.table(spark, sf_dir, "events")))


@query(f"""with {V_JOB}, g as (select *, row_number() over (partition by job order by us, id) - row_number() over (partition by job, kind = 'error' order by us, id) as g from v_job),
  r as (select job, g, count(*) as n from g where kind = 'error' group by job, g) select job, max(n) as longest, max(n) >= 5 as fatal from r group by job""")
def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.failure_streaks(E.job_events(S.table(spark, sf_dir, "events")))


@query("""with e as (select user_id, event_id, epoch_us(ts) as us, lead(epoch_us(ts)) over (partition by user_id order by ts, event_id) as next from events)
  select user_id, event_id from e where next is null or next - us > 3600000000::bigint""")
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits that nothing follows within the gap, of an hour here."""
    return E.debounced(S.table(spark, sf_dir, "events"), 3600.0)


@query(ORACLES["job_state_fold"])
def streaming_job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold of `job_state_fold` by Structured Streaming over the same table."""
    return E.stream_states(spark, f"{sf_dir}/events.parquet")
