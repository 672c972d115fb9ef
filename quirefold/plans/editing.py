"""Queries over edits: blocks, articles, selections, queues, page texts, verdicts, reviews and picture plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.functions import layout as L
from quirefold.operators import editing as D
from quirefold.plans.registry import query
from quirefold.sources import fixtures as S
from quirefold.sources.shared import store

# A file is a customer, an article one of its orders, a block one of the order's lines.
V_EDIT = """e_blocks as (select o_custkey as file, l_suppkey % 5 + 1 as page, l_orderkey * 10 + l_linenumber as block, l_orderkey as article_of, l_linenumber as line, l_linestatus as text, l_returnflag as flag from (select l_orderkey, l_linenumber, min(l_suppkey) as l_suppkey, min(l_linestatus) as l_linestatus, min(l_returnflag) as l_returnflag from lineitem group by l_orderkey, l_linenumber) join orders on l_orderkey = o_orderkey),
  e_refs as (select file, article_of as article, page, block, (line * 2)::bigint as ord from e_blocks where line <= 4),
  e_articles as (select o_custkey as file, o_orderkey as article, row_number() over (partition by o_custkey order by o_orderkey) as num, case when o_orderkey % 3 = 0 then 'Article 99' else o_orderpriority end as title from orders),
  e_selected as (select file, page, block, row_number() over (partition by file order by block desc) as ord from e_blocks where flag = 'R')"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = S.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_suppkey", "l_linestatus", "l_returnflag")])
    files = S.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = lines.join(files, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("o_custkey").alias("file"), (F.col("l_suppkey") % 5 + 1).alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("block"), F.col("l_orderkey").alias("article_of"), F.col("l_linenumber").alias("line"), F.col("l_linestatus").alias("text"), F.col("l_returnflag").alias("flag"))


def _refs(blocks: DataFrame) -> DataFrame:
    return blocks.filter("line <= 4").select("file", F.col("article_of").alias("article"), "page", "block", (F.col("line") * 2).cast("long").alias("ord"))


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("article"), F.when(F.col("o_orderkey") % 3 == 0, "Article 99").otherwise(F.col("o_orderpriority")).alias("title"))
    return rows.withColumn("num", F.row_number().over(Window.partitionBy("file").orderBy("article")).cast("long"))


def _selected(blocks: DataFrame) -> DataFrame:
    order = Window.partitionBy("file").orderBy(F.col("block").desc())
    return blocks.filter("flag = 'R'").select("file", "page", "block", F.row_number().over(order).alias("ord"))


@query(f"""with {V_EDIT}, added as (select file, page, block, text from e_blocks union all select file, page, -block, 'new' from e_blocks where line = 1),
  patched as (select file, page, block, case when block > 0 and block % 4 = 0 then 'patched' else text end as text from added) select file, page, block, text from patched where block % 7 <> 0""")
def block_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks after additions, patches (every fourth, and some of blocks that don't exist) and removals (every seventh)."""
    rows = _blocks(spark, sf_dir)
    blocks = rows.select(*D.BLOCK, "text").unionByName(rows.filter("line = 1").select("file", "page", (-F.col("block")).alias("block"), F.lit("new").alias("text")))
    patches = rows.filter("block % 4 = 0").select(*D.BLOCK, F.lit("patched").alias("text")).unionByName(rows.limit(1).select("file", "page", F.lit(3).cast("long").alias("block"), F.lit("nowhere").alias("text")))
    return D.without(D.patched(blocks, patches, D.BLOCK), blocks.filter("block % 7 = 0"), D.BLOCK)


@query(f"""with {V_EDIT}, r as (select *, row_number() over (partition by file, article order by ord, page, block) as o from e_refs where block % 3 <> 0),
  a as (select file, article, title, row_number() over (partition by file order by num, article) as n from e_articles where article in (select article from r))
  select file, article, n as num, case when title = 'Article 99' then 'Article ' || n else title end as title, page, block, o as ord from a join r using (file, article)""")
def remove_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third block goes; articles without blocks go, the others and their orders are renumbered."""
    blocks = _blocks(spark, sf_dir)
    _, articles, refs = D.remove_blocks(blocks, _articles(spark, sf_dir), _refs(blocks), blocks.filter("block % 3 = 0"))
    return articles.join(refs, ["file", "article"]).select("file", "article", "num", "title", "page", "block", "ord")


@query(f"""with {V_EDIT}, r as (select file, article, page, block, row_number() over (partition by file, article order by ord, page, block) as article_ord from e_refs)
  select b.file, b.page, b.block, r.article, r.article_ord from e_blocks b left join r on r.block = b.block""")
def block_back_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir)
    return D.back_pointers(blocks.select(*D.BLOCK), D.compacted_refs(_refs(blocks)))


@query(f"""with {V_EDIT}, f as (select distinct file from e_selected),
  t as (select f.file, case when f.file % 3 = 0 then m.first else -f.file end as dest, f.file % 3 <> 0 as fresh from f join (select file, min(article) as first from e_articles group by file) m on m.file = f.file),
  kept as (select * from e_refs where block not in (select block from e_selected)),
  ends as (select article, max(ord) as e from kept group by article),
  moved as (select s.file, t.dest as article, s.page, s.block, coalesce(e, 0) + row_number() over (partition by s.file order by s.ord) as ord from e_selected s join t on t.file = s.file left join ends on ends.article = t.dest),
  refs as (select file, article, page, block, row_number() over (partition by file, article order by ord, page, block) as ord from (select * from kept union all select * from moved)),
  arts as (select file, article, num, title from e_articles union all select t.file, t.dest, m.n + 1, 'Article ' || (m.n + 1) from t join (select file, max(num) as n from e_articles group by file) m on m.file = t.file where fresh),
  alive as (select * from arts a where a.article in (select article from refs) or a.article in (select dest from t) or a.file not in (select file from f)),
  named as (select file, article, title, row_number() over (partition by file order by num, article) as n from alive)
  select n.file, n.article, n.n as num, case when regexp_matches(title, '^Article [0-9]+$') then 'Article ' || n.n else title end as title, page, block, ord from named n left join refs r on r.article = n.article and r.file = n.file""")
def mark_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected blocks become an article: appended to the first in every third file, else a new one (some name an unknown one)."""
    blocks = store(_blocks(spark, sf_dir), "blocks")
    articles = _articles(spark, sf_dir)
    i = F.col("file") % 3
    targets = articles.groupBy("file").agg(F.min("article").alias("first")).select("file", F.when(i == 0, F.col("first")).when(i == 1, F.lit(-1)).cast("long").alias("article"), (-F.col("file")).alias("fresh"))
    nowhere = blocks.filter("line = 1").select("file", "page", F.lit(-7).cast("long").alias("block"), F.lit(0).alias("ord"))
    named, refs = D.mark_selection(blocks, articles, _refs(blocks), _selected(blocks).unionByName(nowhere), targets)
    return named.join(refs, ["file", "article"], "left").select("file", "article", "num", "title", "page", "block", "ord")


@query(f"""with {V_EDIT}, gone as (select article from e_articles where article % 4 = 0), a as (select *, row_number() over (partition by file order by num, article) as n from e_articles where article not in (select article from gone))
  select a.file, a.article, n as num, case when title = 'Article 99' then 'Article ' || n else title end as title,
    (select count(*) from e_blocks b where b.file = a.file and not (b.article_of in (select article from gone) and b.line <= 4)) as blocks_left, case when a.article % 5 = 0 then 'text ' || a.article end as text from a""")
def remove_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth article goes with its blocks and text; what is left of each file."""
    blocks, articles = _blocks(spark, sf_dir), _articles(spark, sf_dir)
    texts = articles.filter("article % 5 = 0").select("file", "article", F.concat(F.lit("text "), F.col("article").cast("string")).alias("text"))
    left, named, _, kept = D.remove_articles(blocks, articles, _refs(blocks), texts, articles.filter("article % 4 = 0"))
    counts = left.groupBy("file").agg(F.count("*").alias("blocks_left"))
    return named.join(counts, "file", "left").join(kept, ["file", "article"], "left").select("file", "article", "num", "title", F.coalesce("blocks_left", F.lit(0)).alias("blocks_left"), "text")


@query(f"""with {V_EDIT} select file, article, block, row_number() over (partition by file, article order by ord) as i, count(*) over (partition by file, article) as n,
  row_number() over (partition by file order by page, article, ord) as work from e_refs""")
def block_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which block of its article each is, and its turn among the file's work items by page."""
    return D.block_places(_refs(_blocks(spark, sf_dir))).select("file", "article", "block", "i", "n", "work")


@query("""with p as (select user_id as file, event_id % 3 as page, event_id % 7 as block, max(event_id) as last from events group by 1, 2, 3) select file, page, block, row_number() over (partition by file order by last) as ord from p""")
def selection_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = S.table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), (F.col("event_id") % 3).alias("page"), (F.col("event_id") % 7).alias("block"), "event_id")
    return D.pushed(picks, F.col("event_id"))


QUEUE = """q as (select o_custkey as owner, o_orderkey as file, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as pos from orders where o_orderstatus <> 'P')"""


@query(f"""with {QUEUE}, c as (select owner, max(pos) as n from q group by owner), more as (select o_custkey as owner, o_orderkey as file from orders where o_orderkey % 2 = 0 and o_orderkey not in (select file from q))
  select owner, file, pos from q union all select m.owner, m.file, coalesce(n, 0) + row_number() over (partition by m.owner order by m.file) from more m left join c on c.owner = m.owner""")
def queue_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a queue lacks go to its end; those that it has stay where they are, and entries may repeat."""
    more = S.table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("file"), F.col("o_orderkey").alias("at"))
    return D.queue_add(_queue(spark, sf_dir), more.unionByName(more.withColumn("at", F.col("at") + 1)))


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = S.table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'")
    place = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return orders.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("file"), F.row_number().over(place).cast("long").alias("pos"))


@query(f"""with {QUEUE}, s as (select owner, min(pos) as lo, max(pos) as hi from q group by owner), g as (select owner, case when owner % 2 = 0 then hi else lo end as pos, case when owner % 3 = 0 then lo else hi end as cur from s),
  n as (select g.owner, c.file as old, x.file as gone, coalesce(a.file, b.file) as heir from g join q c on c.owner = g.owner and c.pos = g.cur join q x on x.owner = g.owner and x.pos = g.pos left join q a on a.owner = g.owner and a.pos = g.pos + 1 left join q b on b.owner = g.owner and b.pos = g.pos - 1)
  select n.owner, case when old = gone then heir else old end as file, (select count(*) from q where q.owner = n.owner and q.file <> n.gone) as files_left from n""")
def queue_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file of each queue goes, its first or its last; where it was open, its neighbour opens."""
    queue = _queue(spark, sf_dir)
    ends = queue.groupBy("owner").agg(F.min_by("file", "pos").alias("lo"), F.max_by("file", "pos").alias("hi"))
    gone = ends.select("owner", F.when(F.col("owner") % 2 == 0, F.col("hi")).otherwise(F.col("lo")).alias("file"))
    current = ends.select("owner", F.when(F.col("owner") % 3 == 0, F.col("lo")).otherwise(F.col("hi")).alias("file"))
    left, now = D.queue_remove(queue, current, gone)
    counts = left.groupBy("owner").agg(F.count("*").alias("files_left"))
    return now.join(counts, "owner", "left").select("owner", "file", F.coalesce("files_left", F.lit(0)).alias("files_left"))


@query("""with p as (select source as file, doc_id as page, text from documents where doc_id % 2 = 0), e as (select source as file, doc_id as page, 'edited ' || lang as text from documents where doc_id % 3 = 0)
  select coalesce(p.file, e.file) as file, coalesce(p.page, e.page) as page, coalesce(e.text, p.text) as text, 'done' as status, case when p.page is null then 'page_image' else 'document' end as source, e.page is not null as edited from p full join e on p.file = e.file and p.page = e.page""")
def page_text_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents")
    pages = docs.filter("doc_id % 2 = 0").select(F.col("source").alias("file"), F.col("doc_id").alias("page"), "text", F.lit("done").alias("status"), F.lit("document").alias("source"))
    edits = docs.filter("doc_id % 3 = 0").select(F.col("source").alias("file"), F.col("doc_id").alias("page"), F.concat(F.lit("edited "), "lang").alias("text"))
    return D.with_page_texts(pages, edits)


@query("""with t as (select doc_id, text, split_part(text, ' ', 1 + (doc_id % 4)::int) as old from documents), c as (select *, strpos(text, old) as p from t)
  select doc_id, case when trim(old) <> '' and p > 0 and strpos(substr(text, p + 1), old) = 0 then substr(text, 1, p - 1) || '[' || doc_id || ']' || substr(text, p + length(old)) else text end as text from c""")
def replace_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block's new text goes into the page text only where its old one stands there once."""
    old = F.split_part(F.col("text"), F.lit(" "), (F.col("doc_id") % 4 + 1).cast("int"))
    new = F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("]"))
    return S.table(spark, sf_dir, "documents").select("doc_id", D.replaced_once(F.col("text"), old, new).alias("text"))


VERDICTS = """s as (select user_id as key, event_id as i, event_type as category, case when event_id % 2 = 0 then 'accepted' else 'pending' end as verdict from events),
  j as (select key, i, category, case when i % 10 = 0 then 'edited' when i % 5 = 0 then 'rejected' when category = 'click' and key % 2 = 0 then 'rejected' when category = 'error' then 'accepted' else verdict end as verdict, case when i % 10 = 0 then 'text ' || i end as edited_after from s)"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = S.table(spark, sf_dir, "events")
    i = F.col("event_id")
    rows = events.select(F.col("user_id").alias("key"), i.alias("i"), F.col("event_type").alias("category"), F.when(i % 2 == 0, "accepted").otherwise("pending").alias("verdict"), F.lit(None).cast("string").alias("edited_after"))
    one = events.filter("event_id % 5 = 0").select(F.col("user_id").alias("key"), i.alias("i"), F.when(i % 10 == 0, "edited").otherwise("rejected").alias("verdict"), F.concat(F.lit("text "), i.cast("string")).alias("edited_after"))
    users = events.select(F.col("user_id").alias("key")).distinct()
    category = users.filter("key % 2 = 0").select("key", F.lit("click").alias("category"), F.lit("rejected").alias("verdict")).unionByName(users.select("key", F.lit("error").alias("category"), F.lit("accepted").alias("verdict")))
    return D.judged(rows, one, category)


@query(f"with {VERDICTS} select * from j")
def verdict_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of single suggestions over those of whole categories over what there was."""
    return _judged(spark, sf_dir)


@query(f"with {VERDICTS} select key, category, count(*) as suggestions, count(*) filter (where verdict in ('accepted', 'edited')) as applied, case when bool_and(verdict = 'accepted') then 'all' else 'mixed' end as state from j group by key, category")
def category_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.category_states(_judged(spark, sf_dir))


@query("""with r as (select doc_id, text as base, text || '!' as output, case when doc_id % 2 = 0 then 'pending' else 'applied' end as status, case doc_id % 3 when 0 then text when 1 then text || '!' else 'moved' end as live,
    ['apply', 'undo', 'discard', 'apply', 'undo'][(doc_id % 5 + 1)::int] as action from documents),
  d as (select *, action = 'apply' and status = 'pending' and live = base as fits, action = 'undo' and status = 'applied' and live = output as back from r)
  select doc_id, case when fits then output when back then base else live end as text, fits or back or action = 'discard' as done, case when action = 'discard' then null when fits then 'applied' when back then 'pending' else status end as status from d""")
def review_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews applied, undone and discarded, some after their text was changed elsewhere."""
    i, text = F.col("doc_id"), F.col("text")
    output = F.concat(text, F.lit("!"))
    status = F.when(i % 2 == 0, "pending").otherwise("applied")
    live = F.when(i % 3 == 0, text).when(i % 3 == 1, output).otherwise("moved")
    rows = S.table(spark, sf_dir, "documents").select("doc_id", text.alias("base"), output.alias("output"), status.alias("status"), live.alias("live"), F.when(i % 2 == 1, output).alias("applied_text"))
    actions = F.get(F.array(*[F.lit(a) for a in ("apply", "undo", "discard", "apply", "undo")]), (i % 5).cast("int"))
    return D.reviewed(rows, actions).select("doc_id", "text", "done", "status")


@query(f"""with {S.V_RECTS}, t as (select o_custkey as job, o_orderkey as seq, case when o_orderkey % 3 > 0 then o_orderkey end as article, o_orderkey % 9 + 1 as page from orders),
  u as (select article, page, min(least(x, x + w)) as x0, min(least(y, y + h)) as y0, max(greatest(x, x + w)) as x1, max(greatest(y, y + h)) as y1 from v_rects group by article, page),
  e as (select job, seq, 'page:' || page as key, page, null::double as "left", null::double as "top", null::double as "right", null::double as "bottom" from t where article is null
    union all select t.job, t.seq, 'article:' || t.article, u.page, x0 - (x1 - x0) * 0.02::double, y0 - (y1 - y0) * 0.02::double, x1 + (x1 - x0) * 0.02::double, y1 + (y1 - y0) * 0.02::double from t join u on u.article = t.article where x1 > x0 and y1 > y0)
  select job, key, page, round("left", 6) as "left", round("top", 6) as "top", round("right", 6) as "right", round("bottom", 6) as "bottom", row_number() over (partition by job order by seq, page) as i, count(*) over (partition by job) > 20 as too_many from e""")
def proofread_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pictures that the targets of each job need: whole pages, or crops around an article's blocks."""
    targets = S.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey")).alias("article"), (F.col("o_orderkey") % 9 + 1).alias("page"))
    rects = S.rects(spark, sf_dir).withColumn("file", F.lit(0)).withColumn("block", F.col("article") * 10 + F.col("page"))
    boxes = D.article_boxes(rects.select(*D.BLOCK, "article"), rects.select(*D.BLOCK, *"xywh"))
    plan = D.image_plan(targets, boxes, L.RECT_PADDING, 20)
    return plan.select("job", "key", "page", *[F.round(c, 6).alias(c) for c in ("left", "top", "right", "bottom")], "i", "too_many")
