"""Queries over request validation, canvas geometry, keys, messages and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import canvas as C
from quirefold.functions import labels as N
from quirefold.operators import validation as V
from quirefold.plans.registry import query
from quirefold.sources import fixtures as S

KIND = "case when c_custkey % 2 = 0 then 'pdf' else 'image' end"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    provider = F.get(F.array(*[F.lit(p) for p in ("openai", "paddleocr", "openrouter")]), (k % 3).cast("int"))
    return S.table(spark, sf_dir, "customer").select(k.alias("job"), F.when(k % 11 != 0, F.col("c_name")).otherwise("").alias("path"), F.when(k % 2 == 0, "pdf").otherwise("image").alias("kind"), (k % 7).alias("dpi"), provider.alias("provider"))


@query(f"""with a as (select o_custkey as job, count(*) as articles, count(*) filter (where n is null) as bare from orders left join (select l_orderkey, count(*) as n from lineitem where l_linenumber > 1 group by 1) on l_orderkey = o_orderkey group by 1)
  select c_custkey as job, case when c_custkey % 11 = 0 then 'path' when articles is null then 'articles' when bare > 0 then 'blocks' when {KIND} = 'pdf' and c_custkey % 7 = 0 then 'dpi' end as fault from customer left join a on job = c_custkey""")
def grouped_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = S.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("article"))
    blocks = S.table(spark, sf_dir, "lineitem").filter("l_linenumber > 1").select(F.col("l_orderkey").alias("article"))
    return V.grouped_faults(_requests(spark, sf_dir), articles, blocks)


@query(f"""with p as (select o_custkey as job, case when o_orderkey % 37 = 0 then 0 when o_custkey % 5 = 0 then 1 + row_number() over w else o_orderkey % 200 end as page, o_orderkey as k from orders window w as (partition by o_custkey order by o_orderkey)),
  b as (select *, lag(page) over (partition by job order by k) as before from p), l as (select job, count(*) as n, bool_or(page < 1) as zero, bool_or(page <> 1) as other, count(page) <> count(distinct page) as repeated, bool_or(coalesce(before >= page, false)) as unordered from b group by job)
  select c_custkey as job, case when c_custkey % 11 = 0 then 'path' when n is null then 'pages' when zero then 'zero' when {KIND} = 'image' and other then 'image' when repeated then 'repeated' when unordered then 'order'
    when n > case when c_custkey % 3 = 1 and {KIND} = 'pdf' then 12 else 8 end then 'too_many' end as fault from customer left join l on job = c_custkey""")
def whole_file_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules for page lists, with limits of 12 and 8 pages in place of 1000 and 500."""
    from pyspark.sql import Window

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    turn = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    pages = S.table(spark, sf_dir, "orders").select(c.alias("job"), F.when(k % 37 == 0, 0).when(c % 5 == 0, 1 + turn).otherwise(k % 200).alias("page"), k.alias("k"))
    return V.whole_file_faults(_requests(spark, sf_dir), pages, ["k"], document_pages=12, most=8)


@query("""with u as (select source as job, case when doc_id % 401 = 0 then '' else 'page:' || (doc_id - case when doc_id % 97 = 0 then 1 else 0 end) end as key, case when doc_id % 211 = 0 then ' ' else text end as text from documents),
  a as (select job, count(*) as units, bool_or(key = '') as keyless, count(key) <> count(distinct key) as repeated, bool_or(trim(text) = '') as blank, bool_or(length(text) > 90000) as long, sum(length(text))::bigint as chars from u group by job),
  i as (select source as job, count(*) as images, min(case when doc_id % 53 = 0 then 'empty' when doc_id % 59 = 0 then 'prefix' when doc_id % 61 = 0 then 'base64' end) as image from documents where doc_id % 17 = 0 group by 1)
  select job, case when units > 100000 then 'too many units' when keyless then 'key' when repeated then 'repeated' when blank then 'blank' when long then 'long' when image is not null then 'image' when images > 20 then 'too many images'
    when length(job) % 4 = 3 then 'provider' when length(job) % 5 = 0 then 'no model' when chars + units * 11 > 400000 then 'budget' end as fault, chars + units * 11 as budget from a left join i using (job)""")
def proofread_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs are sources; units are their documents, some without key or text; some pictures aren't base64."""
    docs, i = S.table(spark, sf_dir, "documents"), F.col("doc_id")
    key = F.when(i % 401 == 0, "").otherwise(N.target_key(i - F.when(i % 97 == 0, 1).otherwise(0), F.lit(None).cast("string")))
    units = docs.select(F.col("source").alias("job"), key.alias("key"), F.when(i % 211 == 0, " ").otherwise(F.col("text")).alias("text"))
    data = F.when(i % 53 == 0, "").when(i % 59 == 0, "data:image/png;base64,AAAA").when(i % 61 == 0, "A-B_").otherwise("QUJD")
    images = docs.filter("doc_id % 17 = 0").select(F.col("source").alias("job"), data.alias("data"))
    n = F.length("source")
    requests = docs.select("source").distinct().select(F.col("source").alias("job"), F.when(n % 4 == 3, "paddleocr").otherwise("openai").alias("provider"), F.when(n % 5 == 0, "").otherwise("gpt-x").alias("model"), F.lit("read again").alias("prompt"))
    return V.proofread_faults(requests.withColumn("prompt", F.concat("prompt", F.lit("!"))), units, images, {"units": 100_000, "unit_chars": 90_000})


SCREEN = "least(x, x + w)::double * k + px"


@query(f"""with {S.V_RECTS}, t as (select *, (50 + article % 150)::double / 100 as k, (page * 10 - article % 300)::double as px, (article % 200 - 100)::double as py from v_rects),
  p as (select *, x * k + px as l, y * k + py as t0, (x + w) * k + px as r, (y + h) * k + py as b from t)
  select article, page, l >= 0 and t0 >= 0 and r <= 800 and b <= 600 as visible, round(400 - (x + w / 2::double) * k, 6) as pan_x, round(300 - (y + h / 2::double) * k, 6) as pan_y, abs(w) * k >= 6 and abs(h) * k >= 6 as kept,
    case when abs(w) * k >= 6 and abs(h) * k >= 6 then least(x, x + w) end as draw_x from p""")
def canvas_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles on a panned and zoomed canvas: in sight, the shift that centres them, and whether they are large enough to be drawn."""
    a = F.col("article")
    k, px, py = (50 + a % 150).cast("double") / 100, (F.col("page") * 10 - a % 300).cast("double"), (a % 200 - 100).cast("double")
    x, y, w, h = (F.col(c) for c in "xywh")
    rows = S.rects(spark, sf_dir)
    pan_x, pan_y = C.centring_pan(x, y, w, h, k, F.lit(800), F.lit(600))
    drawn = C.drawn(x, y, x + w, y + h, k)
    return rows.select("article", "page", C.fully_visible(C.projected(x, y, w, h, k, px, py), F.lit(800), F.lit(600)).alias("visible"), F.round(pan_x, 6).alias("pan_x"), F.round(pan_y, 6).alias("pan_y"), drawn.isNotNull().alias("kept"), drawn["x"].alias("draw_x"))


@query(f"""with {S.V_RECTS}, s as (select article, page, (abs(w) + 1)::double * 10 as iw, (abs(h) + 1)::double * 10 as ih, 72 + article % 229 as dpi, case when page % 2 = 0 then 2000 end as most from v_rects),
  f as (select *, least(800, greatest(10, floor(least(800 / iw, 600 / ih) * 0.94::double * 100 + 0.5::double))) as pct from s)
  select article, page, pct::bigint as percent, round((800 - iw * (pct / 100)) / 2, 6) as fit_x, round((600 - ih * (pct / 100)) / 2, 6) as fit_y, round(case when most is not null then least(dpi / 72.0::double, most / greatest(iw, ih)) else dpi / 72.0::double end, 9) as scale from f""")
def page_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zoom that shows a whole page, and the scale at which it is rendered."""
    rows = S.rects(spark, sf_dir).select("article", "page", ((F.abs("w") + 1) * 10).cast("double").alias("iw"), ((F.abs("h") + 1) * 10).cast("double").alias("ih"), (72 + F.col("article") % 229).alias("dpi"), F.when(F.col("page") % 2 == 0, 2000).alias("most"))
    percent, x, y = C.fitted(F.col("iw"), F.col("ih"), F.lit(800), F.lit(600))
    return rows.select("article", "page", percent.cast("long").alias("percent"), F.round(x, 6).alias("fit_x"), F.round(y, 6).alias("fit_y"), F.round(C.render_scale(F.col("iw"), F.col("ih"), F.col("dpi"), F.col("most")), 9).alias("scale"))


@query(f"""with {S.V_BLOCKS}, m as (select *, case when doc_id % 3 > 0 then 2.0::double end as sx, case when doc_id % 3 > 0 then 1.5::double end as sy, pos % 2 = 0 as polygon from v_blocks)
  select doc_id, pos, polygon and sx is not null as by_points, round(case when polygon then least(x0, x1) - 5 else least(x0, x1) end * sx, 6) as x, round(least(y0, y1) * sy, 6) as y, round(case when polygon then abs(x1 - x0) + 10 else abs(x1 - x0) end * sx, 6) as w, round(abs(y1 - y0) * sy, 6) as h from m""")
def block_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks on the canvas: by polygon where there is one, else by box, nowhere without a mapping."""
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    polygon = F.when(F.col("pos") % 2 == 0, F.array(point(x0 - 5, y0), point(x1 + 5, y0), point(x1 + 5, y1), point(x0 - 5, y1)))
    mapping = F.when(F.col("doc_id") % 3 > 0, F.struct(F.lit(2.0).alias("sx"), F.lit(1.5).alias("sy")))
    got = S.blocks(spark, sf_dir).select("doc_id", "pos", C.overlay(polygon, x0, y0, x1, y1, mapping).alias("o"))
    return got.select("doc_id", "pos", F.coalesce(F.col("o.points").isNotNull(), F.lit(False)).alias("by_points"), *[F.round(f"o.rect.{c}", 6).alias(n) for c, n in (("x", "x"), ("y", "y"), ("width", "w"), ("height", "h"))])


@query("""select c_custkey, case when n <= 10 then '--article-' || n else printf('%.1f', (220.0::double + (n - 1) * 137.508::double) % 360.0::double) || ' 18% 42%' end as colour from (select c_custkey, greatest(1, c_custkey % 3000 - 3) as n from customer)""")
def article_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "customer").select("c_custkey", C.article_colour(F.col("c_custkey") % 3000 - 3).alias("colour"))


@query("""with p as (select user_id, event_id, event_id % 40 - 5 as done, event_id % 37 as total, event_id % 50 as page, event_id % 23 as requested, ['running', 'cancelling', 'cancelled', 'error', 'done'][(event_id % 5 + 1)::int] as status,
    ['preparing_pages', 'page_done', 'proofread_running', 'chunk_submitting', 'document_running', 'block_running'][(event_id % 6 + 1)::int] as stage from events)
  select event_id, case when requested > 0 then least(greatest(0, done), requested) else done end as done, case when requested > 0 then requested else total end as total, case when requested > 0 then least(greatest(1, page), requested) else page end as page,
    case when total > 0 then least(100, floor(done::double / total * 100 + 0.5::double)) else 0 end::bigint as percent,
    'progress.' || case status when 'running' then case stage when 'preparing_pages' then 'preparing' when 'page_done' then 'finished' when 'proofread_running' then 'proofreading' else 'running' end when 'done' then 'finished' else status end as headline,
    case stage when 'preparing_pages' then 'pages ' || done when 'page_done' then 'page ' || done when 'proofread_running' then 'unit ' || done when 'chunk_submitting' then 'chunk ' || done || ' · pages ' || total when 'block_running' then 'article ' || done else '' end as detail from p""")
def progress_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress within what was asked for, and what is shown of it."""
    i = F.col("event_id")
    pick = lambda *names: F.get(F.array(*[F.lit(n) for n in names]), (i % len(names)).cast("int"))
    rows = S.table(spark, sf_dir, "events").select("event_id", (i % 40 - 5).alias("done"), (i % 37).alias("total"), (i % 50).alias("page"), (i % 23).alias("requested"), pick("running", "cancelling", "cancelled", "error", "done").alias("status"), pick("preparing_pages", "page_done", "proofread_running", "chunk_submitting", "document_running", "block_running").alias("stage"))
    clean = N.clean_progress(F.col("done"), F.col("total"), F.col("page"), F.col("requested"))
    return rows.select("event_id", clean["done"].alias("done"), clean["total"].alias("total"), clean["page"].alias("page"), N.percent(F.col("done"), F.col("total")).alias("percent"), N.headline(F.col("status"), F.col("stage")).alias("headline"), N.detail(F.col("stage"), F.col("done"), F.col("total")).alias("detail"))


@query("""with k as (select doc_id, case doc_id % 5 when 0 then 'page:' || doc_id when 1 then 'article:a_' || doc_id when 2 then 'page:0' when 3 then 'article:' else 'block:' || doc_id end as key from documents)
  select doc_id, case when doc_id % 5 = 0 and doc_id > 0 then doc_id::double end as page, case when doc_id % 5 = 1 then 'a_' || doc_id end as article, case when (doc_id % 5 = 0 and doc_id > 0) or doc_id % 5 = 1 then key end as again from k""")
def target_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target keys taken apart and put together again; keys of other forms have no parts."""
    i = F.col("doc_id")
    text = lambda head: F.concat(F.lit(head), i.cast("string"))
    forms = F.get(F.array(text("page:"), text("article:a_"), F.lit("page:0"), F.lit("article:"), text("block:")), (i % 5).cast("int"))
    rows = S.table(spark, sf_dir, "documents").select("doc_id", N.parsed_key(forms).alias("k"))
    again = F.when(F.col("k").isNotNull(), N.target_key(F.col("k.page").cast("long"), F.col("k.article")))
    return rows.select("doc_id", F.col("k.page").alias("page"), F.col("k.article").alias("article"), again.alias("again"))


@query("""with s as (select user_id, event_id % 4 as own, event_id % 3 as gen, event_id from events),
  r as (select *, coalesce([null, 'openai', 'openrouter', 'paddleocr'][own::int + 1], ['openai_compatible', 'paddleocr', 'openai'][gen::int + 1]) as provider from s)
  select event_id, provider, coalesce(case when event_id % 7 = 0 then 'own' end, case provider when 'openai' then 'm1' when 'openrouter' then 'm2' when 'openai_compatible' then 'm3' else '' end) as model,
    case when event_id % 5 = 0 then 'own prompt' else 'default' end || case when event_id % 2 = 0 then '+images' else '' end as prompt, provider <> 'paddleocr' as chat from r""")
def proofread_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider, model and prompt of a proofreading pass from own and general settings."""
    i = F.col("event_id")
    own = F.get(F.array(F.lit(None), F.lit("openai"), F.lit("openrouter"), F.lit("paddleocr")), (i % 4).cast("int"))
    general = F.get(F.array(F.lit("openai_compatible"), F.lit("paddleocr"), F.lit("openai")), (i % 3).cast("int"))
    provider = N.proofread_provider(own, general)
    models = {"openai": F.lit("m1"), "openrouter": F.lit("m2"), "openai_compatible": F.lit("m3")}
    model = N.proofread_model(F.when(i % 7 == 0, "own").otherwise(""), provider, models)
    prompt = N.proofread_prompt(F.when(i % 5 == 0, "own prompt").otherwise("  "), F.lit("default"), i % 2 == 0, F.lit("+images"))
    return S.table(spark, sf_dir, "events").select("event_id", provider.alias("provider"), model.alias("model"), prompt.alias("prompt"), N.is_chat_provider(provider).alias("chat"))


@query("""with m as (select conv_id, turn, text, case turn % 3 when 0 then 'hello' when 1 then 'pages' else 'nothing' end as key, turn % 2 = 0 as english from conversations)
  select conv_id, turn, case key when 'hello' then case when english then 'Hello ' || conv_id || '!' else '你好 ' || conv_id || '！' end when 'pages' then turn || ' 页 {missing}' else 'nothing' end as message, substr(text, 1, 20) as head,
    least(18, greatest(2, len(string_split(text, chr(10))), ceil(length(text) / 42.0)))::bigint as rows from m""")
def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wordings from a catalogue with their parameters, the head of a text and the rows of its editor."""
    catalogue = spark.createDataFrame([("hello", True, "Hello {name}!"), ("hello", False, "你好 {name}！"), ("pages", False, "{n} 页 {missing}")], "key string, english boolean, template string")
    t = F.col("turn")
    rows = S.table(spark, sf_dir, "conversations").withColumn("key", F.when(t % 3 == 0, "hello").when(t % 3 == 1, "pages").otherwise("nothing")).withColumn("english", t % 2 == 0)
    own = F.broadcast(catalogue.withColumnRenamed("template", "own"))  # the fixed catalogue above
    general = F.broadcast(catalogue.filter("not english").select("key", F.col("template").alias("general")))
    params = F.create_map(F.lit("name"), F.col("conv_id").cast("string"), F.lit("n"), t.cast("string"))
    text = N.interpolated(N.message(F.col("key"), F.col("own"), F.col("general")), params)
    return rows.join(own, ["key", "english"], "left").join(general, "key", "left").select("conv_id", "turn", text.alias("message"), N.first_points(F.col("text"), 20).alias("head"), N.editor_rows(F.col("text")).alias("rows"))


@query("""select page_id, case when page_id % 50 <= 0 or page_id % 7 <= 0 then 'dimensions' when page_id % 3 = 0 then 'length' end as fault, page_id % 50 as w, page_id % 7 as h, least(greatest(1, floor((page_id % 7)::double)), greatest(1, floor((page_id % 11) / 2.0::double)))::bigint as page from pages""")
def raw_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pictures checked and framed, read back from their frames; and page numbers kept inside a document."""
    i = F.col("page_id")
    w, h = i % 50, i % 7
    size = w * h * 4 + F.when(i % 3 == 0, 1).otherwise(0)
    back = C.unframed(C.framed(w, h, F.lit("x").cast("binary")))
    return S.table(spark, sf_dir, "pages").select("page_id", C.rgba_fault(w, h, size).alias("fault"), back["width"].alias("w"), back["height"].alias("h"), N.clamped_page((i % 11) / 2, h).alias("page"))
