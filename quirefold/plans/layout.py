"""Queries over layout blocks and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import layout as L
from quirefold.functions import text as X
from quirefold.operators import articles as A
from quirefold.operators import reading as R
from quirefold.operators.running import numbered
from quirefold.plans.registry import query
from quirefold.sources import fixtures as S

KIND_SQL = """case when bottom >= h * 0.88 and bottom - top <= h * 0.10 then 'Footer'
  when (top <= h * 0.12 and bottom - top <= h * 0.10) or ((x0 <= w * 0.13 or x1 >= w * 0.87) and x1 - x0 <= w * 0.12 and bottom - top <= h * 0.50) then 'Header' end"""
KEY_SQL = S.sql_delete(S.sql_trim(S.sql_clean_line(S.sql_strip_html("text"))))
V_PLACED = f"""v_placed as (select *, {KIND_SQL} as kind, {S.sql_role('label')} as role from (select *, y0 as top, y1 as bottom, coalesce(width, 1000)::double as w, coalesce(height, 1500)::double as h from v_running)),
  v_keyed as (select *, case when length(k) between 3 and 40 then k end as key from (select *, case when role = 'Body' and kind is not null then {KEY_SQL} end as k from v_placed))"""
ORDER_SQL = """row_number() over (partition by doc_id order by case when has_ord then coalesce(ord, 2147483647) else 0 end,
  case when not has_ord then y0 end, case when not has_ord then -x0 end, pos)"""
V_ORDERED = f"v_ordered as (select *, {ORDER_SQL} as seq from (select *, bool_or(ord is not null) over (partition by doc_id) as has_ord, {S.sql_role('label')} as role from v_blocks))"


@query("""select lang, count(*) as documents, sum(len(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '')))::bigint as full_lines,
  sum(length(text))::bigint as chars from documents group by lang""")
def scan_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents")
    full = F.size(F.filter(X.lines(F.col("text")), lambda line: F.trim(line) != ""))
    return docs.groupBy("lang").agg(F.count("*").alias("documents"), F.sum(full).alias("full_lines"), F.sum(F.length("text")).alias("chars"))


@query(f"with {S.V_BLOCKS} select source, label, count(*) as blocks from v_blocks group by source, label")
def label_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.blocks(spark, sf_dir).groupBy("source", "label").agg(F.count("*").alias("blocks"))


@query(f"""with {S.V_BLOCKS} select doc_id, count(*) as blocks, bool_or(trim(text) <> '') as has_text, bool_or(ord is not null) as has_order, bool_or(width is not null) as has_size,
  bool_or(label = 'image') as has_images, bool_or(label in ('header', 'footer', 'number')) as has_furniture from v_blocks group by doc_id""")
def preflight_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    any_of = lambda c: F.bool_or(c)
    return S.blocks(spark, sf_dir).groupBy("doc_id").agg(
        F.count("*").alias("blocks"), any_of(F.trim("text") != "").alias("has_text"), any_of(F.col("ord").isNotNull()).alias("has_order"), any_of(F.col("width").isNotNull()).alias("has_size"),
        any_of(F.col("label") == "image").alias("has_images"), any_of(F.col("label").isin("header", "footer", "number")).alias("has_furniture"),
    )


@query(f"""with {S.V_PAGES}, m as (select source, page, row_number() over (partition by source order by page) as i from v_pages where width is null)
  select source, count(*) as missing, string_agg(page::varchar, '、' order by page) filter (where i <= 5) || case when count(*) > 5 then '…' else '' end as preview from m group by source""")
def missing_dimension_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = numbered(S.pages(spark, sf_dir).filter("width is null").select("source", "page"), ["source"], ["page"], "i")
    shown = F.sort_array(F.collect_list(F.when(F.col("i") <= 5, F.col("page"))))
    counted = missing.groupBy("source").agg(F.count("*").alias("missing"), shown.alias("p"))
    return counted.select("source", "missing", F.concat(F.array_join(F.col("p").cast("array<string>"), "、"), F.when(F.col("missing") > 5, "…").otherwise("")).alias("preview"))


@query(f"""with {S.V_BLOCKS}, p as (select source, doc_id, width, height, greatest(0, max(x1))::double as ext_w, greatest(0, max(y1))::double as ext_h from v_blocks group by source, doc_id, width, height),
  q as (select *, width is not null as measured, coalesce(width::double, ext_w) as w, coalesce(height::double, ext_h) as h from p),
  r as (select *, max(greatest(w, h) * case when measured then 1.0::double else 1.02::double end) over (partition by source) as l, max(least(w, h) * case when measured then 1.0::double else 1.02::double end) over (partition by source) as s from q)
  select source, doc_id, round(case when measured then w when w >= h then l else s end, 6) as page_w, round(case when measured then h when w >= h then s else l end, 6) as page_h, not measured as approximate from r""")
def page_size_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    extents = S.blocks(spark, sf_dir).groupBy("source", "doc_id", "width", "height").agg(F.greatest(F.lit(0), F.max("x1")).alias("ext_w"), F.greatest(F.lit(0), F.max("y1")).alias("ext_h"))
    return R.resolved_sizes(extents, "source").select("source", "doc_id", F.round("page_w", 6).alias("page_w"), F.round("page_h", 6).alias("page_h"), "approximate")


@query(f"with {S.V_BLOCKS} select doc_id, greatest(0, max(x1)) as ext_w, greatest(0, max(y1)) as ext_h from v_blocks group by doc_id")
def bbox_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.blocks(spark, sf_dir).groupBy("doc_id").agg(F.greatest(F.lit(0), F.max("x1")).alias("ext_w"), F.greatest(F.lit(0), F.max("y1")).alias("ext_h"))


@query(f"""with {S.V_BLOCKS} select doc_id, pos, round(least(x0, x1) * 1.5::double, 6) as sx0, round(least(y0, y1) * 0.75::double, 6) as sy0, round(greatest(x0, x1) * 1.5::double, 6) as sx1,
  round(greatest(y0, y1) * 0.75::double, 6) as sy1 from v_blocks""")
def bbox_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = L.scaled_box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")], F.lit(1.5), F.lit(0.75))
    return S.blocks(spark, sf_dir).select("doc_id", "pos", *[F.round(v, 6).alias(n) for v, n in zip(sides, ("sx0", "sy0", "sx1", "sy1"))])


@query("""with p as (select doc_id, 1000::double as lw, 1500::double as lh, 2000::double as cw, (3000 + doc_id % 200)::double as ch, doc_id % 3 = 0 as approx from documents)
  select doc_id, round(case when approx then least(ch / lh, cw / lw) when abs((cw / lw) / (ch / lh) - 1) <= 0.02 then cw / lw end, 6) as sx,
         round(case when approx then least(ch / lh, cw / lw) when abs((cw / lw) / (ch / lh) - 1) <= 0.02 then ch / lh end, 6) as sy from p""")
def canvas_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents").select("doc_id")
    got = L.canvas_mapping(F.lit(1000.0), F.lit(1500.0), F.lit(2000.0), (3000 + F.col("doc_id") % 200).cast("double"), F.col("doc_id") % 3 == 0)
    return docs.select("doc_id", got.alias("m")).select("doc_id", F.round("m.sx", 6).alias("sx"), F.round("m.sy", 6).alias("sy"))


@query(f"with {S.V_RECTS} select article, page, least(x, x + w) as bx, least(y, y + h) as by, abs(w) as bw, abs(h) as bh from v_rects")
def polygon_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, w, h = (F.col(c) for c in "xywh")
    corners = L.points(F.array(x, y, x + w, y, x + w, y + h, x, y + h))
    return S.rects(spark, sf_dir).select("article", "page", L.bounds(corners).alias("r")).select("article", "page", F.col("r.x").alias("bx"), F.col("r.y").alias("by"), F.col("r.width").alias("bw"), F.col("r.height").alias("bh"))


@query(f"""with {S.V_RECTS}, u as (select article, min(least(x, x + w)) as ux, min(least(y, y + h)) as uy, max(greatest(x, x + w)) - min(least(x, x + w)) as uw,
  max(greatest(y, y + h)) - min(least(y, y + h)) as uh from v_rects group by article)
  select article, ux, uy, uw, uh, round(ux - uw * 0.02::double, 6) as px, round(uy - uh * 0.02::double, 6) as py from u where uw > 0 and uh > 0""")
def article_union_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.padded(A.union_rects(S.rects(spark, sf_dir), ["article"]))
    return out.select("article", "ux", "uy", "uw", "uh", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"))


@query(f"""with {S.V_RECTS}, c as (select article, page, greatest(0, least(x, 800))::bigint as l, greatest(0, least(y, 600))::bigint as t, least(800, x + w)::bigint as r, least(600, y + h)::bigint as b from v_rects where w > 0 and h > 0)
  select article, page, l as "left", t as "top", greatest(0, r - l)::bigint as crop_w, greatest(0, b - t)::bigint as crop_h from c""")
def crop_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = L.clamp_crop(*[F.col(c) for c in "xywh"], F.lit(800), F.lit(600))
    return S.rects(spark, sf_dir).filter("w > 0 and h > 0").select("article", "page", *[v.cast("long").alias(k) for k, v in got.items()])


@query(f"""with {S.V_RECTS} select article, page, least(round(x * 1.5::double)::bigint, 1199) as cx, least(round(y * 1.5::double)::bigint, 899) as cy,
  greatest(1, least(round(w * 1.5::double)::bigint, 1200 - least(round(x * 1.5::double)::bigint, 1199))) as cw, greatest(1, least(round(h * 1.5::double)::bigint, 900 - least(round(y * 1.5::double)::bigint, 899))) as ch
  from v_rects where w >= 0 and h >= 0""")
def crop_block_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = L.crop_block(*[F.col(c) for c in "xywh"], F.lit(1.5), 1200, 900)
    return S.rects(spark, sf_dir).filter("w >= 0 and h >= 0").select("article", "page", *[v.alias(n) for v, n in zip(got, ("cx", "cy", "cw", "ch"))])


@query(f"""with {S.V_RECTS}, s as (select article, page, w * 10 as w, h * 10 as h, least(1.0::double, 2000::double / greatest(w * 10, h * 10)) as k from v_rects where w > 0 and h > 0)
  select article, page, greatest(1, round(w * k)::bigint) as fit_w, greatest(1, round(h * k)::bigint) as fit_h from s""")
def long_edge_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.rects(spark, sf_dir).filter("w > 0 and h > 0")
    w, h = L.fit_long_edge(F.col("w") * 10, F.col("h") * 10, 2000)
    return rows.select("article", "page", w.alias("fit_w"), h.alias("fit_h"))


@query(f"with {S.V_BLOCKS} select {S.sql_role('label')} as role, count(*) as blocks from v_blocks group by 1")
def role_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.blocks(spark, sf_dir).groupBy(L.role(F.col("label")).alias("role")).agg(F.count("*").alias("blocks"))


@query(f"""with {S.V_BLOCKS}, r as (select source, {S.sql_role('label')} as role from v_blocks) select source, count(*) filter (where role = 'Header') as headers, count(*) filter (where role = 'Footer') as footers,
  count(*) filter (where role = 'PageNumber') as numbers, count(*) filter (where role = 'Aside') as asides, count(*) filter (where role = 'Footnote') as footnotes from r group by source""")
def label_gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.blocks(spark, sf_dir).select("source", L.gate(F.col("label")).alias("gate"))
    names = {"Header": "headers", "Footer": "footers", "PageNumber": "numbers", "Aside": "asides", "Footnote": "footnotes"}
    return rows.groupBy("source").agg(*[F.count_if(F.col("gate") == k).alias(v) for k, v in names.items()])


@query(f"with {S.V_BLOCKS}, r as (select doc_id, pos, {S.sql_role('label')} as role from v_blocks) select * from r where role not in ('Header', 'Footer', 'Aside', 'PageNumber')")
def reading_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.blocks(spark, sf_dir).select("doc_id", "pos", L.role(F.col("label")).alias("role")).filter(L.included(F.col("role")))


@query(f"with {S.V_BLOCKS}, {S.V_RUNNING}, {V_PLACED} select doc_id, pos, kind from v_placed where kind is not null")
def furniture_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_furniture(S.blocks(spark, sf_dir)).filter("kind is not null").select("doc_id", "pos", "kind")


def _volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_furniture(S.running_lines(S.blocks(spark, sf_dir)))


@query(f"""with {S.V_BLOCKS}, {S.V_RUNNING}, {V_PLACED} select volume, key, count(distinct doc_id) as pages from v_keyed where key is not null group by volume, key having count(distinct doc_id) >= 3""")
def repeated_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.repeated_keys(_volumes(spark, sf_dir), ["volume"], "doc_id")


@query(f"""with {S.V_BLOCKS}, {S.V_RUNNING}, {V_PLACED}, rep as (select volume, key from v_keyed where key is not null group by volume, key having count(distinct doc_id) >= 3)
  select b.volume, count(*) as kept from v_keyed b where not exists (select 1 from rep r where r.volume = b.volume and r.key = b.key) group by b.volume""")
def furniture_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.without_furniture(_volumes(spark, sf_dir), ["volume"], "doc_id").groupBy("volume").agg(F.count("*").alias("kept"))


@query(f"with {S.V_BLOCKS}, {V_ORDERED} select doc_id, pos, seq from v_ordered")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.in_reading_order(S.blocks(spark, sf_dir), ["doc_id"]).select("doc_id", "pos", "seq")


ITEM_SQL = f"case when role = 'Image' then '[image: not embedded]' || case when {S.sql_strip_html('text')} = '' then '' else ' ' || {S.sql_strip_html('text')} end when role = 'Table' then {S.sql_trim('text')} else {S.sql_trim(S.sql_clean_line('text'))} end"
V_ITEMS = f"v_items as (select * from (select doc_id, seq, role, {ITEM_SQL} as item from v_ordered where role not in ('Header', 'Footer', 'Aside', 'PageNumber')) where item <> '')"


@query(f"with {S.V_BLOCKS}, {V_ORDERED}, {V_ITEMS} select doc_id, seq, role, item from v_items")
def reading_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: included blocks of every page in reading order with their cleaned text."""
    return R.reading_items(S.blocks(spark, sf_dir), ["doc_id"]).select("doc_id", "seq", "role", "item")


@query(f"""with {S.V_BLOCKS}, {V_ORDERED}, {V_ITEMS}, m as (select doc_id, seq, case role when 'DocTitle' then '# ' || item when 'Heading' then '## ' || item when 'FigureCaption' then '### ' || item
    when 'Footnote' then '> ' || item else item end as md from v_items)
  select doc_id, string_agg(md, chr(10) || chr(10) order by seq) || chr(10) || chr(10) as markdown from m group by doc_id""")
def reading_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.markdown(R.reading_items(S.blocks(spark, sf_dir), ["doc_id"]), ["doc_id"])


@query(f"""with {S.V_BLOCKS} select doc_id, coalesce(string_agg({S.sql_trim('text')}, chr(10) || chr(10) order by ord nulls last, pos) filter (where {S.sql_trim('text')} <> ''), '') as page_text
  from v_blocks where doc_id % 3 <> 0 group by doc_id union all select doc_id, text as page_text from documents where doc_id % 3 = 0""")
def page_text_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown where a page has some (every third), else the full blocks by order."""
    docs = S.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).alias("markdown"))
    place = F.struct(F.coalesce("ord", F.lit(2**31)).alias("o"), "pos", X.trim_ws(F.col("text")).alias("t"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(X.not_blank(F.col("text")), place))), lambda p: p["t"]), "\n\n")
    made = S.blocks(spark, sf_dir).groupBy("doc_id").agg(joined.alias("made"))
    return docs.join(made, "doc_id").select("doc_id", F.coalesce("markdown", "made").alias("page_text"))


@query(f"with {S.V_PAGES}, t as (select source, page, {S.sql_trim('text')} as b from v_pages) select source, string_agg('# Page ' || page || chr(10) || chr(10) || b, chr(10) || chr(10) order by page) as bulk from t where b <> '' group by source")
def all_pages_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.pages(spark, sf_dir).withColumn("b", X.trim_ws(F.col("text"))).filter("b <> ''")
    part = F.concat(F.lit("# Page "), F.col("page").cast("string"), F.lit("\n\n"), F.col("b"))
    return rows.groupBy("source").agg(A.joined(F.struct("page", part.alias("t")), ["page"], "t", "\n\n").alias("bulk"))
