"""Queries over typeset text: wrapped lines and pages, beside recursive SQL that takes line by line and page by page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.operators import reading as R
from quirefold.operators import typesetting as T
from quirefold.plans.layout import V_ITEMS, V_ORDERED
from quirefold.plans.registry import query
from quirefold.sources import fixtures as S

SIZE, FIRST, FULL = 10.5, 462.0, 483.0
WIDE = " or ".join(f"c between chr({a}) and chr({b})" for a, b in T.FULL_WIDTH)
WIDTH = f"case when strlen(c) = 1 then case when c in (' ', chr(9), chr(10), chr(12), chr(13)) then 30 else 52 end when {WIDE} then 100 else 82 end"


def sql_wrap(paragraphs: str) -> str:
    """v_wrapped (id, k, n, line) of a table (id, text, first_limit, full_limit): k counts full source lines and n their pieces, from 1."""
    fits = f"(select greatest(1, len(list_filter(range(1, len(w) + 1), lambda j: list_sum(w[1:j]) <= room))) from (select list_transform(string_split(left(rest, 512), ''), lambda c: {WIDTH}) as w))"
    return f"""v_said as (select id, row_number() over (partition by id order by i) as k, line, first_limit, full_limit from
      (select id, first_limit, full_limit, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from {paragraphs}) where {S.sql_trim('line')} <> ''),
    v_cut as (select id, k, 0 as n, ''::varchar as piece, line as rest, case when k = 1 then first_limit else full_limit end as room, full_limit from v_said
      union all select id, k, n + 1, left(rest, fits), substr(rest, fits + 1), full_limit, full_limit from (select *, {fits} as fits from v_cut where rest <> '')),
    v_wrapped as (select id, k, n, piece as line from v_cut where n > 0 union all select id, 1, 1, '' from {paragraphs} where id not in (select id from v_said))"""


@query(f"""with recursive v_texts as (select doc_id as id, text, {T.limit(FIRST, SIZE)} as first_limit, {T.limit(FULL, SIZE)} as full_limit from documents), {sql_wrap('v_texts')}
  select id as doc_id, count(*) as n_lines, max(length(line)) as longest, string_agg(line, chr(10) order by k, n) as lines from v_wrapped group by id""")
def line_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.wrapped(S.table(spark, sf_dir, "documents").select("doc_id", "text"), size=SIZE, first_width=FIRST, width=FULL)


V_STYLES = "v_styles as (select * from (values " + ", ".join(f"('{role}', {m['first']}, {m['full']}, {m['step']}, {m['before']}, {m['after']})" for role, m in T.measures().items()) + ") t(role, first_limit, full_limit, step, before, after))"
TOP, HEIGHT = T.milli(T.PAGE_H - T.MARGIN_TOP), T.milli(T.PAGE_H - T.MARGIN_TOP) - T.milli(T.MARGIN_BOTTOM)


@query(f"""with recursive {S.V_BLOCKS}, {V_ORDERED}, {V_ITEMS}, {V_STYLES},
  v_paras as (select doc_id, seq, doc_id || '/' || seq as id, item as text, s.* from v_items join v_styles s using (role)), {sql_wrap('v_paras')},
  v_numbered as (select p.doc_id, p.seq, p.step, p.before, p.after, w.line, row_number() over (partition by id order by k, n) - 1 as line_no, count(*) over (partition by id) as of_item from v_wrapped w join v_paras p using (id)),
  v_lines as (select *, sum(step + case when line_no = 0 then before else 0 end) over w + coalesce(sum(case when line_no = of_item - 1 then after end) over (w rows between unbounded preceding and 1 preceding), 0) as depth from v_numbered window w as (partition by doc_id order by seq, line_no)),
  v_starts as (select doc_id, min(depth) as depth, arg_min(step, depth) as step, 1::bigint as page from v_lines group by doc_id
    union all select s.doc_id, min(l.depth), arg_min(l.step, l.depth), s.page + 1 from v_starts s join v_lines l on l.doc_id = s.doc_id and l.depth > greatest(s.depth, s.depth - s.step + {HEIGHT}) group by s.doc_id, s.page),
  v_pages as (select *, lead(depth) over (partition by doc_id order by page) as until from v_starts)
  select l.doc_id::varchar as doc, page, seq, line_no, ({TOP} - (l.depth - p.depth + p.step)) / 1000.0::double as y, line from v_lines l join v_pages p on l.doc_id = p.doc_id and l.depth >= p.depth and (until is null or l.depth < until)""")
def pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading items of every document on pages."""
    items = R.reading_items(S.blocks(spark, sf_dir), ["doc_id"]).select(F.col("doc_id").cast("string").alias("doc"), "seq", "role", "item")
    return T.paginated(items)
