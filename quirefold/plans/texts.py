"""Queries over texts: cleaning, anchors, suggestions, wrapping, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.functions import labels
from quirefold.functions import net as N
from quirefold.functions import text as X
from quirefold.operators import proofreading as P
from quirefold.plans.registry import query
from quirefold.sources import fixtures as S

NL = "chr(10)"
DECODE = "replace(replace(replace(replace(replace(replace({}, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', '''')"


@query(f"""with {S.V_BLOCKS}, l as (select doc_id, pos, ['# ' || text, '> **' || text || '**', '`' || text || '`', '*' || text || '*', '  ## > ' || text][(doc_id % 5 + 1)::int] as line from v_blocks),
  c as (select doc_id, pos, {S.sql_clean_line('line')} as cleaned from l) select doc_id, {S.sql_trim(f"string_agg(cleaned, {NL} order by pos)")} as cleaned from c group by doc_id""")
def clean_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of which every line carries marks."""
    marks = F.get(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in (("# ", ""), ("> **", "**"), ("`", "`"), ("*", "*"), ("  ## > ", ""))]), (F.col("doc_id") % 5).cast("int"))
    marked = F.array_join(F.transform(X.lines(F.col("text")), lambda line: F.concat(F.col("m.a"), line, F.col("m.b"))), "\n")
    return S.table(spark, sf_dir, "documents").withColumn("m", marks).select("doc_id", X.clean_block_text(marked).alias("cleaned"))


@query(f"select page_id, regexp_replace({S.sql_trim(chr(114) + 'egexp_replace(html, ' + chr(39) + '<[^>]*>' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')}, '{S.WS}+', ' ', 'g') as plain from pages")
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "pages").select("page_id", X.strip_html(F.col("html")).alias("plain"))


@query(f"select r_name, string_agg(n_name || ' | A 1 | B&2', {NL} order by n_nationkey) as plain from nation join region on n_regionkey = r_regionkey group by r_name")
def html_table_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat(F.lit("<tr class='x'><td>"), F.col("n_name"), F.lit("</td><TD>A&nbsp;1</TD><td> </td><th>B&amp;2</th></tr>"))
    rows = S.table(spark, sf_dir, "nation").join(S.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    html = rows.groupBy("r_name").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", row.alias("t")))).alias("p"))
    return html.select("r_name", X.html_table_text(F.concat(F.lit("<table>"), F.array_join(F.transform("p", lambda p: p["t"]), ""), F.lit("</table>"))).alias("plain"))


@query(f"select page_id, {DECODE.format('html')} as decoded from pages")
def html_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "pages").select("page_id", X.decode_entities(F.col("html")).alias("decoded"))


@query(f"""with w as (select doc_id, list_filter(regexp_split_to_array(text, '[ {chr(92)}n]+'), lambda x: x <> '') as a from documents),
  s as (select doc_id, list_transform(a, lambda x: substr(x, 1, (doc_id % 6 + 1)::int)) as a from w)
  select doc_id, case when len(a) >= 2 and len(list_filter(a, lambda x: length(x) > 4)) = 0 then list_aggregate(a, 'string_agg', '') else coalesce(list_aggregate(a, 'string_agg', {NL}), '') end as repaired from s""")
def short_line_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split("text", r"[ \n]+"), lambda w: w != "")
    short = F.transform(words, lambda w: F.substring(w, F.lit(1), (F.col("doc_id") % 6 + 1).cast("int")))
    return S.table(spark, sf_dir, "documents").select("doc_id", X.repair_short_lines(F.array_join(short, "\n")).alias("repaired"))


@query("""with p as (select page_id, case when page_id % 3 = 0 then url || '/?a=b/c' when page_id % 3 = 1 then url || repeat('x', 90) else ' ' end as ref from pages),
  d as (select page_id, ref, list_filter(string_split(split_part(ref, '?', 1), '/'), lambda x: x <> '')[-1] as name from p)
  select page_id, case when trim(ref) = '' then '[image: not embedded]' else '[image: not embedded: ' || case when length(name) > 80 then substr(name, 1, 79) || '…' else name end || ']' end as placeholder from d""")
def image_placeholder(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id") % 3
    ref = F.when(i == 0, F.concat("url", F.lit("/?a=b/c"))).when(i == 1, F.concat("url", F.repeat(F.lit("x"), 90))).otherwise(" ")
    return S.table(spark, sf_dir, "pages").select("page_id", X.image_placeholder(ref).alias("placeholder"))


@query(f"select doc_id, {S.sql_delete('text || chr(12288) || lang || chr(160)')} as bare from documents")
def whitespace_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents").select("doc_id", X.delete_ws(F.concat("text", F.lit("　"), "lang", F.lit(" "))).alias("bare"))


ANCHOR = f"""t as (select doc_id, text, split_part(text, ' ', 2 + (doc_id % 3)::int) || ' ' || split_part(text, ' ', 3 + (doc_id % 3)::int) as before, split_part(text, ' ', 1 + (doc_id % 3)::int) as context from documents),
  h as (select *, {S.sql_delete('text')} as hay, {S.sql_delete('context || before')} as needle from t)"""
COUNTED = "case when needle = '' or strpos(hay, needle) = 0 then 0 when strpos(substr(hay, strpos(hay, needle) + 1), needle) = 0 then 1 else 2 end"


@query(f"with {ANCHOR} select doc_id, {COUNTED} = 1 and {S.sql_trim('before')} <> '' as anchored from h")
def anchor_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = lambda i: F.split_part(F.col("text"), F.lit(" "), i.cast("int"))
    k = F.col("doc_id") % 3
    docs = S.table(spark, sf_dir, "documents")
    return docs.select("doc_id", P.anchored(F.col("text"), F.concat(word(2 + k), F.lit(" "), word(3 + k)), word(1 + k)).alias("anchored"))


@query(f"""with {S.V_BLOCKS}, b as (select doc_id, pos, {S.sql_delete('text')} as hay from v_blocks where {S.sql_trim('text')} <> ''), n as (select doc_id, {S.sql_delete("split_part(text, ' ', 3)")} as own, {S.sql_delete("case when doc_id % 2 = 0 then split_part(text, ' ', 2) else 'never' end || split_part(text, ' ', 3)")} as needle from documents)
  select n.doc_id, min(pos) as block from n left join b on b.doc_id = n.doc_id and ((own <> '' and contains(hay, own)) or (needle <> '' and contains(hay, needle))) group by n.doc_id""")
def anchor_block_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first block of a page that contains a suggestion, with its context or without."""
    word = lambda i: F.split_part(F.col("text"), F.lit(" "), F.lit(i))
    found = S.table(spark, sf_dir, "documents").select("doc_id", word(3).alias("before"), F.when(F.col("doc_id") % 2 == 0, word(2)).otherwise("never").alias("context"))
    return P.block_of(found, S.blocks(spark, sf_dir), ["doc_id"]).select("doc_id", "block")


@query("""select conv_id, turn, case turn % 6 when 0 then null when 1 then 'empty' when 2 then 'truncated' when 3 then 'prose' when 4 then 'invalid' end as fault from conversations""")
def suggestion_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with replies of which no suggestions can be read."""
    good = '[{"before": "a", "after": "b", "category": "punct", "confidence": 0.5}]'
    forms = F.array(*[F.lit(x) for x in (good, " \n", 'Here: [{"before": "a", ', "no changes needed", '[{"before": 1}, {"x": 2}]', "```json\n" + good + "\n```")])
    return S.table(spark, sf_dir, "conversations").select("conv_id", "turn", X.suggestion_fault(F.get(forms, (F.col("turn") % 6).cast("int"))).alias("fault"))


@query("""select conv_id, turn, (case when turn % 3 = 2 then 'missing' else 'ok' end) as state, (case when turn % 3 = 2 then null else 2 end)::bigint as found,
  (case when turn % 3 = 2 then null else role end) as first_before, (case when turn % 3 = 2 then null else 0.5::double end) as first_confidence from conversations""")
def suggestion_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions out of replies: bare, fenced, or none."""
    one = F.to_json(F.struct(F.col("role").alias("before"), F.lit("x").alias("after"), F.lit("punct").alias("category"), F.lit(0.5).alias("confidence")))
    array = F.concat(F.lit("["), one, F.lit(","), one, F.lit("]"))
    reply = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Here: "), array, F.lit(" done"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("```json\n"), array, F.lit("\n```"))).otherwise("no changes")
    found = F.from_json(X.json_array_in(reply), "array<struct<before string, after string, category string, confidence double>>")
    rows = S.table(spark, sf_dir, "conversations").select("conv_id", "turn", found.alias("f"))
    return rows.select("conv_id", "turn", F.when(F.col("f").isNull(), "missing").otherwise("ok").alias("state"), F.when(F.col("f").isNotNull(), F.size("f")).cast("long").alias("found"), F.get("f", 0)["before"].alias("first_before"), F.get("f", 0)["confidence"].alias("first_confidence"))


@query("""with s as (select event_id, user_id, ['punct', 'charform', 'garble', 'layout', 'semantic'][(event_id % 5 + 1)::int] as category from events)
  select user_id, category, count(*) as suggestions, case when category in ('punct', 'charform', 'garble') then 'accepted' else 'pending' end as verdict from s group by user_id, category""")
def verdict_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("punct", "charform", "garble", "layout", "semantic")])
    rows = S.table(spark, sf_dir, "events").select("user_id", F.get(names, (F.col("event_id") % 5).cast("int")).alias("category"))
    return rows.groupBy("user_id", "category").agg(F.count("*").alias("suggestions")).withColumn("verdict", labels.default_verdict(F.col("category")))


@query("""select source, count(*) as units, sum(length(text))::bigint as chars, max(length(text))::bigint as longest, count(*) > 200 as too_many, max(length(text)) > 20000 as too_long, sum(length(text)) + count(*) * 1000 > 400000 as over_budget
  from documents group by source""")
def proofread_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, size = F.count("*"), F.sum(F.length("text"))
    longest = F.max(F.length("text"))
    return S.table(spark, sf_dir, "documents").groupBy("source").agg(n.alias("units"), size.alias("chars"), longest.cast("long").alias("longest"), (n > 200).alias("too_many"), (longest > 20000).alias("too_long"), (size + n * 1000 > 400000).alias("over_budget"))


@query(f"""with w as (select doc_id, text, split_part(text, ' ', 2) as before from documents), c as (select *, {COUNTED} as k from (select *, {S.sql_delete('text')} as hay, {S.sql_delete('before')} as needle from w))
  select doc_id::varchar as key, case when k = 1 then substr(text, 1, strpos(text, before) - 1) || '[' || regexp_replace(before, '({S.WS}+)', '\\1\\1', 'g') || ']' || substr(text, strpos(text, before) + length(before)) else text end as text,
         (k = 1)::bigint as applied, (k = 1)::bigint as conflicts from c""")
def apply_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second words put into brackets where their place is unique; a second suggestion for the same place is a conflict.

    Whitespace inside of a word's replacement comes beside that of the text, which stays.
    """
    before = F.split_part(F.col("text"), F.lit(" "), F.lit(2))
    to = lambda head, tail: F.struct(before.alias("before"), F.concat(F.lit(head), before, F.lit(tail)).alias("after"), F.lit("").alias("context"))
    units = S.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), "text", F.array(to("[", "]"), to("", "!")).alias("suggestions"))
    return P.apply_suggestions(units)


#: The changes of `suggestion_rules`, by the document's id: what a suggestion wants for the word w. Signs that no text has.
_RULES = 8
_LONG = 110


def _probe(w: Column) -> tuple[Column, Column, Column]:
    """(before, after, text) of a word that is written downwards, one character a line, and changed by one of the rules."""
    k = F.col("doc_id") % _RULES
    n = F.length(w)
    signs = lambda m: F.repeat(F.lit("¤"), m)
    many = F.repeat(w, _LONG)
    before = F.when(k == 2, F.concat(F.lit("¤€"), w)).when(k == 6, F.concat(F.lit("¤"), many)).otherwise(w)
    after = (
        F.when(k == 0, signs(n)).when(k == 1, signs(n + 2)).when(k == 2, w).when(k == 3, F.concat(w, F.lit(" ¤\n"))).when(k == 4, F.concat(F.substring(w, 1, 1), F.lit("¤"), F.substring(w, F.lit(2), n)))
        .when(k == 5, F.lit("¤ ¤")).when(k == 6, F.concat(F.lit("€"), many, F.lit("€€"))).otherwise("")
    )
    down = F.array_join(F.regexp_extract_all(before, F.lit("(?s)."), F.lit(0)), "\n")
    return before, after, down


def _sql_down(x: str) -> str:
    return f"array_to_string(regexp_extract_all({x}, '(?s).'), chr(10))"


@query(f"""with d as (select doc_id, coalesce(text, '') as text, regexp_extract(coalesce(text, ''), '[A-Za-z][A-Za-z]+') as w, doc_id % {_RULES} as k, ['accepted', 'edited', 'rejected', 'pending', 'accepted'][(doc_id % 5 + 1)::int] as verdict from documents),
  b as (select *, case k when 2 then '¤€' || w when 6 then '¤' || repeat(w, {_LONG}) else w end as before from d),
  t as (select *, '@@' || {_sql_down("before")} || chr(10) || text as raw from b),
  r as (select *, case k when 0 then {_sql_down("repeat('¤', length(w))")} when 1 then repeat('¤', length(w) + 2) when 2 then chr(10) || {_sql_down("w")} when 3 then {_sql_down("w")} || ' ¤' || chr(10)
      when 4 then left(w, 1) || chr(10) || '¤' || {_sql_down("substr(w, 2)")} when 5 then case when length(w) = 3 then '¤' || chr(10) || ' ' || chr(10) || '¤' else '¤ ¤' end when 6 then '€' || repeat(w, {_LONG}) || '€€' else '' end as part from t)
  select doc_id::varchar as key, case when w = '' or verdict in ('rejected', 'pending') then raw else '@@' || (case when verdict = 'edited' then repeat('§', length(before) + 1) else part end) || chr(10) || text end as text,
    (w <> '' and verdict in ('accepted', 'edited'))::bigint as applied, (w <> '' and verdict in ('accepted', 'edited') and doc_id % 2 = 0)::bigint as conflicts from r""")
def suggestion_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions with verdicts for a word written downwards: each rule for whitespace, and a change too long to align."""
    w = F.regexp_extract(F.coalesce("text", F.lit("")), "[A-Za-z][A-Za-z]+", 0)
    before, after, down = _probe(F.col("w"))
    verdict = F.get(F.array(*[F.lit(v) for v in ("accepted", "edited", "rejected", "pending", "accepted")]), (F.col("doc_id") % 5).cast("int"))
    docs = S.table(spark, sf_dir, "documents").withColumn("w", w).select("doc_id", "text", "w", before.alias("before"), after.alias("after"), down.alias("down"), verdict.alias("verdict"))
    one = lambda after: F.struct("before", after.alias("after"), F.lit("@@").alias("context"), "verdict", F.repeat(F.lit("§"), F.length("before") + 1).alias("edited_after"))
    # A word of its own, which no text has: a suggestion that changes nothing would be passed over and be no conflict.
    twice = F.when(F.col("doc_id") % 2 == 0, F.array(one(F.col("after")), one(F.lit("¤again")))).otherwise(F.array(one(F.col("after"))))
    wanted = F.when(F.col("w") == "", F.slice(twice, 1, 0)).otherwise(twice)  # without a word there is nothing to suggest
    raw = F.concat(F.lit("@@"), F.col("down"), F.lit("\n"), F.coalesce("text", F.lit("")))
    return P.apply_suggestions(docs.select(F.col("doc_id").cast("string").alias("key"), raw.alias("text"), wanted.alias("suggestions")))


@query("""with s as (select url, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) as scheme, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]*)', 1)) as host, page_id from
    (select page_id, case page_id % 5 when 0 then url when 1 then 'http://localhost:80/x' when 2 then 'https://10.1.2.3/' when 3 then 'ftp://a.example.org/' else 'https://a.b@c.example.org/' end as url from pages))
  select page_id, case when page_id % 5 = 3 then 'scheme' when page_id % 5 = 4 then 'userinfo' when scheme <> 'https' then 'https' when page_id % 5 = 2 then 'internal' when strpos(host, '.') = 0 then 'internal' else 'ok' end as verdict from s""")
def url_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = F.array(F.col("url"), *[F.lit(x) for x in ("http://localhost:80/x", "https://10.1.2.3/", "ftp://a.example.org/", "https://a.b@c.example.org/")])
    return S.table(spark, sf_dir, "pages").select("page_id", N.url_verdict(F.get(forms, (F.col("page_id") % 5).cast("int"))).alias("verdict"))


NAMES = "['scan.PNG', 'a.b.pdf', 'notes.txt', 'x.Tiff', 'raw.dng', 'noext'][(page_id % 6 + 1)::int]"


@query(f"with f as (select page_id, {NAMES} as name from pages) select lower(regexp_extract(name, '\\.([^.]+)$', 1)) in ('png', 'jpg', 'jpeg', 'tif', 'tiff', 'bmp', 'dng', 'pdf') as supported, count(*) as files from f group by 1")
def extension_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("scan.PNG", "a.b.pdf", "notes.txt", "x.Tiff", "raw.dng", "noext")])
    ext = X.file_extension(F.get(names, (F.col("page_id") % 6).cast("int")))
    return S.table(spark, sf_dir, "pages").groupBy(ext.isin("png", "jpg", "jpeg", "tif", "tiff", "bmp", "dng", "pdf").alias("supported")).agg(F.count("*").alias("files"))


@query(f"select page_id, translate(url, '/{chr(92)}:', '___') as safe, regexp_replace(url, '\\.[^.]+$', '') as stem from pages")
def filename_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "pages").select("page_id", X.safe_name(F.col("url")).alias("safe"), X.stem(F.col("url")).alias("stem"))


@query(f"select lang, c as glyph, count(*) as uses from (select lang, unnest(string_split(text, '')) as c from documents) where not regexp_matches(c, '^{S.WS}?$') group by lang, c")
def glyph_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = S.table(spark, sf_dir, "documents").select("lang", F.explode(F.split(X.delete_ws(F.col("text")), "")).alias("glyph"))
    return chars.filter("glyph <> ''").groupBy("lang", "glyph").agg(F.count("*").alias("uses"))


@query("select user_id, event_type, min(event_id) as first_event from events group by user_id, event_type")
def keep_first_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    return S.table(spark, sf_dir, "events").withColumn("k", F.row_number().over(w)).filter("k = 1").select("user_id", "event_type", F.col("event_id").alias("first_event"))


@query("""select doc_id, array_to_string(list_filter([case when doc_id % 2 = 1 then 'header' end, case when (doc_id // 2) % 2 = 1 then 'footer' end, case when (doc_id // 4) % 2 = 1 then 'page_number' end,
  case when (doc_id // 8) % 2 = 1 then 'aside_text' end, case when (doc_id // 16) % 2 = 1 then 'header_image' end, case when (doc_id // 32) % 2 = 1 then 'footer_image' end, case when (doc_id // 64) % 2 = 1 then 'footnote' end], lambda x: x is not null), ',') as labels from documents""")
def ignore_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents").select("doc_id", F.array_join(N.ignore_labels(_flags()), ",").alias("labels"))


def _flags() -> dict:
    return {name: F.shiftright("doc_id", i).bitwiseAND(F.lit(1)) == 0 for i, name in enumerate(N.IGNORABLE)}


@query("""select doc_id, case when doc_id % 2 = 1 then 'header' end as first_label, doc_id % 2 = 0 as merge, 0.5::double as temperature, doc_id % 3 as pixels, true as has_prompt, null::varchar as prompt from documents""")
def document_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to a document service as JSON, read back by path."""
    i = F.col("doc_id")
    json = N.document_payload(_flags(), {"mergeTables": i % 2 == 0, "temperature": F.lit(0.5), "minPixels": i % 3})
    v = F.try_parse_json(json)
    at = lambda path, kind: F.try_variant_get(v, path, kind)
    rows = S.table(spark, sf_dir, "documents").select("doc_id", json.alias("json"))
    v = F.try_parse_json("json")
    first = F.when(at("$.markdownIgnoreLabels[0]", "string") == "header", "header")
    return rows.select("doc_id", first.alias("first_label"), at("$.mergeTables", "boolean").alias("merge"), at("$.temperature", "double").alias("temperature"), at("$.minPixels", "long").alias("pixels"), F.contains("json", F.lit('"promptLabel":null')).alias("has_prompt"), at("$.promptLabel", "string").alias("prompt"))


@query("select event_id, (props->>'$.k')::bigint as k, props->>'$.missing' as missing from events")
def variant_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return rows.select("event_id", F.try_variant_get("v", "$.k", "long").alias("k"), F.try_variant_get("v", "$.missing", "string").alias("missing"))


@query("""with p as (select user_id, event_id, case when (props->>'$.k')::bigint % 3 = 0 then (props->>'$.k')::bigint end as k from events)
  select user_id, arg_min(k, event_id) filter (where k is not null) as setting from p group by user_id""")
def first_non_null_setting(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    rows = S.table(spark, sf_dir, "events").select("user_id", "event_id", F.when(k % 3 == 0, k).alias("k"))
    return rows.groupBy("user_id").agg(F.min_by("k", F.when(F.col("k").isNotNull(), F.col("event_id"))).alias("setting"))


@query("""select doc_id, case when doc_id % 3 = 0 then text || '!' else text end = text as applies, case when doc_id % 3 = 0 then 'stale' when doc_id % 3 = 1 then 'applied' else 'undone' end as state from documents""")
def review_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review applies only to the text that it was made for, and is undone only where its own text stands."""
    i = F.col("doc_id") % 3
    live = F.when(i == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    fits = live.eqNullSafe(F.col("text"))
    return S.table(spark, sf_dir, "documents").select("doc_id", fits.alias("applies"), F.when(~fits, "stale").when(i == 1, "applied").otherwise("undone").alias("state"))
