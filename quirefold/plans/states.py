"""Queries over job lifecycles, late answers, reading warnings, fonts, paths and catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.functions import labels as N
from quirefold.functions import text as X
from quirefold.operators import fonts as G
from quirefold.operators import reading as R
from quirefold.plans.jobs import V_JOB, _chunks, CHUNKS
from quirefold.plans.registry import query
from quirefold.sources import fixtures as S
from quirefold.sources import recognition as Q
from quirefold.streaming import events as E

V_LIFE = """v_life as (select user_id as job, event_id as id, epoch_us(ts) as us, case event_type when 'purchase' then 'done' when 'error' then 'error' when 'signup' then 'cancelled' when 'click' then case when event_id % 10 = 0 then 'cancel' else 'progress' end else 'progress' end as kind,
  (props->>'$.k')::bigint as done, event_id % 90 as total from events where event_id % 7 < 3 or event_type in ('click', 'view', 'page_view'))"""


@query(f"""with {V_LIFE}, f as (select job, arg_max(kind, (us, id)) filter (where kind in ('done', 'cancelled', 'error')) as e, bool_or(kind = 'cancel') as asked, arg_max(done, (us, id)) filter (where kind = 'progress') as reached, arg_max(total, (us, id)) filter (where kind = 'progress') as total from v_life group by job),
  s as (select *, coalesce(e, case when asked then 'cancelling' else 'running' end) as state from f) select job, case when state = 'done' and total > 0 then total else reached end as done, total, state from s""")
def job_lifecycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by their last end, those asked to stop, and those still running."""
    return E.lifecycles(life_events(spark, sf_dir))


def life_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = S.table(spark, sf_dir, "events").filter("event_id % 7 < 3 or event_type in ('click', 'view', 'page_view')")
    kind = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "cancelled").when((F.col("event_type") == "click") & (F.col("event_id") % 10 == 0), "cancel").otherwise("progress")
    return E.job_events(events).drop("kind").join(events.select(F.col("event_id").alias("id"), kind.alias("kind"), (F.col("event_id") % 90).alias("total")), "id")


@query(f"""with {V_JOB}, p as (select distinct job from v_job where job % 3 > 0), r as (select distinct job from v_job where job % 5 = 0),
  e as (select job, arg_max(kind, (us, id)) as kind from v_job, (select max(us) as now from v_job) where kind <> 'progress' and us >= now - 86400000000::bigint group by job)
  select p.job, case when r.job is not null then 'running' else coalesce(kind, 'lost') end as state from p left join r using (job) left join e using (job)""")
def reconciled_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a lost connection: which jobs still run, which have a kept result, which are lost."""
    events = E.job_events(S.table(spark, sf_dir, "events"))
    jobs = events.select("job").distinct()
    return E.reconciled(jobs.filter("job % 3 > 0"), jobs.filter("job % 5 = 0"), E.latest_terminal(events, keep_seconds=86_400))


@query("""with a as (select user_id as file, event_id as token, case when event_id % 4 > 0 then event_type end as result from events), m as (select file, max(token) as token from a group by file)
  select file, token, result from a join m using (file, token) where result is not null""")
def newest_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that came for a file's last request."""
    i = F.col("event_id")
    rows = S.table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), i.alias("token"), F.when(i % 4 > 0, F.col("event_type")).alias("result"))
    return E.newest_answers(rows, "file")


@query("""with t as (select doc_id, case when doc_id % 2 = 0 then 'page:' || doc_id else 'article:' || doc_id end as key from documents), p as (select 'page:' || doc_id as key from documents where doc_id % 6 = 0 union all select 'article:' || doc_id from documents where doc_id % 9 = 0)
  select t.doc_id, t.key from t where exists (select 1 from p where p.key = t.key)""")
def pending_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that have a review waiting."""
    docs, i = S.table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id")
    none = F.lit(None).cast("long")
    targets = docs.select("doc_id", N.target_key(i, F.when(i % 2 == 1, i)).alias("key"))
    pending = docs.filter("doc_id % 6 = 0").select(N.target_key(i, none).alias("key")).unionByName(docs.filter("doc_id % 9 = 0").select(N.target_key(i, i).alias("key")))
    return targets.join(pending, "key", "left_semi").select("doc_id", "key")


@query(f"""with {S.V_BLOCKS}, b as (select *, {S.sql_role('label')} as role from (select doc_id, source, pos, label, ord, case when pos % 11 = 0 then '' when pos % 13 = 0 then 'Images have been losslessly embedded. ' || pos else 'line ' || pos end as text from v_blocks)),
  i as (select *, starts_with(text, 'Images have been losslessly embedded.') as artefact from b where role not in ('Header', 'Footer', 'Aside', 'PageNumber'))
  select doc_id, bool_or(role = 'Image' and not artefact) as images, bool_or(role = 'Table' and text = '') as empty_tables, count(*) filter (where artefact) as artefacts, count(*) filter (where not artefact and (text <> '' or role in ('Image', 'Table'))) as items from i group by doc_id""")
def reading_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reading of each page leaves out or stands in for."""
    pos = F.col("pos")
    line = lambda head: F.concat(F.lit(head), pos.cast("string"))
    rows = S.blocks(spark, sf_dir).withColumn("text", F.when(pos % 11 == 0, "").when(pos % 13 == 0, line("Images have been losslessly embedded. ")).otherwise(line("line ")))
    return R.warnings(rows, ["doc_id"])


@query(f"with {CHUNKS} select doc, chunk, sum(page * 1000 + doc % 97)::bigint as bytes from v_chunks group by doc, chunk")
def chunk_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).groupBy("doc", "chunk").agg(F.sum(F.col("page") * 1000 + F.col("doc") % 97).alias("bytes"))


FONTS = """v_need as (select distinct lang, c as glyph from (select lang, unnest(string_split(text, '')) as c from documents) where c <> '' and not regexp_matches(c, '^{ws}$')),
  v_fonts as (select * from (select 'plain' as font, 1 as rank, glyph from v_need where length(glyph) = strlen(glyph) union all select 'wide', 2, glyph from v_need where strlen(glyph) > 1 or glyph in ('a', 'e', '.') union all select 'small', 3, glyph from v_need where glyph between 'a' and 'm') group by all),
  v_hits as (select lang, font, rank, count(*) as supported from v_need join v_fonts using (glyph) group by all),
  v_best as (select lang, arg_max(font, (supported, -rank)) as font, max(supported) as supported from v_hits group by lang)""".replace("{ws}", S.WS)


def _fonts(needed: DataFrame) -> DataFrame:
    glyphs = G.glyphs_of(G.merged(needed, []), [])
    some = lambda font, rank, on: glyphs.filter(on).select(F.lit(font).alias("font"), F.lit(rank).alias("rank"), "glyph")
    wide = F.octet_length("glyph") > 1
    rows = some("plain", 1, ~wide).unionByName(some("wide", 2, wide | F.col("glyph").isin("a", "e", "."))).unionByName(some("small", 3, F.col("glyph").between("a", "m")))
    return G.glyph_sets(rows, ["font", "rank"])


@query(f"with {FONTS} select lang, font, supported, (select count(*) from v_need n where n.lang = b.lang) - supported as missing from v_best b")
def font_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The font that has most of the glyphs of each language."""
    needed = G.required(S.table(spark, sf_dir, "documents"), ["lang"])
    return G.coverage(needed, _fonts(needed), ["lang"])


@query(f"with {FONTS} select n.lang, n.glyph from v_need n join v_best b using (lang) where not exists (select 1 from v_fonts f where f.font = b.font and f.glyph = n.glyph)")
def missing_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The glyphs of each language that the font chosen for it lacks."""
    needed = G.required(S.table(spark, sf_dir, "documents"), ["lang"])
    have = _fonts(needed)
    return G.missing(needed, G.coverage(needed, have, ["lang"]), have, ["lang"])


@query(f"with {S.V_BLOCKS} select doc_id, pos, row_number() over (partition by doc_id order by coalesce(ord, pos), pos) as place from v_blocks")
def editor_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks as an editor lists them: by order, else by place in the file."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.coalesce("ord", "pos"), "pos"))
    return S.blocks(spark, sf_dir).select("doc_id", "pos", place.alias("place"))


@query("""with a as (select user_id, event_id as i, ['--verbose', 'scan.PNG', '/data/a.pdf', 'notes.txt', '/w/scan.PNG', 'b/c.dng'][(event_id % 6 + 1)::int] as arg from events),
  p as (select user_id, i, case when starts_with(arg, '/') then arg else '/w/' || arg end as path from a where not starts_with(arg, '-'))
  select user_id, path, row_number() over (partition by user_id order by min(i)) as place from p where lower(regexp_extract(path, '\\.([^.]+)$', 1)) in ('png', 'jpg', 'jpeg', 'tif', 'tiff', 'bmp', 'dng', 'pdf') group by user_id, path""")
def opened_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths among a command's arguments: made absolute, with a known extension, each once in order."""
    args = F.get(F.array(*[F.lit(a) for a in ("--verbose", "scan.PNG", "/data/a.pdf", "notes.txt", "/w/scan.PNG", "b/c.dng")]), (F.col("event_id") % 6).cast("int"))
    rows = S.table(spark, sf_dir, "events").select("user_id", "event_id", args.alias("arg"))
    found = X.open_paths(rows, ["user_id"], "event_id", F.lit("/w"))
    return found.select("user_id", "path", "place")


@query("""select p_brand as provider, p_partkey as i, p_name as id, row_number() over (partition by p_brand order by p_name, p_partkey) as place from part where p_brand <> 'Brand#11'
  union all select 'Brand#11', null, m.id, m.k from (values ('doc-vl-2', 1), ('doc-vl', 2)) m(id, k)""")
def model_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models by provider in the order of their ids; one provider's list is fixed."""
    rows = S.table(spark, sf_dir, "part").select(F.col("p_brand").alias("provider"), F.col("p_partkey").alias("i"), F.col("p_name").alias("id"))
    return Q.model_list(rows, {"Brand#11": ["doc-vl-2", "doc-vl"]})
