"""One query for each corpus operator, over its whole tables, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import decontamination, fingerprints, jaccard, licenses, manifest, mixing, pii, quality, sharding, suffixes, toxicity, warc, whitening
from quirefold.llm.common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", mixing.words_in(F.col("text")).alias("size"))
    out = mixing.allocate(sized).select("doc_id", "size", "source_size", "target", "taken")
    return out


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.train_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.by_document(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest.audit(table(spark, sf_dir, "documents"), tampered, F.col("n_chars") + 1)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_quality, op3_suffixes, op4_pii, op5_warc, op6_mixing, op7_toxicity, op8_jaccard, op9_licenses, op10_fingerprints, op11_sharding, op12_whitening, op13_manifest)}


UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WORDS = f"regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP1 = f"""
with d as (select doc_id, {WORDS} as w from documents),
  i as (select item_id::varchar as item, {WORDS} as w from benchmark),
  s as (select item, w, least(len(w), 10) as n from i where len(w) > 0),
  items as (select distinct item, n, array_to_string(w[k : k + n - 1], ' ') as g from s, lateral (select unnest(range(1, len(w) - n + 2)) as k)),
  sizes as (select distinct n from items),
  grams as (select doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') as g from d, sizes, lateral (select unnest(range(1, len(w) - n + 2)) as k)),
  found as (select doc_id, n, k, item from grams join items using (n, g)),
  hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + n)) as p from found) group by doc_id),
  named as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as ids from found group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join named using (doc_id)"""

# Bytes are pairs of hexadecimal digits here.
OP3 = """
with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as x from documents),
  s as (select r, doc_id, x, (length(x) // 2)::bigint as n from d),
  w as (select r, i, md5(substr(x, 2 * i + 1, 800)) as h from s, lateral (select unnest(range(0, greatest(n - 399, 0))) as i)),
  c as (select h from w group by h having count(*) > 1),
  m as (select r, i from w where h in (select h from c)),
  g as (select r, i, case when i <= lag(i) over o + 400 then 0 else 1 end as new from m window o as (partition by r order by i)),
  k as (select r, i, sum(new) over (partition by r order by i rows unbounded preceding) as k from g),
  spans as (select r, k, min(i) as a, max(i) + 400 as b from k group by r, k),
  t as (select r, sum(b - a)::bigint as gone, count(*) as spans from spans group by r),
  edges as (select r, a, b, coalesce(lag(b) over (partition by r order by a), 0) as before from spans),
  kept as (select e.r, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' order by a) || any_value(substr(x, 2 * z + 1)) as x from edges e join s on s.r = e.r join (select r, max(b) as z from spans group by r) q on q.r = e.r group by e.r)
select doc_id, n as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept.x, s.x))) as kept_sha256 from s left join t on t.r = s.r left join kept on kept.r = s.r"""

OP5 = """
with p as (select page_id, coalesce(html, '') as h from pages),
  f as (select h, min(page_id) as first_id from p where strlen(h) >= 100 group by h)
select page_id, strlen(p.h)::bigint as payload_bytes, sha256(p.h) as payload_digest, case when first_id < page_id then 'revisit' else 'response' end as record_type, case when first_id < page_id then first_id end as refers_to
from p left join f on p.h = f.h"""

# The queue's order is that of the md5 of ids, which both engines have.
OP6 = """
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size, md5(coalesce(doc_id::varchar, 'null ' || len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')))) as k from documents),
  s as (select source, sum(size)::bigint as source_size, ((row_number() over (order by source nulls last) - 1) % 3 + 1) as w from d group by source),
  t as (select sum(source_size)::bigint as total, sum(w)::bigint as weights from s),
  o as (select *, 3.0::double * source_size / w as r, coalesce(sum(3 * source_size) over q, 0)::bigint as used, coalesce(sum(w) over q, 0)::bigint as gone from s, t
    window q as (order by 3.0::double * source_size / w, source nulls last rows between unbounded preceding and 1 preceding)),
  c as (select *, r < (total - used)::double / (weights - gone) as filled from o),
  l as (select (max(total) - coalesce(sum(3 * source_size) filter (where filled), 0))::double as rest, (max(weights) - coalesce(sum(w) filter (where filled), 0))::double as active from c),
  g as (select source, source_size, least(rest * w::double / active, (3 * source_size)::double) as target from c, l),
  q as (select doc_id, source, size, (sum(size) over (partition by source order by k, doc_id, size rows unbounded preceding) - size)::bigint as start from d)
select doc_id, size, source_size, target, (greatest(0, least(size, floor(target)::bigint - start)) + greatest(0, least(size, floor(target)::bigint - source_size - start)) + greatest(0, least(size, floor(target)::bigint - 2 * source_size - start)))::bigint as taken
from q join g on q.source is not distinct from g.source"""

OP8 = f"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}), '[^\\x20\\x09-\\x0D]+') as w from documents),
  s as (select distinct doc_id, array_to_string(w[k : k + 4], ' ') as g from d, lateral (select unnest(range(1, greatest(len(w) - 4, 1) + 1)) as k) where len(w) > 0),
  n as (select doc_id, count(*) as n from s group by doc_id),
  p as (select a.doc_id as a, b.doc_id as b, count(*) as same from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
  links as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * same >= 80 * (x.n + y.n - same)),
  reach as (select doc_id as node, doc_id as other from d union select node, b from reach join links on other = a),
  c as (select node, min(other) as component_id from reach group by node)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id from d left join n using (doc_id) join c on node = doc_id"""


# The table of CRC-32 from its polynomial, and the checksum of the bytes of a hexadecimal string.
CRC = """bits(v, k, c) as (select v, 0, v::bigint from range(256) t(v) union all select v, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bits where k < 8),
  crcs as (select list(c order by v) as crc from bits where k = 8)"""
CRC_OF = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all({x}, '..'), lambda p: ('0x' || p)::bigint)), lambda a, b: xor(a >> 8, crc[(xor(a & 255, b))::int + 1])), 4294967295)"
DRAW = "-ln((('0x' || left(md5(k || '/' || {path}), 12))::bigint::double + 0.5) / 281474976710656) / {weight}"

OP11 = f"""
with recursive {CRC},
  d as (select row_number() over () as r, doc_id, coalesce(doc_id::varchar, 'null') as k, hex(encode(coalesce(text, ''))) as x from documents),
  leaves as (select n, 'region' || case when s < 40 then s // 10 else s - 36 end as region, 'rack' || case when s < 40 then s // 5 % 2 else 0 end as rack, s from (select unnest([40, 41]) as n), lateral (select unnest(range(n)) as s)),
  racks as (select n, region, rack, count(*) as w from leaves group by all),
  regions as (select n, region, sum(w) as w from racks group by all),
  a as (select r, k, n, arg_min(region, {DRAW.format(path="region", weight="w")}) as region from d, regions group by r, k, n),
  b as (select r, k, n, region, arg_min(rack, {DRAW.format(path="region || '/' || rack", weight="w")}) as rack from a join racks using (n, region) group by r, k, n, region),
  c as (select r, n, arg_min(s, {DRAW.format(path="region || '/' || rack || '/' || s", weight="1")})::int as s from b join leaves using (n, region, rack) group by r, k, n),
  e as (select r, doc_id, k, length(x)::bigint // 2 + 16 as size, {CRC_OF.format(x="x")} as text_crc32 from d, crcs)
select doc_id, size, text_crc32, 'key' as law, o.s as shard, row_number() over (partition by o.s order by md5(concat_ws('|', k, text_crc32, size))) - 1 as slot, g.s as grown_shard
from e join c o on o.r = e.r and o.n = 40 join c g on g.r = e.r and g.n = 41"""

_FIELD = "coalesce(strlen({0}::varchar) || ':' || {0}::varchar, '-')"
_LEAF = lambda n_chars: "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"
OP13 = f"""
with recursive {CRC},
  d as (select doc_id, lang, {_LEAF("n_chars")} as leaf, case when {CRC_OF.format(x="hex(encode(doc_id::varchar))")} % 7 = 0 and n_chars is not null then {_LEAF("(n_chars + 1)")} else {_LEAF("n_chars")} end as claim from documents, crcs),
  rows as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n, dense_rank() over (order by lang nulls first) - 1 as g from d),
  up as (select g, n, 0 as l, i, leaf as h from rows union all select g, any_value(n), l + 1, i // 2, sha256(string_agg(h, '' order by i)) from up where (n - 1) >> l > 0 group by g, l, i // 2),
  roots as (select g, h as subroot, count(*) over () as m from up where (n - 1) >> l = 0),
  over_(m, l, i, h) as (select m, 0, g, subroot from roots union all select any_value(m), l + 1, i // 2, sha256(string_agg(h, '' order by i)) from over_ where (m - 1) >> l > 0 group by l, i // 2),
  steps as (
    select r.g, r.i, a.l, 0 as part, case when s.h is null then 2 else (r.i >> a.l) & 1 end as side, s.h from rows r join (select distinct g, n, l from up) a on a.g = r.g and (a.n - 1) >> a.l > 0 left join up s on s.g = r.g and s.l = a.l and s.i = xor(r.i >> a.l, 1)
    union all
    select r.g, r.i, a.l, 1, case when s.h is null then 2 else (r.g >> a.l) & 1 end, s.h from rows r join (select distinct m, l from over_) a on (a.m - 1) >> a.l > 0 left join over_ s on s.l = a.l and s.i = xor(r.g >> a.l, 1)),
  proofs as (select g, i, list({{'side': side, 'h': coalesce(h, '')}} order by part, l) as proof, string_agg(h, '' order by part, l) as siblings from steps group by g, i),
  fold(g, i, k, acc, proof) as (select r.g, r.i, 1, r.claim, coalesce(proof, []) from rows r left join proofs p on p.g = r.g and p.i = r.i
    union all select g, i, k + 1, sha256(case proof[k].side when 0 then acc || proof[k].h when 1 then proof[k].h || acc else acc end), proof from fold where k <= len(proof)),
  root as (select h as root from over_ where (m - 1) >> l = 0)
select doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) as proof_sha256, acc as folded_root, acc = root as verified
from rows join roots using (g) cross join root left join proofs using (g, i) join fold on fold.g = rows.g and fold.i = rows.i and k = len(fold.proof) + 1"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1, "op3_suffixes": OP3, "op5_warc": OP5, "op6_mixing": OP6, "op8_jaccard": OP8, "op11_sharding": OP11, "op13_manifest": OP13}
