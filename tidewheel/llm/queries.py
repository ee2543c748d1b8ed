"""One query for each operator of this package, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.llm import embed_dedup, line_dedup, mixing, packing, quality, simhash, suffix_dedup, topk, toxicity, url_filter
from tidewheel.llm.common import table


def _tokenizer() -> dict:
    import public_tokenizers

    return {"tokenizer": public_tokenizers.path("byte_bpe_50k.json"), "ranks": (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)}


def op1_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), longest=1024, end=0, **_tokenizer())


def op2_toxicity(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"), "toxic", threshold=0.5)


def op3_exact_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20, scale=64.0)


def op4_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), radius=4, shingle=4)


def op5_quality_classifier(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", threshold=0.3)


def op6_line_dedup(spark, sf_dir):
    out = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op9_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "block", "release", "deadline", "slot")


def op7_embedding_near_dedup(spark, sf_dir):
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), threshold=0.98)


def op10_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The rules (host, path, verdict) of the query.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op8_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.rules_frame(spark, URL_RULES), default="allow").select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as e from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 20
"""

OP6_SQL = r"""
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents where text is not null
), toks as (
  select doc_id, pos, list_filter(regexp_split_to_array(regexp_replace(raw, '[0-9]+', '#', 'g'), '\s+'), lambda x: x <> '') as t from lines
), keyed as (
  select doc_id, pos, t, len(t) as n, t[1:3] as head from toks where len(t) >= 4
), variants as (
  select n, head, t, count(*) as c, min((doc_id, pos)) as met from keyed group by all
), leaves as (
  select n, head, arg_min(t, (-c, met)) as leader from variants group by n, head having count(*) > 1 and sum(c) >= 3
), judged as (
  select v.n, v.head, v.t, v.c, l.leader, l.leader is not null and len(list_filter(list_zip(v.t, l.leader), lambda p: p[1] = p[2])) >= 0.8 * v.n as led
  from variants v left join leaves l on v.n = l.n and v.head = l.head
), words as (
  select n, head, t, c, unnest(t) as word, generate_subscripts(t, 1) as p from judged where leader is not null and not led
), seldom as (
  select n, head, p, word from words where p > 3 group by all having sum(c) < 3
), fields as (
  select w.t, list(w.p) as fields from words w join seldom s on w.n = s.n and w.head = s.head and w.p = s.p and w.word = s.word group by w.t
), template as (
  select j.t, case when j.led then j.leader when f.t is not null and j.n - len(f.fields) >= 0.8 * j.n
                   then list_transform(j.t, lambda x, i: case when list_contains(f.fields, i) then '' else x end) else j.t end as template
  from judged j left join fields f on j.t = f.t
), placed as (
  select k.doc_id, k.pos, m.template from keyed k join template m on k.t = m.t
), spread as (
  select template, count(distinct doc_id) as docs, min(doc_id) as first from placed group by template having count(distinct doc_id) >= 3
), gone as (
  select distinct p.doc_id, p.pos from placed p join spread s on p.template = s.template where p.doc_id <> s.first
), kept as (
  select l.doc_id, string_agg(l.raw, chr(10) order by l.pos) as text from lines l anti join gone g on l.doc_id = g.doc_id and l.pos = g.pos group by l.doc_id
), counted as (
  select l.doc_id, count(*) as n_lines, count(g.pos) as n_dropped from lines l left join gone g on l.doc_id = g.doc_id and l.pos = g.pos group by l.doc_id
)
select d.doc_id, coalesce(c.n_lines, 0) as n_lines, coalesce(c.n_dropped, 0) as n_dropped,
       case when d.text is null then null else md5(coalesce(k.text, '')) end as kept_md5
from documents d left join counted c on d.doc_id = c.doc_id left join kept k on d.doc_id = k.doc_id
"""

OP8_SQL = r"""
with a as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), b as (
  select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from a
), c as (
  select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from b
), d as (
  select page_id, host, path, '.' || host as h from c
), e as (
  select page_id, host, path, case
    when h like '%.www.example.com' and path like '/en/%' then 'www.example.com/en/'
    when h like '%.example.com' and path like '/en/%' then 'example.com/en/'
    when h like '%.net' and path like '/es/%' then 'net/es/'
    when h like '%.net' and path like '/fr/%' then 'net/fr/'
    when h like '%.com' and path like '/%' then 'com/' end as rule from d
)
select page_id, host, path, rule, case when rule in ('example.com/en/', 'net/es/', 'net/fr/') then 'block' else 'allow' end as verdict from e
"""

OP9_SQL = """
with recursive sized as (
  select doc_id, source, md5(cast(doc_id as varchar)) as h, coalesce(strlen(text), 0) + 1 as size from documents
), totals as (
  select source, cast(coalesce(sum(strlen(text)), 0) as double) as bytes from documents group by source
), weights as (
  select source, cast(greatest(1, round(pow(bytes + 1, 0.5) / sum(pow(bytes + 1, 0.5)) over () * 200)) as bigint) as share from totals
), ranked as (
  select source, share, sum(share) over () as period, row_number() over (order by share desc, source nulls first) as i from weights
), lists as (
  select list(share order by i) as shares, cast(max(period) as bigint) as period from ranked
), run as (
  select cast(-1 as bigint) as t, list_transform(shares, lambda x: cast(0 as bigint)) as done, cast(null as bigint) as who, shares, period from lists
  union all
  select t + 1, list_transform(done, lambda d, j: case when j = w then d + 1 else d end), w, shares, period
  from (select *, list_min(list_filter(list_transform(shares, lambda s, j: case when (done[j] * period) // s <= t + 1 and done[j] < s
          then (((done[j] + 1) * period + s - 1) // s) * 100000 + j end), lambda x: x is not null)) % 100000 as w
        from run where t + 1 < period)
), plan as (
  select r.source, r.share, r.period, row_number() over (partition by r.i order by t) - 1 as nth, t from run join ranked r on run.who = r.i
), placed as (
  select doc_id, source, cast((sum(size) over (partition by source order by h, doc_id rows between unbounded preceding and current row) - size) // 65536 as bigint) as block from sized
)
select d.doc_id, d.source, d.block,
       cast((d.block // p.share) * p.period + (p.nth * p.period) // p.share as bigint) as release,
       cast((d.block // p.share) * p.period + ((p.nth + 1) * p.period + p.share - 1) // p.share as bigint) as deadline,
       cast((d.block // p.share) * p.period + p.t as bigint) as slot
from placed d join plan p on d.source is not distinct from p.source and d.block % p.share = p.nth
"""

QUERIES = {
    "op1_packing": op1_packing,
    "op2_toxicity": op2_toxicity,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_line_dedup": op6_line_dedup,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_url_filters": op8_url_filters,
    "op9_mixing": op9_mixing,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
}

SQL = {
    "op3_exact_top_k": OP3_SQL,
    "op6_line_dedup": OP6_SQL,
    "op8_url_filters": OP8_SQL,
    "op9_mixing": OP9_SQL,
}
