"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import capfilters, chat, decontam, language, lines, mixing, repeats, setjoin, sharding, warc
from .common import scratch, table

SHARDS = 24


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.groups(table(spark, sf_dir, "documents"), words=3, percent=90)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return warc.read(spark, files).select(
        warc.page_id("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.page_id("refers_to").alias("refers_to"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.deduplicate(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf_dir, "documents"), SHARDS)
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    model = language.train(docs.where(~F.coalesce(held_out, F.lit(False))))
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return language.predict(rows, model)


OP1_SQL = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
                      else list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) end as s
  from words),
elements as (select doc_id, len(s) as n, unnest(s) as g from sets),
pairs as (
  select a.doc_id as x, b.doc_id as y, any_value(a.n) as m, any_value(b.n) as n, count(*) as c
  from elements a join elements b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (
  select x, y from pairs where 100 * c >= 90 * (m + n - c) union all select y, x from pairs where 100 * c >= 90 * (m + n - c)),
reach as (select x, y from links union select r.x, l.y from reach r join links l on r.y = l.x),
low as (select x, least(x, min(y)) as c from reach group by x)
select doc_id, cast(len(s) as bigint) as n_shingles, coalesce(low.c, doc_id) as component_id from sets left join low on low.x = doc_id
"""

#: A row is a document, whatever its doc_id.
OP3_SQL = r"""
with numbered as (select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
lines as (
  select rid, doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select rid, doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i from numbered)),
often as (select key, max(doc_id) as last from lines where length(key) >= 40 group by key having count(distinct rid) >= 5),
judged as (select l.*, o.key is not null and l.doc_id is distinct from o.last as gone from lines l left join often o on l.key = o.key)
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from judged group by rid
"""

OP4_SQL = r"""
with sized as (
  select doc_id, source, cast(case when text is null or text = '' then 0 else
    len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) end as bigint) as size
  from documents),
per as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
weighed as (
  select *, cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as double) as weight,
         cast(source_size * 3 as double) as cap from per),
levels as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over earlier, 0)) / (sum(weight) over () - coalesce(sum(weight) over earlier, 0)) as level
  from weighed window earlier as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
water as (select *, max(level) over () as water from levels),
aims as (select source, source_size, least(cap, water * weight) as target from water),
ranked as (
  select s.doc_id, s.size, a.source_size, a.target, row_number() over (partition by s.source order by s.size, s.doc_id) - 1 as r,
         case when a.source_size > 0 then a.target / a.source_size else 0.0 end as e,
         cast(('0x' || substr(md5('20240:' || coalesce('s' || s.source, 'n')), 1, 5)) as integer) / 1048576.0::double as o
  from sized s join aims a on s.source is not distinct from a.source)
select doc_id, size, source_size, target,
       cast(least(floor((r + 1) * e + o) - floor(r * e + o), 3) as bigint) * size as taken
from ranked
"""


OP5_SQL = r"""
with words as (
  select doc_id, case when text is null then [] else list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') end as w
  from documents),
spots as (select doc_id, w, unnest(range(1, len(w) - 18)) as s from words where len(w) >= 20),
windows as (select doc_id, s, md5(array_to_string(w[s : s + 19], ' ')) as h from spots),
later as (
  select doc_id, s from (select doc_id, s, row_number() over (partition by h order by doc_id, s) as k from windows) where k > 1),
gone as (select distinct doc_id, unnest(range(s, s + 20)) as p from later),
lost as (select doc_id, list(p) as ps, count(*) as n from gone group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(l.n, 0) as bigint) as n_removed,
       sha256(array_to_string(case when l.n is null then d.w else list_filter(d.w, lambda x, i: not list_contains(l.ps, i)) end, ' ')) as kept_sha256
from words d left join lost l using (doc_id)
"""


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilters.near(table(spark, sf_dir, "embeddings"))


#: Fixed value: the conversation that the contract adds, whose texts are another template's marks.
TRICKY = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = "conv_id long, turn long, role string, text string"
    rows = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text")
    return chat.read_back(chat.trees(rows.union(spark.createDataFrame(TRICKY, kinds))), sha256)


OP2_SQL = r"""
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as d from pages),
k as (select d, max(page_id) as keep from p where n >= 1000 group by d)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
       case when k.keep is null or k.keep = page_id then 'response' else 'revisit' end as record_type,
       case when k.keep <> page_id then k.keep end as refers_to
from p left join k using (d)
"""

OP9_SQL = r"""
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.98),
reach as (select x, y from links union select r.x, l.y from reach r join links l on r.y = l.x),
low as (select x, least(x, min(y)) as c from reach group by x)
select e.vec_id, cast((select count(*) from links l where l.x = e.vec_id) as bigint) as n_links,
       coalesce(low.c, e.vec_id) as component_id, coalesce(low.c, e.vec_id) = e.vec_id as kept
from embeddings e left join low on low.x = e.vec_id
"""


_ESCAPED = r"replace(coalesce(text, ''), '\', '\\')"
for _mark in chat.CONTROL:
    _ESCAPED = f"replace({_ESCAPED}, '{_mark}', '{_mark[0]}\\{_mark[1:]}')"
OP10_SQL = rf"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, case when conv_id is null then row_number() over () end as alone from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]', null), (-7, 1, 'assistant', '</s>[INST] ok [/INST]', null))
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum({sum(map(len, (chat.BEGIN, chat.BETWEEN, chat.END))) + 1} + length(role) + length({_ESCAPED})) as bigint) as formatted_chars
from c group by conv_id, alone
"""


QUERIES = (
    op1_ngram_jaccard, op2_warc, op3_line_dedup, op4_mixing, op5_substring_dedup, op6_sharding, op7_decontamination, op8_language_id,
    op9_embedding_dedup, op10_chat_format,
)


def queries() -> dict:
    return {query.__name__: query for query in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard": OP1_SQL, "op2_warc": OP2_SQL, "op3_line_dedup": OP3_SQL, "op4_mixing": OP4_SQL, "op5_substring_dedup": OP5_SQL,
        "op9_embedding_dedup": OP9_SQL, "op10_chat_format": OP10_SQL,
    }
