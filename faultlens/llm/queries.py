"""The operators as registered queries, with DuckDB SQL of the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.llm import decontam, embed, html, langid, linededup, lm, minhash, mixing, substring, warc
from faultlens.llm.common import table

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOW = f"translate(coalesce(text, ''), '{UPPER}', '{SMALL}')"
SPLIT = r"[^\x20\x09-\x0D]+"


def op1_mixing(spark: SparkSession, d: str) -> DataFrame:
    got = mixing.mix(table(spark, d, "documents"))
    return got.select("doc_id", "size", "source_size", "target", "taken")


OP1 = rf"""
with s as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{SPLIT}'))::bigint as size from documents),
src as (select source, source_size, [1, 2, 3][(rk % 3 + 1)::int] as w from (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as rk from s group by source)),
lv as (select (total - coalesce(sum(3 * source_size) over (o rows between unbounded preceding and 1 preceding), 0))::double / (sum(w) over (o rows between current row and unbounded following))::double as level
       from src, (select sum(source_size) as total from src) window o as (order by source_size::double / w, source nulls last)),
tg as (select source, source_size, least((3 * source_size)::double, (select max(level) from lv) * w::double) as target from src),
nb as (select s.doc_id, s.source, s.size, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size::double else 0::double end as rate,
       ('0x' || substr(sha256('mix-1|' || coalesce('=' || s.source, '')), 1, 12))::bigint::double / 281474976710656::double as u,
       (row_number() over (partition by s.source order by s.size, s.doc_id))::double as n
       from s join tg t on s.source is not distinct from t.source),
tr as (select nb.*, k, (floor(rate) + floor(u + k::double / 32::double + (rate - floor(rate)) * n) - floor(u + k::double / 32::double + (rate - floor(rate)) * (n - 1)))::bigint * size as taken from nb, range(32) r(k)),
best as (select source, arg_min(k, (e, k)) as k from (select source, k, abs(sum(taken)::double - any_value(target)) as e from tr group by source, k) group by source)
select tr.doc_id, size, source_size, target, taken from tr join best b on tr.source is not distinct from b.source and tr.k = b.k
"""


def op2_warc(spark: SparkSession, d: str) -> DataFrame:
    return warc.round_trip(table(spark, d, "pages")).drop("payload")


OP2 = """
with p as (select page_id, url, coalesce(html, '') as h from pages),
f as (select h, min(page_id) as first from p group by h),
hex as (select page_id, octet_length(encode(p.h))::bigint as payload_bytes, upper(sha1(p.h)) as x, case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to, p.url from p join f on p.h = f.h),
bits as (select *, list_reduce(list_transform(string_split(x, ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', (strpos('0123456789ABCDEF', c) - 1) * 4 + 1, 4)), lambda a, b: a || b) as b from hex)
select page_id, url, record_type, refers_to, payload_bytes, list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (substr(b, i * 5 + 1, 1)::int * 16 + substr(b, i * 5 + 2, 1)::int * 8 + substr(b, i * 5 + 3, 1)::int * 4 + substr(b, i * 5 + 4, 1)::int * 2 + substr(b, i * 5 + 5, 1)::int + 1)::int, 1)), lambda a, b: a || b) as payload_digest
from bits
"""


def op3_lm_scoring(spark: SparkSession, d: str) -> DataFrame:
    return lm.score(table(spark, d, "documents")).withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


OP3 = rf"""
with d as (select doc_id, list_append(regexp_extract_all({LOW}, '{SPLIT}'), chr(10)) as w, coalesce(doc_id::varchar, '') as s from documents),
t as (select doc_id, i, w[i] as w, case when i = 1 then chr(10) || '^' else w[i - 1] end as v, held_out from (select doc_id, w, unnest(range(1, len(w) + 1)) as i, h.held_out from d join (select doc_id, xor(list_reduce(list_transform(string_split(coalesce(doc_id::varchar, ''), ''), lambda ch: ascii(ch)::bigint), lambda c, ch: list_reduce(list_prepend(xor(c, ch), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda b, i: case when b & 1 = 1 then xor(b >> 1, 3988292384) else b >> 1 end), 4294967295::bigint), 4294967295) % 10 = 0 as held_out from documents) h using (doc_id))),
c1 as (select w, count(*) as c from t where not held_out group by w),
nv as (select sum(c)::bigint as n, count(*) as v from c1),
cx as (select w, c from c1 union all select chr(10) || '^', c from c1 where w = chr(10)),
c2 as (select v, w, count(*) as c from t where not held_out group by v, w),
k as (select dec, least({lm.HIGHEST}::double, greatest({lm.LOWEST}::double, sum(case when x > 1 and (c - 1)::double * (n - 1)::double > (cw - 1)::double * (x - 1)::double then c else 0 end)::double / sum(c)::double)) as k
      from (select c2.c, cx.c as x, c1.c as cw, length(cx.c::varchar) - 1 as dec from c2 join cx on cx.w = c2.v join c1 on c1.w = c2.w), nv group by dec),
p as (select t.doc_id, t.i, t.held_out, c1.c is not null as known, (coalesce(c1.c, 0)::double + {lm.ADD}::double) / (n::double + {lm.ADD}::double * (nv.v + 1)::double) as p1, cx.c as x, c2.c as c2, k.k as k
      from t cross join nv left join c1 on c1.w = t.w left join cx on cx.w = t.v left join c2 on c2.v = t.v and c2.w = t.w left join k on k.dec = length(cx.c::varchar) - 1)
select doc_id, any_value(held_out) as held_out, count(*) as n_tokens, count(*) filter (known) as n_known, (select n from nv) as train_tokens, round(sum(log10(p1)), 6) as base_score,
  round(sum(case when x is null then log10(p1) when c2 is null then log10(1 - k) + log10(p1) else log10(k * c2::double / x::double + (1 - k) * p1) end), 6) as score
from p group by doc_id
"""


def op4_line_hashing(spark: SparkSession, d: str) -> DataFrame:
    return substring.dedup_windows(table(spark, d, "documents"))


def op5_tag_paths(spark: SparkSession, d: str) -> DataFrame:
    return html.main_text(table(spark, d, "pages"))


def op7_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    languages = langid.labels(docs)
    found = langid.identify(langid.page_rows(table(spark, d, "pages")), langid.fit(docs, languages), is_html=True, languages=languages)
    return found.withColumnRenamed("id", "page_id").withColumn("confidence", F.round("confidence", 6))


def op6_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    got = linededup.dedup_lines(table(spark, d, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.col("kept_text").alias("text"), "n_lines", F.size("removed").alias("n_removed"), "removed")


def op8_lsh_forest(spark: SparkSession, d: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, d, "documents"), percent=85)


OP8 = rf"""
with recursive w as (select doc_id, regexp_extract_all({LOW}, '{SPLIT}') as w from documents),
sh as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end) as x from w),
n as (select doc_id, count(*) as n from sh group by doc_id),
l as (select a.doc_id as p, b.doc_id as q from sh a join sh b on a.x = b.x and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id
      having 100 * count(*) >= 85 * ((select n from n where n.doc_id = a.doc_id) + (select n from n where n.doc_id = b.doc_id) - count(*))),
r as (select doc_id, doc_id as hop from w union select r.doc_id, l.q from r join l on l.p = r.hop)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id, w.doc_id = c.component_id as kept
from w left join n on n.doc_id = w.doc_id join (select doc_id, min(hop) as component_id from r group by doc_id) c on c.doc_id = w.doc_id
"""


def op9_sign_hashing(spark: SparkSession, d: str) -> DataFrame:
    return embed.near_vectors(table(spark, d, "embeddings"), cosine=0.9)


OP9 = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings),
g as (select * from v where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
l as (select a.vec_id as p, b.vec_id as q from g a join g b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.9),
r as (select vec_id, vec_id as hop from v union select r.vec_id, l.q from r join l on l.p = r.hop)
select v.vec_id, coalesce(n.n, 0)::bigint as n_links, c.component_id, v.vec_id = c.component_id as kept
from v left join (select p, count(*) as n from l group by p) n on n.p = v.vec_id join (select vec_id, min(hop) as component_id from r group by vec_id) c on c.vec_id = v.vec_id
"""


def op10_decontamination(spark: SparkSession, d: str) -> DataFrame:
    got = decontam.decontaminate(table(spark, d, "documents"), table(spark, d, "benchmark"), width=13)
    return got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP10 = rf"""
with w as (select doc_id, regexp_extract_all({LOW}, '{ALNUM}') as w from documents),
b as (select item_id, regexp_extract_all({LOW}, '{ALNUM}') as w from benchmark),
win as (select distinct item_id, k, array_to_string(x, ' ') as x from (select item_id, least(13, len(w)) as k, unnest(list_transform(range(1, greatest(2, len(w) - 11)), lambda i: w[i : i + least(13, len(w)) - 1])) as x from b where len(w) > 0)),
dw as (select doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') as x from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as p from w, (select distinct k from win))),
hit as (select doc_id, p, dw.k, item_id from dw join win on win.k = dw.k and win.x = dw.x),
nh as (select doc_id, count(distinct hop) as n from (select doc_id, unnest(range(p, p + k)) as hop from hit) group by doc_id),
ni as (select doc_id, count(*) as n, string_agg(item_id::varchar, ',' order by item_id::varchar) as items from (select distinct doc_id, item_id from hit) group by doc_id)
select w.doc_id, len(w)::bigint as n_words, coalesce(nh.n, 0)::bigint as n_hit, coalesce(ni.n, 0)::bigint as n_items, sha256(coalesce(ni.items, '')) as items_sha256, coalesce(nh.n, 0) > 0 and 20 * coalesce(nh.n, 0) >= len(w) as contaminated
from w left join nh on nh.doc_id = w.doc_id left join ni on ni.doc_id = w.doc_id
"""

FUNCTIONS = (op1_mixing, op2_warc, op3_lm_scoring, op4_line_hashing, op5_tag_paths, op6_line_dedup, op7_language_id, op8_lsh_forest, op9_sign_hashing, op10_decontamination)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in FUNCTIONS}
ORACLE_SQL: dict[str, str] = {"op1_mixing": OP1, "op2_warc": OP2, "op3_lm_scoring": OP3, "op8_lsh_forest": OP8, "op9_sign_hashing": OP9, "op10_decontamination": OP10}
