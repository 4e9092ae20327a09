"""Registered queries of the subpackage: name -> builder, and DuckDB SQL where SQL can express one.

Each builder reads whole tables, applies its operator with production
parameters and derives the contract's columns from the operator's outputs.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: DuckDB: lower-cases A-Z only.
LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_OP1_SQL = rf"""
with recursive words as (
  select doc_id, regexp_extract_all({LOWER_SQL.format("text")}, '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, case when len(w) < 3 then array_to_string(w, ' ') else w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] end as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
links as (
  select a.doc_id as x, b.doc_id as y from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id
  join sizes p on p.doc_id = a.doc_id join sizes q on q.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, p.n, q.n having 100 * count(*) >= 90 * (p.n + q.n - count(*))),
reach(x, y) as (select x, y from links union select r.x, l.y from reach r join links l on l.x = r.y)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(min(r.y), d.doc_id)) as component_id
from documents d left join sizes s using (doc_id) left join reach r on r.x = d.doc_id
group by d.doc_id, s.n
"""


@query("op1_ngram_jaccard_join", _OP1_SQL)
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqlab.llm.jaccard import jaccard_components
    found = jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


def bpe_digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op4_byte_bpe")
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from seqlab.llm.bpe import encode
    return bpe_digests(encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                               public_tokenizers.PATTERN, keep=["doc_id"]))


_OP5_SQL = rf"""
with recursive items as (
  select item_id, regexp_extract_all({LOWER_SQL.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
windows as (
  select distinct item_id, least(len(w), 10) as m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as s
  from (select item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) as i from items where len(w) > 0)),
docs as (
  select row_number() over () as r, doc_id,
         coalesce(regexp_extract_all({LOWER_SQL.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::varchar[]) as w
  from documents),
sizes as (select distinct m from windows),
found as (
  select r, i, p.m, x.item_id from (
    select r, m, i, array_to_string(w[i:i + m - 1], ' ') as s
    from (select r, w, m, unnest(range(1, len(w) - m + 2)) as i from docs, sizes where len(w) >= m)) p
  join windows x on x.m = p.m and x.s = p.s),
hits as (select r, count(distinct k) as n_hit from (select r, unnest(range(i, i + m)) as k from found) group by r),
named as (select r, list(distinct item_id::varchar order by item_id::varchar) as ids from found group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(len(ids), 0)::bigint as n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hits using (r) left join named using (r)
"""


@query("op5_benchmark_decontamination", _OP5_SQL)
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqlab.llm.decontam import contaminated_words
    found = contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def learned(modulus: int, held_out: int):
    """Whether a document's label may be learned from: crc32 of its id decides."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) != held_out


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqlab.llm.langid import classify, train
    docs = table(spark, sf_dir, "documents")
    model = train(docs, learned(3, 1))
    return (classify(docs, model, keep=["doc_id"])
            .select("doc_id", (~learned(3, 1)).alias("held_out"), "lang_pred", "score", "rejected"))


@query("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqlab.llm.quality import score, train
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(learned(4, 2) & F.col("quality").isNotNull()).select(
        "doc_id", F.col("quality").alias("label"))
    model = train(docs, labels)
    return (score(docs, model, keep=["doc_id"])
            .select("doc_id", (~learned(4, 2)).alias("held_out"), "score",
                    F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")))


def _spans_sql(kind: int, pattern: str, ok: str, value: int = 0) -> str:
    """DuckDB: (r, start, kind, end) of the matches that satisfy ``ok`` over m (match) and v (value)."""
    p = pattern.replace("'", "''")
    return f"""
  select r, s as start, {kind} as kind, s + len(m) as "end" from (
    select r, m, v, sum(len(gap)) over (partition by r order by i) + coalesce(sum(len(m)) over (
      partition by r order by i rows between unbounded preceding and 1 preceding), 0) as s
    from (select r, unnest(gaps) as gap, unnest(ms) as m, unnest(vs) as v, unnest(range(len(gaps))) as i from (
      select r, regexp_split_to_array(t, '{p}') as gaps, regexp_extract_all(t, '{p}', 0) as ms,
             regexp_extract_all(t, '{p}', {value}) as vs from docs)))
  where m is not null and ({ok})"""


def _op10_sql(scope: int = 200) -> str:
    from seqlab.llm.secrets import ACCESS, ASSIGN, ENDPOINT, HEX, KINDS, SECRET_FORMS, USER, VALUE_RUN
    kinds = [(0, ASSIGN, "len(v) >= 6", 2), (1, ACCESS, "len(m) >= 20", 0), (2, HEX, "len(m) >= 24", 0), (3, USER, "true", 0),
             (4, VALUE_RUN, " and ".join(f"regexp_matches(m, '{f}')" for f in SECRET_FORMS), 0), (5, ENDPOINT, "true", 0)]
    names = ", ".join(f"'{k}'" for k in KINDS)
    spelled = f"""[{names}][kind + 1] || ':' || start || ':' || "end\""""
    return f"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
parts as materialized ({" union all ".join(_spans_sql(*k) for k in kinds)}),
roles as (select *, case when kind in (1, 3) then 'id' when kind in (0, 2, 4) then 'secret' else 'endpoint' end as role from parts),
linked as (
  select a.r, a.start, a.kind, a."end" from roles a join roles b on a.r = b.r and greatest(b.start - a."end", a.start - b."end") <= {scope}
    and a.role <> b.role and b.role <> 'endpoint' where a.kind >= 3
  group by a.r, a.start, a.kind, a."end", a.role having count(distinct b.role) >= if(a.role = 'endpoint', 2, 1)),
shown as (select * from parts where kind < 3 union all select * from linked),
rows_ as (
  select r, count(*) filter (kind = 0) as a, count(*) filter (kind = 1) as b, count(*) filter (kind = 2) as c,
         string_agg({spelled}, ',' order by start, kind) filter (kind < 3) as base,
         string_agg({spelled}, ',' order by start, kind) as spans
  from shown group by r)
select doc_id, coalesce(a, 0) as n_assign, coalesce(b, 0) as n_access, coalesce(c, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join rows_ using (r)
"""


@query("op10_secret_scan", _op10_sql())
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqlab.llm.secrets import find_secrets, spelled
    found = find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(spelled(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        spelled(F.col("spans")).alias("spans"))


def _op9_sql(containment: float = 0.8) -> str:
    from seqlab.llm.licenses import NOTICES, SHINGLE, _shingles, _words, window_plan
    grams = ", ".join(f"({i}, '{name}', '{' '.join(s)}', {len(_shingles(_words(notice)))}, {window_plan(notice)[0]}, {window_plan(notice)[1]})"
                      for i, (name, notice) in enumerate(NOTICES) for s in sorted(_shingles(_words(notice))))
    return f"""
with t(i, license, s, n, size, step) as (values {grams}),
docs as (select row_number() over () as r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') as w from documents),
d as (select r, p, array_to_string(w[p + 1:p + {SHINGLE}], ' ') as s
      from (select r, w, unnest(range(0, len(w) - {SHINGLE - 1})) as p from docs where len(w) >= {SHINGLE})),
m as (select r, p, i, license, n, size, step, s from d join t using (s)),
win as (select r, i, license, n, s, unnest(range((greatest(ceil((p - size + {SHINGLE}) / step), 0) * step)::bigint, p + 1, step)) as q from m),
ok as (select r, i, license, q from win group by r, i, license, n, q having count(distinct s) >= {containment} * n),
best as (select r, count(*) as n_windows, list(distinct license order by license) as found from ok group by r)
select doc_id, coalesce(len(found), 0)::int as n_licenses, coalesce(array_to_string(found, ','), '') as licenses,
       coalesce(n_windows, 0) as n_windows
from docs left join best using (r)
"""


@query("op9_license_scan", _op9_sql())
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqlab.llm.licenses import find_licenses
    found = find_licenses(table(spark, sf_dir, "documents"), keep=["doc_id"])
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    return found.select("doc_id", F.size(names).alias("n_licenses"), F.array_join(names, ",").alias("licenses"),
                        F.size("matches").cast("long").alias("n_windows"))


_OP3_SQL = r"""
with turns as (select distinct conv_id, turn, role, coalesce(text, '') as text, floor(turn / 64)::bigint as chunk
               from conversations where conv_id is not null),
people as (select distinct conv_id, role as perspective from turns where role is not null and role <> 'system'),
seen as (
  select conv_id, perspective, chunk, turn, role, text, coalesce(role = perspective, false) as said,
         '<|im_start|>' || case when role = perspective then 'assistant' when role = 'system' then 'system'
           else 'user name=' || replace(coalesce(role, 'unknown'), '<|', '< |') end || chr(10) as head,
         replace(text, '<|', '< |') || '<|im_end|>' as body
  from turns join people using (conv_id)),
placed as (
  select *, sum(length(head) + length(body) + 1) over w - length(body) - 1 as s from seen
  window w as (partition by conv_id, perspective, chunk order by turn nulls last, role, text rows unbounded preceding))
select conv_id, perspective, chunk, count(*) as n_turns,
       string_agg(head || body || chr(10), '' order by turn nulls last, role, text) as rendered,
       coalesce(string_agg(s || ':' || (s + length(body)), ',' order by s) filter (said), '') as mask
from placed group by conv_id, perspective, chunk
"""


@query("op3_chat_perspectives", _OP3_SQL)
def op3_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqlab.llm.chat import dialogues
    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return dialogues(table(spark, sf_dir, "conversations")).select(
        "conv_id", "perspective", "chunk", "n_turns", "rendered", mask.alias("mask"))


#: Shards of the registered sharding query.
SHARDS = [f"shard-{i:03d}" for i in range(128)]


@query("op2_sharding")
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqlab.llm.sharding import place
    return place(table(spark, sf_dir, "documents"), "doc_id", SHARDS, keep=["doc_id"])


_OP6_SQL = """
with recursive ok as (
  select vec_id, label, embedding::double[] as v from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as x, b.vec_id as y from ok a join ok b
  on a.label = b.label and len(a.v) = len(b.v) and a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.93),
reach(x, y) as (select x, y from links union select r.x, l.y from reach r join links l on l.x = r.y),
n as (select x, count(*) as n_links from links group by x),
c as (select x, min(y) as y from reach group by x)
select vec_id, coalesce(n_links, 0) as n_links, least(vec_id, coalesce(c.y, vec_id)) as component_id,
       vec_id = least(vec_id, coalesce(c.y, vec_id)) as kept
from embeddings left join n on n.x = vec_id left join c on c.x = vec_id
"""


@query("op6_embedding_near_dedup", _OP6_SQL)
def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqlab.llm.vecdedup import near_duplicates
    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


def _op11_sql(k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256) -> str:
    """Every distance anew in each round, unrolled."""
    parts = [f"""
with v as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as x from embeddings
  where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
vx as materialized (select r, unnest(x) as x, unnest(range({dims})) as i from v),
c0 as materialized (
  select j, unnest(x) as c, unnest(range({dims})) as i from (
    select row_number() over (order by sha256('{seed}:' || vec_id), x) - 1 as j, x from v where vec_id is not null) where j < {k})"""]
    for n in range(rounds + 1):
        parts.append(f"""
a{n} as materialized (
  select r, j, d from (
    select *, row_number() over (partition by r order by d, j) as place from (
      select r, j, sum((x - c) * (x - c))::bigint as d from vx join c{n} using (i) group by r, j)) where place = 1)""")
        if n < rounds:
            parts.append(f"""
c{n + 1} as materialized (
  select c.j, c.i, coalesce(m.c, c.c) as c from c{n} c left join (
    select j, i, (s - ((s % n) + n) % n) // n as c from (
      select j, i, sum(x)::bigint as s, count(*) as n from a{n} join vx using (r) group by j, i)) m using (j, i))""")
    return ",".join(parts) + f"""
select vec_id, j::int as cluster, d as distance, (sum(d) over (partition by j))::bigint as cluster_inertia,
       (sum(d) over ())::bigint as inertia, centroid_sha256
from a{rounds} join v using (r) join (
  select j, sha256(string_agg(c::varchar, ',' order by i)) as centroid_sha256 from c{rounds} group by j) using (j)
"""


@query("op11_centroid_clustering", _op11_sql())
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqlab.llm.centroids import clustered
    return clustered(table(spark, sf_dir, "embeddings"), k=40, rounds=5, seed=2, dims=64, scale=256)


def _op12_sql() -> str:
    from seqlab.llm.fingerprint import BUCKETS, HASH, LENGTH_MOST, LENGTH_STEP, MOST
    q = BUCKETS // 4
    return rf"""
with docs as materialized (
  select row_number() over (order by doc_id nulls last, md5(coalesce(text, ''))) as r, doc_id, coalesce(text, '') as t from documents),
n as (select count(*) as n from docs),
pairs as materialized (
  select a.r, a.doc_id, a.t, b.r as s, a.t[:len(a.t) - len(a.t) // 4] || b.t[:len(a.t) // 4] as e
  from docs a, n join docs b on b.r = a.r % n + 1),
texts as (select r, 0 as v, t from pairs union all select r, 1, e from pairs),
hexed as materialized (select r, v, '0000' || hex(encode(t)) || '0000' as h, octet_length(encode(t)) + 1 as m from texts),
bytes as (
  select r, v, i, 16 * (strpos('0123456789ABCDEF', p[1]) - 1) + strpos('0123456789ABCDEF', p[2]) - 1 as b
  from (select r, v, unnest(regexp_extract_all(h, '..')) as p, unnest(range(len(h) // 2)) as i from hexed)),
triplets as (
  select r, v, b * 65536 + lead(b) over w * 256 + lead(b, 2) over w as code from bytes window w as (partition by r, v order by i)),
counted as (select r, v, ((code * {HASH}) & 4294967295) >> 24 as k, count(*) as c from triplets where code is not null group by all),
counts as (
  select r, v, k, coalesce(c, 0) as c from (select r, v, unnest(range({BUCKETS})) as k from hexed) left join counted using (r, v, k)),
quarters as (
  select r, v, list(((c > a[{q}])::int + (c > a[{2 * q}])::int + (c > a[{3 * q}])::int) order by k) as x
  from counts join (select r, v, list(c order by c) as a from counts group by r, v) using (r, v) group by r, v),
found as materialized (
  select r, v, x, 8 * len(bin(m)) + (((m * 8) >> (len(bin(m)) - 1)) & 7) as step from quarters join hexed using (r, v)),
spelled as materialized (
  select *, lower(printf('%03X', step::int)) || array_to_string(list_transform(range({BUCKETS} // 2), lambda i: '0123456789abcdef'[4 * x[2 * i + 1] + x[2 * i + 2] + 1]), '') as f
  from found)
select p.doc_id, len(p.t)::bigint as n_chars, sha256(p.e) as edited_sha256, a.f as fingerprint, b.f as edited_fingerprint,
       1 - least({MOST}, list_sum(list_transform(list_zip(a.x, b.x), lambda z: abs(z[1] - z[2]))) + least({LENGTH_STEP} * abs(a.step - b.step), {LENGTH_MOST})) / {MOST}.0::double as near_edited,
       1 - least({MOST}, list_sum(list_transform(list_zip(a.x, c.x), lambda z: abs(z[1] - z[2]))) + least({LENGTH_STEP} * abs(a.step - c.step), {LENGTH_MOST})) / {MOST}.0::double as near_next
from pairs p join spelled a on a.r = p.r and a.v = 0 join spelled b on b.r = p.r and b.v = 1 join spelled c on c.r = p.s and c.v = 0
"""


@query("op12_document_fingerprints", _op12_sql())
def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqlab.llm.fingerprint import edited_fingerprints
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def _op13_sql(percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = 10_000) -> str:
    """crc32 byte by byte, whose table of 256 is an xor of the entries of the 8 bits; every distinct run once."""
    entry = [0] * 8
    for k in range(8):
        c = 1 << k
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 if c & 1 else c >> 1
        entry[k] = c
    mixed = "(c >> 8)"
    for k, e in enumerate(entry):
        mixed = f"xor({mixed}, ((xor(c, b) >> {k}) & 1) * {e})"
    bytes_ = "list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda p: (16 * (strpos('0123456789ABCDEF', p[1]) - 1) + strpos('0123456789ABCDEF', p[2]) - 1)::bigint)"
    return rf"""
with texts as materialized (
  select 'd' as kind, row_number() over () as r, doc_id, coalesce(regexp_extract_all({LOWER_SQL.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::varchar[]) as w from documents
  union all select 'b', row_number() over (), null, coalesce(regexp_extract_all({LOWER_SQL.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::varchar[]) from benchmark),
runs as (select kind, r, array_to_string(w[i:i + n - 1], ' ') as f
         from (select kind, r, w, n, unnest(range(1, len(w) - n + 2)) as i from texts, (select unnest([1, 2, 3]) as n) where len(w) >= n)),
counted as materialized (select kind, r, f, count(*) as n from runs group by all),
hashed as materialized (
  select f, xor(list_reduce(list_prepend(4294967295::bigint, {bytes_}), lambda c, b: {mixed}), 4294967295) % {buckets} as k
  from (select distinct f from counted)),
per as materialized (select kind, r, k, sum(n)::bigint as n from counted join hashed using (f) group by all),
totals as (select k, coalesce(sum(n) filter (kind = 'd'), 0)::double as s, coalesce(sum(n) filter (kind = 'b'), 0)::double as t
           from (select unnest(range({buckets})) as k) left join per using (k) group by k),
whole as (select sum(s) + {buckets} as s, sum(t) + {buckets} as t from totals),
gain as (select k, floor(1000 * ln((totals.t + 1) * whole.s / ((totals.s + 1) * whole.t)))::bigint as g from totals, whole),
weights as (select r, sum(n * g)::bigint as weight from per join gain using (k) where kind = 'd' group by r),
scored as (
  select r, doc_id, len(w) as n, (len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0))::bigint as n_features, coalesce(weight, 0) as weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{seed}:' || doc_id)[1:8])::bigint::double + 0.5::double) / 4294967296::double)))::bigint as score
  from texts left join weights using (r) where kind = 'd'),
placed as (select r, row_number() over (order by score desc, doc_id) as place, count(*) over () as n
           from scored where n >= {least_words} and score is not null)
select doc_id, n_features, weight, score, (case when place <= {percent} * placed.n // 100 then place end)::double as rank
from scored left join placed using (r)
"""


@query("op13_importance_resampling", _op13_sql())
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqlab.llm.resample import resample
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, least_words=20, seed=42).select(
        "doc_id", "n_features", "weight", "score", "rank")
