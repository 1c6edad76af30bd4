"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import secret_scan
from .common import table
from .crf_toxicity import toxicity
from .html_layout import page_texts
from .kdtree_topk import top_products
from .minhash_neardup import components
from .nbsvm_quality import quality_scores
from .pivotal_mix import mixture
from .range_shards import shard_rows
from .secret_scan import secrets
from .superkmer_dedup import removed_words
from .tiling_decontam import leaks


def op1_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def op3_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))


def op4_range_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))


def op5_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(table(spark, sf_dir, "pages"))


def op6_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_words(table(spark, sf_dir, "documents"))


def op7_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.col("source"))


def op8_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_tiling_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_crf_toxicity": op1_crf_toxicity,
    "op2_secret_scan": op2_secret_scan,
    "op3_kdtree_topk": op3_kdtree_topk,
    "op4_range_shards": op4_range_shards,
    "op5_html_layout": op5_html_layout,
    "op6_superkmer_dedup": op6_superkmer_dedup,
    "op7_pivotal_mix": op7_pivotal_mix,
    "op8_nbsvm_quality": op8_nbsvm_quality,
    "op9_tiling_decontam": op9_tiling_decontam,
    "op10_minhash_neardup": op10_minhash_neardup,
}


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

TOP_PRODUCTS = """
with v as (
  select vec_id, row_number() over () as uid, [floor(64 * x::double)::bigint for x in embedding] as e from embeddings
  where vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (
  select q.vec_id as query_id, q.uid as quid, c.vec_id, c.uid, list_sum([a * c.e[i] for a, i in q.e])::bigint as score
  from v q join v c on q.uid <> c.uid and len(q.e) = len(c.e) where q.vec_id % 20 = 0)
select query_id, (row_number() over (partition by quid order by score desc, vec_id, uid))::int as rank, vec_id, score from s
qualify rank <= 20
"""

REPEATED_WINDOWS = f"""
with d as (select row_number() over () as rid, doc_id, {WORDS} as w from documents),
windows as (select rid, i, array_to_string(w[i:i + 34], ' ') as win from d, unnest(range(1, len(w) - 33)) as t(i)),
twice as (select rid, i from windows qualify count(*) over (partition by win) > 1),
placed as (select rid, i, w[i] as word from d, unnest(range(1, len(w) + 1)) as t(i)),
judged as (
  select p.rid, p.i, word, max(case when t.i is null then 0 else 1 end) over (partition by p.rid order by p.i rows between 34 preceding and current row) as gone
  from placed p left join twice t on t.rid = p.rid and t.i = p.i),
kept as (select rid, count(*) as n, sum(gone)::bigint as gone, string_agg(word, ' ' order by i) filter (gone = 0) as text from judged group by rid)
select doc_id, coalesce(n, 0) as n_words, coalesce(gone, 0)::bigint as n_removed, sha256(coalesce(text, '')) as kept_sha256 from d left join kept using (rid)
"""

NEAR_DUPLICATES = f"""
with recursive d as (
  select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
held as (
  select distinct rid, array_to_string(w[i:i + 4], ' ') as shingle from d, unnest(range(1, len(w) - 3)) as t(i)
  union all select rid, array_to_string(w, ' ') from d where len(w) between 1 and 4),
sizes as (select rid, count(*) as n from held group by rid),
shared as (select a.rid as a, b.rid as b, count(*) as n from held a join held b on a.shingle = b.shingle and a.rid <> b.rid group by all),
links as (select a, b from shared s join sizes x on x.rid = a join sizes y on y.rid = b where 100 * s.n >= 75 * (x.n + y.n - s.n)),
reach(a, b) as (select rid, rid from d union select r.a, l.b from reach r join links l on l.a = r.b),
least as (select a as rid, min(doc_id) as component_id from reach join d on rid = b group by a)
select doc_id, coalesce(n, 0) as n_shingles, component_id, coalesce(doc_id = component_id, false) as kept from d join least using (rid) left join sizes using (rid)
"""


def secret_sql() -> str:
    """The patterns' spans, and the randomness tests with their levels, step by step as the operator takes them."""
    patterns = dict(zip(secret_scan.KINDS[:3], (secret_scan.ASSIGN, r"AKIA[A-Z0-9]+", r"[0-9a-f]+"), strict=True)) | {"random": secret_scan.TOKEN}
    parts = []
    for i, (kind, pattern) in enumerate(patterns.items()):
        quoted = pattern.replace("'", "''")
        parts.append(
            f"select rid, {i} as kind, string_split_regex(text, '{quoted}') as gap, regexp_extract_all(text, '{quoted}') as hit from d where regexp_matches(text, '{quoted}')"
        )
    grouped = secret_scan.ASSIGN.replace("'", "''")
    codes = {k: v[0] for k, v in secret_scan.ENCODINGS.items()}
    lengths = secret_scan.LENGTHS
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
pieces as ({" union all ".join(parts)}),
found as (
  select rid, kind, hit[i] as s, (list_sum([length(g) for g in gap[1:i]]) + coalesce(list_sum([length(h) for h in hit[1:i - 1]]), 0))::bigint as begins
  from pieces, unnest(range(1, len(hit) + 1)) as t(i)),
base as (
  select rid, kind, begins, begins + length(s) as till from found
  where (kind = 0 and length(regexp_extract(s, '{grouped}', 2)) >= 6) or (kind = 1 and length(s) >= 20) or (kind = 2 and length(s) >= 24)),
token as (
  select rid, begins, till, length(s)::double as n, string_split(s, '') as c, len(regexp_extract_all(s, '[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+')) - 1.0 as changes,
    case when regexp_matches(s, '{codes["hex"]}') then 0 when regexp_matches(s, '{codes["base32"]}') then 1 else 2 end as e
  from (select rid, begins, begins + length(s) as till, rtrim(s, '=') as s from found where kind = 3)),
measured as (
  select *, [16.0, 32.0, 64.0][e + 1]::double as k, [10.0, 26.0, 26.0][e + 1]::double as own, [0.46875, 0.3046875, 0.634765625][e + 1]::double as r,
    list_sum([x * x for x in map_values(list_histogram(c))])::double as q, [ascii(x)::double for x in c] as a from token),
moments as (select *, k / n * q - n as chi, list_sum(a) / n as mean, list_sum([x * x for x in a]) as xx, coalesce(list_sum([a[i] * a[i + 1] for i in range(1, len(a))]), 0) as xy from measured),
tested as (
  select *, (chi - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n) as uniform, (k + k * (n - 1) / own - n - chi) / (k / n * 2 * sqrt(n * (n - 1) / 2 / own * (1 - 1 / own))) as even,
    (changes - (n - 1) * r) / sqrt((n - 1) * r * (1 - r)) as runs, (changes - (n - 1) * {secret_scan.CHANGES}) / sqrt((n - 1) * {secret_scan.CHANGES} * (1 - {secret_scan.CHANGES})) as mixed,
    case when xx / n - mean * mean > 1e-9 then (xy / (n - 1) - mean * mean) / (xx / n - mean * mean) * sqrt(n) else 99 end as serial,
    e * {len(lengths)} + {" + ".join(f"(n >= {x})::int" for x in lengths[1:])} as stratum from moments),
scored as (
  select rid, begins, till, stratum, case when uniform <= {secret_scan.REJECT} and abs(runs) <= {secret_scan.REJECT} and abs(serial) <= {secret_scan.REJECT}
    then floor((even + mixed) / sqrt(2) / {secret_scan.STEP})::int end as level from tested),
counts as (select stratum, level, sum(count(*)) over (partition by stratum order by level desc nulls last) as above, sum(count(*)) over (partition by stratum) as total from scored group by stratum, level),
levels as (
  select stratum, min(level) as least from counts
  where level > 0 and total * 0.5 * exp(-level * {secret_scan.STEP} * level * {secret_scan.STEP} / 2) <= {secret_scan.FALSE_SHARE} * above group by stratum),
spans as (select *, ['assign', 'access', 'hex', 'random'][kind + 1] || ':' || begins || ':' || till as span from (
  select rid, kind, begins, till from base union all select rid, 3, begins, till from scored join levels using (stratum) where level >= least))
select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
  sha256(coalesce(string_agg(span, ',' order by begins, kind) filter (kind < 3), '')) as base_sha256, coalesce(string_agg(span, ',' order by begins, kind), '') as spans
from d left join spans using (rid) group by rid, doc_id
"""


ORACLE: dict[str, str] = {
    "op2_secret_scan": secret_sql(),
    "op3_kdtree_topk": TOP_PRODUCTS,
    "op6_superkmer_dedup": REPEATED_WINDOWS,
    "op10_minhash_neardup": NEAR_DUPLICATES,
}
