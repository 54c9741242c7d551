"""The registered queries of this subpackage: thin calls with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import runtime
from . import embedding_dedup, ngram_join, packing, pii_bootstrap, quality_qda, quality_rules, recompression, secret_scan, sp_gumbel, token_counts


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return runtime.ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_read(spark, sf_dir, "documents"), n=4, percent=85)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"), threshold=0.98)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.report(_read(spark, sf_dir, "documents"), group_col="lang")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_qda.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.remove_repeats(_read(spark, sf_dir, "documents"), width=35, digest=True)


def op6_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_gumbel.sample(_read(spark, sf_dir, "documents"), ["doc_id"], k=2, seed=1)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_bootstrap.extract(_read(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), length=2048, end_id=1)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_embedding_near_dedup, op3_token_counts, op4_quality_classifier, op5_substring_dedup,
        op6_sentencepiece_sampling, op7_pii, op8_packing, op9_quality_rules, op10_secret_scan,
    )
}

_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^ \t-\r]+')".format

ORACLE: dict[str, str] = {
    "op1_ngram_jaccard_join": f"""
with recursive w as (
  select doc_id, {_WORDS("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as ws from documents),
s as (select doc_id, case when len(ws) >= 4 then list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')))
                          when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end as sh from w),
n as (select doc_id, len(sh) as n from s),
t as (select doc_id, unnest(sh) as tok from s),
c as (select a.doc_id as a, b.doc_id as b, count(*) as both from t a join t b on a.tok = b.tok and a.doc_id < b.doc_id group by 1, 2),
l as (select c.a, c.b from c join n x on x.doc_id = c.a join n y on y.doc_id = c.b where 100 * c.both >= 85 * (x.n + y.n - c.both)),
e as (select a, b from l union select b, a from l),
r(doc_id, other) as (select doc_id, doc_id from documents union select r.doc_id, e.b from r join e on e.a = r.other)
select n.doc_id, cast(n.n as bigint) as n_shingles, min(r.other) as component_id from n join r on r.doc_id = n.doc_id group by 1, 2
""",
    "op5_substring_dedup": f"""
with d as (select doc_id, {_WORDS("text")} as ws from documents),
p as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as j, ws from d),
h as (select doc_id, j, word, case when j + 34 <= len(ws) then md5(array_to_string(ws[j:j + 34], ' ')) end as win from p),
g as (select win from h where win is not null group by win having count(*) > 1),
f as (select h.doc_id, h.j, h.word, g.win is not null as rep from h left join g on h.win = g.win),
k as (select doc_id, j, word, max(case when rep then 1 else 0 end) over (partition by doc_id order by j rows between 34 preceding and current row) as gone from f),
a as (select doc_id, sum(gone) as n_removed, string_agg(word, ' ' order by j) filter (where gone = 0) as kept from k group by doc_id)
select d.doc_id, cast(len(d.ws) as bigint) as n_words, cast(coalesce(a.n_removed, 0) as bigint) as n_removed, sha256(coalesce(a.kept, '')) as kept_sha256
from d left join a on a.doc_id = d.doc_id
""",
    "op2_embedding_near_dedup": """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id < b.vec_id and len(a.e) = len(b.e)
      where list_cosine_similarity(a.e, b.e) >= 0.98),
e as (select a, b from l union all select b, a from l),
r(id, other) as (select vec_id, vec_id from embeddings union select r.id, e.b from r join e on e.a = r.other),
c as (select id, min(other) as component_id from r group by id),
n as (select a as id, count(*) as n from e group by a)
select c.id as vec_id, cast(coalesce(n.n, 0) as bigint) as n_links, c.component_id, c.id = c.component_id as kept
from c left join n on n.id = c.id
""",
}
