"""Embedding queries and the end-to-end text search (documents -> vectors -> kNN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import embed as em
from tessera.operators.search import search_texts
from tessera.plans.registry import register
from tessera.schema import IndexSpec
from tessera.session import parallelism, spread
from tessera.sources.tables import read_table

DIM = 64
SPEC = IndexSpec(dim=DIM, metric="cosine")

# DuckDB form of hash_embed's sparse weights, for any (id, text) relation named src
_SPARSE_SQL = """
tok as (select id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) as t from src),
cnt as (select id, cast(('0x' || substr(md5(t), 1, 8))::bigint % {dim} as integer) as bucket, count(*) as cnt from tok group by all),
sp as (select id, bucket, cnt, cnt / sqrt(sum(cnt * cnt) over (partition by id)) as weight from cnt)
"""


def _sparse(src_sql: str, dim: int = DIM) -> str:
    return f"src as ({src_sql}), " + _SPARSE_SQL.format(dim=dim)


@register(
    "hash_embed",
    f"""
with {_sparse("select cast(doc_id as varchar) as id, text from documents")}
select id as doc_id, bucket, cnt, round(weight, 6) as weight from sp
""",
)
def q_hash_embed(spark, sf_dir):
    """H1: built-in hashing embedder, sparse (bucket, count, weight) view of every document."""
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    sp = em.hash_embed_sparse(d, "doc_id", "text", DIM, parallelism(spark))
    return sp.select("doc_id", "bucket", "cnt", F.round("weight", 6).alias("weight"))


@register(
    "embed_dedup",
    f"""
with {_sparse("select md5(left(text, 8000)) as id, left(text, 8000) as text from (select distinct text from documents)")},
v as (select id, count(*) as nnz, sum(cast(weight as float)::double * cast(weight as float)::double) as n2 from sp group by id)
select cast(d.doc_id as varchar) as doc_id, md5(left(d.text, 8000)) as text_md5, v.nnz, round(v.n2, 5) as norm2
from documents d left join v on v.id = md5(left(d.text, 8000))
""",
)
def q_embed_dedup(spark, sf_dir):
    """Equal texts embedded once (by md5 of the model input) and joined back to every document."""
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    out = em.embed_dedup(d, "text", em.hash_embedder(DIM))
    nnz = F.size(F.filter("vec", lambda x: x != 0))
    n2 = F.aggregate(F.transform("vec", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return out.select("doc_id", "text_md5", nnz.alias("nnz"), F.round(n2, 5).alias("norm2"))


@register(
    "embed_cache",
    """
with c as (select distinct md5(left(text, 8000)) as text_md5 from documents where lang = 'en')
select cast(d.doc_id as varchar) as doc_id, md5(left(d.text, 8000)) as text_md5, c.text_md5 is not null as cache_hit
from documents d left join c on c.text_md5 = md5(left(d.text, 8000))
""",
)
def q_embed_cache(spark, sf_dir):
    """Cache holds the English documents' vectors; every document looks up, misses are embedded."""
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang")
    emb = em.hash_embedder(DIM)
    seed = em.embed_dedup(d.where(F.col("lang") == "en"), "text", emb)
    cache = seed.select("text_md5", F.lit(em.HASH_EMBED_MODEL).alias("model"), F.lit(DIM).alias("dim"), "vec").dropDuplicates(["text_md5"])
    cache = cache.withColumn("cached", F.lit(True))
    rows, new = em.embed_with_cache(d.select("doc_id", "text"), "text", cache.drop("cached"), emb, em.HASH_EMBED_MODEL, DIM)
    hit = rows.join(cache.select("text_md5", "cached"), "text_md5", "left")
    return hit.select("doc_id", "text_md5", F.coalesce("cached", F.lit(False)).alias("cache_hit"))


def _doc_index(spark, sf_dir):
    """Every document as one vector, embedded on the row (narrow UDF; equal to ``hash_embed``)."""
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang", "source")
    d = spread(d, parallelism(spark))
    v = d.withColumn("vec", em.hash_embed_udf(DIM)("text")).where(F.col("vec").isNotNull())
    return v.select(F.concat("doc_id", F.lit(".chunk-0000")).alias("key"), "vec", "doc_id", "lang", "source")


SEARCH_TEXT_SQL = f"""
with {_sparse("select 'q' || cast(item_id as varchar) as id, text from benchmark union all select cast(doc_id as varchar) as id, text from documents")},
f as (select id, bucket, cast(weight as float)::double as w from sp),
nq as (select id, sqrt(sum(w * w)) as n from f group by id),
qs as (select cast(substr(f.id, 2) as bigint) as query_id, bucket, w from f where f.id like 'q%'),
ds as (select f.id as doc_id, bucket, w from f where f.id not like 'q%'),
dot as (select qs.query_id, ds.doc_id, sum(qs.w * ds.w) as dp from qs join ds using (bucket) group by all),
p as (select dot.query_id, dot.doc_id, concat(dot.doc_id, '.chunk-0000') as key,
             greatest(1 - dp / (a.n * b.n), 0) as distance
      from dot join nq a on a.id = 'q' || cast(dot.query_id as varchar) join nq b on b.id = dot.doc_id),
r as (select *, row_number() over (partition by query_id order by round(distance, 9), key) as rank from p)
select query_id, rank, key, doc_id, round(distance, 6) as distance, round(1 - distance / 2, 4) as score
from r where rank <= 5 and 1 - distance / 2 >= 0.6
"""


@register("search_text", SEARCH_TEXT_SQL)
def q_search_text(spark, sf_dir):
    """Benchmark texts embedded with the built-in embedder search the
    embedded documents: top 5, score >= 0.6."""
    texts = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    hits = search_texts(_doc_index(spark, sf_dir), texts, SPEC, k=5, threshold=0.6, payload=("doc_id",))
    return hits.select("query_id", "rank", "key", "doc_id", F.round("distance", 6).alias("distance"),
                       F.round("score", 4).alias("score"))
