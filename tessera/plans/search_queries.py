"""Search-side queries: kNN, score, threshold, rank, hit rows, filters, distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.search import search
from tessera.plans.fixtures import FIXTURE_SPEC, INDEX_VIEW_SQL, index_view, query_vectors
from tessera.plans.registry import register
from tessera.session import materialize, parallelism

# DuckDB pieces shared by the kNN oracles: all embeddings are queries.
_DUCK_COS = (
    "greatest(1 - list_dot_product(q.qv, cast(iv.vec as double[])) / "
    "(sqrt(list_dot_product(q.qv, q.qv)) * sqrt(list_dot_product(cast(iv.vec as double[]), cast(iv.vec as double[])))), 0)"
)
_DUCK_Q = "q as (select vec_id as query_id, cast(embedding as double[]) as qv from embeddings)"


def _preview_sql(c: str) -> str:
    return (
        f"case when length({c}) > 200 then concat(replace(left({c}, 200), chr(10), ' '), '...') "
        f"else replace(left({c}, 200), chr(10), ' ') end"
    )


def _knn_sql(where: str, k: int, extra_cols: str = "", dist: str = _DUCK_COS) -> str:
    return f"""
with iv as ({INDEX_VIEW_SQL}), {_DUCK_Q},
p as (select q.query_id, iv.*, {dist} as distance from q cross join iv where {where}),
r as (select *, row_number() over (partition by query_id order by distance, key) as rank from p)
select query_id, rank, key, round(distance, 6) as distance{extra_cols} from r where rank <= {k}
"""


SEARCH_SQL = f"""
with iv as ({INDEX_VIEW_SQL}), {_DUCK_Q},
p as (select q.query_id, iv.key, iv.doc_id, iv.source, iv.tags, iv.content, {_DUCK_COS} as distance
      from q cross join iv where iv.lang = 'en'),
r as (select *, row_number() over (partition by query_id order by distance, key) as rank from p)
select query_id, rank, key, doc_id, round(distance, 6) as distance, round(1 - distance / 2, 4) as score,
       source, tags, {_preview_sql('content')} as preview
from r where rank <= 5 and 1 - distance / 2 >= 0.6
"""


@register("search", SEARCH_SQL)
def q_search(spark, sf_dir):
    """K2 (minimum slice): every embedding queries the English part of the index,
    top 5 by cosine, score >= 0.6, ranked, with a 200-character preview."""
    hits = search(
        index_view(spark, sf_dir),
        query_vectors(spark, sf_dir),
        FIXTURE_SPEC,
        k=5,
        threshold=0.6,
        flt={"lang": {"$eq": "en"}},
        payload=("doc_id", "source", "tags", "content"),
        parallelism=parallelism(spark),
    )
    return hits.select(
        "query_id",
        "rank",
        "key",
        "doc_id",
        F.round("distance", 6).alias("distance"),
        F.round("score", 4).alias("score"),
        "source",
        "tags",
        tx.preview("content").alias("preview"),
    )


def _knn_select(hits, *extra):
    return hits.select("query_id", "rank", "key", F.round("distance", 6).alias("distance"), *extra)


@register("knn_topk", _knn_sql("true", 10))
def q_knn_topk(spark, sf_dir):
    """Exact top-10 cosine neighbours of every embedding over the whole index."""
    from tessera.operators.knn import knn_topk

    return _knn_select(knn_topk(index_view(spark, sf_dir), query_vectors(spark, sf_dir), FIXTURE_SPEC, k=10, parallelism=parallelism(spark)))


_DUCK_EUC = "sqrt(list_sum(list_transform(list_zip(q.qv, cast(iv.vec as double[])), lambda x: (x[1] - x[2]) * (x[1] - x[2]))))"


@register("knn_join", _knn_sql("true", 5, dist=_DUCK_EUC))
def q_knn_join(spark, sf_dir):
    """J9/K1 on a euclidean index: top-5 by L2 distance, no score."""
    from tessera.operators.knn import knn_topk
    from tessera.schema import IndexSpec

    spec = IndexSpec(dim=FIXTURE_SPEC.dim, metric="euclidean")
    return _knn_select(knn_topk(index_view(spark, sf_dir), query_vectors(spark, sf_dir), spec, k=5))


def _filtered_knn(flt, where_sql):
    from tessera.operators.knn import knn_topk

    def fn(spark, sf_dir):
        return _knn_select(knn_topk(index_view(spark, sf_dir), query_vectors(spark, sf_dir), FIXTURE_SPEC, k=3, flt=flt))

    return fn, _knn_sql(where_sql, 3)


for _name, _flt, _where in [
    ("filter_eq", {"lang": {"$eq": "fr"}}, "iv.lang = 'fr'"),
    ("filter_ne", {"file_type": {"$ne": "md"}}, "iv.file_type is distinct from 'md'"),
    ("filter_gte", {"score_num": {"$gte": 3000}}, "iv.score_num >= 3000"),
    ("filter_in", {"source": {"$in": ["src1", "src2", "src3"]}}, "iv.source in ('src1', 'src2', 'src3')"),
    (
        "filter_and",
        {"$and": [{"lang": {"$in": ["en", "de"]}}, {"score_num": {"$gte": 500}}, {"tags": {"$ne": "en,src0"}}]},
        "iv.lang in ('en', 'de') and iv.score_num >= 500 and iv.tags is distinct from 'en,src0'",
    ),
    (
        "filter_more",
        {"$or": [{"score_num": {"$gt": 4000}}, {"score_num": {"$lte": 400}}], "source": {"$nin": ["src1", "src2"]}, "tags": {"$exists": True}, "chunk_index": {"$lt": 1}},
        "(iv.score_num > 4000 or iv.score_num <= 400) and iv.source not in ('src1', 'src2') and iv.tags is not null and iv.chunk_index < 1",
    ),
]:
    _fn, _sql = _filtered_knn(_flt, _where)
    register(_name, _sql)(_fn)


@register(
    "score_threshold",
    f"""
with iv as ({INDEX_VIEW_SQL}), {_DUCK_Q},
p as (select q.query_id, iv.key, {_DUCK_COS} as distance from q cross join iv),
r as (select *, row_number() over (partition by query_id order by distance, key) as rank from p)
select query_id, rank, key, round(1 - distance / 2, 4) as score from r where rank <= 5 and 1 - distance / 2 >= 0.7
""",
)
def q_score_threshold(spark, sf_dir):
    """score = 1 - distance/2, kept when >= 0.7, applied after top-5."""
    hits = search(index_view(spark, sf_dir), query_vectors(spark, sf_dir), FIXTURE_SPEC, k=5, threshold=0.7, payload=())
    return hits.select("query_id", "rank", "key", F.round("score", 4).alias("score"))


@register(
    "hits_with_meta",
    f"""
with iv as ({INDEX_VIEW_SQL}), {_DUCK_Q},
p as (select q.query_id, iv.*, {_DUCK_COS} as distance from q cross join iv where iv.file_type = 'txt'),
r as (select *, row_number() over (partition by query_id order by distance, key) as rank from p)
select query_id, rank, round(1 - distance / 2, 4) as score, doc_id, source, cast(chunk_index as varchar) as chunk_index,
       cast(total_chunks as varchar) as total_chunks, '' as heading_path, left(content, 300) as content_preview, tags, cast(null as varchar) as context_prefix
from r where rank <= 5 and 1 - distance / 2 >= 0.6
""",
)
def q_hits_with_meta(spark, sf_dir):
    """JSON hit fields for the survivors of top-5 over the txt part of the index."""
    from tessera.operators.search import hit_rows

    hits = search(index_view(spark, sf_dir), query_vectors(spark, sf_dir), FIXTURE_SPEC, k=5, threshold=0.6,
                  flt={"file_type": {"$eq": "txt"}})
    return hit_rows(hits)


@register(
    "report_lines",
    f"""
with iv as ({INDEX_VIEW_SQL}), {_DUCK_Q},
p as (select q.query_id, iv.*, {_DUCK_COS} as distance from q cross join iv where iv.lang = 'de'),
r as (select *, row_number() over (partition by query_id order by distance, key) as rank from p),
h as (select * from r where rank <= 3 and 1 - distance / 2 >= 0.6),
n as (select query_id, count(*) as n from h group by query_id)
select query_id, rank,
  concat_ws(chr(10), printf('**%d. [%.2f] %s**', rank, 1 - distance / 2, coalesce(nullif('', ''), doc_id, key)),
            printf('来源：%s (chunk %s/%s)', coalesce(source, 'unknown'), cast(chunk_index as varchar), cast(total_chunks as varchar)),
            concat('> ', {_preview_sql('content')}), '') as line
from h
union all
select query_id, 0, printf('📚 知识库搜索结果（Top %d for "%s"）：', least(3, n), cast(query_id as varchar)) || chr(10) from n
union all
select vec_id, 0, printf('🤖 知识库中未找到与 "%s" 相关的内容。', cast(vec_id as varchar)) from embeddings
where vec_id not in (select query_id from n)
""",
)
def q_report_lines(spark, sf_dir):
    """Markdown report per query over the German part of the index (top 3, score >= 0.6),
    with the header line, or the not-found line for queries without hits."""
    from tessera.operators.search import report_lines

    qv = query_vectors(spark, sf_dir)
    hits = search(index_view(spark, sf_dir), qv, FIXTURE_SPEC, k=3, threshold=0.6, flt={"lang": {"$eq": "de"}})
    hits = materialize(hits, "hits")  # three parts of the report read it
    return report_lines(hits, queries=qv, k=3)


_JSON_SQL = f"""
with iv as ({INDEX_VIEW_SQL}), {_DUCK_Q},
p as (select q.query_id, iv.*, {_DUCK_COS} as distance from q cross join iv where iv.lang = 'en'),
r as (select *, row_number() over (partition by query_id order by distance, key) as rank from p),
h as (select query_id, list({{'rank': rank, 'score': round(1 - distance / 2, 4), 'doc_id': doc_id, 'source': source,
             'chunk_index': cast(chunk_index as varchar), 'total_chunks': cast(total_chunks as varchar), 'heading_path': '',
             'content_preview': left(content, 300), 'tags': tags}} order by rank) as results
      from r where rank <= 5 and 1 - distance / 2 >= 0.6 group by query_id)
select vec_id as query_id, cast(to_json({{'success': true, 'action': 'search', 'query': cast(vec_id as varchar), 'top_k': 5,
       'threshold': cast(0.6 as double), 'results_count': len(coalesce(results, [])), 'results': coalesce(results, [])}}) as varchar) as json
from embeddings left join h on h.query_id = vec_id
"""


@register("search_json", _JSON_SQL)
def q_search_json(spark, sf_dir):
    """One JSON document per query: query, top_k, threshold, results_count and the ranked results."""
    from tessera.operators.search import hit_rows, search_json

    qv = query_vectors(spark, sf_dir)
    hits = search(index_view(spark, sf_dir), qv, FIXTURE_SPEC, k=5, threshold=0.6, flt={"lang": {"$eq": "en"}})
    return search_json(hit_rows(hits), qv, k=5, threshold=0.6)


_PAIR_SQL = """
select a.vec_id, round({d}, 6) as {name}
from (select vec_id, cast(embedding as double[]) as qv from embeddings) a
join (select vec_id, cast(embedding as double[]) as vec from embeddings) b on b.vec_id = a.vec_id + 1
"""


def _pair_q(metric):
    from tessera.functions.vector import distance
    from tessera.sources.tables import read_table

    def fn(spark, sf_dir):
        e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
        a, b = e.alias("a"), e.alias("b")
        j = a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1)
        return j.select(
            F.col("a.vec_id").alias("vec_id"),
            F.round(distance(F.col("a.embedding"), F.col("b.embedding"), metric), 6).alias(f"dist_{metric}"),
        )

    return fn


register(
    "dist_cosine",
    _PAIR_SQL.format(
        name="dist_cosine",
        d="greatest(1 - list_dot_product(a.qv, b.vec) / (sqrt(list_dot_product(a.qv, a.qv)) * sqrt(list_dot_product(b.vec, b.vec))), 0)",
    ),
)(_pair_q("cosine"))
register(
    "dist_euclidean",
    _PAIR_SQL.format(
        name="dist_euclidean", d="sqrt(list_sum(list_transform(list_zip(a.qv, b.vec), lambda x: (x[1] - x[2]) * (x[1] - x[2]))))"
    ),
)(_pair_q("euclidean"))


@register(
    "dim_check",
    "select vec_id, len(embedding) as dim from embeddings where embedding is null or len(embedding) <> 64",
)
def q_dim_check(spark, sf_dir):
    """vectors whose length differs from the index dimension (violations table)."""
    from tessera.operators.index import dim_violations
    from tessera.sources.tables import read_table

    e = read_table(spark, sf_dir, "embeddings")
    return dim_violations(e, FIXTURE_SPEC, vec_col="embedding").select("vec_id", F.col("dim"))


@register(
    "dim_check_mixed",
    """select vec_id, case when vec_id % 7 = 0 then 63 when vec_id % 7 = 1 then 0 else -1 end as dim
       from embeddings where vec_id % 7 in (0, 1, 2)""",
)
def q_dim_check_mixed(spark, sf_dir):
    """F14 where vectors are short, empty or missing: each is reported with its length (-1: missing)."""
    from tessera.operators.index import dim_violations
    from tessera.sources.tables import read_table

    n = F.col("vec_id") % 7
    e = read_table(spark, sf_dir, "embeddings")
    e = e.withColumn("embedding", F.when(n == 0, F.slice("embedding", 1, 63)).when(n == 1, F.slice("embedding", 1, 0)).when(n > 2, F.col("embedding")))
    return dim_violations(e, FIXTURE_SPEC, vec_col="embedding").select("vec_id", F.coalesce("dim", F.lit(-1)).alias("dim"))


def _ivf(spark, sf_dir):
    """An IVF index of the whole table, as many lists as the root of its rows, stored and read back."""
    from tessera.operators.ann import build_ivf, load_ivf, save_ivf
    from tessera.session import scratch_path

    path = scratch_path(spark, "ivf")
    save_ivf(build_ivf(index_view(spark, sf_dir), FIXTURE_SPEC), path)
    return load_ivf(spark, path)


@register("knn_ann", _knn_sql("true", 5))
def q_knn_ann(spark, sf_dir):
    """K3 with every list probed: the IVF search is then exact, and held against the exact answer."""
    from tessera.operators.ann import ivf_search

    ivf = _ivf(spark, sf_dir)
    return _knn_select(ivf_search(ivf, query_vectors(spark, sf_dir), k=5, nprobe=len(ivf.centroids)))


@register("ann_recall")
def q_ann_recall(spark, sf_dir):
    """K3 report: recall@5 of the IVF search with half of the lists probed, against exact K1, over all queries."""
    from tessera.operators.ann import ivf_search, recall_at_k
    from tessera.operators.knn import knn_topk

    qv = query_vectors(spark, sf_dir)
    ivf = _ivf(spark, sf_dir)
    found = ivf_search(ivf, qv, k=5, nprobe=-(-len(ivf.centroids) // 2))
    return recall_at_k(found, knn_topk(index_view(spark, sf_dir), qv, FIXTURE_SPEC, k=5))
