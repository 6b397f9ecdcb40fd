"""Semantic search: kNN -> score -> threshold -> rank -> hit rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.vector import similarity_score
from tessera.operators.knn import knn_topk
from tessera.schema import DEFAULT_THRESHOLD, DEFAULT_TOP_K, IndexSpec

HIT_PAYLOAD = ("doc_id", "source", "chunk_index", "total_chunks", "heading_path", "content", "tags", "context_prefix")


def search(
    index: DataFrame,
    queries: DataFrame,
    spec: IndexSpec,
    k: int = DEFAULT_TOP_K,
    threshold: float | None = DEFAULT_THRESHOLD,
    flt=None,
    payload=HIT_PAYLOAD,
    **knn_kw,
) -> DataFrame:
    """Ranked hits per query.

    The threshold is applied after top-k (a query may return fewer than k
    rows). Scores are only defined for cosine indexes; on a euclidean index
    ``score`` is null and the threshold is not applied.
    """
    payload = [p for p in payload if p in index.columns]
    hits = knn_topk(index, queries, spec, k=k, flt=flt, payload=payload, **knn_kw)
    if spec.metric == "cosine":
        hits = hits.withColumn("score", similarity_score("distance"))
        if threshold is not None:
            hits = hits.where(F.col("score") >= F.lit(float(threshold)))
    else:
        hits = hits.withColumn("score", F.lit(None).cast("double"))
    return hits


def hit_rows(hits: DataFrame) -> DataFrame:
    """S12 field set of one JSON hit: rank, score (4 dp), metadata defaults, 300-char preview."""
    cols = set(hits.columns)

    def meta(name, default=""):
        return F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in cols else F.lit(default)

    return hits.select(
        "query_id",
        "rank",
        F.round("score", 4).alias("score"),
        meta("doc_id").alias("doc_id"),
        meta("source").alias("source"),
        meta("chunk_index").alias("chunk_index"),
        meta("total_chunks").alias("total_chunks"),
        meta("heading_path").alias("heading_path"),
        F.substring(meta("content"), 1, tx.JSON_PREVIEW_CHARS).alias("content_preview"),
        meta("tags").alias("tags"),
        F.nullif(meta("context_prefix"), F.lit("")).alias("context_prefix"),  # absent from the JSON when there is none
    )


# The markdown formats of search results.
MD_HEADER = "📚 知识库搜索结果（Top %d for \"%s\"）："
MD_NOT_FOUND = "🤖 知识库中未找到与 \"%s\" 相关的内容。"
MD_TITLE = "**%d. [%.2f] %s**"
MD_SOURCE = "来源：%s (chunk %s/%s)"
MD_CONTEXT = "上下文："
MD_QUOTE = "> "


def report_lines(hits: DataFrame, queries: DataFrame | None = None, k: int | None = None,
                 query_text: str | None = None) -> DataFrame:
    """The markdown report as rows ``query_id, rank, line``.

    ``rank`` 0 holds the header of a query (or the not-found line, for the
    queries of ``queries`` without any hit); rank r holds the block of hit r
    (title with score to 2 decimals, source with chunk i/n, optional context
    line, 200-character preview, blank line). ``query_text`` names a column of
    ``queries`` shown in the header; otherwise the query id is shown.
    """
    cols = set(hits.columns)

    def meta(name, default):
        return F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in cols else F.lit(default)

    title = tx.hit_title(meta("heading_path", ""), F.col("doc_id") if "doc_id" in cols else F.lit(None), F.col("key"))
    ctx = meta("context_prefix", "")
    blocks = hits.select(
        "query_id",
        "rank",
        F.concat_ws(
            "\n",
            F.format_string(MD_TITLE, F.col("rank"), F.col("score"), title),
            F.format_string(MD_SOURCE, meta("source", "unknown"), meta("chunk_index", "?"), meta("total_chunks", "?")),
            F.when(ctx != "", F.concat(F.lit(MD_CONTEXT), ctx)),
            F.concat(F.lit(MD_QUOTE), tx.preview(meta("content", ""))),
            F.lit(""),
        ).alias("line"),
    )
    if queries is None:
        return blocks
    qt = F.col(query_text) if query_text else F.col("query_id").cast("string")
    q = queries.select("query_id", qt.alias("_qt"))
    n = hits.groupBy("query_id").agg(F.count("*").alias("_n"))  # <= k rows per query
    kk = F.lit(k) if k is not None else F.col("_n")
    head = q.join(n, "query_id").select(
        "query_id", F.lit(0).alias("rank"),
        F.concat(F.format_string(MD_HEADER, F.least(kk, F.col("_n")), F.col("_qt")), F.lit("\n")).alias("line"))
    none = q.join(n, "query_id", "left_anti").select(
        "query_id", F.lit(0).alias("rank"), F.format_string(MD_NOT_FOUND, F.col("_qt")).alias("line"))
    return head.unionByName(none).unionByName(blocks)


def search_json(rows: DataFrame, queries: DataFrame, k: int, threshold: float, query_text: str | None = None) -> DataFrame:
    """One JSON text per query (``query_id, json``) with the hit fields of
    ``hit_rows`` ordered by rank. Grouping is per query and holds at most k
    rows (k <= 100), so no group is unbounded."""
    qt = F.col(query_text) if query_text else F.col("query_id").cast("string")
    res = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in rows.columns if c != "query_id"]))).alias("results"))
    j = queries.select("query_id", qt.alias("query")).join(res, "query_id", "left")
    results = F.coalesce(F.col("results"), F.array().cast(res.schema["results"].dataType))
    doc = F.struct(
        F.lit(True).alias("success"), F.lit("search").alias("action"), F.col("query"),
        F.lit(k).alias("top_k"), F.lit(float(threshold)).alias("threshold"),
        F.size(results).alias("results_count"), results.alias("results"),
    )
    return j.select("query_id", F.to_json(doc).alias("json"))


def hash_queries(texts: DataFrame, spec: IndexSpec, text_col: str = "text") -> DataFrame:
    """``query_id, qvec`` of texts by the built-in hashing embedder (null where there is no text)."""
    from tessera.operators import embed as em

    return texts.select("query_id", em.hash_embed_udf(spec.dim)(tx.embed_cut(F.col(text_col))).alias("qvec"))


def search_texts(index: DataFrame, texts: DataFrame, spec: IndexSpec, k: int = DEFAULT_TOP_K,
                 threshold: float | None = DEFAULT_THRESHOLD, flt=None, embedder=None, text_col: str = "text",
                 payload=HIT_PAYLOAD, **knn_kw) -> DataFrame:
    """A batch of query texts (``query_id, text``) -> embedded -> ``search``.

    ``embedder`` is the same hook as on the ingest path
    (``DataFrame(text_md5, text) -> DataFrame(text_md5, vec)``); by default
    the built-in hashing embedder runs on the row. The embedding sees the
    first 8000 characters, as in ingest.
    """
    cut = tx.embed_cut(F.col(text_col))
    if embedder is None:
        q = hash_queries(texts, spec, text_col)
    else:
        keyed = texts.select("query_id", F.md5(cut).alias("text_md5"), cut.alias("text"))
        vecs = embedder(keyed.select("text_md5", "text").dropDuplicates(["text_md5"]))
        q = keyed.join(vecs.select("text_md5", F.col("vec").alias("qvec")), "text_md5").select("query_id", "qvec")
    return search(index, q.where(F.col("qvec").isNotNull()), spec, k=k, threshold=threshold, flt=flt,
                  payload=payload, **knn_kw)
