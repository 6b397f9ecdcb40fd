"""End-to-end ingest queries and file sources."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.plans.ingest import build_index_rows
from tessera.plans.registry import register
from tessera.plans.text_queries import html_text_sql
from tessera.schema import IndexSpec
from tessera.session import parallelism, scratch_path, spread
from tessera.sources import files as fs
from tessera.sources.tables import read_table

SPEC = IndexSpec(dim=64)
FIXED_TIME = dt.datetime(2024, 1, 1, 0, 0, 0)


@register("ingest_pages")
def q_ingest_pages(spark, sf_dir):
    """Raw pages -> visible text -> chunks (auto) -> hashing embedder -> index rows with metadata."""
    p = spread(read_table(spark, sf_dir, "pages"), parallelism(spark))
    corpus = p.select(
        F.col("page_id").cast("string").alias("doc_id"), tx.html_text("html").alias("text"), F.lit("html").alias("file_type"),
        F.col("url").alias("source"), F.lit("web").alias("tags"),
    )
    rows = build_index_rows(corpus, SPEC, ingested_at=FIXED_TIME, contextual=True)
    return rows.select("key", "doc_id", "chunk_index", "total_chunks", "content_hash", "heading_path", "context_prefix",
                       F.octet_length("content").alias("content_bytes"), F.size("vec").alias("dim"))


_PAGES_SQL = f"""
with t as (select cast(page_id as varchar) as doc_id, {html_text_sql('html')} as text from pages)
select doc_id, md5(text) as content_hash, concat(doc_id, '.chunk-0000') as key,
       nullif(left(regexp_extract(text, '(?s)^\\s*(.+?[.!?。])(\\s|$)', 1), 200), '') as context_prefix, true as whole
from t where regexp_matches(text, '\\S')
"""


@register("ingest_pages_docs", _PAGES_SQL)
def q_ingest_pages_docs(spark, sf_dir):
    """E1/H2 per page: text hash, first key, prefix (all chunks have the same here) and whether chunks 0 .. n-1 are all there."""
    rows = q_ingest_pages(spark, sf_dir)
    n = F.count("*")
    whole = (n == F.max("total_chunks")) & (F.countDistinct("chunk_index") == n) & (F.max("chunk_index") == n - 1) & (F.max("dim") == SPEC.dim)
    same = F.coalesce(F.min("context_prefix") == F.max("context_prefix"), F.lit(True))
    return rows.groupBy("doc_id", "content_hash").agg(F.min("key").alias("key"), F.max("context_prefix").alias("context_prefix"), (whole & same).alias("whole"))


def _shaky_model(document: str, chunk: str) -> str:
    """A stand-in for a model that fails on documents of odd length."""
    if len(document) % 2:
        raise TimeoutError("no answer")
    return document[:12]


@register(
    "ingest_context",
    """select cast(doc_id as varchar) as doc_id, nullif(case when length(text) % 2 = 1 then '' else left(text, 12) end, '') as context_prefix, true as whole
       from documents where regexp_matches(text, '\\S')""",
)
def q_ingest_context(spark, sf_dir):
    """H2 with a model that fails on some documents: their chunks are indexed without a prefix, the others with it."""
    from tessera.plans.ingest import per_chunk

    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.lit("txt").alias("file_type"))
    rows = build_index_rows(d, SPEC, ingested_at=FIXED_TIME, contextual=True, context_fn=per_chunk(_shaky_model))
    n = F.count("*")
    whole = (n == F.max("total_chunks")) & (F.max("chunk_index") == n - 1) & F.coalesce(F.min("context_prefix") == F.max("context_prefix"), F.lit(True)) & (
        F.count("context_prefix").isin(0, n))
    return rows.groupBy("doc_id").agg(F.max("context_prefix").alias("context_prefix"), whole.alias("whole"))


_ODD_SQL = """
odd as (select cast(doc_id as varchar) as doc_id, case when doc_id % 13 = 0 then '!!! ... ???' when doc_id % 17 = 0 then concat(repeat(chr(1), 400), text)
               else text end as text, concat('a/', cast(doc_id as varchar)) as path, case when doc_id % 17 = 0 then repeat(chr(2), 300) else source end as source from documents
        union all
        select cast(doc_id as varchar), concat('later ', text), concat('b/', cast(doc_id as varchar)), source from documents where doc_id % 10 = 0),
last as (select doc_id, arg_max(text, path) as text from odd group by doc_id)
"""


def _odd_corpus(spark, sf_dir):
    """Documents with ids that come twice, texts without any token, and control characters."""
    d = read_table(spark, sf_dir, "documents")
    did = F.col("doc_id").cast("string")
    text = F.when(F.col("doc_id") % 13 == 0, "!!! ... ???").when(F.col("doc_id") % 17 == 0, F.concat(F.repeat(F.lit("\x01"), 400), "text")).otherwise(F.col("text"))
    source = F.when(F.col("doc_id") % 17 == 0, F.repeat(F.lit("\x02"), 300)).otherwise(F.col("source"))
    first = d.select(did.alias("doc_id"), text.alias("text"), F.concat(F.lit("a/"), did).alias("path"), F.lit("txt").alias("file_type"), source.alias("source"))
    again = d.where(F.col("doc_id") % 10 == 0).select(did.alias("doc_id"), F.concat(F.lit("later "), "text").alias("text"), F.concat(F.lit("b/"), did).alias("path"),
                                                      F.lit("txt").alias("file_type"), "source")
    return first.unionByName(again)


@register(
    "ingest_odd",
    f"""with {_ODD_SQL}
select 'stored' as part, doc_id, md5(text) as value, cast(1 as bigint) as n from last where regexp_matches(text, '\\S')
union all select 'again', 'unchanged', '', count(*) from last where regexp_matches(text, '\\S')""",
)
def q_ingest_odd(spark, sf_dir):
    """E1 on odd rows: of rows with one id the last path is stored, texts without tokens and control characters
    are indexed, metadata stays within its bytes, and an identical second sync changes nothing."""
    from tessera.operators import index as ix
    from tessera.operators.metadata import fit_metadata
    from tessera.plans.ingest import ingest

    base = scratch_path(spark, "odd")
    corpus = _odd_corpus(spark, sf_dir).where(~tx.is_blank("text"))
    ingest(spark, corpus, base, SPEC, sync=True, ingested_at=FIXED_TIME)
    version = ix.current_version(spark, base)
    again = ingest(spark, corpus, base, SPEC, sync=True, ingested_at=FIXED_TIME)
    stored = ix.read_index(spark, base)
    fits = fit_metadata(stored.withColumn("content_full", F.col("content"))).groupBy("doc_id").agg(F.max("meta_json_bytes").alias("most"))
    kept = F.lit(ix.current_version(spark, base) == version)
    heads = ix.doc_header_rows(stored).join(fits, "doc_id").where(kept & (F.col("most") <= 2048))
    heads = heads.groupBy("doc_id").agg(F.max("content_hash").alias("value"), F.count("*").alias("n"))
    return heads.select(F.lit("stored").alias("part"), "doc_id", "value", "n").unionByName(
        again.select(F.lit("again").alias("part"), F.col("status").alias("doc_id"), F.lit("").alias("value"), F.col("docs").alias("n")))


@register(
    "scan_corpus",
    """select page_id, 'txt' as file_type, md5(html || chr(10)) as content_hash from pages
       where regexp_matches(html, '\\S')""",
)
def q_scan_corpus(spark, sf_dir):
    """Pages written as one file each, read back by the recursive multi-glob corpus reader."""
    d = scratch_path(spark, "corpus")
    name = F.format_string("page_id=%s.txt", F.coalesce(F.col("page_id").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")))
    fs.write_files(read_table(spark, sf_dir, "pages").select(name.alias("name"), F.col("html").alias("text")), d)
    c = fs.scan_corpus(spark, d, globs="*.md,*.txt,*.html")
    return c.select(F.regexp_extract("path", r"page_id=(\d+)", 1).cast("long").alias("page_id"), "file_type",
                    tx.content_hash("text").alias("content_hash"))


@register(
    "corpus_file_types",
    f"""
with p as (select page_id, case page_id % 4 when 0 then 'md' when 1 then 'txt' when 2 then 'html' else 'HTM' end as ext, html, {html_text_sql('html')} as visible from pages)
select concat('kb-page-', cast(page_id as varchar)) as doc_id, case when lower(ext) = 'htm' then 'html' else ext end as file_type,
       md5(case when ext in ('html', 'HTM') then visible else html end) as content_hash
from p where regexp_matches(html, '\\S')""",
)
def q_corpus_file_types(spark, sf_dir):
    """S1/S2 behind the file reader: pages as Markdown, text and HTML files; HTML is reduced to its text."""
    ext = F.element_at(F.array(*map(F.lit, ("md", "txt", "html", "HTM"))), (F.col("page_id") % 4 + 1).cast("int"))
    p = read_table(spark, sf_dir, "pages")
    raw = p.select(F.concat(F.lit("/data/kb/page-"), F.col("page_id").cast("string"), F.lit("."), ext).alias("path"), F.col("html").alias("raw"))
    c = fs.corpus_from_files(spread(raw, parallelism(spark)), base_dir="/data")
    return c.select("doc_id", "file_type", tx.content_hash("text").alias("content_hash"))


@register(
    "vector_records",
    """select 'vec-' || cast(vec_id as varchar) as key, len(embedding) as dim, cast(vec_id as varchar) as doc_id,
              cast(label as varchar) as label, round(list_sum(cast(embedding as double[])), 4) as vec_sum
       from embeddings""",
)
def q_vector_records(spark, sf_dir):
    """Every embedding serialised as a JSON vector record and parsed back by the record reader."""
    e = read_table(spark, sf_dir, "embeddings")
    rec = F.struct(
        F.concat(F.lit("vec-"), F.col("vec_id").cast("string")).alias("key"),
        F.struct(F.col("embedding").alias("float32")).alias("data"),
        F.create_map(F.lit("label"), F.col("label").cast("string"), F.lit("doc_id"), F.col("vec_id").cast("string")).alias("metadata"),
    )
    js = e.select(F.to_json(F.array(rec)).alias("value"))
    v = fs.parse_vector_records(js)
    vsum = F.aggregate(F.transform("vec", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return v.select("key", F.size("vec").alias("dim"), "doc_id", F.col("extra")["label"].alias("label"),
                    F.round(vsum, 4).alias("vec_sum"))


@register(
    "query_vectors_json",
    """select vec_id, q.query_id, len(embedding) as dim from embeddings, (values (0), (1)) q(query_id)""",
)
def q_query_vectors_json(spark, sf_dir):
    """Query vectors given as JSON text (a batch of two per row: the vector and its negation)."""
    e = read_table(spark, sf_dir, "embeddings")
    neg = F.transform("embedding", lambda x: -x)
    txt = e.select("vec_id", F.to_json(F.array("embedding", neg)).alias("value"))
    q = fs.parse_query_vectors(txt, keep=("vec_id",))
    return q.select("vec_id", "query_id", F.size("qvec").alias("dim"))


@register("search_pages")
def q_search_pages(spark, sf_dir):
    """E1+E2 end to end: pages -> text -> chunks -> embeddings -> index; benchmark
    texts embedded the same way search it (top 5, score >= 0.6)."""
    from tessera.operators import embed as em
    from tessera.operators.search import search

    p = spread(read_table(spark, sf_dir, "pages"), parallelism(spark))
    corpus = p.select(F.col("page_id").cast("string").alias("doc_id"), tx.html_text("html").alias("text"),
                      F.lit("html").alias("file_type"), F.col("url").alias("source"))
    index = build_index_rows(corpus, SPEC, ingested_at=FIXED_TIME)
    b = read_table(spark, sf_dir, "benchmark")
    q = b.select(F.col("item_id").alias("query_id"), em.hash_embed_udf(SPEC.dim)(tx.embed_cut(F.col("text"))).alias("qvec"))
    hits = search(index, q.where(F.col("qvec").isNotNull()), SPEC, k=5, threshold=0.6)
    return hits.select("query_id", "rank", "key", "doc_id", F.round("score", 4).alias("score"),
                       tx.preview("content").alias("preview"))
