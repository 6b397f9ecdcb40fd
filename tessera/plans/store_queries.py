"""Queries over stored indexes: delete files, compaction, listings, sketches, caches, codes, catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import embed as em
from tessera.operators import index as ix
from tessera.operators import listing as ls
from tessera.operators import pq
from tessera.operators import stats as st
from tessera.operators import sync as sy
from tessera.operators import tags as tg
from tessera.operators.ann import recall_at_k
from tessera.operators.knn import knn_topk
from tessera.plans.embed_queries import DIM, SPEC, _doc_index, _sparse
from tessera.plans.fixtures import INCOMING_SQL, STORED_SQL, line_index, line_index_sql
from tessera.plans.index_queries import _PLAN_SQL, _sync_inputs
from tessera.plans.registry import register
from tessera.session import materialize, parallelism, scratch_path
from tessera.sources.tables import read_table

LI = line_index_sql()


# --------------------------------------------------------------------------
# J6 on a stored index: delete files, then compaction
# --------------------------------------------------------------------------
_SYNCED_SQL = f"""
{_PLAN_SQL},
old as (select key, doc_id, content_hash from {line_index_sql(STORED_SQL)}),
new as (select key, doc_id, content_hash from {line_index_sql(INCOMING_SQL)}
        where doc_id in (select doc_id from plan where status in ('new', 'changed'))),
synced as (select * from old where doc_id not in (select doc_id from plan where status in ('changed', 'removed'))
           union all select * from new)
"""


def _synced_store(spark, sf_dir, *left_out: str, before=lambda base: None) -> str:
    """The stored version of the corpus as an index (without some columns), and the incoming version synced into it."""
    base = scratch_path(spark, "store")
    inc, stored = _sync_inputs(spark, sf_dir)
    ix.write_index(stored.drop(*left_out), base)
    before(base)
    plan = materialize(sy.sync_plan(inc, ix.read_index(spark, base)), "plan")
    rows = line_index(spark, sf_dir, docs=sy.to_ingest(inc, plan)).drop(*left_out)
    gone = plan.where(F.col("status").isin("changed", "removed")).select("doc_id")
    ix.apply_doc_changes(spark, base, rows, gone)
    return base


@register("sync_stored", f"with {_SYNCED_SQL} select * from synced")
def q_sync_stored(spark, sf_dir):
    """J6 stored: a sync by added rows and delete files; nothing that stays is written again."""
    return ix.read_index(spark, _synced_store(spark, sf_dir)).select("key", "doc_id", "content_hash")


@register("sync_compacted", f"with {_SYNCED_SQL} select s.state, synced.* from synced, (values ('synced'), ('compacted')) s(state)")
def q_sync_compacted(spark, sf_dir):
    """J6 stored, an index without its texts: read by its delete files, and after compaction."""
    base = _synced_store(spark, sf_dir, "content")
    synced = ix.read_index(spark, base)
    ix.compact_index(spark, base)
    both = [d.select(F.lit(n).alias("state"), "key", "doc_id", "content_hash") for n, d in (("synced", synced), ("compacted", ix.read_index(spark, base)))]
    return both[0].unionByName(both[1])


# --------------------------------------------------------------------------
# Totals from stored sketches
# --------------------------------------------------------------------------
@register(
    "kb_totals_sketched",
    f"""with {_SYNCED_SQL}
select count(*) as total_chunks, true as docs_within, true as sources_within, true as tags_within from synced""",
)
def q_kb_totals_sketched(spark, sf_dir):
    """Chunks exact, and whether documents, sources and tags of a synced index are within the sketches' bound.

    Sketches are made, the index is changed, and only the changed buckets are sketched again.
    """
    base = _synced_store(spark, sf_dir, "content", before=lambda base: st.refresh_sketches(spark, base))
    told = st.sketched_totals(st.refresh_sketches(spark, base))
    index = ix.read_index(spark, base)
    exact = index.agg(F.count_distinct("doc_id").alias("docs"), F.count_distinct("source").alias("sources"), F.count_distinct(tx.first_tag("tags")).alias("tags"))
    within = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.lit(st.SKETCH_BOUND) * F.col(b)
    one = F.lit(1).alias("one")
    both = told.select("*", one).join(exact.select("*", one), "one")
    return both.select("total_chunks", within("total_docs", "docs").alias("docs_within"), within("total_sources", "sources").alias("sources_within"), within("total_tags", "tags").alias("tags_within"))


# --------------------------------------------------------------------------
# Key-ordered listing
# --------------------------------------------------------------------------
def _listing(spark, sf_dir):
    path = scratch_path(spark, "listing")
    ls.save_listing(line_index(spark, sf_dir).select("key", "doc_id"), path)
    return ls.open_listing(spark, path)


@register(
    "page_walk",
    f"""with k as (select key, row_number() over (order by key) - 1 as n, count(*) over () as total from {LI})
select key, cast(n // ((total + 7) // 8) as bigint) as page from k""",
)
def q_page_walk(spark, sf_dir):
    """Paging to the end by continuation tokens, an eighth of the keys a page; each page opens only its files."""
    listing = _listing(spark, sf_dir)
    size = -(-(listing.ranges.agg(F.sum("rows")).first()[0] or 8) // 8)
    pages, token, n = [], None, 0
    while n == 0 or token is not None:
        page, token = ls.list_page(listing, size, token)
        pages.append(page.select("key", F.lit(n).cast("long").alias("page")))
        n += 1
    out = pages[0]
    for p in pages[1:]:
        out = out.unionByName(p)
    return out


@register("page_numbers", f"select key, (row_number() over (order by key) - 1) // 1000 as page from {LI}")
def q_page_numbers(spark, sf_dir):
    """S8 for all pages of 1,000 at once: the page of every key."""
    return ls.all_pages(_listing(spark, sf_dir), 1000).select("key", "page")


@register("segment_listing", f"select key, true as in_order from {LI}")
def q_segment_listing(spark, sf_dir):
    """S7 on the listing: four segments, each a run of whole files; together every key once, in ranges that follow each other."""
    listing = _listing(spark, sf_dir)
    parts = [ls.list_segment(listing, 4, i).select("key", F.lit(i).alias("segment")) for i in range(4)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    ends = rows.groupBy("segment").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    before = ends.select((F.col("segment") + 1).alias("segment"), F.col("hi").alias("prev"))  # four rows
    order = ends.join(before, "segment", "left").select("segment", F.coalesce(F.col("prev") < F.col("lo"), F.lit(True)).alias("in_order"))
    return rows.join(F.broadcast(order), "segment").select("key", "in_order")


# --------------------------------------------------------------------------
# S10, J8
# --------------------------------------------------------------------------
def _vector_facts(sources: str) -> str:
    return f"""{_sparse(f"select md5(left(text, 8000)) as id, left(text, 8000) as text from (select distinct text from {sources})")},
v as (select id, count(*) as nnz, sum(cast(weight as float)::double * cast(weight as float)::double) as n2 from sp group by id)"""


def _facts(rows):
    nnz = F.size(F.filter("vec", lambda x: x != 0))
    n2 = F.aggregate(F.transform("vec", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return rows.select("*", nnz.alias("nnz"), F.round(n2, 5).alias("norm2"))


@register(
    "embed_cache_stored",
    f"""with {_vector_facts("documents")},
c as (select distinct md5(left(text, 8000)) as id from documents where lang = 'en'),
m as (select count(distinct md5(left(text, 8000))) as n from documents where md5(left(text, 8000)) not in (select id from c))
select cast(d.doc_id as varchar) as doc_id, md5(left(d.text, 8000)) as text_md5, v.nnz, round(v.n2, 5) as norm2, m.n as second_run, 0 as third_run
from documents d left join v on v.id = md5(left(d.text, 8000)), m""",
)
def q_embed_cache_stored(spark, sf_dir):
    """A stored cache. The first run embeds the English documents, the second what is missing, the third nothing."""
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang")
    cache, emb = em.EmbeddingCache(spark, scratch_path(spark, "cache"), buckets=8), em.hash_embedder(DIM)
    run = lambda rows: em.embed_cached(rows.select("doc_id", "text"), "text", cache, emb, em.HASH_EMBED_MODEL, DIM)
    run(d.where(F.col("lang") == "en"))
    second = run(d)[1]
    rows, third = run(d)
    return _facts(rows).select("doc_id", "text_md5", "nnz", "norm2", F.lit(second).cast("long").alias("second_run"), F.lit(third).cast("int").alias("third_run"))


_HEAVY_SQL = "(select doc_id, case when doc_id % 3 = 0 then 'One text that a third of all documents hold.' else text end as text from documents)"


@register(
    "embed_dedup_heavy",
    f"""with {_vector_facts(_HEAVY_SQL)}
select cast(d.doc_id as varchar) as doc_id, md5(left(d.text, 8000)) as text_md5, v.nnz, round(v.n2, 5) as norm2
from {_HEAVY_SQL} d left join v on v.id = md5(left(d.text, 8000))""",
)
def q_embed_dedup_heavy(spark, sf_dir):
    """J8 where one text holds a third of the rows: it is embedded once, and its rows are not gathered."""
    text = F.when(F.col("doc_id") % 3 == 0, F.lit("One text that a third of all documents hold.")).otherwise(F.col("text"))
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), text.alias("text"))
    return _facts(em.embed_dedup(d, "text", em.hash_embedder(DIM))).select("doc_id", "text_md5", "nnz", "norm2")


# --------------------------------------------------------------------------
# K3: residual codes over text embeddings
# --------------------------------------------------------------------------
@register("ann_text_recall", "select count(*) as queries, true as recall_95, true as read_under_fifth from benchmark")
def q_ann_text_recall(spark, sf_dir):
    """K3: recall@5 of the coded search for the benchmark texts over all document embeddings, held against exact K1:
    whether it is 0.95 at least, and whether codes and vectors read for a query are less than a fifth of all vectors' bytes."""
    from tessera.operators.search import hash_queries

    index = materialize(_doc_index(spark, sf_dir).select("key", "vec"), "vectors")
    asked = materialize(hash_queries(read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), SPEC), "asked")
    path = scratch_path(spark, "pq")
    pq.save_pq(pq.build_pq(index, SPEC), path)
    coded = pq.load_pq(spark, path)
    n, probe = index.count(), -(-coded.lists // 3)
    rerank = max(5, min(128, n // 8))
    recall = recall_at_k(pq.pq_search(coded, asked, k=5, nprobe=probe, rerank=rerank), knn_topk(index, asked, SPEC, k=5))
    read = pq.share_read(coded, asked, probe)
    one = F.lit(1).alias("one")
    both = recall.select("recall", one).join(read.select("share", "queries", one), "one")
    read_bytes = F.col("share") * F.lit(len(coded.books) / (4 * DIM)) + F.lit(rerank / max(1, n))
    return both.select("queries", (F.col("recall") >= 0.95).alias("recall_95"), (read_bytes < 0.2).alias("read_under_fifth"))


# --------------------------------------------------------------------------
# A catalog of any size
# --------------------------------------------------------------------------
_WORD_CATALOG_SQL = """
kw as (select distinct 't' || cast(('0x' || substr(md5(w), 1, 2))::integer % 16 as varchar) as tag, w as kw
       from (select unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) as w from documents))
"""


@register(
    "keyword_tagger_table",
    f"""with {_WORD_CATALOG_SQL},
vocab as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as v from documents),
inside as (select v, kw, tag from vocab join kw on contains(v, kw)),
words as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as v from documents),
hits as (select cast(doc_id as varchar) as doc_id, tag, count(distinct kw) as hits from words join inside using (v) group by all)
select doc_id, arg_min(tag, (-hits, tag)) as best_tag, max(hits) as hits from hits group by doc_id""",
)
def q_keyword_tagger_table(spark, sf_dir):
    """J11 by a table: every word of the documents is a keyword of one of sixteen tags."""
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    words = d.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), 0))).alias("w")).distinct()
    tag = F.concat(F.lit("t"), (F.conv(F.substring(F.md5("w"), 1, 2), 16, 10).cast("int") % 16).cast("string"))
    catalog = words.select(tag.alias("name"), F.array("w").alias("keywords"))
    hits = tg.keyword_matches(d, catalog, parallelism=parallelism(spark))
    return tg.best_tag(hits).select("doc_id", "best_tag", F.col("hits").cast("long").alias("hits"))
