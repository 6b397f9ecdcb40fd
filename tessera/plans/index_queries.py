"""Vector-table queries: list, segment, page, get, delete, upsert, versions, sync."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import index as ix
from tessera.operators import sync as sy
from tessera.plans.fixtures import (
    INCOMING_SQL,
    INDEX_VIEW_SQL,
    STORED_SQL,
    incoming_docs,
    index_view,
    line_index,
    line_index_sql,
    stored_docs,
)
from tessera.plans.registry import register
from tessera.session import materialize
from tessera.sources.tables import read_table

LI = line_index_sql()


def _labels(spark, sf_dir):
    return read_table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("doc_id"), "quality", "toxic")


@register("list_vectors", f"select key, doc_id, chunk_index, total_chunks, tags from {LI}")
def q_list_vectors(spark, sf_dir):
    """Full listing with metadata, without vectors (pruned)."""
    return ix.list_vectors(line_index(spark, sf_dir), return_metadata=True).select(
        "key", "doc_id", "chunk_index", "total_chunks", "tags")


@register(
    "segment_scan",
    f"select key, cast(('0x' || substr(md5(key), 1, 8))::bigint % 4 as integer) as segment from {LI}",
)
def q_segment_scan(spark, sf_dir):
    """The four segments of a parallel listing; their union is the whole table."""
    li = line_index(spark, sf_dir).select("key")
    parts = [ix.segment_scan(li, 4, i).withColumn("segment", F.lit(i)) for i in range(4)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("page_vectors", f"select key, doc_id from {LI} where key > '1' order by key limit 50")
def q_page_vectors(spark, sf_dir):
    """One page of 50 keys after the continuation token '1'."""
    return ix.page_vectors(line_index(spark, sf_dir).select("key", "doc_id"), 50, next_token="1")


@register(
    "get_vectors",
    f"""select li.key, li.doc_id, li.content from {LI} li
        where li.key in (select printf('%s.chunk-%04d', cast(doc_id as varchar), 0) from labels where quality = 1)""",
)
def q_get_vectors(spark, sf_dir):
    """Point lookup of the first chunk of every good-quality document."""
    keys = _labels(spark, sf_dir).where(F.col("quality") == 1).select(tx.vector_key("doc_id", F.lit(0)).alias("key"))
    return ix.get_vectors(line_index(spark, sf_dir), keys).select("key", "doc_id", "content")


@register(
    "delete_keys",
    f"""select key from {LI}
        where key not in (select printf('%s.chunk-%04d', cast(doc_id as varchar), 0) from labels where toxic = 1)""",
)
def q_delete_keys(spark, sf_dir):
    """The index without the first chunk of every toxic document."""
    keys = _labels(spark, sf_dir).where(F.col("toxic") == 1).select(tx.vector_key("doc_id", F.lit(0)).alias("key"))
    return ix.delete_keys(line_index(spark, sf_dir), keys).select("key")


@register(
    "delete_doc",
    f"""select doc_id, count(*) as deleted_chunks from {LI}
        where doc_id in (select cast(doc_id as varchar) from labels where toxic = 1) group by doc_id""",
)
def q_delete_doc(spark, sf_dir):
    """Delete every chunk of the toxic documents; chunks deleted per document."""
    _, deleted = ix.delete_docs(line_index(spark, sf_dir), _labels(spark, sf_dir).where(F.col("toxic") == 1))
    return deleted


@register(
    "doc_chunks",
    f"""select key, chunk_index from {LI} where doc_id in (select cast(doc_id as varchar) from labels where quality = 1)""",
)
def q_doc_chunks(spark, sf_dir):
    """all chunks of the good-quality documents."""
    return ix.doc_chunks(line_index(spark, sf_dir), _labels(spark, sf_dir).where(F.col("quality") == 1)).select(
        "key", "chunk_index")


@register("doc_header_rows", f"select key, doc_id, content_hash from {LI} where chunk_index = 0 and doc_id <> ''")
def q_doc_header_rows(spark, sf_dir):
    """chunk 0 of every document."""
    return ix.doc_header_rows(line_index(spark, sf_dir)).select("key", "doc_id", "content_hash")


@register("doc_hashes", f"select doc_id, arg_max(content_hash, ingested_at) as content_hash from {LI} where chunk_index = 0 group by doc_id")
def q_doc_hashes(spark, sf_dir):
    """A5: stored document hashes from the header rows."""
    return ix.doc_hashes(line_index(spark, sf_dir))


_UPSERT_SQL = f"""
with old as (select key, doc_id, tags, 0 as version from ({INDEX_VIEW_SQL})),
new as (select printf('%s.chunk-%04d', cast(doc_id as varchar), 0) as key, cast(doc_id as varchar) as doc_id,
               'q' || cast(quality as varchar) as tags, 1 as version from labels
        union all
        select printf('%s.chunk-%04d', cast(doc_id as varchar), 0), cast(doc_id as varchar), 't' || cast(toxic as varchar), 2
        from labels where toxic = 1),
u as (select * from old where key not in (select key from new)
      union all select * from new),
r as (select *, row_number() over (partition by key order by version desc) as rn from u)
select key, doc_id, tags, version from r where rn = 1
"""


@register("put_vectors", _UPSERT_SQL)
def q_put_vectors(spark, sf_dir):
    """Upsert re-tagged rows for labelled documents into the index
    (two versions of the same key in one batch: the later wins)."""
    old = index_view(spark, sf_dir).select("key", "doc_id", "tags", F.lit(0).alias("version"))
    lab = _labels(spark, sf_dir)
    k = tx.vector_key("doc_id", F.lit(0)).alias("key")
    new = lab.select(k, "doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("tags"), F.lit(1).alias("version"))
    new2 = lab.where(F.col("toxic") == 1).select(k, "doc_id", F.concat(F.lit("t"), F.col("toxic").cast("string")).alias("tags"),
                                                 F.lit(2).alias("version"))
    batch = new.unionByName(new2)
    latest = ix.latest_version(batch, "key", "version")
    return ix.put_vectors(old, batch).select("key", "doc_id", "tags").join(
        latest.select("key", "version"), "key", "left").select(
        "key", "doc_id", "tags", F.coalesce("version", F.lit(0)).alias("version"))


@register(
    "latest_version",
    f"""
with u as (select cast(doc_id as varchar) as doc_id, md5(text) as content_hash, 1 as version from {STORED_SQL}
           union all select cast(doc_id as varchar), md5(text), 2 from {INCOMING_SQL})
select doc_id, arg_max(content_hash, version) as content_hash, max(version) as version from u group by doc_id
""",
)
def q_latest_version(spark, sf_dir):
    """Last write per key over the stored and incoming versions of the corpus."""
    s = stored_docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), F.md5("text").alias("content_hash"),
                                          F.lit(1).alias("version"))
    i = incoming_docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), F.md5("text").alias("content_hash"),
                                            F.lit(2).alias("version"))
    return ix.latest_version(s.unionByName(i), "doc_id", "version")


# --------------------------------------------------------------------------
# Sync
# --------------------------------------------------------------------------
def _sync_inputs(spark, sf_dir):
    inc = incoming_docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang", "source",
                                              F.md5("text").alias("content_hash"))
    stored_index = line_index(spark, sf_dir, docs=stored_docs(spark, sf_dir))
    return inc, stored_index


_PLAN_SQL = f"""
plan as (select coalesce(i.doc_id, s.doc_id) as doc_id,
                case when s.h is null then 'new' when i.h is null then 'removed'
                     when s.h = i.h then 'unchanged' else 'changed' end as status
         from (select cast(doc_id as varchar) as doc_id, md5(text) as h from {INCOMING_SQL}) i
         full outer join (select doc_id, arg_max(content_hash, ingested_at) as h from {line_index_sql(STORED_SQL)}
                          where chunk_index = 0 group by doc_id) s on i.doc_id = s.doc_id)
"""


@register("sync_plan", f"with {_PLAN_SQL} select doc_id, status from plan")
def q_sync_plan(spark, sf_dir):
    """New / changed / unchanged / removed per document (hash compare before chunking)."""
    inc, stored_index = _sync_inputs(spark, sf_dir)
    return sy.sync_plan(inc, stored_index).select("doc_id", "status")


@register("sync_removed", f"with {_PLAN_SQL} select doc_id from plan where status = 'removed'")
def q_sync_removed(spark, sf_dir):
    """Stored documents that vanished from the incoming set."""
    inc, stored_index = _sync_inputs(spark, sf_dir)
    return sy.sync_removed(sy.sync_plan(inc, stored_index))


@register(
    "ids_except",
    f"""select cast(doc_id as varchar) as doc_id from {STORED_SQL}
        except select cast(doc_id as varchar) from {INCOMING_SQL}""",
)
def q_ids_except(spark, sf_dir):
    """Existing ids minus processed ids."""
    s = stored_docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"))
    i = incoming_docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"))
    return sy.ids_except(s, i)


@register(
    "sync_apply",
    f"""
with {_PLAN_SQL},
old as (select key, doc_id, content_hash from {line_index_sql(STORED_SQL)}),
new as (select key, doc_id, content_hash from {line_index_sql(INCOMING_SQL)}
        where doc_id in (select doc_id from plan where status in ('new', 'changed')))
select * from old where doc_id not in (select doc_id from plan where status in ('changed', 'removed'))
union all select * from new
""",
)
def q_sync_apply(spark, sf_dir):
    """The index after sync -- unchanged rows kept, changed/new documents re-chunked, removed dropped."""
    inc, stored_index = _sync_inputs(spark, sf_dir)
    plan = materialize(sy.sync_plan(inc, stored_index), "plan")  # three parts of the result read it
    todo = sy.to_ingest(inc, plan)
    new_rows = line_index(spark, sf_dir, docs=todo.withColumn("doc_id", F.col("doc_id")))
    return sy.sync_apply(stored_index, new_rows, plan).select("key", "doc_id", "content_hash")


@register(
    "sync_summary",
    f"""
with {_PLAN_SQL},
old as (select doc_id, count(*) as n from {line_index_sql(STORED_SQL)} group by doc_id),
new as (select doc_id, count(*) as n from {line_index_sql(INCOMING_SQL)} group by doc_id)
select p.status, count(*) as docs, coalesce(sum(o.n), 0) as stored_chunks,
       coalesce(sum(case when p.status in ('new', 'changed') then n.n end), 0) as chunks_written
from plan p left join old o on o.doc_id = p.doc_id left join new n on n.doc_id = p.doc_id
group by p.status
""",
)
def q_sync_summary(spark, sf_dir):
    """A4: per status documents, stored chunks and chunks written."""
    inc, stored_index = _sync_inputs(spark, sf_dir)
    plan = materialize(sy.sync_plan(inc, stored_index), "plan")
    new_rows = line_index(spark, sf_dir, docs=sy.to_ingest(inc, plan))
    return sy.sync_summary(plan, stored_index, new_rows)


@register(
    "sync_counters",
    f"""
with {_PLAN_SQL},
old as (select doc_id, count(*) as n from {line_index_sql(STORED_SQL)} group by doc_id),
new as (select doc_id, count(*) as n from {line_index_sql(INCOMING_SQL)} group by doc_id),
s as (select p.status, count(*) as docs, coalesce(sum(o.n), 0) as stored_chunks,
             coalesce(sum(case when p.status in ('new', 'changed') then n.n end), 0) as chunks_written
      from plan p left join old o on o.doc_id = p.doc_id left join new n on n.doc_id = p.doc_id group by p.status)
select coalesce(sum(case when status in ('new', 'changed') then docs end), 0) as ingested,
       coalesce(sum(case when status = 'unchanged' then docs end), 0) as skipped,
       coalesce(sum(case when status = 'removed' then stored_chunks end), 0) as deleted,
       coalesce(sum(chunks_written), 0) as chunks_written
from s
""",
)
def q_sync_counters(spark, sf_dir):
    """A4/Q20: ingested, skipped, deleted (chunks) and chunks written, as one row."""
    inc, stored_index = _sync_inputs(spark, sf_dir)
    plan = materialize(sy.sync_plan(inc, stored_index), "plan")
    new_rows = line_index(spark, sf_dir, docs=sy.to_ingest(inc, plan))
    return sy.sync_counters(sy.sync_summary(plan, stored_index, new_rows))


@register("ingest_sync", f"with {_PLAN_SQL} select status, count(*) as docs from plan group by status")
def q_ingest_sync(spark, sf_dir):
    """E1 end to end: ingest the stored version of the corpus into a versioned
    index, then sync the incoming version into it (only touched buckets are
    rewritten); documents per status."""
    import datetime as dt

    from tessera.plans.ingest import ingest
    from tessera.schema import IndexSpec
    from tessera.session import scratch_path

    base = scratch_path(spark, "kb")
    spec = IndexSpec(dim=64)
    t = dt.datetime(2024, 1, 1)

    def corpus(d):
        return d.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.lit("txt").alias("file_type"),
                        "source", F.col("lang").alias("tags"))

    ingest(spark, corpus(stored_docs(spark, sf_dir)), base, spec, sync=True, ingested_at=t)
    summary = ingest(spark, corpus(incoming_docs(spark, sf_dir)), base, spec, sync=True, ingested_at=t)
    return summary.select("status", "docs")
