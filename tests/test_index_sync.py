"""Vector table operations and sync: properties (idempotence, versions, replacement)."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import index as ix
from tessera.operators import sync as sy
from tessera.plans.fixtures import index_view
from tessera.plans.ingest import ingest
from tessera.schema import IndexSpec
from tests.conftest import SF001


def test_upsert_twice_equals_once(spark):
    iv = index_view(spark, SF001).select("key", "doc_id", "tags")
    new = iv.orderBy("key").limit(20).withColumn("tags", F.lit("new"))
    once = ix.put_vectors(iv, new)
    twice = ix.put_vectors(once, new)
    assert sorted(once.collect()) == sorted(twice.collect())
    assert once.count() == iv.count()


def test_same_key_twice_later_version_wins(spark):
    iv = index_view(spark, SF001).select("key", "doc_id", "tags")
    k = iv.first().key
    batch = spark.createDataFrame([(k, "x", "v1", 1), (k, "x", "v2", 2)], "key string, doc_id string, tags string, version int")
    out = ix.put_vectors(iv, batch)
    assert [r.tags for r in out.where(F.col("key") == k).collect()] == ["v2"]


def test_delete_and_get(spark):
    iv = index_view(spark, SF001)
    keys = [r.key for r in iv.orderBy("key").limit(5).collect()]
    assert ix.get_vectors(iv, ",".join(keys + ["missing"])).count() == 5
    assert ix.delete_keys(iv, keys).count() == iv.count() - 5


def test_pages_cover_table(spark):
    iv = index_view(spark, SF001).select("key")
    seen, token = [], None
    while True:
        page = [r.key for r in ix.page_vectors(iv, 37, token).collect()]
        seen += page
        if len(page) < 37:
            break
        token = page[-1]
    assert sorted(seen) == sorted(r.key for r in iv.collect())


def test_segments_partition_table(spark):
    iv = index_view(spark, SF001).select("key")
    total = sum(ix.segment_scan(iv, 5, i).count() for i in range(5))
    assert total == iv.count()


def _corpus(spark, sf=SF001):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.lit("txt").alias("file_type"),
                    "source", F.col("lang").alias("tags"))


def test_ingest_sync_idempotent(spark, tmpdir_path):
    base = f"{tmpdir_path}/index"
    spec = IndexSpec(dim=64)
    t = dt.datetime(2024, 1, 1)
    c = _corpus(spark)
    s1 = {r.status: r.docs for r in ingest(spark, c, base, spec, sync=True, ingested_at=t).collect()}
    assert set(s1) == {"new"}
    idx1 = sorted(ix.read_index(spark, base).select("key", "content_hash").collect())
    s2 = {r.status: r.chunks_written for r in ingest(spark, c, base, spec, sync=True, ingested_at=t).collect()}
    assert set(s2) == {"unchanged"} and s2["unchanged"] == 0
    idx2 = sorted(ix.read_index(spark, base).select("key", "content_hash").collect())
    assert idx1 == idx2
    # one changed, one removed
    c2 = c.where(F.col("doc_id") != "1").withColumn(
        "text", F.when(F.col("doc_id") == "2", F.lit("short new text")).otherwise(F.col("text")))
    s3 = {r.status: r.docs for r in ingest(spark, c2, base, spec, sync=True, ingested_at=t).collect()}
    assert s3.get("changed") == 1 and s3.get("removed") == 1
    idx3 = ix.read_index(spark, base)
    assert idx3.where("doc_id = '1'").count() == 0
    assert [r.chunk_index for r in idx3.where("doc_id = '2'").collect()] == [0]  # no stale chunks (Q11)


def test_sync_plan_counts_match_fixture(spark):
    from tessera.plans.fixtures import incoming_docs, line_index, stored_docs

    inc = incoming_docs(spark, "/root/testdata/sf0.01").select(F.col("doc_id").cast("string").alias("doc_id"),
                                                               F.md5("text").alias("content_hash"))
    st = line_index(spark, "/root/testdata/sf0.01", docs=stored_docs(spark, "/root/testdata/sf0.01"))
    got = {r.status: r["count"] for r in sy.sync_plan(inc, st).groupBy("status").count().collect()}
    assert got == {"unchanged": 624, "changed": 155, "new": 130, "removed": 78}


def test_small_change_rewrites_only_its_bucket(spark, tmpdir_path):
    base = f"{tmpdir_path}/index"
    spec = IndexSpec(dim=64)
    t = dt.datetime(2024, 1, 1)
    c = _corpus(spark)
    ingest(spark, c, base, spec, sync=True, ingested_at=t)
    _, m1 = ix.read_manifest(spark, base)
    c2 = c.withColumn("text", F.when(F.col("doc_id") == "7", F.lit("a new text for seven")).otherwise(F.col("text")))
    ingest(spark, c2, base, spec, sync=True, ingested_at=t)
    _, m2 = ix.read_manifest(spark, base)
    changed = [b for b in m2 if m2[b] != m1.get(b)]
    assert len(changed) == 1  # the bucket of document 7 only
    assert set(m1) == set(m2)
    idx = ix.read_index(spark, base)
    assert [r.content for r in idx.where("doc_id = '7'").collect()] == ["a new text for seven"]
    assert idx.count() == ix.read_index(spark, base).count()


def test_removing_every_doc_of_a_bucket_drops_it(spark, tmpdir_path):
    base = f"{tmpdir_path}/index"
    rows = spark.createDataFrame([("a.chunk-0000", "a", 0, 1), ("b.chunk-0000", "b", 0, 1)],
                                 "key string, doc_id string, chunk_index int, total_chunks int")
    ix.write_index(rows, base, buckets=8)
    _, m1 = ix.read_manifest(spark, base)
    ix.apply_doc_changes(spark, base, rows.where("false"), spark.createDataFrame([("a",)], "doc_id string"))
    _, m2 = ix.read_manifest(spark, base)
    assert [r.doc_id for r in ix.read_index(spark, base).collect()] == ["b"]
    assert len(m2) == len(m1) - (1 if len(m1) == 2 else 0)
    v_before = ix.current_version(spark, base)
    ix.apply_doc_changes(spark, base, rows.where("false"), spark.createDataFrame([], "doc_id string"))
    assert ix.current_version(spark, base) == v_before  # nothing to change: no new version


def test_vacuum_keeps_what_the_current_manifest_reads(spark, tmpdir_path):
    base = f"{tmpdir_path}/index"
    rows = spark.createDataFrame([(f"{d}.chunk-0000", d, 0, 1) for d in "abcdefgh"],
                                 "key string, doc_id string, chunk_index int, total_chunks int")
    ix.write_index(rows, base, buckets=4)
    new = spark.createDataFrame([("a.chunk-0000", "a", 0, 1, "x")], "key string, doc_id string, chunk_index int, total_chunks int, tags string")
    ix.apply_doc_changes(spark, base, new, spark.createDataFrame([], "doc_id string"))
    before = sorted((r.doc_id, r.tags) for r in ix.read_index(spark, base).collect())
    deleted = ix.vacuum_index(spark, base, keep_versions=1)
    assert deleted  # the old manifest at least
    after = sorted((r.doc_id, r.tags) for r in ix.read_index(spark, base).collect())
    assert before == after and ("a", "x") in after and len(after) == 8
