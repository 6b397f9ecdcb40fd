"""Streaming queries: run to completion over the document table as a file stream."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tessera.operators import index as ix
from tessera.plans.registry import register
from tessera.schema import IndexSpec
from tessera.session import scratch_path
from tessera.sources.tables import read_table
from tessera.streaming import ingest as si


def _doc_stream(spark, sf_dir):
    """The documents as a file stream, whether the table is one file or a folder of them."""
    schema = read_table(spark, sf_dir, "documents").schema
    return si.document_stream(spark, os.path.join(sf_dir, "documents.parquet"), schema, glob=None)


@register("stream_ingest")
def q_stream_ingest(spark, sf_dir):
    """Documents arriving as a file stream are chunked, embedded and
    upserted into a versioned index by foreachBatch; returns the final index."""
    base = scratch_path(spark, "stream-index")
    to_corpus = lambda b: b.select(F.col("doc_id").cast("string").alias("doc_id"), "text",
                                   F.lit("txt").alias("file_type"), "source", F.col("lang").alias("tags"))
    q = si.stream_ingest(spark, _doc_stream(spark, sf_dir), base, IndexSpec(dim=64), checkpoint=base + "-ckpt",
                         to_corpus=to_corpus)
    q.awaitTermination()
    idx = ix.read_index(spark, base)
    return idx.select("key", "doc_id", "chunk_index", "total_chunks", "content_hash", "tags")


@register(
    "stream_ingest_docs",
    """select cast(doc_id as varchar) as doc_id, md5(text) as content_hash, concat(cast(doc_id as varchar), '.chunk-0000') as key,
              true as whole from documents where regexp_matches(text, '\\S')""",
)
def q_stream_ingest_docs(spark, sf_dir):
    """R1, final state: hash and first key of every document, and whether its chunks 0 .. n-1 are all there once."""
    rows = q_stream_ingest(spark, sf_dir)
    return rows.groupBy("doc_id", "content_hash").agg(
        F.min("key").alias("key"),
        ((F.count("*") == F.max("total_chunks")) & (F.countDistinct("chunk_index") == F.count("*")) & (F.max("chunk_index") == F.count("*") - 1)).alias("whole"))


@register("stream_dedup", "select distinct md5(text) as text_md5 from documents")
def q_stream_dedup(spark, sf_dir):
    """R2: streaming de-duplication of equal texts within a watermark."""
    s = _doc_stream(spark, sf_dir).withColumn(
        "event_time", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 90).cast("int")).cast("timestamp"))
    d = si.stream_dedup(s, delay="365 days").select("text_md5")
    return si.run_to_table(spark, d, "stream-dedup")
