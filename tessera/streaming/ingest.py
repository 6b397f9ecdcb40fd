"""Structured Streaming: continuous ingest (R1) and streaming de-duplication (R2).

R1 runs the batch sync as ``foreachBatch``: every micro-batch of arriving
documents is compared with the stored hashes, new and changed documents are
chunked and embedded, and the touched documents are replaced in one write.
A replayed micro-batch finds its documents unchanged and writes nothing, so
the sink is idempotent (keys are deterministic).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import index as ix
from tessera.operators import sync as sy
from tessera.plans.ingest import apply_plan, choose_rows
from tessera.schema import IndexSpec
from tessera.session import checkpoint_dir, materialize, scratch_path


def document_stream(spark: SparkSession, path: str, schema, glob: str | None = "*.parquet",
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files arriving in the folder ``path`` as a stream of documents; ``glob`` (None: all) chooses by their names.

    A ``path`` that is one file is a stream of that file.
    """
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        path, glob = p.getParent().toString(), p.getName()
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def stream_ingest(spark: SparkSession, docs: DataFrame, base: str, spec: IndexSpec, checkpoint: str | None = None,
                  to_corpus=None, compact_parts: int = 16, **build_kw):
    """Start the ingest stream; returns the ``StreamingQuery`` (trigger availableNow).

    ``to_corpus`` maps a micro-batch to corpus rows (``doc_id, text, ...``). A
    bucket that has grown to ``compact_parts`` parts is made one again.
    """
    checkpoint = checkpoint or os.path.join(checkpoint_dir(spark), "stream-ingest-" + os.path.basename(base.rstrip("/")))

    def apply(batch: DataFrame, batch_id: int):
        corpus = (to_corpus(batch) if to_corpus else batch).where(~tx.is_blank("text"))
        chosen = materialize(choose_rows(corpus), "stream-ids")
        # only the buckets that this batch's documents are in are read
        stored = ix.read_buckets(spark, base, chosen.select("doc_id"))
        plan = sy.sync_plan(chosen, stored, keep=tuple(c for c in chosen.columns if c not in ("doc_id", "content_hash")))
        apply_plan(spark, corpus, base, spec, plan.where(F.col("status") != "removed"), removed=False, **build_kw)
        ix.compact_index(spark, base, min_parts=compact_parts)

    q = (docs.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    return q


def stream_dedup(docs: DataFrame, text_col: str = "text", event_time: str = "event_time",
                 delay: str = "1 day") -> DataFrame:
    """R2: drop texts equal to one already seen within the watermark delay."""
    return (docs.withColumn("text_md5", F.md5(F.col(text_col)))
            .withWatermark(event_time, delay)
            .dropDuplicatesWithinWatermark(["text_md5"]))


def run_to_table(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream to completion (availableNow) into Parquet under the
    checkpoint folder and read the result back as a batch DataFrame."""
    out = scratch_path(spark, name)
    q = (stream.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", out + "-ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)  # a stream without rows writes no file to tell it by
