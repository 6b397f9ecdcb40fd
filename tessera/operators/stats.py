"""Knowledge-base statistics: one pruned scan of the index, partial aggregates."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import index as ix
from tessera.session import materialize

RECENT_N = 10


def kb_totals(index: DataFrame) -> DataFrame:
    """A1: total chunks and distinct documents (a missing id counts as 'unknown')."""
    return index.agg(
        F.count("*").alias("total_chunks"),
        F.count_distinct(F.coalesce(F.col("doc_id"), F.lit("unknown"))).alias("total_docs"),
    )


def kb_totals_approx(index: DataFrame, rsd: float = 0.01) -> DataFrame:
    """The same with HyperLogLog++ for indexes with billions of rows."""
    return index.agg(
        F.count("*").alias("total_chunks"),
        F.approx_count_distinct(F.coalesce(F.col("doc_id"), F.lit("unknown")), rsd).alias("total_docs"),
    )


def tag_distribution(index: DataFrame) -> DataFrame:
    """A2: per first tag -- distinct documents and chunks, sorted by tag."""
    t = index.select(F.coalesce(F.col("doc_id"), F.lit("unknown")).alias("doc_id"), tx.first_tag("tags").alias("tag"))
    return t.groupBy("tag").agg(F.count_distinct("doc_id").alias("docs"), F.count("*").alias("chunks")).orderBy("tag")


def doc_rollup(index: DataFrame) -> DataFrame:
    """A3: per document -- chunks, and tag / ingest day / source of its first row
    (first = lowest (chunk_index, key), a deterministic listing order)."""
    first = F.struct(F.col("chunk_index"), F.col("key"))
    day = F.date_format("ingested_at", "yyyy-MM-dd") if dict(index.dtypes).get("ingested_at") == "timestamp" \
        else F.substring("ingested_at", 1, 10)
    # group on the plain column (keeps an existing doc_id partitioning); the
    # null group is the 'unknown' document
    g = index.groupBy("doc_id").agg(
        F.count("*").alias("chunks"),
        F.min_by(tx.first_tag("tags"), first).alias("tag"),
        F.min_by(F.coalesce(day, F.lit("")), first).alias("ingested_at"),
        F.min_by(F.coalesce(F.col("source"), F.lit("")), first).alias("source"),
    )
    return g.select(F.coalesce(F.col("doc_id"), F.lit("unknown")).alias("doc_id"), "chunks", "tag", "ingested_at", "source")


def recent_docs(index: DataFrame, n: int = RECENT_N) -> DataFrame:
    """K4/Q24: the n most recent documents by ingest day, ties by doc_id (top-k, no full sort)."""
    r = doc_rollup(index)
    return r.orderBy(F.col("ingested_at").desc(), F.col("doc_id").asc()).limit(n).select(
        "doc_id", "tag", "chunks", "ingested_at", F.substring("source", 1, tx.STATS_SOURCE_CHARS).alias("source"))


# The markdown formats of the statistics report.
MD_STATS_TITLE = "📊 知识库状态："
MD_DOCS = "文档数：%d"
MD_CHUNKS = "Chunk 总数：%d"
MD_BY_TAG = "按分类："
MD_TAG_LINE = "  %s: %d 篇 (%d chunks)"
MD_RECENT = "最近入库："
MD_RECENT_LINE = "  %s %s — %d chunks (%s)"
MD_UNTAGGED = "未分类"


def stats_lines(index: DataFrame) -> DataFrame:
    """One text line per tag (untagged shown with its label)."""
    d = tag_distribution(index)
    label = F.when(F.col("tag") == tx.UNTAGGED, F.lit(MD_UNTAGGED)).otherwise(F.col("tag"))
    return d.select("tag", F.format_string(MD_TAG_LINE, label, F.col("docs"), F.col("chunks")).alias("line"))


def _counts(index: DataFrame) -> DataFrame:
    """A1-A3 in one scan, written: a row a document (``doc_id`` set) and a row a tag (``tag`` set).

    The index is aggregated once by document and tag; grouping sets over what
    is left give both kinds of rows.
    """
    first = F.struct(F.col("chunk_index"), F.col("key"))
    day = F.date_format("ingested_at", "yyyy-MM-dd") if dict(index.dtypes).get("ingested_at") == "timestamp" \
        else F.substring("ingested_at", 1, 10)
    head = F.struct(F.coalesce(day, F.lit("")).alias("ingested_at"), F.coalesce(F.col("source"), F.lit("")).alias("source"))
    both = index.select(F.col("doc_id").alias("doc"), tx.first_tag("tags").alias("own_tag"), first.alias("first"), head.alias("head"))
    both = both.groupBy("doc", "own_tag").agg(F.count("*").alias("chunks"), F.min("first").alias("first"), F.min_by("head", "first").alias("head"))
    both = both.withColumn("doc_tag", F.col("own_tag"))
    sets = both.groupingSets([["doc"], ["own_tag"]], "doc", "own_tag").agg(
        F.grouping("doc").alias("by_tag"), F.sum("chunks").alias("chunks"), F.count("*").alias("pairs"),
        F.min_by("doc_tag", "first").alias("tag_of_first"), F.min_by("head", "first").alias("head"),
        # rows without an id count as a document 'unknown', together with one of that name
        (F.max(F.col("doc").isNull()) & F.coalesce(F.max(F.col("doc") == "unknown"), F.lit(False))).alias("twice"))
    return materialize(sets, "counts")


def stats_report(index: DataFrame, n_recent: int = RECENT_N) -> DataFrame:
    """The whole statistics report as rows ``part, sort_key, line``; ordered
    by (part, sort_key) it reads: totals (0), one line per tag in tag order
    (1), the recent documents (2). The index is scanned once (``_counts``). No
    global window over the tags: the tag itself is the sort key."""
    counts = _counts(index)
    by_doc, by_tag = counts.where("by_tag = 0"), counts.where("by_tag = 1")
    docs = F.count("*") - F.when(F.max(F.col("doc").isNull()) & F.max(F.coalesce(F.col("doc") == "unknown", F.lit(False))), 1).otherwise(0)
    tot = by_doc.agg(docs.alias("total_docs"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("total_chunks")).select(
        F.lit(0).alias("part"), F.lit("").alias("sort_key"),
        F.concat_ws("\n", F.lit(MD_STATS_TITLE), F.lit(""), F.format_string(MD_DOCS, F.coalesce("total_docs", F.lit(0))),
                    F.format_string(MD_CHUNKS, "total_chunks"), F.lit(""), F.lit(MD_BY_TAG)).alias("line"))
    label = F.when(F.col("own_tag") == tx.UNTAGGED, F.lit(MD_UNTAGGED)).otherwise(F.col("own_tag"))
    tags = by_tag.select(F.lit(1).alias("part"), F.col("own_tag").alias("sort_key"),
                         F.format_string(MD_TAG_LINE, label, F.col("pairs") - F.col("twice").cast("int"), "chunks").alias("line"))
    rec = by_doc.select(F.coalesce("doc", F.lit("unknown")).alias("doc_id"), F.col("tag_of_first").alias("tag"), "chunks", "head.ingested_at")
    rec = rec.orderBy(F.col("ingested_at").desc(), F.col("doc_id").asc()).limit(n_recent)  # a window over them is bounded
    tag_str = F.when(F.col("tag") == tx.UNTAGGED, F.lit(f"[{MD_UNTAGGED}]")).otherwise(F.concat(F.lit("["), "tag", F.lit("]")))
    seq = F.row_number().over(Window.orderBy(F.col("ingested_at").desc(), F.col("doc_id").asc()))
    rec_lines = rec.select(
        F.lit(2).alias("part"), F.lpad(seq.cast("string"), 6, "0").alias("sort_key"),
        F.format_string(MD_RECENT_LINE, tag_str, "doc_id", "chunks", "ingested_at").alias("line"))
    rec_head = rec.limit(1).select(F.lit(2).alias("part"), F.lit("000000").alias("sort_key"),
                                   F.concat(F.lit("\n"), F.lit(MD_RECENT)).alias("line"))
    return tot.unionByName(tags).unionByName(rec_head).unionByName(rec_lines)


# --------------------------------------------------------------------------
# Stored sketches: distinct counts that are united, not counted again
# --------------------------------------------------------------------------
SKETCH_LOG = 14
SKETCH_BOUND = 3 * 1.04 / 2 ** (SKETCH_LOG / 2)
"""Relative error of a united sketch: three standard errors of HyperLogLog."""


def _sketches(rows: DataFrame) -> DataFrame:
    """A row for each bucket: rows, and sketches of its documents, sources and first tags."""
    sk = lambda c: F.hll_sketch_agg(c, SKETCH_LOG)
    return rows.groupBy("bucket").agg(
        F.count("*").alias("rows"), sk(F.coalesce(F.col("doc_id"), F.lit("unknown"))).alias("docs"),
        sk(F.coalesce(F.col("source"), F.lit(""))).alias("sources"), sk(tx.first_tag("tags")).alias("tags"))


def refresh_sketches(spark: SparkSession, base: str) -> DataFrame:
    """Sketches of every bucket of the stored index (``bucket, sign, rows, docs, sources, tags``).

    They are kept beside the index. Buckets whose parts are those of the last
    time are taken from there; only the others are read.
    """
    m = ix.current_manifest(spark, base)
    ddl = "bucket int, sign string, rows long, docs binary, sources binary, tags binary"
    if m is None or not m.parts:
        return spark.createDataFrame([], ddl)
    now = {b: hashlib.md5("\n".join(map(str, own)).encode()).hexdigest() for b, own in m.parts.items()}
    sign = spark.createDataFrame(sorted(now.items()), "bucket int, sign string")  # one row a bucket
    path, last = os.path.join(base, "_sketches"), None
    root, fs = ix._fs(spark, path)
    if fs.exists(root):
        done = [st.getPath().getName() for st in fs.listStatus(root) if fs.exists(ix._fs(spark, st.getPath().toString() + "/_SUCCESS")[0])]
        last = max(done, default=None)
    kept = spark.read.schema(ddl).parquet(os.path.join(path, last)).join(F.broadcast(sign), ["bucket", "sign"], "left_semi") if last else None
    held = {r.bucket for r in kept.select("bucket").collect()} if last else set()
    todo = {b: own for b, own in m.parts.items() if b not in held}
    if not todo:
        return kept
    new = _sketches(ix._living(spark, todo, m.buckets)).join(F.broadcast(sign), "bucket").select(*[c.split()[0] for c in ddl.split(", ")])
    out = os.path.join(path, ix._new_version())
    (kept.unionByName(new) if last else new).coalesce(max(1, len(now) // 256)).write.parquet(out)
    return spark.read.schema(ddl).parquet(out)


def sketched_totals(sketches: DataFrame) -> DataFrame:
    """Total chunks (exact) and distinct documents, sources and tags within ``SKETCH_BOUND``."""
    n = lambda c: F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0))
    return sketches.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total_chunks"), n("docs").alias("total_docs"), n("sources").alias("total_sources"), n("tags").alias("total_tags"))
