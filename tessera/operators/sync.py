"""Incremental sync as set-based joins.

``sync_plan`` compares the incoming corpus with the stored document hashes
*before* any chunking or embedding, so unchanged documents cost one hash and
one join row. ``sync_apply`` replaces changed documents in one write (old
rows of a changed document and its new rows never coexist, and a failure
leaves the previous version intact).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.index import doc_hashes

STATUSES = ("new", "changed", "unchanged", "removed")


def sync_plan(incoming: DataFrame, stored: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, status`` for the union of both sides, and the columns ``keep`` of the incoming.

    ``incoming`` has ``doc_id, content_hash``; ``stored`` is either a hash
    table (``doc_id, content_hash``) or the index itself (header rows are used).
    """
    if "chunk_index" in stored.columns:
        stored = doc_hashes(stored)
    i = incoming.select("doc_id", F.col("content_hash").alias("new_hash"), *keep)
    s = stored.select("doc_id", F.col("content_hash").alias("old_hash"))
    j = i.join(s, "doc_id", "full_outer")
    status = (
        F.when(F.col("old_hash").isNull(), "new")
        .when(F.col("new_hash").isNull(), "removed")
        .when(F.col("old_hash") == F.col("new_hash"), "unchanged")
        .otherwise("changed")
    )
    return j.select("doc_id", status.alias("status"), "new_hash", "old_hash", *keep)


def sync_removed(plan: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Stored documents missing from the incoming set.

    Q12 fix: with ``scope`` (doc ids the run is responsible for, e.g. one
    source), only documents inside it are removed.
    """
    r = plan.where(F.col("status") == "removed").select("doc_id")
    return r if scope is None else r.join(scope.select("doc_id").distinct(), "doc_id", "left_semi")


def ids_except(existing: DataFrame, processed: DataFrame) -> DataFrame:
    """Ids in ``existing`` and not in ``processed``."""
    return existing.select("doc_id").distinct().join(processed.select("doc_id"), "doc_id", "left_anti")


def to_ingest(corpus: DataFrame, plan: DataFrame) -> DataFrame:
    """Incoming documents that must be (re)chunked: new or changed."""
    todo = plan.where(F.col("status").isin("new", "changed")).select("doc_id")
    return corpus.join(todo, "doc_id", "left_semi")


def sync_apply(index: DataFrame, new_rows: DataFrame, plan: DataFrame, remove: bool = True,
               scope: DataFrame | None = None) -> DataFrame:
    """Resulting index = rows of documents that stay + rows of new/changed documents.

    Rows of changed documents and (when ``remove``) of removed documents are
    dropped with one anti join on ``doc_id``.
    """
    drop = plan.where(F.col("status") == "changed").select("doc_id")
    if remove:
        drop = drop.unionByName(sync_removed(plan, scope))
    kept = index.join(drop, "doc_id", "left_anti")
    return kept.unionByName(new_rows, allowMissingColumns=True)


def sync_summary(plan: DataFrame, index: DataFrame, new_rows: DataFrame) -> DataFrame:
    """A4/Q20: per status -- documents, stored chunks, chunks written.

    The reference's counters follow: ingested = docs of new+changed,
    skipped = docs of unchanged, deleted = stored chunks of removed,
    chunks_written = chunks written for new+changed.
    """
    old = index.groupBy("doc_id").agg(F.count("*").alias("stored_chunks"))
    new = new_rows.groupBy("doc_id").agg(F.count("*").alias("new_chunks"))
    j = plan.select("doc_id", "status").join(old, "doc_id", "left").join(new, "doc_id", "left")
    return j.groupBy("status").agg(
        F.count("*").alias("docs"),
        F.coalesce(F.sum("stored_chunks"), F.lit(0)).alias("stored_chunks"),
        F.coalesce(F.sum(F.when(F.col("status").isin("new", "changed"), F.col("new_chunks"))), F.lit(0)).alias("chunks_written"),
    )


def sync_counters(summary: DataFrame) -> DataFrame:
    """A4: the reference's one-line counters from ``sync_summary`` (at most four rows):
    ingested / skipped documents, deleted chunks (Q20: chunks, not documents),
    chunks written."""
    st = F.col("status")
    return summary.agg(
        F.coalesce(F.sum(F.when(st.isin("new", "changed"), F.col("docs"))), F.lit(0)).alias("ingested"),
        F.coalesce(F.sum(F.when(st == "unchanged", F.col("docs"))), F.lit(0)).alias("skipped"),
        F.coalesce(F.sum(F.when(st == "removed", F.col("stored_chunks"))), F.lit(0)).alias("deleted"),
        F.coalesce(F.sum(F.col("chunks_written")), F.lit(0)).alias("chunks_written"),
    )
