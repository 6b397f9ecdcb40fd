"""End-to-end ingest (E1): corpus -> chunks -> embeddings -> index rows,
plus incremental application to a stored index.

Plan shape: the corpus is first read for ids and hashes only: of rows with one
id the winner is chosen, and it is compared with the stored hashes. Then the
texts of new and changed documents are fetched where the corpus is read, by a
semi-join with their keys, which are broadcast in waves of a measured size:
unchanged texts are never shuffled and never reach the chunker. Chunking is
narrow; an external embedder sees each distinct text once.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import chunking as ch
from tessera.operators import embed as em
from tessera.operators import index as ix
from tessera.operators import metadata as md
from tessera.operators import sync as sy
from tessera.session import checkpoint_dir, materialize, rows_of, spread
from tessera.schema import DEFAULT_CHUNK_OVERLAP, DEFAULT_CHUNK_SIZE, DEFAULT_MIN_CHUNK, EMBED_INPUT_MAX_CHARS, IndexSpec

# first sentence of a document: up to the first sentence end followed by white space or the end
_FIRST_SENTENCE = r"(?s)^\s*(.+?[.!?。])(\s|$)"


def first_sentence(text) -> F.Column:
    """The first sentence of a document, at most 200 characters."""
    return F.substring(F.regexp_extract(text, _FIRST_SENTENCE, 1), 1, 200)


def extractive_prefix(sentence, heading_path) -> F.Column:
    """H2 default: heading path and the document's first sentence (no model call)."""
    return F.concat_ws(" — ", F.nullif(heading_path, F.lit("")), F.nullif(sentence, F.lit("")))


def _named(corpus: DataFrame) -> list[str]:
    """What tells rows of one id apart besides their text."""
    return [c for c in ("path", "source") if c in corpus.columns]


def choose_rows(corpus: DataFrame) -> DataFrame:
    """Q10: which row of an id is stored, by hashes alone: the last write wins,
    that of the greatest path, then source, then content hash.

    Returns ``doc_id``, these columns and ``copies`` (rows that are equal in
    them). No text leaves the task that reads it.
    """
    named = _named(corpus)
    rows = corpus.select("doc_id", *named, tx.content_hash("text").alias("content_hash"))
    own = [*named, "content_hash"]
    same = rows.groupBy("doc_id", *own).agg(F.count("*").alias("copies"))
    last = same.groupBy("doc_id").agg(F.max_by(F.struct(*own, "copies"), F.struct(*own)).alias("_r"))
    return last.select("doc_id", *[F.col("_r")[c].alias(c) for c in (*own, "copies")])


def _at(corpus: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of the corpus that these keys name."""
    rows = corpus.withColumn("content_hash", tx.content_hash("text"))
    return rows_of(rows, keys, ["doc_id", *_named(corpus), "content_hash"]).select(*corpus.columns)


def fetch_rows(corpus: DataFrame, chosen: DataFrame) -> DataFrame:
    """The corpus rows that ``chosen`` (a written table as ``choose_rows`` returns it) names, one of each id."""
    out = _at(corpus, chosen.where(F.col("copies") == 1))
    twice = chosen.where(F.col("copies") > 1)
    if twice.limit(1).count():  # rows that are equal up to columns of no weight: any, but always the same
        others = [c for c in corpus.columns if c != "doc_id"]
        last = _at(corpus, twice).groupBy("doc_id").agg(F.max_by(F.struct(*others), F.xxhash64(*others)).alias("_r"))
        out = out.unionByName(last.select(*[F.col("doc_id") if c == "doc_id" else F.col("_r")[c].alias(c) for c in corpus.columns]))
    return out


def one_row_per_id(corpus: DataFrame) -> DataFrame:
    """Q10: the rows that are stored, one of each id."""
    return fetch_rows(corpus, materialize(choose_rows(corpus), "ids"))


def per_chunk(call: Callable[[str, str], str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """H2: a ``context_fn`` from ``call(document, chunk) -> prefix``.

    A document meets its chunks in one task. A call that raises gives that
    chunk alone an empty prefix, and ``failed`` says what it raised.
    """

    def run(chunks: DataFrame, documents: DataFrame) -> DataFrame:
        kind = documents.schema["doc_id"].dataType.simpleString()

        def of(docs: pa.Table, own: pa.Table) -> pa.Table:
            text = docs.column("text")[0].as_py() if docs.num_rows else None
            prefix, failed = [], []
            for chunk in own.column("content").to_pylist():
                try:
                    prefix.append(call(text or "", chunk))
                    failed.append(None)
                except Exception as e:  # noqa: BLE001 whatever a model's client raises
                    prefix.append("")
                    failed.append(f"{type(e).__name__}: {e}"[:200])
            return pa.table({"doc_id": own.column("doc_id"), "chunk_index": own.column("chunk_index"), "context_prefix": pa.array(prefix, pa.string()), "failed": pa.array(failed, pa.string())})

        asked = chunks.select("doc_id", "chunk_index", "content").groupBy("doc_id")
        return documents.select("doc_id", "text").groupBy("doc_id").cogroup(asked).applyInArrow(of, f"doc_id {kind}, chunk_index int, context_prefix string, failed string")

    return run


def build_index_rows(
    corpus: DataFrame,
    spec: IndexSpec,
    embedder: Callable[[DataFrame], DataFrame] | None = None,
    strategy: str = "auto",
    size: int = DEFAULT_CHUNK_SIZE,
    overlap: int = DEFAULT_CHUNK_OVERLAP,
    min_chunk: int = DEFAULT_MIN_CHUNK,
    contextual: bool = False,
    context_fn: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    ingested_at: _dt.datetime | None = None,
    parallelism: int | None = None,
) -> DataFrame:
    """Corpus rows (``doc_id, text, file_type, source, tags, author``) -> index rows.

    ``context_fn(chunks, documents) -> (doc_id, chunk_index, context_prefix)``
    writes the prefixes (H2): it gets the chunks and the documents' texts as
    tables to join on doc_id. A chunk for which it gives no row or null is
    indexed with an empty prefix; ``per_chunk`` makes one of a plain function
    whose failures do the same. Without it the prefix
    is the heading path and the document's first sentence, which is all of the
    document that travels with its chunks. ``parallelism`` deals documents
    over so many tasks, for corpora of fewer splits than cores.
    """
    checkpoint_dir(corpus.sparkSession)  # the shared folder named by spark.checkpoint.dir
    corpus = spread(corpus, parallelism)
    cols = corpus.columns
    keep = [c for c in ("source", "tags", "author") if c in cols]
    docs = corpus.withColumn("content_hash", tx.content_hash("text"))
    docs = docs.withColumn("_ft", F.col("file_type") if "file_type" in cols else F.lit(None).cast("string"))
    lead = contextual and context_fn is None
    if lead:
        docs = docs.withColumn("_lead", first_sentence(F.col("text")))
    # built-in embedder on the plain chunk text: computed inside the chunking task
    fused = embedder is None and not contextual
    chunks = ch.chunk_docs(docs, strategy=strategy, size=size, overlap=overlap, min_chunk=min_chunk,
                           keep=keep + ["content_hash", "_ft"] + (["_lead"] if lead else []),
                           hash_dim=spec.dim if fused else None, embed_chars=EMBED_INPUT_MAX_CHARS)
    if contextual:
        if context_fn is not None:
            chunks = materialize(chunks, "chunks")
            prefixes = context_fn(chunks, docs.select("doc_id", "text")).select("doc_id", "chunk_index", "context_prefix")
            chunks = chunks.join(prefixes, ["doc_id", "chunk_index"], "left").withColumn("context_prefix", F.coalesce("context_prefix", F.lit("")))
        else:
            chunks = chunks.withColumn("context_prefix", extractive_prefix(F.col("_lead"), F.col("heading_path"))).drop("_lead")
    if "context_prefix" not in chunks.columns:
        chunks = chunks.withColumn("context_prefix", F.lit(None).cast("string"))
    chunks = chunks.withColumn("embed_input", tx.embed_input("content", "context_prefix"))
    if fused:
        vec = chunks
    elif embedder is None:
        # built-in embedder: narrow, on the row itself (no de-dup shuffle needed)
        vec = chunks.withColumn("vec", em.hash_embed_udf(spec.dim)(tx.embed_cut(F.col("embed_input"))))
    else:
        # external model: embed each distinct text once (J8); the chunks are
        # used twice (distinct texts, join back), so materialise them once
        vec = em.embed_dedup(materialize(chunks, "chunks"), "embed_input", embedder)
    ts = F.lit(ingested_at).cast("timestamp") if ingested_at else F.date_trunc("second", F.current_timestamp())
    rows = vec.withColumn("ingested_at", ts).withColumn("content_full", F.col("content")).withColumnRenamed("_ft", "file_type")
    rows = md.fit_metadata(rows)
    out = rows.select(
        tx.vector_key("doc_id", "chunk_index").alias("key"), "vec", "doc_id", "chunk_index", "total_chunks",
        "content_hash", "file_type", "ingested_at", *[c for c in ("source", "tags", "author") if c in rows.columns],
        F.nullif("heading_path", F.lit("")).alias("heading_path"),
        F.nullif("context_prefix", F.lit("")).alias("context_prefix"), "content",
        F.col("content_full").alias("chunk_text"),
    )
    return ix.assert_dims(ix.conform(out), spec)


def apply_plan(spark: SparkSession, corpus: DataFrame, base: str, spec: IndexSpec, plan: DataFrame, removed: bool, **kw) -> tuple[DataFrame, DataFrame]:
    """Fetch, chunk and embed what the plan calls new or changed, and store it;
    the written plan and the stored rows. ``removed``: stored documents of that status go."""
    plan = materialize(plan, "sync-plan")  # one comparison, reused by the rows, the write and the summary
    todo = plan.where(F.col("status").isin("new", "changed")).select("doc_id", F.col("new_hash").alias("content_hash"), *_named(corpus), "copies")
    buckets, texts = ix.buckets_of(spark, base), fetch_rows(corpus, todo)
    in_place = kw.get("embedder") is None and kw.get("context_fn") is None
    if in_place:  # texts are dealt by bucket, so the rows made of them (twice as long, with vectors) need not be
        texts = ix.dealt_by_bucket(texts, buckets)
    rows = ix.stage_rows(build_index_rows(texts, spec, **kw), base, buckets, dealt=in_place)  # chunk + embed once
    drop = plan.where(F.col("status") == "changed").select("doc_id")
    ix.apply_doc_changes(spark, base, rows, drop.unionByName(sy.sync_removed(plan)) if removed else drop)
    return plan, rows.read(spark)


def ingest(
    spark: SparkSession,
    corpus: DataFrame,
    base: str,
    spec: IndexSpec,
    sync: bool = False,
    scope: DataFrame | None = None,
    compact_parts: int | None = 16,
    **kw,
) -> DataFrame:
    """Ingest ``corpus`` into the versioned index at ``base``; return the per-status summary.

    Without ``sync`` every document of the corpus replaces its stored rows
    (Q11 fix: no stale higher-numbered chunks). With ``sync`` unchanged
    documents are skipped and stored documents missing from the corpus are
    removed (within ``scope`` when given, Q12 fix). Only the documents that
    change are written; a bucket of ``compact_parts`` parts is made one again.
    """
    checkpoint_dir(spark)
    stored = ix.read_index(spark, base)
    plan = sy.sync_plan(choose_rows(corpus), stored, keep=(*_named(corpus), "copies"))
    if not sync:  # nothing is removed, and what is there already is written again
        plan = plan.where(F.col("status") != "removed")
        plan = plan.withColumn("status", F.when(F.col("status") == "unchanged", "changed").otherwise(F.col("status")))
    elif scope is not None:  # stored documents outside the scope are none of this run's business
        inside = scope.select("doc_id").distinct().withColumn("_in", F.lit(True))
        plan = plan.join(inside, "doc_id", "left").where((F.col("status") != "removed") | F.col("_in")).drop("_in")
    plan, rows = apply_plan(spark, corpus, base, spec, plan, removed=sync, **kw)
    if compact_parts:
        ix.compact_index(spark, base, min_parts=compact_parts)
    # lazy: reads only the materialised plan and rows and the replaced
    # version's files, which are immutable, so it is valid after the write
    return sy.sync_summary(plan, stored, rows)
