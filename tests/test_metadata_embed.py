"""Metadata byte budget (Q28) and embedder equivalence."""

import json

from pyspark.sql import functions as F

from tessera.operators import embed as em
from tessera.operators import metadata as md
from tests.conftest import SF01


def _rows(spark, content, source="s", heading=None, prefix=None):
    return spark.createDataFrame(
        [("d1", 0, 1, "h" * 32, "md", "2024-01-01T00:00:00Z", source, "t", None, heading, prefix, content)],
        "doc_id string, chunk_index int, total_chunks int, content_hash string, file_type string, ingested_at string, "
        "source string, tags string, author string, heading_path string, context_prefix string, content_full string",
    )


def test_metadata_fits_2048_bytes_with_cjk_and_emoji(spark):
    big = "中文😀\n\"x\\" * 3000
    df = _rows(spark, big, source="源" * 300, heading="标题" * 200, prefix="上下文" * 100)
    r = md.fit_metadata(df).collect()[0]
    assert r.meta_json_bytes <= 2048
    assert len(r.content) > 0


def test_metadata_fits_2048_bytes_with_control_characters(spark):
    odd = "\x01\x02" * 300
    r = md.fit_metadata(_rows(spark, odd * 10, source=odd, heading=odd, prefix=odd)).collect()[0]
    assert r.meta_json_bytes <= 2048


def test_json_byte_count_matches_python(spark):
    df = _rows(spark, "plain text\nwith \"quotes\"", source="src")
    r = md.fit_metadata(df).collect()[0]
    meta = {"doc_id": "d1", "chunk_index": "0", "total_chunks": "1", "content_hash": "h" * 32, "file_type": "md",
            "ingested_at": "2024-01-01T00:00:00Z", "source": "src", "tags": "t", "content": r.content}
    assert r.meta_json_bytes == len(json.dumps(meta, ensure_ascii=False).encode("utf-8"))


def test_udf_embedder_equals_native(spark):
    d = spark.read.parquet(f"{SF01}/documents.parquet").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    native = {r.doc_id: list(r.vec) for r in em.hash_embed(d, "doc_id", "text", 64).collect()}
    udf = {r.doc_id: list(r.vec) for r in d.select("doc_id", em.hash_embed_udf(64)("text").alias("vec")).collect()}
    assert native == udf


def test_embed_dedup_and_cache(spark):
    d = spark.read.parquet(f"{SF01}/documents.parquet").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    calls = []

    def embedder(texts):
        calls.append(texts)
        return em.hash_embed(texts, "text_md5", "text", 64)

    out = em.embed_dedup(d, "text", embedder)
    assert out.count() == d.count() and out.where("vec is null").count() == 0
    empty = spark.createDataFrame([], "text_md5 string, model string, dim int, vec array<float>")
    rows, new = em.embed_with_cache(d, "text", empty, embedder, "m", 64)
    assert new.count() == d.select(F.md5("text")).distinct().count()
    rows2, new2 = em.embed_with_cache(d, "text", new, embedder, "m", 64)
    assert new2.count() == 0 and rows2.where("vec is null").count() == 0


def test_fused_chunk_vectors_equal_udf(spark):
    from tessera.operators import chunking as ch

    d = spark.read.parquet(f"{SF01}/documents.parquet").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    fused = {(r.doc_id, r.chunk_index): list(r.vec) for r in ch.chunk_docs(d, hash_dim=64, embed_chars=8000).collect()}
    c = ch.chunk_docs(d)
    udf = {(r.doc_id, r.chunk_index): list(r.vec)
           for r in c.select("doc_id", "chunk_index", em.hash_embed_udf(64)(F.substring("content", 1, 8000)).alias("vec")).collect()}
    assert fused == udf


def test_cutting_rules_agree_with_the_plain_loop(spark):
    """Budgets from below nothing to more than enough; escapes, wide characters, empty and null texts."""
    texts = ["", "a", "ab\"\\\n" * 50, "中文😀" * 400, "\x01" * 90, "x" * 5000, None]
    budgets = [-5, 0, 1, 7, 100, 2000, 100_000]

    def plain(t, b):
        while t and len(json.dumps(t, ensure_ascii=False).encode()) - 2 > b:
            t = t[: len(t) * 3 // 4]
        return t

    df = spark.createDataFrame([(i * 100 + j, t, b) for i, t in enumerate(texts) for j, b in enumerate(budgets)], "i int, t string, b int")
    whole = spark.read.parquet(f"{SF01}/documents.parquet").select(F.col("doc_id").cast("int") + 1000, "text", F.lit(1500))
    df = df.union(whole)
    want = {r.i: plain(r.t, r.b) for r in df.collect()}
    cut = md.cut_to_bytes(F.col("t"), F.col("b"), measure=md.escaped_json_len)
    assert {r.i: r.c for r in df.select("i", cut.alias("c")).collect()} == want


def test_heading_counts_agree_with_the_chunker(spark):
    from tessera.operators import chunking as ch

    texts = ["", "# a", "#\ta\n##b\n### c d", "x\r# no\n # no\n#  yes", "#######", "# \n#  \n# é", "a # no", "#\x1cyes\n# yes\n#　", "# a\n" * 5, "#\x0b x", None]
    df = spark.createDataFrame([(str(i), t, "md" if i % 4 == 0 else None) for i, t in enumerate(texts)], "doc_id string, text string, file_type string")
    got = {r.doc_id: (r.n_headings, r.strategy) for r in ch.strategies(df).collect()}
    assert got == {str(i): (ch.count_headings(t), ch.choose_strategy(t, "md" if i % 4 == 0 else None)) for i, t in enumerate(texts) if t is not None}
