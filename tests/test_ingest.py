"""Ingest: one row per id, summaries, context hooks, storage safety, HTML text."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import visible_text
from tessera.operators import index as ix
from tessera.operators.knn import knn_topk
from tessera.plans.ingest import build_index_rows, ingest, one_row_per_id
from tessera.schema import IndexSpec

SPEC = IndexSpec(dim=8)
SCHEMA = "doc_id string, text string, path string, file_type string, source string"


def corpus(spark, *rows):
    return spark.createDataFrame([(i, t, p, "txt", "s") for i, t, p in rows], SCHEMA)


def statuses(df):
    return {r.status: r.docs for r in df.collect()}


def test_last_path_wins_and_a_second_sync_changes_nothing(spark, tmpdir_path):
    docs = corpus(spark, ("a", "old text", "x/1"), ("a", "new text", "x/2"), ("a", "new text", "x/2"), ("b", "!!!", "x/3"))
    assert {(r.doc_id, r.text) for r in one_row_per_id(docs).collect()} == {("a", "new text"), ("b", "!!!")}
    base = tmpdir_path + "/kb"
    assert statuses(ingest(spark, docs, base, SPEC, sync=True)) == {"new": 2}
    assert sorted(r.key for r in ix.read_index(spark, base).collect()) == ["a.chunk-0000", "b.chunk-0000"]
    version = ix.current_version(spark, base)
    assert statuses(ingest(spark, docs, base, SPEC, sync=True)) == {"unchanged": 2}
    assert ix.current_version(spark, base) == version


def test_summary_tells_what_was_done(spark, tmpdir_path):
    base = tmpdir_path + "/kb"
    ingest(spark, corpus(spark, ("a", "one", "1"), ("b", "two", "2"), ("c", "three", "3")), base, SPEC, sync=True)
    assert statuses(ingest(spark, corpus(spark, ("d", "four", "4")), base, SPEC, sync=False)) == {"new": 1}
    assert ix.read_index(spark, base).count() == 4
    scope = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    got = statuses(ingest(spark, corpus(spark, ("b", "two", "2")), base, SPEC, sync=True, scope=scope))
    assert got == {"unchanged": 1, "removed": 1}
    assert sorted(r.doc_id for r in ix.read_index(spark, base).collect()) == ["b", "c", "d"]


def test_context_hook_gets_documents_and_may_fail(spark):
    docs = corpus(spark, ("a", "First sentence. Rest of it.", "1"), ("b", "Other text here.", "2"))

    def prefixes(chunks, documents):
        j = chunks.join(documents.withColumnRenamed("text", "whole"), "doc_id").where("doc_id = 'a'")
        return j.select("doc_id", "chunk_index", F.length("whole").cast("string").alias("context_prefix"))

    rows = {r.doc_id: r for r in build_index_rows(docs, SPEC, contextual=True, context_fn=prefixes).collect()}
    assert rows["a"].context_prefix == "27" and rows["b"].context_prefix is None
    plain = build_index_rows(docs, SPEC, contextual=True)
    assert {r.doc_id: r.context_prefix for r in plain.collect()} == {"a": "First sentence.", "b": "Other text here."}


def test_two_writers_from_one_parent_both_stay(spark, tmpdir_path, monkeypatch):
    base = tmpdir_path + "/kb"
    rows = lambda *d: build_index_rows(corpus(spark, *d), SPEC).cache()
    none = spark.createDataFrame([], "doc_id string")
    ix.write_index(rows(("a", "one", "1")), base, buckets=2)
    second, write = rows(("c", "three", "3"), ("a", "one again", "1")), ix.stage_rows
    calls = []

    def racing(*args):
        out = write(*args)
        if not calls:  # another writer commits after this one has read and written
            calls.append(1)
            ix.apply_doc_changes(spark, base, rows(("b", "two", "2")), none)
        return out

    monkeypatch.setattr(ix, "stage_rows", racing)
    ix.apply_doc_changes(spark, base, second, none)
    assert sorted(r.doc_id for r in ix.read_index(spark, base).collect()) == ["a", "b", "c"]
    man = ix.read_manifest(spark, base)
    assert not ix._commit(spark, base, ix.current_manifest(spark, base).number, *man)


def test_vacuum_spares_a_write_in_progress(spark, tmpdir_path):
    base = tmpdir_path + "/kb"
    rows = build_index_rows(corpus(spark, ("a", "one", "1")), SPEC)
    ix.write_index(rows, base, buckets=2)
    dirs = ix.stage_rows(rows, base, 2).dirs  # written, not committed
    ix.write_index(rows, base, buckets=2)
    assert ix.vacuum_index(spark, base)
    assert all(spark.read.parquet(d).count() == 1 for d in dirs.values()) and ix.read_index(spark, base).count() == 1


def test_wrong_dimensions_fail(spark):
    index = spark.createDataFrame([("k", [1.0] * 8), ("l", [1.0] * 7)], "key string, vec array<float>")
    queries = spark.createDataFrame([(1, [1.0] * 8)], "query_id long, qvec array<float>")
    with pytest.raises(Exception, match="dimension must be 8, got 7"):
        knn_topk(index, queries, SPEC).collect()
    with pytest.raises(Exception, match="dimension must be 8, got 8|dimension must be 8, got 9"):
        knn_topk(index.where("key = 'k'"), spark.createDataFrame([(1, [1.0] * 9)], "query_id long, qvec array<float>"), SPEC).collect()


@pytest.mark.parametrize(
    "html,text",
    [
        ("<p>a &#8217; &euro; &mdash;</p><p>&nbsp;</p><pre>x\n  y</pre>", "a ’ € —\nx\n  y"),
        ("<nav><nav>a</nav>b</nav>c", "c"),
        ("<div><nav>a</div>b", "b"),
        ("a<br>b<br/>c<img src=x>d", "a\nb\nc\nd"),
        ("<script>if (a<b) {}</script><style>p{}</style>t", "t"),
        ("<!DOCTYPE html><!-- c -->a<!-- d -->b</p>", "a\nb"),
        ("x &unknown; 1 < 2", "x &unknown; 1 < 2"),
        ("", ""),
        (None, None),
    ],
)
def test_visible_text(html, text):
    assert visible_text(html) == text
