"""Sources (files written to a temp dir) and stream = batch."""

import json
import os

from pyspark.sql import functions as F

from tessera.operators import chunking as ch
from tessera.operators import index as ix
from tessera.sources import files as fs
from tessera.streaming import ingest as si
from tessera.schema import IndexSpec


def _write(d, rel, text):
    p = os.path.join(d, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)


def test_scan_corpus_globs_ids_html(spark, tmpdir_path):
    d = tmpdir_path
    _write(d, "a/b.md", "# Title\ntext")
    _write(d, "a-b.txt", "other")
    _write(d, "x/page.html", "<html><script>var x;</script><body><p>Hello &amp; bye</p></body></html>")
    _write(d, "skip.pdf", "binary")
    _write(d, "blank.txt", "  \n ")
    c = fs.scan_corpus(spark, d).collect()
    by = {r.doc_id: r for r in c}
    assert set(by) == {"a-b", "x-page"}  # a/b.md and a-b.txt collide; blank dropped; pdf skipped
    assert by["x-page"].text == "Hello & bye" and by["x-page"].file_type == "html"
    coll = fs.id_collisions(fs.scan_corpus(spark, d)).collect()
    assert len(coll) == 1 and coll[0].doc_id == "a-b"


def test_written_files_share_folders(spark, tmpdir_path):
    rows = [(f"n{i}.txt", f"text é {i}") for i in range(600)] + [("n7.txt", "text é 7"), ("null.txt", None), ("page.html", "<p>Hello &amp; bye</p>")]
    d = os.path.join(tmpdir_path, "files")
    fs.write_files(spark.createDataFrame(rows, "name string, text string").repartition(5), d)
    assert 1 < len(os.listdir(d)) <= fs.FOLDERS  # not one for each file
    c = {os.path.basename(r.path): r.text for r in fs.scan_corpus(spark, d).collect()}
    assert c == {f"n{i}.txt": f"text é {i}\n" * (2 if i == 7 else 1) for i in range(600)} | {"page.html": "Hello & bye"}
    none = os.path.join(tmpdir_path, "none")
    fs.write_files(spark.createDataFrame([], "name string, text string"), none)
    assert fs.scan_corpus(spark, none).count() == 0


def test_doc_id_rules(spark):
    df = spark.createDataFrame([("/base/中文/x y.md",), ("/base/--.txt",), ("/other/a.b.c.htm",)], "p string")
    from tessera.functions.text import doc_id_from_path, file_type

    r = df.select(doc_id_from_path("p", "/base/").alias("id"), file_type("p").alias("ft")).collect()
    assert r[0].id == "中文-x-y" and r[0].ft == "md"
    assert len(r[1].id) == 16  # empty name -> md5 prefix
    assert r[2].id == "a-b-c" and r[2].ft == "html"


def test_vector_and_query_json(spark, tmpdir_path):
    recs = [{"key": "doc-001", "data": {"float32": [0.1, 0.2, 0.3]}, "metadata": {"title": "A", "category": "AI"}},
            {"key": "doc-002", "data": {"float32": [0.3, 0.2, 0.1]}, "metadata": {"category": "ML", "doc_id": "d2"}}]
    p = os.path.join(tmpdir_path, "v.json")
    with open(p, "w") as f:
        json.dump(recs, f)
    v = fs.read_vector_records(spark, p).collect()
    assert {r.key for r in v} == {"doc-001", "doc-002"}
    assert [r for r in v if r.key == "doc-001"][0].extra == {"title": "A", "category": "AI"}
    q = os.path.join(tmpdir_path, "q.json")
    with open(q, "w") as f:
        json.dump([0.1, 0.2, 0.3], f)
    qs = fs.read_query_vectors(spark, q).collect()
    assert len(qs) == 1 and len(qs[0].qvec) == 3


def test_tag_catalog_missing_file_is_empty(spark, tmpdir_path):
    assert fs.read_tag_catalog(spark, os.path.join(tmpdir_path, "none.json")).count() == 0


def test_stream_equals_batch(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for i in range(3):  # three files arrive
        docs.where(F.col("doc_id") % 3 == i).write.parquet(os.path.join(src, f"part{i}"))
    base = os.path.join(tmpdir_path, "index")
    stream = spark.readStream.schema(docs.schema).option("recursiveFileLookup", True).option(
        "maxFilesPerTrigger", 1).parquet(src)
    to_corpus = lambda b: b.select(F.col("doc_id").cast("string").alias("doc_id"), "text",
                                   F.lit("txt").alias("file_type"))
    q = si.stream_ingest(spark, stream, base, IndexSpec(dim=64), checkpoint=os.path.join(tmpdir_path, "ck"),
                         to_corpus=to_corpus)
    q.awaitTermination()
    got = sorted((r.doc_id, r.chunk_index) for r in ix.read_index(spark, base).select("doc_id", "chunk_index").collect())
    batch = ch.chunk_docs(to_corpus(docs)).select("doc_id", "chunk_index").collect()
    assert got == sorted((r.doc_id, r.chunk_index) for r in batch)


def test_bad_vector_json_fails_and_missing_catalog_is_empty(spark, tmpdir_path):
    import pytest

    from tessera.sources import files as fs

    for bad in ("not json", '{"key": 1}', "[1, 2", None):
        one = spark.createDataFrame([(bad,)], "value string")
        with pytest.raises(Exception):
            fs.parse_vector_records(one).collect()
        with pytest.raises(Exception):
            fs.parse_query_vectors(one).collect()
    assert fs.read_tag_catalog(spark, tmpdir_path + "/none.json").count() == 0
    (lambda p: open(p, "w").write("{broken"))(tmpdir_path + "/bad.json")
    with pytest.raises(Exception):
        fs.read_tag_catalog(spark, tmpdir_path + "/bad.json").collect()


def test_single_file_with_explicit_id(spark, tmpdir_path):
    import pytest

    from tessera.sources import files as fs

    for n in ("a.md", "b.md"):
        with open(f"{tmpdir_path}/{n}", "w") as f:
            f.write("# T " + n)
    got = fs.read_file(spark, f"{tmpdir_path}/a.md", doc_id="mine").collect()
    assert [(r.doc_id, r.text, r.file_type) for r in got] == [("mine", "# T a.md", "md")]
    for path in (tmpdir_path, f"{tmpdir_path}/*.md", f"{tmpdir_path}/none.md"):
        with pytest.raises(ValueError):
            fs.read_file(spark, path, doc_id="mine")


def test_a_stream_of_documents_reads_folders_and_single_files(spark, tmpdir_path):
    from tessera.plans.stream_queries import q_stream_dedup, q_stream_ingest_docs

    rows = [(i, f"text {i % 4}.", "en", "s", 7) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.repartition(3).write.parquet(f"{tmpdir_path}/folder/documents.parquet")
    docs.coalesce(1).write.parquet(f"{tmpdir_path}/one")
    os.makedirs(f"{tmpdir_path}/file")
    part = next(f for f in os.listdir(f"{tmpdir_path}/one") if f.endswith(".parquet"))
    with open(f"{tmpdir_path}/one/{part}", "rb") as a, open(f"{tmpdir_path}/file/documents.parquet", "wb") as b:
        b.write(a.read())
    for kind in ("folder", "file"):
        assert q_stream_dedup(spark, f"{tmpdir_path}/{kind}").count() == 4
        assert q_stream_ingest_docs(spark, f"{tmpdir_path}/{kind}").count() == 9
    docs.where("false").write.parquet(f"{tmpdir_path}/none/documents.parquet")
    assert q_stream_dedup(spark, f"{tmpdir_path}/none").count() == 0
