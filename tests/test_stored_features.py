"""Listings, sketches, caches, heavy texts, keyword tables, reports in one scan, coded search, ingest by hashes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import embed as em
from tessera.operators import index as ix
from tessera.operators import listing as ls
from tessera.operators import pq
from tessera.operators import stats as st
from tessera.operators import tags as tg
from tessera.operators.knn import knn_topk
from tessera.plans import ingest as ing
from tessera.schema import IndexSpec
from tessera.session import materialize
from tests.test_knn import _exchanges, _files_read

LINE = "key string, doc_id string, chunk_index int, source string, tags string, ingested_at timestamp"


def keys(spark, n):
    return spark.range(n).select(F.format_string("k%06d", (F.col("id") * 7919) % n).alias("key"), F.col("id").alias("v"))


def test_pages_open_only_their_files(spark, tmpdir_path):
    ls.save_listing(keys(spark, 1000), tmpdir_path + "/l", part_rows=100)
    listing = ls.open_listing(spark, tmpdir_path + "/l")
    assert 8 <= listing.ranges.count() <= 12
    got, token, files = [], None, []
    while True:
        page, token = ls.list_page(listing, 130, token)
        got.append([r.key for r in page.collect()])
        files.append(_files_read(page))
        if token is None:
            break
    assert [len(p) for p in got] == [130] * 7 + [90] and sum(got, []) == [f"k{i:06d}" for i in range(1000)]
    assert page.columns == ["key", "v"] and max(files) <= 4
    assert "PartitionFilters: [part" in ls.list_page(listing, 10)[0]._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        ls.list_page(listing, 0)


def test_segments_are_runs_of_files(spark, tmpdir_path):
    ls.save_listing(keys(spark, 1000), tmpdir_path + "/l", part_rows=100)
    listing = ls.open_listing(spark, tmpdir_path + "/l")
    parts = [ls.list_segment(listing, 3, i) for i in range(3)]
    found = [sorted(r.key for r in p.collect()) for p in parts]
    assert sum(found, []) == [f"k{i:06d}" for i in range(1000)]
    assert all(_files_read(p) <= 5 for p in parts)
    assert sum(ls.list_segment(listing, 40, i).count() for i in range(40)) == 1000  # more segments than files
    for n, i in ((None, 1), (2, None), (2, 2)):
        with pytest.raises(ValueError):
            ls.list_segment(listing, n, i)


def test_a_listing_of_nothing(spark, tmpdir_path):
    ls.save_listing(keys(spark, 1).where("false"), tmpdir_path + "/l")
    listing = ls.open_listing(spark, tmpdir_path + "/l")
    page, token = ls.list_page(listing, 5)
    assert page.collect() == [] and token is None and ls.all_pages(listing, 5).collect() == []


def test_only_changed_buckets_are_sketched_again(spark, tmpdir_path, monkeypatch):
    base = tmpdir_path + "/index"
    rows = spark.range(3000).select(F.concat("id", F.lit(".c")).alias("key"), F.col("id").cast("string").alias("doc_id"), F.lit(0).alias("chunk_index"),
                                    F.concat(F.lit("s"), (F.col("id") % 50).cast("string")).alias("source"), F.lit("x,y").alias("tags"))
    ix.write_index(rows, base, buckets=16)
    read = []
    real = ix._living
    monkeypatch.setattr(ix, "_living", lambda s, parts, b: read.append(sorted(parts)) or real(s, parts, b))
    first = st.sketched_totals(st.refresh_sketches(spark, base)).first()
    assert first.total_chunks == 3000 and abs(first.total_docs - 3000) <= 3000 * st.SKETCH_BOUND and first.total_sources == 50 and first.total_tags == 1
    assert read == [list(range(16))]
    assert st.sketched_totals(st.refresh_sketches(spark, base)).first() == first and len(read) == 1
    ix.apply_doc_changes(spark, base, rows.where("false"), spark.createDataFrame([("7",)], "doc_id string"))
    read.clear()
    assert st.sketched_totals(st.refresh_sketches(spark, base)).first().total_chunks == 2999
    assert len(read[-1]) == 1


def test_a_cache_embeds_what_it_does_not_hold(spark, tmpdir_path):
    seen = []

    def embedder(texts):
        seen.append(sorted(r.text for r in texts.collect()))
        return texts.select("text_md5", F.array(F.length("text").cast("float"), F.lit(1.0).cast("float")).alias("vec"))

    def run(*texts, model="m"):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
        rows, n = em.embed_cached(df, "text", em.EmbeddingCache(spark, tmpdir_path + "/c", buckets=4), embedder, model, 2)
        return {r.id: r.vec and r.vec[0] for r in rows.collect()}, n

    assert run("a", "bb", "a", None) == ({0: 1.0, 1: 2.0, 2: 1.0, 3: None}, 2)
    assert run("bb", "ccc") == ({0: 2.0, 1: 3.0}, 1)
    assert run("ccc", "a") == ({0: 3.0, 1: 1.0}, 0)
    assert run("a", model="other") == ({0: 1.0}, 1)
    assert seen == [["a", "bb"], ["ccc"], ["a"]]
    cached = em.EmbeddingCache(spark, tmpdir_path + "/c", buckets=4).read("m", 2)
    assert _exchanges(cached) == []  # bucketed by hash: merging does not shuffle it


def test_a_text_of_a_third_of_the_rows_is_not_gathered(spark):
    df = spark.range(12_000).repartition(8).select("id", F.when(F.col("id") % 3 == 0, F.lit("the same")).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    df = materialize(df, "heavy")
    embedder = lambda t: t.select("text_md5", F.array(F.length("text").cast("float")).alias("vec"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = em.embed_dedup(df, "text", embedder)
        per = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert out.count() == 12_000 and out.where("vec is null").count() == 0
        assert out.where("text = 'the same' and vec[0] = 8").count() == 4000
        assert max(per) <= 2 * sorted(per)[len(per) // 2]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("size", [1 << 20, 40])
def test_keyword_tables_equal_plain_search(spark, size):
    r = random.Random(4)
    words = ["".join(r.choice("abÄé家x ") for _ in range(r.randrange(1, 5))) for _ in range(120)]
    texts = [None, "", *("".join(r.choice("abÄéÉ家xX ") for _ in range(r.randrange(80))) for _ in range(60))]
    catalog = [(f"t{i % 5}", words[i::7] + [None, ""]) for i in range(7)] + [("none", None), ("empty", [])]
    cat = spark.createDataFrame(catalog, "name string, keywords array<string>")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {(x.doc_id, x.tag): x.hits for x in tg.keyword_matches(docs, cat, slice_bytes=size).collect()}
    want = {}
    for i, t in enumerate(texts):
        for tag in {n for n, _ in catalog}:
            own = {w.lower() for n, ws in catalog if n == tag for w in ws or [] if w}
            if n := sum(w in (t or "").lower() for w in own):
                want[(i, tag)] = n
    assert got == want


def test_keywords_that_are_words_take_no_pass_over_the_texts_each(spark, monkeypatch):
    passes = []
    slices = tg._slice_hits
    monkeypatch.setattr(tg, "_slice_hits", lambda *a: passes.append(1) or slices(*a))
    run = "".join(chr(97 + i * i % 26) for i in range(1000))
    texts = ["Ab abc été ΑΒΓ x9y", run, run + "é", None, "", "one abc", "one abc"]
    keys = ["abc", "b", "été", "αβγ", "9", run[150:214], run[180:230], run[-1], "zzzzzz", run[:65]]
    docs = spark.createDataFrame([(0, texts[0]), (0, texts[1])] + [(i, t) for i, t in enumerate(texts[2:], 2)], "doc_id int, text string")
    cat = spark.createDataFrame([("a", keys[:5]), ("b", keys[5:]), (None, ["b"])], "name string, keywords array<string>")
    for more, n in (([], 1), (["one a", " été α"], 4)):
        tab = cat.unionByName(spark.createDataFrame([("c", more)], cat.schema))
        got = sorted(map(str, ((r.doc_id, r.tag, r.hits) for r in tg.keyword_matches(docs, tab, slice_bytes=20).collect())))
        lists = [("a", keys[:5]), ("b", keys[5:]), (None, ["b"]), ("c", more)]
        low = [(i if i > 1 else 0, (t or "").lower()) for i, t in enumerate(texts)]
        want = [(i, tag, sum(k in t for k in ks)) for i, t in low for tag, ks in lists]
        assert got == sorted(str(w) for w in want if w[2])
        assert len(passes) >= n  # the keyword of 65 characters and the phrases alone
        passes.clear()
    tg.keyword_matches(docs, spark.createDataFrame([("a", [f"w{i}" for i in range(500)])], cat.schema), slice_bytes=20).collect()
    assert not passes  # 500 words: one pass, where slices of 20 bytes were a hundred


def test_the_report_scans_once_and_counts_documents_without_id(spark, tmpdir_path):
    rows = [("k1", "a", 0, "s1", "x", "2024-01-02"), ("k2", "a", 1, "s2", "y", "2024-01-03"), ("k3", None, 0, "s3", "x", "2024-01-01"), ("k4", "unknown", 0, None, None, "2024-01-05"), ("k5", "b", 3, "s5", "x", "2024-01-04")]
    spark.createDataFrame([(*r[:5], None) for r in rows], LINE).withColumn("ingested_at", F.lit("2024-01-02").cast("timestamp")).write.parquet(tmpdir_path + "/i")
    index = spark.read.parquet(tmpdir_path + "/i")
    got = {(r.part, r.sort_key): r.line for r in st.stats_report(index, 10).collect()}
    assert f"{st.MD_DOCS % 3}" in got[(0, "")] and st.MD_CHUNKS % 5 in got[(0, "")]
    assert got[(1, "x")] == st.MD_TAG_LINE % ("x", 3, 3) and got[(1, "y")] == st.MD_TAG_LINE % ("y", 1, 1) and got[(1, "untagged")] == st.MD_TAG_LINE % (st.MD_UNTAGGED, 1, 1)
    assert len([k for k in got if k[0] == 2]) == 1 + 4
    empty = {(r.part, r.sort_key) for r in st.stats_report(index.where("false")).collect()}
    assert empty == {(0, "")}
    files = [f for f in st.stats_report(index).inputFiles() if tmpdir_path in f]
    assert files == []  # every part reads the counts that one scan has written


def test_codewords_are_trained_within_few_bytes():
    import tracemalloc

    x = np.random.default_rng(3).normal(size=(100_000, 4))
    tracemalloc.start()
    c = pq.lloyd(x, pq.WORDS, 1, iterations=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert c.shape == (pq.WORDS, 4) and peak < 64 << 20  # all distances at once are 205 MB
    d = ((x[:3000, None, :] - c[None]) ** 2).sum(2)
    own, near = pq._nearest(x[:3000], c)
    assert (own == d.argmin(1)).all() and np.allclose(near + (x[:3000] ** 2).sum(1), d.min(1))


def test_codes_find_what_is_near(spark, tmpdir_path):
    r = np.random.default_rng(2)
    centres = r.normal(size=(12, 16))
    v = np.concatenate([c + 0.3 * r.normal(size=(100, 16)) for c in centres]).astype(np.float32)
    index = spark.createDataFrame([(f"k{i:04d}", x.tolist()) for i, x in enumerate(v)], "key string, vec array<float>").repartition(4)
    asked = spark.createDataFrame([(i, v[i * 17].tolist()) for i in range(60)], "query_id int, qvec array<float>")
    for metric in ("cosine", "euclidean"):
        spec = IndexSpec(dim=16, metric=metric)
        pq.save_pq(pq.build_pq(index, spec), f"{tmpdir_path}/{metric}")
        coded = pq.load_pq(spark, f"{tmpdir_path}/{metric}")
        assert coded.codes.count() == 1200 and coded.codes.select(F.min(F.length("code"))).first()[0] == 4
        exact = {(x.query_id, x.key) for x in knn_topk(index, asked, spec, k=5).collect()}
        found = pq.pq_search(coded, asked, k=5, nprobe=8, rerank=60)
        rows = found.collect()
        assert len(exact & {(x.query_id, x.key) for x in rows}) >= 0.95 * len(exact) and len(rows) == 300
        assert pq.share_read(coded, asked, 8).first().share < 0.5
        full = pq.pq_search(coded, asked, k=5, nprobe=coded.lists, rerank=1200)
        assert {(x.query_id, x.key) for x in full.collect()} == exact
    with pytest.raises(ValueError):
        pq.build_pq(index, IndexSpec(dim=16), subspaces=5)


def test_unchanged_texts_are_not_shuffled(spark, tmpdir_path):
    base, spec = tmpdir_path + "/kb", IndexSpec(dim=8)
    rows = [(str(i), f"text number {i}", f"p/{i}", "txt", "s") for i in range(50)] + [("7", "later seven", "p/99", "txt", "s"), ("8", "text number 8", "p/8", "txt", "s")]
    spark.createDataFrame(rows, "doc_id string, text string, path string, file_type string, source string").write.parquet(tmpdir_path + "/c")
    corpus = spark.read.parquet(tmpdir_path + "/c")
    chosen = ing.choose_rows(corpus)
    assert all("text" not in names for names in _exchanges(chosen))
    held = materialize(chosen, "chosen")
    got = {r.doc_id: r.text for r in ing.fetch_rows(corpus, held).collect()}
    assert len(got) == 50 and got["7"] == "later seven" and got["8"] == "text number 8"
    assert _exchanges(ing.fetch_rows(corpus, held.where("copies = 1"))) == []  # fetched in place
    ing.ingest(spark, corpus, base, spec, sync=True)
    again = {r.status: r.docs for r in ing.ingest(spark, corpus, base, spec, sync=True).collect()}
    assert again == {"unchanged": 50}


def test_keys_beyond_the_waves_are_joined_plainly(spark, monkeypatch):
    from tessera import session

    corpus = spark.createDataFrame([(str(i), f"t{i}", None if i % 2 else "s") for i in range(40)], "doc_id string, text string, source string")
    held = materialize(ing.choose_rows(corpus), "chosen")
    for size in (64 << 20, 1500, 1):
        monkeypatch.setattr(session, "KEY_BYTES", size)
        assert sorted(r.doc_id for r in ing.fetch_rows(corpus, held.where("doc_id < '2'")).collect()) == sorted(str(i) for i in range(40) if str(i) < "2")


def test_a_failed_call_leaves_its_chunk_without_prefix(spark):
    def call(document, chunk):
        if "bad" in chunk:
            raise RuntimeError("no answer")
        return document[:5]

    docs = spark.createDataFrame([("a", "hello there", "txt"), ("b", "a bad text", "txt"), ("c", "more text", "txt")], "doc_id string, text string, file_type string")
    rows = {r.doc_id: r.context_prefix for r in ing.build_index_rows(docs, IndexSpec(dim=8), contextual=True, context_fn=ing.per_chunk(call)).collect()}
    assert rows == {"a": "hello", "b": None, "c": "more "}
    chunks = spark.createDataFrame([("b", 0, "a bad text"), ("x", 0, "no document")], "doc_id string, chunk_index int, content string")
    failed = {r.doc_id: (r.context_prefix, r.failed) for r in ing.per_chunk(call)(chunks, docs).collect()}
    assert failed == {"b": ("", "RuntimeError: no answer"), "x": ("", None)}
