"""Top-k search, quality classifier, and the pipeline against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import topk as T
from tessera.llm.quality import score_quality
from tests.conftest import SF001
from tests.llm.conftest import DOC, links, make_docs, repeats, same
from tests.llm.test_decontaminate import brute as leaks

SF1 = "/root/testdata/sf0.1"
EMB = "vec_id long, embedding array<float>, label int, v string, cell int"


def emb(spark, rows):
    return spark.createDataFrame([(i, v, 0, "v", 1) for i, v in rows], EMB)


def brute_top(rows, k=20, every=20, scale=64):
    ok = []
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            ok.append((i, tuple(math.floor(scale * float(np.float32(x))) for x in v)))
    out = []
    for at, (q, a) in enumerate(ok):
        if q % every == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for n, (i, b) in enumerate(ok) if n != at and len(b) == len(a))
            out += [(q, r + 1, i, -n) for r, (n, i) in enumerate(s[:k])]
    return out


def vectors(n, seed, dim=6):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    rows = []
    for i in range(n):
        c = r.choice(centres)
        rows.append((i, [x + r.gauss(0, 0.2) for x in c] if i % 3 else centres[0]))
    return rows


@pytest.mark.parametrize("block", [4096, 50])
def test_top_k_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(T, "BLOCK", block)
    rows = vectors(600, 1)
    rows += [(40, rows[40][1]), (20, None), (60, []), (80, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (100, [float("nan")] * 6), (120, [float("inf")] * 6), (None, rows[1][1]), (140, [1.0, 2.0]), (7, [0.5, 0.25]), (-20, rows[2][1])]
    assert same(T.exact_top_k(emb(spark, rows)).collect(), brute_top(rows))


def test_top_k_of_ids_on_several_near_vectors(spark):
    """Other rows under the query's id are answers like any other."""
    rows = vectors(200, 2)
    rows += [(40, [x + i / 64 for x in rows[40][1]]) for i in range(1, 30)] + [(60, [9.0 + i for i in range(6)])]
    got = T.exact_top_k(emb(spark, rows)).collect()
    assert same(got, brute_top(rows)) and sum(r.query_id == 40 for r in got) == 600


def test_top_k_of_repeated_rows(spark):
    """Rows equal in id and vector are queries and candidates each."""
    rows = vectors(120, 3)
    rows += [rows[20]] * 30 + [rows[40]] * 2 + [(60, rows[3][1])] * 25 + [rows[7]] * 40
    assert same(T.exact_top_k(emb(spark, rows).repartition(4)).collect(), brute_top(rows))


def test_top_k_of_more_lengths_than_pivots(spark, monkeypatch):
    monkeypatch.setattr(T, "CELLS", 3)
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) for _ in range(1 + i % 7)]) for i in range(400)]
    assert same(T.exact_top_k(emb(spark, rows)).collect(), brute_top(rows))


def test_top_k_few_and_none(spark):
    rows = [(0, [1.0]), (20, [-1.0]), (3, [0.0])]
    assert same(T.exact_top_k(emb(spark, rows)).collect(), brute_top(rows))
    assert T.exact_top_k(emb(spark, [])).count() == 0
    assert T.exact_top_k(emb(spark, [(1, [1.0]), (2, [1.0])])).count() == 0


def test_tree_search_of_vectors_without_structure(monkeypatch):
    """Where nothing can be skipped, few pairs of nodes are visited; ties go to the smaller id."""
    r = np.random.default_rng(1)
    q, tree = T.CoverTree(r.integers(-3, 4, (200, 16))), T.CoverTree(r.integers(-3, 4, (3000, 16)))
    made = []
    product = T.product
    monkeypatch.setattr(T, "product", lambda a, b: made.append(len(a) * len(b)) or product(a, b))
    ids = r.permutation(3000)
    for floor in (None, 40):
        made.clear()
        got = T.search(q, tree, ids, 5, np.full(200, np.iinfo(np.int64).min if floor is None else floor))
        assert len(made) < 60
        score = q.points @ tree.points.T
        want = [(i, -n, j) for i in range(200) for n, j in sorted(zip((-score[i]).tolist(), ids.tolist(), strict=True))[:5] if floor is None or -n >= floor]
        assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted(want)


def test_tree_search_skips_and_misses_nothing():
    r = np.random.default_rng(0)
    pts = np.concatenate([r.integers(-60, 60, (500, 4)), np.repeat(r.integers(-60, 60, (1, 4)), 200, 0)])
    tree, q = T.CoverTree(pts), T.CoverTree(r.integers(-60, 60, (130, 4)))
    for t in (tree, q):
        for i in range(len(t.lo)):
            own = t.points[t.lo[i] : t.hi[i]]
            assert np.sqrt(((own - t.centre[i]) ** 2).sum(1)).max() <= t.radius[i] + 1e-9
    i, s, who = T.search(q, tree, tree.order, 9, np.full(130, np.iinfo(np.int64).min))
    got = sorted(zip(i.tolist(), s.tolist(), who.tolist(), strict=True))
    want = sorted((x, -n, j) for x, row in enumerate(q.points @ pts.T) for n, j in sorted((-int(v), j) for j, v in enumerate(row))[:9])
    assert got == want


def test_quality_on_documents_without_labels(spark):
    """Trained on even documents' labels only; judged on the others."""
    docs = spark.read.parquet(f"{SF1}/documents.parquet")
    labels = spark.read.parquet(f"{SF1}/labels.parquet")
    got = {r.doc_id: r for r in score_quality(docs, labels.where("doc_id % 3 > 0")).collect()}
    test = [r for r in labels.where("doc_id % 3 = 0").collect()]
    assert len(got) == docs.count()
    toxic = [got[r.doc_id].p_toxic >= 0.5 for r in test if r.toxic]
    clean = [got[r.doc_id].keep for r in test if r.quality and not r.toxic]
    assert sum(toxic) >= 0.8 * len(toxic) and sum(clean) >= 0.95 * len(clean)


def test_quality_edges(spark, odd_docs, odd_rows):
    labels = spark.createDataFrame([(i, i % 2, None if i % 5 else 1) for i in range(150)] + [(1, 1, 0), (None, 1, 1), (10**9, 0, 0)], "doc_id long, quality int, toxic int")
    got = score_quality(odd_docs, labels).collect()
    assert same([(r.doc_id,) for r in got], [(i,) for i, _ in odd_rows])
    assert all(0 <= r.score <= 1 for r in got)
    none = score_quality(odd_docs.drop("lang", "source", "n_chars"), labels.limit(0)).collect()
    assert len(none) == len(odd_rows) and all(abs(r.p_quality - 0.5) < 1e-6 for r in none)
    assert score_quality(spark.createDataFrame([], DOC), labels).count() == 0


def stage(spark, docs, i, sf=SF001):
    return corpus_pipeline.STAGES[i][1](spark, docs, sf)


def test_pipeline_stages_on_odd_rows(spark, odd_docs, odd_rows):
    kept = stage(spark, odd_docs, 0)
    assert kept.dtypes == odd_docs.dtypes
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert not Counter(rows) - Counter(odd_rows) and len(rows) > 0.9 * len([t for _, t in odd_rows if t and t.strip()])

    n, comp = links([t for _, t in odd_rows])
    first = {}
    for j, c in enumerate(comp):
        i = odd_rows[j][0]
        first.setdefault(c, []).append((i is None, i or 0, odd_rows[j]))
    got = stage(spark, odd_docs, 1)
    assert got.dtypes == odd_docs.dtypes
    some = [(r.doc_id, r.text) for r in got.collect()]
    assert len(some) == len(first)
    assert Counter(i for i, _ in some) == Counter(min(m, key=lambda x: x[:2])[2][0] for m in first.values())

    cut = stage(spark, odd_docs, 2)
    assert cut.dtypes == odd_docs.dtypes
    whole = [r for r in repeats(odd_rows) if r[2] == 0]
    left = cut.collect()
    assert sum((r.doc_id, r.text) in set(odd_rows) for r in left) >= len(whole)
    assert all(r.n_chars == len(r.text or "") for r in left)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    small = [r for r in odd_rows if r[1] is None or len(r[1]) < 1500]
    small += [(5000, "Before. " + items[0][1] + " After."), (5001, items[1][1])]
    bad = {i for i, _, _ in leaks(small, items[:6])}
    assert {5000, 5001} <= bad
    keep = stage(spark, make_docs(spark, small), 3)
    assert not {5000, 5001} & {r.doc_id for r in keep.collect()}


def test_pipeline_runs_and_is_the_stages_in_turn(spark):
    out = corpus_pipeline.run(spark, SF001)
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, SF001)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = corpus_pipeline.STAGES[-1][1](spark, docs, SF001)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert same(out.select(*cols).collect(), want.select(*cols).collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language id", "jaccard join", "suffix dedup", "decontamination", "packing"]


def test_pipeline_of_nothing(spark):
    docs = spark.createDataFrame([], DOC)
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, SF001)
        assert docs.dtypes == spark.createDataFrame([], DOC).dtypes
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF001).count() == 0
