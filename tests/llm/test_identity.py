"""Words and pre-tokens that a plain polynomial takes for equal; sizes for large inputs."""

import numpy as np
import pyarrow as pa

from tessera.llm import blocks as B
from tessera.llm import kernels as K
from tessera.llm import packing as P
from tessera.llm.jaccard import jaccard_components
from tessera.llm.queries import vocabulary
from tessera.llm.suffix_tree import score_documents
from tests.llm.conftest import make_docs

FLIP = str.maketrans("ab", "ba")


def doubling(n):
    """The doubling sequence over {a, b} and its complement: equal under any odd base modulo 2**64 from 1024 letters on."""
    word = "a"
    while len(word) < n:
        word += word.translate(FLIP)
    return word, word.translate(FLIP)


ONE, TWO = doubling(1024)


def test_structured_words_are_told_apart():
    data, off = K.text_arrays(pa.array([ONE, TWO, f"x {TWO} {ONE}", *doubling(8192)]))
    sums = K.prefix_sums(data)
    same = K.span_hash(sums, np.array([0, 1024]), np.array([1024, 2048]))
    assert same[0] == same[1]  # the reason for word_hash
    h = K.words(data, off)[0].tolist()
    assert h[0] == h[4] and h[1] == h[3] and len(set(h)) == 5


def test_pre_tokens_are_compared_by_their_bytes(monkeypatch):
    path = vocabulary("word_bpe_49k.json")
    tok = P.load(path)
    texts = [ONE, TWO, f"{TWO} {ONE} plain", "", "it's 12 plain words <|x", "Ünï code €5", *("ab" * i for i in range(40))]
    data, off = K.text_arrays(pa.array(texts))

    def equal():
        ids, cut = P.id_arrays(path)(data, off)
        return all(ids[cut[i] : cut[i + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts))

    assert equal()
    monkeypatch.setattr(P, "word_hash", lambda sums, a, b: ((b - a) % 3).astype(np.uint64))  # a poor hash is only slower
    assert equal()


def test_operators_on_structured_words(spark):
    rest = "four plain words here "
    docs = make_docs(spark, [(10, rest + ONE), (11, rest + TWO), (12, rest + ONE)])
    got = {r.doc_id: r.component_id for r in jaccard_components(docs).collect()}
    assert got == {10: 10, 11: 11, 12: 10}
    import zlib

    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    kept = [i for i in range(200) if i not in held]
    rows = [(kept[0], ONE), (held[0], TWO), (held[1], ONE)]
    known = {r.doc_id: r.n_known for r in score_documents(make_docs(spark, rows)).collect()}
    assert known[held[1]] - known[held[0]] == 1


def test_sizes_hold_at_a_hundred_terabytes():
    for total in (10**9, 10**12, 10**14):
        block, per = B.grown(B.BLOCK_BYTES, total), B.grown(B.RANGE_BYTES, total)
        assert B.bucket_count(total, block, 100_000) <= 100_000
        assert block <= 128 << 20 and per <= 512 << 20
        assert (total / block) * B.destinations(total) <= 2e11
    # messages in proportion to the input up to the limits
    at = lambda t: t / B.grown(B.BLOCK_BYTES, t) * B.destinations(t) / t
    assert at(10**12) < 1.1 * at(10**11)
    assert B.grown(B.BLOCK_BYTES, 30 << 30) == B.BLOCK_BYTES


def test_the_catalog_keeps_no_tables(spark):
    before = {t.name for t in spark.catalog.listTables()}
    blocks, _ = B.document_blocks(make_docs(spark, [(1, "a b"), (2, None)]), "catalog")
    assert {t.name for t in spark.catalog.listTables()} == before
    plan = blocks.groupBy("block").count()._jdf.queryExecution().executedPlan().toString()
    assert blocks.count() >= 1 and "Bucketed: true" in plan
