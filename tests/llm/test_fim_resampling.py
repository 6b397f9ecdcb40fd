"""Fill-in-middle and importance resampling against plain restatements."""

import hashlib
import math
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import fim, resampling as R
from tests.llm.conftest import DOC, make_docs, same


def brute_fim(doc_id, text, seed=7, rate=100, spm=50):
    t = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(lines)
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    form = "spm" if h4 % 100 < spm else "psm"
    return doc_id, n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


TEXTS = [None, "", "\n", "\n\n\n", "one", "one\n", "a\nb", "a\r\nb c\nd\x0be", "é\nü€\n😀\n", "x <P> y\nz", "<S>", "<M", "<\nP>\n<", "a<\nS>b\nM>", "<P\n>", "\x00\n\x00"]


def test_fim_equals_strings(spark, odd_rows):
    rows = odd_rows + [(5000 + 40 * j + i, t) for j in range(20) for i, t in enumerate(TEXTS)] + [(None, "a\nb\nc"), (9999, "line\n" * 200_000)]
    docs = make_docs(spark, rows).repartition(4)
    want = [brute_fim(*r) for r in rows]
    got = [tuple(r) for r in fim.fim_transform(docs).collect()]
    assert same(got, want)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digests = [tuple(r) for r in fim.fim_digests(docs).collect()]
    assert same(digests, [(*w[:5], sha(w[5]), sha(t or "")) for w, (_, t) in zip(want, rows, strict=True)])
    back = fim.fim_restore(fim.fim_transform(docs))
    assert same([tuple(r) for r in back.collect()], [(i, t or "") for i, t in rows])
    forms = {w[2] for w in want}
    assert forms == {"plain", "psm", "spm"}


def test_fim_rates_and_other_sentinels(spark):
    rows = [(i, "first\nsecond\nthird\n") for i in range(400)]
    docs = make_docs(spark, rows)
    marks = (b"<|pre|>", b"<|suf|>", b"<|mid|>")
    out = fim.fim_transform(docs, seed=3, rate=50, spm=0, sentinels=marks)
    forms = [r.form for r in out.collect()]
    assert 120 < forms.count("psm") < 280 and forms.count("spm") == 0
    assert {r.text for r in fim.fim_restore(out, marks).collect()} == {rows[0][1]}
    with pytest.raises(ValueError):
        fim.fim_transform(docs, sentinels=(b"aa", b"ab", b"ac"))


def test_fim_of_no_rows_and_broken_outputs(spark):
    docs = spark.createDataFrame([], DOC)
    assert fim.fim_digests(docs).collect() == [] and fim.fim_restore(fim.fim_transform(docs)).collect() == []
    with pytest.raises(ValueError):
        fim.rebuilt(b"<P>a<S>b", "psm")


def features(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute_resample(rows, bench, percent=5):
    own = [features(t) for _, t in rows]
    s, t = [0] * 10000, [0] * 10000
    for count, texts in ((s, own), (t, [features(x) for x in bench])):
        for _, f in texts:
            for b in f:
                count[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10000) / ((s[b] + 1) * (sum(t) + 10000)))) for b in range(10000)]
    out, may = [], []
    for i, ((doc_id, _), (n, f)) in enumerate(zip(rows, own, strict=True)):
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(f), weight, score, None])
        if n >= 20:
            may.append(((-score, doc_id is None, doc_id or 0, -weight, -len(f)), i))
    for r, (_, i) in enumerate(sorted(may)[: percent * len(may) // 100]):
        out[i][4] = r + 1
    return [tuple(r) for r in out]


def test_buckets_equal_plain_checksums():
    r = random.Random(2)
    texts = ["".join(r.choice("abC9é€😀 .,\n_@[`{~") for _ in range(r.randrange(0, 60))) for _ in range(500)]
    texts += [None, "", "...", "x" * 40, "A" * 100_000 + " b " + "é" * 5000 + " c", " ".join(["w" * i for i in range(1, 140)]), "one", "one two"]
    col = pa.array(texts, pa.string())
    data, off = R.text_arrays(col)
    n, bucket, text = R.text_buckets(data, off)
    got = [[] for _ in texts]
    for b, t in zip(bucket.tolist(), text.tolist(), strict=True):
        got[t].append(b)
    want = [features(t) for t in texts]
    assert n.tolist() == [w for w, _ in want]
    assert [sorted(g) for g in got] == [sorted(f) for _, f in want]


@pytest.mark.parametrize("percent", [5, 100])
def test_resampling_equals_sorting(spark, odd_rows, percent):
    r = random.Random(9)
    words = [w for _, t in odd_rows[:40] for w in (t or "").split()]
    rows = odd_rows + [(20_000 + i, " ".join(r.choices(words, k=r.randrange(10, 60)))) for i in range(300)]
    rows += [(77, " ".join(words[:30]))] * 7 + [(None, " ".join(words[:40]))] * 3  # rows of one key
    bench = [t for _, t in odd_rows[5:25]] + [None, ""]
    target = spark.createDataFrame([(i, t) for i, t in enumerate(bench)], "item_id long, text string")
    got = R.resample(make_docs(spark, rows).repartition(6), target, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert same([tuple(x) for x in got.collect()], brute_resample(rows, bench, percent))


def test_resampling_of_empty_tables(spark):
    target = spark.createDataFrame([], "item_id long, text string")
    assert R.resample(spark.createDataFrame([], DOC), target).collect() == []
    got = R.resample(make_docs(spark, [(1, "word " * 30), (2, None)]), target, percent=100).collect()
    assert sorted((x.doc_id, x.n_features, x.rank) for x in got) == [(1, 87, 1), (2, 0, None)]


@pytest.mark.parametrize("fan", [2, 1000])
def test_cutoff_is_the_kth_key(spark, fan):
    r = random.Random(1)
    keys = [(r.randrange(-40, 40), r.randrange(5), 0, r.randrange(2)) for _ in range(3000)]
    df = spark.createDataFrame(keys, ", ".join(f"{c} long" for c in R.KEY)).repartition(7).cache()
    for k in (1, 150, 3000):
        assert R.cutoff(df, k, fan) == sorted(keys)[k - 1]
    assert R.cutoff(df, 0) is None and R.cutoff(df, 3001) is None
    assert R.cutoff(df.where(F.lit(False)), 1) is None
    same_key = df.select(*[F.lit(4).cast("long").alias(c) for c in R.KEY])
    assert R.cutoff(same_key, 1000, fan) == (4, 4, 4, 4)
