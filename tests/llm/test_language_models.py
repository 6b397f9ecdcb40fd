"""Language identification and the suffix tree: brute force and held-out accuracy."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from tessera.llm import blocks as B
from tessera.llm import langid as L
from tessera.llm import suffix_tree as P
from tests.conftest import SF001, SF01
from tests.llm.conftest import DOC, make_docs, tokens

LANGS = ("de", "en", "es", "fr")


def tree_scores(rows):
    """The documented model with plain dictionaries."""
    texts = [[*tokens(t), None] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    train = [t for t, h in zip(texts, held, strict=True) if not h]
    c = [Counter(), Counter(), Counter()]
    for t in train:
        for i, w in enumerate(t):
            for k in range(3):
                if i >= k:
                    c[k][tuple(t[i - k : i + 1])] += 1
    total, distinct = sum(c[0].values()), len(c[0])
    least = max(P.CONTEXT, P.SHARE * total)
    p0 = lambda w: (c[0][(w,)] + 1) / (total + distinct + 1)
    state: dict = {}

    def p(ctx, w):
        if not ctx:
            return p0(w)
        below = p(ctx[1:], w)
        s = state.get(ctx)
        return (c[len(ctx)][(*ctx, w)] + s * below) / (c[len(ctx) - 1][ctx] + s) if s else below

    for k in (1, 2):
        follow = defaultdict(list)
        for g, n in c[k].items():
            if c[k - 1][g[:-1]] >= least and (k == 1 or c[0][g[:1]] >= least):
                follow[g[:-1]].append((g[-1], n))
        found = {}
        for ctx, nxt in follow.items():
            gains = [sum(n * math.log((n - 1 + s * p(ctx[1:], w)) / ((c[k - 1][ctx] - 1 + s) * p(ctx[1:], w))) for w, n in nxt) for s in P.STRENGTHS]
            if max(gains) >= P.GAIN:
                found[ctx] = P.STRENGTHS[gains.index(max(gains))]
        state.update(found)
    out = []
    for (i, _), t, h in zip(rows, texts, held, strict=True):
        score = base = 0.0
        for j, w in enumerate(t):
            ctx = tuple(t[max(0, j - 2) : j])
            while ctx and not (c[len(ctx) - 1][ctx] >= least):
                ctx = ctx[1:]
            score += math.log10(p(ctx, w))
            base += math.log10(p0(w))
        out.append((i, h, len(t), sum(c[0][(w,)] > 0 for w in t), total, base, score))
    return out, state


def test_suffix_tree_matches_the_plain_form(odd_docs, odd_rows):
    want, state = tree_scores(odd_rows)
    got = P.score_documents(odd_docs).collect()
    assert any(len(s) == 1 for s in state) and any(len(s) == 2 for s in state)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def test_suffix_tree_over_many_blocks(odd_docs, odd_rows, monkeypatch):
    """Pairs and triples that one block holds alone are counted in place, the others by their owners."""
    monkeypatch.setattr(P, "TEXT_BYTES", 1 << 14)
    want = tree_scores(odd_rows)[0]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    got, want = sorted(map(tuple, P.score_documents(odd_docs).collect()), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def test_suffix_tree_sends_only_pairs_that_other_blocks_can_add_to():
    dests, train = 4, [i for i in range(20) if zlib.crc32(str(i).encode()) % 7 != 2]
    texts = ["common shared " * 70 + " ".join(f"common own{k}x{i}" for i in range(300)) for k in range(2)]
    made = [P._make(7, 2)(k, pa.table({"doc_id": [train[k]], "text": [t]})) for k, t in enumerate(texts)]
    sent = [r for k, m in enumerate(made) for r in B.send(k, B.unsqueeze_sorted(B.unframe(m["payload"])[1]), dests, B.unsqueeze(m["known"], np.uint32))]
    owner = B.adder(number=lambda n: n >= 1)
    told = pa.concat_tables([owner(B.table([r for r in sent if r[1] == d])) for d in range(dests)])
    blocks = pa.table({"block": [0], "payload": pa.array([made[0]["payload"]], pa.binary())})
    told = told.filter(pa.compute.equal(told.column("block"), 0))
    got = P._pass("pairs", dests, sum(m["n_train"] for m in made), 700, {"word": 12})(blocks, told)
    keys = np.concatenate([B.unsqueeze_sorted(B.unframe(p)[0]) for p in got.column("payload").to_pylist()])
    assert len(keys) == 2  # common shared, shared common


def test_numbers_scatter_one_to_one():
    x = P._scatter(np.arange(1 << 13), 13)
    assert len(np.unique(x)) == 1 << 13 and not (x & np.uint64((1 << 51) - 1)).any()
    left, right = (a.ravel() for a in np.meshgrid(np.arange(64), np.arange(32)))
    for bits in (6, 40):  # together, and hashed
        assert len(np.unique(P._join(left, right, bits, 30))) == 64 * 32


def test_pairs_travel_in_few_bytes():
    """What is sent of the pairs of frequent words is what owners read, and takes less than two bytes a pair (three as scattered keys)."""
    r, dests = np.random.default_rng(0), 8
    both = np.unique(np.minimum(r.zipf(1.2, (400_000, 2)), 1 << 20), axis=0)
    both = both[r.permutation(len(both))]
    value = np.arange(len(both), dtype=np.uint32) % 3
    order, sent = P._send_pairs(0, both[:, 0], both[:, 1], dests, value)
    bits = max(1, 21 - (dests.bit_length() - 1))
    want, at = (both[order, 0] << bits | both[order, 1] // dests).astype(np.uint64), 0
    for block, dest, payload in sent:
        key, rest = P._told_pairs(bits)(B.unframe(payload))
        own = order[at : at + len(key)]
        assert block == 0 and (key == want[at : at + len(key)]).all() and (np.diff(key) > 0).all()
        assert (B.unsqueeze(rest[0], np.uint32) == value[own]).all()
        at += len(key)
    assert at == len(both) and len({d for _, d, _ in sent}) == dests
    sizes = [len(p) for _, _, p in sent]
    assert max(sizes) < 1.5 * min(sizes)  # the most frequent word's pairs go to all owners
    ones = P._send_pairs(0, both[:, 0], both[:, 1], dests, np.ones(len(both), np.uint32))[1]
    assert sum(len(p) for _, _, p in ones) < 2 * len(both)


def test_frequent_keys_get_small_numbers():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 60, 1000, dtype=np.uint64))
    count = np.ones(1000, np.uint32)
    count[[5, 700]] = 40, 9
    rows = B.send(0, keys, 1, count) + B.send(1, keys[::2], 1, count[::2])
    told = B.adder(number=lambda n: n >= 2)(B.table(rows))
    number, first = [], []
    for payload in told.column("payload").to_pylist():
        n, nth, _, lead = B.unframe(payload)
        n = B.unsqueeze(n, np.uint64)
        has = np.flatnonzero(n >= 2)
        number.append(np.full(len(n), -1))
        number[-1][has[B.by_size(n[has])]] = B.unsqueeze_sorted(nth, np.uint32)
        first.append(has[np.unpackbits(B.unsqueeze(lead, np.uint8), count=len(has)).astype(bool)])
    # 40 of key 5, then 18 of key 700, then the two of each even key; of key 5 only block 0 has any
    assert number[0][5] == 0 and number[0][700] == 1 and number[0][1] == -1
    assert (number[0][::2] == number[1]).all() and sorted(number[0][number[0] >= 0]) == list(range(501))
    assert len(first[0]) == 501 and not len(first[1])  # each key has one block that reports it


def test_each_event_is_reported_once():
    """Blocks' sums of what they alone report add up to the left-out divergence of all occurrences."""
    r, p = np.random.default_rng(2), np.array([0.2, 0.05, 0.01, 0.001])
    local = r.integers(0, 40, (5, 4))
    local[:, 3] = [0, 0, 1, 0, 0]
    n, c = local.sum(0), local.sum()
    lead = (local > 0).argmax(0)
    at = np.zeros(4, np.int64)
    got = [P._sums(at, P._gains(n.astype(float), lead == k, p), np.array([c]), np.array([k == 0]))[1] for k in range(5)]
    for i, s in enumerate(P.STRENGTHS):
        want = (n * np.log((n - 1 + s * p) / ((c - 1 + s) * p))).sum()
        assert abs(sum(int(g[i][0]) for g in got) * P.STEP - want) < 5 * P.STEP
    assert not any(g[0] for g in got[4]) and not any(g[0] for g in got[3])  # nothing to tell again


def test_suffix_tree_beats_single_words_on_held_out_texts(spark):
    got = P.score_documents(spark.read.parquet(f"{SF01}/documents.parquet")).where("held_out").collect()
    assert len(got) > 100 and sum(r.score for r in got) > 0.98 * sum(r.base_score for r in got)
    assert sum(r.score > r.base_score for r in got) > 0.9 * len(got)


def test_suffix_tree_states_are_distributions(spark):
    """Over all known words and the unknown one, what follows a context sums to one."""
    r = random.Random(0)
    rows = [(i, " ".join(r.choice(("a b", "a c", "b d")) for _ in range(60))) for i in range(30)]
    probe = [(1000 + i, f"a {w}") for i, w in enumerate(("a", "b", "c", "d", "unseen", ""))]
    ids = [i for i, _ in probe if zlib.crc32(str(i).encode()) % 7 != 2]
    held = iter(i for i in range(5000, 9000) if zlib.crc32(str(i).encode()) % 7 == 2)
    probe = [(next(held), t) for _, t in probe]
    assert ids
    got = {x.doc_id: x for x in P.score_documents(make_docs(spark, rows + probe)).collect()}
    first = got[probe[-1][0]].score  # "a" and the end
    whole = sum(10 ** got[i].score for i, _ in probe[:-1])
    assert math.isfinite(first) and whole < 1


def test_languages_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    model = L.train(docs.where("doc_id % 2 = 0"), LANGS)
    rows = docs.where("doc_id % 2 = 1").select("lang", "text").collect()
    logs = L.text_evidence(pa.array([r.text for r in rows]), model)
    right = [LANGS[int(x[:-1].argmax())] == r.lang for x, r in zip(logs, rows, strict=True) if not np.isnan(x[0])]
    assert sum(right) >= 0.98 * len(right)


def test_evidence_is_fused_and_junk_is_rejected(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text", "lang", "source")
    r = random.Random(3)
    junk = [(10_000 + i, "".join(r.choice("qxzwkjvQXZ") for _ in range(400)), "en", "src1") for i in range(3)]
    odd = [(20_000, None, "fr", "src1"), (20_001, " \n", "fr", None), (20_002, "1234 !!", None, None), (None, "de la que", None, None), (0, docs.where("doc_id = 0").first().text, "EN", "src1"), (20_003, "ok", "xx", "")]
    more = spark.createDataFrame(junk + odd, "doc_id long, text string, lang string, source string")
    got = L.identify_documents(docs.unionByName(more).selectExpr("*", "'x' as share", "1 as seen", "2 as logs"), LANGS).collect()
    assert len(got) == docs.count() + len(junk) + len(odd)
    by = defaultdict(list)
    for x in got:
        by[x.doc_id].append(x)
    assert all(not by[i][0].accepted and by[i][0].language == "und" for i in (10_000, 10_001, 10_002))
    assert all(not by[i][0].accepted for i in (20_000, 20_001, 20_002))
    assert by[20_000][0].language == "fr" and len(by[0]) == 2 and {x.text_language for x in by[0]} == {"fr"}
    clean = [x for x in got if x.doc_id is not None and x.doc_id < 10_000]
    assert sum(x.accepted for x in clean) >= 0.99 * len(clean)


def test_pages_use_markup_and_address(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.example.de/x", '<html lang="de"><body>ok</body></html>'), (2, "https://u@b.example.org:80/", "<p>und das ist der und die</p>"), (3, None, None), (4, "no address", "<script>x</script>")],
        "page_id long, url string, html string",
    )
    e = {x.page_id: x for x in L.page_evidence(pages).collect()}
    assert (e[1].host, e[1].domain, e[1].suffix, e[1].declared) == ("a.example.de", "example.de", "de", "de")
    assert e[2].host == "b.example.org" and e[3].host is None and e[4].host is None and e[4].suffix is None
    got = {x.page_id: x for x in L.identify_pages(pages, spark.read.parquet(f"{SF01}/documents.parquet"), LANGS).collect()}
    assert got[1].language == "de" and got[2].language == "de" and not got[3].accepted and not got[4].accepted


@pytest.mark.parametrize("fn", [P.score_documents, lambda d: L.identify_documents(d, LANGS)])
def test_empty(spark, fn):
    assert fn(spark.createDataFrame([], DOC)).count() == 0


def test_suffix_tree_contexts_dont_thin_out_with_size(spark):
    """A context of 70 occurrences is learnt among more than 7 million training tokens too."""
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2]
    train = [i for i in range(1000) if i not in held]
    rows = [(i, "x " * 100_000) for i in train[:72]] + [(i, "rare next") for i in train[72:142]]
    rows.append((held[0], "rare next"))
    got = {x.doc_id: x for x in P.score_documents(make_docs(spark, rows)).where("n_tokens = 3").collect()}
    x = got[held[0]]
    assert x.held_out and x.train_tokens > 7_000_000 and len(got) == 71
    assert x.score > x.base_score + 3


def plain_languages(rows, languages):
    """op3 with dictionaries: (id, language, probability, accepted) of rows (id, text, lang, source)."""

    def grams(text):
        low = [L._FOLD[b] for b in (text or "").encode()]
        out = []
        for i, w in enumerate(low):
            one, two = low[i - 1] if i > 0 else 0x20, low[i - 2] if i > 1 else 0x20
            if not (w == 0x20 and one == 0x20):
                out.append(((int(two) << 16 | int(one) << 8 | int(w)) * 0x9E3779B1 % (1 << 32)) >> 16)
        return out, any(w != 0x20 for w in low)

    k = len(languages)
    seen = {x: Counter() for x in languages}
    own = [grams(t) for _, t, _, _ in rows]
    for (_, _, lang, _), (g, _) in zip(rows, own):
        if lang in seen:
            seen[lang].update(g)
    pooled = Counter()
    for c in seen.values():
        pooled.update(c)
    mass = sum(pooled.values()) + 0.5 * L.BUCKETS

    def like(lang, b):
        p = (seen[lang][b] + 500.0 * (pooled[b] + 0.5) / mass) / (sum(seen[lang].values()) + 500.0)
        return math.log((1 - L.UNSEEN) * p + L.UNSEEN * math.exp(L.ALIKE))

    def softmax(x):
        e = [math.exp(v - max(x)) for v in x]
        return [v / sum(e) for v in e]

    memo = {}
    logs = []
    for g, letters in own:
        if not g or not letters:
            logs.append(None)
            continue
        at = lambda lang, b: memo.setdefault((lang, b), like(lang, b))
        logs.append([sum(at(x, b) for b in g) * L.TEMPER for x in languages] + [len(g) * L.ALIKE * L.TEMPER])
    share = [softmax(x[:k]) if x else [1 / k] * k for x in logs]
    live = [i for i, x in enumerate(logs) if x]
    base = [(sum(share[i][j] for i in live) + L.HOST_STRENGTH / k) / (len(live) + L.HOST_STRENGTH) for j in range(k)]
    out = []
    for i, (doc, _, lang, host) in enumerate(rows):
        total = list(logs[i]) if logs[i] else [0.0] * (k + 1)
        mates = [j for j in live if rows[j][3] == host and j != i] if host is not None else []
        anyone = [j for j in live if rows[j][3] == host] if host is not None else []
        for j in range(k):
            prior = (sum(share[m][j] for m in mates) + L.HOST_STRENGTH * base[j]) / (len(mates) + L.HOST_STRENGTH) if anyone else base[j]
            total[j] += math.log(prior) + math.log(1 - L.UNKNOWN)
            if lang in languages:
                same = [m for m in live if rows[m][2] == lang]
                guess = L.DECLARED_TRUST if languages[j] == lang else (1 - L.DECLARED_TRUST) / (k - 1)
                total[j] += math.log((sum(share[m][j] for m in same) + L.HOST_STRENGTH * guess) / (len(same) + L.HOST_STRENGTH) / base[j])
        total[k] += math.log(L.UNKNOWN)
        p = softmax(total)
        best = max(range(k + 1), key=lambda j: p[j])
        out.append((doc, [*languages, "und"][best], p[best], bool(logs[i]) and best < k and p[best] >= 0.5))
    return out


def test_language_id_equals_plain_dictionaries(spark):
    r = random.Random(6)
    docs = [(x.doc_id, x.text, x.lang, x.source) for x in spark.read.parquet(f"{SF001}/documents.parquet").collect()][:70]
    words = [w for _, t, _, _ in docs for w in t.split()]
    rows = docs + [(500, None, "en", "s1"), (501, "", None, None), (502, " 12 ", "fr", "s2"), (503, "xqzj kkvw zzxx qqq", "de", None), (504, "der", None, "s1"), (505, " ".join(r.choices(words, k=400)), "pt", "s9"), (None, docs[0][1], "EN", "s1")]
    rows = [(i, t, lang.lower() if lang else lang, s) for i, t, lang, s in rows]
    df = spark.createDataFrame([(i, t, lang, s, 1) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, logs int").repartition(3)
    languages = L.declared_languages(df, share=0.05)
    assert languages == ("de", "en", "es", "fr") and L.declared_languages(df.where("false"), ("x",)) == ("x",)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = sorted(plain_languages(rows, languages), key=key)
    got = sorted(((x.doc_id, x.language, x.probability, x.accepted) for x in L.identify_documents(df, languages).collect()), key=key)
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in want]
    assert all(abs(a[2] - b[2]) < 1e-4 for a, b in zip(got, want))


def test_a_fifth_language_counts_when_it_is_declared(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text", "lang", "source")
    more = spark.range(9000, 9040).select(F.col("id").alias("doc_id"), F.lit("Zażółć gęślą jaźń, wszyscy ludzie rodzą się wolni i równi pod względem godności").alias("text"), F.lit("PL").alias("lang"), F.lit("s").alias("source"))
    both = docs.unionByName(more)
    languages = L.declared_languages(both)
    assert languages == ("de", "en", "es", "fr", "pl")
    got = {x.doc_id: x.language for x in L.identify_documents(both, languages).where("accepted").collect()}
    assert all(got[i] == "pl" for i in range(9000, 9040))
