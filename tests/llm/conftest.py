import hashlib
import random
import re

import pytest
from tests.conftest import SF001

DOC = "doc_id long, text string, lang string, source string, n_chars long, block long, uid string, payload string"


def make_docs(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), 7, "u", "p") for i, t in rows], DOC)


@pytest.fixture(scope="session")
def odd_rows(spark):
    """Driver documents plus nulls, empty, blank, tiny, repeated, periodic and very long texts."""
    r = random.Random(5)
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    base = [t for _, t in rows if len(t) > 600][:12]
    words = [w for t in base for w in t.split()]
    near = []
    for t in base[:4]:
        w = t.split()
        for _ in range(6):
            v = list(w)
            v[r.randrange(len(v))] = "changed"
            near.append(" ".join(v))
    line = "one line that very many of these documents share with each other, word for word, and long enough. "
    shared = [" ".join(r.choices(words, k=30)) + " " + line + " ".join(r.choices(words, k=30)) for _ in range(25)]
    more = [None, "", " \n\t ", "One", "two words", "Two  WORDS", "a" * 500, "ab" * 300, "a" * 500, "é ü <|endoftext|> x​y", "\x00nul\x00" * 40, line * 9]
    long = " ".join(r.choices(words, k=60_000))
    texts = near + shared + more + [base[0], base[0], base[1] + " " + base[2], long, long[1000:200_000]]
    rows += [(1000 + i, t) for i, t in enumerate(texts)]
    rows += [(3, base[3]), (3, base[3]), (4, "another text under the same id " * 8), (None, base[5]), (None, base[5] + " more"), (None, None)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return make_docs(spark, odd_rows).repartition(5).cache()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def shingles(text, k=5):
    w = tokens(text)
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def repeats(rows, length=100):
    """Multiset rows (doc_id, n_bytes, n_removed, n_spans, sha) by brute force; ties as documented."""
    import zlib

    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, zlib.crc32((r[1] or "").encode())))
    seen, out = set(), []
    for i, t in order:
        b = (t or "").encode()
        cov = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                cov[p : p + length] = b"\1" * length
            seen.add(s)
        kept = bytes(x for x, c in zip(b, cov, strict=True) if not c)
        runs = sum(1 for p in range(len(b)) if cov[p] and (p == 0 or not cov[p - 1]))
        out.append((i, len(b), sum(cov), runs, hashlib.sha256(kept).hexdigest()))
    return out


def links(texts, percent=80, k=5):
    """Component (smallest index) of each text by comparing all that share a shingle."""
    sets = [shingles(t, k) for t in texts]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    at = {}
    for i, s in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(i)
    pairs = {(i, j) for own in at.values() for i in own for j in own if i < j}
    for i, j in pairs:
        o = len(sets[i] & sets[j])
        if 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
            a, b = find(i), find(j)
            up[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


def same(got, want):
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    return sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)
