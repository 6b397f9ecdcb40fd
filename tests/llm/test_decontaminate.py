"""Greedy string tiling against a plain restatement, and the operator's edge cases."""

import random
import re

from tessera.llm.decontaminate import leaked_items, without_leaks
from tests.llm.conftest import DOC, make_docs, same


def tokens(text):
    low = re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), text or "")
    return re.findall("[0-9a-z\x80-\U0010ffff]+", low)


def plain_tiles(item, doc, size):
    """Words of ``item`` in greedy tiles, by trying every pair of places (longest first)."""
    a, b, covered = [False] * len(item), [False] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and not a[i + k] and not b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < size:
            return covered
        a[i : i + k] = [True] * k
        b[j : j + k] = [True] * k
        covered += k


def brute(rows, items, size=5, percent=80):
    out = []
    for d, t in rows:
        doc = tokens(t)
        for i, x in items:
            w = tokens(x)
            if w:
                c = plain_tiles(w, doc, min(size, len(w)))
                if 100 * c >= percent * len(w):
                    out.append((d, i, round(c / len(w), 9)))
    return out


def cases():
    r = random.Random(4)
    voc = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choices(voc, k=n))) for i, n in enumerate((40, 25, 60, 12, 5, 3, 1, 33))]
    items += [(8, None), (9, " "), (None, items[1][1]), (4, items[4][1])]
    rows = []
    for i, (_, t) in enumerate(items[:8]):
        w = t.split()
        mid = len(w) // 2
        pad = " ".join(r.choices(voc, k=30))
        rows.append((i * 10, f"{pad} {t.upper()} {pad}"))
        rows.append((i * 10 + 1, f"{pad} {' '.join(w[mid:])} {pad} {' '.join(w[:mid])}"))
        rows.append((i * 10 + 2, f"{' '.join(w[: max(1, int(len(w) * 0.7))])} {pad}"))
        v = list(w)
        v[mid] = "other"
        rows.append((i * 10 + 3, " ".join(v)))
    rows += [(900 + i, " ".join(r.choices(voc[:6], k=80))) for i in range(4)]
    mixed = "Über die ÑAÑEZ wÄlder, ça và sÖ fort; ÉTÉ × 3"
    items.append((77, mixed))
    rows += [(970, "x " + mixed.upper() + " y"), (971, " | ".join(w + "!!" for w in mixed.split()))]
    rows += [(0, rows[0][1]), (None, rows[0][1]), (950, None), (951, ""), (952, "w1"), (953, " ".join([items[0][1]] * 3))]
    return rows, items


def test_tiling_matches_the_plain_form(spark):
    rows, items = cases()
    table = spark.createDataFrame(items, "item_id long, text string")
    got = [(x.doc_id, x.item_id, round(x.coverage, 9)) for x in leaked_items(make_docs(spark, rows).withColumnRenamed("uid", "item_id"), table).collect()]
    assert same(got, brute(rows, items))


def test_slices_of_items_give_the_same(spark, monkeypatch):
    rows, items = cases()
    table, docs = spark.createDataFrame(items, "item_id long, text string"), make_docs(spark, rows)
    whole = leaked_items(docs, table).collect()
    monkeypatch.setattr("tessera.llm.decontaminate.SLICE_WORDS", 60)
    assert same(leaked_items(docs, table).collect(), whole)
    kept = without_leaks(docs, table)
    bad = {x.doc_id for x in whole}
    assert kept.columns == docs.columns
    assert sorted((x.doc_id or -1) for x in kept.collect()) == sorted((i or -1) for i, _ in rows if i not in bad)


def test_empty(spark):
    rows, items = cases()
    table, docs = spark.createDataFrame(items, "item_id long, text string"), make_docs(spark, rows)
    assert leaked_items(spark.createDataFrame([], DOC), table).count() == 0
    assert leaked_items(docs, table.limit(0)).count() == 0
    assert without_leaks(docs, table.limit(0)).count() == len(rows)


def test_repeated_words_do_not_multiply():
    """An item of one word 2,000 times against a text of it 1,000,000 bytes long: places are never paired."""
    import tracemalloc

    import pyarrow as pa

    from tessera.llm.decontaminate import Seeds, _hits

    item, text = "echo " * 2000, "echo " * 200_000
    seeds = Seeds([(1, item), (2, "some other words that never come up here")], 5)
    tracemalloc.start()
    got = list(_hits(pa.array([text, "echo " * 1500, item + "end", None, text]), seeds, 5, 80, {}))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(r, j, c) for r, j, c, _, _ in got] == [(0, 0, 1.0), (2, 0, 1.0), (4, 0, 1.0)]
    assert peak < 300 << 20  # some numbers for each word of three texts, whatever the item's length


def test_very_long_texts(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    item = " ".join(r.choices(words, k=40))
    long = " ".join(r.choices(words, k=150_000))
    docs = make_docs(spark, [(1, long), (2, f"{long} {item}"), (3, f"{item[:100]} {long}")])
    table = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [(x.doc_id, x.item_id, x.coverage) for x in leaked_items(docs, table).collect()] == [(2, 7, 1.0)]
