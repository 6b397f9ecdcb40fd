"""Benchmark passages in documents, by greedy string tiling.

Documents and test items meet where they share a seed, a run of ``size``
words. Where the seeds that a document shares with an item could cover enough
of it, the two are tiled: the longest match of unmarked words is found by a
running Karp-Rabin hash over lengths, matches of that length are marked so
that none overlap, and so on down to ``size`` words. An item has leaked into a
document if its tiles cover at least ``percent`` of its words, in whatever
order they stand there.

Documents are read once, in place, for each slice of the items; a slice holds
at most ``SLICE_WORDS`` words, so what a task gets of the items is bounded
however many there are. Words are runs of letters and digits (all of U+0080 on
counts as letters), A-Z and U+00C0 to U+00DE lower-cased, so that signs strewn
into a passage or capitals don't hide it. An
item with fewer than ``size`` words is a seed as a whole; null, empty and
blank items leak nowhere, and such documents hold nothing. Rows count for
themselves: repeated ``doc_id`` values give rows each, a null one is kept as
null. Repeated items are reported each. Columns besides ``doc_id``, ``text``,
``item_id`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import release
from tessera.llm.kernels import U64, merge_spans, mix, portions, ranges, shingle_hash, text_arrays, words
from tessera.session import ship_package

SLICE_WORDS = 1 << 20
"""Words of test items that one pass over the documents takes (16 bytes each and task)."""
_FILTER = 1 << 20
_STEP = 0x9E3779B97F4A7C15


_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
_FOLD[0x41:0x5B] = _FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def _words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, first word of each text) of a column."""
    data, off = text_arrays(col)
    low = _FOLD[data]
    second = np.flatnonzero(low[:-1] == 0xC3) + 1
    low[second[(low[second] <= 0x9E) & (low[second] >= 0x80) & (low[second] != 0x97)]] += 0x20
    h, _, first = words(low, off)
    return h, first


class Seeds:
    """Seeds of a slice of items: each distinct seed with the items that hold it, and where they do.

    ``key``: distinct seeds in order; entries ``first[s] .. first[s + 1]`` of
    seed s name an item each, whose places are ``pos[at[e] : at[e + 1]]``.
    """

    def __init__(self, items: list[tuple[int | None, str]], size: int):
        h, first = _words(pa.array([t for _, t in items], pa.string()))
        self.ids = [i for i, _ in items]
        self.words = [h[first[j] : first[j + 1]] for j in range(len(items))]
        self.length = np.array([min(size, len(w)) for w in self.words], np.int64)
        keys = [shingle_hash(w, int(n)) for w, n in zip(self.words, self.length)]
        self.sizes = sorted({int(n) for n in self.length if n})
        count = np.array([len(k) for k in keys], np.int64)
        key = np.concatenate(keys) if keys else np.zeros(0, U64)
        item = np.repeat(np.arange(len(keys)), count)
        pos = ranges(np.zeros(len(keys), np.int64), count)
        order = np.lexsort((pos, item, key))
        key, item, self.pos = key[order], item[order], pos[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (item[1:] != item[:-1])
        self.at = np.append(np.flatnonzero(new), len(key))
        self.item = item[new]
        self.key, begin = np.unique(key[new], return_index=True)
        self.first = np.append(begin, len(self.item))
        self.maybe = np.zeros(_FILTER, bool)
        self.maybe[(self.key & U64(_FILTER - 1)).astype(np.int64)] = True


def _runs(word: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any run of words is one subtraction."""
    out = np.zeros(len(word) + 1, U64)
    np.cumsum(word * powers[: len(word)], out=out[1:])
    return out


def tiles(item: np.ndarray, doc: np.ndarray, free: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Greedy string tiles (item place, document place, words), longest first.

    ``free``: which words of the document may be matched.
    """
    n, m = len(item), len(doc)
    base = np.full(max(n, m) + 1, U64(_STEP))
    base[0] = 1
    power = np.multiply.accumulate(base)
    inverse = np.full(max(n, m) + 1, U64(pow(_STEP, -1, 1 << 64)))
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    sums = (_runs(item, power), _runs(doc, power))
    used = [np.zeros(n, bool), ~free]
    out: list[tuple[int, int, int]] = []

    def open_runs(side: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the unmarked runs of so many words."""
        s, mark = sums[side], np.concatenate([[0], np.cumsum(used[side])])
        at = np.flatnonzero(mark[length:] == mark[: len(mark) - length])
        return at, mix((s[at + length] - s[at]) * inverse[at])

    def common(length: int):
        if length > n or length > m:
            return None
        (p, x), (q, y) = open_runs(0, length), open_runs(1, length)
        in_doc = np.isin(x, y)
        return (p[in_doc], x[in_doc], q, y) if in_doc.any() else None

    top = min(n, m)
    while top >= size:
        lo, hi = size - 1, top  # the longest match is between these
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if common(mid) else (lo, mid - 1)
        if lo < size:
            break
        p, x, q, y = common(lo)
        order = np.argsort(y, kind="stable")
        y, q = y[order], q[order]
        for i, h in zip(p.tolist(), x, strict=True):
            if used[0][i : i + lo].any():
                continue
            for j in q[np.searchsorted(y, h) : np.searchsorted(y, h, side="right")].tolist():
                if not used[1][j : j + lo].any() and (item[i : i + lo] == doc[j : j + lo]).all():
                    used[0][i : i + lo] = True
                    used[1][j : j + lo] = True
                    out.append((i, j, lo))
                    break
        top = lo - 1 if lo == top else lo
        if not out or out[-1][2] != lo:
            top = lo - 1  # only hashes agreed
    return out


def _hits(col: pa.Array, seeds: Seeds, size: int, percent: int, memo: dict) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item, coverage, tiles, longest tile) for the texts of one column.

    A text's places and an item's places of a seed are never paired: texts and
    items meet by distinct seeds, and each side's places are covered by itself.
    """
    h, first = _words(col)
    if not len(h) or not len(seeds.key):
        return
    found = []
    for n in seeds.sizes:
        g = shingle_hash(h, n)
        at = np.flatnonzero(seeds.maybe[(g & U64(_FILTER - 1)).astype(np.int64)])
        s = np.minimum(np.searchsorted(seeds.key, g[at]), len(seeds.key) - 1)
        row = np.searchsorted(first, at, side="right") - 1
        ok = (seeds.key[s] == g[at]) & (at + n <= first[row + 1])
        found.append((row[ok], s[ok], at[ok], np.full(int(ok.sum()), n)))
    row, s, at, n = (np.concatenate(v) for v in zip(*found, strict=True))
    if not len(row):
        return
    order = np.lexsort((at, s, n, row))
    row, s, at, n = (v[order] for v in (row, s, at, n))
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (s[1:] != s[:-1]) | (n[1:] != n[:-1])
    begin = np.flatnonzero(new)  # places of a text's distinct seed: at[begin[d] : end[d]]
    end = np.append(begin[1:], len(row))
    count = seeds.first[s[begin] + 1] - seeds.first[s[begin]]
    entry, seed = ranges(seeds.first[s[begin]], count), np.repeat(np.arange(len(begin)), count)
    own = seeds.length[seeds.item[entry]] == n[begin][seed]
    entry, seed = entry[own], seed[own]
    item, text = seeds.item[entry], row[begin][seed]
    order = np.lexsort((seed, item, text))
    entry, seed, item, text = (v[order] for v in (entry, seed, item, text))
    if not len(text):
        return
    cut = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1])]))
    for a, b in zip(cut, [*cut[1:], len(text)], strict=True):
        j, r = int(item[a]), int(text[a])
        whole, m = seeds.words[j], int(seeds.length[j])
        e = entry[a:b]
        pos = np.sort(seeds.pos[ranges(seeds.at[e], seeds.at[e + 1] - seeds.at[e])])
        lo, hi = merge_spans(pos, pos + m)
        if 100 * int((hi - lo).sum()) < percent * len(whole):
            continue
        # the words that seeds of this item cover, a gap between each run of them
        d = seed[a:b]
        place = np.sort(at[ranges(begin[d], end[d] - begin[d])])
        lo, hi = merge_spans(place, place + m)
        gap = np.zeros(1, U64)
        doc = np.concatenate([x for u, v in zip(lo.tolist(), hi.tolist(), strict=True) for x in (h[u:v], gap)])
        free = np.ones(len(doc), bool)
        free[np.cumsum(hi - lo + 1) - 1] = False
        key = (j, doc.tobytes())
        got = memo.get(key)
        if got is None:
            if len(memo) > 4096:
                memo.clear()
            tiled = tiles(whole, doc, free, m)
            got = memo[key] = (sum(t[2] for t in tiled), len(tiled), max((t[2] for t in tiled), default=0))
        if 100 * got[0] >= percent * len(whole):
            yield r, j, got[0] / len(whole), got[1], got[2]


def _slices(items: DataFrame) -> Iterator[list[tuple]]:
    """The items in slices of at most SLICE_WORDS words (one longer item has a slice of its own)."""
    held, size = [], 0
    for r in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").toLocalIterator():
        n = len(r[1]) // 2 + 1  # words at most
        if held and size + n > SLICE_WORDS:
            yield held
            held, size = [], 0
        held.append((r[0], r[1]))
        size += n
    if held:
        yield held


_FOUND = "doc_id long, item_id long, coverage double, n_tiles int, longest int"


def leaked_items(docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, longest (words) of each item that leaked into a document."""
    spark = docs.sparkSession
    ship_package(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], _FOUND)
    for part in _slices(items):
        held = spark.sparkContext.broadcast(part)

        def run(batches, held=held):
            seeds, memo = Seeds(held.value, size), {}
            for b in batches:
                for lo, hi in portions(text_arrays(b.column(1))[1]):
                    got = list(_hits(b.column(1).slice(lo, hi - lo), seeds, size, percent, memo))
                    doc = b.column(0).slice(lo, hi - lo)
                    r, j, c, k, m = zip(*got, strict=True) if got else ([],) * 5
                    yield pa.RecordBatch.from_arrays(
                        [doc.take(pa.array(r, pa.int64())), pa.array([seeds.ids[x] for x in j], pa.int64()), pa.array(c, pa.float64()), pa.array(k, pa.int32()), pa.array(m, pa.int32())],
                        names=["doc_id", "item_id", "coverage", "n_tiles", "longest"],
                    )
                release()

        out = out.unionByName(src.mapInArrow(run, _FOUND))
    return out


def without_leaks(docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` into which no item leaked, unchanged and in place."""
    spark = docs.sparkSession
    ship_package(spark)
    at, out = docs.columns.index("text"), docs
    for part in _slices(items):
        held = spark.sparkContext.broadcast(part)

        def run(batches, held=held):
            seeds, memo = Seeds(held.value, size), {}
            for b in batches:
                for lo, hi in portions(text_arrays(b.column(at))[1]):
                    some = b.slice(lo, hi - lo)
                    bad = {r for r, *_ in _hits(some.column(at), seeds, size, percent, memo)}
                    yield some.filter(pa.array([i not in bad for i in range(some.num_rows)], pa.bool_()))
                release()

        out = out.mapInArrow(run, docs.schema)
    return out
