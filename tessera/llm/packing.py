"""Packing of token pieces into sequences by a configuration linear program.

Only the histogram of piece lengths (at most ``capacity`` numbers) reaches the
driver. The program over patterns (multisets of lengths that fit a sequence)
is solved by multiplicative weights: a length weighs more the less of it is
covered, and the best pattern under these prices comes from a knapsack dynamic
program over capacities. The fractional solution is scaled down to what there
is, rounded down, and the program is solved anew for what is left: full patterns
only at first, then any if that takes fewer sequences; the last few pieces are
placed best-fit decreasing. Pieces are then numbered within
their length, and a piece's number says which copy of which pattern it fills.

Null text counts as empty: one piece that is the end id alone. Every row is
packed for itself, so repeated or null ``doc_id`` values are fine. Columns
besides ``doc_id`` and ``text`` are not read. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import release
from tessera.llm.kernels import portions, prefix_sums, ranges, text_arrays, word_hash
from tessera.llm.ranking import number_within
from tessera.llm.token_counts import load
from tessera.session import materialize, ship_package

PIECES = 1 << 19
"""Pre-tokens whose ids a worker keeps at a time."""

# Byte classes of lower-cased text: blank, letter (also both bytes of U+00C0 to
# U+00FF but for the two signs there), digit, sign. Words with any other byte,
# or with what may open a special token's string, are left to the tokenizer.
_BLANK, _LETTER, _DIGIT, _SIGN, _HARD = range(5)
_CLASS = np.full(256, _HARD, np.uint8)
_CLASS[0x21:0x7F] = _SIGN
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER
_CLASS[[0x09, 0x0A, 0x0D, 0x20]] = _BLANK
# The endings that the pre-token pattern splits off with their apostrophe.
_ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
# The byte alphabet of byte-level BPE: printable Latin-1 stands for itself, the rest from U+0100 on.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_ALPHABET = {b: b for b in _PLAIN} | {b: 0x100 + i for i, b in enumerate(x for x in range(256) if x not in set(_PLAIN))}


def _spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends, whether hard) of the pre-tokens of texts."""
    n = len(data)
    low, cls = data.copy(), _CLASS[data]
    upper = (data >= 0x41) & (data <= 0x5A)
    low[upper] += 32
    lead = np.flatnonzero(data[:-1] == 0xC3)
    second = data[lead + 1]
    lead = lead[(second >= 0x80) & (second != 0x97) & (second != 0xB7)]
    cls[lead] = cls[lead + 1] = _LETTER
    capital = lead[data[lead + 1] <= 0x9E] + 1
    low[capital] += 32
    low[upper & (cls == _HARD)] -= 32
    cls[np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))] = _HARD

    edge = np.zeros(n + 1, bool)
    edge[off] = True
    cut = edge.copy()
    cut[1:n] |= (cls[1:] != cls[:-1]) | (cls[1:] == _DIGIT)
    # an apostrophe right before one of the endings takes it along; n't and the like don't occur here
    for a in np.flatnonzero((data == 0x27) & cut[:n]).tolist():
        if a + 1 < n and cut[a + 1] and not edge[a + 1] and cls[a + 1] == _LETTER:
            for e in _ENDINGS:
                z = a + 1 + len(e)
                if z <= n and low[a + 1 : z].tobytes() == e and not edge[a + 1 : z].any():
                    cut[a + 1] = False
                    cut[z] = True
                    break
    if (cls == _HARD).any():
        blank = cls == _BLANK
        word = edge.copy()
        word[1:n] |= blank[1:] != blank[:-1]
        at = np.flatnonzero(word)
        size = np.diff(at)
        hard = np.repeat(np.add.reduceat((cls == _HARD).astype(np.int64), at[:-1]) > 0, size)
        hard &= ~blank
        cut[:n] &= ~hard | word[:n]
        low[hard] = data[hard]
    else:
        hard = np.zeros(n, bool)
    at = np.flatnonzero(cut)
    start, end = at[:-1], at[1:]
    keep = cls[start] != _BLANK
    start, end = start[keep], end[keep]
    return low, start, end, hard[start]


def id_arrays(path: str):
    """``(bytes, offsets) of texts -> (ids, first id of each text)`` for a lower-casing BPE that drops blanks.

    Pre-tokens are found for all texts at once, gathered by a hash, compared
    byte by byte with the one that stands for them, and remembered by their
    bytes; each is encoded once while it is remembered.
    """
    tok, known = load(path), {}
    store, used = np.zeros(1 << 20, np.uint32), 0
    bounds = np.zeros(1 << 16, np.int64)  # where the ids of each remembered pre-token begin, and where the last ends

    def learn(keys: list[bytes], pieces: list[bytes], hard: list[bool]) -> None:
        nonlocal store, used, bounds
        for h, p, odd in zip(keys, pieces, hard, strict=True):
            if odd:
                ids = tok.encode(p.decode(), add_special_tokens=False).ids
            else:
                ids = [t.id for t in tok.model.tokenize(p.decode("latin-1").translate(_ALPHABET))]
            if used + len(ids) > len(store):
                store = np.concatenate([store, np.zeros(max(len(store), len(ids)), np.uint32)])
            store[used : used + len(ids)] = ids
            used += len(ids)
            known[h] = len(known)
            if len(known) == len(bounds):
                bounds = np.concatenate([bounds, np.zeros(len(bounds), np.int64)])
            bounds[len(known)] = used

    def run(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nonlocal used
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        low, start, end, hard = _spans(data, off)
        h = word_hash(prefix_sums(low), start, end) ^ hard.astype(np.uint64)
        _, first, code = np.unique(h, return_index=True, return_inverse=True)
        size = end - start
        alike = (size == size[first][code]) & (hard == hard[first][code])
        at = ranges(start, np.where(alike, size, 0))
        differ = np.flatnonzero(low[at] != low[ranges(start[first][code], np.where(alike, size, 0))])
        if len(differ):
            alike[np.searchsorted(start, at[differ], side="right") - 1] = False
        odd = np.flatnonzero(~alike)  # another string under one hash stands for itself
        code[odd] = len(first) + np.arange(len(odd))
        first = np.concatenate([first, odd])
        raw = low.tobytes()
        keys = [raw[a:b] + (b"!" if x else b".") for a, b, x in zip(start[first].tolist(), end[first].tolist(), hard[first].tolist(), strict=True)]
        if len(known) + len(keys) > PIECES:
            known.clear()
            used = 0
        fresh = list({k: i for i, k in enumerate(keys) if k not in known}.values())
        if fresh:
            learn([keys[i] for i in fresh], [keys[i][:-1] for i in fresh], hard[first[fresh]].tolist())
        place = np.array([known[k] for k in keys], np.int64)[code]
        size = bounds[place + 1] - bounds[place]
        ids = store[ranges(bounds[place], size)]
        return ids, np.concatenate([[0], np.cumsum(size)])[np.searchsorted(start, off)]

    return run


def _pieces(path: str, capacity: int, end_id: int):
    names = ("doc_id", "piece", "start", "length", "ids_crc32")

    def run(batches):
        ids_of, end, step = id_arrays(path), int(end_id).to_bytes(4, "little"), 4 * capacity
        for b in batches:
            docs = b.column(0).to_pylist()
            data, off = text_arrays(b.column(1))
            for lo, hi in portions(off):
                got, cut = ids_of(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                raw, out = got.astype("<u4", copy=False).tobytes(), []
                for doc, a, z in zip(docs[lo:hi], (cut[:-1] * 4).tolist(), (cut[1:] * 4).tolist(), strict=True):
                    ids = raw[a:z] + end
                    for i, at in enumerate(range(0, len(ids), step)):
                        part = ids[at : at + step]
                        out.append((doc, i, at // 4, len(part) // 4, zlib.crc32(part)))
                cols = zip(*out, strict=True) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n in ("piece", "length") else pa.int64()) for n, c in zip(names, cols, strict=True)], names=list(names))
            del data, off, b
            release()

    return run


def knapsack(price: np.ndarray, capacity: int) -> Counter:
    """The multiset of lengths (1 .. len(price)-1) of greatest price within the capacity."""
    best = np.zeros(capacity + 1)
    pick = np.zeros(capacity + 1, np.int64)
    m = len(price) - 1
    for c in range(1, capacity + 1):
        k = min(m, c)
        # best[c - l] + price[l] for l = 1 .. k
        value = best[c - k : c][::-1] + price[1 : k + 1]
        i = int(value.argmax())
        if value[i] > best[c - 1]:
            best[c], pick[c] = value[i], i + 1
        else:
            best[c] = best[c - 1]
    out, c = Counter(), capacity
    while c > 0:
        if pick[c]:
            out[int(pick[c])] += 1
            c -= int(pick[c])
        else:
            c -= 1
    return out


def _fractional(left: np.ndarray, capacity: int, rounds: int) -> list[tuple[Counter, float]]:
    """Patterns and how often to use each so that no length is used more than ``left``."""
    have = left > 0
    size = np.arange(len(left)) * have
    cover, uses = np.zeros(len(left)), Counter()
    rate = 4.0
    found: dict = {}
    total = float((left * np.arange(len(left))).sum())
    for _ in range(rounds):
        lag = np.zeros(len(left))
        lag[have] = cover[have] / left[have]
        weight = np.exp(-rate * (lag - lag[have].mean()) / max(lag.max(), 1e-12)) if lag.max() > 0 else np.ones(len(left))
        # a length of which few pieces are left can't stand in a pattern more often than that
        pattern = knapsack(size * weight, capacity)
        key = tuple(sorted(pattern.items()))
        found[key] = pattern
        step = max(1.0, 0.5 * min(left[l] / a for l, a in pattern.items()) / 4, total / capacity / rounds / 4)
        uses[key] += step
        for l, a in pattern.items():
            cover[l] += a * step
    over = max((cover[l] / left[l] for l in np.flatnonzero(cover)), default=1.0)
    return [(found[k], n / over) for k, n in uses.items()]


def _fill(pattern: Counter) -> int:
    return sum(l * a for l, a in pattern.items())


def _rounded(left: np.ndarray, patterns: list[tuple[Counter, float]]) -> Counter:
    """Whole copies of the patterns, in turn, as many as ``left`` has pieces for; takes them off it."""
    out: Counter = Counter()
    for pattern, n in patterns:
        n = min(int(n), *(int(left[l]) // a for l, a in pattern.items()))
        if n > 0:
            out[tuple(sorted(pattern.items()))] += n
            for l, a in pattern.items():
                left[l] -= a * n
    return out


def solve(histogram: dict[int, int], capacity: int, rounds: int = 96) -> list[tuple[dict[int, int], int]]:
    """(pattern, copies) that place every piece exactly once."""
    left = np.zeros(capacity + 1, np.int64)
    for l, n in histogram.items():
        left[l] = n
    plan: Counter = Counter()
    if left[capacity]:
        plan[((capacity, 1),)] = int(left[capacity])
        left[capacity] = 0
    words = lambda: int((left * np.arange(capacity + 1)).sum())
    while (before := words()) >= 64 * capacity:
        patterns = sorted(_fractional(left, capacity, rounds), key=lambda x: -x[1])
        # a pattern with room left waits for what the next program offers
        plan += _rounded(left, [(p, n) for p, n in patterns if _fill(p) >= capacity - 1])
        if before - words() < before // 64:
            break
    # no full patterns any more: the program's as they are, unless best-fit alone takes fewer sequences
    alone, some = _best_fit(left, capacity), Counter()
    while (before := words()) > 0:
        some += _rounded(left, sorted(_fractional(left, capacity, rounds), key=lambda x: (-_fill(x[0]), -x[1])))
        if before - words() <= before // 8:
            break
    some += _best_fit(left, capacity)
    plan += min(alone, some, key=Counter.total)
    return [(dict(k), n) for k, n in sorted(plan.items())]


def _best_fit(left: np.ndarray, capacity: int) -> Counter:
    """Best-fit decreasing on a histogram: equal states of sequences are handled together."""
    open_by_room: dict[int, Counter] = {}
    rooms = np.zeros(capacity + 1, bool)
    for l in range(capacity, 0, -1):
        n = int(left[l])
        while n > 0:
            fits = np.flatnonzero(rooms[l:])
            if len(fits):
                room = l + int(fits[0])
                states = open_by_room[room]
                key, have = next(iter(states.items()))
                use = min(have, n)
                states[key] -= use
                if not states[key]:
                    del states[key]
                if not states:
                    rooms[room] = False
            else:
                room, key, use = capacity, (), max(1, n // (capacity // l))
            new = dict(key)
            new[l] = new.get(l, 0) + 1
            open_by_room.setdefault(room - l, Counter())[tuple(sorted(new.items()))] += use
            rooms[room - l] = True
            n -= use
    out: Counter = Counter()
    for states in open_by_room.values():
        out.update(states)
    return out


def _place(plan: list[tuple[dict[int, int], int]]):
    """Number within length -> sequence and offset, as sorted arrays (bounded by the patterns)."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for pattern, copies in plan:
        offset = 0
        for l, a in sorted(pattern.items(), reverse=True):
            rows.append(((l << 48) | used[l], l, a, sequence, offset))
            used[l] += a * copies
            offset += a * l
        sequence += copies
    rows.sort()
    key, length, a, base, offset = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 5

    def run(batches):
        for b in batches:
            l, r = b.column(3).to_numpy().astype(np.int64), b.column(b.schema.get_field_index("number")).to_numpy()
            i = np.searchsorted(key, (l << 48) | r, side="right") - 1
            nth = r - (key[i] & ((1 << 48) - 1))
            cols = [b.column(c) if c != 3 else pa.array(l) for c in range(5)]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(base[i] + nth // a[i]), pa.array(offset[i] + nth % a[i] * l)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack_sequences(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    ship_package(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = materialize(src.mapInArrow(_pieces(tokenizer, capacity, end_id), "doc_id long, piece int, start long, length int, ids_crc32 long"), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    numbered = number_within(pieces, "length", ["doc_id", "piece", "ids_crc32"], "number")
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number")
    return numbered.mapInArrow(_place(solve(histogram, capacity)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
