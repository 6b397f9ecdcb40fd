"""Probabilistic suffix tree over words.

A state is a context of zero, one or two words. A context that the training
texts hold often enough is a candidate; it becomes a state if its next-word
distribution diverges enough from that of its suffix, measured on each
occurrence with that occurrence left out and summed over all. A state's
distribution is smoothed towards its suffix's, with the strength (of a few)
that explains the left-out occurrences best. A word is scored by the longest
suffix of what stands before it that is a state.

Blocks hold their documents as word numbers of their own vocabulary. Counts
travel by key exchange: words first, then the pairs whose first word is a
candidate, then the triples whose first two words are one, and between them
the sums of the divergence tests; a block gets the totals for its own keys
only, so nothing that grows with the vocabulary is broadcast. The owners of
words and of candidate pairs number them, and a pair or triple travels as the
numbers of its two parts. One with a part that no other block holds does not
travel, as its block has all its occurrences, nor one with a part that the
training texts lack. Numbers are small for what is frequent, and one block
reports the divergence of each pair or triple that occurs more than once.

Lower-cases A-Z; words are ``[^\\x20\\x09-\\x0D]+``, and each text ends with one
end token. Null, empty and blank texts are the end token alone. Texts with
crc32(doc_id as text) mod ``parts`` equal to ``out`` are held out of training;
a null doc_id counts as the empty string. Every row counts for itself.
Columns besides doc_id and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from tessera.llm import blocks as B
from tessera.llm.kernels import U64, mix, portions, text_arrays, words
from tessera.session import materialize

CONTEXT, SHARE = 64, 0.0
"""Training occurrences that make a context a candidate, at every size: no share of the tokens is asked for."""
GAIN = 32.0
"""Divergence from the suffix's distribution, in nats over all occurrences, that makes it a state."""
STRENGTHS = (20.0, 200.0, 2000.0)
"""Occurrences that the suffix's opinion counts for."""
STEP = 2.0**-16
"""Nats; divergences are summed in whole steps, so the order of the sum does not matter."""
TEXT_BYTES = 3 * B.BLOCK_BYTES
"""Text bytes of a block: larger ones hold fewer distinct pairs and triples a byte."""
_STRENGTH = np.array([0.0, *STRENGTHS])
_END = U64(0x2545F4914F6CDD1D)
_KIND = 20  # answers of one exchange are told from another's by dest >> _KIND
_ODD = U64(0x9E3779B97F4A7C15)


def _scatter(x: np.ndarray, bits: int) -> np.ndarray:
    """Numbers of so many bits as others of as many, one to one, from the highest of 64 bits on: keys that fill the ranges evenly."""
    mask, half = U64((1 << bits) - 1), U64(max(1, bits // 2))
    x = x.astype(U64)
    for _ in range(3):
        x = x * _ODD & mask
        x ^= x >> half
    return x << U64(64 - bits)


def _join(left: np.ndarray, right: np.ndarray, left_bits: int, right_bits: int) -> np.ndarray:
    """Keys of pairs of numbers; hashed where the pair does not fit 64 bits."""
    left, right = left.astype(U64), right.astype(U64)
    if left_bits + right_bits <= 64:
        return left << U64(right_bits) | right
    return mix(left * _ODD + mix(right))


def _by_count(count: np.ndarray) -> np.ndarray:
    """Places by falling counts: what is frequent gets small numbers, which pack well."""
    return np.argsort(-count.astype(np.int64), kind="stable")


def _by_owner(number: np.ndarray, dests: int) -> np.ndarray:
    """Places by the numbers' owners, and then by number."""
    return np.lexsort((number, number % dests))


def _send_numbers(block: int, number: np.ndarray, dests: int, values: list[np.ndarray]) -> list[tuple]:
    """Rows that carry numbers (in the order of ``_by_owner``) and their values to the owners."""
    cut, out = np.searchsorted(number % dests, np.arange(dests + 1)), []
    for d in range(dests):
        lo, hi = int(cut[d]), int(cut[d + 1])
        if hi > lo:
            out.append((block, d, B.frames([B.squeeze_sorted((number[lo:hi] // dests).astype(U64)), *(B.squeeze(v[lo:hi]) for v in values)])))
    return out


def _send_pairs(block: int, left: np.ndarray, right: np.ndarray, dests: int, value: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """Rows that carry pairs of numbers and their values to the owners of the pairs; and the order they are sent in.

    The owner of a pair follows from a hash of the left number and the right
    one's remainder, so a frequent left or right one has all ranges, and a
    message need not tell the remainder. Lefts ascend, and so do the rights of
    a left, which are told as differences.
    """
    left, right = left.astype(U64), right.astype(U64)
    dest = ((mix(left * _ODD) % U64(dests) + right) % U64(dests)).astype(np.int64)
    order = np.lexsort((right, left, dest))
    left, right, dest, value = left[order], right[order] // U64(dests), dest[order], value[order]
    cut, out = np.searchsorted(dest, np.arange(dests + 1)), []
    for d in range(dests):
        lo, hi = int(cut[d]), int(cut[d + 1])
        if hi > lo:
            same = left[lo + 1 : hi] == left[lo : hi - 1]
            step = right[lo:hi].copy()
            step[1:][same] -= right[lo : hi - 1][same]
            out.append((block, d, B.frames([B.squeeze_sorted(left[lo:hi]), B.squeeze(step), B.squeeze(value[lo:hi])])))
    return order, out


def _told_pairs(bits: int):
    """Keys and values of a message of pairs; rights have so many bits."""

    def read(parts: list[bytes]) -> tuple[np.ndarray, bytes]:
        left, step = B.unsqueeze_sorted(parts[0]), B.unsqueeze(parts[1], U64)
        if not len(left):
            return left, parts[2:]
        at = np.flatnonzero(np.diff(left, prepend=~left[:1]))
        total = np.cumsum(step)
        right = total - np.repeat(total[at] - step[at], np.diff(at, append=len(left)))
        return _join(left, right, 64 - bits, bits), parts[2:]

    return read


def _make(parts: int, out: int):
    def make(block: int, t: pa.Table) -> dict:
        data, off = text_arrays(t.column("text"))
        cols = []
        for lo, hi in portions(off):
            h, _, first = words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            cols.append((h, np.diff(first)))
        h = np.concatenate([c[0] for c in cols])
        n = np.concatenate([c[1] for c in cols])
        ends = np.cumsum(n + 1) - 1
        token = np.full(len(h) + len(n), _END)
        inner = np.ones(len(token), bool)
        inner[ends] = False
        token[inner] = h
        vocab, code = np.unique(token, return_inverse=True)
        ids = ["" if i is None else str(i) for i in t.column("doc_id").to_pylist()]
        held = np.array([zlib.crc32(i.encode()) % parts == out for i in ids])
        train = np.repeat(~held, n + 1)
        count = np.bincount(code[train], minlength=len(vocab)).astype(np.uint32)
        head = B.pack(doc_id=t.column("doc_id"), held=held, n=(n + 1).astype(np.int64))
        rank = np.empty(len(vocab), np.uint32)
        rank[_by_count(count)] = np.arange(len(vocab))
        known = B.squeeze(count)
        return {
            "payload": B.frames([head, B.squeeze_sorted(vocab), B.squeeze(rank[code]), known]),
            "known": known,
            "n_train": int(train.sum()),
        }

    return make


def _send_words(dests: int):
    def run(batches):
        for b in batches:
            for block, payload, known in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                vocab = B.unsqueeze_sorted(B.unframe(payload)[1])
                yield B.rows(B.send(block, vocab, dests, B.unsqueeze(known, np.uint32)))

    return run


class _Block:
    """What a block holds and what it was told so far."""

    def __init__(self, blocks: pa.Table, told: pa.Table, dests: int, bits: dict):
        head, vocab, code, known = B.unframe(blocks.column("payload")[0].as_py())
        self.block = blocks.column("block")[0].as_py()
        self.head = B.unpack(head)
        self.vocab = B.unsqueeze_sorted(vocab)
        self.code = _by_count(B.unsqueeze(known, np.uint32))[B.unsqueeze(code, np.uint32)]
        n = self.head.column("n").to_numpy()
        self.doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
        self.place = np.arange(len(self.code), dtype=np.int32) - np.repeat((np.cumsum(n) - n).astype(np.int32), n)
        self.train = ~self.head.column("held").to_numpy()[self.doc]
        self.told, self.dests, self.bits = told, dests, bits
        self.count, self.id, self.shared, self.first = self._numbered(0, np.uint64, 1)  # of each word of the vocabulary

    def _of_kind(self, kind: int) -> pa.Table:
        return self.told.filter(pa.compute.equal(pa.compute.shift_right(self.told.column("dest"), _KIND), kind))

    def _answer(self, kind: int, dtype) -> np.ndarray:
        return B.answers(self._of_kind(kind), dtype)

    def _numbered(self, kind: int, dtype, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """In the order of the keys sent: counts, numbers of those of ``least`` occurrences (others -1), which other blocks hold too, and which this block reports."""
        t = self._of_kind(kind).sort_by("dest")
        count, own, shared, first = [np.zeros(0, dtype)], [np.zeros(0, np.int64)], [np.zeros(0, bool)], [np.zeros(0, bool)]
        for d, p in zip(t.column("dest").to_pylist(), t.column("payload").to_pylist(), strict=True):
            n, *numbers, lead = B.unframe(p)
            count.append(B.unsqueeze(n, dtype))
            if numbers:
                i = np.full(len(count[-1]), -1, np.int64)
                has = np.flatnonzero(count[-1] >= least)
                i[has[B.by_size(count[-1][has])]] = B.unsqueeze_sorted(numbers[0], np.uint32).astype(np.int64) * self.dests + (d & ((1 << _KIND) - 1))
                own.append(i)
                shared.append(np.unpackbits(B.unsqueeze(numbers[1], np.uint8), count=len(i)).astype(bool))
            twice = np.flatnonzero(count[-1] > 1)
            first.append(np.zeros(len(count[-1]), bool))
            first[-1][twice] = np.unpackbits(B.unsqueeze(lead, np.uint8), count=len(twice))
        return np.concatenate(count), np.concatenate(own), np.concatenate(shared), np.concatenate(first)

    def _unique(self, at: np.ndarray, left: np.ndarray):
        """Distinct (context, next word) at these places, and which each place has; training occurrences of each."""
        both, own = np.unique(left << 32 | self.code[at], return_inverse=True)
        return both >> 32, both & 0xFFFFFFFF, own, np.bincount(own[self.train[at]], minlength=len(both))

    def pairs(self) -> None:
        """Places whose word before is a candidate context; of their pairs, those to ask for, and what to send."""
        before = np.concatenate([[0], self.code[:-1]]) if len(self.code) else self.code
        self.at2 = np.flatnonzero((self.place >= 1) & (self.count[before] >= CONTEXT))
        self.left2, self.right2, self.own2, self.local2 = self._unique(self.at2, before[self.at2])
        known = self.shared & (self.count > 0)
        ask = np.flatnonzero(known[self.left2] & known[self.right2])
        order, self.sent2 = _send_pairs(self.block, self.id[self.left2[ask]], self.id[self.right2[ask]], self.dests, self.local2[ask].astype(np.uint32))
        self.ask2 = ask[order]

    def pair_counts(self) -> None:
        self.count2, self.id2, self.shared2 = self.local2.astype(float), np.full(len(self.left2), -1), np.zeros(len(self.left2), bool)
        self.first2 = np.ones(len(self.left2), bool)
        self.count2[self.ask2], self.id2[self.ask2], self.shared2[self.ask2], self.first2[self.ask2] = self._numbered(1, np.uint32, CONTEXT)

    def triples(self) -> None:
        """Places whose two words before are a candidate context; of their triples, those to ask for, and what to send."""
        pair_of = np.full(len(self.code) + 1, -1, np.int64)
        pair_of[self.at2 + 1] = self.own2  # the pair that ends right before a place
        left = pair_of[self.at2]
        ok = (self.place[self.at2] >= 2) & (left >= 0) & (self.count2[left] >= CONTEXT)
        self.in2 = np.flatnonzero(ok)  # among the places of pairs
        self.left3, self.right3, self.own3, self.local3 = self._unique(self.at2[ok], left[ok])
        self.pair3 = np.zeros(len(self.left3), np.int64)  # each triple's own pair (second and third word)
        self.pair3[self.own3] = self.own2[self.in2]
        ask = np.flatnonzero(self.shared2[self.left3] & self.shared2[self.pair3] & (self.count2[self.pair3] > 0))
        order, self.sent3 = _send_pairs(self.block, self.id2[self.left3[ask]], self.id[self.right3[ask]], self.dests, self.local3[ask].astype(np.uint32))
        self.ask3 = ask[order]

    def triple_counts(self) -> None:
        self.count3 = self.local3.astype(float)
        self.first3 = np.ones(len(self.left3), bool)
        self.count3[self.ask3], _, _, self.first3[self.ask3] = self._numbered(3, np.uint32, CONTEXT)

    def states1(self) -> None:
        """Strength of each word as a context; 0: no state."""
        used = np.unique(self.left2)
        order = _by_owner(self.id[used], self.dests)
        self.state1 = np.zeros(len(self.vocab))
        self.state1[used[order]] = _STRENGTH[self._answer(2, np.uint8)]

    def gains2(self, p1: np.ndarray) -> None:
        """Divergence of each two-word context here, those shared with other blocks in the order of their keys, and the rest."""
        used, sums = _sums(self.left3, _gains(self.count3, self.first3, p1[self.pair3]), self.count2, self.first2)
        alone = ~self.shared2[used]
        self.alone2, self.verdict2 = used[alone], _verdict(*(s[alone] for s in sums))
        self.used2, sums = used[~alone], [s[~alone] for s in sums]
        order = _by_owner(self.id2[self.used2], self.dests)
        self.used2, self.gain2 = self.used2[order], [s[order] for s in sums]

    def states2(self) -> np.ndarray:
        """Strength of each pair as a context; 0: no state."""
        state2 = np.zeros(len(self.left2))
        state2[self.alone2] = _STRENGTH[self.verdict2]
        state2[self.used2] = _STRENGTH[self._answer(4, np.uint8)]
        return state2

    def base(self, total: int, distinct: int) -> np.ndarray:
        return (self.count.astype(float) + 1.0) / (total + distinct + 1.0)

    def after1(self, p0: np.ndarray) -> np.ndarray:
        """P(next | one word) of each distinct pair, by the suffix where the word is no state."""
        s = self.state1[self.left2]
        return np.where(s > 0, (self.count2 + s * p0[self.right2]) / (self.count[self.left2] + s), p0[self.right2])


def _gains(count, first, below) -> list[np.ndarray]:
    """What this block reports of each distinct event: the occurrences' log gain over ``below``, each left out of its count.

    That is log((n - 1 + s p) / ((c - 1 + s) p)) for an event of n of a
    context's c occurrences. Taken as log((n - 1 + s p) / (s p)) less
    log((c - 1 + s) / s), the first is 0 for events that occur once, and the
    second is the context's alone (``_sums``). One block reports an event.
    """
    told = first & (count > 1)
    n, p = count[told], below[told]
    out = []
    for s in STRENGTHS:
        g = np.zeros(len(count))
        g[told] = n * np.log((n - 1 + s * p) / (s * p))
        out.append(g)
    return out


def _sums(of: np.ndarray, gains: list[np.ndarray], context: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The contexts, and the sums of their gains in steps; the block that reports a context takes off what is its own."""
    used, at = np.unique(of, return_inverse=True)
    c = np.where(first[used], context[used].astype(float), 0.0)
    own = [c * np.log((np.maximum(c, 1) - 1 + s) / s) for s in STRENGTHS]
    return used, [np.rint((np.bincount(at, weights=g, minlength=len(used)) - o) / STEP).astype(np.int64) for g, o in zip(gains, own, strict=True)]


def _verdict(*total: np.ndarray) -> np.ndarray:
    """0, or 1 + the strength that gains most where that is enough."""
    all_ = np.stack(total)
    return np.where(all_.max(0) >= GAIN / STEP, all_.argmax(0) + 1, 0).astype(np.uint8)


def _shift(items: list[tuple], kind: int) -> list[tuple]:
    return [(b, (kind << _KIND) | d, p) for b, d, p in items]


def _pass(step: str, dests: int, total: int, distinct: int, bits: dict):
    def run(blocks: pa.Table, told: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return B.table([])
        b = _Block(blocks, told, dests, bits)
        b.pairs()
        if step == "pairs":
            return B.table(_shift(b.sent2, 1))
        b.pair_counts()
        b.triples()
        p0 = b.base(total, distinct)
        if step == "triples":
            out = _shift(b.sent3, 3)
            used, sums = _sums(b.left2, _gains(b.count2, b.first2, p0[b.right2]), b.count, b.first)
            order = _by_owner(b.id[used], dests)
            return B.table(out + _shift(_send_numbers(b.block, b.id[used[order]], dests, [s[order] for s in sums]), 2))
        b.triple_counts()
        b.states1()
        p1 = b.after1(p0)
        b.gains2(p1)
        if step == "gains":
            return B.table(_shift(_send_numbers(b.block, b.id2[b.used2], dests, b.gain2), 4))
        p = p0[b.code]
        p[b.at2] = p1[b.own2]
        s = b.states2()[b.left3]
        p3 = np.where(s > 0, (b.count3 + s * p1[b.pair3]) / (b.count2[b.left3] + s), p1[b.pair3])
        p[b.at2[b.in2]] = p3[b.own3]
        n = b.head.num_rows
        add = lambda w: np.bincount(b.doc, weights=w, minlength=n)
        return pa.table(
            {
                "doc_id": b.head.column("doc_id"),
                "held_out": b.head.column("held"),
                "n_tokens": b.head.column("n"),
                "n_known": pa.array(add((b.count[b.code] > 0).astype(float)).astype(np.int64)),
                "train_tokens": pa.array(np.full(n, total, np.int64)),
                "base_score": pa.array(add(np.log10(p0[b.code]))),
                "score": pa.array(add(np.log10(p))),
            }
        )

    return run


def score_documents(docs: DataFrame, parts: int = 7, out: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) of each row."""
    from pyspark.sql import functions as F

    blocks, size = B.document_blocks(docs, "suffix_tree", _make(parts, out), "known binary, n_train long", TEXT_BYTES)
    dests = B.destinations(size)
    total = int(blocks.agg(F.sum("n_train")).first()[0] or 0)
    texts = blocks.select("block", "payload")
    bits: dict[str, int] = {}

    def each(step: str) -> DataFrame:
        return B.with_blocks(texts, told, _pass(step, dests, total, distinct, dict(bits)), B.PAYLOAD)

    def numbered(sent: DataFrame, name: str, least: int, **how) -> tuple[DataFrame, int]:
        """What is told, how many keys have so many occurrences; and the bits of their numbers."""
        got = materialize(B.sum_keys(sent, once=lambda n: int((n >= least).sum()), number=lambda n: n >= least, **how), f"{name}s")
        each_range = [int(B.unsqueeze(r["payload"], np.int64)[0]) for r in got.where("block < 0").select("payload").collect()]
        bits[name] = max(1, (max(each_range, default=0) * dests + dests).bit_length())
        return got.where("block >= 0"), sum(each_range)

    sent = blocks.select("block", "payload", "known").mapInArrow(_send_words(dests), B.PAYLOAD)
    told, distinct = numbered(sent, "word", 1)
    read = _told_pairs(max(1, bits["word"] - (dests.bit_length() - 1)))
    told = told.unionByName(numbered(each("pairs"), "pair", CONTEXT, wide=np.uint32, read=read)[0])
    counts = B.adder(wide=np.uint32, read=read, first=True)
    gains = B.adder(np.int64, np.int64, _verdict, len(STRENGTHS))

    def either(t: pa.Table) -> pa.Table:
        return (counts if t.column("dest")[0].as_py() >> _KIND == 3 else gains)(t)

    told = told.unionByName(materialize(B.by_range(each("triples"), either), "triples"))
    told = told.unionByName(materialize(B.by_range(each("gains"), gains), "states"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return B.with_blocks(texts, told, _pass("score", dests, total, distinct, dict(bits)), schema)
