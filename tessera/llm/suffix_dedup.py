"""Exact removal of repeated byte strings by distributed merging of suffixes.

Every ``length``-byte string that also starts earlier (smaller doc_id, or the
same document further left) is removed wherever it is not the first.

Not all suffixes are sorted. A window of ``length`` bytes is represented by
its *anchors*, the ``gram``-byte strings in it with the smallest hash; equal
windows have equal anchors, so it is enough to sort the suffixes at anchors:

1. A key exchange tells each block which of its anchor grams occur more than
   once. The rest cannot be in any repeat (their distinguishing prefix is the
   gram itself) and are not sent.
2. Each block sorts its remaining suffixes, followed by what stands before
   them read backwards, keeps the first of equal ones (the others are repeats
   already) and sends them front-coded to the tasks that own their grams.
3. An owner merges the runs with a loser tree that carries the common prefix
   of each run's head with the last output, so no known prefix is compared
   again. From the merged order's common prefixes, and those of the backward
   strings, each window's class of equals follows without comparing texts;
   all but the first of a class are repeats.
4. Grams that stand in many places (a common line) would give one owner too
   much: their windows are sent singly, hashed to 128 bits and reduced to the
   first of each block, which spreads them over all owners.

Null text is empty. Rows of one doc_id are ordered by their text's checksum,
then by place; a null doc_id comes after all others. Texts shorter than
``length`` lose nothing. Columns besides doc_id, text and the carried ones are
not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import blocks as B
from tessera.llm.kernels import U64, gram_hash, merge_spans, mix, prefix_sums, ranges, sliding, span_hash, text_arrays
from tessera.session import materialize

HOT = 2048
"""Contexts of one gram (counted once in a block) beyond which its windows are sent singly."""
_CHUNK = 1 << 18
_MARK = -1


def anchors(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, gram hash) of the anchors of all windows that lie within one text."""
    n, w = len(data), length - gram + 1
    valid = np.ones(max(0, n - length + 1), bool)
    tail = np.maximum(off[1:] - length + 1, off[:-1])
    bad = ranges(tail, off[1:] - tail)
    valid[bad[bad < len(valid)]] = False
    at, hs = [], []
    for lo in range(0, len(valid), _CHUNK):
        hi = min(lo + _CHUNK, len(valid))
        if not valid[lo:hi].any():
            continue
        h = gram_hash(data[lo : hi + length - 1], gram)
        m = sliding(np.minimum, h, w)
        m[~valid[lo:hi]] = 0
        pad = np.zeros(w - 1, U64)
        most = sliding(np.maximum, np.concatenate([pad, m, pad]), w)
        own = np.flatnonzero((most == h) & (h > 0))
        at.append(own + lo)
        hs.append(h[own])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at, first = np.unique(np.concatenate(at), return_index=True)
    # smallest hashes of windows are small numbers: mixed again, they spread over all owners
    return at, mix(np.concatenate(hs)[first] ^ U64(0x5851F42D4C957F2D))


def _context_hash(data, off, at, length: int, gram: int) -> np.ndarray:
    """Hash of all that a block's windows around an anchor can see (and of how far that reaches)."""
    back = length - gram
    doc = np.searchsorted(off, at, side="right") - 1
    left, right = np.minimum(at - off[doc], back), np.minimum(off[doc + 1] - at, length)
    out = np.empty(len(at), U64)
    for a in range(0, len(data), _CHUNK):
        s, e = np.searchsorted(at, [a, a + _CHUNK])
        if e > s:
            base = max(0, a - back)
            sums = prefix_sums(data[base : a + _CHUNK + length])
            out[s:e] = span_hash(sums, at[s:e] - left[s:e] - base, at[s:e] + right[s:e] - base)
    return out ^ ((left << 8 | right).astype(U64) * U64(0x9E3779B97F4A7C15))


def _grams(data, off, length: int, gram: int):
    """Anchors of a block: place and code of each; per code its hash, places and distinct contexts."""
    at, h = anchors(data, off, length, gram)
    keys, code, count = np.unique(h, return_inverse=True, return_counts=True)
    seen = _context_hash(data, off, at, length, gram)
    order = np.lexsort((seen, code))
    new = np.ones(len(at), bool)
    new[1:] = (code[order][1:] != code[order][:-1]) | (seen[order][1:] != seen[order][:-1])
    return at, code, keys, count, np.bincount(code[order][new], minlength=len(keys)).astype(np.uint32)


def _texts(blocks: pa.Table):
    t = B.unpack(blocks.column("payload")[0].as_py())
    return t, *text_arrays(t.column("text"))


def _send_grams(length: int, gram: int, dests: int):
    def run(batches):
        for b in batches:
            for block, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data, off = text_arrays(B.unpack(payload).column("text"))
                _, _, keys, _, contexts = _grams(data, off, length, gram)
                yield B.rows(B.send(block, keys, dests, contexts))

    return run


def _spans(block: int, start: np.ndarray, end: np.ndarray) -> tuple:
    start, end = merge_spans(start.astype(np.int64), end.astype(np.int64))
    return (block, _MARK, B.frames([B.squeeze(start.astype(np.int64)), B.squeeze((end - start).astype(np.int32))]))


def _doc_order(t: pa.Table, data, off):
    """(doc_id with nulls last, checksum) of each text of a block."""
    ids = t.column("doc_id").combine_chunks()
    doc = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ U64(1 << 63)
    doc[ids.is_null().to_numpy(zero_copy_only=False)] = U64(2**64 - 1)
    crc = np.array([zlib.crc32(data[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)], np.uint32)
    return doc, crc


def _send_suffixes(length: int, gram: int, dests: int, hot: int):
    back = length - gram

    def contexts(data, at, left, right):
        """Rows of ``length`` bytes onwards and ``back`` bytes backwards, zero beyond the text."""
        m = np.zeros((len(at), length + back), np.uint8)
        for c in range(length):
            ok = right > c
            m[ok, c] = data[at[ok] + c]
        for c in range(back):
            ok = left > c
            m[ok, length + c] = data[at[ok] - c - 1]
        return m

    def hot_windows(block, data, at, lo, hi, doc, crc, out):
        """Windows around the anchors (sorted by place), a bounded number at a time."""
        count = np.maximum(0, hi - lo + 1)
        sent = -1
        for cut in np.array_split(np.arange(len(at)), max(1, int(count.sum()) >> 16)):
            n = count[cut]
            start, first = np.unique(ranges(at[cut] - hi[cut], n), return_index=True)
            d, c = np.repeat(doc[cut], n)[first], np.repeat(crc[cut], n)[first]
            fresh = start > sent  # a window of two anchors goes once
            start, d, c = start[fresh], d[fresh], c[fresh]
            if not len(start):
                continue
            sent = int(start[-1])
            h1, h2 = np.empty(len(start), U64), np.empty(len(start), U64)
            for a in range(int(start[0]), sent + 1, _CHUNK):
                s, e = np.searchsorted(start, [a, a + _CHUNK])
                if e > s:
                    own = data[a : a + _CHUNK + length]
                    p, q = start[s:e] - a, start[s:e] - a + length
                    h1[s:e] = span_hash(prefix_sums(own), p, q)
                    h2[s:e] = span_hash(prefix_sums(own ^ np.uint8(0xA5)), p, q)
            order = np.lexsort((start, c, d, h2, h1))
            start, h1, h2, d, c = start[order], h1[order], h2[order], d[order], c[order]
            new = np.ones(len(start), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            rep = start[~new]
            out.append(_spans(block, rep, rep + length))
            out.extend(B.send(block, h1[new], dests, h2[new], d[new], c[new], start[new].astype(np.uint32)))

    def run(blocks: pa.Table, told: pa.Table) -> pa.Table:
        out: list = []
        if not blocks.num_rows or not told.num_rows:
            return B.table(out)
        block = blocks.column("block")[0].as_py()
        t, data, off = _texts(blocks)
        at, code, keys, count, _ = _grams(data, off, length, gram)
        total = B.answers(told, np.uint32)
        keep = ((total > 1) | (count > 1))[code]
        at, code = at[keep], code[keep]
        h, total = keys[code], total[code]
        del keys, count, keep
        if not len(at):
            return B.table(out)
        doc_of = np.searchsorted(off, at, side="right") - 1
        doc, crc = _doc_order(t, data, off)
        doc, crc = doc[doc_of], crc[doc_of]
        left = np.minimum(at - off[doc_of], back)
        right = np.minimum(off[doc_of + 1] - at, length)
        lo, hi = np.maximum(0, length - right), left  # offsets at which a window around the anchor fits
        for which, is_hot in ((total > hot, True), (total <= hot, False)):
            pick = np.flatnonzero(which)
            if not len(pick):
                continue
            if is_hot:
                hot_windows(block, data, at[pick], lo[pick], hi[pick], doc[pick], crc[pick], out)
                continue
            pick = pick[np.lexsort((at[pick], crc[pick], doc[pick]))]
            a, l, r = at[pick], left[pick], right[pick]
            m = contexts(data, a, l, r)
            order = np.argsort(m.view(f"S{m.shape[1]}").ravel(), kind="stable")
            m, a, l, r, pick = m[order], a[order], l[order], r[order], pick[order]
            same = np.zeros(len(m), bool)
            same[1:] = (_common(m)[1:] == m.shape[1]) & (l[1:] == l[:-1]) & (r[1:] == r[:-1])
            rep = same & (lo[pick] <= hi[pick])
            if rep.any():
                out.append(_spans(block, a[rep] - hi[pick][rep], a[rep] - lo[pick][rep] + length))
            same |= total[pick] < 2  # no other block or context has these
            m, a, l, r, pick = m[~same], a[~same], l[~same], r[~same], pick[~same]
            owner = _owner(h[pick], dests)
            by = np.argsort(owner, kind="stable")
            cut = np.searchsorted(owner[by], np.arange(dests + 1))
            for d in range(dests):
                mine = by[cut[d] : cut[d + 1]]
                if len(mine):
                    out.append((block, dests + d, _run(m[mine], a[mine], l[mine], r[mine], doc[pick[mine]], crc[pick[mine]])))
        return B.table(out)

    return run


def _common(m: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the row before (0 for the first)."""
    differ = np.ones((len(m), m.shape[1] + 1), bool)
    differ[1:, :-1] = m[1:] != m[:-1]
    lcp = differ.argmax(1)
    lcp[0] = 0
    return lcp


def _owner(h: np.ndarray, dests: int) -> np.ndarray:
    return ((h >> U64(32)) * U64(dests) >> U64(32)).astype(np.int64)


def _run(m, at, left, right, doc, crc) -> bytes:
    """A front-coded run: common prefixes with the row before, the rest of each row, and the places."""
    lcp = _common(m)
    rest = m[np.arange(m.shape[1]) >= lcp[:, None]]
    cols = (lcp.astype(np.uint8), rest, at.astype(np.uint32), left.astype(np.uint8), right.astype(np.uint8), doc, crc)
    return B.frames([B.squeeze(c) for c in cols])


_RUN_TYPES = (np.uint8, np.uint8, np.uint32, np.uint8, np.uint8, np.uint64, np.uint32)


def _decode(lcp: list[int], rest: bytes, width: int) -> list[bytes]:
    out, at, row = [], 0, b""
    for h in lcp:
        end = at + width - h
        row = row[:h] + rest[at:end]
        at = end
        out.append(row)
    return out


def merge_runs(runs: list[tuple[list[bytes], list[int]]], width: int) -> tuple[list[int], list[int], list[int]]:
    """Merge sorted runs of strings of one width: (run, place, common prefix with the one before).

    A loser tree over the runs' heads. ``know[r]`` is the common prefix of run
    r's head with the last output; of two heads the one that shares more with
    the output is smaller, and only at a tie are bytes read, from there on.
    """
    n = len(runs)
    size = 1
    while size < n:
        size *= 2
    heads = [r[0][0] if i < n and r[0] else None for i, r in enumerate(runs)] + [None] * (size - n)
    know = [0] * size
    place = [0] * size
    tree = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser then knows its common prefix with the winner."""
        if heads[a] is None:
            return b, a
        if heads[b] is None:
            return a, b
        ha, hb = know[a], know[b]
        if ha != hb:
            return (a, b) if ha > hb else (b, a)
        x, y = heads[a][ha:], heads[b][ha:]
        if x == y:
            know[b] = width
            return a, b
        diff = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
        h = width - (diff.bit_length() + 7) // 8
        if x < y:
            know[b] = h
            return a, b
        know[a] = h
        return b, a

    level = list(range(size))
    node = size // 2
    while len(level) > 1:
        up = []
        for i in range(0, len(level), 2):
            win, lose = play(level[i], level[i + 1])
            tree[node + i // 2] = lose
            up.append(win)
        level, node = up, node // 2
    win, out_run, out_place, out_lcp = level[0], [], [], []
    while heads[win] is not None:
        i = place[win]
        out_run.append(win)
        out_place.append(i)
        out_lcp.append(know[win])
        strings, lcps = runs[win]
        i += 1
        place[win] = i
        if i < len(strings):
            heads[win] = strings[i]
            know[win] = lcps[i]
        else:
            heads[win] = None
        p = (win + size) // 2
        while p:
            other = tree[p]
            best, lose = play(win, other)
            tree[p] = lose
            win = best
            p //= 2
    return out_run, out_place, out_lcp


def _repeated(lcp_right, left_rows, left, right, length: int, gram: int, order: np.ndarray) -> np.ndarray:
    """For each entry (merged order) and window offset: does an earlier equal window exist?

    ``order``: the entries by document, then place.
    """
    n, back = len(left), length - gram
    by_left = np.argsort(left_rows.view(f"S{back}").ravel(), kind="stable")
    lcp_left = _common(left_rows[by_left])
    out = np.zeros((n, back + 1), bool)
    rank = np.empty(n, np.int64)
    lo, hi = length - right.astype(np.int64), left.astype(np.int64)
    for o in range(back + 1):
        ok = order[(lo[order] <= o) & (o <= hi[order])]
        if len(ok) < 2:
            continue
        rank[by_left] = np.cumsum(lcp_left < o)
        cls = np.cumsum(lcp_right < length - o)[ok] * n + rank[ok]
        first = np.unique(cls, return_index=True)[1]
        rep = np.ones(len(ok), bool)
        rep[first] = False
        out[ok[rep], o] = True
    return out


def _merge(length: int, gram: int):
    back, width = length - gram, 2 * length - gram

    def windows(t: pa.Table) -> pa.Table:
        """First of each window hash over all blocks; the others are repeats."""
        blocks, got = t.column("block").to_pylist(), [B.unframe(p) for p in t.column("payload").to_pylist()]
        h1 = np.concatenate([B.unsqueeze_sorted(g[0]) for g in got])
        h2, doc, crc, start = (np.concatenate([B.unsqueeze(g[i + 1], d) for g in got]) for i, d in enumerate((np.uint64, np.uint64, np.uint32, np.uint32)))
        src = np.repeat(np.arange(len(got)), [int.from_bytes(g[0][:8], "little") for g in got])
        order = np.lexsort((start, np.array(blocks)[src], crc, doc, h2, h1))
        new = np.ones(len(order), bool)
        new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        rep = order[~new]
        out = []
        for i in np.unique(src[rep]).tolist():
            s = start[rep[src[rep] == i]].astype(np.int64)
            out.append(_spans(blocks[i], s, s + length))
        return B.table(out)

    def suffixes(t: pa.Table) -> pa.Table:
        blocks, runs, cols = t.column("block").to_pylist(), [], []
        for p in t.column("payload").to_pylist():
            lcp, rest, *more = (B.unsqueeze(x, d) for x, d in zip(B.unframe(p), _RUN_TYPES, strict=True))
            lcps = lcp.tolist()
            runs.append((_decode(lcps, rest.tobytes(), width), lcps))
            cols.append(more)
        run, place, lcp = merge_runs(runs, width)
        run, place, lcp = np.array(run), np.array(place), np.minimum(np.array(lcp), length)
        lcp[0] = 0
        # entries that share their gram with no neighbour repeat nothing
        alike = lcp >= gram
        pick = np.flatnonzero(alike | np.append(alike[1:], False))
        if not len(pick):
            return B.table([])
        rows = np.frombuffer(b"".join(runs[r][0][i][length:] for r, i in zip(run[pick].tolist(), place[pick].tolist(), strict=True)), np.uint8).reshape(len(pick), back)
        del runs
        base = np.concatenate([[0], np.cumsum([len(c[0]) for c in cols])])
        where = base[run[pick]] + place[pick]
        at, left, right, doc, crc = (np.concatenate([c[i] for c in cols])[where] for i in range(5))
        src = run[pick]
        order = np.lexsort((at, np.array(blocks)[src], crc, doc))
        # a neighbour that was left out shares no gram, so common prefixes over the gap stay below it
        rep = _repeated(lcp[pick], rows, left, right, length, gram, order)
        edge = np.diff(np.pad(rep.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        who, o1 = np.nonzero(edge > 0)
        _, o2 = np.nonzero(edge < 0)
        a = at[who].astype(np.int64)
        start, end, src = a - (o2 - 1), a - o1 + length, src[who]
        return B.table([_spans(blocks[i], start[src == i], end[src == i]) for i in np.unique(src).tolist()])

    def run(t: pa.Table) -> pa.Table:
        return B.tidy(suffixes if t.column("kind")[0].as_py() else windows)(t)

    return run


def _finish(carried: bool):
    def run(blocks: pa.Table, told: pa.Table) -> pa.Table:
        t, data, off = _texts(blocks)
        step = np.zeros(len(data) + 1, np.int32)
        for p in told.column("payload").to_pylist():
            start, size = (B.unsqueeze(x, d) for x, d in zip(B.unframe(p), (np.int64, np.int32), strict=True))
            np.add.at(step, start, 1)
            np.add.at(step, start + size, -1)
        gone = np.cumsum(step[:-1]) > 0
        del step
        begin = gone.copy()
        begin[1:] &= ~gone[:-1]
        inner = off[:-1][off[:-1] < len(data)]
        begin[inner] = gone[inner]
        lost, runs = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(begin)])
        kept, at = data[~gone].tobytes(), off - lost[off]
        texts = [kept[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        out = {
            "doc_id": t.column("doc_id"),
            "n_bytes": pa.array(np.diff(off), pa.int64()),
            "n_removed": pa.array(np.diff(lost[off]), pa.int64()),
            "n_spans": pa.array(np.diff(runs[off]), pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
        }
        if carried:
            was_null = t.column("text").is_null().to_pylist()
            out["kept"] = pa.array([None if z else x.decode("utf-8", "ignore") for x, z in zip(texts, was_null, strict=True)], pa.string())
            out |= {c: t.column(c) for c in t.column_names if c[0] == "c"}
        return pa.table(out)

    return run


def suffix_dedup(docs: DataFrame, length: int = 100, gram: int = 40, carry: list[str] | None = None, block_bytes: int = B.BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal runs), kept_sha256 of each row.

    With ``carry`` (column names, may be empty) also ``kept``, the remaining
    text (a character that lost some of its bytes goes whole), and the named
    columns as c0, c1, ...
    """
    blocks, total = B.document_blocks(docs, "suffix_dedup", block_bytes=block_bytes, carry=carry)
    dests = B.destinations(total)
    grams = blocks.mapInArrow(_send_grams(length, gram, dests), B.PAYLOAD)
    told = B.sum_keys(grams, wide=np.uint32)
    sent = materialize(B.with_blocks(blocks, told, _send_suffixes(length, gram, dests, hot), B.PAYLOAD), "suffixes")
    runs = sent.where("dest >= 0").withColumn("kind", (sent["dest"] >= dests).cast("int"))
    marks = runs.groupBy("dest").applyInArrow(_merge(length, gram), B.PAYLOAD).unionByName(sent.where("dest < 0"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if carry is not None:
        kinds = dict(docs.dtypes)
        schema += ", kept string" + "".join(f", c{i} {kinds[c]}" for i, c in enumerate(carry))
    return B.with_blocks(blocks, marks, _finish(carry is not None), schema)


def without_repeats(docs: DataFrame, length: int = 100, gram: int = 40) -> DataFrame:
    """The rows of ``docs`` with repeated strings removed from their texts.

    A text that loses everything but blanks goes; texts that lose nothing stay
    as they are. ``n_chars``, where there is one, is counted anew.
    """
    others, kinds = B.others(docs), dict(docs.dtypes)
    out = suffix_dedup(docs, length, gram, others)
    out = out.where((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("kept", r"[\x09-\x0D]+", " ")) != ""))
    made = {"doc_id": F.col("doc_id").cast(kinds["doc_id"]), "text": F.col("kept")} | {c: F.col(f"c{i}") for i, c in enumerate(others)}
    if "n_chars" in made:
        made["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(kinds["n_chars"])).otherwise(made["n_chars"])
    return out.select(*[made[c].alias(c) for c in docs.columns])
