"""Document blocks and the key exchange between them.

A *block* holds some megabytes of whole documents as one compressed Arrow
table. Blocks are written once to a table bucketed by block id under the
shared checkpoint folder, so later passes over the texts read them in place:
joining a block with what other tasks found out about it moves only those
answers, never the texts.

``count_keys`` is the exchange that most operators here need: each block sends
its sorted distinct 64-bit keys to the task that owns their range, that task
adds up what all blocks sent, and each block gets the totals of its own keys
back in the same order. Keys travel as byte planes of their differences, so a
key costs four to six bytes and an answer about one.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import scratch_path, ship_package
from tessera.llm.kernels import U64

BLOCK_BYTES = 4 << 20
"""Text bytes after which a block is closed (a longer document has a block of its own)."""
RANGE_BYTES = 16 << 20
"""Text bytes for each key range of an exchange."""
GROWN = 64 << 30
"""Text bytes from which blocks and ranges grow with the root of the input, so that messages grow in proportion to it."""
MOST = 32
"""Times that blocks and ranges grow at most: a task holds one of them."""
BLOCK_DOCS = 1 << 16
ROW = U64(16)  # a document's row number is block << 16 | place in its block

_IPC = pa.ipc.IpcWriteOptions(compression="zstd")
PAYLOAD = "block long, dest int, payload binary"


def pack(**columns) -> bytes:
    """Columns of equal length as one compressed Arrow stream."""
    t = pa.table({k: v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for k, v in columns.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=_IPC) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(payload)).read_all()


_ZSTD = pa.Codec("zstd", 1)


def squeeze(a: np.ndarray) -> bytes:
    """Integers as compressed byte planes (length first)."""
    raw = np.ascontiguousarray(a)
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes() if len(raw) else b""
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(planes, asbytes=True)


def unsqueeze(b: bytes, dtype) -> np.ndarray:
    n, size = int.from_bytes(b[:8], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    planes = np.frombuffer(_ZSTD.decompress(b[8:], n * size, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(dtype).reshape(n)


def squeeze_sorted(a: np.ndarray) -> bytes:
    return squeeze(np.diff(a, prepend=a.dtype.type(0)))


def unsqueeze_sorted(b: bytes, dtype=np.uint64) -> np.ndarray:
    return np.cumsum(unsqueeze(b, dtype), dtype=dtype)


def batch(schema: str | pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols.values(), schema.types, strict=True)], schema=schema)


_OUT = pa.schema([("block", pa.int64()), ("dest", pa.int32()), ("payload", pa.binary())])


def rows(items: list[tuple]) -> pa.RecordBatch:
    """(block, dest, payload) rows as one batch."""
    b, d, p = zip(*items, strict=True) if items else ((), (), ())
    return batch(_OUT, block=b, dest=d, payload=p)


def table(items: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([rows(items)], _OUT)


def document_rows(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """doc_id (long), text (string) and the carried columns as c0, c1, ...; others stay behind."""
    more = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry or [])]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts plus one per row."""
    return int(docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1))).first()[0] or 0)


def _cut(batches: Iterator[pa.RecordBatch], make: Callable, block_bytes: int):
    from pyspark import TaskContext

    part, seq, held, size, count = TaskContext.get().partitionId(), 0, [], 0, 0

    def close():
        nonlocal seq, held, size, count
        t = pa.Table.from_batches(held)
        out = make((part << 20) | seq, t)
        seq, held, size, count = seq + 1, [], 0, 0
        release()
        return out

    for b in batches:
        lens = np.diff(np.frombuffer(b.column(1).buffers()[1], np.int32 if b.column(1).type == pa.string() else np.int64)[b.column(1).offset : b.column(1).offset + b.num_rows + 1]) if b.num_rows else np.zeros(0, int)
        lo = 0
        for i, n in enumerate(lens.tolist()):
            size, count = size + n, count + 1
            if size >= block_bytes or count >= BLOCK_DOCS:
                held.append(b.slice(lo, i + 1 - lo))
                lo = i + 1
                yield close()
        if lo < b.num_rows:
            held.append(b.slice(lo))
    if held:
        yield close()


def grown(size: int, total: int) -> int:
    """A block's or range's bytes for an input of ``total`` bytes."""
    return round(size * min(MOST, max(1.0, (total / GROWN) ** 0.5)))


def bucket_count(total: int, block_bytes: int, most: int) -> int:
    """Buckets of some blocks each, within what Spark allows."""
    return min(most, max(32, -(-total // (2 * block_bytes))))


def bucketed(df: DataFrame, name: str, total: int, block_bytes: int) -> DataFrame:
    """Write ``df`` bucketed by block under the shared folder and read it back; the catalog keeps no table."""
    spark = df.sparkSession
    n = bucket_count(total, block_bytes, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))
    tab = f"tessera_{name}_{uuid.uuid4().hex[:12]}"
    df.write.format("parquet").option("path", scratch_path(spark, name)).option("compression", "uncompressed").bucketBy(n, "block").saveAsTable(tab)
    out = spark.table(tab)
    spark.sql(f"drop table {tab}")  # its files stay, and so does what was read of it here
    return out


def document_blocks(docs: DataFrame, name: str, make: Callable | None = None, schema: str = "", block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None) -> tuple[DataFrame, int]:
    """Blocks of ``docs`` as (block, payload) plus what ``make`` adds; and the bytes of text.

    ``carry`` names columns that the payload holds besides doc_id and text, as c0, c1, ...

    ``make(block, table) -> dict`` gives the further columns of a block
    (``schema``: their DDL); a ``payload`` of its own replaces the texts.
    """
    ship_package(docs.sparkSession)
    src = document_rows(docs, carry)
    total = text_bytes(src)
    block_bytes = grown(block_bytes, total)
    full = "block long, payload binary" + (f", {schema}" if schema else "")

    def run(batches):
        def one(block, t):
            more = make(block, t) if make else {}
            payload = more.pop("payload", None)
            if payload is None:
                payload = pack(text=t.column("text").cast(pa.large_binary()), **{c: t.column(c) for c in t.column_names if c != "text"})
            return pa.RecordBatch.from_pydict({"block": [block], "payload": [payload]} | {k: [v] for k, v in more.items()})

        yield from _cut(batches, one, block_bytes)

    return bucketed(src.mapInArrow(run, full), name, total, block_bytes), total


def destinations(total: int, per: int = RANGE_BYTES) -> int:
    """Key ranges of an exchange: one for so many bytes of text, 64 at least."""
    return max(64, -(-total // grown(per, total)))


def dest_cuts(keys: np.ndarray, dests: int) -> np.ndarray:
    """Where each range of sorted hashed keys begins (``dests + 1`` places)."""
    edge = [(i << 64) // dests for i in range(1, dests)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(edge, U64)), [len(keys)]])


def send(block: int, keys: np.ndarray, dests: int, *values: np.ndarray) -> list[tuple]:
    """Rows that carry sorted keys and their values to the owners of the ranges."""
    cut, out = dest_cuts(keys, dests), []
    for d in range(dests):
        lo, hi = int(cut[d]), int(cut[d + 1])
        if hi > lo:
            parts = [squeeze_sorted(keys[lo:hi]), *(squeeze(v[lo:hi]) for v in values)]
            out.append((block, d, frames(parts)))
    return out


def frames(parts: list[bytes]) -> bytes:
    """Byte strings as one, each after its length."""
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unframe(payload: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(payload):
        n = int.from_bytes(payload[at : at + 8], "little")
        out.append(payload[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def by_size(count: np.ndarray) -> np.ndarray:
    """Places by falling bit length of their counts (1 at least); those of one length in their order."""
    return np.argsort(-np.frexp(count.astype(float))[1], kind="stable")


def sorted_keys(parts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The keys of a message of ``send``, and its values."""
    return unsqueeze_sorted(parts[0]), parts[1:]


def adder(
    dtype=np.uint32,
    wide=np.uint64,
    tell: Callable | None = None,
    values: int = 1,
    once: Callable | None = None,
    number: Callable | None = None,
    read: Callable = sorted_keys,
    first: bool = False,
) -> Callable:
    """Function of a range's rows: for each, the totals of its keys over all, in its order.

    With several ``values`` of a key, or to
    answer with less, ``tell(totals...)`` turns the totals into the answer.
    ``once(total)`` gives a number for the range (or some), told to block -1.
    ``number(total)`` says which keys are numbered from 0, frequent ones first
    (``by_size``): an answer is then framed, and tells the numbers of those of
    its keys as well, in the order of ``by_size``, and in bits which of its keys
    other blocks sent too. With that, or ``first``, a last frame tells in bits
    which of the keys with totals of 2 or more the block is to report: of those
    that sent more than 0, the least block is. ``read(frames)`` gives a
    message's keys and the frames of its values.
    """
    first = first or number is not None
    code, out_code = np.dtype(dtype).str, np.dtype(wide).str

    def run(t: pa.Table) -> pa.Table:
        if not t.num_rows:
            return table([])
        if first:
            t = t.sort_by("block")
        got = [unframe(p) for p in t.column("payload").to_pylist()]
        keys, got = zip(*(read(p) for p in got), strict=True)
        vals = [np.concatenate([unsqueeze(p[i], np.dtype(code)) for p in got]) for i in range(values)]
        allk = np.concatenate(keys)
        order = np.argsort(allk, kind="stable")
        sk = allk[order]
        new = np.ones(len(sk), bool)
        new[1:] = sk[1:] != sk[:-1]
        at = np.flatnonzero(new)
        total = [np.add.reduceat(v[order], at, dtype=np.dtype(out_code)) for v in vals]
        back = np.empty(len(sk), np.int64)
        back[order] = np.cumsum(new) - 1
        if first:
            some = np.flatnonzero(vals[0][order] > 0)
            lead = np.zeros(len(sk), bool)
            lead[order[some[np.diff(back[order[some]], prepend=-1) > 0]]] = True
            twice = total[0] > 1
        del allk, order, sk, new
        more = [(-1, t.column("dest")[0].as_py(), squeeze(np.atleast_1d(once(*total)).astype(np.int64)))] if once else []
        if number:
            size, has = total[0], number(*total)
            which = np.flatnonzero(has)
            nth = np.zeros(len(at), np.uint32)
            nth[which[by_size(size[which])]] = np.arange(len(which))
        several = np.diff(at, append=len(back)) > 1
        total = tell(*total) if tell else total[0]
        cut = np.concatenate([[0], np.cumsum([len(k) for k in keys])])

        def answer(lo: int, hi: int) -> bytes:
            of = back[lo:hi]
            out = [squeeze(total[of])]
            if number:
                which = of[has[of]]
                out += [squeeze_sorted(nth[which[by_size(size[which])]]), squeeze(np.packbits(several[of]))]
            if first:
                out.append(squeeze(np.packbits(lead[lo:hi][twice[of]])))
            return frames(out) if len(out) > 1 else out[0]

        return table(more + [(b, d, answer(int(cut[i]), int(cut[i + 1]))) for i, (b, d) in enumerate(zip(t.column("block").to_pylist(), t.column("dest").to_pylist(), strict=True))])

    return run


def tidy(fn: Callable) -> Callable:
    """``fn`` that gives freed memory back afterwards: workers idle on while others run."""

    def run(*tables):
        out = fn(*tables)
        release()
        return out

    return run


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def by_range(sent: DataFrame, fn: Callable) -> DataFrame:
    """``fn(table) -> table`` over the rows sent to each range."""
    fn = tidy(fn)

    def run(t: pa.Table) -> pa.Table:
        return fn(t)

    return sent.groupBy("dest").applyInArrow(run, PAYLOAD)


def sum_keys(sent: DataFrame, *how, **more) -> DataFrame:
    """The totals of all keys sent, told to those who sent them; ``adder`` has the options."""
    return by_range(sent, adder(*how, **more))


def answers(t: pa.Table, dtype) -> np.ndarray:
    """The answers of one block's keys, in the order of its sorted keys."""
    d = t.column("dest").to_pylist()
    p = t.column("payload").to_pylist()
    got = [unsqueeze(p[i], dtype) for i in sorted(range(len(d)), key=d.__getitem__)]
    return np.concatenate(got) if got else np.zeros(0, dtype)


def with_blocks(blocks: DataFrame, told: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``fn(block table, told table) -> table`` for each block; texts stay in place."""
    fn = tidy(fn)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return fn(left, right)

    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, schema)


def others(docs: DataFrame) -> list[str]:
    """The columns of documents besides doc_id and text."""
    return [c for c in docs.columns if c not in ("doc_id", "text")]


def row_blocks(docs: DataFrame, name: str, make: Callable | None = None, schema: str = "", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """Blocks that hold whole rows of ``docs``; ``keep_rows`` gives rows back."""
    return document_blocks(docs, name, make, schema, block_bytes, others(docs))


def as_text(col) -> pa.Array:
    """A payload's text column as strings."""
    return col.cast(pa.large_string()).cast(pa.string())


def places(uids: DataFrame) -> DataFrame:
    """Row numbers (uid) as one message to each block."""

    def run(t: pa.Table) -> pa.Table:
        if not t.num_rows:
            return table([])
        uid = np.sort(t.column("uid").to_numpy())
        return table([(int(uid[0]) >> 16, -1, squeeze(uid & 0xFFFF))])

    return uids.select("uid", F.shiftright("uid", 16).alias("block")).groupBy("block").applyInArrow(run, PAYLOAD)


def told_places(told: pa.Table) -> np.ndarray:
    """The places that ``places`` told a block."""
    own = [p for d, p in zip(told.column("dest").to_pylist(), told.column("payload").to_pylist(), strict=True) if d < 0]
    return unsqueeze(own[0], np.int64) if own else np.zeros(0, np.int64)


def keep_rows(blocks: DataFrame, uids: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with these numbers; only the numbers are shuffled."""
    names, carried = docs.columns, others(docs)

    def run(b: pa.Table, told: pa.Table) -> pa.Table:
        if not b.num_rows:
            return pa.table({c: pa.array([], pa.null()) for c in names})
        t = unpack(b.column("payload")[0].as_py()).take(pa.array(told_places(told)))
        cols = {c: as_text(t.column("text")) if c == "text" else t.column("doc_id" if c == "doc_id" else f"c{carried.index(c)}") for c in names}
        return pa.table(cols)

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {'bigint' if c == 'doc_id' else kinds[c]}" for c in names)
    out = with_blocks(blocks.select("block", "payload"), places(uids), run, schema)
    return out.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in names])
