"""Fill-in-middle texts by piece tables.

A document is a list of *descriptors* (buffer, start, length) over two
immutable buffers: its own UTF-8 bytes, and the sentinels. Cutting splits
descriptors, an arrangement permutes the pieces and puts sentinel descriptors
before them, the inverse permutation restores the order, and a digest streams
over the descriptors; no byte of a text is moved for any of it. Only a caller
who asks for the texts themselves gets the bytes joined, once.

``fim_transform`` cuts each text at two line ends that a hash of the seed and
the ``doc_id`` draws, and writes prefix, middle and suffix in the order of its
form: ``plain`` (the text as it is), ``psm`` or ``spm``. ``fim_restore`` needs
only output and form: since a text that holds a sentinel stays plain, the
sentinels of an output are found by a search, cut out, and the pieces put back
in order. Both are narrow: a row is handled in the task that reads it, and
nothing is shuffled.

Edge cases. A null or empty text has no lines and stays plain (its output is
empty). A null ``doc_id`` draws like an empty one (hash of ``<seed>:``) and
stays null. Equal rows give equal rows. A text of any length is one row of
one task, which holds it, its line ends and at most three copies of it. Columns besides ``doc_id`` and ``text`` are not read, whatever their
names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.kernels import text_arrays
from tessera.session import ship_package

SENTINELS = (b"<P>", b"<S>", b"<M>")
"""Before the prefix, the suffix and the middle."""
ARRANGED = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
"""Order in which a form writes prefix (0), middle (1) and suffix (2)."""
SENTINEL_OF = (0, 2, 1)
"""Which of the sentinels stands before piece 0, 1, 2."""
TEXT, MARKS = 0, 1


class PieceTable:
    """Descriptors (buffer, start, length) over immutable buffers, in reading order."""

    __slots__ = ("buffers", "pieces")

    def __init__(self, buffers: tuple, pieces: list[tuple[int, int, int]]):
        self.buffers, self.pieces = buffers, pieces

    @classmethod
    def of(cls, text, marks: tuple[bytes, ...] = SENTINELS) -> PieceTable:
        return cls((memoryview(text), memoryview(b"".join(marks))), [(TEXT, 0, len(text))])

    def cut(self, at: list[int]) -> PieceTable:
        """The table of a text in one piece, split at these offsets (ascending; pieces may be empty)."""
        ((buffer, start, length),) = self.pieces
        edge = [0, *at, length]
        return PieceTable(self.buffers, [(buffer, start + a, b - a) for a, b in zip(edge, edge[1:])])

    def arranged(self, order: tuple[int, ...], marks: tuple[bytes, ...] = SENTINELS) -> PieceTable:
        """Pieces in this order, each after its sentinel."""
        begin = np.cumsum([0, *map(len, marks)]).tolist()
        out = []
        for i in order:
            s = SENTINEL_OF[i]
            out += [(MARKS, begin[s], len(marks[s])), self.pieces[i]]
        return PieceTable(self.buffers, out)

    def restored(self, order: tuple[int, ...]) -> PieceTable:
        """The inverse of ``arranged``: sentinels dropped, pieces in their first order."""
        own = [p for p in self.pieces if p[0] == TEXT]
        back = [own[order.index(i)] for i in range(len(order))]
        return PieceTable(self.buffers, back)

    def stream(self) -> Iterator[memoryview]:
        for buffer, start, length in self.pieces:
            yield self.buffers[buffer][start : start + length]

    def digest(self) -> str:
        """Lowercase hex sha256 of the bytes read in order."""
        h = hashlib.sha256()
        for view in self.stream():
            h.update(view)
        return h.hexdigest()

    def read(self) -> bytes:
        return b"".join(self.stream())

    @classmethod
    def parsed(cls, output, form: str, marks: tuple[bytes, ...] = SENTINELS) -> PieceTable:
        """The table of an output: its sentinels found by search, in the order of the form."""
        data, pieces, at = bytes(output), [], 0
        order = ARRANGED[form]
        for n, i in enumerate(order):
            mark = marks[SENTINEL_OF[i]]
            if data[at : at + len(mark)] != mark:
                raise ValueError(f"no {mark!r} at byte {at} of a text in form {form}")
            pieces.append((MARKS, at, len(mark)))
            at += len(mark)
            end = data.find(marks[SENTINEL_OF[order[n + 1]]], at) if n + 1 < len(order) else len(data)
            if end < 0:
                raise ValueError(f"a sentinel of form {form} is missing")
            pieces.append((TEXT, at, end - at))
            at = end
        view = memoryview(data)
        return cls((view, view), pieces)


def checked(marks: tuple[bytes, ...]) -> tuple[bytes, ...]:
    """Sentinels that no text can complete: none has the first byte of one at another place, or begins another."""
    first = {m[:1] for m in marks}
    if len(marks) != 3 or b"" in first or any(x in m[1:] for m in marks for x in first) or any(a != b and b.startswith(a) for a in marks for b in marks) or len(set(marks)) < 3:
        raise ValueError(f"sentinels must be three strings whose first bytes stand nowhere else in them: {marks!r}")
    return marks


def line_ends(data: np.ndarray) -> np.ndarray:
    """Byte offsets behind each line (``[^\\n]*\\n|[^\\n]+``), ascending."""
    ends = np.flatnonzero(data == 0x0A) + 1
    return np.append(ends, len(data)) if len(data) and data[-1] != 0x0A else ends


def characters(data: np.ndarray) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four unsigned 32-bit numbers from the hash of ``<seed>:<doc_id>``."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]


def fim_table(data: np.ndarray, doc_id: int | None, seed: int, rate: int, spm: int, marks: tuple[bytes, ...]):
    """(lines, form, prefix and middle characters or None, the arranged piece table) of a text."""
    text = memoryview(data)
    whole = PieceTable.of(text, marks)
    ends = line_ends(data)
    n = len(ends)
    h1, h2, h3, h4 = draws(seed, doc_id)
    raw = bytes(text)
    if not n or h3 % 100 >= rate or any(m in raw for m in marks):
        return n, "plain", None, None, whole
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (lo, hi))
    form = "spm" if h4 % 100 < spm else "psm"
    return n, form, characters(data[:a]), characters(data[a:b]), whole.cut([a, b]).arranged(ARRANGED[form], marks)


def rebuilt(output, form: str, marks: tuple[bytes, ...] = SENTINELS) -> PieceTable:
    """The text as a piece table over an output, from output and form alone."""
    if form == "plain":
        return PieceTable.of(output, marks)
    return PieceTable.parsed(output, form, marks).restored(ARRANGED[form])


def _rows(make: Callable, schema: pa.Schema):
    def run(batches):
        for b in batches:
            data, off = text_arrays(b.column(1))
            ids = b.column(0).to_pylist()
            rows = [make(data[off[i] : off[i + 1]], ids[i]) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(schema)], schema=schema)

    return run


def _table(docs: DataFrame, make: Callable, ddl: str, kinds: list[pa.DataType]) -> DataFrame:
    ship_package(docs.sparkSession)
    names = [c.split()[0] for c in ddl.split(", ")]
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(_rows(make, pa.schema(list(zip(names, kinds, strict=True)))), ddl)


_HEAD = "doc_id long, n long, form string, prefix_chars long, middle_chars long"
_HEAD_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]


def fim_transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, sentinels: tuple[bytes, ...] = SENTINELS) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every document.

    ``rate``: percent of the texts that are cut at all; ``spm``: percent of
    those in the form ``spm``. ``n``: lines.
    """

    checked(sentinels)

    def make(data, doc_id):
        *head, t = fim_table(data, doc_id, seed, rate, spm, sentinels)
        return doc_id, *head, t.read().decode()

    return _table(docs, make, _HEAD + ", output string", [*_HEAD_KINDS, pa.string()])


def fim_restore(outputs: DataFrame, sentinels: tuple[bytes, ...] = SENTINELS) -> DataFrame:
    """doc_id, text of every row of ``outputs`` (doc_id, form, output): the texts before ``fim_transform``."""
    ship_package(outputs.sparkSession)
    checked(sentinels)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        for b in batches:
            data, off = text_arrays(b.column(2))
            form = b.column(1).to_pylist()
            texts = [rebuilt(memoryview(data[off[i] : off[i + 1]]), f, sentinels).read().decode() for i, f in enumerate(form)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], schema=schema)

    return outputs.select(F.col("doc_id").cast("long").alias("doc_id"), "form", F.col("output").cast("string").alias("output")).mapInArrow(run, "doc_id long, text string")


def fim_digests(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, sentinels: tuple[bytes, ...] = SENTINELS) -> DataFrame:
    """As ``fim_transform`` with the digest of the output instead of its text, and that of the text rebuilt from it."""
    checked(sentinels)

    def make(data, doc_id):
        *head, t = fim_table(data, doc_id, seed, rate, spm, sentinels)
        return doc_id, *head, t.digest(), rebuilt(t.read(), head[1], sentinels).digest()

    ddl = _HEAD + ", output_sha256 string, restored_sha256 string"
    return _table(docs, make, ddl, [*_HEAD_KINDS, pa.string(), pa.string()])
