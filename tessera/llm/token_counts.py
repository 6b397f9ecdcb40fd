"""Token counts without ids.

Each text is split into pre-tokens. A block of documents keeps, per document,
how often each pre-token occurs; the pieces of a pre-token are counted once
for all documents by the task that owns it, the counts go back to the blocks,
and a document's tokens are the sum of frequency times pieces.

Null text counts as empty (0 bytes, 0 tokens). A special token's string inside
a text is one token, as the tokenizer's default has it. Every row is counted
for itself, so repeated or null ``doc_id`` values give a row each. Columns
besides ``doc_id`` and ``text`` are not read. An empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import blocks as B

# The split pattern of byte-level BPE, and its letters, numbers
# and white space up to U+024F. Texts with other characters are split by the
# tokenizer itself.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
_SPACE = " \\t\\n\\r\\f\\v\u0085 "
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_OTHER = re.compile("[^\x00-\x1b\x20-ɏ‐-‧‰-›€]")

VOCABULARY_BYTES = 8 << 20
"""Text bytes of a block: the larger, the fewer pre-tokens are sent more than once."""

_LOADED: dict = {}


def load(path: str):
    """The tokenizer of a file, once per worker."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def splitter(path: str):
    """``text -> (pre-tokens, special tokens)`` for a byte-level BPE file."""
    tok = load(path)
    special = [t.content for t in tok.get_added_tokens_decoder().values()]
    cut = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def plain(text: str) -> list[str]:
        if _OTHER.search(text):
            return [text[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(text)]
        return _SPLIT.findall(text)

    def run(text: str) -> tuple[list[str], int]:
        if cut is None or not cut.search(text):
            return plain(text), 0
        parts = cut.split(text)
        return [p for x in parts if x for p in plain(x)], len(parts) - 1

    return run


def _make(path: str):
    def make(block: int, t: pa.Table) -> dict:
        split, vocab = splitter(path), {}
        ids, freq, n_docs, special, sizes = [], [], [], [], []
        for text in t.column("text").to_pylist():
            pieces, n = split(text or "")
            seen = Counter(pieces)
            ids.append(np.fromiter((vocab.setdefault(p, len(vocab)) for p in seen), np.int64, len(seen)))
            freq.append(np.fromiter(seen.values(), np.uint32, len(seen)))
            n_docs.append(len(seen))
            special.append(n)
            sizes.append(len((text or "").encode()))
        names = list(vocab)
        owner = np.fromiter((zlib.crc32(p.encode()) for p in names), np.uint32, len(names))
        order = np.argsort(owner, kind="stable")
        place = np.empty(len(names), np.int64)
        place[order] = np.arange(len(names))
        count = np.array(n_docs, np.int64)
        key = (np.repeat(np.arange(len(count)), count) << 32) | place[np.concatenate(ids)] if ids else np.zeros(0, np.int64)
        by = np.argsort(key)
        payload = B.pack(doc_id=t.column("doc_id"), n_bytes=np.array(sizes, np.int64), special=np.array(special, np.int64), pieces=count)
        payload = [payload, B.squeeze_sorted(key[by]), B.squeeze(np.concatenate(freq)[by] if freq else np.zeros(0, np.uint32))]
        return {"payload": B.frames(payload), "vocab": B.pack(owner=owner[order], piece=pa.array([names[i] for i in order], pa.string()))}

    return make


def _send(dests: int):
    def run(batches):
        for b in batches:
            for block, vocab in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = B.unpack(vocab)
                owner = t.column("owner").to_numpy().astype(np.int64)
                cut = np.searchsorted(owner, [(i << 32) // dests for i in range(dests)] + [1 << 32])
                piece = t.column("piece")
                yield B.rows([(block, d, B.pack(piece=piece.slice(lo, hi - lo))) for d, (lo, hi) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if hi > lo])

    return run


def _count(path: str):
    def run(t: pa.Table) -> pa.Table:
        runs = [B.unpack(p).column("piece") for p in t.column("payload").to_pylist()]
        every = pa.chunked_array([c for r in runs for c in r.chunks], pa.string()).dictionary_encode().unify_dictionaries()
        names = every.chunk(0).dictionary.to_pylist() if every.num_chunks else []
        tok, n = load(path), []
        for lo in range(0, len(names), 4096):
            n += [len(e.ids) for e in tok.encode_batch(names[lo : lo + 4096], add_special_tokens=False)]
        n, at, out = np.array(n, np.uint32), 0, []
        code = np.concatenate([c.indices.to_numpy() for c in every.chunks]) if every.num_chunks else np.zeros(0, int)
        for b, d, r in zip(t.column("block").to_pylist(), t.column("dest").to_pylist(), runs, strict=True):
            out.append((b, d, B.squeeze(n[code[at : at + len(r)]])))
            at += len(r)
        return B.table(out)

    return run


def _sum(blocks: pa.Table, told: pa.Table) -> pa.Table:
    n = B.answers(told, np.uint32).astype(np.int64)
    out = []
    for payload in blocks.column("payload").to_pylist():
        head, key, freq = B.unframe(payload)
        head = B.unpack(head)
        key, freq = B.unsqueeze_sorted(key, np.int64), B.unsqueeze(freq, np.uint32).astype(np.int64)
        doc = key >> 32
        total = np.bincount(doc, weights=(n[key & 0xFFFFFFFF] * freq).astype(float), minlength=head.num_rows).astype(np.int64)
        total = total + head.column("special").to_numpy()
        out.append(pa.table({"doc_id": head.column("doc_id"), "n_bytes": head.column("n_bytes"), "n_tokens": pa.array(total, pa.int64())}))
    return pa.concat_tables(out) if out else pa.table({k: pa.array([], pa.int64()) for k in ("doc_id", "n_bytes", "n_tokens")})


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) of each row."""
    blocks, total = B.document_blocks(docs, "token_counts", _make(tokenizer), "vocab binary", VOCABULARY_BYTES)
    sent = blocks.select("block", "vocab").mapInArrow(_send(B.destinations(total)), B.PAYLOAD)
    told = B.by_range(sent, _count(tokenizer))
    out = B.with_blocks(blocks.select("block", "payload"), told, _sum, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
