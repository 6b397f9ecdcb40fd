"""Document quality by co-training of two views.

One classifier sees a text (which words it has, which runs of signs, and a few
shape statistics), the other only what is recorded about it (language, source,
length). Both are naive: a feature's weight is the log-odds lift of its class
share, shrunk to the prior and kept only where it differs from it clearly. In
each round the views are calibrated on labelled documents set aside for that,
and each hands its confident answers on unlabelled documents to the other as
pseudo-labels; in the end both score every document and their calibrated
log-odds are added, the prior counted once.

Two heads are learnt, ``quality`` and ``toxic``; a document is kept if it is
likely good and not likely toxic. All labels and all documents take part.
Blocks hold the documents' features; a pass adds up, per block, vectors whose
length does not depend on the input, and only their sums reach the driver.

Null, empty and blank texts have shape statistics only. Null or missing
records are a feature of their own kind. Several labels of one doc_id are
averaged; null labels, and labels of no document, are not used; a null doc_id
has no label. Every row is scored for itself. Without labels every document
gets the prior of one half. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import blocks as B
from tessera.llm.kernels import U64, mix, text_arrays, words
from tessera.llm.langid import add_vectors
from tessera.session import materialize

TEXT_BITS, RECORD_BITS = 18, 12
HEADS = ("quality", "toxic")
RECORD = ("lang", "source", "n_chars")
SHRINK, CLEAR = 10.0, 4.0
"""Documents of prior opinion behind a feature; standard errors that make its share differ clearly."""
TRUE_WEIGHT, PSEUDO_WEIGHT = 2, 1
CONFIDENT = 0.98
ASIDE = 5
"""One in so many labelled documents calibrates instead of training."""
_BINS = 257
_STEP = 0.25
_RANGES = 16
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_SIGN = np.zeros(256, bool)
_SIGN[0x21:0x7F] = True
_SIGN &= ~_LETTER
_SIGN[0x30:0x3A] = False


def _buckets(h: np.ndarray, salt: int, bits: int) -> np.ndarray:
    return (mix(h ^ U64(salt)) >> U64(64 - bits)).astype(np.int64)


def _text_keys(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sorted distinct document << TEXT_BITS | feature."""
    blank = np.uint8(0x20)
    out = []
    n = np.diff(off)
    h, _, first = words(np.where(_LETTER[data], data, blank), off)
    count = np.diff(first)
    doc = np.repeat(np.arange(len(n)), count)
    out.append(doc << TEXT_BITS | _buckets(h, 1, TEXT_BITS))
    g, _, at = words(np.where(_SIGN[data], data, blank), off)
    out.append(np.repeat(np.arange(len(n)), np.diff(at)) << TEXT_BITS | _buckets(g, 2, TEXT_BITS))

    def share(mask) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask)])
        return (c[off[1:]] - c[off[:-1]]) / (n + 100)  # shares of short texts say little

    order = np.lexsort((h, doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[1:] != doc[:-1])
    different = (np.bincount(doc[new], minlength=len(n)) + 20) / (count + 20)
    upper = (data >= 0x41) & (data <= 0x5A)
    again = np.zeros(len(h) + 1, np.int64)
    again[1:-1] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    again = np.diff(np.cumsum(np.concatenate([[0], again[:-1]]))[first])
    runs = np.diff(at)
    some = count + 20
    classes = [np.log2(count + 1.0), n / np.maximum(count, 1) / 2, 20 * share(data == 0x0A)]
    steps = [10 * share(upper), 20 * share(_SIGN[data]), 10 * (1 - different), 10 * again / some, 10 * runs / some]
    for i, v in enumerate(classes + steps):
        v = np.minimum(v, 60 if i < len(classes) else 10).astype(np.uint64)
        for level in range(1 if i < len(classes) else 10):  # a step has a feature for each level it reaches
            has = np.flatnonzero(v > level) if i >= len(classes) else np.arange(len(n))
            token = ((v[has] if i < len(classes) else np.full(len(has), level, np.uint64)) << U64(8)) | U64(i)
            out.append(has << TEXT_BITS | _buckets(token, 3, TEXT_BITS))
    return np.unique(np.concatenate(out))


def _record_keys(columns: list[tuple[str, list]], n: int) -> np.ndarray:
    keys = [np.arange(n) << RECORD_BITS]  # every document has one feature at least
    for name, values in columns:
        if name == "n_chars":
            values = [None if v is None else int(v).bit_length() for v in values]
        token = np.fromiter((zlib.crc32(f"{name}={v}".encode()) for v in values), np.uint64, n)
        keys.append(np.arange(n) << RECORD_BITS | _buckets(token, 4, RECORD_BITS))
    return np.unique(np.concatenate(keys))


def _make(record: list[str]):
    def make(block: int, t: pa.Table) -> dict:
        data, off = text_arrays(t.column("text"))
        columns = [(name, t.column(f"c{i}").to_pylist()) for i, name in enumerate(record)]
        parts = [B.pack(doc_id=t.column("doc_id")), B.squeeze_sorted(_text_keys(data, off)), B.squeeze_sorted(_record_keys(columns, t.num_rows))]
        return {"payload": B.frames(parts)}

    return make


def _names(batches):
    for b in batches:
        for block, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            doc = B.unpack(B.unframe(payload)[0]).column("doc_id").combine_chunks()
            uid = (np.int64(block) << 16) | np.arange(len(doc))
            yield pa.RecordBatch.from_arrays([pa.array(uid), doc], names=["uid", "doc_id"])


def _tell_labels(t: pa.Table) -> pa.Table:
    if not t.num_rows:
        return B.table([])
    uid = t.column("uid").to_numpy()
    flags = [t.column(h).fill_null(-1).to_numpy() for h in HEADS]
    return B.table([(int(uid[0]) >> 16, 0, B.frames([B.squeeze(uid & 0xFFFF), *(B.squeeze(f.astype(np.int8)) for f in flags), B.squeeze(t.column("aside").to_numpy(zero_copy_only=False).astype(np.int8))]))])


class _Docs:
    """Features, labels and model scores of a block."""

    def __init__(self, blocks: pa.Table, told: pa.Table):
        self.block = blocks.column("block")[0].as_py()
        head, text, record = B.unframe(blocks.column("payload")[0].as_py())
        self.doc_id = B.unpack(head).column("doc_id")
        self.n = len(self.doc_id)
        text, record = B.unsqueeze_sorted(text, np.int64), B.unsqueeze_sorted(record, np.int64)
        self.views = [(text >> TEXT_BITS, text & ((1 << TEXT_BITS) - 1)), (record >> RECORD_BITS, record & ((1 << RECORD_BITS) - 1))]
        self.label = np.full((len(HEADS), self.n), -1, np.int64)
        self.aside = np.zeros(self.n, bool)
        for p in told.column("payload").to_pylist():
            at, *flags, aside = (B.unsqueeze(x, d) for x, d in zip(B.unframe(p), (np.int64, np.int8, np.int8, np.int8), strict=True))
            for h, f in enumerate(flags):
                self.label[h, at] = f
            self.aside[at] = aside > 0

    def raw(self, model, view: int, head: int) -> np.ndarray:
        doc, feature = self.views[view]
        return np.bincount(doc, weights=model["weight"][view][head][feature], minlength=self.n)

    def logit(self, model, view: int, head: int) -> np.ndarray:
        """Calibrated log-odds."""
        a, b = model["line"][view][head]
        return a * self.raw(model, view, head) + b


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _count(model):
    """Class counts of features, by true labels and by the other view's confident answers."""

    def run(blocks: pa.Table, told: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return B.table([])
        d = _Docs(blocks, told)
        vectors, totals = [], []
        for view, bits in enumerate((TEXT_BITS, RECORD_BITS)):
            doc, feature = d.views[view]
            rows = []
            for head in range(len(HEADS)):
                label = np.where(d.aside, -1, d.label[head])
                weight = np.where(label >= 0, TRUE_WEIGHT, 0)
                if model is not None:
                    p = _sigmoid(d.logit(model.value, 1 - view, head))
                    sure = (d.label[head] < 0) & ((p >= CONFIDENT) | (p <= 1 - CONFIDENT))
                    label = np.where(sure, p >= 0.5, label)
                    weight = np.where(sure, PSEUDO_WEIGHT, weight)
                for cls in range(2):
                    w = np.where(label == cls, weight, 0)
                    rows.append(np.bincount(feature, weights=w[doc], minlength=1 << bits).astype(np.int64))
                    totals.append(int(w.sum()))
            vectors.append(np.stack(rows))
        step = (1 << TEXT_BITS) // _RANGES
        out = [(d.block, i, B.squeeze(vectors[0][:, i * step : (i + 1) * step].ravel())) for i in range(_RANGES)]
        out.append((d.block, _RANGES, B.squeeze(np.concatenate([vectors[1].ravel(), np.array(totals, np.int64)]))))
        return B.table(out)

    return run


def _histogram(model):
    """Scores of the labelled documents set aside, by view, head and label."""

    def run(blocks: pa.Table, told: pa.Table) -> pa.Table:
        if not blocks.num_rows or not told.num_rows:
            return B.table([])
        d = _Docs(blocks, told)
        out = np.zeros((2, len(HEADS), 2, _BINS), np.int64)
        for view in range(2):
            for head in range(len(HEADS)):
                at = np.clip(np.rint(d.raw(model.value, view, head) / _STEP) + _BINS // 2, 0, _BINS - 1).astype(np.int64)
                for cls in range(2):
                    out[view, head, cls] = np.bincount(at[d.aside & (d.label[head] == cls)], minlength=_BINS)
        return B.table([(d.block, 0, B.squeeze(out.ravel()))])

    return run


def _learn(got: dict[int, np.ndarray]) -> dict:
    """Weights from summed class counts; the lines are set by calibration."""
    h = len(HEADS)
    step = (1 << TEXT_BITS) // _RANGES
    text = np.zeros((2 * h, 1 << TEXT_BITS), np.int64)
    for i in range(_RANGES):
        if i in got:
            text[:, i * step : (i + 1) * step] = got[i].reshape(2 * h, step)
    rest = got.get(_RANGES, np.zeros(2 * h * (1 << RECORD_BITS) + 4 * h, np.int64))
    record = rest[: 2 * h << RECORD_BITS].reshape(2 * h, -1)
    totals = rest[2 * h << RECORD_BITS :].reshape(2, h, 2)
    weight, prior = [], []
    for view, counts in enumerate((text, record)):
        rows = []
        for head in range(h):
            zero, one = counts[2 * head] / TRUE_WEIGHT, counts[2 * head + 1] / TRUE_WEIGHT
            share = (totals[view, head, 1] + 1) / (totals[view, head].sum() + 2)
            n = zero + one
            p = (one + SHRINK * share) / (n + SHRINK)
            lift = np.log(p / (1 - p)) - np.log(share / (1 - share))
            clear = np.abs(one - n * share) >= CLEAR * np.sqrt(np.maximum(n * share * (1 - share), 1e-12))
            rows.append(np.where(clear & (n > 0), lift, 0.0))
            prior.append(float(np.log(share / (1 - share))))
        weight.append(np.stack(rows).astype(np.float32))
    prior = np.array(prior).reshape(2, h)
    return {"weight": weight, "prior": prior, "line": [[(1.0, prior[v, i]) for i in range(h)] for v in range(2)]}


def _fit_line(hist: np.ndarray, prior: float) -> tuple[float, float]:
    """Logistic calibration (slope, offset) of binned scores by Newton steps, drawn to (1, prior)."""
    x = (np.arange(_BINS) - _BINS // 2) * _STEP
    n, one = hist.sum(0).astype(float), hist[1].astype(float)
    w, start = np.array([1.0, prior]), np.array([1.0, prior])
    pull = np.array([1.0, 1.0])
    for _ in range(50):
        p = _sigmoid(w[0] * x + w[1])
        e, v = one - n * p, n * p * (1 - p)
        grad = np.array([(e * x).sum(), e.sum()]) - pull * (w - start)
        hess = np.array([[(v * x * x).sum(), (v * x).sum()], [(v * x).sum(), v.sum()]]) + np.diag(pull)
        move = np.linalg.solve(hess, grad)
        w = w + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    return max(float(w[0]), 0.0), float(w[1])


def _score(model):
    def run(blocks: pa.Table, told: pa.Table) -> pa.Table:
        d, m = _Docs(blocks, told), model.value
        out = {"doc_id": d.doc_id}
        for head, name in enumerate(HEADS):
            text, record = d.logit(m, 0, head), d.logit(m, 1, head)
            prior = float(m["prior"][:, head].mean())
            out |= {f"text_{name}": pa.array(_sigmoid(text)), f"record_{name}": pa.array(_sigmoid(record)), f"p_{name}": pa.array(_sigmoid(text + record - prior))}
        return pa.table(out)

    return run


def score_quality(docs: DataFrame, labels: DataFrame, rounds: int = 2) -> DataFrame:
    """doc_id, score, keep, p_quality, p_toxic and each view's opinion of each row."""
    sc = docs.sparkSession.sparkContext
    record = [c for c in RECORD if c in docs.columns]
    blocks, _ = B.document_blocks(docs, "quality", _make(record), carry=record)
    mark = {h: F.when(F.avg(F.col(h).cast("double")) >= 0.5, 1).when(F.avg(F.col(h).cast("double")) < 0.5, 0) for h in HEADS}
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[v.alias(h) for h, v in mark.items()])
    known = known.withColumn("aside", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(ASIDE)) == 0)
    named = blocks.select("block", "payload").mapInArrow(_names, "uid long, doc_id long").join(known, "doc_id")
    told = materialize(named.withColumn("block", F.shiftright("uid", 16)).groupBy("block").applyInArrow(_tell_labels, B.PAYLOAD), "labels")

    def each(make, model) -> dict[int, np.ndarray]:
        return add_vectors(B.with_blocks(blocks, told, make(model), B.PAYLOAD))

    model = None
    for _ in range(rounds + 1):
        learnt = _learn(each(_count, model))
        model = sc.broadcast(learnt)
        hist = each(_histogram, model).get(0, np.zeros(2 * len(HEADS) * 2 * _BINS, np.int64)).reshape(2, len(HEADS), 2, _BINS)
        learnt["line"] = [[_fit_line(hist[v, h], learnt["prior"][v, h]) for h in range(len(HEADS))] for v in range(2)]
        model = sc.broadcast(learnt)
    fields = [f"{v}_{h}" for h in HEADS for v in ("text", "record", "p")]
    out = B.with_blocks(blocks, told, _score(model), "doc_id long, " + ", ".join(f"{f} double" for f in fields))
    return out.select("doc_id", (F.col("p_quality") * (1 - F.col("p_toxic"))).alias("score"), ((F.col("p_quality") >= 0.5) & (F.col("p_toxic") < 0.5)).alias("keep"), "p_quality", "p_toxic", *[f for f in fields if f[0] != "p"])
