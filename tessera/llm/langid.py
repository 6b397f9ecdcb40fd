"""Language of texts by fusing evidence.

Four kinds of evidence about a row are combined by Bayes' rule:

* its text, under byte-trigram models of each language (and, as the class
  ``und``, a model to which all letters are alike, which wins on text that is
  in none of them);
* the language that its markup or record declares;
* the suffix of its address (top-level label);
* where it comes from: a host's language shares, smoothed towards those of its
  domain, and those towards all rows. A row's own share is left out of its
  host's and domain's.

The trigram counts are summed per task and added up by ranges, so what is
sent is of fixed size per task; shares are grouped aggregations over what the
texts say, joined back by host. Only the model (fixed size) reaches the
driver. No text is shuffled.

A null declaration, address or host is no evidence. A text without letters
(null, empty, blank) says nothing: its language follows from the other
evidence, and it is not accepted. Rows count for themselves, so repeated or
null ids are fine. An empty table gives no rows; without training rows every
language is equally likely. A text of any length is read in the task that holds
it, half a megabyte at a time or as a whole if it is longer. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import blocks as B
from tessera.llm.kernels import portions, text_arrays
from tessera.session import materialize, ship_package

BUCKETS = 1 << 16
_RANGES, _SPLIT = 16, 64
TEMPER = 1 / 3
"""Weight of a trigram: neighbouring ones overlap in two bytes, so three count as one."""
UNKNOWN = 1e-3
"""Prior share of texts in no known language."""
ALIKE = 3 * np.log(1 / 32)
"""Log-likelihood of any trigram as ``und``: three bytes, each one of 32."""
UNSEEN = 0.05
"""Share of a language's trigrams that are as good as drawn at random."""
HOST_STRENGTH = 20.0
"""Rows of a parent's opinion that a host or domain starts with."""
DECLARED_SHARE = 0.001
"""Share of the declaring rows that makes a code one of the languages."""
DECLARED_TRUST = 0.9
"""How often a declaration is right before any row is seen."""

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def _trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram that ends at each byte, as three bytes; its bucket; whether it tells anything).

    Letters are folded to lower case, all else to blanks; runs of blanks tell nothing.
    """
    low = _FOLD[data]
    wide = low.astype(np.uint32)
    one, two = np.full(len(wide), 0x20, np.uint32), np.full(len(wide), 0x20, np.uint32)
    one[1:], two[2:] = wide[:-1], wide[:-2]
    first = off[:-1][np.diff(off) > 0]
    one[first], two[first] = 0x20, 0x20
    second = first + 1
    second = second[second < len(two)]
    two[second] = 0x20
    tells = ~((wide == 0x20) & (one == 0x20))
    code = two << 16 | one << 8 | wide
    return code, (code * np.uint32(0x9E3779B1)) >> np.uint32(16), tells


def declared_languages(docs: DataFrame, otherwise: tuple[str, ...] = (), share: float = DECLARED_SHARE) -> tuple[str, ...]:
    """The languages that at least this share of the declaring rows declare (so fewer than 1 / share), in order.

    ``otherwise``: the languages where no row declares one. Codes are taken in lower case; ``und`` is none.
    """
    said = F.lower(F.trim(_as_text(F.col("lang"))))
    counts = docs.select(said.alias("lang")).where("lang is not null and lang not in ('', 'und')").groupBy("lang").count()
    least = (counts.agg(F.sum("count")).first()[0] or 0) * share
    return tuple(sorted(r["lang"] for r in counts.where(F.col("count") >= max(1.0, least)).collect())) or otherwise


def _count(languages: tuple[str, ...]):
    at = {lang: i for i, lang in enumerate(languages)}

    def run(batches):
        from pyspark import TaskContext

        grams = np.zeros((len(languages), BUCKETS), np.int64)
        for b in batches:
            data, off = text_arrays(b.column(1))
            which = np.array([at.get(x, -1) for x in b.column(0).to_pylist()], np.int64)
            for lo, hi in portions(off, 1 << 19):
                o = off[lo : hi + 1] - off[lo]
                _, code, tells = _trigrams(data[off[lo] : off[hi]], o)
                lang = np.repeat(which[lo:hi], np.diff(o))
                ok = tells & (lang >= 0)
                grams += np.bincount(lang[ok] * BUCKETS + code[ok], minlength=grams.size).reshape(grams.shape)
        task, step = TaskContext.get().partitionId(), BUCKETS // _RANGES
        if grams.any():
            yield B.rows([(task, d, B.squeeze(grams[:, d * step : (d + 1) * step].ravel())) for d in range(_RANGES)])

    return run


def _add(batches):
    total, dest = None, None
    for b in batches:
        for d, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            got = B.unsqueeze(p, np.int64)
            total, dest = (got if total is None else total + got), d
    if total is not None:
        yield B.rows([(0, dest, B.squeeze(total))])


def add_vectors(sent: DataFrame) -> dict[int, np.ndarray]:
    """Sum of the integer vectors sent to each range (their number and length are fixed).

    Senders are summed in ``_SPLIT`` shares of a range first, so no task reads what all have sent.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _add(batches)

    some = sent.groupBy("dest", F.pmod(F.xxhash64("block"), F.lit(_SPLIT))).applyInArrow(run, B.PAYLOAD)
    return {r["dest"]: B.unsqueeze(r["payload"], np.int64) for r in some.groupBy("dest").applyInArrow(run, B.PAYLOAD).collect()}


def train(labelled: DataFrame, languages: tuple[str, ...]) -> np.ndarray:
    """Log-likelihoods (trigram bucket, language) from rows (lang, text)."""
    ship_package(labelled.sparkSession)
    got = add_vectors(labelled.select("lang", "text").mapInArrow(_count(languages), B.PAYLOAD))
    k, step = len(languages), BUCKETS // _RANGES
    grams = np.zeros((k, BUCKETS))
    for d in range(_RANGES):
        if d in got:
            grams[:, d * step : (d + 1) * step] = got[d].reshape(k, step)
    pooled = grams.sum(0) + 0.5
    pooled /= pooled.sum()
    grams = (grams + 500.0 * pooled) / (grams.sum(1, keepdims=True) + 500.0)
    # a few trigrams that a language hasn't shown yet are no evidence for none at all
    return np.ascontiguousarray(np.log((1 - UNSEEN) * grams.T + UNSEEN * np.exp(ALIKE)).astype(np.float32))


def text_evidence(col: pa.Array, model) -> np.ndarray:
    """Tempered log-likelihood of each text under each language and, last, ``und``; NaN without letters."""
    data, off = text_arrays(col)
    out = np.full((len(off) - 1, model.shape[1] + 1), np.nan)
    for lo, hi in portions(off, 1 << 19):
        o = off[lo : hi + 1] - off[lo]
        three, code, tells = _trigrams(data[off[lo] : off[hi]], o)
        if not len(three):
            continue
        at = np.flatnonzero(tells)
        cut = np.searchsorted(at, o)
        letters = np.concatenate([[0], np.cumsum((three & 255) != 0x20)])[o]
        own = np.flatnonzero((np.diff(cut) > 0) & (np.diff(letters) > 0))
        if not len(own):
            continue
        # texts without any telling trigram are left out, so each sum ends where the next begins
        out[lo + own, :-1] = np.add.reduceat(model[code[at]], cut[:-1][own], axis=0, dtype=np.float64) * TEMPER
        out[lo + own, -1] = np.diff(cut)[own] * (ALIKE * TEMPER)
    return out


_MARKUP = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-zA-Z#0-9]+;")


def _softmax(logs: Column) -> Column:
    e = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def _shares(df: DataFrame, key: str, k: int, name: str) -> DataFrame:
    """Rows and summed language shares of each key (partial sums before the shuffle)."""
    some = df.where(F.col(key).isNotNull() & F.col("seen"))
    return some.groupBy(key).agg(F.count("*").alias(f"{name}_n"), F.array(*[F.sum(F.col("share")[i]) for i in range(k)]).alias(f"{name}_sum"))


def fuse(scored: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """Adds language, probability, accepted, text_language to rows that have ``logs``, declared, host, domain, suffix.

    ``logs``: tempered text log-likelihoods, languages then und; null without text evidence.
    """
    k = len(languages)
    names = F.array(*[F.lit(x) for x in languages])
    known = F.slice("logs", 1, k)
    df = scored.withColumn("seen", F.col("logs").isNotNull())
    df = df.withColumn("share", F.when(F.col("seen"), _softmax(known)).otherwise(F.array(*[F.lit(1.0 / k)] * k)))
    df = df.withColumn("claim", F.when(F.array_contains(names, F.lower("declared")), F.lower("declared")))
    df = materialize(df, "evidence")

    # shares of all rows, and of each declaration: fixed numbers
    row = df.where("seen").agg(F.count("*").alias("n"), *[F.sum(F.col("share")[i]).alias(f"s{i}") for i in range(k)]).first()
    base = [((row[f"s{i}"] or 0.0) + HOST_STRENGTH / k) / (row["n"] + HOST_STRENGTH) for i in range(k)]
    said = {r["claim"]: r for r in _shares(df, "claim", k, "claim").collect()}
    lift = {}
    for i, lang in enumerate(languages):
        got = said.get(lang)
        total, sums = (got["claim_n"], got["claim_sum"]) if got else (0, [0.0] * k)
        guess = [DECLARED_TRUST if j == i else (1 - DECLARED_TRUST) / max(1, k - 1) for j in range(k)]
        lift[lang] = [(sums[j] + HOST_STRENGTH * guess[j]) / (total + HOST_STRENGTH) / base[j] for j in range(k)]
    whole = F.array(*[F.lit(b) for b in base])
    claim = F.lit(None).cast("array<double>")
    for lang, v in lift.items():
        claim = F.when(F.col("claim") == lang, F.array(*[F.lit(float(np.log(x))) for x in v])).otherwise(claim)

    # rows without a key meet nothing: each gets a key of its own, or they would all meet in one task
    own = F.concat(F.lit("\x00"), F.xxhash64(*df.columns).cast("string"))
    for key in ("suffix", "domain", "host"):
        there = _shares(df, key, k, key).withColumnRenamed(key, "_key")
        df = df.withColumn("_key", F.coalesce(key, own)).join(there, "_key", "left").drop("_key")

    def smoothed(name: str, parent: Column) -> Column:
        """Shares of a key without the row's own, drawn to the parent's."""
        own = F.when(F.col("seen"), F.lit(1.0)).otherwise(F.lit(0.0))
        rest = F.zip_with(f"{name}_sum", "share", lambda s, p: F.greatest(s - p * own, F.lit(0.0)))
        out = F.zip_with(rest, parent, lambda s, q: (s + F.lit(HOST_STRENGTH) * q) / (F.col(f"{name}_n") - own + F.lit(HOST_STRENGTH)))
        return F.when(F.col(f"{name}_n").isNotNull(), out).otherwise(parent)

    df = df.withColumn("by_domain", smoothed("domain", whole))
    df = df.withColumn("prior", smoothed("host", F.col("by_domain")))
    df = df.withColumn("by_suffix", F.zip_with(smoothed("suffix", whole), whole, lambda a, b: F.log(a / b)))
    zero = F.array(*[F.lit(0.0)] * k)
    text = F.coalesce("logs", F.array(*[F.lit(0.0)] * (k + 1)))
    logs = F.zip_with(F.slice(text, 1, k), "prior", lambda a, b: a + F.log(b))
    for more in (F.coalesce("by_suffix", zero), F.coalesce(claim, zero)):
        logs = F.zip_with(logs, more, lambda a, b: a + b)
    logs = F.concat(F.transform(logs, lambda x: x + F.lit(float(np.log(1 - UNKNOWN)))), F.array(F.element_at(text, -1) + F.lit(float(np.log(UNKNOWN)))))
    df = df.withColumn("total", _softmax(logs))
    best = F.array_max("total")
    df = df.withColumn("language", F.element_at(F.concat(names, F.array(F.lit("und"))), F.array_position("total", best).cast("int")))
    df = df.withColumn("probability", best).withColumn("accepted", F.col("seen") & (F.col("language") != "und") & (best >= 0.5))
    return df.withColumn("text_language", F.when(F.col("seen"), F.element_at(names, F.array_position("share", F.array_max("share")).cast("int"))))


def score_texts(df: DataFrame, model, id_name: str, markup: bool = False) -> DataFrame:
    """(id, declared, host, domain, suffix, logs) from rows (id, text, declared, host, domain, suffix)."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            col = b.column(1)
            if markup:
                col = pa.array([None if t is None else _MARKUP.sub(" ", t) for t in col.to_pylist()], pa.string())
            logs = text_evidence(col, held.value)
            items = [None if np.isnan(x[0]) else x.tolist() for x in logs]
            yield pa.RecordBatch.from_arrays([b.column(0), *(b.column(i) for i in range(2, 6)), pa.array(items, pa.list_(pa.float64()))], names=[id_name, "declared", "host", "domain", "suffix", "logs"])

    return df.mapInArrow(run, f"{id_name} long, declared string, host string, domain string, suffix string, logs array<double>")


def _as_text(c: Column) -> Column:
    return c.cast("string")


def document_evidence(docs: DataFrame) -> DataFrame:
    """Documents declare a language and come from a source; they have no address."""
    none = F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long"), _as_text(F.col("text")), _as_text(F.col("lang")).alias("declared"), _as_text(F.col("source")).alias("host"), none.alias("domain"), none.alias("suffix"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """Pages declare ``<html lang>`` and have an address."""
    host = F.lower(F.regexp_extract(_as_text(F.col("url")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    host = F.when(host != "", host)
    said = F.lower(F.regexp_extract(_as_text(F.col("html")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    return pages.select(
        F.col("page_id").cast("long"),
        _as_text(F.col("html")).alias("text"),
        F.when(said != "", said).alias("declared"),
        host.alias("host"),
        F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"),
        F.substring_index(host, ".", -1).alias("suffix"),
    )


_OUT = ("language", "probability", "accepted", "text_language")


def identify_documents(docs: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """doc_id, language ('und' if none fits), probability, accepted, text_language of each document."""
    model = train(docs.select(F.lower(F.trim(_as_text(F.col("lang")))).alias("lang"), _as_text(F.col("text")).alias("text")), languages)
    scored = score_texts(document_evidence(docs), model, "doc_id")
    return fuse(scored, languages).select("doc_id", *_OUT)


def identify_pages(pages: DataFrame, docs: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """page_id, language, probability, accepted, text_language of each page, with models of the documents."""
    model = train(docs.select(F.lower(F.trim(_as_text(F.col("lang")))).alias("lang"), _as_text(F.col("text")).alias("text")), languages)
    return fuse(score_texts(page_evidence(pages), model, "page_id", True), languages).select("page_id", *_OUT)


def accepted_documents(docs: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """The rows of ``docs`` whose language is accepted, unchanged; texts stay in their blocks."""
    model = train(docs.select(F.lower(F.trim(_as_text(F.col("lang")))).alias("lang"), _as_text(F.col("text")).alias("text")), languages)
    blocks, _ = B.row_blocks(docs, "langid")
    return B.keep_rows(blocks, fuse(_score_blocks(blocks, docs, model), languages).where("accepted").select("uid"), docs)


def _score_blocks(blocks: DataFrame, docs: DataFrame, model) -> DataFrame:
    """``score_texts`` of the rows in blocks, read and scored in one step (one Python worker a task)."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), B.others(docs)

    def run(batches):
        for b in batches:
            for block, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = B.unpack(payload)
                logs = text_evidence(t.column("text"), held.value)
                items = [None if np.isnan(x[0]) else x.tolist() for x in logs]
                none = pa.nulls(t.num_rows, pa.string())
                said, host = (t.column(f"c{at.index(c)}").combine_chunks().cast(pa.string()) for c in ("lang", "source"))
                uid = pa.array((np.int64(block) << 16) | np.arange(t.num_rows))
                yield pa.RecordBatch.from_arrays([uid, said, host, none, none, pa.array(items, pa.list_(pa.float64()))], names=["uid", "declared", "host", "domain", "suffix", "logs"])
            B.release()

    return blocks.select("block", "payload").mapInArrow(run, "uid long, declared string, host string, domain string, suffix string, logs array<double>")
