"""Importance resampling towards a target distribution.

Features of a text are its runs of one to three words, hashed to buckets. A
bucket's *gain* compares its share in the target with that in the corpus; a
document's weight sums the gains of its features, read from an array; a hash
of its id adds Gumbel noise, so that the highest scores are a draw without
replacement in proportion to exp(weight).

The draw needs the k highest of all scores, exactly. They are not sorted as a
whole: each partition tells the median of the keys that may still be the
cutoff, and how many these are; the median of those medians, weighted by the
numbers, is the pivot (taken twice: over shares of the medians, then over what
these give). At least an eighth of all keys lies on either side of it, so each
round discards such a fraction for good, until a pivot's own place is the k-th.
Keys are written again when few are left, so the later rounds read
little. Only the winners are sorted, by ranges.

Words are hashed by columns of bytes, and runs of words by the linearity of
the checksum: crc(ab) = shift(crc(a), len(b)) ^ crc(b), so no run is ever
spelled out.

Edge cases. A null text, or one without words, has no features: weight 0, and
it isn't drawn. A null ``doc_id`` gives noise like an empty id (hash of
``<seed>:``) and ranks behind the others of its score. Rows of equal id and
score are drawn in the order of weight, then of n_features; rows equal in all
of these are interchangeable, each counts for itself. A text of any length is
read in the task that holds it, and counts reach Spark as one row a bucket.
Columns besides ``doc_id`` and ``text`` are not read, whatever their names. An
empty corpus gives no rows, an empty target gains from smoothing alone.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.kernels import portions, text_arrays
from tessera.session import materialize, ship_package

BUCKETS, RUN = 10_000, 3
SHORT = 32
"""Bytes of a word that is hashed by columns; longer words are hashed one by one."""
FAN = 1_000
"""Medians that come to the driver in a round, at most."""
PART_KEYS = 1 << 20
"""Keys of a partition, where they are written again; winners of a range."""

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_T = _crc_table()


def _shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """What appending n zero bytes makes of a checksum, for each of its bytes: n < 64, and n = 64, 128, 256, ..."""
    eye = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    few = [eye]
    for _ in range(63):
        few.append(_T[few[-1] & 0xFF] ^ (few[-1] >> np.uint32(8)))
    many, now = [], _T[few[-1] & 0xFF] ^ (few[-1] >> np.uint32(8))
    for _ in range(30):
        many.append(now)
        now = _apply(now, now)
    return np.stack(few), many


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = table[0][crc & 0xFF]
    for k in range(1, 4):
        out = out ^ table[k][(crc >> np.uint32(8 * k)) & 0xFF]
    return out


_FEW, _MANY = _shift_tables()
_FLAT = np.ascontiguousarray(_FEW.transpose(1, 0, 2)).reshape(4, -1)


def crc_join(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Checksums of joined strings from those of both parts and the sizes of the right ones."""
    at = (size & 63) << 8
    out = _FLAT[0][at + (left & 0xFF)]
    for k in range(1, 4):
        out ^= _FLAT[k][at + ((left >> np.uint32(8 * k)) & 0xFF)]
    big = np.flatnonzero(size > 63)
    for bit, table in enumerate(_MANY):
        big = big[(size[big] >> 6 >> bit) > 0]
        if not len(big):
            break
        on = big[((size[big] >> 6 >> bit) & 1) == 1]
        out[on] = _apply(table, out[on])
    return out ^ right


def _space(crc: np.ndarray) -> np.ndarray:
    """Checksums of strings with a space appended."""
    c = ~crc
    return ~(_T[(c ^ np.uint32(0x20)) & 0xFF] ^ (c >> np.uint32(8)))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts; a word never crosses a text's end."""
    n = len(data)
    inside = _WORD[data]
    cut = np.ones(n + 1, bool)
    cut[1:n] = inside[1:] != inside[:-1]
    cut[offsets] = True
    at = np.flatnonzero(cut)
    start, end = at[:-1], at[1:]
    keep = inside[start]
    return start[keep], end[keep]


def word_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of each span of ``data``."""
    size = end - start
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    order = np.argsort(np.minimum(size, SHORT + 1), kind="stable")
    held = np.searchsorted(size[order], np.arange(1, SHORT + 2), side="left") if len(order) else np.zeros(SHORT + 1, int)
    short = order[: int(np.count_nonzero(size <= SHORT))]
    c, s = crc[short], start[short]
    for j in range(SHORT):
        lo = int(held[j])  # words of more than j bytes
        if lo >= len(short):
            break
        x = c[lo:]
        c[lo:] = _T[(x ^ data[s[lo:] + j]) & 0xFF] ^ (x >> np.uint32(8))
    crc[short] = ~c
    for i in order[len(short) :].tolist():
        crc[i] = zlib.crc32(data[start[i] : end[i]])
    return crc


def text_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, bucket of each feature, text of each feature)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return np.zeros(len(offsets) - 1, np.int64), z, z
    data = _LOWER[data]
    start, end = word_spans(data, offsets)
    own = np.searchsorted(offsets, start, side="right") - 1
    count = np.bincount(own, minlength=len(offsets) - 1)
    crc, size = word_crcs(data, start, end), end - start
    whole, out, texts = crc, [crc], [own]
    for j in range(1, run):
        whole, at = crc_join(_space(whole[:-1]), crc[j:], size[j:]), np.flatnonzero(own[j:] == own[:-j]) if len(own) > j else np.zeros(0, np.int64)
        out.append(whole[at])
        texts.append(own[at])
    return count, (np.concatenate(out) % np.uint32(buckets)).astype(np.int64), np.concatenate(texts)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text"))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """(bucket, n): features of all texts in each bucket; a task sums its texts before it sends."""
    ship_package(texts.sparkSession)

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            data, off = text_arrays(b.column(0))
            for lo, hi in portions(off):
                total += np.bincount(text_buckets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], buckets, run)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return _texts(texts).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS, run: int = RUN) -> np.ndarray:
    """Gain of each bucket, 1000 times the log of its smoothed shares' ratio, floored (``buckets`` numbers on the driver)."""

    def held(texts):
        out = [0] * buckets
        for r in bucket_counts(texts, buckets, run).collect():
            out[r.bucket] = r.n
        return out, sum(out)

    (t, all_t), (s, all_s) = held(target), held(corpus)
    return np.array([math.floor(1000 * math.log((a + 1) * (all_s + buckets) / ((b + 1) * (all_t + buckets)))) for a, b in zip(t, s, strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, run: int = RUN) -> DataFrame:
    """doc_id, n_words, n_features, weight of every document; narrow."""
    buckets = len(gain)

    def score(batches):
        for b in batches:
            data, off = text_arrays(b.column(1))
            words, features, weight = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for lo, hi in portions(off):
                n, at, text = text_buckets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], buckets, run)
                words[lo:hi] = n
                features[lo:hi] = np.bincount(text, minlength=hi - lo)
                np.add.at(weight[lo:hi], text, gain[at])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    ship_package(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int, doc_id: str = "doc_id"):
    """floor(1000 times Gumbel noise) from the hash of ``<seed>:<doc_id>``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


# -- selection ---------------------------------------------------------------

KEY = ("k0", "k1", "k2", "k3")
"""Columns of a key, all long: the smaller the better."""
Key = tuple[int, int, int, int]


def _before(pivot: Key, strict: bool = True):
    """Condition: the key is smaller than the pivot (or equal to it)."""
    out = F.lit(not strict)
    for c, v in reversed(list(zip(KEY, pivot, strict=True))):
        out = (F.col(c) < F.lit(v)) | ((F.col(c) == F.lit(v)) & out)
    return out


def _sorted(cols: list[np.ndarray]) -> np.ndarray:
    return np.lexsort(cols[::-1])


_MEDIAN = ", ".join(f"{c} long" for c in (*KEY, "n"))


def _medians(batches):
    """The median key of a partition, its rows and its number."""
    from pyspark import TaskContext

    t = [b for b in batches if b.num_rows]
    if t:
        whole = pa.Table.from_batches(t)
        cols = [whole.column(c).to_numpy() for c in KEY]
        i = _sorted(cols)[(whole.num_rows - 1) // 2]
        yield pa.RecordBatch.from_pydict({c: [int(x[i])] for c, x in zip(KEY, cols, strict=True)} | {"n": [whole.num_rows], "part": pa.array([TaskContext.get().partitionId()], pa.int32())})


def _weighted(t: pa.Table) -> tuple[int, int]:
    """(place of the weighted median, all weights) of medians with their numbers."""
    order = _sorted([t.column(c).to_numpy() for c in KEY])
    n = t.column("n").to_numpy()[order]
    return int(order[np.searchsorted(np.cumsum(n), (n.sum() + 1) // 2)]), int(n.sum())


def _combined(medians: DataFrame, fan: int) -> pa.Table:
    """``fan`` weighted medians at most, each of a share of the medians."""
    kind = pa.schema([(c, pa.int64()) for c in (*KEY, "n")])

    def run(t: pa.Table) -> pa.Table:
        i, n = _weighted(t)
        return pa.table([*(t.column(c).slice(i, 1) for c in KEY), pa.array([n])], schema=kind)

    of = medians.groupBy(F.pmod("part", F.lit(fan))).applyInArrow(run, _MEDIAN)
    return pa.Table.from_pylist([r.asDict() for r in of.collect()], kind)


def cutoff(keys: DataFrame, k: int, fan: int = FAN) -> Key | None:
    """The k-th smallest key of ``keys`` (``KEY`` columns; a written table): None if there is none.

    At most ``fan`` medians come to the driver in a round. Each round reads
    the keys that are left, for the medians and for the pivot's place.
    """
    left, rest, n = keys, k, keys.count()
    if not 0 < k <= n:
        return None
    held = n  # rows of the table that is read
    while True:
        t = _combined(left.mapInArrow(_medians, _MEDIAN + ", part int"), fan)
        row = t.slice(_weighted(t)[0], 1).to_pylist()[0]
        pivot = tuple(row[c] for c in KEY)
        less, upto = left.agg(F.count_if(_before(pivot)), F.count_if(_before(pivot, False))).first()
        if less < rest <= upto:
            return pivot
        left = left.where(_before(pivot)) if rest <= less else left.where(~_before(pivot, False))
        n = less if rest <= less else n - upto
        rest = rest if rest <= less else rest - upto
        if n * 16 <= held:
            left, held = materialize(left.repartition(-(-n // PART_KEYS)), "keys"), n


def ranked(rows: DataFrame, order: list[str], name: str, per: int = PART_KEYS) -> DataFrame:
    """Add ``name``: 1, 2, ... over all rows in the order of these columns, by ranges of about ``per`` rows at most.

    One count a range comes to the driver.
    """
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = rows.repartitionByRange(max(least, -(-rows.count() // per)), *order).withColumn("_part", F.spark_partition_id())
    held = materialize(parts, "ranges")
    before, at = [], 0
    for p, c in sorted((r._part, r["count"]) for r in held.groupBy("_part").count().collect()):
        before.append((p, at))
        at += c
    shift = rows.sparkSession.createDataFrame(before, "_part int, _before long")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return held.withColumn(name, own).join(F.broadcast(shift), "_part").withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_part", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42, buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null where it isn't drawn.

    ``percent`` of the documents of at least ``min_words`` words are drawn.
    ``target`` needs a ``text`` column.
    """
    gain = gains(docs, target, buckets, run)
    scored = weights(docs, gain, run).withColumn("score", F.col("weight") + noise(seed))
    far = F.lit((1 << 63) - 1)
    keys = dict(zip(KEY, (-F.col("score"), F.coalesce(F.col("doc_id"), far), -F.col("weight"), -F.col("n_features")), strict=True))
    scored = materialize(scored.withColumns(keys), "scores")
    may = scored.where(F.col("n_words") >= min_words)
    k = percent * may.count() // 100
    last = cutoff(may.select(*KEY), k)
    out = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    wins = (F.col("n_words") >= min_words) & _before(last, False)
    drawn = ranked(scored.where(wins).select(*out, *KEY), list(KEY), "rank")
    # of rows equal to the cutoff key only so many are drawn as there is room for
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return drawn.select(*out, "rank").unionByName(scored.where(~wins).select(*out, F.lit(None).cast("long").alias("rank")))
