"""Approximate nearest neighbours by residual codes (K3): few bytes of a vector are read until it matters.

Build. A two-level tree of centroids gives every vector its list: the nearest
centroids of the upper level, then the nearest of their children, so no vector
is held against all lists. What is left after subtracting the list's centroid
is cut into subspaces, and each part is replaced by the number of its nearest
codeword: a vector's code has one byte for each subspace (product
quantisation). The centroids and codewords are trained on a sample of at most
``TRAIN_BYTES`` of vectors, taken by a hash of the key; every vector is coded.

Search. A query probes its ``nprobe`` nearest lists. Their codes (not their
vectors) are scanned by table lookup: distances from the query's residual to
all codewords are computed once for a list, and a code's distance is the sum
of its entries. The ``rerank`` best of a query are then compared exactly, by
their vectors. Stored vectors are partitioned by upper centroid and sorted by
list, so only files of probed parts are opened.

For a cosine index vectors and queries are scaled to length one first.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.vector import distance, l2_normalize
from tessera.operators.index import MAX_FILE_ROWS
from tessera.operators.knn import INDEX_BLOCK, QUERY_BLOCK, SLICE, _checked, _matrix, _pack, check_top_k
from tessera.schema import IndexSpec
from tessera.session import materialize

TRAIN_BYTES = 64 << 20
"""Bytes of vectors that are trained on, about."""
CENTROID_BYTES = 64 << 20
"""Bytes of all centroids at most: they travel to the tasks."""
PAIRS = 1 << 20
"""Distances that a task holds at a time."""
WORDS = 256
"""Codewords of a subspace: a part's code is a byte."""
BEAM = 3
"""Upper centroids whose children are looked at for a vector."""


class PQIndex:
    """Stored or lazy codes (key, vec, top, list_id, code) and what they were made with."""

    def __init__(self, codes: DataFrame, upper: np.ndarray, lower: list[np.ndarray], books: np.ndarray, spec: IndexSpec):
        self.codes, self.spec = codes, spec
        self.upper = upper  # (upper centroids, dim)
        self.lower = lower  # the children of each
        self.books = books  # (subspaces, WORDS, dim of a subspace)
        self.first = np.cumsum([0, *(len(c) for c in lower)])  # number of each upper centroid's first list

    @property
    def lists(self) -> int:
        return int(self.first[-1])


def lloyd(x: np.ndarray, k: int, seed: int, iterations: int = 12) -> np.ndarray:
    """At most k centroids of the rows of x; a centroid without rows moves to the row farthest from its own."""
    r = np.random.default_rng(seed)
    c = x[r.permutation(len(x))[:k]].astype(np.float64)
    for _ in range(iterations):
        own, near = _nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = total / np.maximum(n, 1)[:, None]
        empty = np.flatnonzero(n == 0)
        if len(empty):
            far = np.argsort(near + (x * x).sum(1))[::-1][: len(empty)]
            c[empty[: len(far)]] = x[far]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest of ``c`` and its squared distance less the row's own square; ``PAIRS`` distances are held at a time."""
    own, near = np.empty(len(x), np.int64), np.empty(len(x))
    square, step = (c * c).sum(1)[None, :], max(1, PAIRS // max(1, len(c)))
    for lo in range(0, len(x), step):
        d = square - 2.0 * (x[lo : lo + step] @ c.T)
        at = d.argmin(1)
        own[lo : lo + step], near[lo : lo + step] = at, d[np.arange(len(d)), at]
    return own, near


def lists_of(rows: int, dim: int) -> int:
    """Lists for so many vectors: the square root, as far as the centroids' bytes allow."""
    return max(1, min(round(rows**0.5), CENTROID_BYTES // (4 * dim)))


def _unit(x: np.ndarray, metric: str) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if metric == "cosine" else x


def nearest_lists(x: np.ndarray, upper: np.ndarray, lower: list[np.ndarray], first: np.ndarray, n: int, beam: int) -> np.ndarray:
    """The n nearest lists of each row among the children of its ``beam`` nearest upper centroids (-1 where there are fewer)."""
    d = (upper * upper).sum(1)[None, :] - 2.0 * (x @ upper.T)
    beam = min(beam, len(upper))
    tops = np.argpartition(d, beam - 1, axis=1)[:, :beam] if beam < len(upper) else np.broadcast_to(np.arange(len(upper)), d.shape)
    width = max(len(c) for c in lower)
    far = np.full((len(x), beam * width), np.inf)
    number = np.full((len(x), beam * width), -1, np.int64)
    for t in np.unique(tops).tolist():
        rows, at = np.nonzero(tops == t)
        c = lower[t]
        cols = at[:, None] * width + np.arange(len(c))[None, :]
        far[rows[:, None], cols] = (c * c).sum(1)[None, :] - 2.0 * (x[rows] @ c.T)
        number[rows[:, None], cols] = first[t] + np.arange(len(c))[None, :]
    n = min(n, far.shape[1])
    best = np.argpartition(far, n - 1, axis=1)[:, :n] if n < far.shape[1] else np.broadcast_to(np.arange(n), far.shape)
    return np.where(np.isfinite(np.take_along_axis(far, best, 1)), np.take_along_axis(number, best, 1), -1)


def encode(residual: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(rows, subspaces) bytes: the nearest codeword of each part."""
    m, _, width = books.shape
    out = np.empty((len(residual), m), np.uint8)
    for s in range(m):
        out[:, s] = _nearest(residual[:, s * width : (s + 1) * width], books[s])[0]
    return out


def lookup(q: np.ndarray, books: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distances of query residuals and coded residuals, from tables."""
    m, _, width = books.shape
    out = np.zeros((len(q), len(codes)))
    for s in range(m):
        part, b = q[:, s * width : (s + 1) * width], books[s]
        table = (part * part).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (part @ b.T)
        out += table[:, codes[:, s]]
    return out


def _train(index: DataFrame, spec: IndexSpec, n_lists: int, subspaces: int, seed: int, key_col: str, vec_col: str):
    """(upper, lower, books) from the sample."""
    sample = materialize(index, "sample")
    unit = l2_normalize(vec_col) if spec.metric == "cosine" else F.col(vec_col)
    k1 = max(1, round(n_lists**0.5))
    feats = sample.withColumn("features", array_to_vector(unit))
    model = KMeans(k=k1, seed=seed, maxIter=10, featuresCol="features", predictionCol="top").fit(feats)
    upper = np.array(model.clusterCenters())
    k2 = -(-n_lists // len(upper))

    def children(t: pa.Table) -> pa.Table:
        top = t.column("top")[0].as_py()
        c = lloyd(_unit(_matrix(t.select(["top", vec_col])), spec.metric), k2, seed + top)
        return pa.table({"top": pa.array([top], pa.int32()), "c": pa.array([c.tobytes()], pa.binary())})

    split = model.transform(feats).select(F.col("top").cast("int").alias("top"), vec_col).groupBy("top").applyInArrow(children, "top int, c binary").collect()
    got = {r.top: np.frombuffer(r.c).reshape(-1, spec.dim) for r in split}
    upper = upper[sorted(got)]
    lower = [got[t] for t in sorted(got)]
    first = np.cumsum([0, *(len(c) for c in lower)])
    flat, width = np.concatenate(lower), spec.dim // subspaces

    def residuals(batches):
        for b in batches:
            x = _unit(_matrix(pa.Table.from_batches([b])), spec.metric)
            r = x - flat[nearest_lists(x, upper, lower, first, 1, BEAM)[:, 0]]
            for s in range(subspaces):
                yield pa.RecordBatch.from_pydict({"s": pa.array([s], pa.int32()), "r": [np.ascontiguousarray(r[:, s * width : (s + 1) * width]).tobytes()]})

    def words(t: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(t.column("r").to_pylist())).reshape(-1, width)
        c = lloyd(x, WORDS, seed + t.column("s")[0].as_py())
        c = np.concatenate([c, np.repeat(c[:1], WORDS - len(c), 0)])  # fewer rows than codewords
        return pa.table({"s": t.column("s").slice(0, 1), "b": pa.array([c.tobytes()], pa.binary())})

    parts = sample.select(key_col, vec_col).mapInArrow(residuals, "s int, r binary").groupBy("s").applyInArrow(words, "s int, b binary").collect()
    books = np.stack([np.frombuffer(r.b).reshape(WORDS, width) for r in sorted(parts)])
    return upper, lower, books


def build_pq(index: DataFrame, spec: IndexSpec, n_lists: int | None = None, subspaces: int | None = None, seed: int = 42,
             key_col: str = "key", vec_col: str = "vec") -> PQIndex:
    """Train on a bounded sample and code every vector of ``index`` (lazy until saved).

    ``subspaces`` must divide the dimension (default: four dimensions each).
    """
    rows = index.count()
    if not rows:
        raise ValueError("an index without vectors has no lists")
    subspaces = subspaces or max(1, spec.dim // 4)
    if spec.dim % subspaces:
        raise ValueError(f"{subspaces} subspaces do not divide {spec.dim} dimensions")
    n_lists = lists_of(rows, spec.dim) if n_lists is None else n_lists
    src = index.select(key_col, _checked(vec_col, spec.dim).alias(vec_col))
    share = min(1.0, TRAIN_BYTES / (4 * spec.dim * rows))
    some = src.where(F.pmod(F.xxhash64(key_col), F.lit(1 << 20)) < F.lit(max(1, round(share * (1 << 20)))))
    some = some if share < 1.0 and some.limit(1).count() else src
    upper, lower, books = _train(some, spec, n_lists, subspaces, seed, key_col, vec_col)
    first, flat = np.cumsum([0, *(len(c) for c in lower)]), np.concatenate(lower)
    told = index.sparkSession.sparkContext.broadcast((upper, lower, books))  # CENTROID_BYTES bounds it

    def code(batches):
        upper, lower, books = told.value
        for b in batches:
            x = _unit(_matrix(pa.Table.from_batches([b])), spec.metric)
            own = nearest_lists(x, upper, lower, first, 1, BEAM)[:, 0]
            codes = encode(x - flat[own], books)
            tops = np.searchsorted(first, own, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tops.astype(np.int32)), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())],
                                             names=[key_col, vec_col, "top", "list_id", "code"])

    codes = src.mapInArrow(code, f"{key_col} string, {vec_col} array<float>, top int, list_id int, code binary")
    return PQIndex(codes, upper, lower, books, spec)


def save_pq(pq: PQIndex, path: str, files: int = 8) -> None:
    """Codes and vectors partitioned by upper centroid, sorted by list (``files`` tasks write a large part); centroids and codewords."""
    spark = pq.codes.sparkSession
    salt = F.pmod("list_id", F.lit(files))
    dealt = pq.codes.repartition("top", salt).sortWithinPartitions("top", "list_id")
    dealt.write.option("maxRecordsPerFile", MAX_FILE_ROWS).partitionBy("top").parquet(os.path.join(path, "codes"))
    rows = [("upper", 0, pq.upper.tobytes()), ("books", len(pq.books), pq.books.tobytes()), *(("lower", i, c.tobytes()) for i, c in enumerate(pq.lower))]
    spark.createDataFrame(rows, "kind string, n int, data binary").coalesce(1).write.parquet(os.path.join(path, "centroids"))
    spark.createDataFrame([(pq.spec.dim, pq.spec.metric)], "dim int, metric string").coalesce(1).write.parquet(os.path.join(path, "spec"))


def load_pq(spark: SparkSession, path: str) -> PQIndex:
    s = spark.read.parquet(os.path.join(path, "spec")).first()
    rows = spark.read.parquet(os.path.join(path, "centroids")).collect()  # CENTROID_BYTES bounds them
    upper = np.frombuffer(next(r.data for r in rows if r.kind == "upper")).reshape(-1, s.dim)
    m, data = next((r.n, r.data) for r in rows if r.kind == "books")
    lower = [np.frombuffer(r.data).reshape(-1, s.dim) for r in sorted((r for r in rows if r.kind == "lower"), key=lambda r: r.n)]
    return PQIndex(spark.read.parquet(os.path.join(path, "codes")), upper, lower, np.frombuffer(data).reshape(m, WORDS, -1), IndexSpec(dim=s.dim, metric=s.metric))


def probes(pq: PQIndex, queries: DataFrame, nprobe: int, query_id: str = "query_id", qvec: str = "qvec") -> DataFrame:
    """(list_id, query_id, qvec): the lists that each query looks into."""
    spec, kind = pq.spec, queries.schema[query_id].dataType.simpleString()
    upper, lower, first = pq.upper, pq.lower, pq.first
    beam = max(BEAM, -(-2 * nprobe * len(upper) // max(1, pq.lists)))  # twice the parts that so many lists fill

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                part = b.slice(lo, SLICE)
                near = nearest_lists(_unit(_matrix(pa.Table.from_batches([part])), spec.metric), upper, lower, first, nprobe, beam)
                i, j = np.nonzero(near >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(near[i, j].astype(np.int32)), *(c.take(pa.array(i)) for c in part.columns)], names=["list_id", query_id, qvec])

    return queries.select(query_id, _checked(qvec, spec.dim).alias(qvec)).mapInArrow(run, f"list_id int, {query_id} {kind}, {qvec} array<float>")


def pq_search(pq: PQIndex, queries: DataFrame, k: int = 5, nprobe: int = 8, rerank: int = 64, query_id: str = "query_id",
              qvec: str = "qvec", key_col: str = "key", vec_col: str = "vec") -> DataFrame:
    """Approximate top-k: ``query_id, key, distance, rank``; distances are exact.

    ``nprobe`` lists are scanned by their codes for each query, and the
    ``rerank`` best of them are compared by their vectors.
    """
    check_top_k(k)
    spec, books, first = pq.spec, pq.books, pq.first
    rerank, nprobe = max(k, rerank), max(1, min(nprobe, pq.lists))
    kind = queries.schema[query_id].dataType.simpleString()
    told = queries.sparkSession.sparkContext.broadcast(np.concatenate(pq.lower))  # CENTROID_BYTES bounds it

    def group(t: pa.Table) -> pa.Table:
        rows = t.select([query_id, qvec])
        cuts = range(0, rows.num_rows, QUERY_BLOCK)
        return pa.table({"list_id": pa.array([t.column("list_id")[0].as_py()] * len(cuts), pa.int32()), "q": pa.array([_pack(rows.slice(c, QUERY_BLOCK)) for c in cuts], pa.binary())})

    def packed(batches):
        for b in batches:
            lists = b.column(0).to_numpy()
            for one in np.unique(lists).tolist():
                rows = pa.Table.from_batches([b.select([1, 2]).filter(pa.array(lists == one))])
                for lo in range(0, rows.num_rows, INDEX_BLOCK):
                    yield pa.RecordBatch.from_arrays([pa.array([one], pa.int32()), pa.array([_pack(rows.slice(lo, INDEX_BLOCK))], pa.binary())], names=["list_id", "c"])

    def scan(batches):
        flat = told.value
        for b in batches:
            for number, qp, cp in zip(*(c.to_pylist() for c in b.columns)):
                q, c = pa.ipc.open_stream(qp).read_all(), pa.ipc.open_stream(cp).read_all()
                codes = np.frombuffer(b"".join(c.column(1).to_pylist()), np.uint8).reshape(c.num_rows, -1)
                step = max(1, PAIRS // max(1, len(codes)))
                for some in (q.slice(lo, step) for lo in range(0, q.num_rows, step)):
                    d = lookup(_unit(_matrix(some), spec.metric) - flat[number], books, codes)
                    kth = np.partition(d, rerank - 1, axis=1)[:, rerank - 1 : rerank] if d.shape[1] > rerank else np.inf
                    i, j = np.nonzero(d <= kth)
                    yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(i)).combine_chunks(), c.column(0).take(pa.array(j)).combine_chunks(), pa.array(np.full(len(i), number, np.int32)), pa.array(d[i, j])], names=["q", "key", "list_id", "near"])

    asked = probes(pq, queries, nprobe, query_id, qvec)
    parts = max(1, min(64, -(-queries.count() // QUERY_BLOCK)))  # a popular list's queries are dealt over parts
    asked = asked.withColumn("part", F.pmod(F.xxhash64(query_id, qvec), F.lit(parts)).cast("int"))
    asked = materialize(asked.groupBy("list_id", "part").applyInArrow(group, "list_id int, q binary"), "probes")
    used = sorted(r.list_id for r in asked.select("list_id").distinct().collect())  # at most the number of lists
    tops = sorted(set((np.searchsorted(first, used, side="right") - 1).tolist()))
    held = pq.codes.where(F.col("top").isin(tops) & F.col("list_id").isin(used))
    met = held.select("list_id", key_col, "code").mapInArrow(packed, "list_id int, c binary").join(asked, "list_id").select("list_id", "q", "c")
    found = met.mapInArrow(scan, f"q {kind}, key string, list_id int, near double")
    w = Window.partitionBy("q").orderBy("near", "key")
    best = found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= rerank)
    best = materialize(best.select(F.col("q").alias(query_id), F.col("key").alias(key_col), "list_id"), "survivors")
    exact = best.join(held.select("list_id", key_col, vec_col), ["list_id", key_col]).join(queries.select(query_id, qvec).dropDuplicates([query_id]), query_id)
    out = exact.select(query_id, key_col, distance(F.col(qvec), F.col(vec_col), spec.metric).alias("distance"))
    w = Window.partitionBy(query_id).orderBy(F.col("distance").asc(), F.col(key_col).asc())
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def share_read(pq: PQIndex, queries: DataFrame, nprobe: int, query_id: str = "query_id", qvec: str = "qvec") -> DataFrame:
    """One row: the mean share of all vectors whose codes a query scans."""
    sizes = pq.codes.groupBy("list_id").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    read = probes(pq, queries, nprobe, query_id, qvec).join(sizes, "list_id").groupBy(query_id).agg(F.sum("n").alias("n"))
    return read.agg(F.avg("n").alias("n"), F.count("*").alias("queries")).join(F.broadcast(total), F.lit(True)).select((F.col("n") / F.col("total")).alias("share"), "queries")
