"""Exact k-nearest-neighbour search of a batch of queries over a vector table.

One side stays where it is read, the other comes to it: its rows are packed
into blocks, written, and broadcast in *waves* of a measured size. Plan of a
wave:

    scan of the staying side (filters pushed to Parquet, only id and vector read)
      -> blocks, packed where they are read
      -> broadcast join with the wave's blocks on the block's number
      -> numpy block product; a task holds the k best that each query has met
         until it ends, so k hits of a query leave it at most
      -> row_number() over (query_id order by distance, key) <= k,
         limited per task before its exchange

and then a join of the survivors with the payload columns of the index. The
smaller side is broadcast: queries over a large index, so that the index is
never shuffled whatever their number; the index where there are more queries
than vectors, so that a query's hits don't multiply with the index's tasks.
With ``bound_from`` tasks begin with a distance that k vectors are known to
keep.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.filters import compile_filter
from tessera.schema import TOP_K_MAX, TOP_K_MIN, IndexSpec
from tessera.session import materialize

QUERY_BLOCK, INDEX_BLOCK, SLICE = 4096, 4096, 512
"""Rows of a block of queries, of a block of vectors, and of the queries that are multiplied at a time."""
WAVE_BYTES = 64 << 20
"""Bytes of packed rows that are broadcast at a time."""
HELD_BYTES = 256 << 20
"""Bytes of unpacked queries and hits that a task holds."""


def check_top_k(k: int) -> int:
    if not isinstance(k, int) or not (TOP_K_MIN <= k <= TOP_K_MAX):
        raise ValueError(f"top-k must be an integer in [{TOP_K_MIN}, {TOP_K_MAX}], got {k!r}")
    return k


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _matrix(t: pa.Table) -> np.ndarray:
    """The vectors in a table's second column."""
    flat = t.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(t.num_rows, -1)


def _checked(vec: str, dim: int):
    """The vector; a row of another dimension fails the job."""
    bad = F.raise_error(F.format_string(f"vector dimension must be {dim}, got %s", F.size(vec))).cast("array<float>")
    return F.when(F.size(vec) == dim, F.col(vec)).otherwise(bad)


def _scaled(x: np.ndarray, metric: str) -> np.ndarray:
    """Rows of length one for cosine (zero stays zero), else the rows."""
    if metric != "cosine":
        return x
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _distances(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Cosine distance of scaled rows (1 where one is zero), or squared Euclidean distance, of all pairs."""
    d = q @ v.T
    if metric == "cosine":
        np.subtract(1.0, d, out=d)
        return np.maximum(d, 0.0, out=d)
    d *= -2.0
    d += (q * q).sum(1)[:, None]
    d += (v * v).sum(1)[None, :]
    return d


class _Asked:
    """A block of queries in a task: its vectors, and the k best that each query has met so far."""

    def __init__(self, payload, k: int, metric: str, probe=None):
        t = pa.ipc.open_stream(payload).read_all()
        self.ids, self.q, self.k, self.metric = t.column(0), _scaled(_matrix(t), metric), k, metric
        self.far = t.column(2).to_numpy().copy() if t.num_columns > 2 else np.full(t.num_rows, np.inf)
        self.found: list[pa.Table] = []
        self.rows = 0
        if probe is not None:  # which queries look into a list, by list
            lists = np.concatenate([probe(self.q[lo : lo + SLICE]) for lo in range(0, len(self.q), SLICE)]).astype(np.int32)
            self.askers = np.argsort(lists, axis=None, kind="stable")
            self.lists = lists.ravel()[self.askers]
            self.askers = (self.askers // lists.shape[1]).astype(np.int32)

    @property
    def nbytes(self) -> int:
        return self.q.nbytes + 48 * self.rows

    def meet(self, keys: pa.Array, v: np.ndarray, lists: np.ndarray | None = None) -> None:
        """Hold the queries against a block of scaled vectors whose keys ascend; where ``lists`` (ascending) tells
        the vectors' lists, only those that look into them, and keys ascend in a list."""
        if lists is None:
            self._all(np.arange(len(self.q)), keys, v)
            return
        for one in np.unique(lists):
            a, b = np.searchsorted(lists, [one, one + 1])
            lo, hi = np.searchsorted(self.lists, [one, one + 1])
            self._all(self.askers[lo:hi], keys.slice(a, b - a), v[a:b])

    def _all(self, own: np.ndarray, keys: pa.Array, v: np.ndarray) -> None:
        for lo in range(0, len(own), SLICE):
            self._meet(own[lo : lo + SLICE], keys, v)
        if self.rows > 2 * self.k * len(self.q):
            self.cut()

    def _meet(self, own: np.ndarray, keys: pa.Array, v: np.ndarray) -> None:
        k, q, cosine = self.k, self.q[own], self.metric == "cosine"
        d = _distances(q, v, self.metric)
        # by expansion the squared distance is only good enough to choose by: a little more is taken
        far = self.far[own] if cosine else self.far[own] ** 2
        slack = 1e-12 if cosine else 1e-9 * (np.abs(d).max(initial=0.0) + (q * q).sum(1).max(initial=0.0) + 1e-300)
        kth = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(q), np.inf)
        near = d <= np.minimum(kth, far)[:, None] + slack
        ends = np.cumsum(near.sum(1))
        lo = 0
        while lo < len(q):  # many equal distances are cut to k a query, some queries at a time
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 18), side="right")))
            i, j = np.nonzero(near[lo:hi])
            dist = d[lo:hi][i, j] if cosine else np.sqrt(((q[lo:hi][i] - v[j]) ** 2).sum(1))
            o = np.lexsort((j, dist, i))
            o = o[np.arange(len(o)) - np.searchsorted(i[o], i[o]) < k]
            if len(o):
                self.found.append(pa.table({"i": own[i[o] + lo].astype(np.int64), "distance": dist[o], "key": keys.take(pa.array(j[o]))}))
                self.rows += len(o)
            lo = hi
        self.far[own] = np.minimum(self.far[own], kth if cosine else np.sqrt(np.maximum(kth, 0.0) + slack))

    def cut(self) -> pa.Table | None:
        """Only the k best of each query are kept."""
        if not self.found:
            return None
        t = pa.concat_tables(self.found).sort_by([("i", "ascending"), ("distance", "ascending"), ("key", "ascending")])
        i = t.column("i").to_numpy()
        t = t.filter(pa.array(np.arange(len(i)) - np.searchsorted(i, i) < self.k))
        self.found, self.rows = [t], t.num_rows
        return t

    def batch(self) -> pa.RecordBatch | None:
        t = self.cut()
        if t is None:
            return None
        one = [c.combine_chunks() for c in (self.ids.take(t.column("i")), t.column("key"), t.column("distance"))]
        return pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in one], names=["q", "key", "distance"])


def _pairs(k: int, metric: str, one: bool = False, probe=None):
    """The k best that a task finds for each query.

    Rows: number of the query block and its part, queries, vectors. Of what a
    query has met only its k best are held, and told when the task ends; where
    all rows of a query block follow each other (``one``), as soon as the next begins.
    ``probe`` (scaled queries -> lists) tells the lists that each query looks
    into; the blocks of vectors then have their lists as a third column.
    """

    def run(batches):
        asked: dict[tuple[int, int], _Asked] = {}
        payload, keys, v, lists = None, None, None, None
        for batch in batches:
            blocks, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for r, at in enumerate(zip(blocks, parts)):
                if at not in asked:
                    while asked and (one or sum(x.nbytes for x in asked.values()) > HELD_BYTES):  # the oldest goes first
                        out = asked.pop(next(iter(asked))).batch()
                        if out is not None:
                            yield out
                    asked[at] = _Asked(batch.column(2)[r].as_buffer(), k, metric, probe)
                vp = batch.column(3)[r].as_buffer()
                if payload is None or not payload.equals(vp):
                    payload = vp
                    t = pa.ipc.open_stream(vp).read_all()
                    names = t.column_names
                    t = t.take(pa.compute.sort_indices(t, [(names[i], "ascending") for i in ([0] if probe is None else [2, 0])]))
                    keys, v = t.column(0).combine_chunks(), _scaled(_matrix(t), metric)
                    lists = None if probe is None else t.column(2).to_numpy()
                asked[at].meet(keys, v, lists)
        for held in asked.values():
            out = held.batch()
            if out is not None:
                yield out

    return run


def _packed(size: int):
    """Batches as blocks of at most so many rows, each with a number of its own."""

    def run(batches):
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << 20
        for b in batches:
            for lo in range(0, b.num_rows, size):
                yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "p": [_pack(pa.Table.from_batches([b.slice(lo, size)]))]})
                n += 1

    return run


def _blocks(rows: DataFrame, n: int, size: int, largest: int | None = None) -> tuple[DataFrame, int]:
    """(b, c, p): rows (id, vector, any bound) dealt by a hash and packed, written; and how many numbers b has.

    With ``largest`` (rows of the largest list) the third column is the row's
    list: a list's rows lie together, in as few blocks as hold them.
    """
    cols = rows.columns

    def group(t: pa.Table) -> pa.Table:
        own = t.select(cols) if largest is None else t.select(cols).sort_by(cols[2])
        cuts = range(0, own.num_rows, size)
        return pa.table({"b": pa.array([t.column("_b")[0].as_py()] * len(cuts), pa.int32()), "c": pa.array(range(len(cuts)), pa.int32()), "p": pa.array([_pack(own.slice(a, size)) for a in cuts], pa.binary())})

    n_blocks = max(1, -(-n // size))
    place = F.xxhash64(*cols[:2])
    if largest is not None:
        place = F.pmod(F.xxhash64(cols[2]), F.lit(n_blocks)) + F.pmod(place, F.lit(max(1, -(-largest // size))))
    dealt = rows.withColumn("_b", F.pmod(place, F.lit(n_blocks)).cast("int"))
    return materialize(dealt.groupBy("_b").applyInArrow(group, "b int, c int, p binary"), "blocks"), n_blocks


def _waves(blocks: DataFrame, n_blocks: int, wave_bytes: int) -> list[tuple[int, int]]:
    """Ranges of block numbers (first, behind the last) of at most ``wave_bytes`` each; a larger block stands alone."""
    if n_blocks == 1:
        return [(0, 1)]
    most = blocks.groupBy("b").agg(F.sum(F.octet_length("p")).alias("n")).agg(F.max("n")).first()[0] or 1
    per = max(1, wave_bytes // most)
    return [(lo, min(n_blocks, lo + per)) for lo in range(0, n_blocks, per)]


def best_hits(rows: DataFrame, q: DataFrame, spec: IndexSpec, k: int, to_index: bool, n_queries: int, n_vectors: int | None, query_block: int = QUERY_BLOCK,
              wave_bytes: int = WAVE_BYTES, parallelism: int | None = None, probe=None, largest: int | None = None) -> DataFrame:
    """``query_id, key, distance, rank`` of the k best, from waves of one side broadcast to the other.

    ``rows`` (key, vector) and ``q`` (id, vector, any bound); queries come to
    the vectors with ``to_index``, else vectors to the queries. With ``probe``
    rows have their list as a third column, and a query only meets vectors of the lists it looks into.
    """
    (key_col, query_id), kind = (rows.columns[0], q.columns[0]), q.dtypes[0][1]
    found = f"q {kind}, key string, distance double"

    def hits(own: DataFrame, coming: DataFrame, lo: int, hi: int) -> DataFrame:
        """The k best of each query, of what stays with the blocks lo .. hi - 1 of what comes."""
        own = own.select("n", F.col("p").alias("own"), F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))).alias("b"))
        met = own.join(F.broadcast(coming.where(F.col("b").between(lo, hi - 1))), "b")
        met = met.select(F.col("b").cast("long").alias("b"), "c", F.col("p").alias("q"), F.col("own").alias("v")) if to_index else met.select(F.col("n").alias("b"), F.lit(0).alias("c"), F.col("own").alias("q"), F.col("p").alias("v"))
        near = met.mapInArrow(_pairs(k, spec.metric, one=not to_index, probe=probe), found).select(F.col("q").alias(query_id), F.col("key").alias(key_col), "distance")
        w = Window.partitionBy(query_id).orderBy(F.col("distance").asc(), F.col(key_col).asc())
        return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    coming, n_blocks = _blocks(q, n_queries, query_block) if to_index else _blocks(rows, n_vectors, INDEX_BLOCK, largest)
    staying, cuts = rows if to_index else q, _waves(coming, n_blocks, wave_bytes)
    own = staying.mapInArrow(_packed(INDEX_BLOCK if to_index else query_block), "n long, p binary")
    if parallelism:
        own = own.repartition(parallelism)
    if len(cuts) == 1:
        return hits(own, coming, *cuts[0])
    if parallelism:  # dealt once for all waves
        own = materialize(own, "staying")
    parts = reduce(DataFrame.unionByName, [materialize(hits(own, coming, lo, hi), "hits") for lo, hi in cuts])
    if to_index:  # a query is in one wave
        return parts
    w = Window.partitionBy(query_id).orderBy(F.col("distance").asc(), F.col(key_col).asc())
    return parts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_topk(
    index: DataFrame,
    queries: DataFrame,
    spec: IndexSpec,
    k: int = 5,
    flt=None,
    payload=(),
    query_id: str = "query_id",
    qvec: str = "qvec",
    key_col: str = "key",
    vec_col: str = "vec",
    query_block: int = QUERY_BLOCK,
    wave_bytes: int = WAVE_BYTES,
    parallelism: int | None = None,
    bound_from: int | None = None,
    broadcast: str | None = None,
) -> DataFrame:
    """k nearest vectors of ``index`` for each row of ``queries``.

    Returns ``query_id, key, distance, rank`` plus ``payload`` columns of the
    index, ``rank`` 1-based by (distance, key). Keys of the index are unique.
    A vector of another dimension, on either side, fails the job.

    ``broadcast`` names the side that comes to the other (``queries`` or
    ``index``; None: queries where they fill no more than a block, else the
    side of fewer rows, which are counted). ``parallelism``
    deals the staying side's blocks over so many tasks, for tables of fewer
    splits than cores; None leaves them where they are read. ``bound_from``
    searches one vector of so many first (by a hash of the key), so that the
    search proper only sends hits nearer than the kth of these. None of them
    changes the result.
    """
    check_top_k(k)
    if broadcast not in (None, "queries", "index"):
        raise ValueError("broadcast must be queries, index or None")
    payload = [p for p in payload if p not in (key_col, vec_col)]
    idx = index if flt is None else index.where(compile_filter(flt, index.schema, spec.non_filterable))
    vectors = idx.select(key_col, _checked(vec_col, spec.dim).alias(vec_col))
    n_queries = queries.count()
    # one block of queries goes to any index: no need to count that
    to_index = broadcast == "queries" or (broadcast is None and n_queries <= query_block)
    n_vectors = None if to_index else idx.count()
    to_index = to_index or (broadcast is None and n_queries < n_vectors)

    def waves(rows: DataFrame, q: DataFrame) -> DataFrame:
        return best_hits(rows, q, spec, k, to_index, n_queries, n_vectors, query_block, wave_bytes, parallelism)

    q = queries.select(query_id, _checked(qvec, spec.dim).alias(qvec))
    if bound_from:
        some = waves(vectors.where(F.pmod(F.xxhash64(key_col), F.lit(bound_from)) == 0), q)
        kth = materialize(some.where(F.col("rank") == k).groupBy(query_id).agg(F.max("distance").alias("far")), "bounds")
        q = q.join(kth, query_id, "left").withColumn("far", F.coalesce("far", F.lit(float("inf"))))
    best = waves(vectors, q)
    if payload:
        best = best.join(index.select(key_col, *payload), key_col)
    return best.select(query_id, key_col, "distance", *payload, "rank")
