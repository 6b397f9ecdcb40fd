"""Approximate nearest neighbours at scale (K3): an inverted-file (IVF) index.

Build: distributed k-means (``pyspark.ml.clustering.KMeans``) over the
(L2-normalised, for cosine) vectors; every vector gets its list id (narrow).
``save_ivf`` stores the vectors partitioned by ``list_id`` plus the small
centroid table; ``load_ivf`` reads them back.

Search: every query finds its ``nprobe`` nearest centroids in the task that
holds it, so no query is repeated for its lists. The smaller side, queries or
vectors, is broadcast to the other in waves of a measured size, as in exact
kNN, and a query is only held against vectors of the lists it probes. Only
probed lists are read (a partition filter on ``list_id``). A final window
keeps the k best per query (``WindowGroupLimit``).
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vector import l2_normalize
from tessera.operators.index import MAX_FILE_ROWS
from tessera.operators.knn import QUERY_BLOCK, SLICE, WAVE_BYTES, _checked, _matrix, _scaled, best_hits, check_top_k
from tessera.schema import IndexSpec

MAX_LISTS = 65536
"""Lists at most: the centroids travel with the tasks."""


class IVFIndex:
    def __init__(self, assigned: DataFrame, centroids: np.ndarray, spec: IndexSpec, rows: int | None = None):
        self.assigned, self.rows = assigned, rows  # key, vec, list_id; how many, where they were counted
        self.centroids = centroids  # (n_lists, dim), unit rows for cosine
        self.spec = spec


def lists_for(rows: int) -> int:
    """Lists for so many vectors: the square root, within bounds."""
    return max(1, min(MAX_LISTS, round(rows ** 0.5)))


def build_ivf(index: DataFrame, spec: IndexSpec, n_lists: int | None = None, seed: int = 42, max_iter: int = 10,
              key_col: str = "key", vec_col: str = "vec") -> IVFIndex:
    """Train the coarse quantiser on every vector and assign each vector to its list."""
    rows = index.count() if n_lists is None else None
    n_lists = lists_for(rows) if n_lists is None else n_lists
    if not (1 <= n_lists <= MAX_LISTS):
        raise ValueError(f"n_lists must be in [1, {MAX_LISTS}]")
    v = index.select(key_col, _checked(vec_col, spec.dim).alias(vec_col))
    unit = l2_normalize(vec_col) if spec.metric == "cosine" else F.col(vec_col)
    feats = v.withColumn("features", array_to_vector(unit))
    model = KMeans(k=n_lists, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="list_id").fit(feats)
    centroids = np.array([c for c in model.clusterCenters()], dtype=np.float64)
    assigned = model.transform(feats).select(key_col, vec_col, F.col("list_id").cast("int"))
    return IVFIndex(assigned, centroids, spec, rows)


def save_ivf(ivf: IVFIndex, path: str) -> None:
    """Vectors partitioned by ``list_id`` (several files per large list) + centroids."""
    spark = ivf.assigned.sparkSession
    files = 8 if ivf.rows is None else max(1, min(64, 8 * ivf.rows // (len(ivf.centroids) * MAX_FILE_ROWS)))
    salt = F.pmod(F.xxhash64("key"), F.lit(files))  # a large list is written by several tasks
    ivf.assigned.repartition("list_id", salt).write.option("maxRecordsPerFile", MAX_FILE_ROWS).partitionBy("list_id").parquet(
        os.path.join(path, "vectors"))
    rows = [(int(i), [float(x) for x in c]) for i, c in enumerate(ivf.centroids)]
    spark.createDataFrame(rows, "list_id int, centroid array<double>").coalesce(1).write.parquet(
        os.path.join(path, "centroids"))
    spark.createDataFrame([(ivf.spec.dim, ivf.spec.metric)], "dim int, metric string").coalesce(1).write.parquet(
        os.path.join(path, "spec"))


def load_ivf(spark: SparkSession, path: str) -> IVFIndex:
    spec_row = spark.read.parquet(os.path.join(path, "spec")).first()
    rows = sorted(spark.read.parquet(os.path.join(path, "centroids")).collect())  # n_lists rows (bounded)
    centroids = np.array([r.centroid for r in rows], dtype=np.float64)
    assigned = spark.read.parquet(os.path.join(path, "vectors"))
    return IVFIndex(assigned, centroids, IndexSpec(dim=spec_row.dim, metric=spec_row.metric))


def ivf_search(ivf: IVFIndex, queries: DataFrame, k: int = 5, nprobe: int = 4, query_id: str = "query_id",
               qvec: str = "qvec", key_col: str = "key", vec_col: str = "vec", query_block: int = QUERY_BLOCK,
               wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """Approximate top-k: ``query_id, key, distance, rank`` (distances as in exact kNN).

    Queries go to the vectors where they fill no more than a block or are
    fewer; else vectors, packed by list, go to the queries.
    """
    check_top_k(k)
    spec, spark = ivf.spec, queries.sparkSession
    nprobe = max(1, min(nprobe, len(ivf.centroids)))
    some = nprobe < len(ivf.centroids)
    told = spark.sparkContext.broadcast(ivf.centroids) if some else None

    def probe(x: np.ndarray) -> np.ndarray:
        # the rule of the k-means assignment: distance of the unit vector, for cosine indexes
        d = (told.value * told.value).sum(1)[None, :] - 2.0 * (x @ told.value.T)
        return np.argsort(d, axis=1, kind="stable")[:, :nprobe]

    def lists(batches):
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                x = _scaled(_matrix(pa.Table.from_batches([b.slice(lo, SLICE)])), spec.metric)
                yield pa.RecordBatch.from_pydict({"list_id": pa.array(np.unique(probe(x)).astype(np.int32))})

    asked = queries.select(query_id, _checked(qvec, spec.dim).alias(qvec))
    vectors = ivf.assigned
    if some:
        used = sorted(r.list_id for r in asked.mapInArrow(lists, "list_id int").distinct().collect())  # at most the number of lists
        vectors = vectors.where(F.col("list_id").isin(used))
    n_queries, n_vectors, largest = queries.count(), None, None
    to_index = n_queries <= query_block
    if not to_index:
        held = vectors.groupBy("list_id").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
        n_vectors, largest = held.n or 0, held.most or 0
        to_index = n_queries < n_vectors
    vectors = vectors.select(key_col, _checked(vec_col, spec.dim).alias(vec_col), "list_id")
    dealt = None if to_index else spark.sparkContext.defaultParallelism  # blocks of queries are few: they are dealt over all cores
    return best_hits(vectors, asked, spec, k, to_index, n_queries, n_vectors, query_block, wave_bytes, dealt, probe if some else None, largest).select(query_id, key_col, "distance", "rank")


def recall_at_k(approx: DataFrame, exact: DataFrame, query_id: str = "query_id", key_col: str = "key") -> DataFrame:
    """Fraction of exact top-k neighbours found by the approximate search (one row)."""
    found = approx.select(query_id, key_col).withColumn("_hit", F.lit(1))
    j = exact.select(query_id, key_col).join(found, [query_id, key_col], "left")
    return j.agg((F.count("_hit") / F.count("*")).alias("recall"), F.count("_hit").alias("hits"),
                 F.count("*").alias("total"))
