"""Session construction and cluster-facing settings."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every session of ours wants. On a cluster the deployment
# (spark-submit / cluster config) usually already sets most of these; we only
# apply them to sessions we build ourselves.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Arrow batches into pandas UDFs: keep them moderate, documents can be large.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(
    app: str = "tessera",
    cpus: int | str | None = None,
    shuffle_partitions: int | None = None,
    driver_memory: str = "16g",
    extra: dict | None = None,
) -> SparkSession:
    """Build (or reuse) a local session with the engine's defaults.

    On a real cluster, create the session with the cluster's launcher and
    pass it to the operators instead; nothing here is required by them.
    """
    master = f"local[{cpus or '*'}]"
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(_DEFAULTS)
    conf["spark.driver.memory"] = driver_memory
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or (int(cpus) if str(cpus or "").isdigit() else 8))
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


_OWN_DIR: str | None = None


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names that folder (a shared file system path). Only where it is
    unset and all tasks run in this process -- local runs and tests -- do we
    make one of our own; elsewhere that would be a folder no executor sees.
    """
    global _OWN_DIR
    d = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN_DIR = _OWN_DIR or tempfile.mkdtemp(prefix="tessera-ckpt-")
        d = _OWN_DIR
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for materialised tables."""
    base = checkpoint_dir(spark)
    import uuid

    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def materialize(df, name: str = "stage"):
    """Cut lineage by writing ``df`` as Parquet under the shared checkpoint
    folder and reading it back (one computation; survives executor loss)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


KEY_BYTES = 64 << 20
"""Bytes of keys that are broadcast at a time."""
KEY_WAVES = 4
"""Times that a table is read for its rows at most; beyond, Spark joins as it sees fit."""


def rows_of(rows, keys, cols: list[str], anti: bool = False):
    """The rows that ``keys`` (a written table) names by ``cols``, or with ``anti`` the others; nulls are equal to nulls.

    The keys are measured and broadcast in waves of ``KEY_BYTES``, so the rows
    are not shuffled; a row meets the wave of its own hash only.
    """
    from functools import reduce

    from pyspark.sql import functions as F

    size = keys.select(F.sum(sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in cols), F.lit(64)))).first()[0] or 0
    waves = max(1, -(-size // KEY_BYTES))
    how = "left_anti" if anti else "left_semi"
    on = reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}")) for c in cols])
    if waves > KEY_WAVES:
        return rows.alias("r").join(keys.select(*cols).alias("k"), on, how).select("r.*")
    part = F.pmod(F.xxhash64(*cols), F.lit(waves))
    found = [rows.where(part == w).alias("r").join(F.broadcast(keys.select(*cols).where(part == w)).alias("k"), on, how).select("r.*") for w in range(waves)]
    return reduce(lambda a, b: a.unionByName(b), found)


def parallelism(spark: SparkSession) -> int | None:
    """Tasks that CPU-heavy narrow operators deal their rows over: the session's
    ``spark.tessera.parallelism``; None (rows stay in the tasks that read them)
    where it is unset. Set it where tables have fewer splits than there are cores."""
    n = spark.conf.get("spark.tessera.parallelism", None)
    return int(n) if n else None


def spread(df, n: int | None):
    """``df`` dealt over ``n`` tasks; as it is for None."""
    return df.repartition(n) if n else df


BATCH_BYTES = "4m"
"""Bytes of rows that a Python worker is handed at a time: its memory does not grow with the table or the rows' length."""


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of a session whose deployment does not."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


_SHIPPED: dict = {}


def ship_package(spark: SparkSession) -> None:
    """Make ``tessera`` importable in the Python workers of this session.

    The functions that run inside tasks (Arrow / pandas UDF bodies) are
    pickled by reference to this package, so the executors need it. Unless
    it is installed on the cluster's nodes, it is zipped in memory once per
    driver process, written to the shared folder named by
    ``spark.checkpoint.dir`` (Hadoop FileSystem API), and distributed with
    ``SparkContext.addPyFile``.
    """
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    import io
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg_dir):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    target = os.path.join(scratch_path(spark, "pkg"), "tessera.zip")
    jvm = sc._jvm
    p = jvm.org.apache.hadoop.fs.Path(target)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(p, False)
    try:
        out.write(bytearray(buf.getvalue()))
    finally:
        out.close()
    sc.addPyFile(p.toString())
    _SHIPPED[key] = target
