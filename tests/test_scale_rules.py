"""Rules of the engine that a text search can hold: no driver-side vectors, no local checkpoints, no cross joins."""

import glob
import os
import re

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
FILES = [f for f in glob.glob(f"{ROOT}/tessera/**/*.py", recursive=True)]


def sources(pattern):
    return [(os.path.relpath(f, ROOT), n) for f in FILES for n, line in enumerate(open(f), 1) if re.search(pattern, line)]


def test_no_local_checkpoint_and_no_cross_join():
    assert not sources(r"localCheckpoint|\.crossJoin\(|\.rdd\b|mapPartitions\(")


def test_knn_collects_nothing():
    assert not [x for x in sources(r"\.collect\(\)|toPandas|toLocalIterator") if x[0].endswith("operators/knn.py")]


def test_nothing_else_imports_the_optional_subpackage():
    inside = os.path.join("tessera", "llm") + os.sep
    assert not [x for x in sources(r"tessera\.llm|import llm") if not x[0].startswith(inside)]


def test_python_workers_get_batches_of_few_bytes(spark):
    import pyarrow as pa

    import __spark_entry__ as entry

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        entry.queries()["token_count"](spark, "/root/testdata/sf0.001")
        long = spark.range(0, 48, 1, 1).selectExpr("repeat('x', 1048576) as t")
        sizes = long.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())}) for b in bs), "n long").collect()
        assert sum(r.n for r in sizes) == 48 and max(r.n for r in sizes) <= 8
        spark.conf.set(key, "32m")  # the deployment's own value stays
        entry.queries()["token_count"](spark, "/root/testdata/sf0.001")
        assert spark.conf.get(key) == "32m"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
