"""Gapless numbers within keys, without one task per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def number_within(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Add ``name``: 0, 1, ... within each ``key``.

    The number of keys must be bounded (a shard, a length); their rows need not
    be: a key is dealt over as many parts as its share of the rows deserves,
    parts are numbered on their own and shifted by the sizes of those before.
    Counts of keys and parts (a few per shuffle partition) come to the driver.
    ``order`` must tell rows apart, or rows it doesn't must be the same. ``df``
    is read more than once; write it first if it is dear.
    """
    spark = df.sparkSession
    counts = df.groupBy(key).count().collect()
    rows = sum(r["count"] for r in counts)
    if not rows:
        return df.withColumn(name, F.lit(0).cast("long"))
    share = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(df.dtypes)[key]
    parts = spark.createDataFrame([(r[key], -(-r["count"] * share // rows)) for r in counts], f"{key} {kind}, _parts int")
    dealt = df.join(F.broadcast(parts), key).withColumn("_part", F.pmod(F.xxhash64(*order), F.col("_parts")).cast("int")).drop("_parts")
    sizes = sorted(tuple(r) for r in dealt.groupBy(key, "_part").count().collect())
    base, at, last = [], 0, None
    for k, p, n in sizes:
        at = 0 if k != last else at
        base.append((k, p, at))
        at, last = at + n, k
    before = spark.createDataFrame(base, f"{key} {kind}, _part int, _before long")
    w = Window.partitionBy(key, "_part").orderBy(*order)
    out = dealt.withColumn("_own", F.row_number().over(w)).join(F.broadcast(before), [key, "_part"])
    return out.withColumn(name, (F.col("_before") + F.col("_own") - F.lit(1)).cast("long")).drop("_part", "_own", "_before")
