"""Key-ordered listings (S7, S8): pages and segments that open only their files.

A listing is a copy of an index's light columns, range-partitioned and sorted
by key, one partition directory a range; a table of ranges says which keys a
part holds and how many rows stand before it. A page is found through the
ranges and read from the one or two parts that hold it; a segment is a run of
whole parts, so segments together read the listing once.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART_ROWS = 100_000
"""Rows of a part, about."""


class Listing:
    def __init__(self, rows: DataFrame, ranges: DataFrame, key_col: str):
        self.rows, self.ranges, self.key_col = rows, ranges, key_col


def save_listing(index: DataFrame, path: str, key_col: str = "key", part_rows: int = PART_ROWS) -> None:
    """Write the listing of ``index`` (select what it shall hold first)."""
    spark = index.sparkSession
    rows, ranges = os.path.join(path, "rows"), os.path.join(path, "ranges")
    parts = max(1, -(-index.count() // part_rows))
    dealt = index.repartitionByRange(parts, key_col).sortWithinPartitions(key_col).withColumn("part", F.spark_partition_id())
    dealt.write.partitionBy("part").parquet(rows)
    held = spark.read.schema(dealt.schema).parquet(rows).groupBy("part").agg(F.min(key_col).alias("lo"), F.max(key_col).alias("hi"), F.count("*").alias("rows"))
    # one row a part meets here, none of the listing
    held.withColumn("before", F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).na.fill({"before": 0}).coalesce(1).write.parquet(ranges)
    spark.createDataFrame([(key_col, dealt.schema.json())], "key string, schema string").coalesce(1).write.parquet(os.path.join(path, "about"))


def open_listing(spark: SparkSession, path: str) -> Listing:
    about = spark.read.parquet(os.path.join(path, "about")).first()
    schema = T.StructType.fromJson(json.loads(about.schema))
    return Listing(spark.read.schema(schema).parquet(os.path.join(path, "rows")), spark.read.parquet(os.path.join(path, "ranges")), about.key)


def list_page(listing: Listing, max_results: int, next_token: str | None = None) -> tuple[DataFrame, str | None]:
    """The first ``max_results`` rows after the token, by key, and the next token (None after the last row).

    Only parts that hold the page are opened.
    """
    if max_results < 1:
        raise ValueError("max_results must be at least 1")
    key = F.col(listing.key_col)
    later = listing.ranges if next_token is None else listing.ranges.where(F.col("hi") > F.lit(next_token))
    first = later.orderBy("part").first()
    if first is None:
        return listing.rows.where("false").drop("part"), None
    end = first.before + first.rows + max_results  # rows of the page stand before this place
    parts = [r.part for r in listing.ranges.where((F.col("part") >= first.part) & (F.col("before") < end)).select("part").collect()]
    rows = listing.rows.where(F.col("part").isin(parts))
    rows = rows if next_token is None else rows.where(key > F.lit(next_token))
    page = rows.drop("part").orderBy(key).limit(max_results)
    n, last = page.agg(F.count("*"), F.max(key)).first()
    more = n == max_results and listing.ranges.where(F.col("hi") > F.lit(last)).limit(1).count()
    return page, last if more else None


def list_segment(listing: Listing, n: int, i: int) -> DataFrame:
    """Segment ``i`` of ``n``: a run of whole parts, disjoint from the other segments."""
    if n is None or i is None:
        raise ValueError("segment count and segment index must both be given")
    if not (0 <= i < n):
        raise ValueError("segment index must be in [0, segment count)")
    parts = listing.ranges.agg(F.max("part")).first()[0]
    parts = 0 if parts is None else parts + 1
    return listing.rows.where((F.col("part") >= i * parts // n) & (F.col("part") < (i + 1) * parts // n)).drop("part")


def all_pages(listing: Listing, max_results: int) -> DataFrame:
    """Every row with the number of its page, from 0: what paging to the end gives, as one table."""
    own = F.row_number().over(Window.partitionBy("part").orderBy(listing.key_col))
    before = listing.ranges.select("part", "before")
    rows = listing.rows.withColumn("_own", own).join(before, "part")
    return rows.withColumn("page", F.floor((F.col("before") + F.col("_own") - 1) / F.lit(max_results)).cast("long")).drop("_own", "before", "part")
