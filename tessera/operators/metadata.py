"""Chunk metadata: caps, the content byte budget, and the 2048-byte guarantee.

Everything is a column expression, on the ingest path too: the rule "cut to
three quarters until it fits" is a search among the lengths that it can leave.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.schema import (
    CAP_AUTHOR,
    CAP_CONTEXT_PREFIX,
    CAP_HEADING_PATH,
    CAP_SOURCE,
    CAP_TAGS,
    FILTERABLE_METADATA_MAX_BYTES,
    METADATA_CONTENT_BUDGET,
    METADATA_CONTENT_MIN_BUDGET,
)

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
FIXED_KEYS = ("doc_id", "chunk_index", "total_chunks", "content_hash", "file_type", "ingested_at")
OPTIONAL_CAPS = (("source", CAP_SOURCE), ("tags", CAP_TAGS), ("author", CAP_AUTHOR),
                 ("heading_path", CAP_HEADING_PATH), ("context_prefix", CAP_CONTEXT_PREFIX))


def cut_to_bytes(text: Column, budget: Column, measure=F.octet_length) -> Column:
    """Keep the first 3/4 of the characters until ``measure(text) <= budget``.

    The lengths that this rule can leave are known beforehand (down to none);
    of those that can fit (a character has a byte at least) the first whose
    prefix does is taken, and no later one is measured.
    """
    steps = F.ceil(F.log(F.length(text) + F.lit(1)) / F.lit(math.log(4 / 3))).cast("int") + F.lit(1)
    lengths = F.aggregate(F.sequence(F.lit(1), steps), F.array(F.length(text)), lambda a, _: F.concat(a, F.array(F.floor(F.element_at(a, -1) * 3 / 4).cast("int"))))
    some = F.filter(lengths, lambda n: n <= budget)
    fits = F.aggregate(some, F.lit(0), lambda found, n: F.when(found > 0, found).when(measure(F.substring(text, F.lit(1), n)) <= budget, n).otherwise(found))
    return F.when(text.isNull() | (measure(text) <= budget), text).otherwise(F.substring(text, F.lit(1), fits))


def escaped_json_len(t: Column) -> Column:
    """Bytes of a string inside JSON, quotes excluded (escapes counted)."""
    return F.octet_length(F.to_json(F.array(t))) - F.lit(4)  # '["' + ... + '"]'


def _json_bytes(st: Column, n_fields: Column) -> Column:
    """Bytes of ``json.dumps(..., ensure_ascii=False)``: Spark's JSON has no
    spaces, Python's adds one after every ':' and every ','."""
    return F.octet_length(F.to_json(st)) + F.lit(2) * n_fields - F.lit(1)


def metadata_struct(df: DataFrame, caps_in_bytes: bool = False) -> list[Column]:
    """Columns of the metadata record (all strings, absent = null), in key order."""
    cols = [
        F.col("doc_id").cast("string").alias("doc_id"),
        F.col("chunk_index").cast("string").alias("chunk_index"),
        F.col("total_chunks").cast("string").alias("total_chunks"),
        F.col("content_hash").alias("content_hash"),
        F.col("file_type").alias("file_type"),
        (F.date_format("ingested_at", ISO_FORMAT) if dict(df.dtypes).get("ingested_at") == "timestamp"
         else F.col("ingested_at")).alias("ingested_at"),
    ]
    for name, cap in OPTIONAL_CAPS:
        c = F.substring(F.nullif(F.col(name), F.lit("")), 1, cap) if name in df.columns else F.lit(None).cast("string")
        if caps_in_bytes:  # Q28 fix: caps hold in bytes as JSON has them, not only in characters
            c = cut_to_bytes(c, F.lit(cap), measure=escaped_json_len)
        cols.append(c.alias(name))
    return cols


def with_metadata_content(df: DataFrame, content: str = "content_full") -> DataFrame:
    """Reference rule (P10/P11): used bytes, budget ``max(100, 1900 - used)``,
    content cut to the budget. Adds ``meta_used_bytes, meta_budget, content``."""
    cols = metadata_struct(df)
    st = F.struct(*cols)
    n = F.lit(len(FIXED_KEYS)) + sum(F.when(c.isNotNull(), 1).otherwise(0) for c in cols[len(FIXED_KEYS):])
    used = _json_bytes(st, n)
    budget = F.greatest(F.lit(METADATA_CONTENT_MIN_BUDGET), F.lit(METADATA_CONTENT_BUDGET) - used)
    return (
        df.withColumn("meta_used_bytes", used)
        .withColumn("meta_budget", budget)
        .withColumn("content", cut_to_bytes(F.col(content), F.col("meta_budget")))
    )


def fit_metadata(df: DataFrame, content: str = "content_full") -> DataFrame:
    """Q28 fix: the whole serialised metadata (content included, JSON escapes
    counted) is at most 2048 bytes. Optional fields are capped in bytes, and
    the content is cut against the bytes actually left.

    Adds ``content`` and ``meta_json_bytes``.
    """
    cols = metadata_struct(df, caps_in_bytes=True)
    base = df.select("*", *[c.alias(f"_m_{i}") for i, c in enumerate(cols)])
    names = [f"_m_{i}" for i in range(len(cols))]
    keys = list(FIXED_KEYS) + [n for n, _ in OPTIONAL_CAPS]
    st = F.struct(*[F.col(m).alias(k) for m, k in zip(names, keys)])
    n = F.lit(len(FIXED_KEYS)) + sum(F.when(F.col(m).isNotNull(), 1).otherwise(0) for m in names[len(FIXED_KEYS):])
    used = _json_bytes(st, n)
    # the content field adds ', "content": "<escaped>"' = 15 bytes + escaped text
    left = F.lit(FILTERABLE_METADATA_MAX_BYTES) - used - F.lit(15)
    legacy = F.greatest(F.lit(METADATA_CONTENT_MIN_BUDGET), F.lit(METADATA_CONTENT_BUDGET) - used)
    budget = F.least(legacy, left)

    out = base.withColumn("_budget", budget)
    out = out.withColumn("content", cut_to_bytes(F.col(content), F.col("_budget"), measure=escaped_json_len)).drop("_budget")
    full = F.struct(*[F.col(m).alias(k) for m, k in zip(names, keys)], F.col("content").alias("content"))
    out = out.withColumn("meta_json_bytes", _json_bytes(full, n + F.lit(1)))
    return out.drop(*names)
