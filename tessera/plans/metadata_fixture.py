"""Every document as one chunk with metadata, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.metadata import fit_metadata, with_metadata_content
from tessera.schema import FILTERABLE_METADATA_MAX_BYTES


def _doc_chunk(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.lit(0).alias("chunk_index"),
        F.lit(1).alias("total_chunks"),
        F.md5("text").alias("content_hash"),
        F.lit("txt").alias("file_type"),
        F.lit("2024-01-01T00:00:00Z").alias("ingested_at"),
        "source",
        F.col("lang").alias("tags"),
        F.col("text").alias("content_full"),
    )


def chunk_metadata_fixture(docs: DataFrame) -> DataFrame:
    out = with_metadata_content(_doc_chunk(docs))
    return out.select(
        "doc_id", "meta_used_bytes", "meta_budget", F.length("content").alias("content_chars"),
        F.octet_length("content").alias("content_bytes"), F.md5("content").alias("content_md5"),
    )


def metadata_budget_fixture(docs: DataFrame) -> DataFrame:
    out = fit_metadata(_doc_chunk(docs))
    return out.select("doc_id", F.length("content").alias("content_chars"), "meta_json_bytes",
                      (F.col("meta_json_bytes") <= FILTERABLE_METADATA_MAX_BYTES).alias("fits"))


_META_SQL_BASE = """
base as (select cast(doc_id as varchar) as doc_id, text,
  octet_length(encode(json_object('doc_id', cast(doc_id as varchar), 'chunk_index', '0', 'total_chunks', '1',
     'content_hash', md5(text), 'file_type', 'txt', 'ingested_at', '2024-01-01T00:00:00Z', 'source', source,
     'tags', lang)::varchar)) + 15 as used
  from documents)
"""

CHUNK_METADATA_SQL = f"""
with recursive {_META_SQL_BASE},
b as (select doc_id, text, used, greatest(100, 1900 - used) as budget from base),
cut(doc_id, used, budget, t) as (
  select doc_id, used, budget, text from b
  union all
  select doc_id, used, budget, left(t, floor(length(t) * 3 / 4)::bigint) from cut where octet_length(encode(t)) > budget)
select doc_id, used as meta_used_bytes, budget as meta_budget, length(t) as content_chars,
       octet_length(encode(t)) as content_bytes, md5(t) as content_md5
from cut where octet_length(encode(t)) <= budget
"""

METADATA_BUDGET_SQL = f"""
with recursive {_META_SQL_BASE},
b as (select doc_id, text, used, least(greatest(100, 1900 - used), 2048 - used - 15) as budget from base),
cut(doc_id, used, budget, t) as (
  select doc_id, used, budget, text from b
  union all
  select doc_id, used, budget, left(t, floor(length(t) * 3 / 4)::bigint) from cut
  where octet_length(encode(to_json(t)::varchar)) - 2 > budget),
fin as (select doc_id, used, t from cut where octet_length(encode(to_json(t)::varchar)) - 2 <= budget)
select doc_id, length(t) as content_chars,
       used + 15 + octet_length(encode(to_json(t)::varchar)) - 2 as meta_json_bytes,
       used + 15 + octet_length(encode(to_json(t)::varchar)) - 2 <= 2048 as fits
from fin
"""
