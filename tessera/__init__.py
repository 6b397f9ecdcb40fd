"""tessera: a Spark-native document knowledge base.

Documents become chunks, chunks become vectors, vectors live in a plain
Parquet table with typed metadata, and every operation (search, sync,
upsert, delete, re-tag, statistics) is a DataFrame -> DataFrame operator.
"""

from tessera.session import get_spark, checkpoint_dir  # noqa: F401
from tessera.schema import IndexSpec  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir", "IndexSpec"]
