"""Table shapes and index parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour (service limits and
# ingest caps). Kept together, in natural order.
# ---------------------------------------------------------------------------
TOP_K_MIN = 1
TOP_K_MAX = 100
EMBED_INPUT_MAX_CHARS = 8000
FILTERABLE_METADATA_MAX_BYTES = 2048
METADATA_CONTENT_BUDGET = 1900
METADATA_CONTENT_MIN_BUDGET = 100
DIMENSION_MIN = 1
DIMENSION_MAX = 4096
CAP_SOURCE = 200
CAP_TAGS = 100
CAP_AUTHOR = 100
CAP_HEADING_PATH = 150
CAP_CONTEXT_PREFIX = 200
DEFAULT_CHUNK_SIZE = 512
DEFAULT_CHUNK_OVERLAP = 64
DEFAULT_MIN_CHUNK = 100
DEFAULT_TOP_K = 5
DEFAULT_THRESHOLD = 0.6
DEFAULT_GLOB = "*.md,*.txt,*.html"
METRICS = ("cosine", "euclidean")
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class IndexSpec:
    """What the vector service keeps per index: dimension, metric and the
    metadata keys that are stored but may not be used in filters."""

    dim: int
    metric: str = "cosine"
    non_filterable: tuple = field(default_factory=tuple)

    def __post_init__(self):
        if not (DIMENSION_MIN <= self.dim <= DIMENSION_MAX):
            raise ValueError(f"dimension must be in [{DIMENSION_MIN}, {DIMENSION_MAX}], got {self.dim}")
        if self.metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}, got {self.metric!r}")


# The vector table. Known metadata keys are typed top-level columns so that
# filters push down to the Parquet scan; user keys go to ``extra``.
INDEX_SCHEMA = T.StructType(
    [
        T.StructField("key", T.StringType(), False),
        T.StructField("vec", T.ArrayType(T.FloatType(), True), True),
        T.StructField("doc_id", T.StringType(), True),
        T.StructField("chunk_index", T.IntegerType(), True),
        T.StructField("total_chunks", T.IntegerType(), True),
        T.StructField("content_hash", T.StringType(), True),
        T.StructField("file_type", T.StringType(), True),
        T.StructField("ingested_at", T.TimestampType(), True),
        T.StructField("source", T.StringType(), True),
        T.StructField("tags", T.StringType(), True),
        T.StructField("author", T.StringType(), True),
        T.StructField("heading_path", T.StringType(), True),
        T.StructField("context_prefix", T.StringType(), True),
        T.StructField("content", T.StringType(), True),
        T.StructField("chunk_text", T.StringType(), True),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType()), True),
    ]
)

VECTOR_RECORD_SCHEMA = T.StructType(
    [
        T.StructField("key", T.StringType(), True),
        T.StructField("data", T.StructType([T.StructField("float32", T.ArrayType(T.FloatType()), True)]), True),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType()), True),
    ]
)

TAG_CATALOG_SCHEMA = T.StructType(
    [
        T.StructField(
            "tags",
            T.MapType(
                T.StringType(),
                T.StructType(
                    [
                        T.StructField("label", T.StringType(), True),
                        T.StructField("keywords", T.ArrayType(T.StringType()), True),
                        T.StructField("description", T.StringType(), True),
                    ]
                ),
            ),
            True,
        ),
        T.StructField("default_tag", T.StringType(), True),
        T.StructField("allow_custom", T.BooleanType(), True),
    ]
)
