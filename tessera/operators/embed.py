"""Embedding: the replaceable embedder hook (H1), the built-in hashing
embedder, de-duplication of equal texts (J8) and the embedding cache (S10).

``hash_embed`` is plain DataFrame work: tokens are exploded, hashed into
``dim`` buckets, counted with a partial (map-side) aggregate, and
L2-normalised. Being plain SQL, DuckDB can repeat it exactly.

An external model is plugged in as ``embedder``: a function
``DataFrame(text_md5, text) -> DataFrame(text_md5, vec)``, typically an
iterator pandas UDF calling the model per Arrow batch. It is only ever
called on *distinct* texts that are not in the cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.session import materialize, spread

# token = run of letters/digits of the lower-cased text;
# bucket = first 8 hex digits of md5(token) as an integer, modulo dim.
TOKEN_PATTERN = r"[^\p{L}\p{N}]+"
HASH_EMBED_MODEL = "hash-embed-v1"


def tokens(text) -> F.Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(t), TOKEN_PATTERN, -1), lambda x: x != "")


def token_bucket(tok, dim: int) -> F.Column:
    return F.pmod(F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")


def hash_embed_sparse(df: DataFrame, id_col: str, text_col: str, dim: int, parallelism: int | None = None) -> DataFrame:
    """``id, bucket, cnt, weight``: bucket counts, L2-normalised per id.
    ``parallelism`` deals the texts over so many tasks, for tables of fewer splits than cores."""
    ex = spread(df.select(id_col, text_col), parallelism).select(F.col(id_col), F.explode(tokens(text_col)).alias("tok"))
    counts = ex.groupBy(id_col, token_bucket(F.col("tok"), dim).alias("bucket")).agg(F.count("*").alias("cnt"))
    from pyspark.sql import Window

    norm = F.sqrt(F.sum(F.col("cnt") * F.col("cnt")).over(Window.partitionBy(id_col)))
    return counts.withColumn("weight", F.col("cnt") / norm)


def hash_embed(df: DataFrame, id_col: str, text_col: str, dim: int = 64, out: str = "vec") -> DataFrame:
    """``id, vec``: dense ``array<float>`` of length ``dim`` per id (a text
    without any token gets the zero vector). Two small shuffles: (id, bucket)
    counts pre-aggregated map-side, then at most ``dim`` entries per id."""
    ex = df.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.explode_outer(tokens(text_col)).alias("tok"))
    counts = ex.groupBy(id_col, token_bucket(F.col("tok"), dim).alias("bucket")).agg(F.count("tok").alias("cnt"))
    g = counts.groupBy(id_col).agg(
        F.map_from_entries(F.filter(F.collect_list(F.struct("bucket", "cnt")), lambda x: x["bucket"].isNotNull())).alias("_m"),
        F.nullif(F.sqrt(F.sum(F.col("cnt") * F.col("cnt"))), F.lit(0.0)).alias("_n"),
    )
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                        lambda b: F.coalesce(F.col("_m")[b] / F.col("_n"), F.lit(0.0)).cast("float"))
    return g.select(id_col, dense.alias(out))


class HashVectorizer:
    """Per-task helper of the hashing embedder: token buckets are memoised, so
    md5 runs once per distinct token of the task's vocabulary."""

    def __init__(self, dim: int):
        import regex

        self.dim = dim
        self.split = regex.compile(TOKEN_PATTERN)
        self.memo: dict[str, int] = {}

    def __call__(self, text: str | None):
        import numpy as np

        if text is None:
            return None
        from collections import Counter

        counts = [0] * self.dim  # plain ints: cheaper than numpy item updates
        memo = self.memo
        for tok, n in Counter(self.split.split(text.lower())).items():  # C-speed counting
            if not tok:
                continue
            b = memo.get(tok)
            if b is None:
                b = int(hashlib.md5(tok.encode("utf-8")).hexdigest()[:8], 16) % self.dim
                memo[tok] = b
            counts[b] += n
        arr = np.asarray(counts, dtype=np.float64)
        n2 = float((arr * arr).sum())
        return (arr / np.sqrt(n2) if n2 else arr).astype(np.float32)  # no token: the zero vector


def hash_embed_udf(dim: int = 64):
    """The same hashing embedder as a narrow iterator pandas UDF ``text -> array<float>``
    (equal to ``hash_embed``; tested)."""
    from pyspark.sql import types as T

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vec = HashVectorizer(dim)
        for texts in batches:
            yield pd.Series([vec(t) for t in texts])

    # keep Catalyst from inlining the UDF into every reference of its result
    # (a later filter on the vector would otherwise evaluate it twice)
    return embed.asNondeterministic()


def hash_embedder(dim: int = 64) -> Callable[[DataFrame], DataFrame]:
    """H1 default: ``DataFrame(text_md5, text) -> DataFrame(text_md5, vec)``."""

    def run(texts: DataFrame) -> DataFrame:
        return hash_embed(texts, "text_md5", "text", dim)

    return run


HEAVY_SHARE = 1000
"""A text is heavy when it holds more than one in so many rows, so there are fewer heavy texts than this."""


def _joined(keyed: DataFrame, vecs: DataFrame) -> DataFrame:
    """Vectors joined to rows by ``text_md5``, whatever share of the rows a text holds.

    Rows of heavy texts stay where they are: fewer than ``HEAVY_SHARE``
    vectors are broadcast to them. The others are joined by their hash.
    """
    counts = materialize(keyed.groupBy("text_md5").agg(F.count("*").alias("n")), "hashes")
    least = (counts.agg(F.sum("n")).first()[0] or 0) / HEAVY_SHARE
    heavy = counts.where(F.col("n") > max(1.0, least)).select("text_md5")
    if not heavy.limit(1).count():
        return keyed.join(vecs, "text_md5", "left")
    vecs = materialize(vecs, "vectors")  # read on both ways
    mine = F.broadcast(heavy.withColumn("_heavy", F.lit(True)))
    dealt = keyed.join(mine, "text_md5", "left")
    often = dealt.where(F.col("_heavy")).drop("_heavy").join(F.broadcast(vecs.join(heavy, "text_md5", "left_semi")), "text_md5", "left")
    return often.unionByName(dealt.where(F.col("_heavy").isNull()).drop("_heavy").join(vecs, "text_md5", "left"))


def _texts(keyed: DataFrame, cut: Column) -> DataFrame:
    """``text_md5, text`` of every distinct text."""
    return keyed.select("text_md5", cut.alias("text")).dropDuplicates(["text_md5"])


def embed_dedup(df: DataFrame, text_col: str, embedder: Callable[[DataFrame], DataFrame], out: str = "vec") -> DataFrame:
    """Embed each distinct (cut) text once and join the vector back.

    The embedder sees ``text_md5, text`` with unique ``text_md5``. ``df`` is
    read more than once; pass a written table where it is dear.
    """
    cut = tx.embed_cut(F.col(text_col))
    keyed = df.withColumn("text_md5", F.md5(cut))
    return _joined(keyed, embedder(_texts(keyed, cut)).select("text_md5", F.col("vec").alias(out)))


def embed_with_cache(df: DataFrame, text_col: str, cache: DataFrame, embedder: Callable[[DataFrame], DataFrame],
                     model: str, dim: int, out: str = "vec") -> tuple[DataFrame, DataFrame]:
    """Look vectors up in ``cache(text_md5, model, dim, vec)``; embed only
    the misses (distinct texts); return ``(rows with vec, new cache rows)``.

    Q18 fix: the cache key includes model and dimension and hashes the
    truncated model input. Append the new rows to the cache table
    (``write.mode('append')``) to make them visible to later runs.
    """
    cut = tx.embed_cut(F.col(text_col))
    keyed = df.withColumn("text_md5", F.md5(cut))
    c = cache.where((F.col("model") == model) & (F.col("dim") == dim)).select("text_md5", F.col("vec").alias("_cv"))
    misses = _texts(keyed, cut).join(c.select("text_md5"), "text_md5", "left_anti")
    new = embedder(misses).select("text_md5", F.lit(model).alias("model"), F.lit(dim).alias("dim"), "vec")
    allv = c.select("text_md5", F.col("_cv").alias(out)).unionByName(new.select("text_md5", F.col("vec").alias(out)))
    return keyed.join(allv, "text_md5", "left"), new


class EmbeddingCache:
    """A stored cache of vectors, bucketed by the hash of the model input.

    The files lie under ``path``; a table of the session's catalog tells Spark
    how they are bucketed, so that looking up and merging do not shuffle what
    is cached. Any session opens the same files under the same ``buckets``.
    """

    DDL = "text_md5 string, model string, dim int, vec array<float>"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = "tessera_cache_" + hashlib.md5(path.encode()).hexdigest()
        spark.sql(f"create table if not exists {self.name} ({self.DDL}) using parquet clustered by (text_md5) into {int(buckets)} buckets location '{path}'")

    def read(self, model: str, dim: int) -> DataFrame:
        """``text_md5, vec`` of a model; a text that two runs added at once counts once."""
        self.spark.catalog.refreshTable(self.name)
        rows = self.spark.table(self.name).where((F.col("model") == model) & (F.col("dim") == dim))
        return rows.groupBy("text_md5").agg(F.min("vec").alias("vec"))

    def add(self, rows: DataFrame) -> None:
        rows.select(*[c.split()[0] for c in self.DDL.split(", ")]).write.format("parquet").bucketBy(self.buckets, "text_md5").mode("append").saveAsTable(self.name)


def embed_cached(df: DataFrame, text_col: str, cache: EmbeddingCache, embedder: Callable[[DataFrame], DataFrame], model: str, dim: int,
                 out: str = "vec") -> tuple[DataFrame, int]:
    """Vectors of all rows; the embedder sees only texts that are not cached, and what it makes is added.

    Hashes are looked up first, so the texts of cached rows are not shuffled.
    Returns the rows with ``text_md5`` and ``out``, and how many texts were embedded.
    """
    cut = tx.embed_cut(F.col(text_col))
    keyed = df.withColumn("text_md5", F.md5(cut))
    hashes = keyed.where(F.col("text_md5").isNotNull()).select("text_md5").distinct()
    misses = materialize(hashes.join(cache.read(model, dim).select("text_md5"), "text_md5", "left_anti"), "misses")
    n = misses.count()
    if n:
        texts = _texts(keyed.join(misses, "text_md5", "left_semi"), cut)
        new = embedder(texts).select("text_md5", F.lit(model).alias("model"), F.lit(dim).alias("dim"), F.col("vec").cast("array<float>").alias("vec"))
        cache.add(new)
    return _joined(keyed, cache.read(model, dim).select("text_md5", F.col("vec").alias(out))), n
