"""Inputs derived by Spark from the driver's tables (see FIXTURES.md part 3).

Every view here reads the whole tables; nothing is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.schema import IndexSpec
from tessera.sources.tables import read_table

EMBED_DIM = 64
FIXTURE_SPEC = IndexSpec(dim=EMBED_DIM, metric="cosine")


def index_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One index row per embedding whose document exists: key, vec and typed metadata."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    j = e.join(d, e.vec_id == d.doc_id)
    did = F.col("doc_id").cast("string")
    return j.select(
        tx.vector_key(did, F.lit(0)).alias("key"),
        F.col("embedding").alias("vec"),
        "vec_id",
        did.alias("doc_id"),
        F.lit(0).alias("chunk_index"),
        F.lit(1).alias("total_chunks"),
        "lang",
        "source",
        F.concat_ws(",", "lang", "source").alias("tags"),
        F.when(F.col("doc_id") % 3 == 0, "md").when(F.col("doc_id") % 3 == 1, "txt").otherwise("html").alias("file_type"),
        F.md5("text").alias("content_hash"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 90).cast("int")).cast("timestamp").alias(
            "ingested_at"
        ),
        F.col("n_chars").cast("double").alias("score_num"),
        F.col("text").alias("content"),
    )


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding is a query (query_id = vec_id)."""
    return read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec")
    )


# DuckDB text of the same view, for oracles.
INDEX_VIEW_SQL = """
select concat(cast(d.doc_id as varchar), '.chunk-0000') as key, e.embedding as vec, e.vec_id,
       cast(d.doc_id as varchar) as doc_id, 0 as chunk_index, 1 as total_chunks, d.lang, d.source,
       concat(d.lang, ',', d.source) as tags,
       case when d.doc_id % 3 = 0 then 'md' when d.doc_id % 3 = 1 then 'txt' else 'html' end as file_type,
       md5(d.text) as content_hash,
       cast(date '2024-01-01' + cast(d.doc_id % 90 as integer) as timestamp) as ingested_at,
       cast(d.n_chars as double) as score_num, d.text as content
from embeddings e join documents d on e.vec_id = d.doc_id
"""


def markdown_corpus(spark: SparkSession, sf_dir: str, file_type: str = "md") -> DataFrame:
    """Every document turned into Markdown with nested, repeated and
    level-skipping headings (FIXTURES.md part 3)."""
    d = read_table(spark, sf_dir, "documents")
    did = F.col("doc_id").cast("string")
    text = F.concat(
        F.lit("# T"), did, F.lit("\n## A\n"), F.replace(F.col("text"), F.lit("\n"), F.lit("\n### L\n")),
        F.lit("\n# Z\n### deep"),
    )
    return d.select(did.alias("doc_id"), text.alias("text"), F.lit(file_type).alias("file_type"), "lang", "source")


MARKDOWN_SQL = """
select cast(doc_id as varchar) as doc_id,
       concat('# T', cast(doc_id as varchar), chr(10) || '## A' || chr(10), replace(text, chr(10), chr(10) || '### L' || chr(10)),
              chr(10) || '# Z' || chr(10) || '### deep') as text, lang, source
from documents
"""


def plain_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the index view's file type rule (md / txt / html by id)."""
    d = read_table(spark, sf_dir, "documents")
    ft = F.when(F.col("doc_id") % 3 == 0, "md").when(F.col("doc_id") % 3 == 1, "txt").otherwise("html")
    return d.select(F.col("doc_id").cast("string").alias("doc_id"), "text", ft.alias("file_type"), "lang", "source")


def line_index(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None, hash_col=None) -> DataFrame:
    """A multi-chunk index without vectors: every non-blank line of a
    document is a chunk (dense index, total per document, document hash)."""
    d = docs if docs is not None else read_table(spark, sf_dir, "documents")
    h = hash_col if hash_col is not None else F.md5("text")
    d = d.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang", "source", h.alias("content_hash"),
                 F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id").cast("long") % 90).cast("int")).cast("timestamp").alias("ingested_at"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: ~tx.is_blank(x))
    d = d.withColumn("_lines", lines).drop("text")  # index and total without a shuffle
    ln = d.select(*d.columns[:-1], F.size("_lines").alias("total_chunks"), F.posexplode("_lines").alias("chunk_index", "content"))
    return ln.select(
        tx.vector_key("doc_id", "chunk_index").alias("key"), "doc_id", "chunk_index", "total_chunks", "content_hash",
        F.concat_ws(",", "lang", "source").alias("tags"), "source", "ingested_at", "content",
    )


def line_index_sql(docs_sql: str = "documents", hash_sql: str = "md5(text)") -> str:
    return f"""
(select printf('%s.chunk-%04d', doc_id, chunk_index) as key, doc_id, chunk_index, total_chunks, content_hash,
        concat(lang, ',', source) as tags, source, ingested_at, content
 from (select doc_id, lang, source, content_hash, ingested_at, content,
              cast(row_number() over (partition by doc_id order by pos) - 1 as integer) as chunk_index,
              cast(count(*) over (partition by doc_id) as integer) as total_chunks
       from (select cast(doc_id as varchar) as doc_id, lang, source, {hash_sql} as content_hash,
                    cast(date '2024-01-01' + cast(doc_id % 90 as integer) as timestamp) as ingested_at,
                    unnest(string_split(text, chr(10))) as content,
                    unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) as pos
             from {docs_sql})
       where regexp_matches(content, '\\S')))
"""


# Sync scenario: two versions of the corpus (FIXTURES.md part 3).
def incoming_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    return d.where(F.col("doc_id") % 11 != 0)


def stored_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored version: documents with doc_id % 7 <> 0; ids divisible by 5 were
    stored with a different text (so their hash differs)."""
    d = read_table(spark, sf_dir, "documents").where(F.col("doc_id") % 7 != 0)
    return d.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")))


INCOMING_SQL = "(select * from documents where doc_id % 11 <> 0)"
STORED_SQL = ("(select doc_id, case when doc_id % 5 = 0 then concat(text, 'x') else text end as text, lang, source, n_chars "
              "from documents where doc_id % 7 <> 0)")
