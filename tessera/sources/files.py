"""Sources: corpus files, inline text, vector/query JSON, the tag catalog.

Every reader is a Spark reader (distributed listing and reading); nothing
is read on the driver.
"""

from __future__ import annotations

import os
import uuid
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as tx
from tessera.schema import DEFAULT_GLOB, TAG_CATALOG_SCHEMA, VECTOR_RECORD_SCHEMA


def _brace_glob(globs: str) -> str:
    pats = [g.strip() for g in globs.split(",") if g.strip()]
    return pats[0] if len(pats) == 1 else "{" + ",".join(pats) + "}"


def scan_corpus(spark: SparkSession, directory: str, globs: str = DEFAULT_GLOB, source: str | None = None,
                tags: str | None = None, author: str | None = None) -> DataFrame:
    """Recursive read of every file matching any of the comma globs.

    One row per file (``wholetext``), unique paths. Returns the corpus shape:
    ``doc_id, path, text, file_type, source, tags, author``; HTML is reduced to
    its text (P4) and blank documents are dropped (F9).
    """
    raw = (
        spark.read.format("text")
        .option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", _brace_glob(globs))
        .load(directory)
        .select(F.col("_metadata.file_path").alias("uri"), F.col("value").alias("raw"))
    )
    # file:/a/b.md -> /a/b.md (other schemes keep their full URI)
    path = F.regexp_replace("uri", r"^file:(//)?", "")
    base = directory.rstrip("/")
    return corpus_from_files(raw.withColumn("path", path), base_dir=base, source=source, tags=tags, author=author)


FOLDERS = 256
"""Folders that files written by their name are dealt over: a folder is listed by one task."""


def write_files(texts: DataFrame, directory: str) -> None:
    """``texts(name, text)``: the rows of a name as the lines of one file, ``<folder>/<name>`` under ``directory``.

    On a shared local folder the tasks write the files themselves (each under
    another name first, so that a repeated task does no harm): Hadoop's local
    file system starts several processes for every file. Other file systems
    get Spark's writer, with a folder for each name.
    """
    spark = texts.sparkSession
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    dealt = texts.select("name", "text").repartition("name").sortWithinPartitions("name")
    if fs.getUri().getScheme() != "file":
        dealt.write.partitionBy("name").text(directory)
        return
    path, folders = fs.makeQualified(root).toUri().getPath(), FOLDERS

    def run(batches):
        import zlib

        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for name, own in groupby(rows, key=lambda r: r[0]):
            folder = os.path.join(path, f"{zlib.crc32(name.encode()) % folders:03d}")
            os.makedirs(folder, exist_ok=True)
            new = os.path.join(folder, f".{uuid.uuid4().hex}")
            with open(new, "wb") as f:
                f.writelines((t or "").encode() + b"\n" for _, t in own)
            os.replace(new, os.path.join(folder, name))
        yield from ()

    os.makedirs(path, exist_ok=True)  # a table without rows is an empty folder
    dealt.mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()


def read_file(spark: SparkSession, path: str, doc_id: str | None = None, **kw) -> DataFrame:
    """One file; an explicit ``doc_id`` replaces the derived id (and so needs a path of exactly one file)."""
    if doc_id:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
        if found is None or len(found) != 1 or found[0].isDirectory():
            raise ValueError(f"an explicit doc_id takes one file, not {path}")
    raw = (
        spark.read.format("text").option("wholetext", True).load(path)
        .select(F.col("_metadata.file_path").alias("uri"), F.col("value").alias("raw"))
        .withColumn("path", F.regexp_replace("uri", r"^file:(//)?", ""))
    )
    out = corpus_from_files(raw, base_dir="", **kw)
    if doc_id:
        out = out.withColumn("doc_id", F.lit(doc_id))
    return out


def corpus_from_files(raw: DataFrame, base_dir: str = "", source: str | None = None, tags: str | None = None,
                      author: str | None = None) -> DataFrame:
    """Files (``path, raw``) -> corpus rows. Blank files are dropped before
    HTML extraction, as in the reference."""
    ft = tx.file_type("path")
    df = raw.where(~tx.is_blank("raw")).withColumn("file_type", ft)
    html = F.col("file_type") == "html"
    text = F.when(html, tx.html_text(F.when(html, F.col("raw")))).otherwise(F.col("raw"))  # other files don't go through the parser
    return df.select(
        tx.doc_id_from_path("path", base_dir=base_dir + "/" if base_dir else "").alias("doc_id"),
        "path",
        text.alias("text"),
        "file_type",
        (F.lit(source) if source else F.col("path")).alias("source"),
        F.lit(tags or "").alias("tags"),
        F.lit(author or "").alias("author"),
    )


def inline_docs(texts: DataFrame, text_col: str = "text", source: str = "stdin", tags: str = "",
                author: str = "", keep=()) -> DataFrame:
    """S3: text given directly -> corpus rows (id ``stdin-`` + md5[:12], type txt)."""
    return texts.where(~tx.is_blank(text_col)).select(
        tx.inline_doc_id(text_col).alias("doc_id"),
        F.lit(None).cast("string").alias("path"),
        F.col(text_col).alias("text"),
        F.lit("txt").alias("file_type"),
        F.lit(source).alias("source"),
        F.lit(tags).alias("tags"),
        F.lit(author).alias("author"),
        *keep,
    )


def read_vector_records(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of ``{key, data: {float32: [...]}, metadata: {...}}`` records.

    Metadata values are kept as JSON text per key (strings unquoted) in
    ``extra``; known keys are lifted to typed columns by ``index.conform``.
    """
    recs = spark.read.schema(T.StructType([T.StructField("key", T.StringType()),
                                           T.StructField("data", VECTOR_RECORD_SCHEMA["data"].dataType),
                                           T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])) \
        .option("multiLine", True).option("mode", "FAILFAST").json(path)
    return vector_records(recs)


def parse_vector_records(json_text_df: DataFrame, col: str = "value") -> DataFrame:
    """S4 from a string column holding a JSON array of records."""
    arr = _parsed(col, F.from_json(F.col(col), T.ArrayType(VECTOR_RECORD_SCHEMA), {"mode": "FAILFAST"}))
    recs = json_text_df.select(F.explode(arr).alias("r")).select("r.*")
    return vector_records(recs)


def _parsed(col: str, value):
    """A parsed JSON array; text that isn't one fails the job, it does not vanish."""
    array = F.trim(F.regexp_replace(F.col(col), r"[\x09-\x0D]+", " ")).startswith("[")
    bad = F.raise_error(F.concat(F.lit("not a JSON array: "), F.substring(F.coalesce(F.col(col), F.lit("null")), 1, 80)))
    return F.when(F.coalesce(array, F.lit(False)), value).otherwise(bad)


def vector_records(recs: DataFrame) -> DataFrame:
    known = ("doc_id", "content_hash", "file_type", "source", "tags", "author", "heading_path", "context_prefix", "content")
    m = F.col("metadata")
    cols = [F.col("key"), F.col("data.float32").alias("vec")]
    cols += [m.getItem(k).alias(k) for k in known]
    cols += [m.getItem("chunk_index").try_cast("int").alias("chunk_index"),
             m.getItem("total_chunks").try_cast("int").alias("total_chunks"),
             F.to_timestamp(m.getItem("ingested_at")).alias("ingested_at"),
             F.map_filter(m, lambda k, v: ~k.isin(*known, "chunk_index", "total_chunks", "ingested_at")).alias("extra")]
    return recs.select(*cols)


def read_query_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Query vectors from JSON: one array per query (``[[...], [...]]``) or a single array."""
    txt = spark.read.text(path, wholetext=True)
    return parse_query_vectors(txt)


def parse_query_vectors(txt: DataFrame, col: str = "value", keep=()) -> DataFrame:
    """One JSON text per row: a batch ``[[...], ...]`` or one vector ``[...]``;
    ``query_id`` is the position inside the text, ``keep`` columns are carried."""
    nested = F.from_json(F.col(col), T.ArrayType(T.ArrayType(T.FloatType())), {"mode": "FAILFAST"})
    flat = F.from_json(F.col(col), T.ArrayType(T.FloatType()), {"mode": "FAILFAST"})
    is_batch = F.regexp_like(F.col(col), F.lit(r"^\s*\[\s*\["))
    arr = _parsed(col, F.when(is_batch, nested).otherwise(F.array(flat)))
    return txt.select(*keep, F.posexplode(arr).alias("query_id", "qvec")).select(
        *keep, F.col("query_id").cast("long"), "qvec"
    )


def read_tag_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The tag file -> ``name, label, keywords, description`` sorted by name.

    A missing file gives an empty catalog.
    """
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "name string, label string, keywords array<string>, description string")
    return tag_rows(spark.read.schema(TAG_CATALOG_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path))


def tag_rows(cat: DataFrame) -> DataFrame:
    return (
        cat.select(F.explode("tags").alias("name", "t"))
        .select("name", F.col("t.label").alias("label"), F.col("t.keywords").alias("keywords"),
                F.col("t.description").alias("description"))
        .orderBy("name")
    )


def id_collisions(corpus: DataFrame) -> DataFrame:
    """Q10: document ids shared by different paths (the later file would overwrite the earlier)."""
    return (corpus.groupBy("doc_id").agg(F.array_sort(F.collect_set("path")).alias("paths"))
            .where(F.size("paths") > 1))
