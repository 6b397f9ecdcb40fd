"""Keyed operations on the vector table: put (upsert), get, delete, list,
page, segment, validation, and the versioned Parquet layout.

Layout: Parquet partitioned by ``bucket = pmod(xxhash64(doc_id), B)``. A
write adds parts to the buckets that change (new rows, ids of deleted
documents), and a manifest names the parts of every bucket (see "Versioned
storage" below), so a replace or delete never rewrites what stays and never
overwrites a path that is being read.
"""

from __future__ import annotations

import os
import time
import uuid
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import session
from tessera.schema import INDEX_SCHEMA, IndexSpec
from tessera.session import materialize, rows_of

DEFAULT_BUCKETS = 64
MAX_FILE_ROWS = 1_000_000


def bucket_of(doc_id, buckets: int = DEFAULT_BUCKETS):
    return F.pmod(F.xxhash64(F.col(doc_id) if isinstance(doc_id, str) else doc_id), F.lit(buckets)).cast("int")


def conform(df: DataFrame) -> DataFrame:
    """Give a DataFrame the full index schema (absent metadata columns are null)."""
    cols = []
    for f in INDEX_SCHEMA.fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def dim_violations(vectors: DataFrame, spec: IndexSpec, vec_col: str = "vec") -> DataFrame:
    """rows whose vector length differs from the index dimension, with ``dim``."""
    return vectors.where(F.col(vec_col).isNull() | (F.size(vec_col) != spec.dim)).withColumn(
        "dim", F.size(vec_col)
    )


def assert_dims(vectors: DataFrame, spec: IndexSpec, vec_col: str = "vec") -> DataFrame:
    """Fail fast (at execution) on a wrong dimension, without an extra pass."""
    ok = F.col(vec_col).isNotNull() & (F.size(vec_col) == spec.dim)
    return vectors.where(F.assert_true(ok, F.lit(f"vector dimension must be {spec.dim}")).isNull())


def split_keys(keys) -> list[str]:
    """The keys of a comma list (or Python list), without blanks."""
    if isinstance(keys, str):
        keys = keys.split(",")
    return [k.strip() for k in keys if k and k.strip()]


def keys_from_list(spark: SparkSession, keys) -> DataFrame:
    """A comma list (or Python list) of keys -> a one-column DataFrame."""
    return spark.createDataFrame([(k,) for k in split_keys(keys)], "key string")


def _key_table(spark: SparkSession, keys) -> DataFrame:
    """Distinct keys of a list or a table, written where they must be worked out first."""
    if isinstance(keys, DataFrame):
        return materialize(keys.select("key").distinct(), "keys")
    return keys_from_list(spark, sorted(set(split_keys(keys))))


def get_vectors(index: DataFrame, keys, return_data: bool = False, return_metadata: bool = True) -> DataFrame:
    """Point lookup by a list or a table of keys; missing keys are silently absent.

    Keys are broadcast in waves of a measured size, so the index stays in place.
    """
    out = rows_of(index, _key_table(index.sparkSession, keys), ["key"])
    return project(out, return_data, return_metadata)


def project(index: DataFrame, return_data: bool, return_metadata: bool) -> DataFrame:
    """Optional vector / metadata in the output -- plain column pruning."""
    cols = ["key"]
    if return_data:
        cols.append("vec")
    if return_metadata:
        cols += [c for c in index.columns if c not in ("key", "vec", "bucket")]
    return index.select(*cols)


def delete_keys(index: DataFrame, keys) -> DataFrame:
    """The index without the given keys (a list or a table, broadcast in waves of a measured size)."""
    return rows_of(index, _key_table(index.sparkSession, keys), ["key"], anti=True)


def delete_docs(index: DataFrame, doc_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove every chunk of the given documents.

    Returns ``(remaining_index, deleted_counts(doc_id, deleted_chunks))``.
    """
    ids = doc_ids.select("doc_id").distinct()
    remaining = index.join(ids, "doc_id", "left_anti")
    deleted = index.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("deleted_chunks"))
    return remaining, deleted


def doc_chunks(index: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """rows of the given documents (a column predicate, no key-prefix scan)."""
    return index.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")


def doc_header_rows(index: DataFrame) -> DataFrame:
    """chunk 0 of every document with a non-empty id."""
    return index.where((F.col("chunk_index") == 0) & F.col("doc_id").isNotNull() & (F.col("doc_id") != ""))


def doc_hashes(index: DataFrame) -> DataFrame:
    """A5: stored ``doc_id -> content_hash`` (latest header row wins)."""
    return doc_header_rows(index).groupBy("doc_id").agg(
        F.max_by("content_hash", F.struct("ingested_at", "key")).alias("content_hash")
    )


def latest_version(rows: DataFrame, key: str = "key", version: str = "version") -> DataFrame:
    """Keep the last write per key.

    ``max_by`` over ``(version, tiebreak)`` is a partial (map-side) aggregate,
    so a key with millions of versions is reduced before the shuffle.
    """
    payload = [c for c in rows.columns if c != key]
    order = F.struct(F.col(version), F.xxhash64(*payload))  # of equal versions always the same row
    agg = rows.groupBy(key).agg(F.max_by(F.struct(*payload), order).alias("_r"))
    return agg.select(key, *[F.col("_r")[c].alias(c) for c in payload])


def put_vectors(index: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert -- a key present in ``new`` replaces the stored row.

    Duplicate keys inside ``new`` keep the highest ``version`` (if given); ties,
    and duplicates without versions, are decided by a hash of the row, so that
    every run keeps the same one. The new keys are anti-joined; Spark broadcasts
    them where their size, measured at run time, allows it.
    """
    if "version" in new.columns:
        new = latest_version(new, "key", "version").drop("version")
    else:
        new = latest_version(new.withColumn("_v", F.lit(0)), "key", "_v").drop("_v")
    kept = index.join(new.select("key"), "key", "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def list_vectors(index: DataFrame, return_data: bool = False, return_metadata: bool = False) -> DataFrame:
    """Scan of the index; vector and metadata only when asked (column pruning)."""
    return project(index, return_data, return_metadata)


def segment_of(key_col: str, n: int):
    """Segment number in [0, n) from the md5 of the key (same in SQL)."""
    return F.pmod(F.conv(F.substring(F.md5(F.col(key_col)), 1, 8), 16, 10).cast("bigint"), F.lit(n)).cast("int")


def segment_scan(index: DataFrame, n: int, i: int, key_col: str = "key") -> DataFrame:
    """Segment ``i`` of ``n`` for parallel listing; both must be given."""
    if n is None or i is None:
        raise ValueError("segment count and segment index must both be given")
    if not (0 <= i < n):
        raise ValueError("segment index must be in [0, segment count)")
    return index.where(segment_of(key_col, n) == i)


def page_vectors(index: DataFrame, max_results: int, next_token: str | None = None, key_col: str = "key"):
    """Keyset page -- keys after the token, in key order, at most ``max_results``.

    The continuation token of a full page is its last key. Planned as
    ``TakeOrderedAndProject`` (a per-partition top-n, no full sort).
    """
    df = index if not next_token else index.where(F.col(key_col) > F.lit(next_token))
    page = df.orderBy(key_col).limit(max_results)
    return page


# --------------------------------------------------------------------------
# Versioned storage
#
#   base/_manifests/v-<number>             the parts of every bucket; the highest
#                                          complete number is current
#   base/<version>/rows/bucket=<b>/        rows that <version> added to bucket b
#   base/<version>/deletes/bucket=<b>/     ids of documents whose older rows in
#                                          bucket b are gone
#
# A write adds a part of rows and a part of deleted ids to the buckets it
# touches and rewrites nothing; a part of deletes hides the rows of its
# documents in parts that an earlier manifest added. ``compact_index`` turns the
# parts of a bucket into one again.
#
# A manifest is written to a temporary file and renamed to the next number,
# which fails if another writer has it; its last line counts the others.
# Readers take the highest manifest that is whole, so neither a reader between
# nor a writer that dies sees or leaves anything but a complete version. A
# writer that comes second adds its parts to what the first has made. Files are
# never overwritten, and bucket = f(doc_id). The small metadata files go through
# the Hadoop FileContext / FileSystem API directly (no Spark job).
# --------------------------------------------------------------------------


class Part(NamedTuple):
    kind: str
    """``rows`` or ``deletes``."""
    number: int
    """The manifest that added it."""
    path: str
    ids: int = 0
    """Deleted documents in it."""


class Manifest(NamedTuple):
    number: int
    buckets: int
    parts: dict[int, list[Part]]


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifest_dir(base: str) -> str:
    return os.path.join(base, "_manifests")


def _name(number: int) -> str:
    return f"v-{number:012d}"


def _new_version() -> str:
    return f"v-{int(time.time() * 1000):013d}-{uuid.uuid4().hex[:8]}"


def _numbers(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the manifests that are there, whole or not, ascending."""
    p, fs = _fs(spark, _manifest_dir(base))
    if not fs.exists(p):
        return []
    names = [st.getPath().getName() for st in fs.listStatus(p) if st.isFile()]
    return sorted(int(n[2:]) for n in names if n.startswith("v-"))


def _read_text(spark: SparkSession, path: str) -> str:
    p, fs = _fs(spark, path)
    ins = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(ins, "UTF-8")
    finally:
        ins.close()


def _write_text(fs, path, text: str) -> None:
    out = fs.create(path, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def _format(buckets: int, parts: dict[int, list[Part]]) -> str:
    lines = [f"{b}\t{p.kind}\t{p.number}\t{p.ids}\t{p.path}" for b in sorted(parts) for p in parts[b]]
    return "\n".join([f"#index\t2\t{buckets}", *lines, f"#end\t{len(lines)}", ""])


def _parse(text: str, number: int) -> Manifest | None:
    """The manifest in ``text``; None if the text was cut."""
    head, *lines = text.split("\n")
    kind = head.split("\t")
    parts: dict[int, list[Part]] = {}
    if kind[0] == "#buckets" and not text.startswith("#index"):  # first layout: a directory per bucket, no last line
        if lines and lines[-1] == "":
            rows = [ln.split("\t", 1) for ln in lines[:-1]]
            return Manifest(number, int(kind[1]), {int(b): [Part("rows", 0, d)] for b, d in rows})
        return None
    if len(kind) != 3 or kind[:2] != ["#index", "2"] or len(lines) < 2 or lines[-1] != "" or lines[-2] != f"#end\t{len(lines) - 2}":
        return None
    for ln in lines[:-2]:
        b, what, n, ids, path = ln.split("\t", 4)
        parts.setdefault(int(b), []).append(Part(what, int(n), path, int(ids)))
    return Manifest(number, int(kind[2]), parts)


def current_manifest(spark: SparkSession, base: str) -> Manifest | None:
    """The newest manifest that is whole; None when the index does not exist."""
    for n in reversed(_numbers(spark, base)):
        got = _parse(_read_text(spark, os.path.join(_manifest_dir(base), _name(n))), n)
        if got is not None:
            return got
    return None


def current_version(spark: SparkSession, base: str) -> str | None:
    """Name of the newest committed manifest, or None when the index does not exist."""
    m = current_manifest(spark, base)
    return _name(m.number) if m else None


def read_manifest(spark: SparkSession, base: str) -> tuple[int, dict[int, list[Part]]] | None:
    """``(buckets, {bucket: its parts})`` of the current version."""
    m = current_manifest(spark, base)
    return (m.buckets, m.parts) if m else None


def _empty_index(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], T.StructType(INDEX_SCHEMA.fields + [T.StructField("bucket", T.IntegerType())]))


def _living(spark: SparkSession, parts: dict[int, list[Part]], buckets: int) -> DataFrame:
    """Rows of these parts that no later part deletes.

    Parts that nothing later deletes from are read as they are; the others
    are held against the deleted ids, whose part has a higher number; as many
    ids as ``KEY_BYTES`` allows (their number is in the manifest) are broadcast,
    so that rows stay where they are read.
    """
    plain, held, gone = [], {}, {}
    deleted = sum(p.ids for own in parts.values() for p in own)
    for own in parts.values():
        last = max((p.number for p in own if p.kind == "deletes"), default=-1)
        for p in own:
            if p.kind == "deletes":
                gone.setdefault(p.number, []).append(p.path)
            elif p.number >= last:
                plain.append(p.path)
            else:
                held.setdefault(p.number, []).append(p.path)
    rows = spark.read.schema(INDEX_SCHEMA)
    out = [rows.parquet(*plain)] if plain else []
    if held:
        older = [rows.parquet(*paths).withColumn("_added", F.lit(n)) for n, paths in sorted(held.items())]
        ids = [spark.read.schema("doc_id string").parquet(*paths).withColumn("_deleted", F.lit(n)) for n, paths in sorted(gone.items())]
        a, d = reduce(DataFrame.unionByName, older).alias("a"), reduce(DataFrame.unionByName, ids).alias("d")
        d = F.broadcast(d) if 64 * deleted <= session.KEY_BYTES else d
        out.append(a.join(d, F.expr("a.doc_id = d.doc_id and a._added < d._deleted"), "left_anti").drop("_added"))
    if not out:
        return _empty_index(spark)
    return reduce(DataFrame.unionByName, out).withColumn("bucket", bucket_of("doc_id", buckets))


def read_index(spark: SparkSession, base: str) -> DataFrame:
    """The current version of the index (schema given, so no inference over many files)."""
    m = current_manifest(spark, base)
    return _living(spark, m.parts, m.buckets) if m else _empty_index(spark)


def _touched(doc_ids: DataFrame, buckets: int) -> list[int]:
    """Buckets of these documents, ascending (as many numbers as there are buckets reach the driver)."""
    return sorted(r.b for r in doc_ids.select(bucket_of("doc_id", buckets).alias("b")).distinct().collect())


def read_buckets(spark: SparkSession, base: str, doc_ids: DataFrame) -> DataFrame:
    """Stored rows of the buckets that hold ``doc_ids``."""
    m = current_manifest(spark, base)
    if m is None:
        return _empty_index(spark)
    return _living(spark, {b: m.parts[b] for b in _touched(doc_ids, m.buckets) if b in m.parts}, m.buckets)


def _bucket_dirs(spark: SparkSession, path: str) -> dict[int, str]:
    """``bucket=<b>`` sub-directories of what was just written (Hadoop FS listing)."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return {}
    dirs = [st.getPath() for st in fs.listStatus(p) if st.isDirectory() and st.getPath().getName().startswith("bucket=")]
    return {int(d.getName().split("=", 1)[1]): d.toString() for d in dirs}


class Staged(NamedTuple):
    """Rows that lie under the index's directory already; no manifest names them yet."""

    buckets: int
    dirs: dict[int, str]

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(INDEX_SCHEMA).parquet(*self.dirs.values()) if self.dirs else _empty_index(spark).drop("bucket")


def _files(df: DataFrame):
    return df.write.mode("errorifexists").option("maxRecordsPerFile", MAX_FILE_ROWS).option("compression", "zstd").partitionBy("bucket")


def dealt_by_bucket(docs: DataFrame, buckets: int, files_per_bucket: int = 1) -> DataFrame:
    """Documents dealt out as their rows will be written, for rows that are then made in place."""
    return docs.repartition(bucket_of("doc_id", buckets), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(files_per_bucket)))


def buckets_of(spark: SparkSession, base: str, buckets: int = DEFAULT_BUCKETS) -> int:
    """Buckets of the index; of one that is still to be made, as many as asked for."""
    m = current_manifest(spark, base)
    return m.buckets if m else buckets


def stage_rows(rows: DataFrame, base: str, buckets: int, files_per_bucket: int = 1, dealt: bool = False) -> Staged:
    """Write rows under a new version's directory, once. ``dealt``: they are dealt by bucket already."""
    out = conform(rows.drop("bucket")).withColumn("bucket", bucket_of("doc_id", buckets))
    if not dealt:  # tasks get their rows by bucket and key; a large file is closed and another begun
        out = out.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(files_per_bucket)))
    target = os.path.join(base, _new_version(), "rows")
    _files(out).parquet(target)
    dirs = _bucket_dirs(rows.sparkSession, target)
    if not dirs:  # nothing to keep
        p, fs = _fs(rows.sparkSession, os.path.dirname(target))
        fs.delete(p, True)
    return Staged(buckets, dirs)


def _write_deletes(ids: DataFrame, base: str, m: Manifest, touched: list[int]) -> tuple[dict[int, tuple[str, int]], set[int]]:
    """Write those of the ids that have rows in the touched buckets.

    Returns where each bucket's ids are and how many, and the buckets that lose
    every document: these need no deletes, their parts go.
    """
    spark = ids.sparkSession
    old = {b: m.parts[b] for b in touched if b in m.parts}
    if not old:
        return {}, set()
    stored = _living(spark, old, m.buckets).select("doc_id", "bucket").distinct()
    named = ids.select("doc_id").distinct().withColumn("hit", F.lit(True))
    marked = materialize(stored.join(named, "doc_id", "left"), "stored-ids")
    counts = {r.bucket: r for r in marked.groupBy("bucket").agg(F.count("*").alias("alive"), F.count("hit").alias("lost")).collect()}
    lost = {b: r.lost for b, r in counts.items() if r.lost}
    emptied = {b for b in old if b not in counts or counts[b].lost == counts[b].alive}
    if set(lost) <= emptied:
        return {}, emptied
    target = os.path.join(base, _new_version(), "deletes")
    gone = marked.where(F.col("hit") & ~F.col("bucket").isin(sorted(emptied))).select("doc_id", "bucket")
    _files(gone.repartition("bucket")).parquet(target)
    return {b: (d, lost[b]) for b, d in _bucket_dirs(spark, target).items()}, emptied


def _commit(spark: SparkSession, base: str, number: int, buckets: int, parts: dict[int, list[Part]]) -> bool:
    """Publish manifest ``number`` whole if nobody has that number: False if another writer was first."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path, fs = _fs(spark, os.path.join(_manifest_dir(base), _name(number)))
    text = _format(buckets, {b: p for b, p in parts.items() if p})
    fs.mkdirs(path.getParent())
    temp = jvm.org.apache.hadoop.fs.Path(path.getParent(), f".new-{uuid.uuid4().hex}")
    _write_text(fs, temp, text)
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    none[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(temp), fs.makeQualified(path), none)
    except Exception as e:  # noqa: BLE001 the JVM's exception type differs by file system
        fs.delete(temp, False)
        if fs.exists(path):
            return False
        raise e
    return True


def _next(spark: SparkSession, base: str) -> int:
    return (_numbers(spark, base) or [0])[-1] + 1


def write_index(index: DataFrame, base: str, buckets: int = DEFAULT_BUCKETS, files_per_bucket: int = 1) -> str:
    """Write ``index`` as a complete new version (every bucket); returns its manifest's name.

    ``files_per_bucket`` (a hash salt of the key) spreads a bucket over so many
    write tasks.
    """
    spark = index.sparkSession
    dirs = stage_rows(index, base, buckets, files_per_bucket).dirs
    while True:
        number = _next(spark, base)
        if _commit(spark, base, number, buckets, {b: [Part("rows", number, d)] for b, d in dirs.items()}):
            return _name(number)


def apply_doc_changes(spark: SparkSession, base: str, new_rows: DataFrame | Staged, drop_doc_ids: DataFrame,
                      buckets: int = DEFAULT_BUCKETS, files_per_bucket: int = 1) -> str:
    """Replace / remove whole documents; what else their buckets hold is not written again.

    ``new_rows`` are complete index rows of the documents to (re)write;
    ``drop_doc_ids`` (``doc_id``) are documents whose stored rows go away.
    Stored rows of both sets are dropped, ``new_rows`` are added. A writer that
    comes second adds its parts to the first one's manifest; only its deletes
    are looked up again, where the first has changed the same buckets.
    ``new_rows`` may be ``Staged``; a table is staged first, so it is read once.
    """
    staged = new_rows if isinstance(new_rows, Staged) else None
    seen, touched, ids = None, None, drop_doc_ids
    gone: dict[int, tuple[str, int]] = {}
    emptied: set[int] = set()
    while True:
        number, m = _next(spark, base), current_manifest(spark, base)
        m = m or Manifest(0, staged.buckets if staged else buckets, {})
        if staged is None or staged.buckets != m.buckets:  # (an index of other buckets was made meanwhile)
            staged, touched = stage_rows(staged.read(spark) if staged else new_rows, base, m.buckets, files_per_bucket), None
        dirs = staged.dirs
        if touched is None:
            ids = staged.read(spark).select("doc_id").unionByName(drop_doc_ids.select("doc_id")).distinct()
            touched, seen = sorted(set(dirs) | set(_touched(drop_doc_ids, m.buckets))), None
        if not touched and m.number:
            return _name(m.number)
        now = {b: m.parts.get(b, []) for b in touched}
        if seen != now:
            seen, (gone, emptied) = now, _write_deletes(ids, base, m, touched)
        parts = dict(m.parts)
        for b in touched:
            parts[b] = ([] if b in emptied else list(parts.get(b, []))) + ([Part("deletes", number, *gone[b])] if b in gone else []) + ([Part("rows", number, dirs[b])] if b in dirs else [])
        if _commit(spark, base, number, m.buckets, parts):
            return _name(number)


def compact_index(spark: SparkSession, base: str, min_parts: int = 2, files_per_bucket: int = 1) -> list[int]:
    """Rewrite every bucket of at least ``min_parts`` parts as one part; returns those buckets.

    Parts that other writers add meanwhile stay behind the new one.
    """
    m = current_manifest(spark, base)
    todo = {b: p for b, p in m.parts.items() if len(p) >= max(2, min_parts)} if m else {}
    if not todo:
        return []
    dirs = stage_rows(_living(spark, todo, m.buckets), base, m.buckets, files_per_bucket).dirs
    while True:
        number, now = _next(spark, base), current_manifest(spark, base)
        # the rows are those of manifest m, so whatever came later applies to them
        done = [b for b, p in todo.items() if now.parts.get(b, [])[: len(p)] == p]
        new = {b: ([Part("rows", m.number, dirs[b])] if b in dirs else []) + now.parts[b][len(todo[b]) :] for b in done}
        if not done or _commit(spark, base, number, m.buckets, now.parts | new):
            return sorted(done)


def vacuum_index(spark: SparkSession, base: str, keep_versions: int = 1, orphan_hours: float = 168.0) -> list[str]:
    """Delete old manifests and what only they name; returns the deleted paths.

    The newest ``keep_versions`` whole manifests stay. Directories that no
    manifest names (a writer that died, or came second) and unfinished
    manifests go once they are ``orphan_hours`` old, so a write in progress
    must not take longer. Readers that still hold an older manifest lose its
    files, so run it when no reader needs a version older than the ones kept.
    """
    if keep_versions < 1:
        raise ValueError("keep_versions must be >= 1")
    mdir, fs = _fs(spark, _manifest_dir(base))
    if not fs.exists(mdir):
        return []
    oldest = (time.time() - 3600 * orphan_hours) * 1000
    whole = {n: m for n in _numbers(spark, base) if (m := _parse(_read_text(spark, os.path.join(_manifest_dir(base), _name(n))), n))}
    kept = sorted(whole)[-keep_versions:]

    def named(numbers) -> set[str]:
        return {p.path.rstrip("/") for n in numbers for own in whole[n].parts.values() for p in own}

    live, dead, deleted = named(kept), named(set(whole) - set(kept)), []

    def drop(path, recursive: bool):
        if fs.delete(path, recursive):
            deleted.append(path.toString())

    for st in fs.listStatus(mdir):
        name = st.getPath().getName()
        number = int(name[2:]) if name.startswith("v-") else None
        if (number in whole and number not in kept) or (number not in whole and st.getModificationTime() < oldest):
            drop(st.getPath(), False)
    for d in sorted(dead - live):
        drop(_fs(spark, d)[0], True)
    for st in fs.listStatus(_fs(spark, base)[0]):
        path, name = st.getPath(), st.getPath().getName()
        if not (st.isDirectory() and name.startswith("v-")):
            continue
        uses = lambda paths: any(x.startswith(path.toString().rstrip("/") + "/") for x in paths)  # noqa: B023, E731
        if not uses(live) and (uses(dead) or int(name.split("-")[1]) < oldest):
            drop(path, True)
    return deleted
