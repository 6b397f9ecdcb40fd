"""Tag catalog: reading, validation rules, keyword lists, re-tagging, and
mapping text to tags by keywords."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.session import materialize, spread

# The shipped tag catalog (name, label, keywords, description).
DEFAULT_CATALOG = {
    "life": ("生活", ["生活", "旅游", "美食", "购物", "健康", "日常", "家"], "生活日常、旅游攻略、个人笔记"),
    "ops": ("运维", ["运维", "故障", "排查", "RCA", "报警", "监控", "incident", "oncall"], "运维手册、故障排查、RCA 报告"),
    "财经": ("财经", ["股票", "基金", "投资", "理财", "财报", "ETF", "期货", "债券", "财经"], "股票、基金等财经相关"),
    "编程": ("编程", ["编程", "代码", "Python", "Java", "Go", "TypeScript", "前端", "后端", "API", "框架", "开发"], "编程开发相关"),
    "AI": ("AI", ["AI", "人工智能", "大模型", "LLM", "机器学习", "深度学习", "Bedrock", "GPT", "Claude", "embedding", "RAG",
                  "Agent"], "AI、大模型相关"),
    "mm": ("迁移和现代化", ["迁移", "现代化", "Migration", "Modernization", "上云", "重构", "容器化", "EKS", "微服务", "云原生"],
           "迁移和应用现代化相关"),
}
# A tag name starts with a word character or CJK ideograph
# (U+4E00-U+9FFF, U+3400-U+4DBF), then those or '-'. Word character = letter,
# digit or underscore (Unicode).
_NAME_CHARS = r"\p{L}\p{N}_\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}"
TAG_NAME_PATTERN = rf"^[{_NAME_CHARS}][{_NAME_CHARS}-]*$"
MIN_KEYWORDS = 2

CATALOG_SCHEMA = "name string, label string, keywords array<string>, description string"


def catalog_df(spark: SparkSession, catalog: dict | None = None) -> DataFrame:
    """Catalog rows sorted by name."""
    cat = DEFAULT_CATALOG if catalog is None else catalog
    rows = [(n, lab, list(kw), desc) for n, (lab, kw, desc) in cat.items()]
    return spark.createDataFrame(rows, CATALOG_SCHEMA).orderBy("name")


def name_valid(name) -> F.Column:
    """F12."""
    c = F.col(name) if isinstance(name, str) else name
    return c.rlike(TAG_NAME_PATTERN)


def rule_violations(catalog: DataFrame) -> DataFrame:
    """``name, rule, value`` for duplicate names, fewer than two
    keywords, and invalid names."""
    dup = catalog.groupBy("name").agg(F.count("*").alias("value")).where(F.col("value") > 1) \
        .select("name", F.lit("duplicate").alias("rule"), "value")
    few = catalog.where(F.coalesce(F.size("keywords"), F.lit(0)) < MIN_KEYWORDS) \
        .select("name", F.lit("too_few_keywords").alias("rule"), F.coalesce(F.size("keywords"), F.lit(0)).alias("value"))
    bad = catalog.where(~name_valid("name")).select("name", F.lit("invalid_name").alias("rule"), F.lit(1).alias("value"))
    return dup.unionByName(few).unionByName(bad.dropDuplicates(["name"]))


def update_keywords(catalog: DataFrame, updates: DataFrame) -> DataFrame:
    """P20: ``updates(name, add_keywords, keywords)`` -- ``keywords`` (replace)
    wins over ``add_keywords`` (ordered de-duplicated union)."""
    u = updates.select("name", F.col("add_keywords").alias("_add"), F.col("keywords").alias("_rep"))
    j = catalog.join(u, "name", "left")
    merged = F.when(F.col("_add").isNotNull(), tx.keyword_merge("keywords", "_add")).otherwise(F.col("keywords"))
    kw = F.when(F.col("_rep").isNotNull(), F.col("_rep")).otherwise(merged)
    return j.select("name", "label", kw.alias("keywords"), "description")


def reclassify(index: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every chunk of a moved document gets ``tags = new_tag``.

    ``moves(doc_id, new_tag)`` may hold many documents. Returns ``(index,
    missing)`` where ``missing`` lists moves whose document has no chunk
    (the reference's error case).
    """
    # a document moved twice gets the smallest of its new tags
    m = moves.groupBy("doc_id").agg(F.min("new_tag").alias("_new"))
    out = index.join(m, "doc_id", "left").withColumn("tags", F.coalesce(F.col("_new"), F.col("tags"))).drop("_new")
    missing = m.join(index.select("doc_id"), "doc_id", "left_anti").withColumnRenamed("_new", "new_tag")
    return out.select(*index.columns), missing


def keyword_hits(docs: DataFrame, catalog: dict | None = None, text: str = "text", id_col: str = "doc_id",
                 parallelism: int | None = None) -> DataFrame:
    """``doc_id, tag, hits`` -- number of a tag's keywords contained
    (case-insensitive) in the text, for hits > 0.

    The catalog is compiled into one column expression: no join, no shuffle.
    ``parallelism`` deals the texts over so many tasks, for tables of fewer
    splits than cores. ``keyword_matches`` takes catalogs of any size.
    """
    cat = DEFAULT_CATALOG if catalog is None else catalog
    pairs = sorted({(name, kw.lower()) for name, (_, kws, _) in cat.items() for kw in kws if kw})
    words = {t: F.array(*[F.lit(kw) for n, kw in pairs if n == t]) for t in sorted({n for n, _ in pairs})}
    if not words:
        return docs.select(F.col(id_col), F.lit("").alias("tag"), F.lit(0).alias("hits")).where("false")
    low = spread(docs.select(id_col, text), parallelism).select(F.col(id_col), F.lower(F.col(text)).alias("_low"))  # lower once per document
    per_tag = [F.struct(F.lit(t).alias("tag"), F.size(F.filter(kws, lambda k: F.contains(F.col("_low"), k))).alias("hits")) for t, kws in words.items()]
    return low.select(id_col, F.explode(F.array(*per_tag)).alias("h")).select(id_col, "h.tag", "h.hits").where("hits > 0")


SLICE_BYTES = 2 << 20
"""Bytes of keywords that are searched at a time (the automaton takes some fifty times as much)."""
RUN = "[0-9a-z\\u00df-\\u00f6\\u00f8-\\u024f\\u0370-\\u052f]"
"""Digits and Latin, Greek and Cyrillic letters: a keyword of these alone stands in a text where it stands in one of the text's runs of them."""
RUN_MOST = 64
"""Characters of a keyword that is looked up in runs."""
RUN_CUT = 256
"""Characters of a run; a longer one is cut into pieces that overlap."""


def keyword_matches(docs: DataFrame, catalog: DataFrame, text: str = "text", id_col: str = "doc_id", parallelism: int | None = None,
                    slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """J11 by a catalog table (``name``, ``keywords``): as ``keyword_hits``, for any number of keywords.

    Texts are read and lower-cased once, into blocks (one Arrow batch each)
    that know the runs of letters and digits in each text. Keywords that are
    such runs themselves are joined with the parts of the distinct runs, and a
    block is told which keywords its runs hold: the work grows with the texts
    and with the distinct runs, not with texts times keywords. Other keywords
    (phrases, ideographs, very long ones) are cut into slices of bounded
    bytes; a slice becomes an automaton that finds all its keywords in one
    pass over a text. Every row counts for itself. Lower-casing is Spark's on
    both sides. Keywords that are null or empty match nothing.
    """
    kind = dict(docs.dtypes)[id_col]
    words = catalog.select(F.col("name").alias("tag"), F.explode("keywords").alias("kw")).select("tag", F.lower("kw").alias("kw")).where("kw <> ''").distinct()
    in_run = F.col("kw").rlike(rf"\A{RUN}{{1,{RUN_MOST}}}\z")
    words = materialize(words.select("*", F.monotonically_increasing_id().alias("word"), in_run.alias("in_run")), "keywords")
    rest = words.where(~F.col("in_run")).agg(F.sum(F.octet_length("kw"))).first()[0] or 0
    low = spread(docs.select(id_col, text), parallelism).select(id_col, F.lower(F.col(text)).alias("low"))
    blocks = materialize(low.mapInArrow(_run_blocks(rest > 0), "block long, runs array<string>, payload binary"), "blocks")
    found = [_run_hits(blocks, words.where("in_run"), id_col, kind)]
    slices = -(-rest // slice_bytes)
    words = words.where(~F.col("in_run")).withColumn("slice", F.pmod(F.xxhash64("kw"), F.lit(max(1, slices))).cast("int"))
    found += [_slice_hits(blocks, words.where(F.col("slice") == n), id_col, kind) for n in range(slices)]
    if slices:
        found = [reduce(DataFrame.unionByName, found).groupBy("block", "row", id_col, "tag").agg(F.sum("hits").cast("int").alias("hits"))]
    return found[0].select(id_col, "tag", "hits")


def _run_blocks(keep_text: bool):
    """Batches of (id, text) as blocks: their distinct runs, and a payload of each row's id, runs by number, and text if it is kept."""

    def run(batches):
        from pyspark import TaskContext

        part, find = TaskContext.get().partitionId(), re.compile(RUN + "+").findall
        for n, b in enumerate(batches):
            number: dict[str, int] = {}
            own = [list({number.setdefault(w, len(number)) for r in set(find(t)) for w in _cut_run(r)}) if t else [] for t in b.column(1).to_pylist()]
            cols = {"id": b.column(0), "runs": pa.array(own, pa.list_(pa.int32()))} | ({"text": b.column(1)} if keep_text else {})
            yield pa.RecordBatch.from_arrays([pa.array([part << 32 | n]), pa.array([list(number)], pa.list_(pa.string())), pa.array([_packed(pa.table(cols))], pa.binary())],
                                             names=["block", "runs", "payload"])

    return run


def _cut_run(run: str) -> list[str]:
    """A long run as pieces of which each keyword inside lies in one."""
    return [run] if len(run) <= RUN_CUT else [run[i : i + RUN_CUT] for i in range(0, len(run), RUN_CUT - RUN_MOST + 1)]


def _packed(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def _hit_columns(id_col: str, kind: str) -> str:
    return f"block long, row int, {id_col} {kind}, tag string, hits int"


def _run_hits(blocks: DataFrame, words: DataFrame, id_col: str, kind: str) -> DataFrame:
    """Hits of the keywords that are runs, row by row."""
    lengths = [r.n for r in words.select(F.length("kw").alias("n")).distinct().orderBy("n").collect()]  # RUN_MOST at most

    def parts(batches):
        for b in batches:
            runs, kws = [], []
            for w in b.column(0).to_pylist():
                for part in {w[i : i + n] for n in lengths for i in range(len(w) - n + 1)}:
                    runs.append(w)
                    kws.append(part)
                if len(kws) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(runs, pa.string()), pa.array(kws, pa.string())], names=["run", "kw"])
                    runs, kws = [], []
            yield pa.RecordBatch.from_arrays([pa.array(runs, pa.string()), pa.array(kws, pa.string())], names=["run", "kw"])

    def count(block: pa.Table, told: pa.Table) -> pa.Table:
        t = pa.ipc.open_stream(block.column("payload")[0].as_py()).read_all()
        if not told.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "row": pa.array([], pa.int32()), id_col: t.column("id").slice(0, 0), "tag": pa.array([], pa.string()), "hits": pa.array([], pa.int32())})
        number = {w: i for i, w in enumerate(block.column("runs")[0].as_py())}
        inside, word, tag = told.column("inside").combine_chunks(), told.column("inside").combine_chunks().flatten().field("word"), told.column("inside").combine_chunks().flatten().field("tag")
        first = np.zeros(len(number), np.int64)
        many = np.zeros(len(number), np.int64)
        at = np.array([number[w] for w in told.column("run").to_pylist()])
        many[at] = inside.value_lengths().to_numpy(zero_copy_only=False)
        first[at] = inside.offsets.to_numpy()[:-1] - inside.offsets[0].as_py()
        runs = t.column("runs").combine_chunks()
        row = np.repeat(np.arange(t.num_rows), runs.value_lengths().to_numpy(zero_copy_only=False))
        run = runs.flatten().to_numpy()
        n = many[run]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[run], n)
        words_, own = np.unique(word.to_numpy(), return_inverse=True)
        pair = np.unique(np.repeat(row, n) * len(words_) + own[place])  # a keyword counts once in a row
        tags = tag.dictionary_encode()
        tag_of = np.zeros(len(words_), np.int64)
        tag_of[own] = tags.indices.fill_null(len(tags.dictionary)).to_numpy()
        wide = len(tags.dictionary) + 1  # the last: no tag
        hit, hits = np.unique(pair // len(words_) * wide + tag_of[pair % len(words_)], return_counts=True)
        row, code = hit // wide, hit % wide
        return pa.table({"block": pa.array(np.full(len(hit), block.column("block")[0].as_py())), "row": pa.array(row.astype(np.int32)),
                         id_col: t.column("id").take(pa.array(row)), "tag": tags.dictionary.take(pa.array(code, mask=code == wide - 1)), "hits": pa.array(hits.astype(np.int32))})

    of = blocks.select(F.col("block").alias("at"), F.explode("runs").alias("run"))
    inside = of.select("run").distinct().mapInArrow(parts, "run string, kw string").join(words.select("kw", "tag", "word"), "kw")
    inside = inside.groupBy("run").agg(F.collect_list(F.struct("word", "tag")).alias("inside"))
    told = of.join(inside, "run").groupBy("at")
    return blocks.groupBy("block").cogroup(told).applyInArrow(count, _hit_columns(id_col, kind))


def _slice_hits(blocks: DataFrame, words: DataFrame, id_col: str, kind: str) -> DataFrame:
    """Hits of a slice of keywords, row by row."""
    tags: dict[str, list[str]] = {}
    for r in words.select("kw", "tag").collect():  # a slice's bytes are bounded
        tags.setdefault(r.kw, []).append(r.tag)
    told = blocks.sparkSession.sparkContext.broadcast(tags)

    def run(batches):
        import ahocorasick

        a = ahocorasick.Automaton()
        for w in told.value:
            a.add_word(w, w)
        if told.value:
            a.make_automaton()
        for b in batches:
            for block, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                t = pa.ipc.open_stream(payload).read_all()
                rows, out_tag, hits = [], [], []
                for i, text in enumerate(t.column("text").to_pylist()):
                    found = {w for _, w in a.iter(text)} if text and told.value else ()
                    own = Counter(tag for w in found for tag in told.value[w])
                    rows += [i] * len(own)
                    out_tag += own.keys()
                    hits += own.values()
                ids = t.column("id").take(pa.array(rows, pa.int64())).combine_chunks()
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array(rows, pa.int32()), ids, pa.array(out_tag, pa.string()), pa.array(hits, pa.int32())],
                                                 names=["block", "row", id_col, "tag", "hits"])

    return blocks.select("block", "payload").mapInArrow(run, _hit_columns(id_col, kind))


def best_tag(hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Most keyword hits per document, ties by tag name (partial aggregate)."""
    return hits.groupBy(id_col).agg(
        F.min_by("tag", F.struct((-F.col("hits")).alias("h"), F.col("tag"))).alias("best_tag"),
        F.max("hits").alias("hits"),
    )
