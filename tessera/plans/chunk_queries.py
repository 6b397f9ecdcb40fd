"""Chunking queries over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import chunking as ch
from tessera.plans.fixtures import MARKDOWN_SQL, markdown_corpus, plain_corpus
from tessera.plans.registry import register
from tessera.sources.tables import read_table

_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_LINES = """
ln as (select doc_id, unnest(string_split(text, chr(10))) as line,
              unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) as pos from md),
lv as (select doc_id, pos, line,
              case when length(regexp_extract(line, '^(#{1,6})\\s+(.+)', 1)) > 0
                   then length(regexp_extract(line, '^(#{1,6})\\s+(.+)', 1)) end as level,
              case when length(regexp_extract(line, '^(#{1,6})\\s+(.+)', 1)) > 0
                   then regexp_replace(regexp_extract(line, '^(#{1,6})\\s+(.+)', 2), '^\\s+|\\s+$', '', 'g') end as heading
       from ln)
"""


def _paths_sql() -> str:
    win = "over (partition by doc_id order by pos rows between unbounded preceding and current row)"
    cols = ", ".join(
        f"last_value(case when level = {k} then heading end ignore nulls) {win} as h{k}, "
        f"max(case when level = {k} then pos end) {win} as p{k}"
        for k in range(1, 7)
    )
    parts = []
    for k in range(1, 7):
        cond = [f"p{k} is not null"] + [f"(p{j} is null or p{k} > p{j})" for j in range(1, k)]
        parts.append(f"case when {' and '.join(cond)} then h{k} end")
    return f"""
w as (select doc_id, pos, line, level, {cols} from lv),
hp as (select doc_id, pos, line, level, concat_ws(' > ', {', '.join(parts)}) as heading_path from w)
"""


HEADING_PATHS_SQL = f"""
with md as ({MARKDOWN_SQL}), {_LINES}, {_paths_sql()}
select doc_id, pos, level, heading_path from hp
"""


@register("heading_paths", HEADING_PATHS_SQL)
def q_heading_paths(spark, sf_dir):
    """Heading path of every line of every Markdown document."""
    return ch.heading_paths(markdown_corpus(spark, sf_dir)).select("doc_id", "pos", "level", "heading_path")


SECTIONS_SQL = f"""
with md as ({MARKDOWN_SQL}), {_LINES}, {_paths_sql()},
s as (select *, sum(case when level is not null then 1 else 0 end)
                over (partition by doc_id order by pos rows between unbounded preceding and current row) as section_no from hp)
select doc_id, section_no, arg_min(heading_path, pos) as heading_path,
       {_STRIP.format(x="string_agg(line, chr(10) order by pos)")} as content
from s group by doc_id, section_no
"""


@register("sections", SECTIONS_SQL)
def q_sections(spark, sf_dir):
    """Sections of every Markdown document (heading path + stripped content)."""
    return ch.sections(markdown_corpus(spark, sf_dir))


@register(
    "chunk_strategy",
    f"""
with md as ({MARKDOWN_SQL}),
pl as (select cast(doc_id as varchar) as doc_id, text,
              case when doc_id % 3 = 0 then 'md' when doc_id % 3 = 1 then 'txt' else 'html' end as file_type from documents),
u as (select doc_id, 'plain' as variant, text, file_type from pl
      union all select doc_id, 'markdown' as variant, text, 'txt' as file_type from md),
n as (select *, len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^(#{{1,6}})\\s+(.+)'))) as n_headings from u)
select doc_id, variant, file_type, n_headings,
       case when file_type in ('md', 'markdown') or n_headings >= 3 then 'heading' else 'recursive' end as strategy
from n
""",
)
def q_chunk_strategy(spark, sf_dir):
    """Auto strategy for plain documents (type by id) and their Markdown form typed as txt."""
    pl = plain_corpus(spark, sf_dir).select("doc_id", F.lit("plain").alias("variant"), "text", "file_type")
    mdc = markdown_corpus(spark, sf_dir, file_type="txt").select("doc_id", F.lit("markdown").alias("variant"), "text", "file_type")
    return _strategies(pl, "plain").unionByName(_strategies(mdc, "markdown"))


def _strategies(docs, variant):
    types = docs.select("doc_id", "file_type")
    return ch.strategies(docs).join(types, "doc_id").withColumn("variant", F.lit(variant))


def _pieces_sql(size: int = 512) -> str:
    """All levels of C2: whole texts are cut once, then pieces over ``size`` tokens by the next separator."""
    levels = [f"l0 as (select cast(doc_id as varchar) as doc_id, cast([] as integer[]) as ord, text as piece, true as open from documents where regexp_matches(text, '\\S'))"]
    seps = ("chr(10) || chr(10)", "chr(10)", "'. '", "'。'", "' '")
    for k, sep in enumerate(seps):
        levels.append(
            f"s{k} as (select doc_id, ord, open and regexp_matches(piece, '\\S') and strpos(piece, {sep}) > 0 as cut, open, piece, "
            f"string_split(piece, {sep}) as parts from l{k} where not open or regexp_matches(piece, '\\S')), "
            f"x{k} as (select doc_id, ord, len(parts) as n, unnest(parts) as part, unnest(generate_series(1, len(parts))) as i from s{k} where cut), "
            f"y{k} as (select doc_id, list_append(ord, cast(i as integer)) as ord, case when i < n then part || {sep} else part end as piece from x{k}), "
            f"l{k + 1} as (select doc_id, ord, piece, greatest(1, length(piece) // 4) > {size} as open from y{k} "
            f"union all select doc_id, ord, piece, open from s{k} where not cut)"
        )
    k = len(seps)
    levels.append(
        f"c as (select doc_id, list_append(ord, cast(i as integer)) as ord, substr(piece, cast(i as integer), {4 * size}) as piece "
        f"from (select doc_id, ord, piece, unnest(generate_series(1, length(piece), {4 * size})) as i from l{k} where open and regexp_matches(piece, '\\S'))"
        f" union all select doc_id, ord, piece from l{k} where not open)"
    )
    return f"with {', '.join(levels)} select doc_id, cast(row_number() over (partition by doc_id order by ord) - 1 as integer) as piece_no, piece from c"


@register("split_pieces", _pieces_sql())
def q_split_pieces(spark, sf_dir):
    """Pieces at all levels; separators stay on the left piece."""
    return ch.split_pieces(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("chunk_recursive")
def q_chunk_recursive(spark, sf_dir):
    """Recursive chunking (512 tokens, 64 overlap, min 100) of every document."""
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    c = ch.chunk_docs(d, strategy="recursive")
    return c.select("doc_id", "chunk_index", "total_chunks", "tokens", F.md5("content").alias("content_md5"))


@register("chunk_heading")
def q_chunk_heading(spark, sf_dir):
    """Heading-aware chunking of the Markdown form of every document."""
    c = ch.chunk_docs(markdown_corpus(spark, sf_dir), strategy="heading")
    return c.select("doc_id", "chunk_index", "total_chunks", "heading_path", "tokens", F.md5("content").alias("content_md5"))


@register("ingest_plan")
def q_ingest_plan(spark, sf_dir):
    """Dry run -- per document chunk count and token sum with auto strategy."""
    c = ch.chunk_docs(plain_corpus(spark, sf_dir), strategy="auto")
    return c.groupBy("doc_id", "strategy").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"))


@register(
    "chunk_coverage",
    """
with w as (select distinct cast(doc_id as varchar) as doc_id, unnest(regexp_split_to_array(text, '\\s+')) as word from documents where regexp_matches(text, '\\S'))
select doc_id, count(*) as words, 0 as missing, 0 as foreign_words, true as dense from w where word <> '' group by doc_id
""",
)
def q_chunk_coverage(spark, sf_dir):
    """C3/C4/C8 invariants of the recursive chunks of every document: its words all come through, no others
    appear, and their numbers are dense."""
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    c = ch.chunk_docs(d, strategy="recursive")
    words = lambda text: F.filter(F.array_distinct(F.split(text, r"\s+")), lambda x: x != "")
    own = d.where(F.col("text").isNotNull()).groupBy("doc_id").agg(F.collect_list(words("text")).alias("own"))
    n = F.count("*")
    cut = c.select("doc_id", "chunk_index", "total_chunks", words("content").alias("word")).groupBy("doc_id").agg(
        F.array_distinct(F.flatten(F.collect_list("word"))).alias("cut"),
        ((n == F.max("total_chunks")) & (F.size(F.collect_set("chunk_index")) == n) & (F.max("chunk_index") == n - 1)).alias("dense"))
    both = own.join(cut, "doc_id")
    total = lambda sizes: F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)
    missing = total(F.transform("own", lambda x: F.size(F.array_except(x, "cut"))))
    foreign = F.size(F.array_except("cut", F.flatten("own"))).cast("long")
    return both.select("doc_id", total(F.transform("own", lambda x: F.size(x))).alias("words"), missing.alias("missing"), foreign.alias("foreign_words"), "dense").where(
        (F.col("words") > 0) | (F.col("foreign_words") > 0))


def _shape(chunks, texts, size, least, overlap):
    """Per document: whether its chunks are sized, start with the last words of the chunk before, and stand in its text."""
    from pyspark.sql import Window

    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    c = chunks.withColumn("prev", F.lag("content").over(w))
    head = F.when(F.col("prev").isNotNull(), F.substring_index("content", "\n", 1))
    words = F.split(head, " ")
    cost = F.aggregate(F.transform(words, lambda x: F.greatest(F.lit(1), F.floor(F.length(x) / 4)).cast("int")), F.lit(0), lambda a, x: a + x)
    before = F.split(flat(F.col("prev")), " ")
    n = F.size(words)
    one_more = F.greatest(F.lit(1), F.floor(F.length(F.get(before, F.size(before) - n - 1)) / 4)).cast("int")
    follows = (F.array_join(F.slice(before, F.greatest(F.size(before) - n + 1, F.lit(1)), n), " ") == head) & (cost <= overlap) & (
        (F.size(before) <= n) | (cost + one_more > overlap))
    body = F.when(F.col("prev").isNotNull(), F.expr("substring(content, length(substring_index(content, '\n', 1)) + 2)")).otherwise(F.col("content"))
    c = c.select("doc_id", (F.col("tokens") <= size + least).alias("sized"), F.coalesce(follows, F.lit(True)).alias("follows"), F.left(body, F.lit(60)).alias("start"),
                 ((F.col("tokens") >= least) | (F.col("total_chunks") == 1)).alias("enough"))
    held = c.join(texts.select("doc_id", "text"), "doc_id").select("doc_id", "sized", "follows", "enough", F.contains(F.col("text"), F.col("start")).alias("found"))
    return held.groupBy("doc_id").agg(F.min("sized").alias("sized"), F.min("enough").alias("enough"), F.min("follows").alias("follows"), F.min("found").alias("found"))


@register(
    "chunk_shape",
    """select cast(doc_id as varchar) as doc_id, true as sized, true as enough, true as follows, true as found from documents where regexp_matches(text, '\\S')""",
)
def q_chunk_shape(spark, sf_dir):
    """C3/C4 invariants per document: sizes within size and minimum, each chunk begins with as many of the last
    words of the one before as the overlap allows, and goes on with a place of the text."""
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return _shape(ch.chunk_docs(d, strategy="recursive"), d, 512, 100, 64)


@register(
    "chunk_heading_shape",
    f"""
with md as ({MARKDOWN_SQL}), {_LINES}, {_paths_sql()},
p as (select distinct doc_id, heading_path from hp where heading_path <> '')
select doc_id, count(*) as paths, true as led, true as sized, true as dense from p group by doc_id
""",
)
def q_chunk_heading_shape(spark, sf_dir):
    """C7 invariants per Markdown document: every heading path that opens a chunk is one of its own (counted: those
    that stand in any chunk), the path stands before the content, and sizes and numbers are right."""
    docs = markdown_corpus(spark, sf_dir)
    c = ch.chunk_docs(docs, strategy="heading")
    path = F.col("heading_path")
    led = F.when(path == "", F.lit(True)).otherwise(F.startswith("content", F.concat(path, F.lit("\n\n"))) | (F.col("content") == path))
    shape = c.groupBy("doc_id").agg(
        F.min(led).alias("led"), F.min(F.col("tokens") <= 512 + 100 + F.length(path) / 4).alias("sized"),
        ((F.count("*") == F.max("total_chunks")) & (F.countDistinct("chunk_index") == F.count("*")) & (F.max("chunk_index") == F.count("*") - 1)).alias("dense"))
    own = ch.heading_paths(docs).where("heading_path <> ''").select("doc_id", "heading_path").distinct()
    foreign = c.where(path != "").select("doc_id", "heading_path").distinct().join(own, ["doc_id", "heading_path"], "left_anti").select("doc_id").distinct()
    paths = own.groupBy("doc_id").agg(F.count("*").alias("paths"))
    return paths.join(shape, "doc_id").join(foreign, "doc_id", "left_anti").select("doc_id", "paths", "led", "sized", "dense")


@register(
    "ingest_plan_docs",
    """
with t as (select cast(doc_id as varchar) as doc_id, text, doc_id % 3 = 0 as md from documents where regexp_matches(text, '\\S')),
n as (select *, len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^(#{1,6})\\s+(.+)'))) as headings from t)
select doc_id, case when md or headings >= 3 then 'heading' else 'recursive' end as strategy, true as counted from n
""",
)
def q_ingest_plan_docs(spark, sf_dir):
    """C9 per document: the strategy, and whether chunks and tokens lie between what the text's length makes them be."""
    docs = plain_corpus(spark, sf_dir)
    plan = q_ingest_plan(spark, sf_dir).join(docs.select("doc_id", F.length(F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))).alias("n")), "doc_id")
    least = F.greatest(F.lit(1.0), F.col("n") / 4 * 0.8 - F.col("chunks"))
    most = F.col("n") / 4 + 1 + F.col("chunks") * (64 * 8)  # a word of the overlap costs one token however short it is; a small last chunk joins the one before
    counted = (F.col("tokens") >= least) & (F.col("tokens") <= most) & (F.col("chunks") <= F.col("n") / 4 / (100 - 64) + 1)
    return plan.select("doc_id", "strategy", counted.alias("counted"))


@register(
    "chunk_renumber",
    """
with ln as (select cast(doc_id as varchar) as doc_id, unnest(string_split(text, chr(10))) as line,
                   unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) as pos from documents),
nb as (select * from ln where regexp_matches(line, '\\S'))
select doc_id, pos, cast(row_number() over (partition by doc_id order by pos) - 1 as integer) as chunk_index,
       cast(count(*) over (partition by doc_id) as integer) as total_chunks,
       printf('%s.chunk-%04d', doc_id, cast(row_number() over (partition by doc_id order by pos) - 1 as integer)) as key
from nb
""",
)
def q_chunk_renumber(spark, sf_dir):
    """Non-blank lines as chunks, dense 0-based index, total per document, key."""
    from tessera.functions import text as tx

    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    ln = d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).where(~tx.is_blank("line"))
    return ch.renumber(ln, order="pos").select("doc_id", "pos", "chunk_index", "total_chunks",
                                               tx.vector_key("doc_id", "chunk_index").alias("key"))
