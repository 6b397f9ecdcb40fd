"""Scalar-function queries (ids, hashes, HTML text, tokens, keys, metadata,
previews, tags) over the whole driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.plans import metadata_fixture as mf
from tessera.plans.chunk_queries import SECTIONS_SQL
from tessera.plans.fixtures import INDEX_VIEW_SQL, index_view
from tessera.plans.registry import register
from tessera.session import parallelism, spread
from tessera.sources.tables import read_table

# DuckDB form of Python's str.strip() on ASCII white space
_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


# --------------------------------------------------------------------------
# P1 doc_ids: paths built from the documents (CJK directory, spaces, dots)
# --------------------------------------------------------------------------
_PATH_SQL = "concat('中文/', lang, '/', source, ' v', cast(doc_id as varchar), '.md')"


def _doc_id_sql(rel: str, path: str) -> str:
    stem = f"regexp_replace({rel}, '\\.[^./]*$', '')"
    name = f"regexp_replace({stem}, '[^a-zA-Z0-9\\x{{4e00}}-\\x{{9fff}}_-]', '-', 'g')"
    name = f"regexp_replace({name}, '-{{2,}}', '-', 'g')"
    name = f"regexp_replace({name}, '^-+|-+$', '', 'g')"
    return f"coalesce(nullif(left({name}, 128), ''), left(md5({path}), 16))"


@register(
    "doc_ids",
    f"""
select doc_id, {_doc_id_sql("regexp_extract(p, '([^/]*)$', 1)", 'p')} as id_basename,
       {_doc_id_sql("case when starts_with(p, '中文/') then substr(p, 4) else regexp_extract(p, '([^/]*)$', 1) end", 'p')} as id_relative
from (select doc_id, {_PATH_SQL} as p from documents)
""",
)
def q_doc_ids(spark, sf_dir):
    """Document id from a path, by base name and relative to a base directory."""
    d = _docs(spark, sf_dir).select(
        "doc_id", F.concat(F.lit("中文/"), "lang", F.lit("/"), "source", F.lit(" v"), F.col("doc_id").cast("string"), F.lit(".md")).alias("p")
    )
    return d.select(
        "doc_id",
        tx.doc_id_from_path("p").alias("id_basename"),
        tx.doc_id_from_path("p", base_dir="中文/").alias("id_relative"),
    )


@register(
    "content_hash",
    "select doc_id, md5(text) as content_hash, octet_length(encode(text)) as n_bytes from documents",
)
def q_content_hash(spark, sf_dir):
    """md5 hex of the UTF-8 text."""
    return _docs(spark, sf_dir).select("doc_id", tx.content_hash("text").alias("content_hash"),
                                        F.octet_length("text").alias("n_bytes"))


@register(
    "file_types",
    """
select page_id, case when e = 'htm' then 'html' else e end as file_type
from (select page_id, case when strpos(p, '.') > 0 then lower(regexp_extract(p, '\\.([^.]*)$', 1)) else 'txt' end as e
      from (select page_id, regexp_replace(url, '\\?.*$', '') as p from pages))
""",
)
def q_file_types(spark, sf_dir):
    """File type from the extension of each page URL path (htm -> html, none -> txt)."""
    p = read_table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"\?.*$", "").alias("p"))
    return p.select("page_id", tx.file_type("p").alias("file_type"))


# --------------------------------------------------------------------------
# P4/P5 HTML text
# --------------------------------------------------------------------------
def html_text_sql(h: str) -> str:
    """The same text for well-formed pages: tags become separators, references are decoded piece by piece."""
    x = f"regexp_replace({h}, '(?s)<!--.*?-->', chr(1), 'g')"
    x = f"regexp_replace({x}, '(?is)<!doctype[^>]*>', chr(1), 'g')"
    for tag in ("script", "style", "nav", "header", "footer"):
        x = f"regexp_replace({x}, '(?is)<{tag}(\\s[^>]*)?>.*?</{tag}\\s*>', chr(1), 'g')"
    x = f"regexp_replace({x}, '<[^>]*>', chr(1), 'g')"
    piece = "s"
    for name, ch in (("quot", '"'), ("#39", "''"), ("lt", "<"), ("gt", ">"), ("nbsp", "\u00a0"), ("copy", "©"), ("middot", "·"), ("euro", "€"), ("mdash", "—"), ("#8217", "’"), ("amp", "&")):
        piece = f"replace({piece}, '&{name};', '{ch}')"
    strip = f"regexp_replace({piece}, '^[\\s\u00a0]+|[\\s\u00a0]+$', '', 'g')"
    return f"array_to_string(list_filter(list_transform(string_split({x}, chr(1)), lambda s: {strip}), lambda s: s <> ''), chr(10))"


@register("html_text", f"select page_id, {html_text_sql('html')} as text from pages")
def q_html_text(spark, sf_dir):
    """Visible text of every page (script/style/nav/header/footer removed)."""
    return spread(read_table(spark, sf_dir, "pages"), parallelism(spark)).select("page_id", tx.html_text("html").alias("text"))


@register(
    "html_text_simple",
    f"""select page_id, {_STRIP.format(x="regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} as text
from pages""",
)
def q_html_text_simple(spark, sf_dir):
    """P5: tag-stripping fallback."""
    return read_table(spark, sf_dir, "pages").select("page_id", tx.html_text_simple("html").alias("text"))


# --------------------------------------------------------------------------
# P6-P9 tokens, keys, embedding input
# --------------------------------------------------------------------------
@register("token_count", "select doc_id, greatest(1, length(text) // 4) as tokens from documents")
def q_token_count(spark, sf_dir):
    """Default token estimate."""
    return _docs(spark, sf_dir).select("doc_id", tx.token_count("text").alias("tokens"))


@register(
    "vector_key",
    """
select conv_id, turn, printf('%s.chunk-%04d', 'conv' || cast(conv_id as varchar), turn) as key from conversations
""",
)
def q_vector_key(spark, sf_dir):
    """``doc.chunk-0007`` keys for every conversation turn."""
    c = read_table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", tx.vector_key(F.concat(F.lit("conv"), F.col("conv_id").cast("string")), "turn").alias("key"))


@register(
    "embed_input",
    f"""
select doc_id, md5(case when pre <> '' then {_STRIP.format(x="concat(pre, chr(10) || chr(10), text)")} else text end) as input_md5,
       length(left(case when pre <> '' then {_STRIP.format(x="concat(pre, chr(10) || chr(10), text)")} else text end, 8000)) as cut_len
from (select doc_id, text, left(regexp_extract(text, '^[^\\n]*', 0), 200) as pre from documents)
""",
)
def q_embed_input(spark, sf_dir):
    """Prefix + blank line + content (stripped), cut to 8000 characters for the model."""
    d = _docs(spark, sf_dir).withColumn("pre", F.substring(F.regexp_extract("text", r"^[^\n]*", 0), 1, 200))
    inp = tx.embed_input("text", "pre")
    return d.select("doc_id", F.md5(inp).alias("input_md5"), F.length(tx.embed_cut(inp)).alias("cut_len"))


# --------------------------------------------------------------------------
# P10/P11 chunk metadata and the 2048-byte budget
# --------------------------------------------------------------------------
@register("chunk_metadata", mf.CHUNK_METADATA_SQL)
def q_chunk_metadata(spark, sf_dir):
    """Metadata of each document as one chunk; content cut to the byte budget."""
    return mf.chunk_metadata_fixture(_docs(spark, sf_dir))


@register("metadata_budget", mf.METADATA_BUDGET_SQL)
def q_metadata_budget(spark, sf_dir):
    """Every metadata JSON, after the fix, within 2048 bytes."""
    return mf.metadata_budget_fixture(_docs(spark, sf_dir))


# --------------------------------------------------------------------------
# P14-P18, P22 on the index view
# --------------------------------------------------------------------------
@register(
    "preview",
    f"""
select key, case when length(content) > 200 then concat(replace(left(content, 200), chr(10), ' '), '...')
            else replace(left(content, 200), chr(10), ' ') end as preview,
       left(coalesce(source, ''), 100) as source_100,
       coalesce(nullif('', ''), doc_id, key) as title,
       strftime(ingested_at, '%Y-%m-%d') as ingest_day,
       strftime(ingested_at, '%Y-%m-%dT%H:%M:%SZ') as ingested_at_text
from ({INDEX_VIEW_SQL})
""",
)
def q_preview(spark, sf_dir):
    """Preview, title, source cap, ingest day and ISO timestamp text."""
    iv = index_view(spark, sf_dir)
    return iv.select(
        "key",
        tx.preview("content").alias("preview"),
        F.substring(F.coalesce("source", F.lit("")), 1, tx.STATS_SOURCE_CHARS).alias("source_100"),
        tx.hit_title(F.lit(""), "doc_id", "key").alias("title"),
        F.date_format("ingested_at", "yyyy-MM-dd").alias("ingest_day"),
        F.date_format("ingested_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ingested_at_text"),
    )


@register(
    "first_tag",
    f"""
select doc_id, coalesce(nullif({_STRIP.format(x="string_split(coalesce(t, ''), ',')[1]")}, ''), 'untagged') as first_tag
from (select cast(doc_id as varchar) as doc_id, case when doc_id % 4 = 0 then null when doc_id % 4 = 1 then '' else concat(' ', source, ' ,', lang) end as t
      from documents)
""",
)
def q_first_tag(spark, sf_dir):
    """First tag of the comma list; missing or empty -> untagged."""
    d = _docs(spark, sf_dir)
    t = (F.when(F.col("doc_id") % 4 == 0, F.lit(None)).when(F.col("doc_id") % 4 == 1, F.lit(""))
         .otherwise(F.concat(F.lit(" "), "source", F.lit(" ,"), "lang")))
    return d.select(F.col("doc_id").cast("string").alias("doc_id"), tx.first_tag(t).alias("first_tag"))


@register(
    "rounding",
    """
select vec_id, round(s, 4) as score4, printf('%.2f', s) as score2
from (select vec_id, 1 - (1 - list_dot_product(cast(embedding as double[]), cast(embedding as double[]))) / 2 + label / 1000.0 as s
      from embeddings)
""",
)
def q_rounding(spark, sf_dir):
    """Scores to 4 decimals (JSON) and 2 decimals (markdown)."""
    from tessera.functions.vector import dot

    e = read_table(spark, sf_dir, "embeddings")
    s = F.lit(1.0) - (F.lit(1.0) - dot("embedding", "embedding")) / 2 + F.col("label") / 1000.0
    return e.select("vec_id", F.round(s, 4).alias("score4"), F.format_string("%.2f", s).alias("score2"))


@register(
    "defaults",
    f"""
select key, coalesce(source, 'unknown') as source, coalesce(cast(chunk_index as varchar), '?') as chunk_index,
       coalesce(cast(total_chunks as varchar), '?') as total_chunks, coalesce(heading, '') as heading_path,
       coalesce(ctx, '') as context_prefix
from (select *, null::varchar as heading, null::varchar as ctx from ({INDEX_VIEW_SQL}))
""",
)
def q_defaults(spark, sf_dir):
    """Missing metadata shown as '', 'unknown' or '?'."""
    iv = index_view(spark, sf_dir)
    return iv.select(
        "key",
        F.coalesce("source", F.lit("unknown")).alias("source"),
        F.coalesce(F.col("chunk_index").cast("string"), F.lit("?")).alias("chunk_index"),
        F.coalesce(F.col("total_chunks").cast("string"), F.lit("?")).alias("total_chunks"),
        F.coalesce(F.lit(None).cast("string"), F.lit("")).alias("heading_path"),
        F.coalesce(F.lit(None).cast("string"), F.lit("")).alias("context_prefix"),
    )


# --------------------------------------------------------------------------
# F9, S3
# --------------------------------------------------------------------------
@register("drop_blank_docs", "select doc_id from documents where regexp_matches(text, '\\S')")
def q_drop_blank_docs(spark, sf_dir):
    """documents that are not blank after strip."""
    d = _docs(spark, sf_dir)
    return d.where(~tx.is_blank("text")).select("doc_id")


_BLANKED = "case when doc_id % 5 = 0 then repeat(' ', doc_id % 7) || chr(10) || chr(9) when doc_id % 5 = 1 then null else text end"


@register("drop_blank_mixed", f"select doc_id from documents where regexp_matches({_BLANKED}, '\\S')")
def q_drop_blank_mixed(spark, sf_dir):
    """F9 where two fifths of the texts are white space or null."""
    white = F.concat(F.expr("repeat(' ', cast(doc_id % 7 as int))"), F.lit("\n\t"))
    text = F.when(F.col("doc_id") % 5 == 0, white).when(F.col("doc_id") % 5 == 1, F.lit(None)).otherwise(F.col("text"))
    return _docs(spark, sf_dir).withColumn("text", text).where(~tx.is_blank("text")).select("doc_id")


@register(
    "hit_titles",
    f"""
with s as ({SECTIONS_SQL})
select doc_id, section_no, case when heading_path <> '' and section_no % 2 = 0 then heading_path when section_no % 3 = 0 then doc_id
       else concat(doc_id, '#', cast(section_no as varchar)) end as title from s
""",
)
def q_hit_titles(spark, sf_dir):
    """P15 on real headings: the heading path, where there is none (or it is left out) the document, else the key."""
    from tessera.operators.chunking import sections
    from tessera.plans.fixtures import markdown_corpus

    n = F.col("section_no")
    path = F.when(n % 2 == 0, F.col("heading_path")).otherwise(F.when(n % 3 == 0, F.lit("")))
    doc = F.when(n % 3 == 0, F.col("doc_id"))
    s = sections(markdown_corpus(spark, sf_dir))
    return s.select("doc_id", "section_no", tx.hit_title(path, doc, F.concat("doc_id", F.lit("#"), n.cast("string"))).alias("title"))


@register(
    "inline_docs",
    """
select concat('stdin-', left(md5(text), 12)) as doc_id, 'txt' as file_type, 'stdin' as source, md5(text) as content_hash,
       length(text) as n_chars, conv_id, turn
from conversations where regexp_matches(text, '\\S')
""",
)
def q_inline_docs(spark, sf_dir):
    """S3: every conversation turn given as inline text becomes a document (id ``stdin-`` + md5[:12])."""
    from tessera.sources.files import inline_docs

    c = read_table(spark, sf_dir, "conversations")
    docs = inline_docs(c, keep=("conv_id", "turn"))
    return docs.select("doc_id", "file_type", "source", F.md5("text").alias("content_hash"),
                       F.length("text").alias("n_chars"), "conv_id", "turn")


@register(
    "keyword_lists",
    f"""
select doc_id, list_filter(list_transform(string_split(kw, ','), lambda x: {_STRIP.format(x='x')}), lambda x: x <> '') as keywords
from (select doc_id, concat(source, ', ,', lang, ' , ', replace(text, '. ', ',')) as kw from documents)
""",
)
def q_keyword_lists(spark, sf_dir):
    """Comma lists -> trimmed, non-empty entries (order kept)."""
    d = _docs(spark, sf_dir)
    kw = F.concat("source", F.lit(", ,"), "lang", F.lit(" , "), F.replace(F.col("text"), F.lit(". "), F.lit(",")))
    return d.select("doc_id", tx.keyword_list(kw).alias("keywords"))


_COLLIDE_PATH_SQL = ("concat(source, case when doc_id % 2 = 0 then '/' else '-' end, lang, "
                     "case when doc_id % 2 = 0 then '.md' else '.txt' end)")


@register(
    "id_collisions",
    f"""
select id as doc_id, list_sort(list(distinct p)) as paths
from (select p, {_doc_id_sql("regexp_extract(p, '([^/]*)$', 1)", 'p')} as id
      from (select {_COLLIDE_PATH_SQL} as p from documents))
group by id having count(distinct p) > 1
""",
)
def q_id_collisions(spark, sf_dir):
    """Different paths that map to one document id (``src/en.md`` and ``src-en.txt``)."""
    from tessera.sources.files import id_collisions

    d = _docs(spark, sf_dir)
    even = F.col("doc_id") % 2 == 0
    p = F.concat("source", F.when(even, F.lit("/")).otherwise(F.lit("-")), "lang",
                 F.when(even, F.lit(".md")).otherwise(F.lit(".txt")))
    corpus = d.select(p.alias("path")).select(tx.doc_id_from_path("path").alias("doc_id"), "path")
    return id_collisions(corpus)
