"""Statistics and tag queries."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessera.operators import stats as st
from tessera.operators import tags as tg
from tessera.plans.fixtures import line_index, line_index_sql
from tessera.plans.registry import register
from tessera.session import parallelism, scratch_path
from tessera.sources.files import read_tag_catalog
from tessera.sources.tables import read_table

LI = line_index_sql()
_FIRST_TAG = "coalesce(nullif(regexp_replace(string_split(coalesce(tags, ''), ',')[1], '^\\s+|\\s+$', '', 'g'), ''), 'untagged')"


@register("kb_totals", f"select count(*) as total_chunks, count(distinct coalesce(doc_id, 'unknown')) as total_docs from {LI}")
def q_kb_totals(spark, sf_dir):
    """A1: total chunks and documents."""
    return st.kb_totals(line_index(spark, sf_dir))


@register("kb_totals_approx")
def q_kb_totals_approx(spark, sf_dir):
    """HyperLogLog document count (approximate, rows-only check)."""
    return st.kb_totals_approx(line_index(spark, sf_dir))


@register(
    "tag_distribution",
    f"select {_FIRST_TAG} as tag, count(distinct coalesce(doc_id, 'unknown')) as docs, count(*) as chunks from {LI} group by 1",
)
def q_tag_distribution(spark, sf_dir):
    """A2: documents and chunks per first tag."""
    return st.tag_distribution(line_index(spark, sf_dir))


_ROLLUP_SQL = f"""
select coalesce(doc_id, 'unknown') as doc_id, count(*) as chunks,
       arg_min({_FIRST_TAG}, (chunk_index, key)) as tag,
       arg_min(coalesce(strftime(ingested_at, '%Y-%m-%d'), ''), (chunk_index, key)) as ingested_at,
       arg_min(coalesce(source, ''), (chunk_index, key)) as source
from {LI} group by 1
"""


@register("doc_rollup", _ROLLUP_SQL)
def q_doc_rollup(spark, sf_dir):
    """A3: per document chunk count and first-row tag, day and source."""
    return st.doc_rollup(line_index(spark, sf_dir))


@register(
    "recent_docs",
    f"""select doc_id, tag, chunks, ingested_at, left(source, 100) as source
        from ({_ROLLUP_SQL}) order by ingested_at desc, doc_id limit 10""",
)
def q_recent_docs(spark, sf_dir):
    """K4: the ten most recent documents (ties by id)."""
    return st.recent_docs(line_index(spark, sf_dir))


@register(
    "stats_lines",
    f"""select tag, printf('  %s: %d 篇 (%d chunks)', case when tag = 'untagged' then '未分类' else tag end, docs, chunks) as line
        from (select {_FIRST_TAG} as tag, count(distinct doc_id) as docs, count(*) as chunks from {LI} group by 1)""",
)
def q_stats_lines(spark, sf_dir):
    """The per-tag lines of the statistics report."""
    return st.stats_lines(line_index(spark, sf_dir))


@register(
    "stats_report",
    f"""
with li as {LI},
r as ({_ROLLUP_SQL}),
rec as (select * from r order by ingested_at desc, doc_id limit 10)
select 0 as part, '' as sort_key,
       '📊 知识库状态：' || chr(10) || chr(10) || printf('文档数：%d', count(distinct coalesce(doc_id, 'unknown'))) || chr(10)
       || printf('Chunk 总数：%d', count(*)) || chr(10) || chr(10) || '按分类：' as line from li
union all
select 1, tag, printf('  %s: %d 篇 (%d chunks)', case when tag = 'untagged' then '未分类' else tag end, docs, chunks)
from (select {_FIRST_TAG} as tag, count(distinct doc_id) as docs, count(*) as chunks from li group by 1)
union all
select 2, '000000', chr(10) || '最近入库：' from (select 1) where exists (select 1 from rec)
union all
select 2, lpad(cast(row_number() over (order by ingested_at desc, doc_id) as varchar), 6, '0'),
       printf('  %s %s — %d chunks (%s)', case when tag = 'untagged' then '[未分类]' else '[' || tag || ']' end,
              doc_id, chunks, ingested_at)
from rec
""",
)
def q_stats_report(spark, sf_dir):
    """The full statistics report (totals, tags, ten most recent documents)."""
    return st.stats_report(line_index(spark, sf_dir))


# --------------------------------------------------------------------------
# tags
# --------------------------------------------------------------------------
def catalog_values_sql(catalog: dict | None = None) -> str:
    """The catalog's (tag, keyword) pairs as a DuckDB VALUES list (for oracles)."""
    cat = tg.DEFAULT_CATALOG if catalog is None else catalog
    pairs = sorted({(name, kw.lower()) for name, (_, kws, _) in cat.items() for kw in kws if kw})
    vals = ", ".join(f"('{n}', '{k}')" for n, k in pairs)
    return f"(select * from (values {vals}) as t(tag, kw))"


_KW = catalog_values_sql()
_HITS_SQL = f"""
hits as (select cast(d.doc_id as varchar) as doc_id, k.tag, count(*) as hits
         from documents d join {_KW} k on contains(lower(d.text), k.kw) group by all)
"""


@register(
    "keyword_tagger",
    f"""with {_HITS_SQL}
select doc_id, arg_min(tag, (-hits, tag)) as best_tag, max(hits) as hits from hits group by doc_id""",
)
def q_keyword_tagger(spark, sf_dir):
    """The catalog tag whose keywords a document contains most."""
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return tg.best_tag(tg.keyword_hits(d, parallelism=parallelism(spark)))


def _catalog_file(spark) -> str:
    """The shipped catalog as a tag file."""
    tags = {n: {"label": lab, "keywords": list(kw), "description": desc} for n, (lab, kw, desc) in tg.DEFAULT_CATALOG.items()}
    path = scratch_path(spark, "tags")
    spark.createDataFrame([(json.dumps({"tags": tags}, ensure_ascii=False),)], "value string").coalesce(1).write.text(path)
    return path


@register(
    "tag_catalog",
    f"""with {_HITS_SQL},
cat as (select * from (values {", ".join(f"('{n}', '{lab}', {len(kw)}, '{desc}')" for n, (lab, kw, desc) in tg.DEFAULT_CATALOG.items())})
        as t(name, label, n_keywords, description))
select c.name, c.label, c.n_keywords, c.description, count(h.doc_id) as docs
from cat c left join hits h on h.tag = c.name group by all""",
)
def q_tag_catalog(spark, sf_dir):
    """The catalog sorted by name, with the number of documents matching each tag."""
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    hits = tg.keyword_hits(d).groupBy("tag").agg(F.count("*").alias("docs"))
    cat = read_tag_catalog(spark, _catalog_file(spark))
    out = cat.join(hits, cat.name == hits.tag, "left").select(
        "name", "label", F.size("keywords").alias("n_keywords"), "description", F.coalesce("docs", F.lit(0)).alias("docs"))
    return out.orderBy("name")


_NAME_SQL_PAT = "^[\\p{L}\\p{N}_\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}][\\p{L}\\p{N}_\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}-]*$"


@register(
    "tag_name_valid",
    f"""select w as name, regexp_matches(w, '{_NAME_SQL_PAT}') as valid
        from (select distinct string_split(line, ' ')[1] as w
              from (select unnest(string_split(text, chr(10))) as line from documents))""",
)
def q_tag_name_valid(spark, sf_dir):
    """first words of every line as candidate tag names, with validity."""
    d = read_table(spark, sf_dir, "documents")
    w = d.select(F.explode(F.split("text", "\n", -1)).alias("line")).select(
        F.split("line", " ", -1).getItem(0).alias("name")).distinct()
    return w.select("name", tg.name_valid("name").alias("valid"))


_CANDIDATES_SQL = """
(select left(source, 4) as name, list_sort(list(distinct lang)) as keywords from documents group by source)
"""


def _candidates(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("keywords")).select(
        F.substring("source", 1, 4).alias("name"), "keywords", F.lit("").alias("label"), F.lit("").alias("description"))


@register(
    "tag_rule_check",
    f"""
with c as {_CANDIDATES_SQL}
select name, 'duplicate' as rule, count(*) as value from c group by name having count(*) > 1
union all select name, 'too_few_keywords', len(keywords) from c where len(keywords) < 2
union all select distinct name, 'invalid_name', 1 from c where not regexp_matches(name, '{_NAME_SQL_PAT}')
""",
)
def q_tag_rule_check(spark, sf_dir):
    """catalog built per source from its languages; duplicate names and short keyword lists."""
    return tg.rule_violations(_candidates(spark, sf_dir))


@register(
    "keyword_merge",
    """
with c as (select source as name, list_sort(list(distinct lang)) as keywords from documents group by source),
m as (select name, list_concat(keywords, ['en', 'fr', 'xx']) as cat from c)
select name, list_filter(cat, lambda x, i: list_position(cat, x) = i) as merged, ['en', 'zz'] as replaced from m
""",
)
def q_keyword_merge(spark, sf_dir):
    """P20: add keywords (ordered de-duplicated union); a replacement list wins over additions."""
    d = read_table(spark, sf_dir, "documents")
    c = d.groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("keywords")).select(
        F.col("source").alias("name"), "keywords", F.lit("").alias("label"), F.lit("").alias("description"))
    add = c.select("name", F.array(F.lit("en"), F.lit("fr"), F.lit("xx")).alias("add_keywords"),
                   F.lit(None).cast("array<string>").alias("keywords"))
    rep = c.select("name", F.array(F.lit("en"), F.lit("fr")).alias("add_keywords"),
                   F.array(F.lit("en"), F.lit("zz")).alias("keywords"))
    merged = tg.update_keywords(c, add).select("name", F.col("keywords").alias("merged"))
    replaced = tg.update_keywords(c, rep).select("name", F.col("keywords").alias("replaced"))
    return merged.join(replaced, "name")


@register(
    "reclassify",
    f"""
with m as (select cast(doc_id as varchar) as doc_id, case when toxic = 1 then 'ops' else 'AI' end as new_tag from labels)
select li.key, coalesce(m.new_tag, li.tags) as tags from {LI} li left join m on m.doc_id = li.doc_id
""",
)
def q_reclassify(spark, sf_dir):
    """Batch re-tagging -- toxic documents to 'ops', other labelled ones to 'AI'."""
    lab = read_table(spark, sf_dir, "labels")
    moves = lab.select(F.col("doc_id").cast("string").alias("doc_id"),
                       F.when(F.col("toxic") == 1, "ops").otherwise("AI").alias("new_tag"))
    out, _missing = tg.reclassify(line_index(spark, sf_dir), moves)
    return out.select("key", "tags")
