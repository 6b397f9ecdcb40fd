"""The registered queries of this package: one ``opN_<name>`` per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.decontaminate import leaked_items
from tessera.llm.fim import fim_digests
from tessera.llm.jaccard import jaccard_components
from tessera.llm.langid import declared_languages, identify_documents, identify_pages
from tessera.llm.near_vectors import near_vectors
from tessera.llm.packing import pack_sequences
from tessera.llm.quality import score_quality
from tessera.llm.resampling import resample
from tessera.llm.sharding import shard_documents
from tessera.llm.suffix_dedup import suffix_dedup
from tessera.llm.suffix_tree import score_documents
from tessera.llm.topk import exact_top_k
from tessera.llm.token_counts import token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file on this machine (every node has the package)."""
    import public_tokenizers

    return public_tokenizers.path(name)


LANGUAGES = ("de", "en", "es", "fr")
"""Languages where no document declares one."""


@query
def op3_language_id(spark, sf_dir):
    """Language of every document from text, declaration and source."""
    docs = documents(spark, sf_dir)
    return identify_documents(docs, declared_languages(docs, LANGUAGES))


@query
def language_id_pages(spark, sf_dir):
    """Language of every page from text, markup, address suffix, domain and host."""
    docs = documents(spark, sf_dir)
    return identify_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), docs, declared_languages(docs, LANGUAGES))


@query
def op10_token_counts(spark, sf_dir):
    """Byte-level BPE tokens of every document."""
    return token_counts(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


@query
def op7_jaccard_join(spark, sf_dir):
    """Near-duplicate components of all documents (five-word shingles, 0.8)."""
    return jaccard_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


ORACLES["op7_jaccard_join"] = """
with recursive t as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
  from documents),
s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as shingle from t),
n as (select doc_id, count(*) as n from s group by doc_id),
o as (select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all),
e as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 80 * (x.n + y.n - o)),
pairs as (select a, b from e union all select b, a from e),
reach(id, least) as (select doc_id, doc_id from t union select pairs.b, reach.least from reach join pairs on pairs.a = reach.id where reach.least < pairs.b)
select t.doc_id, coalesce(n.n, 0) as n_shingles, min(least) as component_id
from t left join n on n.doc_id = t.doc_id join reach on reach.id = t.doc_id group by all
"""


@query
def op1_suffix_dedup(spark, sf_dir):
    """Bytes of every document that a 100-byte string seen earlier covers."""
    return suffix_dedup(documents(spark, sf_dir))


@query
def op5_pack_sequences(spark, sf_dir):
    """All documents as pieces of at most 2048 tokens, packed into few sequences."""
    return pack_sequences(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


@query
def op4_shard_documents(spark, sf_dir):
    """All documents in 16 shards of near-equal bytes, equal texts together."""
    return shard_documents(documents(spark, sf_dir))


@query
def op9_benchmark_leaks(spark, sf_dir):
    """Benchmark items that any document holds to 0.8 of their words."""
    return leaked_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op8_exact_top_k(spark, sf_dir):
    """The 20 best other embeddings of every 20th, by integer inner product."""
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLES["op8_exact_top_k"] = """
with v as (
  select row_number() over () as n, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select q.n, q.vec_id as query_id, c.vec_id as vec_id,
         cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from (select * from v where vec_id % 20 = 0) q join v c on q.n <> c.n and len(q.v) = len(c.v)),
r as (select *, row_number() over (partition by n order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20
"""


@query
def op6_suffix_tree(spark, sf_dir):
    """Log-probability of every document under a suffix tree learnt from six sevenths of them."""
    return score_documents(documents(spark, sf_dir))


@query
def op2_quality(spark, sf_dir):
    """Quality and toxicity of every document from co-trained views of text and record."""
    return score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op11_near_vectors(spark, sf_dir):
    """Near-duplicate components of all embeddings of a label (cosine 0.93)."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLES["op11_near_vectors"] = """
with recursive v as (select row_number() over () as u, vec_id, label, cast(embedding as double[]) as e from embeddings),
ok as (
  select * from v where label is not null and e is not null and len(e) > 0
    and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
link as (
  select a.u as a, b.u as b, b.vec_id as id from ok a join ok b
  on a.label = b.label and a.u <> b.u and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.93),
reach(u, least) as (select u, vec_id from v union select link.b, reach.least from reach join link on link.a = reach.u where reach.least < link.id),
n as (select a, count(*) as n from link group by a),
c as (select u, min(least) as component_id from reach group by u)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
from v join c on c.u = v.u left join n on n.a = v.u
"""


@query
def op12_fill_in_middle(spark, sf_dir):
    """Every document cut at two line ends and rearranged, as digests of the output and of the text rebuilt from it."""
    return fim_digests(documents(spark, sf_dir))


ORACLES["op12_fill_in_middle"] = """
with d as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as l,
         sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
c as (
  select *, len(l) as n, ('0x' || substr(h, 1, 8))::bigint % (len(l) + 1) as a, ('0x' || substr(h, 9, 8))::bigint % (len(l) + 1) as b,
         ('0x' || substr(h, 17, 8))::bigint % 100 as h3, ('0x' || substr(h, 25, 8))::bigint % 100 as h4 from d),
f as (
  select *, least(a, b) as lo, greatest(a, b) as hi,
         case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 >= 100 then 'plain'
              when h4 < 50 then 'spm' else 'psm' end as form from c),
p as (
  select *, coalesce(array_to_string(l[1:lo], ''), '') as pre, coalesce(array_to_string(l[lo + 1:hi], ''), '') as mid,
         coalesce(array_to_string(l[hi + 1:n], ''), '') as suf from f),
o as (
  select *, case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
                      else '<S>' || suf || '<P>' || pre || '<M>' || mid end as o from p),
r as (
  select *, case form when 'plain' then o
    when 'psm' then substr(o, 4, strpos(o, '<S>') - 4) || substr(o, strpos(o, '<M>') + 3) || substr(o, strpos(o, '<S>') + 3, strpos(o, '<M>') - strpos(o, '<S>') - 3)
    else substr(o, strpos(o, '<P>') + 3, strpos(o, '<M>') - strpos(o, '<P>') - 3) || substr(o, strpos(o, '<M>') + 3) || substr(o, 4, strpos(o, '<P>') - 4) end as back from o)
select doc_id, n, form, case when form <> 'plain' then len(pre) end as prefix_chars, case when form <> 'plain' then len(mid) end as middle_chars,
       sha256(o) as output_sha256, sha256(back) as restored_sha256 from r
"""


@query
def op13_importance_resampling(spark, sf_dir):
    """A twentieth of the documents drawn towards the benchmark's distribution of word runs."""
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
