"""Corpus pipeline: from raw documents to packed training sequences.

Five stages, each a function ``(spark, docs, sf_dir) -> DataFrame`` whose
result is written as Parquet and read again as the next one's ``docs``. All
but the last return the columns of ``documents``:

1. language ID: documents without an accepted language go;
2. n-gram Jaccard join: of each component of near-duplicates the document of
   smallest doc_id stays;
3. suffix-array de-duplication: strings of 100 bytes and more that another
   document (or an earlier place) holds already are cut out of the texts;
4. benchmark decontamination: documents that hold a benchmark item go;
5. best-fit packing: the token pieces of what is left, in sequences of 2048.

Nulls, empty and very long texts, repeated rows and further columns are
handled as the operators' docstrings say; empty documents pass stages 2 to 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.decontaminate import without_leaks
from tessera.llm.jaccard import distinct_documents
from tessera.llm.langid import accepted_documents, declared_languages
from tessera.llm.packing import pack_sequences
from tessera.llm.queries import LANGUAGES, vocabulary
from tessera.llm.suffix_dedup import without_repeats
from tessera.session import materialize, ship_package


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that they declare."""
    return accepted_documents(docs, declared_languages(docs, LANGUAGES))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return distinct_documents(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated strings."""
    return without_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents, placed in sequences."""
    return pack_sequences(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language id", language_id),
    ("jaccard join", jaccard_join),
    ("suffix dedup", suffix_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: SQL can express neither the language model nor the tiling; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage{i + 1}")
    return docs
