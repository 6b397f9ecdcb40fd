"""Report formats (S12, S13) and heading-aware chunk invariants."""

import json

from pyspark.sql import functions as F

import __spark_entry__ as E
from tessera.operators import chunking as ch
from tessera.plans.fixtures import markdown_corpus
from tests.conftest import SF001


def test_report_lines_header_blocks_and_not_found(spark):
    rows = E.queries()["report_lines"](spark, SF001).collect()
    by_q = {}
    for r in rows:
        by_q.setdefault(r.query_id, []).append((r.rank, r.line))
    for qid, lines in by_q.items():
        lines.sort()
        if lines[0][1].startswith("🤖"):
            assert len(lines) == 1
        else:
            assert lines[0][1].startswith("📚 知识库搜索结果（Top ")
            assert [rk for rk, _ in lines[1:]] == list(range(1, len(lines)))
            for _, block in lines[1:]:
                parts = block.split("\n")
                assert parts[0].startswith("**") and parts[1].startswith("来源：") and parts[-2].startswith("> ")
                assert parts[-1] == ""


def test_search_json_documents(spark):
    rows = E.queries()["search_json"](spark, SF001).collect()
    assert rows
    for r in rows:
        doc = json.loads(r.json)
        assert doc["results_count"] == len(doc["results"]) <= 5
        assert [x["rank"] for x in doc["results"]] == list(range(1, len(doc["results"]) + 1))
        assert all(x["score"] >= 0.6 for x in doc["results"])


def test_stats_report_order(spark):
    rows = sorted(E.queries()["stats_report"](spark, SF001).collect(), key=lambda r: (r.part, r.sort_key))
    text = "\n".join(r.line for r in rows)
    assert text.startswith("📊 知识库状态：") and "按分类：" in text and "最近入库：" in text
    assert sum(1 for r in rows if r.part == 2) == 11  # heading + ten documents


def test_heading_chunks_carry_their_path(spark):
    md = markdown_corpus(spark, SF001)
    rows = ch.chunk_docs(md, strategy="heading").collect()
    assert rows
    for r in rows:
        assert r.content.strip()
        if r.heading_path:
            assert r.content.startswith(r.heading_path)
        assert r.tokens <= 512 or r.chunk_index == r.total_chunks - 1 or r.heading_path
