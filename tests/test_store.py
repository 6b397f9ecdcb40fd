"""Versioned storage: atomic commits, delete files, writers that meet, compaction, vacuum."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from tessera.operators import index as ix

DDL = "key string, doc_id string, chunk_index int, total_chunks int, tags string"


def rows(spark, docs, tag="old"):
    return spark.createDataFrame([(f"{d}.chunk-{c:04d}", d, c, 2, tag) for d in docs for c in range(2)], DDL)


def ids(spark, docs):
    return spark.createDataFrame([(d,) for d in docs], "doc_id string")


def state(spark, base):
    return sorted((r.key, r.tags) for r in ix.read_index(spark, base).select("key", "tags").collect())


def want(**tags):
    return sorted((f"{d}.chunk-{c:04d}", t) for d, t in tags.items() for c in range(2))


@pytest.fixture()
def base(spark, tmpdir_path):
    b = f"{tmpdir_path}/index"
    ix.write_index(rows(spark, "abcdef"), b, buckets=2)
    return b


def put(base, number, text):
    with open(f"{base}/_manifests/v-{number:012d}", "w") as f:
        f.write(text)


@pytest.mark.parametrize("keep", [0, 5, 20, -1, -2, -8])
def test_a_cut_manifest_hides_nothing(spark, base, keep):
    whole = open(f"{base}/_manifests/v-{1:012d}").read()
    put(base, 2, whole[:keep])
    old = want(**dict.fromkeys("abcdef", "old"))
    assert ix.current_version(spark, base) == f"v-{1:012d}" and state(spark, base) == old
    assert ix.apply_doc_changes(spark, base, rows(spark, "a", "new"), ids(spark, "b")) == f"v-{3:012d}"
    assert state(spark, base) == want(a="new", c="old", d="old", e="old", f="old")


def test_a_writer_that_dies_leaves_the_version_before(spark, base, monkeypatch):
    real = ix._write_text

    def half(fs, path, text):
        real(fs, path, text[: len(text) // 2])
        raise KeyboardInterrupt("killed between create and close")

    monkeypatch.setattr(ix, "_write_text", half)
    with pytest.raises(KeyboardInterrupt):
        ix.apply_doc_changes(spark, base, rows(spark, "a", "new"), ids(spark, "b"))
    monkeypatch.setattr(ix, "_write_text", real)
    assert state(spark, base) == want(**dict.fromkeys("abcdef", "old"))
    ix.apply_doc_changes(spark, base, rows(spark, "a", "new"), ids(spark, "b"))
    assert state(spark, base) == want(a="new", c="old", d="old", e="old", f="old")


def test_only_one_writer_gets_a_number(spark, base):
    parts = ix.current_manifest(spark, base).parts
    got = []
    threads = [threading.Thread(target=lambda: got.append(ix._commit(spark, base, 2, 2, parts))) for _ in range(2)]
    for t in threads:
        t.start()
        t.join()
    assert sorted(got) == [False, True] and not [f for f in os.listdir(f"{base}/_manifests") if f.startswith(".new")]


def test_a_second_writer_adds_to_the_first(spark, base, monkeypatch):
    """The other writer changes the same document between this one's reading and its commit."""
    real, first = ix._commit, []

    def slow(*a):
        if not first:
            first.append(1)
            ix.apply_doc_changes(spark, base, rows(spark, "ag", "first"), ids(spark, "c"))
        return real(*a)

    monkeypatch.setattr(ix, "_commit", slow)
    ix.apply_doc_changes(spark, base, rows(spark, "ah", "second"), ids(spark, "b"))
    assert state(spark, base) == want(a="second", g="first", h="second", d="old", e="old", f="old")


def test_a_small_change_writes_only_itself(spark, base):
    before = ix.current_manifest(spark, base)
    ix.apply_doc_changes(spark, base, rows(spark, "a", "new"), ids(spark, ""))
    after = ix.current_manifest(spark, base)
    new = [p for own in after.parts.values() for p in own if p.number == 2]
    assert all(p in after.parts[b] for b in before.parts for p in before.parts[b])  # nothing rewritten
    assert sorted(p.kind for p in new) == ["deletes", "rows"]
    assert spark.read.parquet(*[p.path for p in new if p.kind == "rows"]).count() == 2
    assert [r.doc_id for r in spark.read.parquet(*[p.path for p in new if p.kind == "deletes"]).collect()] == ["a"]


def test_deletes_apply_to_older_parts_only(spark, base, monkeypatch):
    for n in range(3):
        ix.apply_doc_changes(spark, base, rows(spark, "a", f"v{n}"), ids(spark, ""))
    ix.apply_doc_changes(spark, base, rows(spark, ""), ids(spark, "bz"))
    ix.apply_doc_changes(spark, base, rows(spark, "b", "back"), ids(spark, ""))
    now = want(a="v2", b="back", c="old", d="old", e="old", f="old")
    assert state(spark, base) == now
    from tessera import session

    plan = lambda: ix.read_index(spark, base)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan()
    monkeypatch.setattr(session, "KEY_BYTES", 10)
    assert "strategy=broadcast" not in plan() and state(spark, base) == now
    read = ix.read_buckets(spark, base, ids(spark, "a"))
    assert sorted(r.tags for r in read.where("doc_id = 'a'").collect()) == ["v2", "v2"]
    assert ix.compact_index(spark, base) and ix.compact_index(spark, base) == []
    assert state(spark, base) == now
    assert all([p.kind for p in own] == ["rows"] for own in ix.current_manifest(spark, base).parts.values())


def test_compaction_keeps_what_others_add_meanwhile(spark, base, monkeypatch):
    ix.apply_doc_changes(spark, base, rows(spark, "ace", "mid"), ids(spark, "b"))
    real, first = ix._commit, []

    def slow(*a):
        if not first:
            first.append(1)
            ix.apply_doc_changes(spark, base, rows(spark, "ax", "late"), ids(spark, "d"))
        return real(*a)

    monkeypatch.setattr(ix, "_commit", slow)
    ix.compact_index(spark, base)
    assert state(spark, base) == want(a="late", x="late", c="mid", e="mid", f="old")


def test_documents_all_gone(spark, base):
    ix.apply_doc_changes(spark, base, rows(spark, ""), ids(spark, "abcdef"))
    assert state(spark, base) == [] and ix.current_manifest(spark, base).parts == {}


def test_vacuum_takes_orphans_by_age(spark, base):
    orphan = f"{base}/v-0000000000001-deadbeef/rows/bucket=0"
    fresh = f"{base}/{ix._new_version()}/rows/bucket=0"
    for d in (orphan, fresh):
        os.makedirs(d)
    put(base, 2, "#index\t2")
    ix.apply_doc_changes(spark, base, rows(spark, "a", "new"), ids(spark, ""))
    now = state(spark, base)
    ix.vacuum_index(spark, base)
    assert not os.path.exists(orphan) and os.path.exists(fresh) and os.path.exists(f"{base}/_manifests/v-{2:012d}")
    ix.compact_index(spark, base)
    ix.vacuum_index(spark, base, orphan_hours=-1)
    assert not os.path.exists(fresh) and not os.path.exists(f"{base}/_manifests/v-{2:012d}")
    assert state(spark, base) == now
    used = {p.path.split(base)[1].split("/")[1] for own in ix.current_manifest(spark, base).parts.values() for p in own}
    assert {d for d in os.listdir(base) if d.startswith("v-")} == used


def test_first_layout_is_still_read(spark, base):
    m = ix.current_manifest(spark, base)
    put(base, 2, "\n".join(["#buckets\t2", *[f"{b}\t{p[0].path}" for b, p in m.parts.items()], ""]))
    assert ix.current_version(spark, base) == f"v-{2:012d}"
    ix.apply_doc_changes(spark, base, rows(spark, "a", "new"), ids(spark, "b"))
    assert state(spark, base) == want(a="new", c="old", d="old", e="old", f="old")


def test_keys_are_split_and_measured_before_they_are_broadcast(spark, base, monkeypatch):
    from tessera import session

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    index = ix.read_index(spark, base)
    text = ", ".join(["a.chunk-0000", " ", "b.chunk-0001", "a.chunk-0000"])
    for size, waves in ((64 << 20, 1), (100, 2), (10, 0)):  # beyond KEY_WAVES nothing is broadcast
        monkeypatch.setattr(session, "KEY_BYTES", size)
        got = ix.get_vectors(index, text)
        assert plan(got).count("strategy=broadcast") == waves
        assert sorted(r.key for r in got.collect()) == ["a.chunk-0000", "b.chunk-0001"]
        assert ix.delete_keys(index, text.split(",")).count() == 10
    table = spark.createDataFrame([("c.chunk-0000",), (None,), ("zz",)], "key string")
    assert [r.key for r in ix.get_vectors(index, table).collect()] == ["c.chunk-0000"]
