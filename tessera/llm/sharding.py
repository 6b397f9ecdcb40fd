"""Shards of near-equal bytes for indivisible groups, by Karmarkar-Karp differencing.

Rows with equal texts form a group that stays in one shard. A partial
partition has one sum per shard; the two with the largest spread are combined
again and again, the larger sums of one with the smaller of the other, so that
their differences cancel. Tasks do this for some tens of thousands of groups
each; what they leave, one partial partition per task, is combined the same
way in further levels until one is left. Group sizes are summed before any
shuffle, and only partial partitions (one number per shard) meet.

A row's size is the UTF-8 bytes of its text plus 1; a null text has none and
forms a group of its own beside the empty text. A group larger than the rest
together takes a shard for itself. Every row counts for itself, so repeated or
null ``doc_id`` values are fine. Columns besides ``doc_id`` and ``text`` are
not read. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.ranking import number_within
from tessera.session import materialize, ship_package

TASK_GROUPS = 50_000
"""Groups, or partial partitions, that one task combines."""


def combine(vectors: list[list[int]]) -> tuple[list[int], list[list[int]]]:
    """Karmarkar-Karp over vectors of one number per shard.

    Returns the sums per shard, and for each vector the shard of each of its places.
    """
    k = len(vectors[0])
    heap = []
    for i, v in enumerate(vectors):
        slots = sorted(((x, (i, j)) for j, x in enumerate(v)), key=lambda s: -s[0])
        heap.append((slots[-1][0] - slots[0][0], i, slots))
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        slots = sorted(((x + y, (p, q)) for (x, p), (y, q) in zip(a, reversed(b), strict=True)), key=lambda s: -s[0])
        heapq.heappush(heap, (slots[-1][0] - slots[0][0], n, slots))
        n += 1
    _, _, slots = heap[0]
    where = [[0] * k for _ in vectors]
    for shard, (_, tree) in enumerate(slots):
        todo = [tree]
        while todo:
            p, q = todo.pop()
            if isinstance(p, int):
                where[p][q] = shard
            else:
                todo += (p, q)
    return [s for s, _ in slots], where


def _local(shards: int):
    """Groups of a task -> rows (group, part, slot) and one row of sums per part."""

    def run(batches):
        from pyspark import TaskContext

        task, seq, held = TaskContext.get().partitionId(), 0, []

        def close(rows):
            sums, where = combine([[n] + [0] * (shards - 1) for _, n in rows])
            part = (task << 20) | seq
            names = [g for g, _ in rows] + [None]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([part] * len(names), pa.int64()), pa.array([w[0] for w in where] + [None], pa.int32()), pa.array([None] * len(rows) + [sums], pa.list_(pa.int64()))],
                names=["name", "part", "slot", "sums"],
            )

        for b in batches:
            held += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            while len(held) >= TASK_GROUPS:
                yield from close(held[:TASK_GROUPS])
                held, seq = held[TASK_GROUPS:], seq + 1
        if held:
            yield from close(held)

    return run


def _level(t: pa.Table) -> pa.Table:
    """Partial partitions of one parent -> where each part's slots went, and the parent's sums."""
    parts = sorted(zip(t.column("part").to_pylist(), t.column("sums").to_pylist(), strict=True))
    sums, where = combine([s for _, s in parts])
    k, parent = len(sums), t.column("parent")[0].as_py()
    return pa.table(
        {
            "part": pa.array([p for p, _ in parts for _ in range(k)] + [parent], pa.int64()),
            "slot": pa.array([j for _ in parts for j in range(k)] + [None], pa.int32()),
            "parent": pa.array([parent] * (len(parts) * k + 1), pa.int64()),
            "parent_slot": pa.array([s for w in where for s in w] + [None], pa.int32()),
            "sums": pa.array([None] * (len(parts) * k) + [sums], pa.list_(pa.int64())),
        }
    )


_LEVEL = "part long, slot int, parent long, parent_slot int, sums array<long>"


def assign_groups(groups: DataFrame, shards: int, task_groups: int = TASK_GROUPS) -> DataFrame:
    """(name, shard) for groups (name string, bytes long)."""
    made = materialize(groups.select("name", "bytes").mapInArrow(_local(shards), "name string, part long, slot int, sums array<long>"), "parts")
    place = made.where("name is not null").select("name", "part", "slot")
    parts = made.where("name is null").select("part", "sums")
    many = parts.count()
    while many > 0:
        up = materialize(parts.withColumn("parent", F.pmod(F.xxhash64("part"), F.lit(-(-many // max(2, task_groups // 8)))).cast("long")).groupBy("parent").applyInArrow(_level, _LEVEL), "levels")
        moved = up.where("slot is not null").select("part", "slot", "parent", "parent_slot")
        place = place.join(moved, ["part", "slot"]).select("name", F.col("parent").alias("part"), F.col("parent_slot").alias("slot"))
        parts = up.where("slot is null").select("part", "sums")
        many = parts.count() if many > 1 else 0
        if many == 1:
            break
    return place.select("name", F.col("slot").alias("shard"))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot (0.. within the shard), grown_shard (null) of each row."""
    ship_package(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.sha2(text.cast("binary"), 256), F.lit("null")).alias("name"),
    )
    rows = materialize(rows, "sizes")
    groups = rows.groupBy("name").agg(F.sum("size").alias("bytes"))
    placed = materialize(rows.join(assign_groups(groups, shards), "name"), "shards")
    out = number_within(placed, "shard", ["doc_id", "name"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
