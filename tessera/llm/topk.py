"""Exact top-k by inner product with dual cover trees.

Vectors become integers (``floor(scale * x)``). A bounded sample of them are
pivots; every vector goes to the cell of its nearest pivot, cells are dealt
into blocks, and each block becomes a cover tree: a node's children are
chosen farthest-first, so they cover its points within a radius and stand at
least that far apart. Queries are treated the same way, so a node of queries
and a node of candidates can be compared at once: no pair below them scores
more than ``q.c + Rq|c| + Rc|q| + Rq Rc``, and if that is less than the worst
kth score in the query node the pair of nodes is skipped. Each query block
first meets the cells around its own, which fixes its scores to beat; of the
other cells it meets only those whose bound reaches the worst of them.

Of equal vectors only the k + 1 smallest ids (repeated ones as often as they
stand) can ever be answers, and equal queries have equal answers, so copies are
searched once however many there are; a query takes its own row out of them. Pivots and cell sizes (at most ``CELLS`` twice, and one for each further
vector length) reach the driver, nothing else.

Vectors that are null, empty, or hold null or non-finite components take no
part, nor do rows without an id; vectors are compared with those of their own
length. Every row counts for itself: rows that share an id, or all, are queries
and candidates each, and a query leaves out its own row alone. Ties go to the
smaller id. Fewer candidates than k give as
many rows; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import blocks as B
from tessera.session import materialize, ship_package

CELLS = 1024
"""Pivots at most; each vector length beyond has a cell of its own around the origin."""
BLOCK = 4096
"""Vectors in a block, about."""
LEAF, FAN = 48, 8
AREA = 1 << 18
"""Products that cost less than the way down to smaller pairs of nodes."""
_EXACT = float(1 << 52)


class CoverTree:
    """Points in tree order, and nodes (centre, radius, range of points, range of children)."""

    def __init__(self, points: np.ndarray):
        self.points = points
        order = np.arange(len(points))
        centre, radius, lo, hi, kids = [], [], [], [], []
        real = points.astype(float)

        def split(part: np.ndarray) -> list[np.ndarray]:
            """Farthest-first centres, each with the points nearest to it."""
            x = real[part]
            near = ((x - x[0]) ** 2).sum(1)
            own = np.zeros(len(part), np.int64)
            for c in range(1, FAN):
                far = int(near.argmax())
                if near[far] == 0:
                    break
                d = ((x - x[far]) ** 2).sum(1)
                closer = d < near
                own[closer] = c
                near = np.minimum(near, d)
            return [part[own == c] for c in range(own.max() + 1)]

        todo = [(0, len(points), -1)]
        parents = []
        while todo:
            a, b, parent = todo.pop()
            part = order[a:b]
            x = real[part]
            node = len(centre)
            c = x.mean(0)
            centre.append(c)
            radius.append(float(np.sqrt(((x - c) ** 2).sum(1).max())))
            lo.append(a)
            hi.append(b)
            parents.append(parent)
            kids.append([])
            if parent >= 0:
                kids[parent].append(node)
            if b - a > LEAF and radius[-1] > 0:
                parts = split(part)
                at = a
                for p in parts:
                    order[at : at + len(p)] = p
                    todo.append((at, at + len(p), node))
                    at += len(p)
        self.order = order
        self.points = points[order]
        self.centre = np.array(centre)
        self.norm = np.sqrt((self.centre**2).sum(1))
        self.radius = np.array(radius)
        self.lo, self.hi, self.kids = np.array(lo), np.array(hi), kids


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows; in floating point where that is exact."""
    if len(a) and len(b) and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < _EXACT:
        return np.rint(a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def _merge(best: np.ndarray, best_id: np.ndarray, at: np.ndarray, s: np.ndarray, ids: np.ndarray, worst: np.ndarray) -> None:
    """Takes the scores ``s`` of the queries ``at`` with ``ids`` into their k best; only those that reach both the k best of ``s`` and ``worst`` are sorted."""
    k = best.shape[1]
    least = worst[at] if s.shape[1] <= k else np.maximum(worst[at], np.partition(s, s.shape[1] - k, axis=1)[:, -k])
    i, j = np.nonzero(s >= least[:, None])
    q = np.concatenate([np.repeat(np.arange(len(at)), k), i])
    alls = np.concatenate([best[at].ravel(), s[i, j]])
    alli = np.concatenate([best_id[at].ravel(), ids[j]])
    o = np.lexsort((alli, ~alls, q))  # ~x orders as -x and has no overflow
    q = q[o]
    first = np.searchsorted(q, np.arange(len(at)))
    o = o[first[:, None] + np.arange(k)]  # each query has its k old ones at least
    best[at], best_id[at] = alls[o], alli[o]
    worst[at] = np.maximum(worst[at], best[at, k - 1])


def search(queries: CoverTree, cands: CoverTree, ids: np.ndarray, k: int, floor: np.ndarray):
    """(query, score, id) of candidates that may be among the k best of each query.

    ``floor``: scores that each query already has k answers at or above
    (lowest number where it hasn't); queries and ids in tree order. Children
    are visited by their bound, best first; a pair of nodes of ``AREA``
    products or fewer is multiplied out at once.
    """
    nq = len(queries.points)
    best = np.full((nq, k), np.iinfo(np.int64).min)
    best_id = np.full((nq, k), np.iinfo(np.int64).max)
    worst = floor.copy()
    todo = [(0, 0)]
    while todo:
        q, c = todo.pop()
        qa, qb, ca, cb = queries.lo[q], queries.hi[q], cands.lo[c], cands.hi[c]
        bound = queries.centre[q] @ cands.centre[c] + queries.radius[q] * cands.norm[c] + cands.radius[c] * queries.norm[q] + queries.radius[q] * cands.radius[c]
        if bound + 1e-6 * (1 + abs(bound)) < worst[qa:qb].min():
            continue
        qk, ck = queries.kids[q], cands.kids[c]
        if not qk and not ck or (qb - qa) * (cb - ca) <= AREA:
            s = product(queries.points[qa:qb], cands.points[ca:cb])
            some = np.flatnonzero((s >= worst[qa:qb, None]).any(1))
            if len(some):
                _merge(best, best_id, qa + some, s[some], ids[ca:cb], worst)
            continue
        pairs = [(x, c) for x in qk] if qk and (not ck or queries.radius[q] >= cands.radius[c]) else [(q, y) for y in ck]
        if pairs[0][0] == q:
            score = cands.centre[ck] @ queries.centre[q]
            pairs = [pairs[i] for i in np.argsort(score, kind="stable")]  # the last is visited first
        todo += pairs
    q, j = np.nonzero((best_id != np.iinfo(np.int64).max) & (best >= floor[:, None]))
    return q, best[q, j], best_id[q, j]


def _first_ids(keep: int):
    """Per task: each vector once, with its smallest ids (bounded, so copies don't add up)."""

    def run(batches):
        held: dict = {}

        def flush():
            keys = list(held)
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([sorted(held[x])[:keep] for x in keys], pa.list_(pa.int64()))], names=["v", "ids"])
            held.clear()
            return out

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                key = np.array(v, np.int64).tobytes()
                own = held.setdefault(key, [])
                own.append(i)
                if len(own) > 4 * keep:
                    held[key] = sorted(own)[:keep]
            if len(held) > 20_000:
                yield flush()
        if held:
            yield flush()

    return run


def _assign(pivots: dict[int, np.ndarray]):
    """Nearest pivot of the same length, and the distance; a pivot without components is the origin."""

    def run(batches):
        for b in batches:
            cell, dist, norm = [], [], []
            for v in b.column(0).to_pylist():
                x = np.frombuffer(v, np.int64).astype(float)
                base, p = pivots[len(x)]
                p = p if p.shape[1] else np.zeros((1, len(x)))
                d = ((p - x) ** 2).sum(1)
                i = int(d.argmin())
                cell.append(base + i)
                dist.append(float(np.sqrt(d[i])))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(dist, pa.float64())], names=[*b.schema.names, "cell", "dist"])

    return run


def _matrix(vs: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.int64) for v in vs]) if vs else np.zeros((0, 0), np.int64)


_ROW = "cell int, part int, radius double, payload binary"


def _block(keep_ids: bool):
    def run(t: pa.Table) -> pa.Table:
        v = t.column("v").to_pylist()
        cols = {"v": pa.array(v, pa.binary())}
        if keep_ids:
            cols["ids"] = t.column("ids")
        return pa.table(
            {
                "cell": pa.array(t.column("cell")[:1].to_pylist(), pa.int32()),
                "part": pa.array(t.column("part")[:1].to_pylist(), pa.int32()),
                "radius": pa.array([max(t.column("dist").to_pylist())], pa.float64()),
                "payload": pa.array([B.pack(**cols)], pa.binary()),
            }
        )

    return run


def _meet(k: int):
    """One block of queries against one of candidates -> (v, score, id)."""
    lowest = np.iinfo(np.int64).min

    def tree(held: dict, payload: bytes, many: int):
        """The block's tree; a block meets several others, so the last few are held."""
        if payload not in held:
            if len(held) >= many:
                held.clear()
            t = B.unpack(payload)
            v = t.column("v").to_pylist()
            if "ids" not in t.column_names:
                held[payload] = (CoverTree(_matrix(v)), v)
            else:
                lists = t.column("ids").to_pylist()
                made = CoverTree(np.repeat(_matrix(v), [len(x) for x in lists], axis=0))
                held[payload] = (made, np.array([i for x in lists for i in x], np.int64)[made.order])
        return held[payload]

    def run(batches):
        asked, there = {}, {}
        for b in batches:
            for qp, fp, cp in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                queries, qv = tree(asked, qp, 32)
                cands, ids = tree(there, cp, 8)
                floor = np.frombuffer(fp, np.int64) if fp else np.full(len(qv), lowest)
                q, s, i = search(queries, cands, ids, k, floor[queries.order])
                yield pa.RecordBatch.from_arrays([pa.array([qv[x] for x in queries.order[q].tolist()], pa.binary()), pa.array(s), pa.array(i)], names=["v", "score", "vec_id"])

    return run


def _best(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("v").orderBy(F.col("score").desc(), F.col("vec_id"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exact_top_k(table: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each row whose vec_id is divisible by ``every``."""
    spark = table.sparkSession
    ship_package(spark)
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where((F.size("embedding") > 0) & fine)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))

    points = rows.mapInArrow(_first_ids(k + 1), "v binary, ids array<long>").groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    points = materialize(points, "points")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)

    def packed(batches):
        for b in batches:
            v = [np.array(v, np.int64) for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in v], pa.binary()), pa.array([int(x @ x) for x in v], pa.int64())], names=["query_id", "v", "own"])

    asked = materialize(asked.mapInArrow(packed, "query_id long, v binary, own long"), "asked")
    want = k + 1  # a query's own row is left out of its answers afterwards

    many = points.count()
    if not many:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    chosen = points.select("v").orderBy(F.xxhash64("v")).limit(min(CELLS, -(-many // BLOCK))).collect()
    lengths = points.select((F.octet_length("v") / 8).cast("int").alias("n"), "v").groupBy("n").agg(F.min("v").alias("v")).orderBy("n").limit(CELLS).collect()
    groups: dict[int, list] = {}
    for r in [*lengths, *chosen]:
        x = np.frombuffer(r["v"], np.int64)
        groups.setdefault(len(x), []).append(x)
    pivots, centre = {}, []
    for r in points.select((F.octet_length("v") / 8).cast("int").alias("n")).distinct().collect():
        groups.setdefault(r["n"], [np.zeros(0, np.int64)])  # the origin of the lengths beyond the first CELLS
    length = []
    for n, of_n in sorted(groups.items()):
        pivots[n] = (len(centre), np.stack(of_n).astype(float))
        centre += list(pivots[n][1])
        length += [n] * len(of_n)

    def dealt(df: DataFrame, size: int) -> tuple[DataFrame, dict]:
        cells = materialize(df.mapInArrow(_assign(pivots), f"{', '.join(f'{a} {t}' for a, t in df.dtypes)}, cell int, dist double"), "cells")
        stats = {r["cell"]: r for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius")).collect()}
        parts = F.element_at(F.array(*[F.lit(-(-stats[c]["n"] // size) if c in stats else 1) for c in range(len(centre))]), F.col("cell") + 1)
        return cells.withColumn("part", F.pmod(F.xxhash64("v"), parts).cast("int")), stats

    cands, stats = dealt(points, BLOCK)
    queries, _ = dealt(asked.select("v").distinct(), BLOCK)
    cands = materialize(cands.groupBy("cell", "part").applyInArrow(_block(True), _ROW), "candidates")
    queries = materialize(queries.groupBy("cell", "part").applyInArrow(_block(False), _ROW), "queries")

    # Cells by the score of their centres, as many as hold the candidates wanted: the first to meet.
    first: dict[int, list[int]] = {}
    for n, (base, p) in pivots.items():
        score = p @ p.T
        for i in range(len(p)):
            own, held = [], 0
            for j in [i, *np.argsort(-score[i], kind="stable").tolist()]:
                if base + j not in own and base + j in stats:
                    own.append(base + j)
                    held += stats[base + j]["n"]
                if held >= want:
                    break
            first[base + i] = own
    near = spark.createDataFrame([(c, x) for c, own in first.items() for x in own], "cell int, target int")
    right = cands.select(F.col("cell").alias("target"), F.col("payload").alias("c"))
    pairs = queries.join(F.broadcast(near), "cell").join(right, "target").select("payload", F.lit(None).cast("binary").alias("floor"), "c")
    one = materialize(_best(pairs.mapInArrow(_meet(want), "v binary, score long, vec_id long"), want), "first")

    # Scores to beat, and the cells that may hold more.
    reach = {c: (np.array(centre[c]), stats[c]["radius"]) for c in stats}

    def ask(batches):
        lowest = np.iinfo(np.int64).min
        for b in batches:
            out = []
            for cell, radius, payload, kth in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                have = {x["v"]: x["s"] for x in kth or []}
                floor = np.array([have.get(v, lowest) for v in B.unpack(payload).column("v").to_pylist()], np.int64)
                q = np.array(centre[cell])
                for c, (p, r) in reach.items():
                    if length[c] != length[cell] or c in first[cell]:
                        continue
                    bound = q @ p + radius * np.sqrt(p @ p) + r * np.sqrt(q @ q) + radius * r
                    if bound + 1e-6 * (1 + abs(bound)) >= floor.min():
                        out.append((c, payload, floor.tobytes()))
            t, p, f = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(p, pa.binary()), pa.array(f, pa.binary())], names=["target", "payload", "floor"])

    def members(batches):
        for b in batches:
            out = [(c, p, v) for c, p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True) for v in B.unpack(x).column("v").to_pylist()]
            c, p, v = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(p, pa.int32()), pa.array(v, pa.binary())], names=["cell", "part", "v"])

    kth = one.where(F.col("rank") == want).select("v", F.col("score").alias("s"))
    of = queries.select("cell", "part", "payload").mapInArrow(members, "cell int, part int, v binary")
    kth = of.join(kth, "v").groupBy("cell", "part").agg(F.collect_list(F.struct("v", "s")).alias("kth"))
    more = queries.join(kth, ["cell", "part"], "left").select("cell", "radius", "payload", "kth").mapInArrow(ask, "target int, payload binary, floor binary")
    pairs = more.join(right, "target").select("payload", "floor", "c")
    two = pairs.mapInArrow(_meet(want), "v binary, score long, vec_id long")

    best = _best(one.select("v", "score", "vec_id").unionByName(two), want)
    lists = best.groupBy("v").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))).alias("best"))
    # where its own row is among the best, one row of its id and score goes: whichever, they are alike
    at = F.array_position(F.transform("best", lambda x: (x["vec_id"] == F.col("query_id")) & (x["less"] == -F.col("own"))), True).cast("int")
    rest = F.when(at > 0, F.concat(F.slice("best", 1, F.greatest(at - 1, F.lit(0))), F.slice("best", at + 1, F.lit(want)))).otherwise(F.col("best"))
    out = asked.join(lists, "v").select("query_id", F.slice(rest, 1, k).alias("best"))
    out = out.select("query_id", F.posexplode("best").alias("place", "hit"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.less")).alias("score"))
