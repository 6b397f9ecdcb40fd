"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors of equal label and length are compared by cosine, all of them. Their
second moments, summed over all rows, give the principal axes. Rows are dealt
out by ranges of label, length and place on the first axis, and packed into
*panels* of distinct vectors (copies beside each other are one vector with a
count). A panel is cut along its widest axes into *tiles*.

Two panels are compared unless their boxes on the leading axes lie farther
apart than linked unit vectors can, and so are two tiles. A tile pair adds up
the products of the leading axes first, slab by slab: what the rest can add is
at most the product of the two suffix norms, so a pair of vectors is left as
soon as sum and bound together miss the threshold. Pairs that come through are
decided by the cosine of the vectors as given.

Links are never listed. A tile pair counts each vector's links as products
with the other side's counts, and its components go into a forest, so a pair
of panels tells at most one row for each of its vectors, however many links
they have. Forests meet in ``components``. A panel is moved once for each panel
that it must be compared with; what reaches the driver are the moments of each
vector length, and counts.

Edge cases. A row whose vector is null, empty, zero or holds null or
non-finite components, or whose label is null, links with nothing, nor do
vectors of different lengths. Rows equal in vector and label link with each
other, each counts for itself, also under one ``vec_id``. A null ``vec_id`` is
a row like others that names a component only where it holds no other id; such
a component's id is null, and its rows are kept. Other columns are not read,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import pack, release, unpack
from tessera.llm.components import components
from tessera.session import materialize, ship_package

LEAD = 32
"""Leading axes; slabs end at 8, 16 and 32 of them."""
SLABS = (8, 16, 32)
PANEL, TILE = 4096, 256
"""Distinct vectors of a panel and of a tile, at most."""
PANEL_ROWS = 1 << 18
"""Rows of a panel, at most (copies included)."""
PART_BYTES = 64 << 20
"""Bytes of vectors in a range."""
PAIRS = 8
"""Panel pairs that a task compares, about."""
SPLIT = 512
"""Panels of one label that a panel is held against in one place."""
_PLACE = 13  # a vector's number is panel << 13 | place in its panel; a panel's is task << 24 | place in its task
_EPS = 1e-9


def unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows scaled by powers of two so that nothing overflows, their norms, unit rows), in doubles."""
    v = v.astype(np.float64)
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, initial=0.0))[1][:, None])
    n = np.sqrt((v * v).sum(1))
    return v, n, v / n[:, None]


def _matrix(col: pa.Array) -> np.ndarray:
    """Vectors of equal length as a matrix."""
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Leading principal axes (columns) for each vector length, from the second moments of all unit vectors.

    ``vectors``: ``dim``, ``v``. A length's moments (its square of numbers) come to the driver.
    """

    def moments(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d in np.unique(b.column(0).to_numpy()).tolist():
                u = unit(_matrix(b.column(1).filter(pa.array(b.column(0).to_numpy() == d))))[2]
                total[d] = total.get(d, 0) + u.T @ u
        for d, m in total.items():
            yield pa.RecordBatch.from_pydict({"dim": pa.array([d] * d, pa.int32()), "i": pa.array(range(d), pa.int32()), "m": [r.tobytes() for r in m]})

    def add(t: pa.Table) -> pa.Table:
        m = np.sum([np.frombuffer(x) for x in t.column("m").to_pylist()], axis=0)
        return t.slice(0, 1).set_column(2, "m", pa.array([m.tobytes()], pa.binary()))

    sent = vectors.select("dim", "v").mapInArrow(moments, "dim int, i int, m binary")
    rows: dict[int, dict] = {}
    for r in sent.groupBy("dim", "i").applyInArrow(add, "dim int, i int, m binary").collect():
        rows.setdefault(r.dim, {})[r.i] = np.frombuffer(r.m)
    return {d: np.ascontiguousarray(np.linalg.eigh(np.stack([m[i] for i in range(d)]))[1][:, ::-1][:, :LEAD]) for d, m in rows.items()}


# -- panels ------------------------------------------------------------------


def _tiles(p: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Order of points, and where tiles end, by halving along the widest axis."""
    order, ends, todo = np.arange(len(p)), [], [(0, len(p))]
    while todo:
        a, b = todo.pop()
        if b - a <= TILE:
            ends.append(b)
            continue
        part = p[order[a:b]]
        axis = int(np.argmax(part.max(0) - part.min(0)))
        mid = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(part[:, axis], mid)]
        todo += [(a + mid, b), (a, a + mid)]
    return order, sorted(ends)


def _panel(number: int, label: str, d: int, ids: pa.Array, v: np.ndarray, basis: np.ndarray) -> dict:
    """One panel's row: members (ids, and each one's vector), distinct vectors in tile order, box."""
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]).any(1)
    own = np.cumsum(new) - 1
    v = v[new]
    p = unit(v)[2] @ basis
    order, ends = _tiles(p)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    place = back[own]
    known = np.asarray(ids.is_valid())
    id_of = ids.fill_null(0).to_numpy()
    none, least = np.ones(len(v), bool), np.full(len(v), np.iinfo(np.int64).max)
    none[place[known]] = False
    np.minimum.at(least, place[known], id_of[known])
    least[none] = 0
    vectors = pack(v=pa.array([v[order].tobytes()], pa.binary()), kind=[v.dtype.str], least=pa.array([least.tobytes()], pa.binary()), none=pa.array([none.tobytes()], pa.binary()),
                   count=pa.array([np.bincount(place, minlength=len(v)).astype(np.int64).tobytes()], pa.binary()), ends=[ends])
    return {"panel": [number], "label": [label], "dim": pa.array([d], pa.int32()), "lo": [p.min(0).tolist()], "hi": [p.max(0).tolist()],
            "members": [pack(vec_id=ids, place=place.astype(np.int32))], "vectors": [vectors]}


def _panels(bases: dict[int, np.ndarray], distinct: int):
    """Sorted rows (label, dim, vec_id, v) as panels."""

    def run(batches):
        from pyspark import TaskContext

        number, key, held, rows, kinds = TaskContext.get().partitionId() << 24, None, [], 0, 0

        def close():
            nonlocal number, held, rows, kinds
            ids = pa.concat_arrays([i for i, _ in held])
            out = pa.RecordBatch.from_pydict(_panel(number, *key, ids, np.concatenate([m for _, m in held]), bases[key[1]]))
            number, held, rows, kinds = number + 1, [], 0, 0
            release()
            return out

        for b in batches:
            label, dim = b.column(0), b.column(1)
            at, lab = 0, label.to_pylist()
            dims = dim.to_pylist()
            for i in range(1, b.num_rows + 1):
                if i < b.num_rows and lab[i] == lab[at] and dims[i] == dims[at]:
                    continue
                if key != (lab[at], dims[at]):
                    if held:
                        yield close()
                    key = (lab[at], dims[at])
                ids, m = b.column(2).slice(at, i - at), _matrix(b.column(3).slice(at, i - at))
                fresh = np.ones(len(m), bool)
                fresh[1:] = (m[1:] != m[:-1]).any(1)
                if held:
                    fresh[0] = bool((held[-1][1][-1] != m[0]).any())
                lo = 0
                while lo < len(m):
                    seen = np.cumsum(fresh[lo:]) + kinds
                    hi = lo + min(PANEL_ROWS - rows, int(np.searchsorted(seen, distinct, side="right")))
                    if hi > lo:
                        held.append((ids.slice(lo, hi - lo), m[lo:hi]))
                        rows, kinds = rows + hi - lo, int(seen[hi - lo - 1])
                    if hi < len(m):
                        yield close()
                        fresh[hi] = True
                    lo = hi
                at = i
        if held:
            yield close()

    return run


class _Panel:
    """A panel's vectors, ready to be compared."""

    def __init__(self, number: int, payload: bytes, d: int, basis: np.ndarray):
        t = unpack(payload).to_pylist()[0]
        self.number = number
        self.raw, self.norm, u = unit(np.frombuffer(t["v"], np.dtype(t["kind"])).reshape(-1, d))
        self.unit, self.lead = u, u @ basis
        self.rest = [np.sqrt(np.maximum(0.0, 1.0 - (self.lead[:, :k] ** 2).sum(1))) for k in SLABS]
        self.least, self.none, self.count = np.frombuffer(t["least"], np.int64), np.frombuffer(t["none"], bool), np.frombuffer(t["count"], np.int64)
        self.tiles = [slice(a, b) for a, b in zip([0, *t["ends"]], t["ends"])]
        self.lo = np.array([self.lead[s].min(0) for s in self.tiles])
        self.hi = np.array([self.lead[s].max(0) for s in self.tiles])


def _linked(a: _Panel, s: slice, b: _Panel, t: slice, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in the two tiles of the pairs whose cosine is at least ``least``."""
    x, y = a.lead[s], b.lead[t]
    dot, lo, i, j = np.zeros((len(x), len(y))), 0, None, None
    for k, ra, rb in zip(SLABS, a.rest, b.rest):
        if i is None:
            dot += x[:, lo:k] @ y[:, lo:k].T
            alive = dot + ra[s][:, None] * rb[t][None, :] >= least - _EPS
            n = np.count_nonzero(alive)
            if not n:
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            if n * 8 < alive.size:  # few are left: one by one from here
                i, j = np.nonzero(alive)
                dot = dot[i, j]
        else:
            dot += np.einsum("nk,nk->n", x[i, lo:k], y[j, lo:k])
            on = dot + ra[s][i] * rb[t][j] >= least - _EPS
            i, j, dot = i[on], j[on], dot[on]
        lo = k
        if k >= x.shape[1]:
            break
    if i is None:
        near = a.unit[s] @ b.unit[t].T
        i, j = np.nonzero(near >= least - _EPS)
    if not len(i):
        return i, j
    got = np.empty(len(i))
    for c in range(0, len(i), 1 << 14):
        p, q = i[c : c + (1 << 14)], j[c : c + (1 << 14)]
        got[c : c + (1 << 14)] = np.einsum("nk,nk->n", a.raw[s][p], b.raw[t][q]) / (a.norm[s][p] * b.norm[t][q])
    on = got >= least
    return i[on], j[on]


class _Forest:
    """Union-find over the vectors of one or two panels."""

    def __init__(self, size: int):
        self.up = list(range(size))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        """Unites x[n] and y[n]; dense links are reduced to a tree by spreading the smallest number first."""
        if len(x) > 4 * (len(np.unique(x)) + len(np.unique(y))):
            names, at = np.unique(np.concatenate([x, y]), return_inverse=True)
            p, q, low = at[: len(x)], at[len(x) :], np.arange(len(names))
            while True:
                m = np.minimum(low[p], low[q])
                new = low.copy()
                np.minimum.at(new, p, m)
                np.minimum.at(new, q, m)
                if (new == low).all():
                    break
                low = new
            x, y = names, names[low]
        for a, b in zip(x.tolist(), y.tolist()):
            a, b = self.find(a), self.find(b)
            if a != b:
                self.up[max(a, b)] = min(a, b)


_LINKS = pa.schema([("panel", pa.int64()), ("place", pa.int32()), ("links", pa.int64()), ("none", pa.bool_()), ("least", pa.int64()), ("to", pa.int64())])


def _compared(a: _Panel, b: _Panel, least: float) -> pa.RecordBatch:
    """A row for each vector with a link between two panels (or within one): its links, and a vector of its component here."""
    same, reach = a.number == b.number, 2 - 2 * least + _EPS
    na, size = len(a.norm), len(a.norm) + (0 if a.number == b.number else len(b.norm))
    shift = 0 if same else na
    links, forest = np.zeros(size, np.int64), _Forest(size)
    for m, s in enumerate(a.tiles):
        gap = np.maximum(0.0, np.maximum(a.lo[m] - b.hi, b.lo - a.hi[m]))
        for n in np.flatnonzero((gap * gap).sum(1) <= reach).tolist():
            if same and n < m:
                continue
            t = b.tiles[n]
            i, j = _linked(a, s, b, t, least)
            if same and n == m:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            x, y = i + s.start, j + t.start
            np.add.at(links, x, b.count[y])
            np.add.at(links, y + shift, a.count[x])
            forest.join(x, y + shift)
    on = np.flatnonzero(links)
    root = np.array([forest.find(i) for i in on.tolist()], np.int64)
    number = np.where(np.arange(size) < na, (a.number << _PLACE) | np.arange(size), (b.number << _PLACE) | (np.arange(size) - shift))
    none, low = (a.none, a.least) if same else (np.concatenate([a.none, b.none]), np.concatenate([a.least, b.least]))
    cols = [number[on] >> _PLACE, (number[on] & ((1 << _PLACE) - 1)).astype(np.int32), links[on], none[on], low[on], number[root]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _LINKS, strict=True)], schema=_LINKS)


def _compare(bases: dict[int, np.ndarray], least: float):
    def run(batches):
        held: dict[int, _Panel] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                d, na, nb = (batch.column(c)[r].as_py() for c in ("dim", "a", "b"))
                held = {k: held[k] for k in (na, nb) if k in held}
                for n, c in ((na, "va"), (nb, "vb")):
                    if n not in held:
                        held[n] = _Panel(n, batch.column(c)[r].as_py(), d, bases[d])
                out = _compared(held[na], held[nb], least)
                if out.num_rows:
                    yield out
        release()

    return run


# -- the operator --------------------------------------------------------------


def _valid(v: str):
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(v).isNotNull() & (F.size(v) > 0) & ok & F.exists(v, lambda x: x != 0) & F.col("label").isNotNull(), F.lit(False))


def panels(vectors: DataFrame, bases: dict[int, np.ndarray], distinct: int = PANEL) -> DataFrame:
    """Panels of ``vectors`` (vec_id, label, dim, v), written: panel, label, dim, box, members, vectors."""
    kind = vectors.schema["v"].dataType.simpleString()
    wide = 8 if "double" in kind else 4

    def lead(batches):
        for b in batches:
            place, dims = np.zeros(b.num_rows), b.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                on = dims == d
                place[on] = unit(_matrix(b.column("v").filter(pa.array(on))))[2] @ bases[d][:, 0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.round(place, 9))], names=[*b.schema.names, "lead"])

    total = vectors.agg(F.sum(F.col("dim").cast("long"))).first()[0] or 0
    parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total * wide // PART_BYTES))
    # the row's own number comes last, so that copies in any number are dealt over ranges
    placed = vectors.withColumn("row", F.monotonically_increasing_id()).withColumn("hash", F.xxhash64("v"))
    placed = placed.select("label", "dim", "vec_id", "v", "hash", "row").mapInArrow(lead, f"label string, dim int, vec_id long, v {kind}, hash long, row long, lead double")
    order = ["label", "dim", "lead", "hash", "row"]
    dealt = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("label", "dim", "vec_id", "v")
    out = "panel long, label string, dim int, lo array<double>, hi array<double>, members binary, vectors binary"
    return materialize(dealt.mapInArrow(_panels(bases, distinct), out), "panels")


def panel_pairs(made: DataFrame, least: float) -> DataFrame:
    """(a, b, dim) of the panels of a label whose boxes lie near enough, a <= b."""
    most = made.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 1
    salts = -(-most // SPLIT)
    box = made.select("panel", "label", "dim", "lo", "hi")
    a = box.select(F.col("panel").alias("a"), "label", "dim", F.col("lo").alias("la"), F.col("hi").alias("ha"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    b = box.select(F.col("panel").alias("b"), "label", "dim", F.col("lo").alias("lb"), F.col("hi").alias("hb"), F.pmod(F.xxhash64("panel"), F.lit(salts)).cast("int").alias("salt"))
    gaps = F.zip_with(F.zip_with("la", "hb", lambda x, y: x - y), F.zip_with("lb", "ha", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    return a.join(b, ["label", "dim", "salt"]).where((F.col("a") <= F.col("b")) & (apart <= F.lit(2 - 2 * least + _EPS))).select("a", "b", "dim")


def near_vectors(vectors: DataFrame, threshold: float = 0.93, panel: int = PANEL) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding, label)."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    if not 0 < panel <= 1 << _PLACE:
        raise ValueError(f"a panel holds 1 to {1 << _PLACE} vectors")
    ship_package(vectors.sparkSession)
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(kind).alias("v"))
    rest = src.where(~_valid("v")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    good = src.where(_valid("v")).withColumn("dim", F.size("v"))

    bases = axes(good)
    made = panels(good, bases, panel)
    pairs = materialize(panel_pairs(made, threshold), "pairs")
    tasks = max(int(src.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs.count() // PAIRS))
    va, vb = made.select(F.col("panel").alias("a"), F.col("vectors").alias("va")), made.select(F.col("panel").alias("b"), F.col("vectors").alias("vb"))
    met = pairs.join(va, "a").repartition(tasks, "b", "a").join(vb, "b").select("dim", "a", "b", "va", "vb")
    ddl = "panel long, place int, links long, none boolean, least long, to long"
    found = materialize(met.mapInArrow(_compare(bases, threshold), ddl), "links")

    number = F.shiftleft("panel", _PLACE) + F.col("place")
    named = components(found.select(number.alias("a"), F.col("to").alias("b"))).withColumnRenamed("id", "number")
    counts = found.groupBy("panel", "place").agg(F.sum("links").alias("links"), F.min(F.struct("none", "least")).alias("id")).withColumn("number", number)
    told = materialize(counts.join(named, "number"), "components")
    least = told.groupBy("component").agg(F.min("id").alias("of"))  # ids before none
    told = told.join(least, "component").select("panel", "place", "links", F.when(~F.col("of.none"), F.col("of.least")).alias("component"))

    def members(own: pa.Table, told: pa.Table) -> pa.Table:
        schema = pa.schema([("vec_id", pa.int64()), ("n_links", pa.int64()), ("component_id", pa.int64()), ("kept", pa.bool_())])
        if not own.num_rows:
            return schema.empty_table()
        t, v = unpack(own.column("members")[0].as_py()), unpack(own.column("vectors")[0].as_py()).to_pylist()[0]
        place, count = t.column("place").to_numpy(), np.frombuffer(v["count"], np.int64)
        links, comp, none = count - 1, np.frombuffer(v["least"], np.int64).copy(), np.frombuffer(v["none"], bool).copy()
        at = told.column("place").to_numpy()
        links[at] += told.column("links").to_numpy()
        none[at] = np.asarray(told.column("component").is_null())
        comp[at] = told.column("component").fill_null(0).to_numpy()
        ids, comp = t.column("vec_id").combine_chunks(), pa.array(comp[place], mask=none[place])
        known = np.asarray(ids.is_valid())
        kept = np.where(none[place], True, known & (ids.fill_null(0).to_numpy() == comp.fill_null(0).to_numpy()))
        return pa.table([ids, pa.array(links[place]), comp, pa.array(kept)], schema=schema)

    each = made.select("panel", "members", "vectors").groupBy("panel").cogroup(told.groupBy("panel"))
    return each.applyInArrow(members, "vec_id long, n_links long, component_id long, kept boolean").unionByName(rest)
