"""Near-duplicate embeddings against all pairs."""

import math
import random

import numpy as np
import pytest

from tessera.llm import near_vectors as N
from tests.llm.conftest import same

EMB = "vec_id long, embedding array<float>, label int, lead double, panel int"


def table(spark, rows, ddl=EMB):
    return spark.createDataFrame([(i, v, label, 0.5, 3) for i, v, label in rows], ddl)


def brute(rows, least=0.93, kind=np.float32):
    ok, mats = {}, {}
    for n, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v):
            ok.setdefault((label, len(v)), []).append(n)
    up = list(range(len(rows)))
    links = [0] * len(rows)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for own in ok.values():
        m = np.array([rows[n][1] for n in own], kind).astype(float)
        m /= np.abs(m).max(1)[:, None]
        m /= np.sqrt((m * m).sum(1))[:, None]
        near = m @ m.T >= least
        for a, b in zip(*np.nonzero(np.triu(near, 1))):
            x, y = own[a], own[b]
            links[x] += 1
            links[y] += 1
            p, q = find(x), find(y)
            up[max(p, q)] = min(p, q)
    comp = {}
    for n, r in enumerate(rows):
        comp.setdefault(find(n), []).append(r[0])
    least_of = {k: min((x for x in v if x is not None), default=None) for k, v in comp.items()}
    return [(r[0], links[n], least_of[find(n)], r[0] == least_of[find(n)]) for n, r in enumerate(rows)]


def vectors(n, seed, dim=24, labels=4):
    """Random vectors, chains of near ones, crowded clusters and copies."""
    r = np.random.default_rng(seed)
    rows = [(i, r.normal(size=dim).tolist(), int(r.integers(labels))) for i in range(n)]
    base = r.normal(size=(6, dim))
    at = n
    for c, b in enumerate(base):
        for _ in range(60):
            rows.append((at, (b + r.normal(size=dim) * 0.12 * (c + 1)).tolist(), c % labels))
            at += 1
    x = r.normal(size=dim)
    for _ in range(40):  # a chain: neighbours are near, ends are not
        x = x / np.linalg.norm(x) + r.normal(size=dim) * 0.05
        rows.append((at, x.tolist(), 1))
        at += 1
    rows += [(at + i, rows[5][1], rows[5][2]) for i in range(150)] + [(at + 200 + i, [2 * y for y in rows[5][1]], rows[5][2]) for i in range(5)]
    random.Random(seed).shuffle(rows)
    return rows


ODD = [
    (9001, None, 1), (9002, [], 1), (9003, [0.0] * 24, 1), (9004, [float("nan")] * 24, 1), (9005, [float("inf")] + [0.0] * 23, 1), (9006, [None] + [1.0] * 23, 1),
    (9007, [1.0] * 24, None), (9008, [1.0, 2.0], 1), (9009, [2.0, 4.0], 1), (9010, [1.0, -2.0], 1), (9011, [3e38] * 24, 2), (9012, [1e-38] * 24, 2), (9013, [1e-44] * 24, 2), (9014, [5.0], 0), (9015, [-5.0], 0), (9016, [-0.0, 1.0], 0), (9017, [0.0, 1.0], 0),
    (None, [1.0, 2.0], 1), (None, None, 1), (None, [7.0, -7.0, 7.0], 3), (None, [7.0, -7.0, 7.0], 3), (9008, [1.0, 2.0], 1), (9008, [-2.0, 1.0], 1), (-5, [1.0, 2.1], 1),
]


@pytest.mark.parametrize("panel", [4096, 70])
def test_links_and_components_equal_all_pairs(spark, monkeypatch, panel):
    monkeypatch.setattr(N, "TILE", 32)
    rows = vectors(900, panel) + ODD
    got = N.near_vectors(table(spark, rows).repartition(5), panel=panel)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = [(*w[:3], w[2] is None or w[3]) for w in brute(rows)]
    assert same([tuple(r) for r in got.collect()], want)


def test_doubles_and_other_thresholds(spark):
    rows = vectors(200, 3, dim=40, labels=2) + [(7000 + i, [1e200 * (i + 1)] * 40, 0) for i in range(3)]
    df = table(spark, rows, EMB.replace("float", "double"))
    assert same([tuple(r) for r in N.near_vectors(df, 0.5).collect()], brute(rows, 0.5, np.float64))
    with pytest.raises(ValueError):
        N.near_vectors(df, 0)


def test_no_rows_and_none_that_count(spark):
    assert N.near_vectors(table(spark, [])).collect() == []
    got = N.near_vectors(table(spark, [(1, None, 1), (2, [0.0], 2)])).collect()
    assert same([tuple(r) for r in got], [(1, 0, 1, True), (2, 0, 2, True)])


def test_bound_never_drops_a_pair():
    """Slab by slab or at once: the same pairs, also where suffix norms are all that counts."""
    r = np.random.default_rng(4)
    v = np.concatenate([r.normal(size=(150, 48)), np.repeat(r.normal(size=(5, 48)), 10, 0) + 0.08 * r.normal(size=(50, 48))])
    basis = np.linalg.qr(r.normal(size=(48, N.LEAD)))[0]  # any orthonormal axes are right
    row = N._panel(1, "x", 48, N.pa.array(range(len(v))), v, basis)
    p = N._Panel(1, row["vectors"][0], 48, basis)
    i, j = N._linked(p, slice(0, 200), p, slice(0, 200), 0.93)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(p.unit @ p.unit.T >= 0.93))))
