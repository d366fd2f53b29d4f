"""The mesh queries over the whole event grid, against numpy on the smallest tables."""

import itertools

import numpy as np
import pytest

from entrofield.plans import registry
from entrofield.plans.meshes import KUHN

N = 10


@pytest.fixture(scope="module")
def whole(spark, sf):
    """Values, and of each tetrahedron its id and corners' ids."""
    f = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value").toPandas().sort_values("event_id").value.to_numpy()
    cells = {}
    for z, y, x in itertools.product(range(len(f) // 100 - 1), range(N - 1), range(N - 1)):
        base = (z * N + y) * N + x
        for k, t in enumerate(KUHN):
            cells[base * 6 + k] = [base + (c & 1) + N * (c >> 1 & 1) + N * N * (c >> 2) for c in t]
    return f, np.array(list(cells)), np.array(list(cells.values()))


def at(ids):
    return np.stack([ids % N, ids // N % N, ids // (N * N)], -1).astype(float)


def shares(f, edges):
    """Share of each tetrahedron's volume between edges, from sums of truncated cubes; equal values are set a little apart."""
    f = np.sort(f, 1) + np.arange(4) * 1e-4
    w = [np.prod([f[:, j] - f[:, i] for j in range(4) if j != i], axis=0) for i in range(4)]
    below = np.stack([np.clip(sum(np.maximum(t - f[:, i], 0) ** 3 / w[i] for i in range(4)), 0, 1) for t in edges], 1)
    below[:, 0], below[:, -1] = 0, 1
    return np.diff(below, axis=1)


def entropy(h):
    p = h[h > 0] / h.sum()
    return -(p * np.log2(p)).sum()


def test_global_entropies(spark, sf, whole):
    f, _, ids = whole
    share = shares(f[ids], np.linspace(f.min(), f.max(), 41))
    assert registry.QUERIES["e11_mesh_entropy_volume"](spark, sf).first().entropy == pytest.approx(entropy(share.sum(0)), abs=1e-3)
    p, v = at(ids), f[ids]
    grad = np.linalg.norm(np.linalg.solve(p[:, 1:] - p[:, :1], (v[:, 1:] - v[:, :1])[..., None])[..., 0], axis=1)
    want = entropy((share * np.where(v.min(1) < v.max(1), grad, 0)[:, None]).sum(0)) / np.log2(40)
    assert registry.QUERIES["e11_mesh_entropy_area"](spark, sf).first().entropy == pytest.approx(want, abs=1e-3)


def test_local_entropies(spark, sf, whole):
    f, _, ids = whole
    got = registry.QUERIES["e12_mesh_local_entropy"](spark, sf).toPandas().set_index("vid").entropy
    assert sorted(got.index) == list(range(len(f)))
    lo, hi, d = f.min(), f.max(), 10
    lattice = [((i + 0.25) / d, (j + 0.25) / d, (k + 0.25) / d) for i in range(d) for j in range(d - i) for k in range(d - i - j)]
    bary = np.array([(*w, 1 - sum(w)) for w in lattice])
    share, p = shares(f[ids], np.linspace(lo, hi, 17)), at(ids)
    for vid in (0, 555, len(f) - 1, len(f) - 342):
        c = at(np.array(vid))
        near = (p.min(1) < c + 1.2).all(1) & (p.max(1) > c - 1.2).all(1)
        inside = near & (p.min(1) >= c - 1.2).all(1) & (p.max(1) <= c + 1.2).all(1)
        h = share[inside].sum(0)
        for t in ids[near & ~inside]:
            q, v = bary @ at(t), bary @ f[t]
            v = v[(np.abs(q - c) <= 1.2).all(1)]
            h = h + np.bincount(np.clip(((v - lo) / ((hi - lo) / 16)).astype(int), 0, 15), minlength=16) / len(bary)
        assert got[vid] == pytest.approx(entropy(h), abs=1e-3), vid


def test_tables_over_the_grid(spark, sf, whole):
    f, cid, ids = whole
    run = lambda name: registry.QUERIES[name](spark, sf).toPandas()
    box = run("t1_bounding_boxes").set_index("cid").loc[cid]
    assert np.array_equal(box[["lx", "ly", "lz"]], at(ids).min(1)) and np.array_equal(box[["hx", "hy", "hz"]], at(ids).max(1))
    assert np.array_equal(run("t6_sorted_values").set_index("cid").loc[cid].to_numpy(), np.sort(f[ids], 1))
    assert set(map(tuple, run("t5_vertex_cells")[["vid", "cid"]].to_numpy())) == {(v, c) for c, t in zip(cid, ids) for v in t}
    faces = {}
    for c, t in zip(cid, ids):
        for three in itertools.combinations(sorted(t), 3):
            faces.setdefault(three, []).append(c)
    assert set(map(tuple, run("t5_face_neighbours").to_numpy())) == {p for s in faces.values() for p in itertools.permutations(s, 2)}
    assert run("t8_t9_volume_histogram_total").total[0] == pytest.approx(len(cid) / 6)
    assert sorted(run("t7_cross_sections").cid) == sorted(cid)
    text = run("io9_mesh_text").set_index("vid").loc[range(len(f))]
    assert np.array_equal(text[["x", "y", "z"]], at(np.arange(len(f)))) and np.array_equal(text.f, f) and set(text.cells) == {len(cid)}
    rel = run("t4_box_relation")
    low, high = at(ids).min(1), at(ids).max(1)
    for vid in (0, 437, len(f) - 1):
        near = (low < at(np.array(vid)) + 1.2).all(1) & (high > at(np.array(vid)) - 1.2).all(1)
        assert set(rel.cid[rel.vid == vid]) == set(cid[near])
    assert not rel.duplicated(["vid", "cid"]).any()
