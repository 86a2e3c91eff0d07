"""Small literal clouds that pin down the operators' meaning."""

import math

import numpy as np
import pytest

from pointloom.operators import aggregates, cluster, features, filters, fitting, registration, selection, surface
from pointloom.plans.neighbors import knn, nearest, radius_neighbors
from pointloom.sources import generators

CROSS = [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0)]


def labels(df, col):
    return {r["id"]: r[col] for r in df.collect()}


def test_radius_is_open_and_leaves_out_the_point(make):
    df = make([(0, 0, 0), (1, 0, 0), (1.5, 0, 0)])
    assert {(r.id, r.nid) for r in radius_neighbors(df, 1.0).collect()} == {(1, 2), (2, 1)}
    assert {(r.id, r.nid) for r in radius_neighbors(df, 1.0, closed=True).collect()} == {(0, 1), (1, 0), (1, 2), (2, 1)}


def test_knn_matches_brute_force(make):
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.normal(size=(60, 3)), rng.normal(size=(20, 3)) * 30])
    got = {(r.id, r.rank): r.nid for r in knn(make(p), 5).collect()}
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    np.fill_diagonal(d, np.inf)
    for i in range(len(p)):
        assert [got[i, k + 1] for k in range(5)] == sorted(range(len(p)), key=lambda j, i=i: (d[i, j], j))[:5]
    assert len(got) == 400
    assert nearest(make([(100, 0, 0)]), make(p)).count() == 1
    assert knn(make([(0, 0, 0)]), 3).count() == 0


def test_dbscan(make):
    square = [(0, 0), (0.05, 0), (0, 0.05), (0.05, 0.05)]
    two = [(a, b, 0) for a, b in square] + [(a + 10, b + 10, 10) for a, b in square]
    assert labels(cluster.dbscan(make(two), 0.1, 3), "cluster_id") == {i: 1 + i // 4 for i in range(8)}
    assert set(labels(cluster.dbscan(make([(0, 0, 0), (1, 0, 0)]), 1.0, 1), "cluster_id").values()) == {-1}
    assert set(labels(cluster.dbscan(make([(0, 0, 0), (0.99, 0, 0)]), 1.0, 1), "cluster_id").values()) == {1}


def brute_clusters(p, eps, least):
    d = np.sqrt(((p[None] - p[:, None]) ** 2).sum(2))
    near = (d < eps) & ~np.eye(len(p), dtype=bool)
    core = near.sum(1) >= least
    label, found = np.full(len(p), -1), 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            found += 1
            queue, label[i] = [i], found
            while queue:
                for j in np.flatnonzero(near[queue.pop()] & core & (label < 0)):
                    label[j] = found
                    queue.append(j)
    edge = np.where((near & core).any(1), np.where(near & core, label[None], len(p)).min(1), -1)
    return dict(enumerate(np.where(core, label, edge).tolist()))


def test_clusters_match_brute_force(make):
    r = np.random.default_rng(8)
    blobs = np.concatenate([r.normal(c, 0.03, (90, 3)) for c in (0.0, 0.16, 0.5)] + [r.uniform(-0.3, 0.8, (150, 3)), np.repeat(r.uniform(0, 1, (6, 3)), 7, 0), np.round(r.uniform(0, 0.6, (60, 3)), 1)])
    df = make(blobs)
    for eps, least in ((0.05, 3), (0.1, 6), (0.2, 1), (0.1, 0)):
        assert labels(cluster.dbscan(df, eps, least), "cluster_id") == brute_clusters(blobs, eps, least)
    assert labels(cluster.distance_clusters(df, 0.1), "cluster_id") == brute_clusters(blobs, 0.1, 0)
    odd = make([*blobs[:100], (math.nan, 0, 0), (math.inf, 0, 0)])
    assert [labels(cluster.dbscan(odd, 0.05, k), "cluster_id")[100] > 0 for k in (3, 0)] == [False, True]


def test_clusters_of_a_dense_cloud_write_no_pairs(make, monkeypatch):
    """3,000 points of one ball make 9 million pairs; what is written stays near the points."""
    from pointloom.operators import cluster as own
    from pointloom.plans import components

    rows, cut = [], components.cut
    for m in (own, components):
        monkeypatch.setattr(m, "cut", lambda df: rows.append((out := cut(df)).count()) or out)
    df = make(np.random.default_rng(9).normal(0, 0.02, (3000, 3)))
    assert set(labels(cluster.dbscan(df, 0.2, 5), "cluster_id").values()) == {1}
    assert set(labels(cluster.distance_clusters(df, 0.2), "cluster_id").values()) == {1}
    assert max(rows) <= 3000


def test_distance_clusters(make):
    p = [(1, 0, 0), (2.4, 0, 0), (2.5, 0, 0), (2.6, 0, 0), (10, 0, 0), (10.1, 0, 0)]
    assert labels(cluster.distance_clusters(make(p), 1.6), "cluster_id") == {0: 1, 1: 1, 2: 1, 3: 1, 4: 2, 5: 2}


def test_outlier_filters(make):
    p = [(0, 0, 0), (0.05, 0, 0), (-0.05, 0, 0), (0, 0.05, 0), (0, -0.05, 0), (10, 10, 10)]
    assert [i for i, v in labels(filters.statistical_outlier(make(p), 2, 1.0), "inlier").items() if not v] == [5]
    assert all(labels(filters.statistical_outlier(make(p), 0, 1.0), "inlier").values())
    assert not labels(filters.radius_outlier(make(p), 0.1, 2), "inlier")[5]
    assert all(labels(filters.density_filter(make(CROSS), 3.0), "inlier").values())


def test_pass_through_is_closed_and_refuses_nan(make):
    got = labels(filters.pass_through(make([(0, 0, 0), (1, 0, 0), (float("nan"), 0, 0), (1.1, 0, 0)]), "x", 0, 1), "inlier")
    assert got == {0: True, 1: True, 2: False, 3: False}


def test_voxels(make):
    v = aggregates.voxel_downsample(make([(0.1, 0, 0), (0.3, 0, 0), (-0.1, 0, 0)]), 1.0).orderBy("first_id").collect()
    assert [(r.n, round(r.x, 6), r.first_id) for r in v] == [(2, 0.2, 0), (1, -0.1, 2)]
    with pytest.raises(ValueError):
        aggregates.voxel_downsample(make(CROSS), 0)


def test_normals_and_curvature(make):
    n = {r.id: abs(r.nz) for r in features.normals(make(CROSS), radius=1.5).collect()}
    assert n[0] == pytest.approx(1)
    assert labels(features.curvature(make(CROSS), radius=1.5), "curvature")[0] == pytest.approx(0, abs=1e-12)
    octa = [(0, 0, 0)] + [tuple(s * (i == k) for i in range(3)) for k in range(3) for s in (1, -1)]
    assert labels(features.curvature(make(octa), radius=1.2), "curvature")[0] == pytest.approx(1 / 3)
    assert features.normals(make([(0, 0, 0), (9, 9, 9)]), radius=1).first().nz == 0


def test_principal_curvature_of_a_sphere(make):
    p = [(0, 0, 2.0)]
    for ring in range(1, 7):
        for k in range(16):
            a, t = 0.08 * ring, 2 * math.pi * k / 16
            p.append((2 * math.sin(a) * math.cos(t), 2 * math.sin(a) * math.sin(t), 2 * math.cos(a)))
    r = features.principal_curvatures(make(p), radius=0.6).where("id = 0").first()
    assert abs(r.k1) == pytest.approx(0.5, abs=0.1) and abs(r.k2) == pytest.approx(0.5, abs=0.1)


def test_boundary(spark):
    rows = [(i, float(i % 11 - 5), float(i // 11 - 5), 0.0, 0.0, 0.0, 1.0) for i in range(121)]
    df = spark.createDataFrame(rows, "id bigint, x double, y double, z double, nx double, ny double, nz double")
    b = labels(features.boundary(df, radius=1.5), "boundary")
    assert not b[60] and b[0] and b[5] and b[120]


def test_fpfh_blocks_sum_to_one(spark):
    rows = [(i, float(i % 5 - 2), float(i // 5 - 2), 0.0, 0.0, 0.0, 1.0) for i in range(25)]
    df = spark.createDataFrame(rows, "id bigint, x double, y double, z double, nx double, ny double, nz double")
    h = {r.id: r.histogram for r in features.fpfh(df, 4).collect()}
    assert len(h) == 25 and len(h[0]) == 33
    blocks = [sum(h[12][k : k + 11]) for k in (0, 11, 22)]
    assert blocks[0] == pytest.approx(blocks[1]) == pytest.approx(blocks[2]) and blocks[0] > 1


def test_ground(make):
    flat = [(i % 11 - 5, i // 11 - 5, 0) for i in range(121)]
    assert all(labels(cluster.ground(make(flat)), "ground").values())
    g = labels(cluster.ground(make([*flat, (0, 0, 5)])), "ground")
    assert g[60] and not g[121]
    house = [(x, y, 5 if 9 <= x <= 11 and 9 <= y <= 11 else 0) for x in range(21) for y in range(21)]
    g = labels(cluster.ground(make(house)), "ground")
    assert not g[10 * 21 + 10] and g[8 * 21 + 10]


def test_ransac_plane(make):
    rng = np.random.default_rng(1)
    p = np.c_[rng.uniform(-1, 1, (300, 2)), rng.normal(0, 0.005, 300)].tolist() + np.c_[rng.uniform(-1, 1, (50, 2)), rng.uniform(0.5, 1, 50)].tolist()
    m, df = fitting.ransac(make(p), "plane", 100, 0.02, 100)
    assert m["inliers"] >= 280 and abs(m["h"]["c"]) > 0.99
    assert fitting.ransac(make(p[:2]), "plane")[0] is None


def test_ransac_sphere(spark):
    m, _ = fitting.ransac(generators.sphere(spark, radius=2.0, n=300), "sphere", 50, 0.02, 50)
    assert m["h"]["r"] == pytest.approx(2, abs=0.01) and m["inliers"] == 300


def test_icp_recovers_a_small_move(spark):
    s = generators.organic(spark, n=300)
    c, n = math.cos(0.05), math.sin(0.05)
    t = filters.transform(s, [[c, -n, 0], [n, c, 0], [0, 0, 1]], [0.02, -0.01, 0.03])
    a = registration.icp(s, t, 30)
    assert a.fitness < 1e-3
    assert np.allclose(a.rotation, [[c, -n, 0], [n, c, 0], [0, 0, 1]], atol=0.05)


def test_hulls(make):
    p = [(0, 0, 0), (1, 0, 1), (1, 1, 2), (0, 1, 3), (0.5, 0.5, 4), (0.5, 0, 5)]
    h = surface.convex_hull_2d(make(p)).orderBy("i").collect()
    assert len(h) == 4 and h[0].area == pytest.approx(1)
    assert surface.convex_hull_2d(make([(0, 0, 0), (1, 1, 0), (2, 2, 0)])).count() == 0
    assert surface.concave_hull_2d(make(p)).first().area <= 1 + 1e-9


def test_selection(spark, make):
    df = make([(i, 0, 0) for i in range(5)])
    sel = spark.createDataFrame([(1,), (3,)], "id bigint")
    assert sorted(r.id for r in selection.invert(df, sel).collect()) == [0, 2, 4]
    assert [(r.id, r.x) for r in selection.delete_selected(df, sel).orderBy("id").collect()] == [(0, 0), (1, 2), (2, 4)]
    assert [(r.id, r.x) for r in selection.duplicate_selected(df, sel, (0.5, 0, 0)).where("id > 4").orderBy("id").collect()] == [(5, 1.5), (6, 3.5)]
    with pytest.raises(ValueError):
        selection.set_radius(df, sel, -1)
    pick = spark.createDataFrame([(0, 3), (1, 3), (2, 0)], "pos int, id bigint")
    assert [r.x for r in selection.subset(df, pick).orderBy("id").collect()] == [3, 3, 0]


def test_mls_keeps_a_plane(make):
    p = [(x * 0.1, y * 0.1, 0.0) for x in range(6) for y in range(6)]
    out = features.mls_smooth(make(p), radius=0.35).collect()
    assert max(abs(r.z) for r in out) < 1e-9
    up = features.mls_upsample(make(p), radius=0.35, up_radius=0.05, step=0.05)
    assert up.count() == 36 * 4 and up.where("abs(z) > 1e-9").count() == 0
