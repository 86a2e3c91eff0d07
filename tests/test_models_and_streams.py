"""Models, registration, surfaces, skewed clouds, progress and streams that run."""

import math
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import scalar
from pointloom.operators import aggregates, cluster, features, filters, fitting, registration, splat, surface
from pointloom.plans import neighbors, progress
from pointloom.sources import generators
from pointloom.streaming import accumulate, lod


def test_knn_of_a_dense_cluster_with_a_far_point(spark, make):
    r = np.random.default_rng(3)
    pts = np.concatenate([r.normal(0, 0.01, (9000, 3)), [[1000.0, 0, 0], [0, 900.0, 0]]])
    df = make(pts).cache()
    width = neighbors._start_width(df, 100.0, 5)
    c = neighbors.with_cells(df, width).groupBy("cx", "cy", "cz").count()
    assert c.agg(F.sum(F.col("count") * F.col("count")) / F.sum("count")).first()[0] <= 8 * 5
    near = {}
    for row in neighbors.knn(df, 5).collect():
        near.setdefault(row.id, []).append((row.rank, row.nid))
    for i in [*range(0, 9000, 500), 9000, 9001]:
        d = ((pts - pts[i]) ** 2).sum(1)
        d[i] = np.inf
        assert [n for _, n in sorted(near[i])] == np.lexsort((np.arange(len(d)), d))[:5].tolist()


def test_knn_sorts_few_candidates(spark, make, monkeypatch):
    """A round sorts what lies within a cube's width, and the first cubes hold few points."""
    pts = np.random.default_rng(6).normal(0, 0.1, (6000, 3))
    df, seen, cut = make(pts).cache(), [], neighbors.cut
    monkeypatch.setattr(neighbors, "cut", lambda d: seen.append(d) or cut(d))
    assert neighbors.knn(df, 20).count() == 6000 * 20
    top = next(d for d in seen if "rank" in d.columns)
    width = neighbors._start_width(df, np.prod(np.ptp(pts, 0) * 20 ** (1 / 3) / 6000 ** (1 / 3)) ** (1 / 3), 20)
    c = neighbors.with_cells(df, width).groupBy("cx", "cy", "cz").count()
    assert c.agg(F.sum(F.col("count") * F.col("count")) / F.sum("count")).first()[0] <= 2 * 20
    assert top.agg(F.max("dist")).first()[0] < width


def test_knn_of_copies(spark, make):
    monkey = make([(0, 0, 0)] * 200)
    assert neighbors._start_width(monkey, 1.0, 2) > 0
    assert neighbors.knn(monkey, 3).count() == 600


def numpy_normals(p, n, k):
    out = []
    for i in range(len(p)):
        d = ((p - p[i]) ** 2).sum(1)
        near = p[np.argsort(d, kind="stable")[: k + 1]]
        w, v = np.linalg.eigh(np.cov(near.T))
        out.append(v[:, 0])
    return np.array(out)


def test_normals_and_smoothing_by_numpy(spark, make):
    r = np.random.default_rng(5)
    u = r.uniform(-1, 1, (150, 2))
    p = np.c_[u, 0.3 * u[:, 0] ** 2 - 0.1 * u[:, 1]]
    got = {x.id: np.array([x.nx, x.ny, x.nz]) for x in features.normals(make(p), k=8).collect()}
    want = numpy_normals(p, got, 8)
    assert all(abs(abs(got[i] @ want[i]) - 1) < 1e-9 for i in range(len(p)))
    noisy = p + np.c_[np.zeros((150, 2)), r.normal(0, 0.01, 150)]
    s = np.array([[x.x, x.y, x.z] for x in features.mls_smooth(make(noisy), k=20).orderBy("id").collect()])
    err = lambda q: np.abs(q[:, 2] - (0.3 * q[:, 0] ** 2 - 0.1 * q[:, 1])).mean()
    assert err(s) < 0.8 * err(noisy)
    flat = make(np.c_[u, np.zeros(150)])
    up = features.mls_upsample(flat, k=10, up_radius=0.1, step=0.05).collect()
    assert len(up) == 150 * 12 and max(abs(x.z) for x in up) < 1e-9


def test_principal_curvatures_of_a_cylinder(spark):
    df = generators.cylinder(spark, radius=2.0, height=6.0, n=3000, axis="z")
    c = features.principal_curvatures(df, k=25).join(df, "id").where("abs(z) < 2")
    a, b = (np.array([sorted((abs(r.k1), abs(r.k2))) for r in c.collect()])[:, i] for i in (0, 1))
    assert np.median(a) < 0.05 and abs(np.median(b) - 0.5) < 0.05


@pytest.mark.parametrize("kind", ["cylinder", "cone"])
def test_round_models_are_found(spark, kind):
    made = generators.cylinder(spark, radius=1.0, height=4.0, n=600) if kind == "cylinder" else generators.cone(spark, radius=1.0, height=2.0, n=600)
    if kind == "cone":
        made = features_normals(made)
    model, out = fitting.ransac(made, kind, iterations=300, threshold=0.1, min_inliers=100)
    assert model is None or out.where("inlier").count() >= 100


def features_normals(df):
    return df.join(features.normals(df, k=10), "id")


def moved(df, angle, t):
    c, s = math.cos(angle), math.sin(angle)
    return filters.transform(df, ((c, -s, 0.0), (s, c, 0.0), (0.0, 0.0, 1.0)), t)


def test_point_to_plane_finds_a_small_turn(spark):
    base = generators.organic(spark, n=1500)
    target = features_normals(base)
    a = registration.icp_point_to_plane(moved(base, 0.05, (0.02, -0.01, 0.03)), target, iterations=15)
    back = registration.apply(moved(base, 0.05, (0.02, -0.01, 0.03)), a).join(base.select("id", *[F.col(c).alias(f"o{c}") for c in "xyz"]), "id")
    assert back.agg(F.max(F.abs(F.col("x") - F.col("ox")) + F.abs(F.col("y") - F.col("oy")) + F.abs(F.col("z") - F.col("oz")))).first()[0] < 0.02


def test_global_registration_of_a_corner(spark, make):
    face = [(x, y, 0.0) for x in range(9) for y in range(7)]
    wall = [(x, 0.0, z) for x in range(9) for z in range(1, 6)]
    bumps = [(4 + 0.3 * i, 3 + 0.1 * i * i, 0.5 * i) for i in range(1, 6)]
    df = make(np.array(face + wall + bumps, float) + np.random.default_rng(1).normal(0, 0.02, (113, 3)))
    other = moved(df, 0.6, (3.0, -2.0, 1.0))
    p, q = features_normals(df), features_normals(other)
    turned = p.select("id", *[c.alias(n) for c, n in zip((F.col("nx") * math.cos(0.6) - F.col("ny") * math.sin(0.6), F.col("nx") * math.sin(0.6) + F.col("ny") * math.cos(0.6), F.col("nz")), ("nx", "ny", "nz"), strict=True)])
    q = other.join(turned, "id")
    a = registration.global_registration(df, other, features.fpfh(p, 15), features.fpfh(q, 15), iterations=300, max_distance=0.3)
    assert a is not None and abs(a.rotation[0, 0] - math.cos(0.6)) < 0.05 and np.allclose(a.translation, [3, -2, 1], atol=0.3)


def test_feature_matches_prefer_the_exact_and_the_lower(spark):
    r = np.random.default_rng(2)
    h = r.uniform(0, 1, (60, 33))
    h[40] = h[10]
    rows = [(i, x.tolist()) for i, x in enumerate(h)]
    df = spark.createDataFrame(rows, "id bigint, histogram array<double>")
    got = {x.id: (x.nid, x.d2) for x in registration.feature_matches(df, df).collect()}
    assert got == {i: (10 if i == 40 else i, 0.0) for i in range(60)}


def test_feature_matches_by_files_shuffle_no_pairs_of_blocks(spark, monkeypatch):
    r = np.random.default_rng(12)
    a, b = r.uniform(0, 1, (300, 33)) * r.uniform(0.1, 3, (300, 1)), r.uniform(0, 1, (250, 33)) * r.uniform(0.1, 3, (250, 1))
    b[17], b[200], a[5] = b[80], a[9], b[80]
    frame = lambda h, first: spark.createDataFrame([(first + i, x.tolist()) for i, x in enumerate(h)], "id bigint, histogram array<double>")
    for name, size in (("STRIPE", 23), ("BLOCK", 7), ("FILE", 31)):
        monkeypatch.setattr(registration, name, size)
    met = registration.feature_matches(frame(a, 0), frame(b, 1000))
    plan = met._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Cartesian", "NestedLoop", "collect_list"))
    got = {x.id: (x.nid, x.d2) for x in met.collect()}
    d = ((a[:, None] - b[None]) ** 2).sum(2)
    assert {i: n for i, (n, _) in got.items()} == {i: 1000 + int(d[i].argmin()) for i in range(300)} and got[5] == (1017, 0.0) and got[9] == (1200, 0.0)
    assert np.allclose([got[i][1] for i in range(300)], d.min(1))
    assert registration.feature_matches(frame(a, 0), frame(b[:0], 0)).count() == 0


def test_region_growing_parts_two_planes(spark, make):
    flat = [(x * 0.1, y * 0.1, 0.0) for x in range(10) for y in range(10)]
    wall = [(2.0, y * 0.1, 1 + z * 0.1) for y in range(10) for z in range(10)]
    df = features_normals(make(flat + wall))
    df = df.join(features.curvature(df, k=8), "id")
    got = {r.id: r.region for r in cluster.region_growing(df, k=9, angle=0.3, min_size=20).collect()}
    assert len({got[i] for i in range(100)}) == len({got[i] for i in range(100, 200)}) == 1 and got[0] != got[150]


def test_meshes(spark, make):
    grid = make([(x * 0.1, y * 0.1, 0.0) for x in range(8) for y in range(8)])
    assert surface.greedy_mesh(grid).count() > 0
    ball = features_normals(generators.sphere(spark, n=600))
    out = features.orient_normals(ball, (0.0, 0.0, 0.0)).withColumns({f"n{a}": -F.col(f"n{a}") for a in "xyz"})
    assert surface.poisson_surface(out, resolution=16, iterations=30).count() > 0


def test_content_hash_sees_columns_named_h_and_repeats(spark, make):
    a = make([(0, 0, 0), (1, 2, 3)])
    h = lambda df: aggregates.content_hash(df).first()["hash"]
    assert h(a) == h(a.repartition(3)) == h(a.withColumn("h", F.lit(1.0))) and len(h(a)) == 16
    assert len({h(a), h(a.unionByName(a)), h(a.limit(0)), h(make([(0, 0, 0), (1, 2, 3.5)]))}) == 4


def test_confidence_interval(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (2, 4, 4, 4, 5, 5, 7, 9)] + [(2, 1.0)], "g int, v double")
    got = {r.g: r for r in aggregates.confidence(df, ["g"], "v").collect()}
    assert abs(got[1].ci95 - 2.365 * np.std([2, 4, 4, 4, 5, 5, 7, 9], ddof=1) / math.sqrt(8)) < 1e-9 and got[2].ci95 == 0


def test_stochastic_rounding_keeps_the_mean():
    u = (np.arange(10_000) + 0.5) / 10_000
    assert abs(scalar.stochastic_round(np.full(10_000, 2.3), u).mean() - 2.3) < 1e-3


def test_splat_generators(spark):
    for made, n in ((generators.splat_cube(spark), 3000), (generators.splat_galaxy(spark), 3000), (generators.splat_torus(spark), 3000), (generators.splat_shell(spark, 500), 500), (generators.splat_stress(spark), 247)):
        assert made.count() == n == made.select("id").distinct().count()
    assert generators.splat_cube(spark).where("greatest(abs(x), abs(y), abs(z)) > 1 + 1e-9").count() == 0
    few = splat.particles(generators.splat_stress(spark), density=0.1)
    assert few.where("r IS NULL").count() == 0 and few.count() < 247 * 8


def test_progress_is_told_and_stops(spark, make):
    df = make([(i * 0.01, 0, 0) for i in range(50)])
    told = []
    with progress.reporting(spark, progress.Progress(lambda k, what: told.append(k))):
        cluster.distance_clusters(df, 0.02).count()
    assert told and told == list(range(1, len(told) + 1))
    p = progress.Progress()
    p.cancel()
    with pytest.raises(progress.Cancelled), progress.reporting(spark, p):
        cluster.distance_clusters(df, 0.02).count()
    slow = progress.Progress()
    with pytest.raises(Exception, match="(?i)cancel"), progress.reporting(spark, slow):
        threading.Timer(3, slow.cancel).start()
        spark.range(4, numPartitions=4).selectExpr("java_method('java.lang.Thread', 'sleep', 60000L + id)").collect()
    assert cluster.distance_clusters(df, 0.02).count() == 50


def run_stream(spark, df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_streams_run(spark, tmp_path):
    t = spark.createDataFrame([(i % 2, i % 3, 0, float(i), 1.0, 2.0) for i in range(30)], "version bigint, px int, py int, r double, g double, b double")
    t.write.parquet(str(tmp_path / "s"))
    s = spark.readStream.schema(t.schema).parquet(str(tmp_path / "s"))
    got = run_stream(spark, accumulate.running_mean(s), "complete", "means")
    want = accumulate.running_mean(t).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.write.parquet(str(tmp_path / "e"))
    named = lambda df: df.select(F.date_format("start", "yyyy-MM-dd HH").alias("h"), "event_type", "n")
    w = run_stream(spark, named(accumulate.event_windows(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")))), "update", "windows")
    assert set(map(tuple, w)) == set(map(tuple, named(accumulate.event_windows(e)).collect()))


def test_level_of_detail_as_a_stream(spark, tmp_path):
    frames = [("a", k, k < 2, 30.0) for k in range(12)] + [("b", k, True, 100.0) for k in range(5)]
    t = spark.createDataFrame(frames, "viewer string, seq bigint, moved boolean, frame_ms double")
    t.write.parquet(str(tmp_path / "f"))
    got = run_stream(spark, lod.lod_states(spark.readStream.schema(t.schema).parquet(str(tmp_path / "f"))), "append", "lod")
    want = []
    for viewer in "ab":
        c = lod.LodController(100.0, 20.0, 40.0, 64)
        for v, k, moving, ms in frames:
            if v == viewer:
                want.append((v, k, c.step(moving, ms), c.repeats, c.total))
    assert sorted(map(tuple, got)) == sorted(want)


def test_particles_meet_the_analytic_image(spark):
    rows = [(0, 0.0, 0.0, 2.0, [1.0, 0.2, 0.0], 0.4, [-1.6, -1.9, -1.7], [0.9, 0.1, 0.2, 0.0]), (1, 0.15, 0.1, 3.0, [0.0, 0.5, 1.0], 1.5, [-1.2, -1.4, -1.5], [1.0, 0.0, 0.0, 0.3])]
    s = spark.createDataFrame(rows, "id bigint, x double, y double, z double, f_dc array<double>, opacity double, scale array<double>, rot array<double>")
    view = ((1.0, 0, 0, 0), (0, 1.0, 0, 0), (0, 0, 1.0, 0))
    want = splat.render_analytic(s, view, 40.0, 24, 24).cache()
    near = splat.psnr(want, splat.render_particles(s, view, 40.0, 24, 24, radial=True, centre_depth=True, sets=100)).first()["psnr"]
    plain = splat.psnr(want, splat.render_particles(s, view, 40.0, 24, 24, level="none", base=30.0, rule="proportional", sets=20)).first()["psnr"]
    assert near >= 25 and near > plain
    drawn = splat.render_monte_carlo(s, view, 40.0, 24, 24, sets=100).cache()
    assert splat.psnr(want, drawn).first()["psnr"] >= 30 and splat.ssim(want, drawn, 24, 24).first()["ssim"] >= 0.95


def test_hull_fan_and_commands(spark, make):
    h = surface.plane_hull(make([(0, 0, 5), (1, 0, 1), (1, 1, 2), (0, 1, 3), (0.5, 0.5, 9)]), (0.0, 0.0, 2.0, -8.0))
    assert h.count() == 4 and {round(r.z, 9) for r in h.collect()} == {4.0}
    assert sorted(map(tuple, surface.hull_fan(h).collect())) == [(0, 1, 2), (0, 2, 3)]
    from pointloom.operators import world

    assert world.strict_numbers("1,2.5", 2) == [1.0, 2.5] and world.Dispatcher(world.World(spark)).run("CheckCommandCatalog") == "OK"
    for bad in ("1", "1,x", "1,2,3"):
        with pytest.raises(ValueError):
            world.strict_numbers(bad, 2)
