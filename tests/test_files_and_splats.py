import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import rng, scalar
from pointloom.operators import splat, world
from pointloom.sources import codec, files, generators
from pointloom.streaming.accumulate import version_key
from pointloom.streaming.lod import CONVERGED, MOVING, REFINING, SETTLING, LodController


def test_pcg_anchors():
    assert rng.pcg_hash(np.array([0, 1], np.uint32)).tolist() == [129708002, 2831084092]


def test_poisson_mean():
    for lam in (0.5, 5.0, 80.0):
        n = rng.poisson(np.full(4000, lam), 7, np.arange(4000))
        assert abs(n.mean() - lam) < 5 * math.sqrt(lam / 4000)


def test_dilog():
    got = scalar.dilog(np.array([0.0, 1.0, -1.0, 0.5]))
    assert np.allclose(got, [0, math.pi**2 / 6, -(math.pi**2) / 12, math.pi**2 / 12 - math.log(2) ** 2 / 2])
    x = np.array([0.1, 0.5, 0.9])
    assert np.allclose(scalar.inv_dilog(scalar.dilog(x)), x)


def test_scalars(spark):
    r = spark.range(1).select(
        scalar.linear_to_srgb(scalar.srgb_to_linear(F.lit(0.3))).alias("a"), scalar.logit(F.lit(0.0)).alias("b"),
        scalar.sigmoid(scalar.logit(F.lit(0.25))).alias("c"), *[c.alias(n) for c, n in zip(scalar.hsv_to_rgb(0.0, 1.0, 1.0), "rgq", strict=True)],
    ).first()
    assert (round(r.a, 9), r.b, round(r.c, 9), r.r, r.g, r.q) == (0.3, -40, 0.25, 1, 0, 0)


def test_depth_keys_sort():
    d = np.array([-2.0, -0.5, 0.0, 0.5, 3.0], np.float32)
    k = scalar.ordered_depth_key(d)
    assert (np.diff(k.astype(np.int64)) > 0).all() and np.array_equal(scalar.depth_of_key(k), d)


@pytest.mark.parametrize("binary", [True, False])
def test_ply_round_trip(spark, tmp_path, binary):
    df = generators.sphere(spark, n=50).withColumns({c: F.lit(v) for c, v in zip("rgb", (0.0, 0.5, 1.0), strict=True)})
    path = str(tmp_path / "a.ply")
    files.save(df, path, binary)
    back = files.load(spark, path).orderBy("id").toPandas()
    want = df.orderBy("id").toPandas()
    assert np.allclose(back[["x", "y", "z"]], want[["x", "y", "z"]], atol=1e-5)
    assert back["g"].iloc[0] == pytest.approx(128 / 255) and back["nx"].isna().all()


@pytest.mark.parametrize("binary", [True, False])
def test_pcd_round_trip(spark, tmp_path, binary):
    df = generators.torus(spark, n=40)
    files.save(df, str(tmp_path / "a.pcd"), binary)
    back = files.load(spark, str(tmp_path / "a.pcd")).orderBy("id").toPandas()
    assert np.allclose(back[["x", "y", "z"]], df.orderBy("id").toPandas()[["x", "y", "z"]], atol=1e-5)


def test_point_set_and_errors(spark, tmp_path):
    cols = {c: np.arange(3.0) + 1 for c in ("x", "y", "z", "r", "g", "b", "radius")}
    data = codec.point_set_bytes(cols)
    assert np.array_equal(codec.point_set_columns(data)["y"], cols["y"])
    with pytest.raises(ValueError):
        codec.point_set_columns(data[:-4] + b"abcd")
    with pytest.raises(ValueError):
        codec.splat_records(b"x" * 33)
    with pytest.raises(ValueError):
        files.load(spark, "a.xyz")
    with pytest.raises(ValueError):
        codec.ply_header(b"ply\nformat ascii 1.0\nelement vertex 1\nproperty list uchar int x\nend_header\n")


def test_txt(spark, tmp_path):
    p = tmp_path / "a.txt"
    p.write_text("# head\n0 0 0 255 0 0\n\nbad line here\n1 2 3\n")
    got = files.read_txt(spark, str(p)).orderBy("id").collect()
    assert [(r.id, r.x, r.r) for r in got] == [(0, 0, 1), (1, 1, pytest.approx(0.6))]
    with pytest.raises(Exception, match="bad number"):
        files.read_txt(spark, str(p), strict=True).collect()


def test_splat_round_trip(spark, tmp_path):
    data = codec.splat_bytes(np.ones((4, 3)), np.full((4, 3), -2.0), np.zeros((4, 3)), np.zeros(4), np.tile([0.5, 0, 0, 0], (4, 1)))
    (tmp_path / "a.splat").write_bytes(data)
    r = files.load(spark, str(tmp_path / "a.splat")).orderBy("id").first()
    assert r.scale[0] == pytest.approx(-2, abs=1e-6) and r.rot == [0.5, 0, 0, 0] and abs(r.opacity) < 0.05


def test_unpack_splats(spark):
    top = 0xFFFFFFFF
    packed = spark.createDataFrame([(0, 0, 0, 0, 0), (1, top, 3 << 30, top, top)], "id bigint, pp bigint, pr bigint, ps bigint, pc bigint")
    names = [f"{m}_{c}" for c in ("x", "y", "z", "scale_x", "scale_y", "scale_z", "r", "g", "b") for m in ("min", "max")]
    chunks = spark.createDataFrame([(0, *[v for _ in range(9) for v in (-1.0, 3.0)])], "ci bigint, " + ", ".join(f"{n} double" for n in names))
    a, b = files.unpack_splats(packed, chunks).orderBy("id").collect()
    assert (a.x, a.opacity, b.z, b.scale[1], b.f_dc[2], b.opacity) == (-1, -40, 3, 3, 3, 40)
    assert a.rot[1] == pytest.approx(-math.sqrt(0.5)) and len(b.rot) == 4


def _one(spark, opacity=1.0):
    return spark.createDataFrame([(0, 0.0, 0.0, 4.0, [0.5, 0.2, -0.3], opacity, [-1.8, -1.8, -1.8], [1.0, 0.0, 0.0, 0.0])],
                                 "id bigint, x double, y double, z double, f_dc array<double>, opacity double, scale array<double>, rot array<double>")


VIEW = ((1.0, 0, 0, 0), (0, 1.0, 0, 0), (0, 0, 1.0, 0))


def test_monte_carlo_nears_the_analytic_image(spark):
    a = splat.render_analytic(_one(spark), VIEW, 60.0, 24, 24).cache()
    m = splat.render_monte_carlo(_one(spark), VIEW, 60.0, 24, 24, spp=2, sets=60)
    assert splat.psnr(a, m).first()["psnr"] > 30
    assert splat.ssim(a, a, 24, 24).first()["ssim"] == pytest.approx(1)
    assert splat.psnr(a, a).first()["psnr"] == 120


def test_inverse_dilogarithm_reads_few_series(monkeypatch):
    x = np.concatenate([np.linspace(0, 1, 20001), 10.0 ** -np.arange(1, 9), 1 - 10.0 ** -np.arange(1, 13)])
    y, seen, dilog = scalar.dilog(x), [], scalar.dilog
    monkeypatch.setattr(scalar, "dilog", lambda v: seen.append(np.size(v)) or dilog(v))
    got = scalar.inv_dilog(y)
    assert np.allclose(got, x, rtol=1e-12, atol=1e-15) and (got[0], got[20000]) == (0, 1)
    assert sum(seen) < len(x)  # once 60 times as many


def test_monte_carlo_in_pieces(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(i, *map(float, r.normal(0, 0.2, 2)), float(2 + i % 3), r.normal(0, 1, 3).tolist(), 0.5, [-2.0] * 3, [1.0, 0.0, 0.0, 0.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, x double, y double, z double, f_dc array<double>, opacity double, scale array<double>, rot array<double>")
    image = lambda: [tuple(p) for p in splat.render_monte_carlo(df, VIEW, 60.0, 16, 16, sets=3).orderBy("px", "py").collect()]
    whole = image()
    monkeypatch.setattr(splat, "THROWN", 37)
    assert np.allclose(image(), whole, atol=1e-12) and sum(p[2] for p in whole) > 0


def test_lod_controller():
    c = LodController()
    assert [c.step(True, 10), c.step(False, 60), c.step(False, 60)] == [MOVING, SETTLING, REFINING]
    for _ in range(40):
        last = c.step(False, 10)
    assert last == CONVERGED and c.total == 64
    c.target = 100
    assert c.step(False, 10) == REFINING and c.step(True, 10) == MOVING and c.total == 0
    assert version_key({"a": 1, "target_ensembles": 3}) == version_key({"a": 1, "target_ensembles": 9}) != version_key({"a": 2})


def test_commands(spark):
    d = world.Dispatcher(world.World(spark))
    steps = [
        {"command": "GenerateSphere:1,200", "expect_prefix": "Id:", "store_as": "s", "strip_prefix": "Id:"},
        {"command": "GetScenePointCount:${s}", "expect": "Count:200"},
        {"command": "DownSample:${s},0.5", "expect_prefix": "Id:"},
        {"command": "RansacSphere:${s},30,0.05,50", "expect_prefix": "Id:"},
        {"command": "GetLastMetric:inlierCount", "expect_range": [190, 200]},
        {"command": "GetSceneHasNormals:${s}", "expect": "No"},
        {"command": "GenerateRect:1,1,1,1", "expect_prefix": "Error:"},
        {"command": "Nothing", "expect_prefix": "Error:"},
        {"command": "GetSceneCount", "expect": "Count:4"},
        {"command": "Clear", "expect": "OK"},
    ]
    bad = [x for x in world.run_scenario(d, steps) if not x[2]]
    assert not bad


def test_counts_and_colours(spark):
    r = spark.range(1).select(
        scalar.calibrated_count("footprint", "extinction", F.lit(0.5), 1.0, 2.0, area=F.lit(3.0), spp=4.0).alias("n"),
        scalar.radial_keep_probability(F.lit(0.8), F.lit(0.0)).alias("p"), scalar.adaptive_footprint(F.lit(5.5), 0.5, 4).alias("s"),
        scalar.pixel_density_scale(F.lit(2.0), 100.0, 100.0, 0.1).alias("d"), scalar.pack_hdr(F.lit(1.0), F.lit(0.0), F.lit(3.0)).alias("h"),
        scalar.expected_coverage(F.lit(0.5), 2.0).alias("c"), scalar.opacity_term("dilog", F.lit(1.0)).alias("g"),
    ).first()
    assert r.n == pytest.approx(2 * math.log(2) * 12) and r.p == 1 and r.s == 2 and r.d == pytest.approx(25) and r.c == 0.75
    assert r.g == pytest.approx(math.pi**2 / 6, rel=1e-6)
    back = spark.range(1).select(*[c.alias(n) for c, n in zip(scalar.unpack_hdr(F.lit(r.h)), "rgb", strict=True)]).first()
    assert back.r == pytest.approx(1, rel=0.02) and back.g == 0 and back.b == pytest.approx(3, rel=0.02)
    u = np.linspace(0.01, 0.99, 50)
    rad = scalar.sample_corrected_radius(np.full(50, 0.7), u)
    assert (np.diff(rad) > 0).all() and scalar.dilog(0.7 * np.exp(-(rad**2) / 2)) == pytest.approx((1 - u) * scalar.dilog(np.array([0.7]))[0])


def test_scan_samples_and_drawing(spark, tmp_path):
    from pointloom.operators import aggregates

    df = spark.createDataFrame([(i, i % 3) for i in range(20)], "id bigint, n bigint")
    got = [r.offset for r in aggregates.exclusive_scan(df, "n").orderBy("id").collect()]
    assert got == [sum(k % 3 for k in range(i)) for i in range(20)]
    full = splat.render_analytic(_one(spark), VIEW, 60.0, 16, 16)
    some = full.select("px", "py").where("px = 8")
    part = splat.render_samples(_one(spark), some, VIEW, 60.0, 16, 16)
    assert splat.psnr(part, full).first()["psnr"] == 120 and part.count() == 16
    assert splat.validate_render(full, part).first()["passed"]
    drawn = splat.image_array(splat.draw_sorted(_one(spark), (0, 0, 0), VIEW, 60.0, 16, 16), 16, 16)
    assert drawn[8, 8].max() > 0.1 and drawn[0, 0].max() == 0
    splat.export_pfm(full, 16, 16, str(tmp_path / "a.pfm"))
    assert (tmp_path / "a.pfm").read_bytes().startswith(b"PF\n16 16\n-1.0\n")
    p = splat.project(_one(spark), VIEW, 60.0, 16, 16)
    assert splat.cull(p, 16, 16).count() == 1 and splat.cull(p, 16, 16, min_alpha=0.99).count() == 0


def test_point_set_ply(spark, tmp_path):
    df = generators.points_from_vertices(generators.sphere(spark, n=30), (0.2, 0.4, 0.8), 0.05)
    files.save_point_set(df, str(tmp_path / "s.ply"))
    r = files.load_point_set(spark, str(tmp_path / "s.ply")).orderBy("id").first()
    assert r.r == pytest.approx(0.2, abs=0.01) and r.radius == pytest.approx(0.05)
