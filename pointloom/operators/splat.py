"""Gaussian splats: projection, rendering, image metrics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rng import normal, poisson, uniform
from ..functions.scalar import calibrated_count, covariance_3d, dilog, eval_sh, expected_point_count, footprint_area, quat_to_rotation, rotation_rows, sample_corrected_radius, sh_dc_to_color, sigmoid, turned_squares, unit_quaternion

NEAR = 1e-4
LOW_PASS = 0.3
#: Points that a task throws, and subpixels it holds, at a time.
THROWN = 1 << 20


def present(splats: DataFrame, size_scale: float = 100.0) -> DataFrame:
    """Draw records: centre, size = largest scale * ``size_scale``, rotation rows
    scaled by largest / own scale, colour and alpha."""
    s = [F.exp(F.col("scale")[i]) for i in range(3)]
    top = F.greatest(*s)
    r = quat_to_rotation(F.col("rot"))
    rows = [F.array(*[r[j][i] * top / s[i] for j in range(3)]).alias(f"row{i}") for i in range(3)]
    colors = [sh_dc_to_color(F.col("f_dc")[i]).alias(c) for i, c in enumerate("rgb")]
    return splats.select("id", "x", "y", "z", (top * size_scale).alias("size"), *rows, *colors, sigmoid("opacity").alias("a"))


def depth_sorted(splats: DataFrame, eye) -> DataFrame:
    """Farthest first, ties by id: a range sort, not one task."""
    d2 = sum(((F.col(a) - float(e)) * (F.col(a) - float(e)) for a, e in zip("xyz", eye, strict=True)), F.lit(0.0))
    return splats.withColumn("d2", d2).orderBy(F.col("d2").desc(), "id")


def project(splats: DataFrame, view, focal: float, width: int, height: int, low_pass: float = LOW_PASS, min_alpha: float = 0.0) -> DataFrame:
    """``(id, cx, cy, sxx, sxy, syy, depth, alpha, r, g, b)`` for splats in front of the
    camera with an invertible footprint. ``view``: 3 x 4 world to camera, z forward."""
    m = np.asarray(view, float)
    p = [F.col(a) for a in "xyz"]
    c = [sum((p[j] * m[i, j] for j in range(3)), F.lit(m[i, 3])) for i in range(3)]
    colors = [F.greatest(F.lit(0.0), sh_dc_to_color(F.col("f_dc")[i])).alias(k) for i, k in enumerate("rgb")]
    turn = [q.alias(f"q{i}") for i, q in enumerate(unit_quaternion(F.col("rot")))] + [F.exp(2 * F.col("scale")[i]).alias(f"s{i}") for i in range(3)]
    s = _steps(splats, ["id"], [c[0].alias("tx"), c[1].alias("ty"), c[2].alias("tz"), sigmoid("opacity").alias("alpha"), *colors, *turn])
    rows = rotation_rows(*[F.col(f"q{i}") for i in range(4)])
    s = _steps(s, [x for x in s.columns if x[0] != "q"], [rows[i][k].alias(f"r{i}{k}") for i in range(3) for k in range(3)])
    cov = turned_squares([[F.col(f"r{i}{k}") for k in range(3)] for i in range(3)], [F.col(f"s{i}") for i in range(3)])
    s = _steps(s, ["id", "tx", "ty", "tz", "alpha", "r", "g", "b"], [v.alias(f"v{k}") for k, v in cov.items()])
    s = s.where((F.col("tz") > NEAR) & (F.col("alpha") > min_alpha))
    limit = [1.3 * 0.5 * width / focal, 1.3 * 0.5 * height / focal]
    t = [F.greatest(F.lit(-lim), F.least(F.lit(lim), F.col(a) / F.col("tz"))) for a, lim in zip(("tx", "ty"), limit, strict=True)]
    j = [[((focal * m[0, k] - focal * t[0] * m[2, k]) / F.col("tz")).alias(f"j0{k}") for k in range(3)], [((focal * m[1, k] - focal * t[1] * m[2, k]) / F.col("tz")).alias(f"j1{k}") for k in range(3)]]
    s = _steps(s, s.columns, j[0] + j[1])
    sym = lambda a, b: F.col("v" + "".join(sorted("xyz"[a] + "xyz"[b])))
    form = lambda u, v: sum((F.col(f"j{u}{a}") * F.col(f"j{v}{b}") * sym(a, b) for a in range(3) for b in range(3)), F.lit(0.0))
    out = _steps(
        s, ["id", F.col("tz").alias("depth"), "alpha", "r", "g", "b"],
        [
            (F.col("tx") / F.col("tz") * focal + width / 2).alias("cx"), (F.col("ty") / F.col("tz") * focal + height / 2).alias("cy"),
            (form(0, 0) + low_pass).alias("sxx"), form(0, 1).alias("sxy"), (form(1, 1) + low_pass).alias("syy"),
        ],
    )
    return out.select("id", "cx", "cy", "sxx", "sxy", "syy", "depth", "alpha", "r", "g", "b").where("sxx * syy - sxy * sxy > 0")


def _steps(df: DataFrame, keep: list, new: list) -> DataFrame:
    """``keep`` and ``new`` columns, the new ones as rows of a generator: an optimizer
    that wrote them out wherever they are used would make more code than a method can hold."""
    return df.select(*keep, F.inline(F.array(F.struct(*new))))


def view_colors(splats: DataFrame, eye, degree: int) -> DataFrame:
    """r, g, b as seen from ``eye`` with harmonics up to ``degree``."""
    d = [F.col(a) - float(e) for a, e in zip("xyz", eye, strict=True)]
    n = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    u = tuple(F.when(n > 0, x / n).otherwise(0.0) for x in d)
    stride = (degree + 1) ** 2 - 1
    return splats.withColumns({c: eval_sh(degree, F.col("f_dc")[i], F.col("sh_rest"), i, u, stride) for i, c in enumerate("rgb")})


def _pixels(width: int, height: int, reach: float = 3.0) -> list:
    lo = lambda c, s, n: F.greatest(F.lit(0), F.floor(F.col(c) - reach * F.sqrt(s)).cast("int"))
    hi = lambda c, s, n: F.least(F.lit(n - 1), F.floor(F.col(c) + reach * F.sqrt(s)).cast("int"))
    return [lo("cx", "sxx", width), hi("cx", "sxx", width), lo("cy", "syy", height), hi("cy", "syy", height)]


def covered(projected: DataFrame, width: int, height: int, reach: float = 6.0) -> DataFrame:
    """Each splat once for every pixel its box covers, with its alpha there."""
    x0, x1, y0, y1 = _pixels(width, height, reach)
    box = projected.withColumns({"x0": x0, "x1": x1, "y0": y0, "y1": y1}).where("x0 <= x1 AND y0 <= y1")
    each = box.withColumn("px", F.explode(F.sequence("x0", "x1"))).withColumn("py", F.explode(F.sequence("y0", "y1")))
    dx, dy = F.col("px") + 0.5 - F.col("cx"), F.col("py") + 0.5 - F.col("cy")
    det = F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy")
    q = (F.col("syy") * dx * dx - 2 * F.col("sxy") * dx * dy + F.col("sxx") * dy * dy) / det
    return each.select("id", "px", "py", "depth", "r", "g", "b", (F.col("alpha") * F.exp(-0.5 * q)).alias("a"))


def composite(layers: DataFrame, stop: float = 1e-9) -> DataFrame:
    """Front to back over each pixel: (px, py, r, g, b, coverage). The light left
    before a layer is the product of those in front, as a running sum of
    logarithms; layers behind ``stop`` add nothing."""
    a = F.least(F.col("a"), F.lit(1 - 1e-15))
    w = Window.partitionBy("px", "py").orderBy("depth", "id").rowsBetween(Window.unboundedPreceding, -1)
    t = F.exp(F.coalesce(F.sum(F.log(1 - a)).over(w), F.lit(0.0)))
    weight = F.when(F.col("t") > stop, F.col("t") * F.col("a")).otherwise(0.0)
    lit = layers.withColumn("t", t).withColumn("w", weight)
    return lit.groupBy("px", "py").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in "rgb"], F.sum("w").alias("coverage"))


def full_image(spark, pixels: DataFrame, width: int, height: int, background=(0.0, 0.0, 0.0)) -> DataFrame:
    """All pixels; where nothing was drawn, and behind what doesn't cover, the background."""
    grid = spark.range(width * height).select((F.col("id") % width).cast("int").alias("px"), F.floor(F.col("id") / width).cast("int").alias("py"))
    j = grid.join(pixels, ["px", "py"], "left")
    rest = 1 - F.coalesce("coverage", F.lit(0.0))
    return j.select("px", "py", *[(F.coalesce(c, F.lit(0.0)) + rest * float(v)).alias(c) for c, v in zip("rgb", background, strict=True)])


def render_analytic(splats: DataFrame, view, focal: float, width: int, height: int, background=(0.0, 0.0, 0.0)) -> DataFrame:
    p = project(splats, view, focal, width, height)
    return full_image(splats.sparkSession, composite(covered(p, width, height)), width, height, background)


def render_monte_carlo(splats: DataFrame, view, focal: float, width: int, height: int, spp: int = 2, sets: int = 32, seed: int = 42,
                       background=(0.0, 0.0, 0.0)) -> DataFrame:
    """Points in place of splats: each splat throws a Poisson number of points over
    its footprint for each set, a subpixel keeps its nearest, and pixels average
    subpixels and sets. Tasks throw some ``THROWN`` points at a time and hand on the nearest
    of each subpixel they hit, so rows grow with the tasks' subpixels, not with points."""
    p = project(splats, view, focal, width, height)
    det = F.sqrt(F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy"))
    p = p.withColumn("lam", expected_point_count("alpha", 2 * math.pi * det) * float(spp * spp))
    p = p.withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    where = ["set", "px", "py", "sub"]

    def nearest(parts: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(parts).sort_values(["depth", "id"], kind="stable").drop_duplicates(where)

    def hits(df: pd.DataFrame):
        df = df.sort_values(["depth", "id"], kind="stable")
        set_, lam, alpha, cx, cy, sxx, sxy, syy = (df[c].to_numpy() for c in ("set", "lam", "alpha", "cx", "cy", "sxx", "sxy", "syy"))
        key = (df["id"].to_numpy(np.uint64) * np.uint64(1_000_003) + set_.astype(np.uint64)) * np.uint64(4096)
        n = poisson(lam, seed, key)
        whole = dilog(np.clip(alpha, 0, 1))
        l11 = np.sqrt(sxx)
        l21 = sxy / l11
        l22 = np.sqrt(np.maximum(0, syy - l21 * l21))
        ends = np.cumsum(n)
        for lo in range(0, int(ends[-1]) if len(ends) else 0, THROWN):
            first, last = np.clip(ends - n, lo, lo + THROWN), np.clip(ends, lo, lo + THROWN)
            row = np.repeat(np.arange(len(n)), last - first)
            i = key[row] + (lo + np.arange(len(row)) - (ends - n)[row]).astype(np.uint64)
            r = sample_corrected_radius(alpha[row], uniform(seed + 1, i), whole[row])
            t = 2 * math.pi * uniform(seed + 2, i)
            x = cx[row] + l11[row] * r * np.cos(t)
            y = cy[row] + l21[row] * r * np.cos(t) + l22[row] * r * np.sin(t)
            px, py = np.floor(x), np.floor(y)
            sub = np.minimum(spp - 1, np.floor((x - px) * spp)) + spp * np.minimum(spp - 1, np.floor((y - py) * spp))
            ok = (px >= 0) & (px < width) & (py >= 0) & (py < height)
            row, px, py, sub = row[ok], *(v[ok].astype(np.int32) for v in (px, py, sub))
            place = ((set_[row] * np.int64(height) + py) * width + px) * (spp * spp) + sub
            new = ~pd.Series(place).duplicated().to_numpy()  # rows go by depth, so the first is the nearest
            row = row[new]
            yield pd.DataFrame({"set": set_[row], "px": px[new], "py": py[new], "sub": sub[new]}).assign(**{c: df[c].to_numpy()[row] for c in ("depth", "id", "r", "g", "b")})

    def throw(batches):
        parts: list[pd.DataFrame] = []
        for df in batches:
            for part in hits(df):
                parts.append(part)
                if sum(map(len, parts)) > THROWN:
                    parts = [nearest(parts)]
                    if len(parts[0]) > THROWN // 2:
                        yield parts.pop()
        if parts:
            yield nearest(parts)

    rows = p.select("id", "set", "lam", "alpha", "cx", "cy", "sxx", "sxy", "syy", "depth", "r", "g", "b")
    hit = rows.mapInPandas(throw, "set int, px int, py int, sub int, depth double, id bigint, r double, g double, b double")
    near = hit.groupBy(*where).agg(F.min_by(F.struct("r", "g", "b"), F.struct("depth", "id")).alias("c"))
    total = float(sets * spp * spp)
    pixels = near.groupBy("px", "py").agg(*[(F.sum(f"c.{k}") / total).alias(k) for k in "rgb"], (F.count(F.lit(1)) / total).alias("coverage"))
    return full_image(splats.sparkSession, pixels, width, height, background)


def packed_color(r="r", g="g", b="b"):
    """Colours in 0-1 as one integer of three bytes."""
    byte = lambda c: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))) * 255 + 0.5).cast("bigint")
    return byte(r) * 65536 + byte(g) * 256 + byte(b)


def scatter(points: DataFrame, *keys: str) -> DataFrame:
    """The point that each pixel (``keys``) shows: the nearest, at equal depth the one of the
    least packed colour. Depths are compared as floats; one aggregate that combines
    on the map side does what a renderer does in a pass for depths and one for colours."""
    order = F.struct(F.col("depth").cast("float").alias("d"), packed_color().alias("k"))
    near = points.groupBy(*keys).agg(F.min_by(F.struct("r", "g", "b"), order).alias("c"), F.min(order).alias("o"))
    return near.select(*keys, "c.r", "c.g", "c.b", F.col("o.d").alias("depth"), F.col("o.k").alias("packed"))


def render_particles(splats: DataFrame, view, focal: float, width: int, height: int, level: str = "footprint", rule: str = "extinction", radial: bool = False,
                     base: float = 512.0, pixel_length: float = 0.01, near: float = 0.05, jitter: bool = True, centre_depth: bool = False, spp: int = 2,
                     sets: int = 32, seed: int = 42, background=(0.0, 0.0, 0.0)) -> DataFrame:
    """Particles in space in place of splats: each splat throws a Poisson number of
    points of its 3D distribution for each set, calibrated by ``level`` and
    ``rule``; they are projected one by one, and subpixels show the nearest.
    ``radial`` drops points so that the footprint's opacity is met; ``jitter`` adds the
    low pass; ``centre_depth`` gives all points of a splat its own depth."""
    m = np.asarray(view, float)
    p = project(splats, view, focal, width, height)
    centre = splats.agg(*[F.avg(a).alias(a) for a in "xyz"]).first()
    object_depth = float(m[2, :3] @ [centre[a] or 0.0 for a in "xyz"] + m[2, 3])
    area = footprint_area("sxx", "sxy", "syy")
    lam = calibrated_count(level, rule, F.col("alpha"), base, 1.0, object_depth=F.lit(object_depth), splat_depth="depth", area=area, focal=(focal, focal), pixel_length=pixel_length, near=near, spp=float(spp * spp))
    p = p.withColumn("lam", lam)
    turn = [q.alias(f"q{i}") for i, q in enumerate(unit_quaternion(F.col("rot")))] + [F.exp(F.col("scale")[i]).alias(f"s{i}") for i in range(3)]
    own = _steps(splats, ["id", "x", "y", "z"], turn)
    each = p.join(own, "id").withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))

    def throw(batches):
        for df in batches:
            a = {c: df[c].to_numpy() for c in df.columns}
            key = (a["id"].astype(np.uint64) * np.uint64(1_000_003) + a["set"].astype(np.uint64)) * np.uint64(1 << 16)
            n = poisson(a["lam"].astype(float), seed, key)
            row = np.repeat(np.arange(len(n)), n)
            i = key[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
            g = np.stack([normal(seed + 10 + k, i) for k in range(3)], -1) * np.stack([a[f"s{k}"][row] for k in range(3)], -1)
            w, x, y, z = (a[f"q{k}"][row] for k in range(4))
            rot = np.stack([np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], -1),
                            np.stack([2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], -1),
                            np.stack([2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)], -1)], -2)
            at = np.stack([a[c][row] for c in "xyz"], -1) + np.einsum("nij,nj->ni", rot, g)
            cam = at @ m[:, :3].T + m[:, 3]
            ok = cam[:, 2] > near
            depth = np.where(ok, cam[:, 2], 1.0)
            u, v = cam[:, 0] / depth * focal + width / 2, cam[:, 1] / depth * focal + height / 2
            if jitter:
                u, v = u + LOW_PASS**0.5 * normal(seed + 20, i), v + LOW_PASS**0.5 * normal(seed + 21, i)
            if radial:
                sxx, sxy, syy, o = (a[c][row] for c in ("sxx", "sxy", "syy", "alpha"))
                du, dv = u - a["cx"][row], v - a["cy"][row]
                r2 = (syy * du * du - 2 * sxy * du * dv + sxx * dv * dv) / (sxx * syy - sxy * sxy)
                ratio = lambda t: np.where(t < 1e-8, 1 + 0.5 * t, -np.log1p(-np.maximum(t, 1e-8)) / np.maximum(t, 1e-8))
                o = np.minimum(o, 1 - 1e-12)
                ok &= uniform(seed + 30, i) < ratio(o * np.exp(-0.5 * r2)) / ratio(o)
            px, py = np.floor(u), np.floor(v)
            ok &= (px >= 0) & (px < width) & (py >= 0) & (py < height)
            sub = np.minimum(spp - 1, np.floor((u - px) * spp)) + spp * np.minimum(spp - 1, np.floor((v - py) * spp))
            if centre_depth:
                depth = a["depth"][row]
            yield pd.DataFrame({"set": a["set"][row][ok], "px": px[ok].astype(np.int32), "py": py[ok].astype(np.int32), "sub": sub[ok].astype(np.int32), "depth": depth[ok], **{c: a[c][row][ok] for c in "rgb"}})

    hit = each.mapInPandas(throw, "set int, px int, py int, sub int, depth double, r double, g double, b double")
    total = float(sets * spp * spp)
    pixels = scatter(hit, "set", "px", "py", "sub").groupBy("px", "py").agg(*[(F.sum(c) / total).alias(c) for c in "rgb"], (F.count(F.lit(1)) / total).alias("coverage"))
    return full_image(splats.sparkSession, pixels, width, height, background)


def psnr(a: DataFrame, b: DataFrame) -> DataFrame:
    """Peak 1, over all channels; 120 dB for (nearly) equal images."""
    j = a.join(b.select("px", "py", *[F.col(c).alias(f"{c}2") for c in "rgb"]), ["px", "py"])
    mse = F.avg(sum(((F.col(c) - F.col(f"{c}2")) * (F.col(c) - F.col(f"{c}2")) for c in "rgb"), F.lit(0.0)) / 3)
    return j.agg(mse.alias("mse")).select("mse", F.when(F.col("mse") <= 1e-20, 120.0).otherwise(-10 * F.log10("mse")).alias("psnr"))


def ssim(a: DataFrame, b: DataFrame, width: int, height: int, size: int = 8, step: int = 4) -> DataFrame:
    """Mean structural similarity of luminance over windows of 8 x 8, 4 apart.
    Pixels are dealt to the windows that hold them; moments decide."""
    lum = lambda p: 0.2126 * F.col(f"r{p}") + 0.7152 * F.col(f"g{p}") + 0.0722 * F.col(f"b{p}")
    j = a.join(b.select("px", "py", *[F.col(c).alias(f"{c}2") for c in "rgb"]), ["px", "py"]).select("px", "py", lum("").alias("u"), lum("2").alias("v"))

    def windows(p: str, n: int):
        last = (n - size) // step
        lo = F.greatest(F.lit(0), F.ceil((F.col(p) - (size - 1)) / step).cast("int"))
        hi = F.least(F.lit(last), F.floor(F.col(p) / step).cast("int"))
        return F.explode(F.when(lo <= hi, F.sequence(lo, hi)))

    w = j.withColumn("wx", windows("px", width)).withColumn("wy", windows("py", height))
    m = w.groupBy("wx", "wy").agg(F.avg("u").alias("mu"), F.avg("v").alias("mv"), F.var_samp("u").alias("su"), F.var_samp("v").alias("sv"), F.covar_samp("u", "v").alias("c"))
    c1, c2 = 0.01**2, 0.03**2
    s = (2 * F.col("mu") * F.col("mv") + c1) * (2 * F.col("c") + c2) / ((F.col("mu") * F.col("mu") + F.col("mv") * F.col("mv") + c1) * (F.col("su") + F.col("sv") + c2))
    return m.agg(F.avg(s).alias("ssim"))


def thin(target: float, active: float, budget: float) -> float:
    """The next share of splats to draw: an average of old (.6) and wanted (.4)
    within [.02, 1]; unchanged within half a per cent."""
    wanted = min(1.0, max(0.02, target * budget / active)) if active > 0 else 1.0
    new = 0.6 * target + 0.4 * wanted
    return target if abs(new - target) < 0.005 else min(1.0, max(0.02, new))


def particles(splats: DataFrame, density: float = 1.0, most: int = 8, seed: int = 42) -> DataFrame:
    """``(splat_id, n, x, y, z, r, g, b)``: up to ``most`` particles a splat, their
    number alpha * density * most to the nearest (which may be none), placed by its 3D
    covariance, of the splat's colour."""
    cov = covariance_3d(F.col("scale"), F.col("rot"))
    count = F.least(F.lit(most), F.floor(sigmoid("opacity") * density * most + 0.5).cast("int"))
    s = splats.withColumns({f"v{k}": v for k, v in cov.items()}).withColumn("n", F.explode(F.when(count > 0, F.sequence(F.lit(1), count))))

    @F.pandas_udf("struct<dx: double, dy: double, dz: double>")
    def offset(i: pd.Series, n: pd.Series, xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
        key = i.to_numpy(np.uint64) * np.uint64(64) + n.to_numpy(np.uint64)
        g = np.stack([normal(seed + k, key) for k in range(3)], -1)
        a = np.stack([np.stack([xx, xy, xz], -1), np.stack([xy, yy, yz], -1), np.stack([xz, yz, zz], -1)], -2)
        low = np.linalg.cholesky(a + 1e-18 * np.eye(3))
        d = np.einsum("nij,nj->ni", low, g)
        return pd.DataFrame({"dx": d[:, 0], "dy": d[:, 1], "dz": d[:, 2]})

    o = s.withColumn("o", offset("id", "n", "vxx", "vxy", "vxz", "vyy", "vyz", "vzz"))
    colors = [F.greatest(F.lit(0.0), sh_dc_to_color(F.col("f_dc")[i])).alias(c) for i, c in enumerate("rgb")]
    return o.select(F.col("id").alias("splat_id"), "n", *[(F.col(a) + F.col(f"o.d{a}")).alias(a) for a in "xyz"], *colors)


def cull(projected: DataFrame, width: int, height: int, min_alpha: float = 0.0, min_area: float = 0.0, reach: float = 12.0) -> DataFrame:
    """Projected splats without the faint, the small and those whose ``reach``
    sigma box misses the image."""
    area = 2 * math.pi * F.sqrt(F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy"))
    rx, ry = reach * F.sqrt("sxx"), reach * F.sqrt("syy")
    seen = (F.col("cx") + rx >= 0) & (F.col("cx") - rx <= width) & (F.col("cy") + ry >= 0) & (F.col("cy") - ry <= height)
    return projected.where((F.col("alpha") > min_alpha) & (area >= min_area) & seen)


def render_samples(splats: DataFrame, pixels: DataFrame, view, focal: float, width: int, height: int, background=(0.0, 0.0, 0.0)) -> DataFrame:
    """The analytic image at the pixels (px, py) alone: others are dropped before
    compositing."""
    layers = covered(project(splats, view, focal, width, height), width, height).join(F.broadcast(pixels), ["px", "py"], "left_semi")  # at most the image's pixels
    lit = pixels.join(composite(layers), ["px", "py"], "left")
    rest = 1 - F.coalesce("coverage", F.lit(0.0))
    return lit.select("px", "py", *[(F.coalesce(c, F.lit(0.0)) + rest * float(v)).alias(c) for c, v in zip("rgb", background, strict=True)])


def validate_render(image: DataFrame, oracle: DataFrame, background=(0.0, 0.0, 0.0), gates=(25.0, 18.0)) -> DataFrame:
    """PSNR over sampled pixels, over all and over the foreground (more than 0.01
    from the background in the oracle), and whether both pass their gates."""
    diff = F.greatest(*[F.abs(F.col(c) - float(v)) for c, v in zip("rgb", background, strict=True)])
    front = oracle.where(diff > 0.01)
    a = psnr(oracle, image).select(F.col("psnr").alias("psnr_all"))
    b = psnr(front, image).select(F.col("psnr").alias("psnr_foreground"))
    both = a.crossJoin(b)  # one row each
    return both.withColumn("passed", (F.col("psnr_all") >= gates[0]) & (F.coalesce("psnr_foreground", F.lit(120.0)) >= gates[1]))


def draw_sorted(splats: DataFrame, eye, view, focal: float, width: int, height: int, size_scale: float = 1.0) -> DataFrame:
    """Points of size / depth (at least one pixel) blended from far to near, with weight
    exp(-4 d^2) within the unit disc and the splat's own ellipse."""
    p = present(splats, size_scale)
    m = np.asarray(view, float)
    c = [sum((F.col(a) * m[i, j] for j, a in enumerate("xyz")), F.lit(m[i, 3])) for i in range(3)]
    s = p.withColumns({"tx": c[0], "ty": c[1], "depth": c[2]}).where(F.col("depth") > NEAR)
    s = s.withColumns({"cx": F.col("tx") / F.col("depth") * focal + width / 2, "cy": F.col("ty") / F.col("depth") * focal + height / 2, "half": F.greatest(F.lit(1.0), F.col("size") * focal / F.col("depth")) / 2})
    edge = lambda c, sign, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(F.col(c) + sign * F.col("half")).cast("int")))
    box = s.withColumn("px", F.explode(F.sequence(edge("cx", -1, width), edge("cx", 1, width))))
    box = box.withColumn("py", F.explode(F.sequence(edge("cy", -1, height), edge("cy", 1, height))))
    u, v = (F.col("px") + 0.5 - F.col("cx")) / F.col("half"), (F.col("py") + 0.5 - F.col("cy")) / F.col("half")
    g = [F.col(f"row{i}")[0] * u + F.col(f"row{i}")[1] * v for i in range(3)]
    d2 = g[0] * g[0] + g[1] * g[1] + g[2] * g[2]
    hit = box.where((u * u + v * v <= 1) & (d2 <= 1)).withColumn("w", F.exp(-4 * d2))
    layers = hit.select("id", "px", "py", "depth", *[F.col(k) for k in "rgb"], (F.col("a") * F.col("w")).alias("a"))
    return full_image(splats.sparkSession, composite(layers), width, height)


def image_array(image: DataFrame, width: int, height: int) -> np.ndarray:
    """(height, width, 3); an image is as large as a screen, whatever the cloud."""
    out = np.zeros((height, width, 3))
    p = image.select("px", "py", "r", "g", "b").toPandas()
    out[p["py"], p["px"]] = p[["r", "g", "b"]]
    return out


def export_pfm(image: DataFrame, width: int, height: int, path: str) -> None:
    """A linear PFM file. With a column ``samples`` all pixels must have as many."""
    from ..plans.filestore import write_bytes
    from ..sources.codec import pfm_bytes

    if "samples" in image.columns and image.select("samples").distinct().count() > 1:
        raise ValueError("pixels have different numbers of samples")
    write_bytes(path, [pfm_bytes(image_array(image, width, height))])
