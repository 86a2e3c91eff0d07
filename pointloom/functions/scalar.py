"""Scalar functions: columns where built-ins express them, numpy otherwise."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Real spherical harmonics constants by degree.
SH0 = 0.28209479177387814
SH1 = 0.4886025119029199
SH2 = (1.0925484305920792, -1.0925484305920792, 0.31539156525252005, -1.0925484305920792, 0.5462742152960396)
SH3 = (-0.5900435899266435, 2.890611442640554, -0.4570457994644658, 0.3731763325901154, -0.4570457994644658, 1.445305721320277, -0.5900435899266435)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def clamp(x, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), _c(x)))


def srgb_to_linear(x) -> Column:
    v = clamp(x)
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(x) -> Column:
    v = clamp(x)
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def logit(p) -> Column:
    """With -40 and 40 at the ends."""
    v = _c(p)
    return F.when(v <= 0, -40.0).when(v >= 1, 40.0).otherwise(F.log(v / (1 - v)))


def sh_dc_to_color(x) -> Column:
    return 0.5 + SH0 * _c(x)


def color_to_sh_dc(x) -> Column:
    return (_c(x) - 0.5) / SH0


def eval_sh(degree: int, dc, rest: Column, channel: int, direction: tuple, stride: int) -> Column:
    """Colour of a channel seen along a unit direction; ``rest`` holds ``stride``
    coefficients a channel, channel by channel; not below 0."""
    x, y, z = (_c(d) for d in direction)
    k = lambda i: rest[channel * stride + i]
    out = SH0 * _c(dc)
    if degree >= 1:
        out = out - SH1 * y * k(0) + SH1 * z * k(1) - SH1 * x * k(2)
    if degree >= 2:
        xx, yy, zz = x * x, y * y, z * z
        basis = (x * y, y * z, 2 * zz - xx - yy, x * z, xx - yy)
        for i, (c, b) in enumerate(zip(SH2, basis, strict=True)):
            out = out + c * b * k(3 + i)
    if degree >= 3:
        basis = (y * (3 * xx - yy), x * y * z, y * (4 * zz - xx - yy), z * (2 * zz - 3 * xx - 3 * yy), x * (4 * zz - xx - yy), z * (xx - yy), x * (xx - 3 * yy))
        for i, (c, b) in enumerate(zip(SH3, basis, strict=True)):
            out = out + c * b * k(8 + i)
    return F.greatest(F.lit(0.0), out + 0.5)


def unit_quaternion(q: Column) -> list[Column]:
    """(w, x, y, z) at unit length; no rotation for a zero quaternion."""
    n = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    return [F.when(n > 0, q[i] / n).otherwise(1.0 if i == 0 else 0.0) for i in range(4)]


def rotation_rows(w: Column, x: Column, y: Column, z: Column) -> list[list[Column]]:
    """Rows of the rotation of a unit quaternion."""
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def quat_to_rotation(q: Column) -> list[list[Column]]:
    """Rows of the rotation of (w, x, y, z), scaled to unit length first."""
    return rotation_rows(*unit_quaternion(q))


def turned_squares(r: list[list[Column]], s2: list[Column]) -> dict[str, Column]:
    """R diag(s2) R^T."""
    return {a + b: sum((r["xyz".index(a)][k] * r["xyz".index(b)][k] * s2[k] for k in range(3)), F.lit(0.0)) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")}


def covariance_3d(scale: Column, rot: Column) -> dict[str, Column]:
    """R S S R^T of log scales and a quaternion."""
    return turned_squares(quat_to_rotation(rot), [F.exp(2 * scale[i]) for i in range(3)])


def footprint_area(sxx, sxy, syy) -> Column:
    """2 pi sqrt(det) of a 2D covariance."""
    return 2 * math.pi * F.sqrt(F.greatest(F.lit(0.0), _c(sxx) * _c(syy) - _c(sxy) * _c(sxy)))


def pixel_density_scale(depth, focal_x: float, focal_y: float, pixel_length: float, near: float = 0.0) -> Column:
    """Pixels that a square of ``pixel_length`` covers at a depth, at most 1e12; 0 in
    front of the near plane or for a bad camera."""
    d = _c(depth)
    if not (focal_x > 0 and focal_y > 0 and pixel_length > 0):
        return F.lit(0.0)
    ratio = pixel_length / d
    return F.when(d > max(near, 0.0), F.least(F.lit(1e12), ratio * ratio * focal_x * focal_y)).otherwise(0.0)


def alpha_at(opacity, dx, dy, sxx, sxy, syy) -> Column:
    """Opacity at an offset from a projected splat's centre."""
    a, b, c = _c(sxx), _c(sxy), _c(syy)
    det = a * c - b * b
    x, y = _c(dx), _c(dy)
    return _c(opacity) * F.exp(-0.5 * (c * x * x - 2 * b * x * y + a * y * y) / det)


def expected_coverage(alpha, pixel_area=1.0) -> Column:
    """1 - (1 - alpha)^area."""
    return 1 - F.pow(1 - clamp(alpha, 0.0, 1 - 1e-15), _c(pixel_area))


def over(front: list, front_alpha, back: list, back_alpha, premultiplied: bool = False) -> list[Column]:
    """Colour over colour: r, g, b, a."""
    s, d = clamp(front_alpha), clamp(back_alpha)
    a = s + d * (1 - s)
    if premultiplied:
        return [*[_c(f) + _c(b) * (1 - s) for f, b in zip(front, back, strict=True)], a]
    return [*[F.when(a > 0, (_c(f) * s + _c(b) * d * (1 - s)) / a).otherwise(0.0) for f, b in zip(front, back, strict=True)], a]


def pack_hdr(r, g, b) -> Column:
    """Linear colour in 11, 11 and 10 bits of log2(c + 1) / 16."""
    q = [F.floor(clamp(F.log2(F.greatest(F.lit(0.0), _c(c)) + 1) / 16) * n + 0.5).cast("bigint") for c, n in ((r, 2047), (g, 2047), (b, 1023))]
    return q[0].bitwiseOR(F.shiftleft(q[1], 11)).bitwiseOR(F.shiftleft(q[2], 22))


def unpack_hdr(packed) -> list[Column]:
    p = _c(packed)
    return [F.pow(F.lit(2.0), F.shiftright(p, s).bitwiseAND(F.lit(n)) / float(n) * 16) - 1 for s, n in ((0, 2047), (11, 2047), (22, 1023))]


def tonemap(x, kind: str = "none") -> Column:
    """none, reinhard or aces, then gamma 2.2."""
    v = F.greatest(F.lit(0.0), _c(x))
    if kind == "reinhard":
        v = v / (1 + v)
    elif kind == "aces":
        v = clamp(v * (2.51 * v + 0.03) / (v * (2.43 * v + 0.59) + 0.14))
    elif kind != "none":
        raise ValueError(f"unknown tone map {kind}")
    return F.pow(v, F.lit(1 / 2.2))


def hsv_to_rgb(h, s, v) -> list[Column]:
    """Hue in turns."""
    h, s, v = _c(h), _c(s), _c(v)
    out = []
    for n in (5, 3, 1):
        k = (n + h * 6) % 6
        out.append(v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0))))
    return out


def cluster_color(cluster_id) -> list[Column]:
    """Golden-ratio hues; gray below 0."""
    c = _c(cluster_id)
    hue = (c * 0.61803398875) % 1.0
    return [F.when(c < 0, 0.5).otherwise(x) for x in hsv_to_rgb(hue, 0.65, 0.95)]


def ordered_depth_key(depth: np.ndarray) -> np.ndarray:
    """uint32 keys that sort as the float32 depths do."""
    b = np.asarray(depth, np.float32).view(np.uint32)
    return np.where(b >> np.uint32(31), ~b, b | np.uint32(0x80000000))


def depth_of_key(key: np.ndarray) -> np.ndarray:
    key = np.asarray(key, np.uint32)
    return np.where(key >> np.uint32(31), key & np.uint32(0x7FFFFFFF), ~key).astype(np.uint32).view(np.float32)


def pack_depth_color(depth: np.ndarray, rgb8: np.ndarray) -> np.ndarray:
    c = np.asarray(rgb8, np.uint64)
    return ordered_depth_key(depth).astype(np.uint64) << np.uint64(32) | c[..., 0] << np.uint64(16) | c[..., 1] << np.uint64(8) | c[..., 2]


def dilog(x: np.ndarray) -> np.ndarray:
    """Li2 on (-inf, 1]: reflected to [0, 1/2], then the power series."""
    x = np.asarray(x, float)
    out = np.zeros_like(x)
    series = lambda t: sum(t**k / k**2 for k in range(1, 60))
    with np.errstate(divide="ignore", invalid="ignore"):
        mid = (x >= 0) & (x <= 0.5)
        high = (x > 0.5) & (x < 1)
        neg = (x < 0) & (x >= -1)
        low = x < -1
        out[mid] = series(x[mid])
        out[high] = math.pi**2 / 6 - np.log(x[high]) * np.log1p(-x[high]) - series(1 - x[high])
        out[x >= 1] = math.pi**2 / 6
        t = x[neg] / (x[neg] - 1)
        out[neg] = -series(t) - 0.5 * np.log1p(-x[neg]) ** 2
        y = 1 / x[low]
        t = y / (y - 1)
        out[low] = -math.pi**2 / 6 - 0.5 * np.log(-x[low]) ** 2 + series(t) + 0.5 * np.log1p(-y) ** 2
    return out


#: B_2k / (2 k + 1)!: Li2(1 - e^-t) = t - t^2 / 4 + the sum of these times t^(2 k + 1).
_BERNOULLI = [b / math.factorial(2 * k + 3) for k, b in enumerate((1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730, 7 / 6, -3617 / 510, 43867 / 798, -174611 / 330))]


def _dilog_of_log(t: np.ndarray) -> np.ndarray:
    """Li2(1 - e^-t) for t in [0, ln 2]."""
    t2, s = t * t, np.zeros_like(t)
    for c in reversed(_BERNOULLI):
        s = s * t2 + c
    return t * (1 - t / 4 + t2 * s)


def inv_dilog(y: np.ndarray) -> np.ndarray:
    """The x in [0, 1] with Li2(x) = y: a table's guess and two Newton steps, whose
    derivative is -ln(1 - x) / x. Each reads two logarithms and a short series."""
    y = np.clip(np.asarray(y, float), 0, math.pi**2 / 6)
    at = -np.expm1(-np.linspace(0, 40, 4001))
    x = np.interp(y, dilog(at), at)
    tiny = np.finfo(float).tiny
    for _ in range(2):
        x = np.clip(x, tiny, 1 - 2.0**-53)
        log, rest = -np.log(x), -np.log1p(-x)
        high = x > 0.5
        s = _dilog_of_log(np.where(high, log, rest))
        x = x - (np.where(high, math.pi**2 / 6 - log * rest - s, s) - y) * x / rest
    return np.where(y <= 0, 0.0, np.clip(x, 0, 1))


@F.pandas_udf(T.DoubleType())
def expected_point_count(alpha: pd.Series, area: pd.Series) -> pd.Series:
    """Points a splat of peak opacity alpha and area 2 pi sqrt(det) needs for its
    coverage 1 - exp(-lambda) to give the opacity: area / (2 pi) * integral of
    -ln(1 - alpha e^-t), which is the dilogarithm of alpha, times 2 pi."""
    return pd.Series(area.to_numpy() * dilog(np.minimum(alpha.to_numpy(), 1)))


@F.pandas_udf(T.DoubleType())
def dilog_udf(x: pd.Series) -> pd.Series:
    return pd.Series(dilog(np.minimum(np.maximum(x.to_numpy(float), 0), 1)))


TOP_OPACITY = 1 - 1e-12


def opacity_term(rule: str, opacity) -> Column:
    """How a splat's points grow with its opacity: proportional, extinction
    (-ln(1 - o)) or dilog."""
    o = F.least(_c(opacity), F.lit(TOP_OPACITY))
    g = {"proportional": lambda: o, "extinction": lambda: -F.log(1 - o), "dilog": lambda: dilog_udf(o)}[rule]()
    return F.when(o > 0, g).otherwise(0.0)


def calibrated_count(level: str, rule: str, opacity, base: float, density: float, *, object_depth=None, splat_depth=None, area=None, focal=(1.0, 1.0),
                     pixel_length: float = 1.0, near: float = 0.0, spp: float = 1.0) -> Column:
    """Expected points: level none (base alone), zoom (one scale for the object's
    depth), depth (each splat's own), or footprint (subpixels of its area)."""
    if level == "none":
        scale = F.lit(base)
    elif level in ("zoom", "depth"):
        scale = base * pixel_density_scale(object_depth if level == "zoom" else splat_depth, *focal, pixel_length, near)
    elif level == "footprint":
        scale = spp * _c(area)
    else:
        raise ValueError(f"unknown level {level}")
    return F.greatest(F.lit(0.0), max(density, 0.0) * opacity_term(rule, opacity) * scale)


def radial_keep_probability(opacity, r2) -> Column:
    """Share of extinction points to keep at a squared radius so that the rest have the
    density -ln(1 - o e^(-r2 / 2))."""
    o = F.least(_c(opacity), F.lit(TOP_OPACITY))
    y = o * F.exp(-0.5 * F.greatest(F.lit(0.0), _c(r2)))
    ratio = lambda x: F.when(x < 1e-8, 1 + 0.5 * x).otherwise(-F.log1p(-x) / x)
    return F.when(o > 0, clamp(ratio(y) / ratio(o))).otherwise(1.0)


def footprint_point_count(expected, subpixels: int) -> Column:
    return F.greatest(F.lit(0.0), _c(expected)) / float(max(1, subpixels) ** 2)


def adaptive_footprint(sigma, kappa: float, largest: int) -> Column:
    """floor(kappa * sigma) within 1 and ``largest``."""
    if kappa <= 0:
        return F.lit(1)
    s = F.floor(kappa * _c(sigma))
    return F.when(_c(sigma) > 0, F.greatest(F.lit(1), F.least(F.lit(max(1, largest)), s))).otherwise(1).cast("int")


def density_clamp(count, sx, sy, sz, depth, focal: float) -> Column:
    """At most a point for each cube of a pixel's length in the splat's volume."""
    pixel = _c(depth) / focal
    return F.least(_c(count), 4 / 3 * math.pi * _c(sx) * _c(sy) * _c(sz) / (pixel * pixel * pixel))


def view_conditioned_keep(count, area, opacity, spp: float, density: float) -> Column:
    """Share of candidates to keep so that those on the screen number what the
    footprint asks for; 0 for half a candidate or less."""
    target = spp * _c(area) * dilog_udf(_c(opacity)) * density
    return F.when(_c(count) > 0.5, clamp(target / _c(count))).otherwise(0.0)


def sample_corrected_radius(opacity: np.ndarray, u: np.ndarray, whole: np.ndarray | None = None) -> np.ndarray:
    """The radius below which a share u of a splat's corrected points lies. ``whole``:
    the opacities' dilogarithms, if they are known."""
    o, u = np.clip(opacity, 0, 1), np.clip(u, 0, 1)
    y = np.minimum(inv_dilog((1 - u) * (dilog(o) if whole is None else whole)), o)
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.sqrt(np.maximum(0, -2 * np.log(y / o)))
    return np.where(o <= 0, 0.0, np.where(y <= 0, 40.0, r))


def stochastic_round(lam: np.ndarray, u: np.ndarray) -> np.ndarray:
    return np.floor(lam).astype(np.int64) + (u < lam - np.floor(lam))
