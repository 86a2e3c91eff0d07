"""RANSAC models: a table of hypotheses scored in one pass over the points.

Hypotheses are few (one row an iteration), so they travel to every task; points
never move. The best has most inliers, the earliest iteration on ties.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import uniform

#: Rows and numbers a row of each kind's parameters.
KINDS = {
    "plane": ("a", "b", "c", "d"),
    "sphere": ("x", "y", "z", "r"),
    "cylinder": ("px", "py", "pz", "ax", "ay", "az", "r"),
    "cone": ("px", "py", "pz", "ax", "ay", "az", "t"),
}
SAMPLE = {"plane": 3, "sphere": 4, "cylinder": 20, "cone": 20}


def samples(df: DataFrame, iterations: int, size: int, seed: int) -> np.ndarray:
    """Points drawn for each iteration, ``(iterations, size, 3)``: from a fixed pool
    of the points with the smallest hashes, so at most ``iterations * size`` reach the driver."""
    pool = df.select("id", "x", "y", "z").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(iterations * size).collect()
    p = np.array([[r["x"], r["y"], r["z"]] for r in pool], float).reshape(-1, 3)
    n = len(p)
    if n < min(size, 3):
        return np.zeros((0, size, 3))
    out = np.zeros((iterations, size, 3))
    for i in range(iterations):
        order = np.argsort(uniform(seed + i, np.arange(n)), kind="stable")
        out[i] = p[np.resize(order[:size], size)]
    return out


def plane_of(p: np.ndarray) -> tuple | None:
    c = np.cross(p[1] - p[0], p[2] - p[0])
    length = np.linalg.norm(c)
    if length < 1e-6:
        return None
    n = c / length
    return (*n, -n @ p[0])


def sphere_of(p: np.ndarray) -> tuple | None:
    a = p[1:4] - p[0]
    if abs(np.linalg.det(a)) / 6 < 1e-9:
        return None
    o = np.linalg.solve(2 * a, (a * a).sum(1))
    r = np.linalg.norm(o)
    return None if r < 1e-6 else (*(p[0] + o), r)


def cylinder_of(p: np.ndarray, axis: int = 0) -> tuple | None:
    """Axis: the sample's direction of least variance (0), or another of the three."""
    c = p.mean(0)
    a = np.linalg.eigh(np.cov((p - c).T))[1][:, axis]
    q = (p - c) - np.outer((p - c) @ a, a)
    r = float(np.sort(np.linalg.norm(q, axis=1))[len(p) // 2])
    return None if r < 1e-6 else (*c, *a, r)


def cone_of(p: np.ndarray) -> tuple | None:
    """Axis: the direction of most variance; radius = slope * height by a line fit;
    (apex, axis, tan of the half angle)."""
    if len(p) < 6:
        return None
    c = p.mean(0)
    a = np.linalg.eigh(np.cov((p - c).T))[1][:, 2]
    h = (p - c) @ a
    r = np.linalg.norm((p - c) - np.outer(h, a), axis=1)
    if np.ptp(h) < 1e-9:
        return None
    slope, base = np.polyfit(h, r, 1)
    if abs(slope) < 1e-9:
        return None
    if slope < 0:
        a, slope = -a, -slope
    apex = c - a * (base / slope)
    return None if not 1e-3 <= np.arctan(slope) <= 1.55 else (*apex, *a, slope)


MAKE = {"plane": plane_of, "sphere": sphere_of, "cylinder": cylinder_of, "cone": cone_of}


def residual(kind: str, m: str = "h"):
    """Distance of a point to the model in column ``m``."""
    x, y, z = (F.col(a) for a in "xyz")
    g = lambda n: F.col(f"{m}.{n}")
    if kind == "plane":
        return F.abs(g("a") * x + g("b") * y + g("c") * z + g("d"))
    if kind == "sphere":
        dx, dy, dz = x - g("x"), y - g("y"), z - g("z")
        return F.abs(F.sqrt(dx * dx + dy * dy + dz * dz) - g("r"))
    dx, dy, dz = x - g("px"), y - g("py"), z - g("pz")
    t = dx * g("ax") + dy * g("ay") + dz * g("az")
    q = F.sqrt(F.greatest(F.lit(0.0), dx * dx + dy * dy + dz * dz - t * t))
    if kind == "cylinder":
        return F.abs(q - g("r"))
    return F.when(t < 0, F.sqrt(t * t + q * q)).otherwise(F.abs(q - t * g("t")) / F.sqrt(1 + g("t") * g("t")))


def hypotheses(df: DataFrame, kind: str, iterations: int, seed: int, all_axes: bool = False) -> DataFrame:
    rows = []
    for i, p in enumerate(samples(df, iterations, SAMPLE[kind], seed)):
        made = [cylinder_of(p, k) for k in range(3)] if kind == "cylinder" and all_axes else [MAKE[kind](p)]
        rows += [(i, *map(float, h)) for h in made if h is not None]
    return df.sparkSession.createDataFrame(rows, "iteration int, " + ", ".join(f"{c} double" for c in KINDS[kind]))


def score(df: DataFrame, hyps: DataFrame, kind: str, threshold: float) -> DataFrame:
    """Inliers of each hypothesis. The pairs of points and hypotheses are counted
    as they come and combine on the map side."""
    h = hyps.select("iteration", F.struct(*KINDS[kind]).alias("h"))
    met = df.select("x", "y", "z").join(F.broadcast(h), F.lit(True)).where(residual(kind) <= threshold)  # a row an iteration
    return met.groupBy("iteration", "h").agg(F.count(F.lit(1)).alias("inliers"))


def best(scores: DataFrame) -> DataFrame:
    return scores.agg(F.max_by(F.struct("h", "inliers", "iteration"), F.struct("inliers", -F.col("iteration"))).alias("m")).where("m IS NOT NULL").select("m.*")


def ransac(df: DataFrame, kind: str, iterations: int = 200, threshold: float = 0.02, min_inliers: int = 50, seed: int = 42, all_axes: bool = False):
    """(model row or None, cloud with ``inlier``). For the cylinder ``all_axes``
    tries all three principal directions of a sample."""
    if df.limit(SAMPLE[kind] if kind in ("plane", "sphere") else 6).count() < (SAMPLE[kind] if kind in ("plane", "sphere") else 6):
        return None, df.withColumn("inlier", F.lit(False))
    hyps = hypotheses(df, kind, iterations, seed, all_axes)
    m = best(score(df, hyps, kind, threshold)).first()
    if m is None or m["inliers"] < min_inliers:
        return None, df.withColumn("inlier", F.lit(False))
    model = F.struct(*[F.lit(float(m["h"][c])).alias(c) for c in KINDS[kind]])
    return m, df.withColumn("h", model).withColumn("inlier", residual(kind) <= threshold).drop("h")


