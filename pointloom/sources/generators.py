"""Test clouds from row numbers and keyed random numbers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import normal, uniform
from ..plans.neighbors import AXES


def _made(spark: SparkSession, n: int, f, columns: str = "x double, y double, z double") -> DataFrame:
    def run(batches):
        for b in batches:
            i = b["id"].to_numpy(np.uint64)
            yield pd.DataFrame({"id": b["id"], **f(i)})

    return spark.range(n).mapInPandas(run, f"id bigint, {columns}")


def _noisy(p: np.ndarray, i: np.ndarray, noise: float, seed: int) -> dict[str, np.ndarray]:
    if noise:
        p = p + noise * np.stack([normal(seed + 101 + k, i) for k in range(3)], -1)
    return {a: p[:, k] for k, a in enumerate(AXES)}


def sphere(spark, center=(0, 0, 0), radius=1.0, n=1000, noise=0.0, seed=42) -> DataFrame:
    def f(i):
        z, t = 2 * uniform(seed, i) - 1, 2 * math.pi * uniform(seed + 1, i)
        s = np.sqrt(1 - z * z)
        return _noisy(np.asarray(center) + radius * np.stack([s * np.cos(t), s * np.sin(t), z], -1), i, noise, seed)

    return _made(spark, n, f)


def cylinder(spark, center=(0, 0, 0), radius=1.0, height=2.0, n=1000, noise=0.0, seed=42, axis="z") -> DataFrame:
    def f(i):
        t, h = 2 * math.pi * uniform(seed, i), height * (uniform(seed + 1, i) - 0.5)
        p = np.stack([radius * np.cos(t), radius * np.sin(t), h], -1)
        order = {"x": [2, 0, 1], "y": [0, 2, 1], "z": [0, 1, 2]}[axis]
        return _noisy(np.asarray(center) + p[:, order], i, noise, seed)

    return _made(spark, n, f)


def cone(spark, apex=(0, 0, 0), radius=1.0, height=2.0, n=1000, noise=0.0, seed=42) -> DataFrame:
    """Opening towards +y, uniform over the surface."""

    def f(i):
        s, t = np.sqrt(uniform(seed, i)), 2 * math.pi * uniform(seed + 1, i)
        return _noisy(np.asarray(apex) + np.stack([radius * s * np.cos(t), height * s, radius * s * np.sin(t)], -1), i, noise, seed)

    return _made(spark, n, f)


def rectangle(spark, center=(0, 0, 0), width=1.0, depth=1.0, n=1000, noise=0.0, seed=42) -> DataFrame:
    """In XZ."""

    def f(i):
        p = np.stack([width * (uniform(seed, i) - 0.5), np.zeros(len(i)), depth * (uniform(seed + 1, i) - 0.5)], -1)
        return _noisy(np.asarray(center) + p, i, noise, seed)

    return _made(spark, n, f)


def grid_rectangle(spark, width: float, depth: float, u: int, v: int) -> DataFrame:
    """u x v points in XZ; both must be 2 or more."""
    if u < 2 or v < 2:
        raise ValueError("a grid needs two points an axis")
    i = F.col("id")
    return spark.range(u * v).select("id", ((i % u) / (u - 1) * width - width / 2).alias("x"), F.lit(0.0).alias("y"), (F.floor(i / u) / (v - 1) * depth - depth / 2).alias("z"))


def ground_scene(spark, n=2000, size=20.0, seed=42) -> DataFrame:
    """Four fifths ground near z = 0, one fifth points above it."""

    def f(i):
        high = i >= np.uint64(int(0.8 * n))
        x, y = (size * (uniform(seed + k, i) - 0.5) for k in (0, 1))
        z = np.where(high, 2 + 3 * uniform(seed + 2, i), 0.05 * normal(seed + 3, i))
        return {"x": x, "y": y, "z": z}

    return _made(spark, n, f)


def torus(spark, major=1.0, minor=0.3, n=1000, noise=0.0, seed=42) -> DataFrame:
    def f(i):
        a, b = 2 * math.pi * uniform(seed, i), 2 * math.pi * uniform(seed + 1, i)
        r = major + minor * np.cos(b)
        return _noisy(np.stack([r * np.cos(a), r * np.sin(a), minor * np.sin(b)], -1), i, noise, seed)

    return _made(spark, n, f)


def organic(spark, n=35_000, octaves=3, seed=11) -> DataFrame:
    """A sphere with waves of ``octaves`` frequencies."""

    def f(i):
        z, t = 2 * uniform(seed, i) - 1, 2 * math.pi * uniform(seed + 1, i)
        s = np.sqrt(1 - z * z)
        d = np.stack([s * np.cos(t), s * np.sin(t), z], -1)
        r = 1 + sum(0.25 / 2**k * np.sin(2**k * 3 * d[:, k % 3] + seed + k) for k in range(octaves))
        return {a: (d * r[:, None])[:, j] for j, a in enumerate(AXES)}

    return _made(spark, n, f)


def _as_splats(p: DataFrame, color: list, size, opacity: float = 2.0) -> DataFrame:
    """Points with normals and linear colours as round splats of a size."""
    dc = [(c - 0.5) / 0.28209479177387814 for c in color]
    log = F.log(size) if not isinstance(size, float) else F.lit(math.log(size))
    return p.select("id", *AXES, *[F.col(f"n{a}") for a in AXES], F.array(*dc).alias("f_dc"), F.lit(opacity).alias("opacity"),
                    F.array(log, log, log).alias("scale"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("rot"),
                    F.lit(0).alias("sh_degree"), F.array().cast("array<double>").alias("sh_rest"))


def _outward(p: DataFrame) -> DataFrame:
    n = F.sqrt(sum((F.col(a) * F.col(a) for a in AXES), F.lit(0.0)))
    return p.select("*", *[F.when(n > 0, F.col(a) / n).otherwise(0.0).alias(f"n{a}") for a in AXES])


def splat_sphere(spark, n=2000, radius=1.0, size=0.05, seed=42) -> DataFrame:
    p = _outward(sphere(spark, radius=radius, n=n, seed=seed))
    return _as_splats(p, [(F.col(f"n{a}") + 1) / 2 for a in AXES], size)


def splat_shell(spark, n=15_000, inner=0.8, outer=1.2, size=0.03, seed=42) -> DataFrame:
    """Between two spheres, uniform in volume."""

    def f(i):
        z, t = 2 * uniform(seed, i) - 1, 2 * math.pi * uniform(seed + 1, i)
        s, r = np.sqrt(1 - z * z), np.cbrt(inner**3 + (outer**3 - inner**3) * uniform(seed + 2, i))
        return {"x": r * s * np.cos(t), "y": r * s * np.sin(t), "z": r * z}

    return _as_splats(_outward(_made(spark, n, f)), [(F.col(f"n{a}") + 1) / 2 for a in AXES], size)


def splat_cube(spark, n=3000, side=2.0, size=0.04, seed=42) -> DataFrame:
    """The faces of a cube, a face after the other; each face its own colour."""

    def f(i):
        face = (i % np.uint64(6)).astype(int)
        u, v = (side * (uniform(seed + k, i) - 0.5) for k in (0, 1))
        w = np.where(face % 2 == 0, side / 2, -side / 2)
        axis = face // 2
        p = np.stack([np.where(axis == 0, w, u), np.where(axis == 1, w, np.where(axis == 0, u, v)), np.where(axis == 2, w, v)], -1)
        d = {a: p[:, k] for k, a in enumerate(AXES)}
        return d | {f"n{a}": np.where(axis == k, np.sign(w), 0.0) for k, a in enumerate(AXES)}

    p = _made(spark, n, f, ", ".join([*(f"{a} double" for a in AXES), *(f"n{a} double" for a in AXES)]))
    return _as_splats(p, [(F.col(f"n{a}") + 1) / 2 for a in AXES], size)


def splat_galaxy(spark, n=3000, arms=3, turns=1.5, radius=2.0, size=0.03, seed=42) -> DataFrame:
    """Spiral arms that thin out, warm inside and blue outside."""

    def f(i):
        r = radius * np.sqrt(uniform(seed, i))
        a = 2 * math.pi * ((i % np.uint64(arms)) / arms + turns * r / radius) + 0.3 * normal(seed + 1, i) * (1 - r / radius)
        return {"x": r * np.cos(a), "y": 0.1 * normal(seed + 2, i) * np.exp(-r), "z": r * np.sin(a)}

    p = _made(spark, n, f).select("*", F.lit(0.0).alias("nx"), F.lit(1.0).alias("ny"), F.lit(0.0).alias("nz"))
    t = F.least(F.lit(1.0), F.sqrt(F.col("x") * F.col("x") + F.col("z") * F.col("z")) / radius)
    return _as_splats(p, [1 - 0.6 * t, 0.8 - 0.3 * t, 0.5 + 0.5 * t], size)


def splat_torus(spark, n=3000, major=1.0, minor=0.35, size=0.04, seed=42) -> DataFrame:
    p = torus(spark, major, minor, n, seed=seed)
    ring = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    out = [F.col("x") * (1 - major / ring) / minor, F.col("y") * (1 - major / ring) / minor, F.col("z") / minor]
    return _as_splats(p.select("*", *[c.alias(f"n{a}") for c, a in zip(out, AXES, strict=True)]), [(F.col(f"n{a}") + 1) / 2 for a in AXES], size)


def splat_stress(spark, counts=(3, 24, 60, 40, 120), seed=42) -> DataFrame:
    """Groups that are hard to draw, of ``counts``: three large and near, thin needles, a
    stack along the view, tiny ones, and a wide faint cloud. A column ``part`` names the group."""
    parts, start = [], 0
    for k, (n, size, opacity, spread) in enumerate(zip(counts, (0.8, 0.15, 0.1, 0.004, 0.3), (3.0, 2.0, 0.0, 2.0, -3.0), (0.5, 1.0, 0.0, 1.0, 3.0), strict=True)):
        p = sphere(spark, n=n, seed=seed + 10 * k)
        moved = p.select((F.col("id") + start).alias("id"), *[(F.col(a) * spread + (F.col("id") * 0.05 if k == 2 and a == "z" else 0.0)).alias(a) for a in AXES])
        s = _as_splats(_outward(moved), [F.lit(0.2 + 0.2 * k), F.lit(0.5), F.lit(0.9 - 0.2 * k)], float(size), opacity)
        if k == 1:
            s = s.withColumn("scale", F.array(F.lit(math.log(size)), F.lit(math.log(size / 50)), F.lit(math.log(size / 50))))
        parts.append(s.withColumn("part", F.lit(k)))
        start += n
    out = parts[0]
    for s in parts[1:]:
        out = out.unionByName(s)
    return out


def points_from_vertices(df: DataFrame, color=(0.6, 0.8, 1.0), radius: float = 0.01) -> DataFrame:
    return df.select("id", *AXES, *[F.lit(float(v)).alias(c) for c, v in zip("rgb", color, strict=True)], F.lit(radius).alias("radius"))


def surface_samples(triangles: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """``count`` points over triangles (id, ax..cz), by area. Sample k uses outputs 3k,
    3k + 1, 3k + 2 of one stream, so samples are independent of partitions; its
    triangle is found among the running sums of areas."""
    t = triangles.orderBy("id").toPandas()  # the mesh, not the samples
    v = {c: t[[f"{c}{a}" for a in AXES]].to_numpy(float) for c in "abc"}
    area = 0.5 * np.linalg.norm(np.cross(v["b"] - v["a"], v["c"] - v["a"]), axis=1)
    total = np.cumsum(area)

    def f(i):
        u = [uniform(seed, i * np.uint64(3) + np.uint64(k)) for k in range(3)]
        at = np.minimum(np.searchsorted(total, u[0] * total[-1], side="right"), len(total) - 1)
        r = np.sqrt(u[1])[:, None]
        w = u[2][:, None]
        p = (1 - r) * v["a"][at] + r * (1 - w) * v["b"][at] + r * w * v["c"][at]
        return {a: p[:, j] for j, a in enumerate(AXES)}

    return _made(triangles.sparkSession, count, f)
