"""Normals, curvature, descriptors, boundaries and smoothing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.linalg import covariance, eigen3, moments, smallest_eigenvalue
from ..plans.neighbors import knn, radius_neighbors


def _near(df: DataFrame, radius: float | None, k: int | None, carry: tuple[str, ...] = ()) -> DataFrame:
    if (radius is None) == (k is None):
        raise ValueError("give a radius or k")
    return radius_neighbors(df, radius, carry=carry) if k is None else knn(df, k, carry=carry)


def normals(df: DataFrame, radius: float | None = None, k: int | None = None) -> DataFrame:
    """``(id, nx, ny, nz)``: the direction of least variance of the neighbours with
    the point itself; a zero vector with fewer than two neighbours."""
    m = _near(df, radius, k).groupBy("id").agg(*moments()).where("n >= 2")
    c = covariance(F.col("n") + 1, F.col("n"))  # the point adds a zero offset
    e = m.select("id", eigen3(*c.values()).alias("e"))
    return df.select("id").join(e, "id", "left").select("id", *[F.coalesce(f"e.a{a}", F.lit(0.0)).alias(f"n{a}") for a in "xyz"])


def orient_normals(df: DataFrame, viewpoint) -> DataFrame:
    """Normals turned towards the viewpoint."""
    dot = sum(((F.lit(float(v)) - F.col(a)) * F.col(f"n{a}") for a, v in zip("xyz", viewpoint, strict=True)), F.lit(0.0))
    return df.withColumns({f"n{a}": F.when(dot < 0, -F.col(f"n{a}")).otherwise(F.col(f"n{a}")) for a in "xyz"})


def curvature(df: DataFrame, radius: float | None = None, k: int | None = None) -> DataFrame:
    """``(id, curvature)``: least eigenvalue by the trace of the neighbours'
    covariance, without the point; 0 with fewer than three. Closed form, no UDF."""
    m = _near(df, radius, k).groupBy("id").agg(*moments()).where("n >= 3")
    c = covariance(F.col("n"), F.col("n"))
    trace = c["xx"] + c["yy"] + c["zz"]
    v = F.when(trace > 1e-18, F.greatest(F.lit(0.0), smallest_eigenvalue(c)) / trace).otherwise(0.0)
    return df.select("id").join(m.select("id", v.alias("curvature")), "id", "left").select("id", F.coalesce("curvature", F.lit(0.0)).alias("curvature"))


def _frame(e: str) -> dict[str, list[Column]]:
    """Tangent axes u, v and normal n from eigen3's struct (c, b, a)."""
    return {n: [F.col(f"{e}.{v}{a}") for a in "xyz"] for n, v in (("u", "c"), ("v", "b"), ("n", "a"))}


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def principal_curvatures(df: DataFrame, radius: float | None = None, k: int | None = None) -> DataFrame:
    """``(id, k1, k2, d1x.., d2x..)`` with k1 >= k2 from the quadric a u^2 + b u v +
    c v^2 + d u + e v fitted to the neighbours in their own frame; zeros with
    fewer than six."""
    near = _near(df, radius, k)
    m = near.groupBy("id").agg(*moments()).where("n >= 6")
    c = covariance(F.col("n"), F.col("n"))
    frame = m.select("id", eigen3(*c.values()).alias("e"))
    off = [F.col("dx"), F.col("dy"), F.col("dz")]
    f = _frame("e")
    local = near.join(frame, "id").select("id", "e", *[_dot(off, f[n]).alias(n) for n in "uvn"])
    basis = [F.col("u") * F.col("u"), F.col("u") * F.col("v"), F.col("v") * F.col("v"), F.col("u"), F.col("v")]
    sums = [F.sum(basis[i] * basis[j]).alias(f"m{i}{j}") for i in range(5) for j in range(i, 5)]
    right = [F.sum(b * F.col("n")).alias(f"r{i}") for i, b in enumerate(basis)]
    q = local.groupBy("id").agg(F.first("e").alias("e"), *sums, *right)

    @F.pandas_udf("struct<k1: double, k2: double, p: double, q: double>")
    def solve(d: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((len(d), 5, 5))
        for i in range(5):
            for j in range(i, 5):
                a[:, i, j] = a[:, j, i] = d[f"m{i}{j}"]
        b = d[[f"r{i}" for i in range(5)]].to_numpy()
        x = np.einsum("nij,nj->ni", np.linalg.pinv(a, rcond=1e-12, hermitian=True), b)
        h = np.stack([np.stack([2 * x[:, 0], x[:, 1]], -1), np.stack([x[:, 1], 2 * x[:, 2]], -1)], -2)
        w, v = np.linalg.eigh(h)
        return pd.DataFrame({"k1": w[:, 1], "k2": w[:, 0], "p": v[:, 0, 1], "q": v[:, 1, 1]})

    packed = F.struct(*[f"m{i}{j}" for i in range(5) for j in range(i, 5)], *[f"r{i}" for i in range(5)])
    s = q.select("id", "e", solve(packed).alias("s"))
    p, r = F.col("s.p"), F.col("s.q")
    d1 = [(p * u + r * v).alias(f"d1{a}") for u, v, a in zip(f["u"], f["v"], "xyz", strict=True)]
    d2 = [(p * v - r * u).alias(f"d2{a}") for u, v, a in zip(f["u"], f["v"], "xyz", strict=True)]
    out = s.select("id", "s.k1", "s.k2", *d1, *d2)
    return df.select("id").join(out, "id", "left").na.fill(0.0)


def principal_summary(p: DataFrame) -> DataFrame:
    return p.agg(F.avg("k1").alias("mean_k1"), F.avg("k2").alias("mean_k2"), F.max(F.greatest(F.abs("k1"), F.abs("k2"))).alias("max_abs"))


def pair_features(n1: list[Column], n2: list[Column], d: list[Column], dist: Column) -> tuple[Column, Column, Column]:
    """alpha, phi, theta of a pair in the frame of the first normal: u = n1, v = u x
    d / |u x d|, w = u x v."""
    e = [x / dist for x in d]
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    c = cross(n1, e)
    length = F.sqrt(_dot(c, c))
    v = [F.when(length > 1e-12, x / length).otherwise(0.0) for x in c]
    w = cross(n1, v)
    return _dot(v, n2), _dot(n1, e), F.atan2(_dot(w, n2), _dot(n1, n2))


BINS = 11


def fpfh(df: DataFrame, k: int) -> DataFrame:
    """``(id, histogram)``, 33 values: each point's three histograms of pair
    features over its k nearest, each summing to 1, plus the mean of the
    neighbours' own histograms weighted by 1 / distance. theta is binned over
    [-pi/2, pi/2]; beyond, it falls in the end bins."""
    near = knn(df, k, carry=("nx", "ny", "nz")).where("dist > 0")
    own = df.select("id", *[F.col(f"n{a}").alias(f"m{a}") for a in "xyz"])
    j = near.join(own, "id")
    f = pair_features([F.col(f"m{a}") for a in "xyz"], [F.col(f"n_n{a}") for a in "xyz"], [F.col(f"d{a}") for a in "xyz"], F.col("dist"))
    lo, hi = (-1.0, -1.0, -math.pi / 2), (1.0, 1.0, math.pi / 2)
    bins = [F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((x - a) / (b - a) * BINS).cast("int"))) + BINS * i for i, (x, a, b) in enumerate(zip(f, lo, hi, strict=True))]
    counts = [F.count_if(F.array_contains(F.col("b"), F.lit(i))).alias(f"c{i}") for i in range(3 * BINS)]
    spfh = j.select("id", F.array(*bins).alias("b")).groupBy("id").agg(F.count(F.lit(1)).alias("n"), *counts)
    spfh = spfh.select("id", *[(F.col(f"c{i}") / F.col("n")).alias(f"h{i}") for i in range(3 * BINS)])
    other = spfh.select(F.col("id").alias("nid"), *[F.col(f"h{i}").alias(f"o{i}") for i in range(3 * BINS)])
    mixed = near.select("id", "nid", "dist").join(other, "nid").groupBy("id").agg(
        *[(F.sum(F.col(f"o{i}") / F.col("dist")) / k).alias(f"w{i}") for i in range(3 * BINS)])
    both = spfh.join(mixed, "id", "left")
    total = [F.col(f"h{i}") + F.coalesce(f"w{i}", F.lit(0.0)) for i in range(3 * BINS)]
    out = both.select("id", F.array(*total).alias("histogram"))
    zero = F.array(*[F.lit(0.0)] * (3 * BINS))
    return df.select("id").join(out, "id", "left").select("id", F.coalesce("histogram", zero).alias("histogram"))


def fpfh_distance(h: DataFrame) -> DataFrame:
    """Each point's distance to the mean histogram."""
    mean = h.agg(F.array(*[F.avg(F.col("histogram")[i]) for i in range(3 * BINS)]).alias("mean"))
    d = F.zip_with("histogram", "mean", lambda a, b: (a - b) * (a - b))
    return h.crossJoin(F.broadcast(mean)).select("id", F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x)).alias("distance"))  # one row


MAX_GAP = 2.67035


def boundary(df: DataFrame, radius: float | None = None, k: int | None = None, max_gap: float = MAX_GAP) -> DataFrame:
    """``(id, boundary)``: whether the widest gap between the neighbours' directions
    in the tangent plane, around the circle, exceeds ``max_gap``; false with fewer than three directions."""
    near = _near(df, radius, k).join(df.select("id", "nx", "ny", "nz"), "id")
    n = [F.col(f"n{a}") for a in "xyz"]
    # u = helper x n, helper = x axis unless n leans on it
    lean = F.abs(n[0]) > 0.9
    u = [F.when(lean, n[2]).otherwise(0.0), F.when(lean, 0.0).otherwise(-n[2]), F.when(lean, -n[0]).otherwise(n[1])]
    size = F.sqrt(_dot(u, u))
    u = [x / size for x in u]
    v = [n[1] * u[2] - n[2] * u[1], n[2] * u[0] - n[0] * u[2], n[0] * u[1] - n[1] * u[0]]
    d = [F.col(f"d{a}") for a in "xyz"]
    flat = near.withColumn("p", _dot(d, u)).withColumn("q", _dot(d, v)).where("p * p + q * q > 1e-24")
    a = flat.select("id", F.atan2("q", "p").alias("a"))
    gap = F.col("a") - F.lag("a").over(Window.partitionBy("id").orderBy("a"))
    g = a.withColumn("gap", gap).groupBy("id").agg(F.count(F.lit(1)).alias("m"), F.max("gap").alias("gap"), (2 * math.pi - (F.max("a") - F.min("a"))).alias("wrap"))
    out = g.select("id", ((F.col("m") >= 3) & (F.greatest("gap", "wrap") > max_gap)).alias("boundary"))
    return df.select("id").join(out, "id", "left").select("id", F.coalesce("boundary", F.lit(False)).alias("boundary"))


def _mls_fit(df: DataFrame, radius: float | None, k: int | None) -> DataFrame:
    """For each point with a fit: mean offset, frame e, and the coefficients of
    1, u, v, u^2, u v, v^2 (the last three 0 with fewer than six)."""
    near = _near(df, radius, k)
    here = df.select("id", F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dz"), F.lit(0.0).alias("dist"))
    near = near.select("id", "dx", "dy", "dz", "dist").unionByName(here)
    if radius is not None:
        near = near.withColumn("sigma", F.lit(radius / 2))
    else:
        near = near.join(near.groupBy("id").agg((F.max("dist") / 2).alias("sigma")), "id")
    u2 = F.col("dist") / F.col("sigma")
    near = near.where("sigma > 0").withColumn("w", F.exp(-u2 * u2 / 2))
    w = F.col("w")
    m = near.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("sw"), *[F.sum(w * F.col(f"d{a}")).alias(f"m{a}") for a in "xyz"]).where("n >= 3")
    m = m.select("id", "n", *[(F.col(f"m{a}") / F.col("sw")).alias(f"o{a}") for a in "xyz"])
    j = near.join(m, "id").withColumns({f"e{a}": F.col(f"d{a}") - F.col(f"o{a}") for a in "xyz"})
    c = j.groupBy("id").agg(*[F.sum(w * F.col(f"e{p[0]}") * F.col(f"e{p[1]}")).alias(p) for p in ("xx", "xy", "xz", "yy", "yz", "zz")])
    frame = c.select("id", eigen3("xx", "xy", "xz", "yy", "yz", "zz").alias("e"))
    f = _frame("e")
    off = [F.col(f"e{a}") for a in "xyz"]
    local = j.join(frame, "id").select("id", "w", "n", "e", "ox", "oy", "oz", *[_dot(off, f[x]).alias(f"t{x}") for x in "uvn"])
    tu, tv = F.col("tu"), F.col("tv")
    basis = [F.lit(1.0), tu, tv, tu * tu, tu * tv, tv * tv]
    sums = [F.sum(w * basis[i] * basis[j2]).alias(f"a{i}{j2}") for i in range(6) for j2 in range(i, 6)]
    right = [F.sum(w * b * F.col("tn")).alias(f"r{i}") for i, b in enumerate(basis)]
    q = local.groupBy("id").agg(F.first("n").alias("n"), F.first("e").alias("e"), *[F.first(f"o{a}").alias(f"o{a}") for a in "xyz"], *sums, *right)

    @F.pandas_udf("array<double>")
    def solve(d: pd.DataFrame) -> pd.Series:
        a = np.zeros((len(d), 6, 6))
        for i in range(6):
            for j2 in range(i, 6):
                a[:, i, j2] = a[:, j2, i] = d[f"a{i}{j2}"]
        b = d[[f"r{i}" for i in range(6)]].to_numpy().copy()
        few = d["n"].to_numpy() < 6
        a[few, 3:, :] = a[few, :, 3:] = 0
        b[few, 3:] = 0
        x = np.einsum("nij,nj->ni", np.linalg.pinv(a, rcond=1e-12, hermitian=True), b)
        return pd.Series(list(x))

    packed = F.struct("n", *[f"a{i}{j2}" for i in range(6) for j2 in range(i, 6)], *[f"r{i}" for i in range(6)])
    return q.select("id", "e", "ox", "oy", "oz", solve(packed).alias("x"))


def _surface(u: Column, v: Column) -> list[Column]:
    """Offset from the point to the fitted surface over (u, v)."""
    x = F.col("x_")
    h = x[0] + x[1] * u + x[2] * v + x[3] * u * u + x[4] * u * v + x[5] * v * v
    f = _frame("e")
    return [F.col(f"o{a}") + u * f["u"][i] + v * f["v"][i] + h * f["n"][i] for i, a in enumerate("xyz")]


def mls_smooth(df: DataFrame, radius: float | None = None, k: int | None = None) -> DataFrame:
    """Each point moved to the weighted quadric (a plane with fewer than six
    points) fitted around it; points without a fit stay."""
    fit = _mls_fit(df, radius, k).withColumnRenamed("x", "x_")
    f = _frame("e")
    o = [F.col(f"o{a}") for a in "xyz"]
    u, v = -_dot(o, f["u"]), -_dot(o, f["v"])
    moved = fit.select("id", *[c.alias(f"s{a}") for c, a in zip(_surface(u, v), "xyz", strict=True)])
    j = df.join(moved, "id", "left")
    return j.withColumns({a: F.coalesce(F.col(a) + F.col(f"s{a}"), F.col(a)) for a in "xyz"}).drop("sx", "sy", "sz")


def mls_upsample(df: DataFrame, radius: float | None = None, k: int | None = None, up_radius: float = 0.1, step: float = 0.05) -> DataFrame:
    """New points only: on each fitted surface at the grid places of a disc of
    ``up_radius`` around the point, the centre left out. (source_id, x, y, z)"""
    n = int(math.floor(up_radius / step + 1e-9))
    grid = [(i * step, j * step) for i in range(-n, n + 1) for j in range(-n, n + 1) if (i or j) and math.hypot(i, j) * step <= up_radius + 1e-12]
    if not grid:
        return df.select(F.col("id").alias("source_id"), "x", "y", "z").limit(0)
    fit = _mls_fit(df, radius, k).withColumnRenamed("x", "x_")
    f = _frame("e")
    o = [F.col(f"o{a}") for a in "xyz"]
    g = fit.withColumn("g", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in grid])))
    u, v = F.col("g.a") - _dot(o, f["u"]), F.col("g.b") - _dot(o, f["v"])
    new = g.select("id", *[c.alias(f"s{a}") for c, a in zip(_surface(u, v), "xyz", strict=True)])
    return df.select("id", "x", "y", "z").join(new, "id").select(F.col("id").alias("source_id"), *[(F.col(a) + F.col(f"s{a}")).alias(a) for a in "xyz"])
