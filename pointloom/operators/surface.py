"""Hulls, meshes and surfaces."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.neighbors import knn, radius_neighbors


def monotone_chain(p: np.ndarray) -> np.ndarray:
    """The convex hull of 2D points, counter-clockwise, without collinear points;
    empty if there is none."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return np.zeros((0, 2))

    def half(points):
        out: list = []
        for q in points:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    hull = np.array(half(p.tolist()) + half(p[::-1].tolist()))
    return hull if len(hull) >= 3 else np.zeros((0, 2))


def polygon_area(p: np.ndarray) -> float:
    x, y = p[:, 0], p[:, 1]
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2 if len(p) else 0.0


def convex_hull_2d(df: DataFrame) -> DataFrame:
    """``(i, x, y, area)`` of the hull in XY; no rows for fewer than three points or
    a line. Hulls of partitions first: only their corners meet in one task."""

    def part(batches):
        held = np.zeros((0, 2))
        for b in batches:
            allp = np.concatenate([held, b[["x", "y"]].dropna().to_numpy(float)])
            hull = monotone_chain(allp)
            held = hull if len(hull) else np.unique(allp, axis=0)
            if not len(hull) and len(held) > 2:  # collinear: the ends are enough
                held = held[[0, -1]]
        yield pd.DataFrame(held, columns=["x", "y"])

    def whole(p: pd.DataFrame) -> pd.DataFrame:
        h = monotone_chain(p[["x", "y"]].to_numpy(float))
        return pd.DataFrame({"i": np.arange(len(h), dtype=np.int32), "x": h[:, 0], "y": h[:, 1], "area": polygon_area(h)})

    corners = df.select("x", "y").mapInPandas(part, "x double, y double")
    return corners.groupBy(F.lit(0).alias("all")).applyInPandas(whole, "i int, x double, y double, area double")


def plane_hull(df: DataFrame, plane: tuple) -> DataFrame:
    """``(i, x, y, z)``: the hull of the cloud's projections onto a plane (a, b, c, d), in space."""
    n = np.asarray(plane[:3], float)
    size = np.linalg.norm(n)
    n, d = n / size, float(plane[3]) / size
    u = np.cross(n, [1.0, 0, 0] if abs(n[0]) < 0.9 else [0, 1.0, 0])
    u /= np.linalg.norm(u)
    v = np.cross(n, u)
    dot = lambda w: sum((F.col(a) * float(k) for a, k in zip("xyz", w, strict=True)), F.lit(0.0))
    flat = convex_hull_2d(df.select(dot(u).alias("x"), dot(v).alias("y")))
    return flat.select("i", *[(F.col("x") * float(u[k]) + F.col("y") * float(v[k]) - d * float(n[k])).alias(a) for k, a in enumerate("xyz")])


def hull_fan(hull: DataFrame) -> DataFrame:
    """Faces ``(a, b, c)`` that fill a hull (i, ...) from its first corner."""
    last = hull.agg(F.max("i").alias("last"))
    inner = hull.crossJoin(F.broadcast(last)).where("i >= 1 AND i < last")  # one row
    return inner.select(F.lit(0).alias("a"), F.col("i").alias("b"), (F.col("i") + 1).alias("c"))


def _cross(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def segments_cross(a, b, c, d) -> bool:
    """Whether open segments meet; a shared end doesn't count."""
    if any(tuple(x) == tuple(y) for x in (a, b) for y in (c, d)):
        return False
    p, q, r, s = _cross(a, b, c), _cross(a, b, d), _cross(c, d, a), _cross(c, d, b)
    return (p > 0) != (q > 0) and (r > 0) != (s > 0)


def point_in_polygon(p, poly: np.ndarray) -> bool:
    """The edge counts as inside."""
    inside = False
    for a, b in zip(poly, np.roll(poly, -1, axis=0), strict=True):
        if abs(_cross(a, b, p)) < 1e-12 and min(a[0], b[0]) - 1e-12 <= p[0] <= max(a[0], b[0]) + 1e-12 and min(a[1], b[1]) - 1e-12 <= p[1] <= max(a[1], b[1]) + 1e-12:
            return True
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            inside = not inside
    return inside


def concave_outline(p: np.ndarray, k: int = 3, max_k: int = 0) -> np.ndarray:
    """A walk along the outside over k nearest points, turning as far right as it
    can; k grows until the outline holds every point."""
    p = np.unique(p, axis=0)
    if len(p) < 3 or not len(monotone_chain(p)):
        return np.zeros((0, 2))
    if len(p) == 3:
        return monotone_chain(p)
    for kk in range(max(3, k), (max_k or len(p) - 1) + 1):
        out = _walk(p, min(kk, len(p) - 1))
        if out is not None and all(point_in_polygon(q, out) for q in p):
            return out
    return monotone_chain(p)


def _walk(p: np.ndarray, k: int) -> np.ndarray | None:
    first = int(np.lexsort((p[:, 0], p[:, 1]))[0])
    free = np.ones(len(p), bool)
    free[first] = False
    path, at, back = [first], first, math.pi
    while True:
        if len(path) == 4:
            free[first] = True
        open_ = np.flatnonzero(free)
        if not len(open_):
            return None
        d = ((p[open_] - p[at]) ** 2).sum(1)
        near = open_[np.argsort(d, kind="stable")[:k]]
        turn = (np.arctan2(p[near, 1] - p[at, 1], p[near, 0] - p[at, 0]) - back) % (2 * math.pi)
        turn[turn < 1e-12] = 2 * math.pi
        for j in near[np.argsort(turn, kind="stable")]:
            edges = list(zip(path[:-1], path[1:], strict=True))
            if not any(segments_cross(p[at], p[j], p[a], p[b]) for a, b in edges[1 if j == first else 0 : -1]):
                break
        else:
            return None
        if j == first:
            return p[path]
        path.append(int(j))
        free[j] = False
        back = math.atan2(p[at, 1] - p[j, 1], p[at, 0] - p[j, 0])
        at = int(j)


def concave_hull_2d(df: DataFrame, k: int = 3, max_k: int = 0) -> DataFrame:
    """The walk depends on what it has passed, so it runs in one task, over the
    distinct XY positions."""

    def whole(p: pd.DataFrame) -> pd.DataFrame:
        h = concave_outline(p[["x", "y"]].to_numpy(float), k, max_k)
        return pd.DataFrame({"i": np.arange(len(h), dtype=np.int32), "x": h[:, 0], "y": h[:, 1], "area": polygon_area(h)})

    return df.select("x", "y").dropDuplicates().groupBy(F.lit(0).alias("all")).applyInPandas(whole, "i int, x double, y double, area double")


def greedy_mesh(df: DataFrame) -> DataFrame:
    """``(a, b, c)``: triangles of each point with consecutive neighbours around it,
    each set of three ids once. The radius is twice the mean distance to the nearest point."""
    mean = knn(df, 1).agg(F.avg("dist").alias("m")).first()["m"]
    if mean is None:
        return df.select(F.col("id").alias("a"), F.col("id").alias("b"), F.col("id").alias("c")).limit(0)
    radius = max(2 * mean, mean + 1e-6, 1e-4)
    near = radius_neighbors(df, radius).where("dist > 1e-12")
    # a plane at each point: from its nearest neighbour and the next one that isn't in line with it
    w = Window.partitionBy("id").orderBy("dist", "nid")
    ranked = near.withColumn("k", F.row_number().over(w))
    one = ranked.where("k = 1").select("id", *[(F.col(f"d{a}") / F.col("dist")).alias(f"u{a}") for a in "xyz"])
    j = ranked.join(one, "id")
    u, d = [F.col(f"u{a}") for a in "xyz"], [F.col(f"d{a}") for a in "xyz"]
    c = [u[1] * d[2] - u[2] * d[1], u[2] * d[0] - u[0] * d[2], u[0] * d[1] - u[1] * d[0]]
    size = F.sqrt(c[0] * c[0] + c[1] * c[1] + c[2] * c[2])
    n = j.where(size / F.col("dist") > 1e-6).groupBy("id").agg(F.min_by(F.struct(*[(x / size).alias(a) for x, a in zip(c, "xyz", strict=True)]), "k").alias("n"))
    j = j.join(n, "id")
    m = [F.col(f"n.{a}") for a in "xyz"]
    v = [m[1] * u[2] - m[2] * u[1], m[2] * u[0] - m[0] * u[2], m[0] * u[1] - m[1] * u[0]]
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    ring = j.select("id", "nid", "dx", "dy", "dz", F.atan2(dot(d, v), dot(d, u)).alias("t"))
    order = Window.partitionBy("id").orderBy("t", "nid")
    here = F.struct("nid", "dx", "dy", "dz")
    ends = Window.partitionBy("id").orderBy("t", "nid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ring = ring.withColumn("next", F.coalesce(F.lead(here).over(order), F.first(here).over(ends))).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("id")))
    e = [F.col(f"next.d{a}") for a in "xyz"]
    x = [d[1] * e[2] - d[2] * e[1], d[2] * e[0] - d[0] * e[2], d[0] * e[1] - d[1] * e[0]]
    tri = ring.where((F.col("m") >= 2) & (dot(x, x) > 1e-16) & (F.col("nid") != F.col("next.nid")))
    s = F.sort_array(F.array("id", "nid", "next.nid"))
    return tri.select(s[0].alias("a"), s[1].alias("b"), s[2].alias("c")).distinct()


def poisson_surface(df: DataFrame, resolution: int = 32, spacing: float = 1.5, iso: float = 0.0, iterations: int = 200, omega: float = 1.8, padding: float = 2.5) -> DataFrame:
    """``(t, k, x, y, z)``: triangles of the zero set of a function whose gradient
    follows the normals. Spreading normals to the grid is a join-free aggregate; the
    relaxation works on the dense grid, whose size is ``resolution`` cubed whatever
    the cloud's, in one task."""
    b = df.agg(*[F.min(a).alias(f"lo{a}") for a in "xyz"], *[F.max(a).alias(f"hi{a}") for a in "xyz"]).first()
    if b["lox"] is None:
        return df.select(F.lit(0).alias("t"), F.lit(0).alias("k"), "x", "y", "z").limit(0)
    lo, hi = np.array([b[f"lo{a}"] for a in "xyz"]), np.array([b[f"hi{a}"] for a in "xyz"])
    side = float(max((hi - lo).max(), 1e-9))
    h = side / max(1, resolution - 1 - 2 * math.ceil(padding))
    origin = (lo + hi) / 2 - h * (resolution - 1) / 2
    reach = math.ceil(spacing * 2)
    g = df.select("nx", "ny", "nz", *[((F.col(a) - float(o)) / h).alias(f"g{a}") for a, o in zip("xyz", origin, strict=True)])
    for a in "xyz":
        at = F.round(F.col(f"g{a}")).cast("int")
        g = g.withColumn(f"i{a}", F.explode(F.sequence(at - reach, at + reach)))
    d2 = sum(((F.col(f"i{a}") - F.col(f"g{a}")) * (F.col(f"i{a}") - F.col(f"g{a}")) for a in "xyz"), F.lit(0.0))
    w = F.exp(-d2 / (2 * spacing * spacing))
    inside = " AND ".join(f"i{a} >= 0 AND i{a} < {resolution}" for a in "xyz")
    field = g.where(inside).groupBy("ix", "iy", "iz").agg(F.sum(w).alias("w"), *[F.sum(w * F.col(f"n{a}")).alias(f"v{a}") for a in "xyz"])

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        n = resolution
        v = np.zeros((3, n, n, n))
        at = (p["ix"].to_numpy(), p["iy"].to_numpy(), p["iz"].to_numpy())
        for i, a in enumerate("xyz"):
            v[i][at] = p[f"v{a}"]
        weight = np.zeros((n, n, n))
        weight[at] = p["w"]
        div = sum(np.gradient(v[i], axis=i) for i in range(3))
        f = np.zeros((n, n, n))
        color = np.indices((n, n, n)).sum(0) % 2
        for _ in range(iterations):
            for c in (0, 1):
                e = np.pad(f, 1, mode="edge")
                near = e[2:, 1:-1, 1:-1] + e[:-2, 1:-1, 1:-1] + e[1:-1, 2:, 1:-1] + e[1:-1, :-2, 1:-1] + e[1:-1, 1:-1, 2:] + e[1:-1, 1:-1, :-2]
                f = np.where(color == c, f + omega * ((near - div) / 6 - f), f)
        f -= (f * weight).sum() / max(weight.sum(), 1e-300)
        tri = tetrahedra(f - iso)
        pts = tri.reshape(-1, 3) * h + origin
        m = len(pts) // 3
        return pd.DataFrame({"t": np.repeat(np.arange(m), 3), "k": np.tile(np.arange(3), m), "x": pts[:, 0], "y": pts[:, 1], "z": pts[:, 2]})

    return field.groupBy(F.lit(0).alias("all")).applyInPandas(solve, "t int, k int, x double, y double, z double")


def tetrahedra(f: np.ndarray) -> np.ndarray:
    """Triangles ``(m, 3, 3)`` of the zero set over the grid, six tetrahedra a cube
    around its diagonal."""
    corner = np.array([[i >> 2 & 1, i >> 1 & 1, i & 1] for i in range(8)])
    tets = [(0, a, a | b, 7) for a, b in ((4, 2), (4, 1), (2, 4), (2, 1), (1, 4), (1, 2))]
    n = np.array(f.shape) - 1
    base = np.stack(np.meshgrid(*[np.arange(k) for k in n], indexing="ij"), -1).reshape(-1, 3)
    out = []
    for t in tets:
        pos = base[:, None, :] + corner[list(t)][None]
        val = f[tuple(np.moveaxis(pos, -1, 0))]
        inside = val < 0
        for mask in range(1, 15):
            rows = np.flatnonzero((inside * [1, 2, 4, 8]).sum(1) == mask)
            if not len(rows):
                continue
            a = [k for k in range(4) if mask >> k & 1]
            b = [k for k in range(4) if not mask >> k & 1]
            cut = lambda i, j, r=rows, p=pos, v=val: p[r, i] + (p[r, j] - p[r, i]) * (v[r, i] / (v[r, i] - v[r, j]))[:, None]
            if len(a) == 2:
                q = [cut(a[0], b[0]), cut(a[0], b[1]), cut(a[1], b[1]), cut(a[1], b[0])]
                out += [np.stack([q[0], q[1], q[2]], 1), np.stack([q[0], q[2], q[3]], 1)]
            else:
                one, rest = (a[0], b) if len(a) == 1 else (b[0], a)
                out.append(np.stack([cut(one, r) for r in rest], 1))
    return np.concatenate(out) if out else np.zeros((0, 3, 3))
