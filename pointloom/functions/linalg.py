"""Small dense algebra, vectorised over rows, and a closed form in SQL."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOMENTS = ("xx", "xy", "xz", "yy", "yz", "zz")


def moments(prefix: str = "d") -> list[Column]:
    """Sums of offsets and of their products over a group, and the count."""
    d = {a: F.col(f"{prefix}{a}") for a in "xyz"}
    sums = [F.sum(d[a]).alias(f"s{a}") for a in "xyz"]
    products = [F.sum(d[m[0]] * d[m[1]]).alias(f"s{m}") for m in MOMENTS]
    return [F.count(F.lit(1)).alias("n"), *sums, *products]


def covariance(n: Column, divisor: Column) -> dict[str, Column]:
    """The six entries from the sums of ``moments``; n points in all."""
    return {m: (F.col(f"s{m}") - F.col(f"s{m[0]}") * F.col(f"s{m[1]}") / n) / divisor for m in MOMENTS}


def matrices(cols: Sequence[pd.Series]) -> np.ndarray:
    xx, xy, xz, yy, yz, zz = (c.to_numpy(np.float64) for c in cols)
    return np.stack([np.stack([xx, xy, xz], -1), np.stack([xy, yy, yz], -1), np.stack([xz, yz, zz], -1)], -2)


EIGEN = T.StructType([T.StructField(n, T.DoubleType()) for n in ("l0", "l1", "l2", *(v + a for v in "abc" for a in "xyz"))])


@F.pandas_udf(EIGEN)
def eigen3(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
    """Eigenvalues in rising order and their vectors a, b, c."""
    w, v = np.linalg.eigh(np.nan_to_num(matrices((xx, xy, xz, yy, yz, zz))))
    cols = {f"l{k}": w[:, k] for k in range(3)}
    for k, name in enumerate("abc"):
        cols |= {f"{name}{a}": v[:, i, k] for i, a in enumerate("xyz")}
    return pd.DataFrame(cols)


def smallest_eigenvalue(c: dict[str, Column]) -> Column:
    """Of a symmetric 3 x 3 matrix, by the trigonometric closed form."""
    q = (c["xx"] + c["yy"] + c["zz"]) / 3
    off = c["xy"] * c["xy"] + c["xz"] * c["xz"] + c["yz"] * c["yz"]
    dx, dy, dz = c["xx"] - q, c["yy"] - q, c["zz"] - q
    p = F.sqrt((dx * dx + dy * dy + dz * dz + 2 * off) / 6)
    det = dx * (dy * dz - c["yz"] * c["yz"]) - c["xy"] * (c["xy"] * dz - c["yz"] * c["xz"]) + c["xz"] * (c["xy"] * c["yz"] - dy * c["xz"])
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (2 * p * p * p)))
    return F.when(p > 0, q + 2 * p * F.cos(F.acos(r) / 3 + 2 * math.pi / 3)).otherwise(q)


def kabsch(weight: float, cs: np.ndarray, ct: np.ndarray, h: np.ndarray, source_var: float, scale: bool = False):
    """Rotation, translation and scale from the centroids, the weighted cross
    covariance (source x target) and the source's weighted variance."""
    u, s, vt = np.linalg.svd(h)
    d = np.sign(np.linalg.det(vt.T @ u.T)) or 1.0
    fix = np.array([1.0, 1.0, d])
    r = vt.T @ np.diag(fix) @ u.T
    k = float((s * fix).sum() / source_var) if scale and source_var > 0 else 1.0
    return r, ct - k * r @ cs, k


def rodrigues(w: np.ndarray) -> np.ndarray:
    """The rotation of a vector of axis times angle."""
    a = float(np.linalg.norm(w))
    if a < 1e-12:
        return np.eye(3)
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]]) / a
    return np.eye(3) + math.sin(a) * k + (1 - math.cos(a)) * k @ k
