"""Filters: every operator returns the cloud with a boolean ``inlier``."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.neighbors import knn, radius_neighbors


def pass_through(df: DataFrame, axis: str, low: float, high: float) -> DataFrame:
    """Inlier if low <= coordinate <= high; NaN is an outlier."""
    v = F.col(axis)
    return df.withColumn("inlier", ~F.isnan(v) & v.between(low, high))


def radius_outlier(df: DataFrame, radius: float, min_neighbors: int) -> DataFrame:
    """Inlier with at least ``min_neighbors`` others within the closed radius."""
    n = radius_neighbors(df, radius, closed=True).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return df.join(n, "id", "left").withColumn("inlier", F.coalesce("n", F.lit(0)) >= min_neighbors).drop("n")


def statistical_outlier(df: DataFrame, k: int, multiplier: float) -> DataFrame:
    """Inlier if the mean distance to the k nearest is at most mean + multiplier *
    population standard deviation over the cloud; k <= 0 keeps all."""
    if k <= 0:
        return df.withColumn("inlier", F.lit(True))
    d = knn(df, k).groupBy("id").agg(F.avg("dist").alias("d"))
    s = d.agg((F.avg("d") + multiplier * F.stddev_pop("d")).alias("limit"))
    flagged = d.crossJoin(F.broadcast(s)).select("id", (F.col("d") <= F.col("limit")).alias("inlier"))  # one row
    return df.join(flagged, "id", "left").withColumn("inlier", F.coalesce("inlier", F.lit(True)))


GAUSS = 1 / math.sqrt(2 * math.pi)


def density(df: DataFrame, radius: float) -> DataFrame:
    """``(id, density)``: sum over neighbours of the normal density of dist/radius."""
    w = F.exp(-(F.col("dist") / radius) * (F.col("dist") / radius) / 2) * GAUSS
    d = radius_neighbors(df, radius).groupBy("id").agg(F.sum(w).alias("density"))
    return df.select("id").join(d, "id", "left").select("id", F.coalesce("density", F.lit(0.0)).alias("density"))


def density_knn(df: DataFrame, k: int = 10) -> DataFrame:
    """As ``density``, with the k-th neighbour's distance for the radius; 0 if
    that is 0."""
    n = knn(df, k)
    far = n.groupBy("id").agg(F.max("dist").alias("far"))
    u = F.col("dist") / F.col("far")
    d = n.join(far, "id").where("far > 0").groupBy("id").agg(F.sum(F.exp(-u * u / 2) * GAUSS).alias("density"))
    return df.select("id").join(d, "id", "left").select("id", F.coalesce("density", F.lit(0.0)).alias("density"))


def density_filter(df: DataFrame, radius: float) -> DataFrame:
    """Inlier if the density is within two population standard deviations of the
    cloud's mean, on either side; all are if that deviation is 0."""
    if radius <= 0:
        raise ValueError("radius must be positive")
    d = density(df, radius)
    s = d.agg(F.avg("density").alias("m"), F.stddev_pop("density").alias("sd"))
    ok = (F.col("sd") == 0) | (F.abs(F.col("density") - F.col("m")) <= 2 * F.col("sd"))
    return df.join(d.crossJoin(F.broadcast(s)).select("id", ok.alias("inlier")), "id")  # one row


def curvature_filter(df: DataFrame, radius: float, threshold: float) -> DataFrame:
    """Points with curvature up to the threshold, and gray = curvature / maximum."""
    from .features import curvature

    c = curvature(df, radius)
    top = c.agg(F.max("curvature").alias("top"))
    gray = F.when(F.col("top") > 0, F.col("curvature") / F.col("top")).otherwise(0.0)
    return df.join(c, "id").crossJoin(F.broadcast(top)).where(F.col("curvature") <= threshold).withColumn("gray", gray).drop("top")


def split_scene(df: DataFrame, flag: str = "inlier") -> tuple[DataFrame, DataFrame]:
    """Rows with the flag, and the others."""
    return df.where(F.col(flag)).drop(flag), df.where(~F.col(flag)).drop(flag)


def normal_colors(df: DataFrame) -> DataFrame:
    return df.select("*", *[((F.col(f"n{a}") + 1) / 2).alias(c) for a, c in zip("xyz", "rgb", strict=True)])


def gray_colors(df: DataFrame, value: str) -> DataFrame:
    """r = g = b = value / maximum, 0 where the maximum is not positive."""
    top = df.agg(F.max(value).alias("__top"))
    g = F.when(F.col("__top") > 0, F.col(value) / F.col("__top")).otherwise(0.0)
    return df.crossJoin(F.broadcast(top)).select(*df.columns, *[g.alias(c) for c in "rgb"])


def transform(df: DataFrame, rotation, translation) -> DataFrame:
    """Positions R p + t; other columns stay, normals are dropped."""
    r, t = rotation, translation
    moved = [(F.col("x") * r[i][0] + F.col("y") * r[i][1] + F.col("z") * r[i][2] + t[i]).alias(a) for i, a in enumerate("xyz")]
    rest = [c for c in df.columns if c not in ("x", "y", "z", "nx", "ny", "nz")]
    return df.select(*rest, *moved)


def normal_segments(df: DataFrame, length: float) -> DataFrame:
    """From each point to point + length * normal."""
    return df.select("id", "x", "y", "z", *[(F.col(a) + length * F.col(f"n{a}")).alias(f"{a}2") for a in "xyz"])


def visible_union(scenes: list[tuple[DataFrame, bool]]) -> DataFrame | None:
    """The union of the visible clouds."""
    out = None
    for df, shown in scenes:
        if shown:
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
