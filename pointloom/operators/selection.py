"""Selections (one-column tables of ids) and edits of a cloud by them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def normalize_selection(sel: DataFrame, n: int) -> DataFrame:
    return sel.select("id").where((F.col("id") >= 0) & (F.col("id") < n)).distinct()


def combine(a: DataFrame, b: DataFrame, mode: str) -> DataFrame:
    """Replace, add, remove or toggle."""
    a, b = a.select("id"), b.select("id")
    if mode == "replace":
        return b.distinct()
    if mode == "add":
        return a.unionByName(b).distinct()
    if mode == "remove":
        return a.distinct().join(b, "id", "left_anti")
    if mode == "toggle":
        return a.distinct().join(b, "id", "left_anti").unionByName(b.distinct().join(a, "id", "left_anti"))
    raise ValueError(f"unknown mode {mode}")


def all_indices(df: DataFrame) -> DataFrame:
    return df.select("id")


def invert(df: DataFrame, sel: DataFrame) -> DataFrame:
    return df.select("id").join(sel, "id", "left_anti")


def renumber(df: DataFrame) -> DataFrame:
    """Dense ids from 0 in the order of the old ones. Ids are counted by ranges:
    each range's first rank comes from the ranges' sizes, so no task sorts all rows."""
    ranged = df.repartitionByRange("id").withColumn("__p", F.spark_partition_id())
    from ..plans.materialize import cut

    ranged = cut(ranged)
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).orderBy("__p").collect()  # one row a partition
    base, starts = 0, []
    for r in sizes:
        starts.append((r["__p"], base))
        base += r["n"]
    s = df.sparkSession.createDataFrame(starts, "__p int, __base bigint")
    rank = F.row_number().over(Window.partitionBy("__p").orderBy("id")) - 1 + F.col("__base")
    return ranged.join(F.broadcast(s), "__p").withColumn("id", rank).drop("__p", "__base")


def delete_selected(df: DataFrame, sel: DataFrame) -> DataFrame:
    return renumber(df.join(sel, "id", "left_anti"))


def extract_selected(df: DataFrame, sel: DataFrame) -> DataFrame:
    return renumber(df.join(sel, "id", "left_semi"))


def subset(df: DataFrame, indices: DataFrame) -> DataFrame:
    """``indices``: (pos, id), repeats allowed; rows in the order of pos. Raises
    where an id is missing."""
    missing = indices.join(df, "id", "left_anti")
    if not missing.isEmpty():
        raise ValueError("an index is out of range")
    return indices.join(df, "id").withColumn("id", F.col("pos")).drop("pos")


def duplicate_selected(df: DataFrame, sel: DataFrame, offset=(0.0, 0.0, 0.0)) -> DataFrame:
    """Copies moved by the offset, appended behind the largest id in order."""
    n = df.agg(F.coalesce(F.max("id") + 1, F.lit(0)).alias("n")).first()["n"]
    copies = renumber(df.join(sel, "id", "left_semi")).withColumn("id", F.col("id") + n)
    for a, o in zip("xyz", offset, strict=True):
        copies = copies.withColumn(a, F.col(a) + o)
    return df.unionByName(copies)


def _flagged(df: DataFrame, sel: DataFrame) -> DataFrame:
    return df.join(sel.select("id").distinct().withColumn("__s", F.lit(True)), "id", "left")


def set_color(df: DataFrame, sel: DataFrame, color) -> DataFrame:
    if not all(math.isfinite(c) for c in color):
        raise ValueError("color is not finite")
    f = _flagged(df, sel)
    for c, v in zip("rgb", color, strict=True):
        f = f.withColumn(c, F.when(F.col("__s"), F.lit(float(v))).otherwise(F.col(c)))
    return f.drop("__s")


def set_radius(df: DataFrame, sel: DataFrame, radius: float) -> DataFrame:
    if not (math.isfinite(radius) and radius > 0):
        raise ValueError("radius is not positive")
    return _flagged(df, sel).withColumn("radius", F.when(F.col("__s"), F.lit(float(radius))).otherwise(F.col("radius"))).drop("__s")


def translation_matrix(t) -> np.ndarray:
    m = np.eye(4)
    m[:3, 3] = t
    return m


def rotation_about(center, degrees) -> np.ndarray:
    """Ry * Rx * Rz of the angles about x, y, z, around the centre."""
    x, y, z = np.radians(degrees)
    rx = np.array([[1, 0, 0], [0, math.cos(x), -math.sin(x)], [0, math.sin(x), math.cos(x)]])
    ry = np.array([[math.cos(y), 0, math.sin(y)], [0, 1, 0], [-math.sin(y), 0, math.cos(y)]])
    rz = np.array([[math.cos(z), -math.sin(z), 0], [math.sin(z), math.cos(z), 0], [0, 0, 1]])
    m = np.eye(4)
    m[:3, :3] = ry @ rx @ rz
    return translation_matrix(center) @ m @ translation_matrix(-np.asarray(center, float))


def scale_about(center, scale) -> np.ndarray:
    m = np.diag([*np.broadcast_to(scale, 3), 1.0])
    return translation_matrix(center) @ m @ translation_matrix(-np.asarray(center, float))


def transform_selected(df: DataFrame, sel: DataFrame, m) -> DataFrame:
    """Positions by the matrix, normals by its inverse transpose at unit length;
    a singular matrix is refused if there are normals. Radii stay."""
    m = np.asarray(m, float)
    f = _flagged(df, sel)
    p = [F.col(a) for a in "xyz"]
    new = {a: F.when(F.col("__s"), p[0] * m[i, 0] + p[1] * m[i, 1] + p[2] * m[i, 2] + m[i, 3]).otherwise(p[i]) for i, a in enumerate("xyz")}
    if "nx" in df.columns:
        if abs(np.linalg.det(m[:3, :3])) < 1e-12:
            raise ValueError("the matrix is singular")
        w = np.linalg.inv(m[:3, :3]).T
        q = [F.col(f"n{a}") for a in "xyz"]
        v = [q[0] * w[i, 0] + q[1] * w[i, 1] + q[2] * w[i, 2] for i in range(3)]
        length = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
        new |= {f"n{a}": F.when(F.col("__s") & (length > 0), v[i] / length).otherwise(q[i]) for i, a in enumerate("xyz")}
    return f.withColumns(new).drop("__s")


def concatenate_meshes(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``vertices``: (mesh, vid, x, y, z); ``faces``: (mesh, a, b, c). Meshes follow
    one another in the order of their numbers and indices shift by the vertices before."""
    sizes = vertices.groupBy("mesh").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("mesh").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = sizes.withColumn("start", before).select("mesh", "start")  # one row a mesh
    v = vertices.join(F.broadcast(start), "mesh").withColumn("vid", F.col("vid") + F.col("start")).drop("start")
    f = faces.join(F.broadcast(start), "mesh").select("mesh", *[(F.col(c) + F.col("start")).alias(c) for c in "abc"])
    return v, f
