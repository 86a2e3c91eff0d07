"""Picking and box selection on the screen."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_screen(df: DataFrame, view_projection, width: int, height: int) -> DataFrame:
    """Adds sx, sy in pixels (y down) and w; rows behind the eye go. 4 x 4 matrix."""
    m = np.asarray(view_projection, float)
    p = [F.col(a) for a in "xyz"]
    c = [sum((p[j] * m[i, j] for j in range(3)), F.lit(m[i, 3])) for i in range(4)]
    s = df.withColumns({"cx_": c[0], "cy_": c[1], "w": c[3]}).where("w > 1e-9")
    return s.withColumn("sx", (F.col("cx_") / F.col("w") + 1) / 2 * width).withColumn("sy", (1 - F.col("cy_") / F.col("w")) / 2 * height).drop("cx_", "cy_")


def depth_map(screen: DataFrame, radius: int) -> DataFrame:
    """The nearest w over the pixels that each point covers."""
    at = screen.select("w", F.floor("sx").cast("int").alias("a"), F.floor("sy").cast("int").alias("b"))
    each = at.select("w", "b", F.explode(F.expr(f"sequence(a - {radius}, a + {radius})")).alias("px"))
    each = each.select("w", "px", F.explode(F.expr(f"sequence(b - {radius}, b + {radius})")).alias("py"))
    return each.groupBy("px", "py").agg(F.min("w").alias("front"))


def visible(screen: DataFrame, radius: int = 1, tolerance: float = 1e-3, occluders: DataFrame | None = None) -> DataFrame:
    """Points whose own pixel shows nothing clearly nearer, of the cloud or the
    occluders' depth (px, py, front)."""
    front = depth_map(screen, radius)
    if occluders is not None:
        front = front.unionByName(occluders).groupBy("px", "py").agg(F.min("front").alias("front"))
    at = screen.withColumn("px", F.floor("sx").cast("int")).withColumn("py", F.floor("sy").cast("int"))
    return at.join(front, ["px", "py"]).where(F.col("w") <= F.col("front") * (1 + tolerance)).drop("px", "py", "front")


def pick_point(df: DataFrame, view_projection, width: int, height: int, x: float, y: float, reach: float = 8.0, xray: bool = False,
               radius: int = 1, tolerance: float = 1e-3, occluders: DataFrame | None = None) -> DataFrame:
    """The id nearest to the cursor within reach, the nearer to the eye on ties;
    no row if none. A top-1, not a sort."""
    s = to_screen(df, view_projection, width, height)
    if not xray:
        s = visible(s, radius, tolerance, occluders)
    d = s.withColumn("d", F.hypot(F.col("sx") - x, F.col("sy") - y)).where(F.col("d") <= reach)
    return d.orderBy("d", "w", "id").limit(1).select("id")


def box_select(df: DataFrame, view_projection, width: int, height: int, x0: float, y0: float, x1: float, y1: float, xray: bool = False,
               radius: int = 1, tolerance: float = 1e-3, occluders: DataFrame | None = None) -> DataFrame:
    s = to_screen(df, view_projection, width, height)
    if not xray:
        s = visible(s, radius, tolerance, occluders)
    return s.where(F.col("sx").between(min(x0, x1), max(x0, x1)) & F.col("sy").between(min(y0, y1), max(y0, y1))).select("id")


def triangle_depth(triangles: DataFrame, view_projection, width: int, height: int) -> DataFrame:
    """(px, py, front) of triangles ax..cz: pixel centres inside, 1 / w linear on
    the screen."""
    cols = []
    for v in "abc":
        t = to_screen(triangles.select(*[F.col(f"{v}{a}").alias(a) for a in "xyz"], *triangles.columns), view_projection, width, height)
        triangles = t.withColumnRenamed("sx", f"{v}_sx").withColumnRenamed("sy", f"{v}_sy").withColumnRenamed("w", f"{v}_w").drop("x", "y", "z")
        cols.append((F.col(f"{v}_sx"), F.col(f"{v}_sy"), F.col(f"{v}_w")))
    (ax, ay, aw), (bx, by, bw), (cx, cy, cw) = cols
    lim = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(c).cast("int")))
    box = triangles.withColumn("px", F.explode(F.sequence(lim(F.least(ax, bx, cx), width), lim(F.greatest(ax, bx, cx), width))))
    box = box.withColumn("py", F.explode(F.sequence(lim(F.least(ay, by, cy), height), lim(F.greatest(ay, by, cy), height))))
    x, y = F.col("px") + 0.5, F.col("py") + 0.5
    area = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    u = ((bx - x) * (cy - y) - (by - y) * (cx - x)) / area
    v = ((cx - x) * (ay - y) - (cy - y) * (ax - x)) / area
    hit = box.where(area != 0).withColumns({"u": u, "v": v}).where("u >= 0 AND v >= 0 AND u + v <= 1")
    inv = F.col("u") / aw + F.col("v") / bw + (1 - F.col("u") - F.col("v")) / cw
    return hit.groupBy("px", "py").agg((1 / F.max(inv)).alias("front"))
