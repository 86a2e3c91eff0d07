"""Aggregates over clouds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.neighbors import AXES


def voxel_downsample(df: DataFrame, size: float, id_col: str | None = "id") -> DataFrame:
    """Centroid, count and least id of each voxel: key = floor(p * (1 / size)).
    One hash aggregate that combines on the map side."""
    if size <= 0:
        raise ValueError("voxel size must be positive")
    inv = 1.0 / size
    keys = [F.floor(F.col(a) * inv).cast("bigint").alias(f"v{a}") for a in AXES]
    out = [F.avg(a).alias(a) for a in AXES] + [F.count(F.lit(1)).alias("n")]
    if id_col:
        out.append(F.min(id_col).alias("first_id"))
    return df.groupBy(*keys).agg(*out)


def bounds(df: DataFrame, radius_scale: float | None = None) -> DataFrame:
    """One row of minima and maxima; with ``radius_scale`` each point counts as a
    ball of its radius times that. Nulls for an empty cloud."""
    r = F.col("radius") * radius_scale if radius_scale is not None else F.lit(0.0)
    return df.agg(
        *[F.min(F.col(a) - r).alias(f"min_{a}") for a in AXES], *[F.max(F.col(a) + r).alias(f"max_{a}") for a in AXES]
    )


def default_radius(df: DataFrame) -> DataFrame:
    """Half the cube root of the volume a point has; an axis counts at least 1 %
    of the longest, at least 1e-6, and 0.01 for a cloud without extent."""
    b = bounds(df).crossJoin(df.agg(F.count(F.lit(1)).alias("n")))  # one row each
    e = [F.col(f"max_{a}") - F.col(f"min_{a}") for a in AXES]
    top = F.greatest(*e)
    floor = [F.greatest(x, top * 0.01) for x in e]
    r = F.greatest(F.lit(1e-6), 0.5 * F.cbrt(floor[0] * floor[1] * floor[2] / F.col("n")))
    return b.select(F.when((F.col("n") > 0) & (top > 0), r).otherwise(0.01).alias("radius"))


def selection_centroid(df: DataFrame, selection: DataFrame) -> DataFrame:
    return df.join(selection, "id", "left_semi").agg(*[F.avg(a).alias(a) for a in AXES], F.count(F.lit(1)).alias("n"))


def selection_bounds(df: DataFrame, selection: DataFrame) -> DataFrame:
    return bounds(df.join(selection, "id", "left_semi"))


def object_center(df: DataFrame) -> DataFrame:
    return df.agg(*[F.avg(a).alias(a) for a in AXES])


def bad(*cols: str) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return out


def validate(df: DataFrame) -> DataFrame:
    """The message of the first broken rule by id; no row if all hold."""
    checks = [(bad("x", "y", "z"), "position is not finite")]
    if "r" in df.columns:
        checks.append((bad("r", "g", "b"), "color is not finite"))
    if "radius" in df.columns:
        checks.append((bad("radius") | (F.col("radius") <= 0), "radius is not positive"))
    if "nx" in df.columns:
        checks.append((bad("nx", "ny", "nz"), "normal is not finite"))
    message = F.coalesce(*[F.when(c, F.lit(m)) for c, m in checks])
    first = df.withColumn("message", message).where("message IS NOT NULL").agg(F.min(F.struct("id", "message")).alias("m"))
    return first.where("m IS NOT NULL").select("m.id", "m.message")


def total_area(triangles: DataFrame) -> DataFrame:
    """Columns ax..cz; the sum of half the cross products' lengths."""
    u = [F.col(f"b{a}") - F.col(f"a{a}") for a in AXES]
    v = [F.col(f"c{a}") - F.col(f"a{a}") for a in AXES]
    c = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    return triangles.agg(F.coalesce(F.sum(0.5 * F.sqrt(c[0] * c[0] + c[1] * c[1] + c[2] * c[2])), F.lit(0.0)).alias("area"))


#: Two-sided 95 % points of Student's t for 1 to 30 degrees of freedom.
T95 = (
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131,
    2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042,
)


def confidence(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Mean, sample deviation, count and half width of the 95 % interval a group."""
    t = F.element_at(F.array(*[F.lit(v) for v in T95]), F.least(F.lit(30), F.greatest(F.lit(1), F.col("n").cast("int") - 1)))
    out = df.groupBy(*group).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    return out.withColumn("ci95", F.when(F.col("n") > 1, t * F.col("sd") / F.sqrt("n")).otherwise(0.0))


def raster_min(df: DataFrame, cell: float, height: str = "z") -> DataFrame:
    """Least height of each XY cell, counted from the cloud's lower corner."""
    b = df.agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    c = df.crossJoin(F.broadcast(b)).select(  # one row
        F.floor((F.col("x") - F.col("x0")) / cell).cast("int").alias("ix"), F.floor((F.col("y") - F.col("y0")) / cell).cast("int").alias("iy"), F.col(height).alias("z")
    )
    return c.groupBy("ix", "iy").agg(F.min("z").alias("z"))


def memory_bytes(df: DataFrame) -> DataFrame:
    """Rows times the widths of the float columns a point has (4 bytes each)."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.agg((F.count(F.lit(1)) * 4 * len(floats)).alias("bytes"))


def content_hash(df: DataFrame, columns: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """An order-free 64-bit hash of the rows with their ids, the same for equal clouds
    however they are partitioned: equal rows are counted, the rows' hashes with their
    counts summed without carry between the halves. It's this engine's own hash; files carry FNV-1a of their body."""
    rows = df.groupBy("id", *columns).agg(F.count(F.lit(1)).alias("copies__"))
    h = F.xxhash64("id", *columns, "copies__")
    low, high = F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftrightunsigned(h, 32))
    both = [F.lower(F.lpad(F.hex(F.coalesce(x, F.lit(0)).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")) for x in (high, low)]
    return rows.agg(F.concat(*both).alias("hash"))


def fnv1a64(data: bytes, h: int = 0xCBF29CE484222325) -> int:
    """FNV-1a over bytes, for interchange files; ``h`` is the hash of what came before."""
    prime, mask = 0x100000001B3, 0xFFFFFFFFFFFFFFFF
    for b in memoryview(data):  # each step needs the one before; interchange files alone are hashed so
        h = (h ^ b) * prime & mask
    return h


def frame_stats(particles: DataFrame) -> DataFrame:
    """Counters of generated, active and drawn particles (columns active, drawn)."""
    return particles.agg(
        F.count(F.lit(1)).alias("generated"), F.count_if("active").alias("active"), F.count_if(F.col("active") & F.col("drawn")).alias("drawn")
    )


def exclusive_scan(df: DataFrame, value: str, order: str = "id", top: int = (1 << 32) - 1) -> DataFrame:
    """Adds ``offset``: the sum of ``value`` before each row, at most ``top``. Ranges
    of the order are summed first, so that no task scans all rows."""
    from pyspark.sql.window import Window

    from ..plans.materialize import cut

    r = cut(df.repartitionByRange(order).withColumn("__p", F.spark_partition_id()))
    base, starts = 0, []
    for row in r.groupBy("__p").agg(F.sum(value).alias("s")).orderBy("__p").collect():  # one row a partition
        starts.append((row["__p"], base))
        base += row["s"] or 0
    s = df.sparkSession.createDataFrame(starts, "__p int, __base bigint")
    before = F.sum(value).over(Window.partitionBy("__p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return r.join(F.broadcast(s), "__p").withColumn("offset", F.least(F.lit(top), F.coalesce(before, F.lit(0)) + F.col("__base"))).drop("__p", "__base")


def plane_polygon(df: DataFrame, plane: tuple) -> DataFrame:
    """Corners of the rectangle in a plane (a, b, c, d) that holds the cloud's
    projections: (i, x, y, z)."""
    import numpy as np

    n = np.asarray(plane[:3], float)
    n = n / np.linalg.norm(n)
    u = np.cross(n, [1.0, 0, 0] if abs(n[0]) < 0.9 else [0, 1.0, 0])
    u /= np.linalg.norm(u)
    v = np.cross(n, u)
    dot = lambda w: sum((F.col(a) * float(k) for a, k in zip(AXES, w, strict=True)), F.lit(0.0))
    b = df.agg(F.min(dot(u)).alias("u0"), F.max(dot(u)).alias("u1"), F.min(dot(v)).alias("v0"), F.max(dot(v)).alias("v1")).first()
    rows = []
    if b["u0"] is not None:
        for i, (s, t) in enumerate(((b["u0"], b["v0"]), (b["u1"], b["v0"]), (b["u1"], b["v1"]), (b["u0"], b["v1"]))):
            rows.append((i, *map(float, s * u + t * v - float(plane[3]) * n)))
    return df.sparkSession.createDataFrame(rows, "i int, x double, y double, z double")


def cylinder_mesh(df: DataFrame, model: tuple, segments: int = 32) -> tuple[DataFrame, DataFrame]:
    """Vertices (vid, x, y, z) and faces (a, b, c) of a cylinder (point, axis,
    radius) over the cloud's extent along the axis."""
    import numpy as np

    p, a, r = np.asarray(model[:3], float), np.asarray(model[3:6], float), float(model[6])
    u = np.cross(a, [1.0, 0, 0] if abs(a[0]) < 0.9 else [0, 1.0, 0])
    u /= np.linalg.norm(u)
    v = np.cross(a, u)
    t = sum(((F.col(x) - float(o)) * float(k) for x, o, k in zip(AXES, p, a, strict=True)), F.lit(0.0))
    b = df.agg(F.min(t).alias("lo"), F.max(t).alias("hi")).first()
    vertices, faces = [], []
    for k in range(segments):
        c, s = np.cos(2 * np.pi * k / segments), np.sin(2 * np.pi * k / segments)
        for j, h in enumerate((b["lo"] or 0.0, b["hi"] or 0.0)):
            vertices.append((2 * k + j, *map(float, p + h * a + r * (c * u + s * v))))
        n = 2 * ((k + 1) % segments)
        faces += [(2 * k, n, 2 * k + 1), (n, n + 1, 2 * k + 1)]
    spark = df.sparkSession
    return spark.createDataFrame(vertices, "vid int, x double, y double, z double"), spark.createDataFrame(faces, "a int, b int, c int")
