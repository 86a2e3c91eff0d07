"""Neighbourhoods as equi-joins on grid cells.

Radius search: points fall into cubes as wide as the radius; the query side visits its
cube and the 26 around it, and distances are tested behind the hash join. k
nearest: the same join, in rounds of doubled cubes. All points outside a point's
27 cubes are at least one cube's width away, so a round settles every point whose
k-th candidate is nearer than that; only the others go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .materialize import cut

AXES = ("x", "y", "z")


def cell(axis: str, width) -> F.Column:
    return F.floor(F.col(axis) / F.lit(width)).cast("bigint")


def with_cells(df: DataFrame, width: float) -> DataFrame:
    return df.select("*", *[cell(a, width).alias(f"c{a}") for a in AXES])


def visited(df: DataFrame, width: float) -> DataFrame:
    """Every row once for each of the 27 cubes it must visit."""
    step = "explode(array(-1L, 0L, 1L))"
    out = with_cells(df, width)
    for a in AXES:
        out = out.select("*", F.expr(step).alias(f"s{a}")).withColumn(f"c{a}", F.col(f"c{a}") + F.col(f"s{a}")).drop(f"s{a}")
    return out


def radius_pairs(queries: DataFrame, points: DataFrame, radius: float, closed: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(id, nid, dx, dy, dz, dist[, n_<carry>])`` for all pairs of different ids
    with dist < radius (<= if ``closed``). dx = neighbour - query."""
    if radius <= 0:
        raise ValueError("radius must be positive")
    q = visited(queries.select("id", *AXES), radius)
    p = with_cells(points.select(F.col("id").alias("nid"), *[F.col(a).alias(f"n{a}_") for a in AXES], *[F.col(c).alias(f"n_{c}") for c in carry]).select(
        "*", *[F.col(f"n{a}_").alias(a) for a in AXES]), radius).drop(*AXES)
    both = q.join(p, ["cx", "cy", "cz"]).where("id <> nid")
    d = {a: F.col(f"n{a}_") - F.col(a) for a in AXES}
    d2 = d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"]
    near = F.sqrt(d2) <= radius if closed else F.sqrt(d2) < radius
    return both.where(near).select(
        "id", "nid", *[v.alias(f"d{a}") for a, v in d.items()], F.sqrt(d2).alias("dist"), *[f"n_{c}" for c in carry]
    )


def radius_neighbors(df: DataFrame, radius: float, closed: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Neighbours within one cloud; a point is not its own neighbour."""
    return radius_pairs(df, df, radius, closed, carry)


def knn_pairs(queries: DataFrame, points: DataFrame, k: int, exclude_self: bool = True, carry: tuple[str, ...] = (), width: float | None = None) -> DataFrame:
    """``(id, nid, dx, dy, dz, dist, rank[, n_<carry>])``: the k nearest points of
    each query, ties by nid, ranks from 1. Fewer if there aren't k points."""
    schema_points = points.select("id", *AXES, *carry)
    box = schema_points.agg(
        F.count(F.lit(1)).alias("n"), *[F.min(a).alias(f"lo{a}") for a in AXES], *[F.max(a).alias(f"hi{a}") for a in AXES]
    ).first()
    qbox = queries.agg(*[F.min(a).alias(f"lo{a}") for a in AXES], *[F.max(a).alias(f"hi{a}") for a in AXES]).first()
    n = box["n"]
    names = ["id", "nid", "dx", "dy", "dz", "dist", "rank", *[f"n_{c}" for c in carry]]
    whole = max((max(box[f"hi{a}"], qbox[f"hi{a}"]) - min(box[f"lo{a}"], qbox[f"lo{a}"]) for a in AXES), default=0.0) if n and qbox["lox"] is not None else 0.0
    if width is None:
        sides = [max((box[f"hi{a}"] - box[f"lo{a}"]) if n else 0.0, whole * 1e-3, 1e-12) for a in AXES]
        width = _start_width(schema_points, (sides[0] * sides[1] * sides[2] * max(k, 1) / max(n, 1)) ** (1 / 3), k) if n > CHECKED else (
            sides[0] * sides[1] * sides[2] * max(k, 1) / max(n, 1)) ** (1 / 3)
    done, left = None, queries.select("id", *AXES)
    while True:
        last = width > whole
        wide = width
        near = _candidates(left, schema_points, wide, exclude_self, carry)
        if not last:
            near = near.where(F.sqrt("d2") < wide)  # what lies beyond settles no point, so it isn't sorted
        order = Window.partitionBy("id").orderBy("d2", "nid")
        top = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        top = top.withColumn("dist", F.sqrt("d2"))
        if last:
            found = top.select(names)
            return found if done is None else done.unionByName(found)
        top = cut(top.select(*names))
        settled = top.groupBy("id").agg(F.count(F.lit(1)).alias("m"), F.max("dist").alias("far")).where((F.col("m") == k) & (F.col("far") < wide)).select("id")
        found = top.join(settled, "id", "left_semi").select(names)
        done = found if done is None else done.unionByName(found)
        left = cut(left.join(settled, "id", "left_anti"))
        if left.isEmpty():
            return done
        width *= 2


#: Clouds up to this size aren't measured for their first width.
CHECKED = 5_000


def _start_width(points: DataFrame, width: float, k: int) -> float:
    """A cube's width at which a point's own cube holds some 2 k points at most on average over the
    points; as a ball of that width has four times as much room, most of them settle at once. The bounding box alone would put a dense cluster with one far point into
    one cube; points in thinner regions settle in later rounds, when cubes have grown."""
    seen = []
    floor, target = width * 1e-15, 2 * max(k, 1)
    while width > floor:
        c = with_cells(points, width).groupBy("cx", "cy", "cz").agg(F.count(F.lit(1)).alias("c"))
        mean = c.agg(F.sum(F.col("c").cast("double") * F.col("c")) / F.sum("c")).first()[0]
        stuck = bool(seen) and mean > 0.97 * seen[-1][0]
        seen.append((mean, width))
        if mean <= target:
            break
        width /= 64.0 if stuck else min(64.0, max(2.0, (mean / target) ** 0.5))
    least = min(m for m, _ in seen)
    return max(w for m, w in seen if m <= max(target, 1.03 * least))  # copies of a point can't be parted


def _candidates(q: DataFrame, p: DataFrame, width: float, exclude_self: bool, carry: tuple[str, ...]) -> DataFrame:
    a = visited(q, width)
    b = with_cells(p, width).select(
        F.col("id").alias("nid"), *[F.col(c).alias(f"p{c}") for c in AXES], *[F.col(c).alias(f"n_{c}") for c in carry], "cx", "cy", "cz"
    )
    both = a.join(b, ["cx", "cy", "cz"])
    if exclude_self:
        both = both.where("id <> nid")
    d = {c: F.col(f"p{c}") - F.col(c) for c in AXES}
    return both.select(
        "id", "nid", *[v.alias(f"d{c}") for c, v in d.items()],
        (d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"]).alias("d2"), *[f"n_{c}" for c in carry],
    )


def knn(df: DataFrame, k: int, exclude_self: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    return knn_pairs(df, df, k, exclude_self, carry)


def nearest(source: DataFrame, target: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The nearest target point of each source point, ties by id."""
    return knn_pairs(source, target, 1, exclude_self=False, carry=carry).drop("rank")
