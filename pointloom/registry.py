"""Every query of the engine's own operators, with its SQL twin."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import aggregates as agg
from .operators import cluster, features, filters, fitting, pick, registration, selection, splat, surface
from .plans.clouds import EMB_SQL, LINE_SQL, embedding_cloud, lineitem_cloud
from .plans.neighbors import knn, radius_neighbors
from .streaming import accumulate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "voxel_downsample"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in cols})


#: All pairs for the small oracle cloud: the brute force behind the cell joins.
PAIRS = """
d AS (SELECT a.id AS id, b.id AS nid, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz,
  sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z)) AS dist,
  b.nx AS n_nx, b.ny AS n_ny, b.nz AS n_nz FROM emb a JOIN emb b ON a.id <> b.id)"""
KNN = "k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nid) AS rank FROM d) WHERE rank <= 10)"
BASE = f"WITH RECURSIVE {EMB_SQL}"


@query(f"WITH {LINE_SQL} SELECT CAST(floor(x * 0.5) AS BIGINT) AS vx, CAST(floor(y * 0.5) AS BIGINT) AS vy, CAST(floor(z * 0.5) AS BIGINT) AS vz, "
       "round(avg(x), 6) + 0.0 AS x, round(avg(y), 6) + 0.0 AS y, round(avg(z), 9) + 0.0 AS z, count(*) AS n FROM line GROUP BY 1, 2, 3")  # fmt: skip
def voxel_downsample(spark, sf):
    v = agg.voxel_downsample(lineitem_cloud(spark, sf), 2.0, id_col=None)
    return _r(_r(v, "x", "y"), "z", digits=9)


@query(f"{BASE} SELECT CAST(floor(x * (1.0 / 0.1)) AS BIGINT) AS vx, CAST(floor(y * (1.0 / 0.1)) AS BIGINT) AS vy, CAST(floor(z * (1.0 / 0.1)) AS BIGINT) AS vz, "
       "round(avg(x), 6) + 0.0 AS x, round(avg(y), 6) + 0.0 AS y, round(avg(z), 6) + 0.0 AS z, count(*) AS n, min(id) AS first_id FROM emb GROUP BY 1, 2, 3")  # fmt: skip
def voxel_downsample_ids(spark, sf):
    return _r(agg.voxel_downsample(embedding_cloud(spark, sf), 0.1), "x", "y", "z")


@query(f"{BASE} SELECT id, x BETWEEN -0.1 AND 0.1 AS inlier FROM emb")
def pass_through(spark, sf):
    return filters.pass_through(embedding_cloud(spark, sf), "x", -0.1, 0.1).select("id", "inlier")


@query(f"{BASE}, {PAIRS} SELECT id, nid, round(dist, 6) AS dist FROM d WHERE dist < 0.1")
def radius_search(spark, sf):
    return _r(radius_neighbors(embedding_cloud(spark, sf), 0.1).select("id", "nid", "dist"), "dist")


@query(f"{BASE}, {PAIRS}, {KNN} SELECT id, nid, rank, round(dist, 6) AS dist FROM k")
def knn_search(spark, sf):
    return _r(knn(embedding_cloud(spark, sf), 10).select("id", "nid", F.col("rank").cast("bigint").alias("rank"), "dist"), "dist")


@query(f"{BASE}, {PAIRS} SELECT emb.id, count(nid) >= 20 AS inlier FROM emb LEFT JOIN d ON d.id = emb.id AND dist <= 0.1 GROUP BY emb.id")
def radius_outlier(spark, sf):
    return filters.radius_outlier(embedding_cloud(spark, sf), 0.1, 20).select("id", "inlier")


@query(f"{BASE}, {PAIRS}, {KNN}, m AS (SELECT id, avg(dist) AS m FROM k GROUP BY id) "
       "SELECT id, m <= (SELECT avg(m) + 1.0 * stddev_pop(m) FROM m) AS inlier FROM m")  # fmt: skip
def statistical_outlier(spark, sf):
    return filters.statistical_outlier(embedding_cloud(spark, sf), 10, 1.0).select("id", "inlier")


DENSITY = "w AS (SELECT emb.id, coalesce(sum(exp(-(dist / 0.1) * (dist / 0.1) / 2) * (1 / sqrt(2 * pi()))), 0.0) AS density FROM emb LEFT JOIN d ON d.id = emb.id AND dist < 0.1 GROUP BY emb.id)"


@query(f"{BASE}, {PAIRS}, {DENSITY} SELECT id, round(density, 6) AS density FROM w")
def density(spark, sf):
    return _r(filters.density(embedding_cloud(spark, sf), 0.1), "density")


@query(f"{BASE}, {PAIRS}, {KNN}, f AS (SELECT *, max(dist) OVER (PARTITION BY id) AS far FROM k) "
       "SELECT id, round(sum(exp(-(dist / far) * (dist / far) / 2) * (1 / sqrt(2 * pi()))), 6) AS density FROM f GROUP BY id")  # fmt: skip
def density_knn(spark, sf):
    return _r(filters.density_knn(embedding_cloud(spark, sf), 10), "density")


@query(f"{BASE}, {PAIRS}, {DENSITY} SELECT id, abs(density - (SELECT avg(density) FROM w)) <= 2 * (SELECT stddev_pop(density) FROM w) AS inlier FROM w")
def density_filter(spark, sf):
    return filters.density_filter(embedding_cloud(spark, sf), 0.1).select("id", "inlier")


def _moments(table: str) -> str:
    c = ", ".join(f"sum(d{p[0]} * d{p[1]}) / count(*) - sum(d{p[0]}) * sum(d{p[1]}) / count(*) / count(*) AS {p}" for p in ("xx", "xy", "xz", "yy", "yz", "zz"))
    return f"c AS (SELECT id, count(*) AS n, {c} FROM {table} GROUP BY id)"


CURVE = (
    "q AS (SELECT *, (xx + yy + zz) / 3 AS q FROM c WHERE n >= 3), "
    "p AS (SELECT *, sqrt(((xx-q)*(xx-q) + (yy-q)*(yy-q) + (zz-q)*(zz-q) + 2*(xy*xy + xz*xz + yz*yz)) / 6) AS p FROM q), "
    "r AS (SELECT *, greatest(-1.0, least(1.0, ((xx-q)*((yy-q)*(zz-q) - yz*yz) - xy*(xy*(zz-q) - yz*xz) + xz*(xy*yz - (yy-q)*xz)) / (2*p*p*p))) AS r FROM p WHERE p > 0), "
    "v AS (SELECT id, greatest(0.0, q + 2 * p * cos(acos(r) / 3 + 2 * pi() / 3)) / (3 * q) AS v FROM r)"
)


@query(f"{BASE}, {PAIRS}, {KNN}, {_moments('k')}, {CURVE} SELECT emb.id, round(coalesce(v, 0.0), 5) AS curvature FROM emb LEFT JOIN v USING (id)")
def curvature_knn(spark, sf):
    return _r(features.curvature(embedding_cloud(spark, sf), k=10), "curvature", digits=5)


@query(f"{BASE}, {PAIRS}, dd AS (SELECT * FROM d WHERE dist < 0.1), {_moments('dd')}, {CURVE} "
       "SELECT emb.id, round(coalesce(v, 0.0), 5) AS curvature FROM emb LEFT JOIN v USING (id)")  # fmt: skip
def curvature_radius(spark, sf):
    return _r(features.curvature(embedding_cloud(spark, sf), radius=0.1), "curvature", digits=5)


@query(f"{BASE}, {PAIRS}, dd AS (SELECT * FROM d WHERE dist < 0.1), {_moments('dd')}, {CURVE}, f AS (SELECT emb.id, coalesce(v, 0.0) AS v FROM emb LEFT JOIN v USING (id)) "
       "SELECT id, round(v, 5) AS curvature, round(v / (SELECT max(v) FROM f), 5) AS gray FROM f WHERE v <= 0.1")  # fmt: skip
def curvature_filter(spark, sf):
    return _r(filters.curvature_filter(embedding_cloud(spark, sf), 0.1, 0.1).select("id", "curvature", "gray"), "curvature", "gray", digits=5)


def _normal_sql(table: str) -> str:
    """The direction of least variance of the neighbours and the point itself, from
    the closed-form least eigenvalue and the longest cross product of two rows of C - lambda I."""
    c = ", ".join(f"(sum(d{p[0]} * d{p[1]}) - sum(d{p[0]}) * sum(d{p[1]}) / (count(*) + 1)) / count(*) AS {p}" for p in ("xx", "xy", "xz", "yy", "yz", "zz"))
    rows = {"a": ("xx - l", "xy", "xz"), "b": ("xy", "yy - l", "yz"), "c": ("xz", "yz", "zz - l")}
    cross = {}
    for k, (u, v) in enumerate((("a", "b"), ("a", "c"), ("b", "c"))):
        p, q = rows[u], rows[v]
        cross[k] = [f"(({p[i]}) * ({q[j]}) - ({p[j]}) * ({q[i]}))" for i, j in ((1, 2), (2, 0), (0, 1))]
    pick = ", ".join(f"{e} AS w{k}{n}" for k, es in cross.items() for e, n in zip(es, "xyz", strict=True))
    size = ", ".join(f"sqrt(w{k}x * w{k}x + w{k}y * w{k}y + w{k}z * w{k}z) AS s{k}" for k in cross)
    best = ", ".join(f"CASE WHEN s0 >= s1 AND s0 >= s2 THEN w0{n} / s0 WHEN s1 >= s2 THEN w1{n} / s1 ELSE w2{n} / s2 END AS n{n}" for n in "xyz")
    return (
        f"c AS (SELECT id, {c} FROM {table} GROUP BY id HAVING count(*) >= 2), q AS (SELECT *, (xx + yy + zz) / 3 AS q FROM c), "
        "p AS (SELECT *, sqrt(((xx-q)*(xx-q) + (yy-q)*(yy-q) + (zz-q)*(zz-q) + 2*(xy*xy + xz*xz + yz*yz)) / 6) AS p FROM q), "
        "r AS (SELECT *, greatest(-1.0, least(1.0, ((xx-q)*((yy-q)*(zz-q) - yz*yz) - xy*(xy*(zz-q) - yz*xz) + xz*(xy*yz - (yy-q)*xz)) / (2*p*p*p))) AS r FROM p), "
        "l AS (SELECT *, q + 2 * p * cos(acos(r) / 3 + 2 * pi() / 3) AS l FROM r), "
        f"w AS (SELECT id, {pick} FROM l), s AS (SELECT *, {size} FROM w), n AS (SELECT id, {best} FROM s)"
    )


PRODUCTS = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]


@query(f"{BASE}, {PAIRS}, {KNN}, {_normal_sql('k')} SELECT id, {', '.join(f'round(n{a} * n{b}, 4) + 0.0 AS {a}{b}' for a, b in PRODUCTS)} FROM n")
def normals_knn(spark, sf):
    """Products of the components, which don't depend on the sign."""
    n = features.normals(embedding_cloud(spark, sf), k=10)
    return _r(n.select("id", *[(F.col(f"n{a}") * F.col(f"n{b}")).alias(a + b) for a, b in PRODUCTS]), *[a + b for a, b in PRODUCTS], digits=4)


@query(f"{BASE}, {PAIRS}, dd AS (SELECT * FROM d WHERE dist < 0.1), {_normal_sql('dd')}, "
       "f AS (SELECT emb.id, n.nx, n.ny, n.nz, CASE WHEN -x * n.nx - y * n.ny + (10.0 - z) * n.nz < 0 THEN -1 ELSE 1 END AS f FROM emb LEFT JOIN n USING (id)) "
       "SELECT id, round(coalesce(f * nx, 0.0), 4) + 0.0 AS nx, round(coalesce(f * ny, 0.0), 4) + 0.0 AS ny, round(coalesce(f * nz, 0.0), 4) + 0.0 AS nz FROM f")  # fmt: skip
def normals_oriented(spark, sf):
    df = embedding_cloud(spark, sf).drop("nx", "ny", "nz")
    n = features.orient_normals(df.join(features.normals(df, radius=0.1), "id"), (0.0, 0.0, 10.0))
    return _r(n.select("id", "nx", "ny", "nz"), "nx", "ny", "nz", digits=4)


@query()
def principal_curvatures(spark, sf):
    return features.principal_curvatures(embedding_cloud(spark, sf), k=10)


#: Histograms of pair features in the frame u = n1, v = u x e, w = u x v.
FPFH = (
    "pf AS (SELECT k.id, nid, dist, emb.nx AS ux, emb.ny AS uy, emb.nz AS uz, n_nx AS mx, n_ny AS my, n_nz AS mz, dx / dist AS ex, dy / dist AS ey, dz / dist AS ez FROM k JOIN emb USING (id) WHERE dist > 0), "
    "pv AS (SELECT *, uy * ez - uz * ey AS cx, uz * ex - ux * ez AS cy, ux * ey - uy * ex AS cz FROM pf), "
    "pl AS (SELECT *, sqrt(cx * cx + cy * cy + cz * cz) AS l FROM pv), "
    "pw AS (SELECT *, CASE WHEN l > 1e-12 THEN cx / l ELSE 0.0 END AS vx, CASE WHEN l > 1e-12 THEN cy / l ELSE 0.0 END AS vy, CASE WHEN l > 1e-12 THEN cz / l ELSE 0.0 END AS vz FROM pl), "
    "pt AS (SELECT id, nid, dist, vx * mx + vy * my + vz * mz AS alpha, ux * ex + uy * ey + uz * ez AS phi, "
    "atan2((uy * vz - uz * vy) * mx + (uz * vx - ux * vz) * my + (ux * vy - uy * vx) * mz, ux * mx + uy * my + uz * mz) AS theta FROM pw), "
    "pb AS (SELECT id, unnest([greatest(0, least(10, CAST(floor((alpha + 1) / 2 * 11) AS INT))), 11 + greatest(0, least(10, CAST(floor((phi + 1) / 2 * 11) AS INT))), "
    "22 + greatest(0, least(10, CAST(floor((theta + pi() / 2) / pi() * 11) AS INT)))]) AS bin FROM pt), "
    "pn AS (SELECT id, count(*) AS n FROM pt GROUP BY id), ph AS (SELECT id, bin, count(*) / max(n) AS h FROM pb JOIN pn USING (id) GROUP BY id, bin), "
    "pm AS (SELECT pt.id, bin, sum(h / dist) / {k} AS w FROM pt JOIN ph ON ph.id = pt.nid GROUP BY pt.id, bin), "
    "fp AS (SELECT emb.id, b.bin, coalesce(h, 0.0) + coalesce(w, 0.0) AS value FROM emb CROSS JOIN range(0, 33) b(bin) LEFT JOIN ph ON ph.id = emb.id AND ph.bin = b.bin LEFT JOIN pm ON pm.id = emb.id AND pm.bin = b.bin)"
)


@query(f"{BASE}, {PAIRS}, {KNN}, {FPFH.format(k=10)} SELECT id, CAST(bin AS INT) AS bin, round(value, 5) AS value FROM fp")
def fpfh(spark, sf):
    return _r(features.fpfh(embedding_cloud(spark, sf), 10).select("id", F.posexplode("histogram").alias("bin", "value")), "value", digits=5)


@query(f"{BASE}, {PAIRS}, {KNN}, {FPFH.format(k=10)}, m AS (SELECT bin, avg(value) AS m FROM fp GROUP BY bin) "
       "SELECT id, round(sqrt(sum((value - m) * (value - m))), 5) AS distance FROM fp JOIN m USING (bin) GROUP BY id")  # fmt: skip
def fpfh_distance(spark, sf):
    return _r(features.fpfh_distance(features.fpfh(embedding_cloud(spark, sf), 10)), "distance", digits=5)


@query(f"{BASE}, {PAIRS}, {KNN}, own AS (SELECT k.*, emb.nx, emb.ny, emb.nz FROM k JOIN emb USING (id)), "
       "u AS (SELECT *, CASE WHEN abs(nx) > 0.9 THEN nz ELSE 0.0 END AS ux, CASE WHEN abs(nx) > 0.9 THEN 0.0 ELSE -nz END AS uy, CASE WHEN abs(nx) > 0.9 THEN -nx ELSE ny END AS uz FROM own), "
       "s AS (SELECT id, dx, dy, dz, nx, ny, nz, ux / l AS ux, uy / l AS uy, uz / l AS uz FROM (SELECT *, sqrt(ux * ux + uy * uy + uz * uz) AS l FROM u)), "
       "a AS (SELECT id, atan2(dx * (ny * uz - nz * uy) + dy * (nz * ux - nx * uz) + dz * (nx * uy - ny * ux), dx * ux + dy * uy + dz * uz) AS a FROM s), "
       "g AS (SELECT id, a, a - lag(a) OVER (PARTITION BY id ORDER BY a) AS gap FROM a) "
       "SELECT id, count(*) >= 3 AND greatest(max(gap), 2 * pi() - (max(a) - min(a))) > 2.0 AS boundary FROM g GROUP BY id")  # fmt: skip
def boundary_knn(spark, sf):
    return features.boundary(embedding_cloud(spark, sf), k=10, max_gap=2.0)


COMPONENTS = (
    "e AS (SELECT id, nid FROM d WHERE dist < 0.05), "
    "reach(id, root) AS (SELECT id, id FROM emb UNION SELECT e.nid, reach.root FROM reach JOIN e ON e.id = reach.id), "
    "root AS (SELECT id, min(root) AS root FROM reach GROUP BY id)"
)


@query(f"{BASE}, {PAIRS}, {COMPONENTS} SELECT id, CAST(dense_rank() OVER (ORDER BY root) AS INT) AS cluster_id FROM root")
def distance_clusters(spark, sf):
    return cluster.distance_clusters(embedding_cloud(spark, sf), 0.05)


@query(f"{BASE}, {PAIRS}, near AS (SELECT id, nid FROM d WHERE dist < 0.06), core AS (SELECT id FROM near GROUP BY id HAVING count(*) >= 5), "
       "e AS (SELECT * FROM near WHERE id IN (SELECT id FROM core) AND nid IN (SELECT id FROM core)), "
       "reach(id, root) AS (SELECT id, id FROM core UNION SELECT e.nid, reach.root FROM reach JOIN e ON e.id = reach.id), "
       "lab AS (SELECT id, CAST(dense_rank() OVER (ORDER BY root) AS INT) AS c FROM (SELECT id, min(root) AS root FROM reach GROUP BY id)), "
       "edge AS (SELECT near.id, min(c) AS c FROM near JOIN lab ON lab.id = near.nid GROUP BY near.id) "
       "SELECT emb.id, coalesce(lab.c, edge.c, -1) AS cluster_id FROM emb LEFT JOIN lab ON lab.id = emb.id LEFT JOIN edge ON edge.id = emb.id")  # fmt: skip
def dbscan(spark, sf):
    return cluster.dbscan(embedding_cloud(spark, sf), 0.06, 5)


@query()
def region_growing(spark, sf):
    df = embedding_cloud(spark, sf)
    return cluster.region_growing(df.join(features.curvature(df, k=10), "id"), k=10, angle=0.6, min_size=5)


@query(f"{BASE}, {PAIRS}, {KNN.replace('rank <= 10', 'rank <= 9')}, e0 AS (SELECT k.id, k.nid FROM k JOIN emb USING (id) WHERE abs(nx * n_nx + ny * n_ny + nz * n_nz) >= cos(0.6)), "
       "e AS (SELECT id, nid FROM e0 UNION SELECT nid, id FROM e0), reach(id, root) AS (SELECT id, id FROM emb UNION SELECT e.nid, reach.root FROM reach JOIN e ON e.id = reach.id), "
       "root AS (SELECT id, min(root) AS root FROM reach GROUP BY id), big AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS region FROM root GROUP BY root HAVING count(*) >= 5) "
       "SELECT id, CAST(coalesce(region, -1) AS INT) AS region FROM root LEFT JOIN big USING (root)")  # fmt: skip
def smooth_components(spark, sf):
    return cluster.smooth_components(embedding_cloud(spark, sf), k=10, angle=0.6, min_size=5)


def _terrain(spark, sf):
    return embedding_cloud(spark, sf).select("id", (F.col("x") * 20).alias("x"), (F.col("y") * 20).alias("y"), (F.col("z") * 5).alias("z"))


def _ground_sql() -> str:
    q = [f"{BASE}, t AS (SELECT id, x * 20 AS x, y * 20 AS y, z * 5 AS z FROM emb), b AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM t), "
         "p AS (SELECT id, z, CAST(least(floor(x1 - x0), floor(x - x0)) AS INT) AS ix, CAST(least(floor(y1 - y0), floor(y - y0)) AS INT) AS iy FROM t, b), "
         "full_grid AS (SELECT ix, iy FROM b, range(0, CAST(floor(x1 - x0) AS BIGINT) + 1) AS r(ix), range(0, CAST(floor(y1 - y0) AS BIGINT) + 1) AS s(iy)), "
         "s0 AS (SELECT ix, iy, min(z) AS z FROM p GROUP BY ix, iy)"]  # fmt: skip
    bad = []
    for k, r in enumerate((1, 2, 4, 8, 16)):
        box = f"o.ix BETWEEN g.ix - {r} AND g.ix + {r} AND o.iy BETWEEN g.iy - {r} AND g.iy + {r}"
        q.append(f"e{k} AS (SELECT g.ix, g.iy, min(o.z) AS z FROM full_grid g JOIN s{k} o ON {box} GROUP BY 1, 2)")
        q.append(f"s{k + 1} AS (SELECT g.ix, g.iy, max(o.z) AS z FROM full_grid g JOIN e{k} o ON {box} GROUP BY 1, 2)")
        bad.append(f"SELECT a.ix, a.iy FROM s{k} a JOIN s{k + 1} c USING (ix, iy) WHERE a.z - c.z > {min(3.0, 0.2 + 0.3 * r * 1.0)!r}")
    q.append(f"bad AS ({' UNION '.join(bad)})")
    return ", ".join(q) + " SELECT p.id, bad.ix IS NULL AND p.z - s5.z <= 0.3 AS ground FROM p JOIN s5 USING (ix, iy) LEFT JOIN bad ON bad.ix = p.ix AND bad.iy = p.iy"


@query(_ground_sql())
def ground(spark, sf):
    return cluster.ground(_terrain(spark, sf))


@query(f"WITH {LINE_SQL}, b AS (SELECT min(x) AS x0, min(y) AS y0 FROM line) "
       "SELECT CAST(floor((x - x0) / 5.0) AS INT) AS ix, CAST(floor((y - y0) / 5.0) AS INT) AS iy, round(min(h), 6) AS z FROM line, b GROUP BY 1, 2")  # fmt: skip
def raster_min(spark, sf):
    return _r(agg.raster_min(lineitem_cloud(spark, sf), 5.0, "h"), "z")


@query(f"WITH {LINE_SQL} SELECT min(x) AS min_x, min(y) AS min_y, round(min(z), 6) AS min_z, max(x) AS max_x, max(y) AS max_y, round(max(z), 6) AS max_z FROM line")
def bounds(spark, sf):
    return _r(agg.bounds(lineitem_cloud(spark, sf)), "min_z", "max_z")


@query(f"{BASE}, b AS (SELECT max(x) - min(x) AS ex, max(y) - min(y) AS ey, max(z) - min(z) AS ez, count(*) AS n FROM emb), "
       "t AS (SELECT *, greatest(ex, ey, ez) * 0.01 AS f FROM b) SELECT round(greatest(1e-6, 0.5 * cbrt(greatest(ex, f) * greatest(ey, f) * greatest(ez, f) / n)), 6) AS radius FROM t")  # fmt: skip
def default_radius(spark, sf):
    return _r(agg.default_radius(embedding_cloud(spark, sf)), "radius")


def _sel(spark, sf):
    return embedding_cloud(spark, sf).where("id % 7 = 0").select("id")


@query(f"{BASE} SELECT round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n FROM emb WHERE id % 7 = 0")
def selection_centroid(spark, sf):
    return _r(agg.selection_centroid(embedding_cloud(spark, sf), _sel(spark, sf)), "x", "y", "z")


@query(f"{BASE} SELECT min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z FROM emb WHERE id % 7 = 0")
def selection_bounds(spark, sf):
    return agg.selection_bounds(embedding_cloud(spark, sf), _sel(spark, sf))


@query(f"{BASE} SELECT id, 'radius is not positive' AS message FROM emb WHERE NOT x > 0 ORDER BY id LIMIT 1")
def validate(spark, sf):
    return agg.validate(embedding_cloud(spark, sf).withColumn("radius", F.when(F.col("x") > 0, F.col("x")).otherwise(-1.0)).drop("nx", "ny", "nz"))


@query(f"{BASE} SELECT id FROM emb WHERE (id % 7 = 0) <> (id % 3 = 0)")
def selection_toggle(spark, sf):
    return selection.combine(_sel(spark, sf), embedding_cloud(spark, sf).where("id % 3 = 0"), "toggle")


@query(f"{BASE} SELECT id FROM emb WHERE id % 7 = 0 OR id % 3 = 0")
def selection_add(spark, sf):
    return selection.combine(_sel(spark, sf), embedding_cloud(spark, sf).where("id % 3 = 0"), "add")


@query(f"{BASE} SELECT id FROM emb WHERE id % 7 = 0 AND id % 3 <> 0")
def selection_remove(spark, sf):
    return selection.combine(_sel(spark, sf), embedding_cloud(spark, sf).where("id % 3 = 0"), "remove")


@query(f"{BASE} SELECT id FROM emb WHERE id % 7 <> 0")
def selection_invert(spark, sf):
    return selection.invert(embedding_cloud(spark, sf), _sel(spark, sf))


@query(f"{BASE} SELECT DISTINCT id - 100 AS id FROM emb WHERE id - 100 >= 0 AND id - 100 < 300")
def selection_normalize(spark, sf):
    moved = embedding_cloud(spark, sf).select((F.col("id") - 100).alias("id"))
    return selection.normalize_selection(moved.unionByName(moved), 300)


@query(f"{BASE} SELECT row_number() OVER (ORDER BY id) - 1 AS id, x, y, z FROM emb WHERE id % 7 <> 0")
def delete_selected(spark, sf):
    return selection.delete_selected(embedding_cloud(spark, sf), _sel(spark, sf)).select("id", "x", "y", "z")


@query(f"{BASE} SELECT row_number() OVER (ORDER BY id) - 1 AS id, x, y, z FROM emb WHERE id % 7 = 0")
def extract_selected(spark, sf):
    return selection.extract_selected(embedding_cloud(spark, sf), _sel(spark, sf)).select("id", "x", "y", "z")


@query(f"{BASE}, n AS (SELECT max(id) + 1 AS n FROM emb) SELECT id, x, y, z FROM emb UNION ALL SELECT n + row_number() OVER (ORDER BY id) - 1, x + 1.0, y + 0.0, z + 0.0 FROM emb, n WHERE id % 7 = 0")
def duplicate_selected(spark, sf):
    return selection.duplicate_selected(embedding_cloud(spark, sf).select("id", "x", "y", "z"), _sel(spark, sf), (1.0, 0.0, 0.0))


@query(f"{BASE} SELECT id, CASE WHEN id % 7 = 0 THEN 0.5 ELSE 0.01 END AS radius FROM emb")
def set_radius(spark, sf):
    return selection.set_radius(embedding_cloud(spark, sf).select("id", F.lit(0.01).alias("radius")), _sel(spark, sf), 0.5)


@query(f"{BASE} SELECT id, CASE WHEN id % 7 = 0 THEN 1.0 ELSE 0.5 END AS r, CASE WHEN id % 7 = 0 THEN 0.25 ELSE 0.5 END AS g, CASE WHEN id % 7 = 0 THEN 0.0 ELSE 0.5 END AS b FROM emb")
def set_color(spark, sf):
    c = embedding_cloud(spark, sf).select("id", *[F.lit(0.5).alias(k) for k in "rgb"])
    return selection.set_color(c, _sel(spark, sf), (1.0, 0.25, 0.0))


@query(f"{BASE} SELECT id, round(CASE WHEN id % 7 = 0 THEN 2 * x + 1 ELSE x END, 6) + 0.0 AS x, round(CASE WHEN id % 7 = 0 THEN 2 * y ELSE y END, 6) + 0.0 AS y, round(CASE WHEN id % 7 = 0 THEN 2 * z ELSE z END, 6) + 0.0 AS z FROM emb")
def transform_selected(spark, sf):
    m = selection.translation_matrix((1.0, 0.0, 0.0)) @ selection.scale_about((0.0, 0.0, 0.0), 2.0)
    return _r(selection.transform_selected(embedding_cloud(spark, sf), _sel(spark, sf), m).select("id", "x", "y", "z"), "x", "y", "z")


@query(f"{BASE} SELECT id, round(z, 6) + 0.0 AS x, round(y + 1, 6) + 0.0 AS y, round(-x, 6) + 0.0 AS z FROM emb")
def transform_cloud(spark, sf):
    return _r(filters.transform(embedding_cloud(spark, sf), [[0, 0, 1], [0, 1, 0], [-1, 0, 0]], [0, 1, 0]).select("id", "x", "y", "z"), "x", "y", "z")


@query(f"{BASE} SELECT id, round((nx + 1) / 2, 6) AS r, round((ny + 1) / 2, 6) AS g, round((nz + 1) / 2, 6) AS b FROM emb")
def normal_colors(spark, sf):
    return _r(filters.normal_colors(embedding_cloud(spark, sf)).select("id", "r", "g", "b"), "r", "g", "b")


@query(f"{BASE} SELECT id, round(x + 0.1 * nx, 6) + 0.0 AS x2, round(y + 0.1 * ny, 6) + 0.0 AS y2, round(z + 0.1 * nz, 6) + 0.0 AS z2 FROM emb")
def normal_segments(spark, sf):
    return _r(filters.normal_segments(embedding_cloud(spark, sf), 0.1).select("id", "x2", "y2", "z2"), "x2", "y2", "z2")


@query(f"{BASE} SELECT id, x FROM emb UNION ALL SELECT id, x FROM emb WHERE id % 7 = 0")
def visible_union(spark, sf):
    e = embedding_cloud(spark, sf).select("id", "x")
    return filters.visible_union([(e, True), (e, False), (e.join(_sel(spark, sf), "id", "left_semi"), True)])


PLANES = ((0, 1.0, 0.0, 0.0, 0.0), (1, 0.0, 1.0, 0.0, 0.02), (2, 0.0, 0.0, 1.0, -0.01), (3, 0.6, 0.8, 0.0, 0.05))


@query(f"{BASE}, h(i, a, b, c, d) AS (VALUES {', '.join(map(str, PLANES))}) "
       "SELECT i AS iteration, count(*) AS inliers FROM emb, h WHERE abs(a * x + b * y + c * z + d) <= 0.05 GROUP BY i")  # fmt: skip
def ransac_plane_scores(spark, sf):
    h = spark.createDataFrame(PLANES, "iteration int, a double, b double, c double, d double")
    return fitting.score(embedding_cloud(spark, sf), h, "plane", 0.05).select("iteration", "inliers")


SPHERES = ((0, 0.0, 0.0, 0.0, 0.15), (1, 0.1, 0.0, 0.0, 0.2), (2, 0.0, -0.1, 0.05, 0.25))


@query(f"{BASE}, h(i, a, b, c, r) AS (VALUES {', '.join(map(str, SPHERES))}), "
       "s AS (SELECT i, count(*) AS n FROM emb, h WHERE abs(sqrt((x - a) * (x - a) + (y - b) * (y - b) + (z - c) * (z - c)) - r) <= 0.03 GROUP BY i) "
       "SELECT i AS iteration, n AS inliers FROM s ORDER BY n DESC, i LIMIT 1")  # fmt: skip
def ransac_sphere_best(spark, sf):
    h = spark.createDataFrame(SPHERES, "iteration int, x double, y double, z double, r double")
    return fitting.best(fitting.score(embedding_cloud(spark, sf), h, "sphere", 0.03)).select("iteration", "inliers")


def _ransac(kind):
    def run(spark, sf):
        _, df = fitting.ransac(embedding_cloud(spark, sf), kind, iterations=50, threshold=0.05, min_inliers=10)
        return df.select("id", "inlier")

    return run


for _kind in ("plane", "sphere", "cylinder", "cone"):
    QUERIES[f"ransac_{_kind}"] = _ransac(_kind)


def _moved(spark, sf):
    return filters.transform(embedding_cloud(spark, sf).drop("label"), [[0.995, -0.0998, 0], [0.0998, 0.995, 0], [0, 0, 1]], [0.01, 0.02, 0])


@query(f"{BASE}, m AS (SELECT id, 0.995 * x - 0.0998 * y + 0.0 * z + 0.01 AS x, 0.0998 * x + 0.995 * y + 0.0 * z + 0.02 AS y, 0.0 * x + 0.0 * y + 1.0 * z AS z FROM emb), "
       "p AS (SELECT m.id, emb.id AS nid, row_number() OVER (PARTITION BY m.id ORDER BY (emb.x - m.x) * (emb.x - m.x) + (emb.y - m.y) * (emb.y - m.y) + (emb.z - m.z) * (emb.z - m.z), emb.id) AS k, "
       "sqrt((emb.x - m.x) * (emb.x - m.x) + (emb.y - m.y) * (emb.y - m.y) + (emb.z - m.z) * (emb.z - m.z)) AS dist FROM m, emb) "
       "SELECT id, nid, round(dist, 6) AS dist FROM p WHERE k = 1")  # fmt: skip
def nearest_match(spark, sf):
    from .plans.neighbors import nearest

    return _r(nearest(_moved(spark, sf), embedding_cloud(spark, sf)).select("id", "nid", "dist"), "dist")


def _alignment(spark, a: registration.Alignment) -> DataFrame:
    row = (*map(float, a.rotation.ravel()), *map(float, a.translation), float(a.scale), a.iterations, float(a.fitness), a.converged)
    cols = ", ".join([*[f"r{i}{j} double" for i in range(3) for j in range(3)], "tx double, ty double, tz double, scale double, iterations int, fitness double, converged boolean"])
    return spark.createDataFrame([row], cols)


@query()
def icp(spark, sf):
    return _alignment(spark, registration.icp(_moved(spark, sf), embedding_cloud(spark, sf), iterations=5))


@query()
def icp_point_to_plane(spark, sf):
    return _alignment(spark, registration.icp_point_to_plane(_moved(spark, sf), embedding_cloud(spark, sf), iterations=3))


@query(f"{BASE}, {PAIRS}, {KNN.replace('rank <= 10', 'rank <= 8')}, {FPFH.format(k=8)}, m AS (SELECT a.id, b.id AS nid, sum((a.value - b.value) * (a.value - b.value)) AS d2 FROM fp a JOIN fp b USING (bin) WHERE a.id % 2 = 0 AND b.id % 2 = 1 GROUP BY 1, 2) "
       "SELECT id, arg_min(nid, d2) AS nid, round(min(d2), 4) AS d2 FROM m GROUP BY id")  # fmt: skip
def feature_matches(spark, sf):
    h = features.fpfh(embedding_cloud(spark, sf), 8)
    return _r(registration.feature_matches(h.where("id % 2 = 0"), h.where("id % 2 = 1")), "d2", digits=4)


@query()
def global_registration(spark, sf):
    """The cloud against itself, moved."""
    e = embedding_cloud(spark, sf)
    c, s = math.cos(0.3), math.sin(0.3)
    turn = ((c, -s, 0.0), (s, c, 0.0), (0.0, 0.0, 1.0))
    moved = filters.transform(e, turn, (0.2, -0.1, 0.05))
    n = e.select("id", *[sum((F.col(f"n{b}") * turn[i][j] for j, b in enumerate("xyz")), F.lit(0.0)).alias(f"n{a}") for i, a in enumerate("xyz")])
    got = registration.global_registration(e, moved, features.fpfh(e, 20), features.fpfh(moved.join(n, "id"), 20), iterations=200, max_distance=0.02)
    return _alignment(spark, got)


@query(f"WITH {LINE_SQL}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM line) "
       "SELECT round(x, 6) AS x, round(y, 6) AS y, round((x1 - x0) * (y1 - y0), 4) AS area FROM b, (SELECT x0 AS x, y0 AS y FROM b UNION SELECT x0, y1 FROM b UNION SELECT x1, y0 FROM b UNION SELECT x1, y1 FROM b)")  # fmt: skip
def convex_hull(spark, sf):
    return _r(_r(surface.convex_hull_2d(lineitem_cloud(spark, sf)).select("x", "y", "area"), "x", "y"), "area", digits=4)


@query()
def concave_hull(spark, sf):
    return surface.concave_hull_2d(embedding_cloud(spark, sf))


@query()
def greedy_mesh(spark, sf):
    return surface.greedy_mesh(embedding_cloud(spark, sf))


@query()
def poisson_surface(spark, sf):
    return surface.poisson_surface(embedding_cloud(spark, sf), resolution=24, iterations=40)


@query()
def mls_smooth(spark, sf):
    return features.mls_smooth(embedding_cloud(spark, sf), k=10).select("id", "x", "y", "z")


@query()
def mls_upsample(spark, sf):
    return features.mls_upsample(embedding_cloud(spark, sf), k=10, up_radius=0.02, step=0.01)


VP = ((2.0, 0.0, 0.0, 0.0), (0.0, 2.0, 0.0, 0.0), (0.0, 0.0, 1.0, 1.0), (0.0, 0.0, 1.0, 2.0))


@query(f"{BASE}, s AS (SELECT id, (2 * x / (z + 2) + 1) / 2 * 640 AS sx, (1 - 2 * y / (z + 2)) / 2 * 480 AS sy FROM emb) SELECT id FROM s WHERE sx BETWEEN 300 AND 360 AND sy BETWEEN 200 AND 280")
def box_select_xray(spark, sf):
    return pick.box_select(embedding_cloud(spark, sf), VP, 640, 480, 300, 200, 360, 280, xray=True)


SCREEN = (
    "s AS (SELECT id, (2 * x / (z + 2) + 1) / 2 * 640 AS sx, (1 - 2 * y / (z + 2)) / 2 * 480 AS sy, z + 2 AS w FROM emb WHERE z + 2 > 1e-9), "
    "f AS (SELECT a.id, min(b.w) AS front FROM s a JOIN s b ON abs(floor(a.sx) - floor(b.sx)) <= 1 AND abs(floor(a.sy) - floor(b.sy)) <= 1 GROUP BY a.id), "
    "v AS (SELECT s.* FROM s JOIN f USING (id) WHERE w <= front * (1 + 1e-3))"
)


@query(f"{BASE}, {SCREEN} SELECT id FROM v WHERE sx BETWEEN 300 AND 360 AND sy BETWEEN 200 AND 280")
def box_select_visible(spark, sf):
    return pick.box_select(embedding_cloud(spark, sf), VP, 640, 480, 300, 200, 360, 280)


@query(f"{BASE}, {SCREEN}, d AS (SELECT id, w, sqrt((sx - 320) * (sx - 320) + (sy - 240) * (sy - 240)) AS d FROM v) SELECT id FROM d WHERE d <= 50 ORDER BY d, w, id LIMIT 1")
def pick_point(spark, sf):
    return pick.pick_point(embedding_cloud(spark, sf), VP, 640, 480, 320, 240, reach=50)


def _splats(spark, sf):
    e = embedding_cloud(spark, sf)
    return e.select("id", "x", "y", (F.col("z") + 2).alias("z"), F.array(*[F.col(f"n{a}") for a in "xyz"]).alias("f_dc"), F.col("nx").alias("opacity"),
                    F.array(*[F.lit(-3.0)] * 3).alias("scale"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("rot"))


VIEW = ((1.0, 0, 0, 0), (0, 1.0, 0, 0), (0, 0, 1.0, 0))


@query(f"{BASE}, s AS (SELECT id, x, y, z + 2 AS z, exp(-6.0) AS v FROM emb), "
       "t AS (SELECT *, greatest(-0.312, least(0.312, x / z)) AS tx, greatest(-0.312, least(0.312, y / z)) AS ty FROM s WHERE z > 1e-4) "
       "SELECT id, round(x / z * 200 + 48, 4) AS cx, round(y / z * 200 + 48, 4) AS cy, round(200 * 200 / (z * z) * v * (1 + tx * tx) + 0.3, 4) AS sxx, "
       "round(200 * 200 / (z * z) * v * tx * ty, 4) + 0.0 AS sxy, round(200 * 200 / (z * z) * v * (1 + ty * ty) + 0.3, 4) AS syy FROM t")  # fmt: skip
def splat_project(spark, sf):
    p = splat.project(_splats(spark, sf), VIEW, 200.0, 96, 96)
    return _r(p.select("id", "cx", "cy", "sxx", "sxy", "syy"), "cx", "cy", "sxx", "sxy", "syy", digits=4)


@query()
def splat_monte_carlo(spark, sf):
    return splat.render_monte_carlo(_splats(spark, sf), VIEW, 200.0, 32, 32, spp=2, sets=4)


@query()
def splat_particles(spark, sf):
    return splat.particles(_splats(spark, sf))


@query("WITH o AS (SELECT l_orderkey % 97 AS px, l_linenumber AS py, l_partkey, l_discount AS d, l_tax AS t, l_orderkey * 100000 + l_suppkey AS i FROM lineitem), "
       "w AS (SELECT *, exp(coalesce(sum(ln(1 - d)) OVER (PARTITION BY px, py ORDER BY l_partkey, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS t0 FROM o), "
       "v AS (SELECT *, CASE WHEN t0 > 1e-9 THEN t0 * d ELSE 0.0 END AS v FROM w) "
       "SELECT px, py, round(sum(v * t), 7) AS r, round(sum(v * d), 7) AS g, round(sum(v * l_partkey / 1000.0), 5) AS b, round(sum(v), 7) AS coverage FROM v GROUP BY px, py")  # fmt: skip
def composite(spark, sf):
    t = spark.read.parquet(f"{sf}/lineitem.parquet")
    layers = t.select((F.col("l_orderkey") % 97).alias("px"), F.col("l_linenumber").alias("py"), F.col("l_partkey").alias("depth"), (F.col("l_orderkey") * 100000 + F.col("l_suppkey")).alias("id"),
                      F.col("l_tax").alias("r"), F.col("l_discount").alias("g"), (F.col("l_partkey") / 1000.0).alias("b"), F.col("l_discount").alias("a"))
    return _r(_r(splat.composite(layers), "r", "g", "coverage", digits=7), "b", digits=5)


@query("WITH g AS (SELECT user_id AS id, event_type AS metric, avg(value) AS mean, stddev_samp(value) AS sd, count(value) AS n FROM events GROUP BY 1, 2) "
       f"SELECT id, metric, round(mean, 6) AS mean, round(sd, 6) AS sd, n, round(CASE WHEN n > 1 THEN [{', '.join(map(str, agg.T95))}][least(30, n - 1)] * sd / sqrt(n) ELSE 0.0 END, 6) AS ci95 FROM g")  # fmt: skip
def group_means(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("id"), F.col("event_type").alias("metric"), "value")
    return _r(agg.confidence(e, ["id", "metric"], "value").select("id", "metric", "mean", "sd", "n", "ci95"), "mean", "sd", "ci95")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    return _r(accumulate.event_windows(spark.read.parquet(f"{sf}/events.parquet")), "total", digits=4)


@query("SELECT l_orderkey % 5 AS version, CAST(l_linenumber AS INT) AS px, 0 AS py, round(avg(l_discount), 6) AS r, round(avg(l_tax), 6) AS g, round(avg(l_tax * l_discount), 6) AS b, count(*) AS samples FROM lineitem GROUP BY 1, 2")
def running_mean(spark, sf):
    t = spark.read.parquet(f"{sf}/lineitem.parquet")
    s = t.select((F.col("l_orderkey") % 5).alias("version"), F.col("l_linenumber").cast("int").alias("px"), F.lit(0).alias("py"),
                 F.col("l_discount").alias("r"), F.col("l_tax").alias("g"), (F.col("l_tax") * F.col("l_discount")).alias("b"))
    return _r(accumulate.running_mean(s).select("version", "px", "py", "r", "g", "b", "samples"), "r", "g", "b")


@query("WITH a AS (SELECT l_suppkey AS px, l_linenumber AS py, avg(l_discount) AS u, avg(l_tax) AS v FROM lineitem GROUP BY 1, 2) "
       "SELECT round(avg((u - v) * (u - v)), 8) AS mse, round(-10 * log10(avg((u - v) * (u - v))), 4) AS psnr FROM a")  # fmt: skip
def image_psnr(spark, sf):
    t = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("px"), F.col("l_linenumber").alias("py"))
    m = t.agg(F.avg("l_discount").alias("u"), F.avg("l_tax").alias("v"))
    a, b = (m.select("px", "py", *[F.col(c).alias(k) for k in "rgb"]) for c in "uv")
    return _r(_r(splat.psnr(a, b), "mse", digits=8), "psnr", digits=4)


@query()
def content_hash(spark, sf):
    return agg.content_hash(embedding_cloud(spark, sf))


from . import registry_formulas  # noqa: E402

QUERIES.update(registry_formulas.QUERIES)
ORACLE_SQL.update(registry_formulas.ORACLE_SQL)
