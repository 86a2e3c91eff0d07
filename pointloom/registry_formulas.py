"""Queries of scalar functions, generators, files and small operators, with SQL twins."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import rng, scalar
from .operators import aggregates as agg
from .operators import features, filters, pick, registration, selection, splat, surface
from .plans.clouds import EMB_SQL, embedding_cloud
from .plans.filestore import write_bytes
from .plans.materialize import shared_dir
from .sources import codec, files, generators

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: The cloud with the embedding's dimensions from the seventh on as e7, e8, ...
WIDE = f"WITH {EMB_SQL}, wide AS (SELECT emb.*, {', '.join(f'CAST(embedding[{k}] AS DOUBLE) AS e{k}' for k in range(1, 65))} FROM emb JOIN embeddings ON vec_id = emb.id)"


def _wide(spark, sf) -> DataFrame:
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    extra = e.select(F.col("vec_id").alias("id"), *[F.col("embedding")[k - 1].cast("double").alias(f"e{k}") for k in range(1, 65)])
    return embedding_cloud(spark, sf).join(extra, "id")


def _out(df: DataFrame, digits: int = 6, **cols) -> DataFrame:
    return df.select("id", *[(F.round(c, digits) + 0.0).alias(n) for n, c in cols.items()])


def _sql(table: str, digits: int = 6, head: str = WIDE, **cols: str) -> str:
    return f"{head} SELECT id, {', '.join(f'round({e}, {digits}) + 0.0 AS {n}' for n, e in cols.items())} FROM {table}"


# ---- colour and opacity functions

UNIT = "((nx + 1) / 2)"


@query(_sql("wide", linear=f"CASE WHEN {UNIT} <= 0.04045 THEN {UNIT} / 12.92 ELSE pow(({UNIT} + 0.055) / 1.055, 2.4) END",
            srgb=f"CASE WHEN {UNIT} <= 0.0031308 THEN {UNIT} * 12.92 ELSE 1.055 * pow({UNIT}, 1 / 2.4) - 0.055 END",
            sig="1 / (1 + exp(-e7 * 5))", logit=f"CASE WHEN {UNIT} <= 0 THEN -40 WHEN {UNIT} >= 1 THEN 40 ELSE ln({UNIT} / (1 - {UNIT})) END",
            color="0.5 + 0.28209479177387814 * e8", dc="(e8 - 0.5) / 0.28209479177387814"))
def color_functions(spark, sf):
    unit = (F.col("nx") + 1) / 2
    return _out(_wide(spark, sf), linear=scalar.srgb_to_linear(unit), srgb=scalar.linear_to_srgb(unit), sig=scalar.sigmoid(F.col("e7") * 5),
                logit=scalar.logit(unit), color=scalar.sh_dc_to_color("e8"), dc=scalar.color_to_sh_dc("e8"))


def _sh_sql(c: int) -> str:
    e = lambda i: f"e{10 + c * 15 + i}"
    terms = [
        f"0.28209479177387814 * e{7 + c}", f"- 0.4886025119029199 * ny * {e(0)} + 0.4886025119029199 * nz * {e(1)} - 0.4886025119029199 * nx * {e(2)}",
        f"+ 1.0925484305920792 * nx * ny * {e(3)} - 1.0925484305920792 * ny * nz * {e(4)} + 0.31539156525252005 * (2 * nz * nz - nx * nx - ny * ny) * {e(5)}",
        f"- 1.0925484305920792 * nx * nz * {e(6)} + 0.5462742152960396 * (nx * nx - ny * ny) * {e(7)}",
        f"- 0.5900435899266435 * ny * (3 * nx * nx - ny * ny) * {e(8)} + 2.890611442640554 * nx * ny * nz * {e(9)}",
        f"- 0.4570457994644658 * ny * (4 * nz * nz - nx * nx - ny * ny) * {e(10)} + 0.3731763325901154 * nz * (2 * nz * nz - 3 * nx * nx - 3 * ny * ny) * {e(11)}",
        f"- 0.4570457994644658 * nx * (4 * nz * nz - nx * nx - ny * ny) * {e(12)} + 1.445305721320277 * nz * (nx * nx - ny * ny) * {e(13)} - 0.5900435899266435 * nx * (nx * nx - 3 * ny * ny) * {e(14)}",
    ]
    return f"greatest(0.0, {' '.join(terms)} + 0.5)"


@query(_sql("wide", **{c: _sh_sql(i) for i, c in enumerate("rgb")}))
def sh_colors(spark, sf):
    """Spherical harmonics of degree 3."""
    rest = F.array(*[F.col(f"e{10 + k}") for k in range(45)])
    d = (F.col("nx"), F.col("ny"), F.col("nz"))
    return _out(_wide(spark, sf), **{c: scalar.eval_sh(3, f"e{7 + i}", rest, i, d, 15) for i, c in enumerate("rgb")})


_ROT = (
    "ql AS (SELECT *, sqrt(e7 * e7 + e8 * e8 + e9 * e9 + e10 * e10) AS ql FROM wide), "
    "qn AS (SELECT *, e7 / ql AS qw, e8 / ql AS qx, e9 / ql AS qy, e10 / ql AS qz FROM ql), "
    "rot AS (SELECT *, 1 - 2 * (qy * qy + qz * qz) AS r00, 2 * (qx * qy - qw * qz) AS r01, 2 * (qx * qz + qw * qy) AS r02, "
    "2 * (qx * qy + qw * qz) AS r10, 1 - 2 * (qx * qx + qz * qz) AS r11, 2 * (qy * qz - qw * qx) AS r12, "
    "2 * (qx * qz - qw * qy) AS r20, 2 * (qy * qz + qw * qx) AS r21, 1 - 2 * (qx * qx + qy * qy) AS r22, "
    "exp(e11 - 3) AS s0, exp(e12 - 3) AS s1, exp(e13 - 3) AS s2 FROM qn), "
    "cov AS (SELECT *, " + ", ".join(
        f"r{i}0 * s0 * r{j}0 * s0 + r{i}1 * s1 * r{j}1 * s1 + r{i}2 * s2 * r{j}2 * s2 AS v{'xyz'[i]}{'xyz'[j]}" for i in range(3) for j in range(i, 3)
    ) + " FROM rot)"
)
TURNED = f"{WIDE}, {_ROT}"


def _splats(spark, sf) -> DataFrame:
    """Splats with turned, unequal axes, two units in front of the camera."""
    w = _wide(spark, sf)
    return w.select("id", "x", "y", (F.col("z") + 2).alias("z"), F.array("nx", "ny", "nz").alias("f_dc"), F.col("e14").alias("opacity"),
                    F.array(*[F.col(f"e{k}") - 3 for k in (11, 12, 13)]).alias("scale"), F.array("e7", "e8", "e9", "e10").alias("rot"))


@query(_sql("cov", 8, TURNED, **{f"v{a}{b}": f"v{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")}, r01="r01", r12="r12", r20="r20"))
def splat_covariance(spark, sf):
    s = _splats(spark, sf)
    r = scalar.quat_to_rotation(F.col("rot"))
    return _out(s, 8, **{f"v{k}": c for k, c in scalar.covariance_3d(F.col("scale"), F.col("rot")).items()}, r01=r[0][1], r12=r[1][2], r20=r[2][0])


_TOP = "greatest(s0, s1, s2)"


@query(_sql("cov", 5, TURNED, x="x", y="y", z="z + 2", size=f"{_TOP} * 100", **{f"row{i}_{j}": f"r{j}{i} * {_TOP} / s{i}" for i in range(3) for j in range(3)},
            **{c: f"0.5 + 0.28209479177387814 * n{a}" for c, a in zip("rgb", "xyz", strict=True)}, a="1 / (1 + exp(-e14))"))
def splat_present(spark, sf):
    p = splat.present(_splats(spark, sf))
    return _out(p, 5, x=F.col("x"), y=F.col("y"), z=F.col("z"), size=F.col("size"), **{f"row{i}_{j}": F.col(f"row{i}")[j] for i in range(3) for j in range(3)},
                **{c: F.col(c) for c in "rgba"})


VIEW = ((1.0, 0, 0, 0), (0, 1.0, 0, 0), (0, 0, 1.0, 0))


def _projected(focal: float, size: int) -> str:
    lim = 1.3 * 0.5 * size / focal
    return (
        f"cam AS (SELECT *, z + 2 AS d, greatest(-{lim!r}, least({lim!r}, x / (z + 2))) AS tx, greatest(-{lim!r}, least({lim!r}, y / (z + 2))) AS ty, 1 / (1 + exp(-e14)) AS alpha FROM cov WHERE z + 2 > 1e-4), "
        f"foot AS (SELECT id, x / d * {focal!r} + {size / 2!r} AS cx, y / d * {focal!r} + {size / 2!r} AS cy, {focal * focal!r} / (d * d) * (vxx - 2 * tx * vxz + tx * tx * vzz) + 0.3 AS sxx, "
        f"{focal * focal!r} / (d * d) * (vxy - ty * vxz - tx * vyz + tx * ty * vzz) AS sxy, {focal * focal!r} / (d * d) * (vyy - 2 * ty * vyz + ty * ty * vzz) + 0.3 AS syy, d AS depth, alpha, "
        + ", ".join(f"greatest(0.0, 0.5 + 0.28209479177387814 * n{a}) AS {c}" for a, c in zip("xyz", "rgb", strict=True))
        + " FROM cam), proj AS (SELECT * FROM foot WHERE sxx * syy - sxy * sxy > 0)"
    )


PROJ_COLS = ("cx", "cy", "sxx", "sxy", "syy", "depth", "alpha", "r", "g", "b")


@query(_sql("proj", 5, f"{TURNED}, {_projected(200.0, 96)}", **{c: c for c in PROJ_COLS}))
def splat_project_turned(spark, sf):
    p = splat.project(_splats(spark, sf), VIEW, 200.0, 96, 96)
    return _out(p, 5, **{c: F.col(c) for c in PROJ_COLS})


@query(f"{TURNED}, {_projected(200.0, 96)} SELECT id FROM proj WHERE alpha > 0.4 AND 2 * pi() * sqrt(sxx * syy - sxy * sxy) >= 30 "
       "AND cx + 12 * sqrt(sxx) >= 0 AND cx - 12 * sqrt(sxx) <= 96 AND cy + 12 * sqrt(syy) >= 0 AND cy - 12 * sqrt(syy) <= 96")  # fmt: skip
def splat_cull(spark, sf):
    return splat.cull(splat.project(_splats(spark, sf), VIEW, 200.0, 96, 96), 96, 96, 0.4, 30.0).select("id")


#: Layers over each pixel, composited front to back over a background.
_LIT = (
    "cover AS (SELECT px, py, id, depth, r, g, b, least(1 - 1e-15, alpha * exp(-0.5 * (syy * (px + 0.5 - cx) * (px + 0.5 - cx) - 2 * sxy * (px + 0.5 - cx) * (py + 0.5 - cy) + sxx * (py + 0.5 - cy) * (py + 0.5 - cy)) / (sxx * syy - sxy * sxy))) AS a "
    "FROM proj, range(0, 48) p(px), range(0, 48) q(py) WHERE px BETWEEN floor(cx - 6 * sqrt(sxx)) AND floor(cx + 6 * sqrt(sxx)) AND py BETWEEN floor(cy - 6 * sqrt(syy)) AND floor(cy + 6 * sqrt(syy))), "
    "lay AS (SELECT *, exp(coalesce(sum(ln(1 - a)) OVER (PARTITION BY px, py ORDER BY depth, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS t FROM cover), "
    "lit AS (SELECT px, py, sum(r * w) AS r, sum(g * w) AS g, sum(b * w) AS b, sum(w) AS c FROM (SELECT *, CASE WHEN t > 1e-9 THEN t * a ELSE 0.0 END AS w FROM lay) GROUP BY px, py), "
    "image AS (SELECT CAST(p.px AS INT) AS px, CAST(q.py AS INT) AS py, coalesce(r, 0.0) + (1 - coalesce(c, 0.0)) * 0.1 AS r, coalesce(g, 0.0) + (1 - coalesce(c, 0.0)) * 0.2 AS g, coalesce(b, 0.0) + (1 - coalesce(c, 0.0)) * 0.3 AS b "
    "FROM range(0, 48) p(px) CROSS JOIN range(0, 48) q(py) LEFT JOIN lit ON lit.px = p.px AND lit.py = q.py)"
)


@query(f"{TURNED}, {_projected(100.0, 48)}, {_LIT} SELECT px, py, round(r, 5) AS r, round(g, 5) AS g, round(b, 5) AS b FROM image")
def splat_render(spark, sf):
    image = splat.render_analytic(_splats(spark, sf), VIEW, 100.0, 48, 48, (0.1, 0.2, 0.3))
    return image.select("px", "py", *[F.round(c, 5).alias(c) for c in "rgb"])


def _series(x: str) -> str:
    return f"(SELECT sum(pow({x}, k) / (k * k)) FROM range(1, 900) AS s(k))"


@query(_sql("wide", 7, li=_series("abs(nx) * 0.95"), back="abs(nx) * 0.95", expected=f"(1 + x * x) * {_series('abs(nx) * 0.95')}"))
def dilogarithm(spark, sf):
    """The dilogarithm, its inverse, and the point count it gives."""
    e = embedding_cloud(spark, sf).withColumn("u", F.abs("nx") * 0.95).withColumn("li", scalar.dilog_udf("u"))

    @F.pandas_udf("double")
    def back(y: pd.Series) -> pd.Series:
        return pd.Series(scalar.inv_dilog(y.to_numpy()))

    return _out(e, 7, li=F.col("li"), back=back("li"), expected=scalar.expected_point_count("u", 1 + F.col("x") * F.col("x")))


O = "((nx + 1) / 2 * 0.9)"  # noqa: E741


@query(_sql("wide", 6, proportional=O, extinction=f"-ln(1 - {O})", dilog=_series(O), base=f"2 * {O} * 3", zoom=f"2 * -ln(1 - {O}) * 3 * (0.01 / 2.5) * (0.01 / 2.5) * 120 * 100",
            depth=f"2 * {O} * 3 * (0.01 / (z + 2)) * (0.01 / (z + 2)) * 120 * 100", footprint=f"2 * {_series(O)} * 4 * (1 + y * y)"))
def count_rules(spark, sf):
    o = (F.col("nx") + 1) / 2 * 0.9
    e = embedding_cloud(spark, sf)
    lens = {"focal": (120.0, 100.0), "pixel_length": 0.01}
    return _out(e, 6, proportional=scalar.opacity_term("proportional", o), extinction=scalar.opacity_term("extinction", o), dilog=scalar.opacity_term("dilog", o),
                base=scalar.calibrated_count("none", "proportional", o, 3.0, 2.0), zoom=scalar.calibrated_count("zoom", "extinction", o, 3.0, 2.0, object_depth=2.5, **lens),
                depth=scalar.calibrated_count("depth", "proportional", o, 3.0, 2.0, splat_depth=F.col("z") + 2, **lens),
                footprint=scalar.calibrated_count("footprint", "dilog", o, 3.0, 2.0, area=1 + F.col("y") * F.col("y"), spp=4.0))


_RATIO = "(CASE WHEN {0} < 1e-8 THEN 1 + 0.5 * {0} ELSE -ln(1 - {0}) / {0} END)"
_KEEP = f"{_RATIO.format(f'({O} * exp(-0.5 * e7 * e7 * 9))')} / {_RATIO.format(O)}"


@query(_sql("wide", 6, area="2 * pi() * sqrt(greatest(0.0, (1 + x * x) * (2 + y * y) - e7 * e7))", scale="CASE WHEN z + 1 > 0.5 THEN least(1e12, (0.5 / (z + 1)) * (0.5 / (z + 1)) * 200 * 100) ELSE 0 END",
            keep=f"greatest(0.0, least(1.0, {_KEEP}))", sub="greatest(0.0, e8) / 9", adaptive="CASE WHEN e9 > 0 THEN greatest(1, least(6, floor(20 * e9))) ELSE 1 END",
            clamped="least(5.0, 4 / 3.0 * pi() * abs(e7 * e8 * e9) / pow((z + 2) / 100.0, 3))", view=f"greatest(0.0, least(1.0, 4 * (1 + x * x) * {_series(O)} * 0.5 / 8.0))"))
def footprint_rules(spark, sf):
    w, o = _wide(spark, sf), (F.col("nx") + 1) / 2 * 0.9
    e = lambda k: F.col(f"e{k}")
    return _out(w, 6, area=scalar.footprint_area(1 + F.col("x") * F.col("x"), "e7", 2 + F.col("y") * F.col("y")), scale=scalar.pixel_density_scale(F.col("z") + 1, 200.0, 100.0, 0.5, 0.5),
                keep=scalar.radial_keep_probability(o, e(7) * e(7) * 9), sub=scalar.footprint_point_count("e8", 3), adaptive=scalar.adaptive_footprint("e9", 20.0, 6),
                clamped=scalar.density_clamp(F.lit(5.0), F.abs("e7"), F.abs("e8"), F.abs("e9"), F.col("z") + 2, 100.0),
                view=scalar.view_conditioned_keep(F.lit(8.0), 1 + F.col("x") * F.col("x"), o, 4.0, 0.5))


_DET = "((1 + x * x) * (1 + y * y) - 0.01)"


@query(_sql("wide", 7, at=f"{O} * exp(-0.5 * ((1 + y * y) * e7 * e7 - 0.2 * e7 * e8 + (1 + x * x) * e8 * e8) / {_DET})", cover=f"1 - pow(1 - {O}, 1 + abs(e9))",
            r=f"CASE WHEN {O} + 0.3 * (1 - {O}) > 0 THEN (abs(x) * {O} + 0.5 * 0.3 * (1 - {O})) / ({O} + 0.3 * (1 - {O})) ELSE 0 END", p=f"abs(y) + 0.25 * (1 - {O})", a=f"{O} + 0.3 * (1 - {O})"))
def coverage_functions(spark, sf):
    w, o = _wide(spark, sf), (F.col("nx") + 1) / 2 * 0.9
    x, y = F.col("x"), F.col("y")
    straight = scalar.over([F.abs(x)] * 3, o, [0.5] * 3, 0.3)
    pre = scalar.over([F.abs(y)] * 3, o, [0.25] * 3, 0.3, premultiplied=True)
    return _out(w, 7, at=scalar.alpha_at(o, "e7", "e8", 1 + x * x, 0.1, 1 + y * y), cover=scalar.expected_coverage(o, 1 + F.abs("e9")), r=straight[0], p=pre[1], a=straight[3])


_PACK = "CAST(floor(greatest(0.0, least(1.0, log2(greatest(0.0, {0}) + 1) / 16)) * {1} + 0.5) AS BIGINT)"
_BITS = [_PACK.format("e7 * 9", 2047), _PACK.format("e8 * 90", 2047), _PACK.format("e9 * 900", 1023)]


@query(f"{WIDE} SELECT id, {_BITS[0]} + {_BITS[1]} * 2048 + {_BITS[2]} * 4194304 AS packed, round(pow(2, {_BITS[0]} / 2047.0 * 16) - 1, 6) AS r, round(pow(2, {_BITS[1]} / 2047.0 * 16) - 1, 6) AS g, round(pow(2, {_BITS[2]} / 1023.0 * 16) - 1, 6) AS b FROM wide")
def hdr_pack(spark, sf):
    w = _wide(spark, sf).select("id", scalar.pack_hdr(F.col("e7") * 9, F.col("e8") * 90, F.col("e9") * 900).alias("packed"))
    return w.select("id", "packed", *[F.round(c, 6).alias(n) for n, c in zip("rgb", scalar.unpack_hdr("packed"), strict=True)])


_V = "greatest(0.0, e7 * 20)"


@query(_sql("wide", 7, none=f"pow({_V}, 1 / 2.2)", reinhard=f"pow({_V} / (1 + {_V}), 1 / 2.2)",
            aces=f"pow(greatest(0.0, least(1.0, {_V} * (2.51 * {_V} + 0.03) / ({_V} * (2.43 * {_V} + 0.59) + 0.14))), 1 / 2.2)"))
def tone_maps(spark, sf):
    return _out(_wide(spark, sf), 7, **{k: scalar.tonemap(F.col("e7") * 20, k) for k in ("none", "reinhard", "aces")})


def _hue(h: str, s: str, v: str, n: int) -> str:
    k = f"(({n} + {h} * 6) % 6)"
    return f"{v} - {v} * {s} * greatest(0.0, least({k}, 4 - {k}, 1.0))"


@query(_sql("wide", 7, **{c: _hue("abs(nx)", "abs(ny)", "abs(nz)", n) for c, n in zip("rgb", (5, 3, 1), strict=True)},
            **{f"c{c}": f"CASE WHEN id < 5 THEN 0.5 ELSE {_hue('(((id - 5) * CAST(0.61803398875 AS DOUBLE)) % 1.0)', '0.65', '0.95', n)} END" for c, n in zip("rgb", (5, 3, 1), strict=True)}))
def hues(spark, sf):
    e = embedding_cloud(spark, sf)
    one = scalar.hsv_to_rgb(F.abs("nx"), F.abs("ny"), F.abs("nz"))
    two = scalar.cluster_color(F.col("id") - 5)
    return _out(e, 7, **dict(zip("rgb", one, strict=True)), **{f"c{c}": v for c, v in zip("rgb", two, strict=True)})


@query(f"{WIDE}, d AS (SELECT id, CAST(x AS FLOAT) AS d FROM wide) SELECT id, dense_rank() OVER (ORDER BY d) AS place, CAST(d AS DOUBLE) AS depth FROM d")
def depth_keys(spark, sf):
    """Keys sort as depths do and give them back."""
    from pyspark.sql.window import Window

    @F.pandas_udf("struct<k: bigint, depth: double>")
    def key(d: pd.Series) -> pd.DataFrame:
        k = scalar.ordered_depth_key(d.to_numpy(np.float32))
        return pd.DataFrame({"k": k.astype(np.int64), "depth": scalar.depth_of_key(k).astype(float)})

    e = embedding_cloud(spark, sf).select("id", key("x").alias("k"))
    place = F.dense_rank().over(Window.orderBy("k.k")).cast("bigint")
    return e.select("id", place.alias("place"), F.col("k.depth").alias("depth"))


@query(f"{WIDE} SELECT id, printf('%016x', id * 1234567) AS hex FROM wide")
def hash_hex(spark, sf):
    return embedding_cloud(spark, sf).select("id", files.hash_to_hex(F.col("id") * 1234567).alias("hex"))


# ---- random numbers and generators

M64 = "18446744073709551616"


def _times(a: str, b: int) -> str:
    """a * b modulo 2^64 by halves, as the product doesn't fit an integer of 128 bits."""
    return f"((({a} % 4294967296) * {b} + ((({a} // 4294967296) * {b}) % 4294967296) * 4294967296) % {M64})"


def _stream(name: str, source: str, seed: int, index: str) -> str:
    """CTEs that add u_name, the uniform number of SplitMix64 at an index, to ``source``."""
    h = "CAST({} AS HUGEINT)"
    return (
        f"{name}0 AS (SELECT *, ({seed} + {_times(f'({h.format(index)} + 1)', 0x9E3779B97F4A7C15)}) % {M64} AS z FROM {source}), "
        f"{name}1 AS (SELECT * EXCLUDE z, {_times('xor(z, z // 1073741824)', 0xBF58476D1CE4E5B9)} AS z FROM {name}0), "
        f"{name}2 AS (SELECT * EXCLUDE z, {_times('xor(z, z // 134217728)', 0x94D049BB133111EB)} AS z FROM {name}1), "
        f"{name} AS (SELECT * EXCLUDE z, CAST(xor(z, z // 2147483648) // 2048 AS DOUBLE) / 9007199254740992.0 AS u_{name} FROM {name}2)"
    )


def _uniforms(n: int, seed: int, k: int) -> str:
    parts = [f"i AS (SELECT range AS id FROM range(0, {n}))"]
    source = "i"
    for j in range(k):
        parts.append(_stream(f"g{j}", source, seed + j, "id"))
        source = f"g{j}"
    return f"WITH {', '.join(parts)}, u AS (SELECT * FROM {source})"


_STATE = "((id * 747796405 + 2891336453) % 4294967296)"
_WORD = f"((xor({_STATE} >> CAST(({_STATE} >> 28) + 4 AS INT), {_STATE}) * 277803737) % 4294967296)"


@query(f"{_uniforms(5000, 42, 1)} SELECT id, xor({_WORD} >> 22, {_WORD}) AS pcg, u_g0 AS uniform FROM u")
def random_streams(spark, sf):
    def run(batches):
        for b in batches:
            i = b["id"].to_numpy(np.uint64)
            yield pd.DataFrame({"id": b["id"], "pcg": rng.pcg_hash(i.astype(np.uint32)).astype(np.int64), "uniform": rng.uniform(42, i)})

    return spark.range(5000).mapInPandas(run, "id bigint, pcg bigint, uniform double")


def _xyz(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select("id", *[(F.round(a, digits) + 0.0).alias(a) for a in "xyz"])


def _made(n: int, x: str, y: str, z: str, seed: int = 42) -> str:
    return _sql("u", 6, _uniforms(n, seed, 2), x=x, y=y, z=z)


_LAT = "(2 * u_g0 - 1)"
_RING = f"sqrt(1 - {_LAT} * {_LAT})"


@query(_made(1000, f"{_RING} * cos(2 * pi() * u_g1)", f"{_RING} * sin(2 * pi() * u_g1)", _LAT))
def generated_sphere(spark, sf):
    return _xyz(generators.sphere(spark, n=1000))


@query(_made(1000, "1 + 2 * cos(2 * pi() * u_g0)", "5 * (u_g1 - 0.5)", "2 * sin(2 * pi() * u_g0)"))
def generated_cylinder(spark, sf):
    return _xyz(generators.cylinder(spark, (1, 0, 0), 2.0, 5.0, 1000, axis="y"))


@query(_made(1000, "2 * sqrt(u_g0) * cos(2 * pi() * u_g1)", "3 * sqrt(u_g0) + 1", "2 * sqrt(u_g0) * sin(2 * pi() * u_g1)"))
def generated_cone(spark, sf):
    return _xyz(generators.cone(spark, (0, 1, 0), 2.0, 3.0, 1000))


@query(_made(1000, "2 * (u_g0 - 0.5)", "0.0", "3 * (u_g1 - 0.5)"))
def generated_rectangle(spark, sf):
    return _xyz(generators.rectangle(spark, (0, 0, 0), 2.0, 3.0, 1000))


@query(_made(1000, "(2 + 0.5 * cos(2 * pi() * u_g1)) * cos(2 * pi() * u_g0)", "(2 + 0.5 * cos(2 * pi() * u_g1)) * sin(2 * pi() * u_g0)", "0.5 * sin(2 * pi() * u_g1)"))
def generated_torus(spark, sf):
    return _xyz(generators.torus(spark, 2.0, 0.5, 1000))


@query("SELECT range AS id, round((range % 20) / 19.0 * 4 - 2, 6) + 0.0 AS x, 0.0 AS y, round((range // 20) / 29.0 * 6 - 3, 6) + 0.0 AS z FROM range(0, 600)")
def generated_grid(spark, sf):
    return _xyz(generators.grid_rectangle(spark, 4.0, 6.0, 20, 30))


@query(f"{WIDE} SELECT id, x, y, z, 0.25 AS r, 0.5 AS g, 0.75 AS b, 0.02 AS radius FROM wide")
def vertex_points(spark, sf):
    return generators.points_from_vertices(embedding_cloud(spark, sf), (0.25, 0.5, 0.75), 0.02)


TRIANGLES = "tri AS (SELECT a.id, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz FROM wide a JOIN wide b ON b.id = a.id + 1 JOIN wide c ON c.id = a.id + 2)"


def _triangles(spark, sf) -> DataFrame:
    e = embedding_cloud(spark, sf).select("id", "x", "y", "z")
    corner = lambda p, k: e.select((F.col("id") - k).alias("id"), *[F.col(a).alias(f"{p}{a}") for a in "xyz"])
    return corner("a", 0).join(corner("b", 1), "id").join(corner("c", 2), "id")


_AREA = "0.5 * sqrt(pow((by_ - ay) * (cz - az) - (bz - az) * (cy - ay), 2) + pow((bz - az) * (cx - ax) - (bx - ax) * (cz - az), 2) + pow((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax), 2))"


@query(f"{WIDE}, {TRIANGLES} SELECT round(sum({_AREA}), 6) AS area FROM tri")
def total_area(spark, sf):
    return agg.total_area(_triangles(spark, sf)).select(F.round("area", 6).alias("area"))


_SAMPLE = (
    f"{WIDE}, {TRIANGLES}, ar AS (SELECT *, {_AREA} AS area FROM tri), run AS (SELECT *, sum(area) OVER (ORDER BY id) AS upto, sum(area) OVER () AS total FROM ar), "
    "i AS (SELECT range AS k FROM range(0, 2000)), "
    + ", ".join(_stream(f"g{j}", "i" if not j else f"g{j - 1}", 42, f"k * 3 + {j}") for j in range(3))
    + ", hit AS (SELECT g2.*, (SELECT min(id) FROM run WHERE upto > u_g0 * total) AS id FROM g2)"
)


@query(f"{_SAMPLE} SELECT k AS id, " + ", ".join(
    f"round((1 - sqrt(u_g1)) * a{a} + sqrt(u_g1) * (1 - u_g2) * {'by_' if a == 'y' else 'b' + a} + sqrt(u_g1) * u_g2 * c{a}, 6) + 0.0 AS {a}" for a in "xyz") + " FROM hit JOIN run USING (id)")
def surface_samples(spark, sf):
    return _xyz(generators.surface_samples(_triangles(spark, sf), 2000))


# ---- files

ROUND = f"{WIDE} SELECT id, CAST(CAST(x AS FLOAT) AS DOUBLE) AS x, CAST(CAST(y AS FLOAT) AS DOUBLE) AS y, CAST(CAST(z AS FLOAT) AS DOUBLE) AS z"


def _file(spark, ext: str) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}/cloud.{ext}"


def _saved(spark, sf, ext: str, binary: bool = True) -> str:
    path = _file(spark, ext)
    files.save(embedding_cloud(spark, sf).drop("label"), path, binary)
    return path


@query(f"{ROUND}, CAST(CAST(nx AS FLOAT) AS DOUBLE) AS nx FROM wide")
def file_ply(spark, sf):
    return files.load(spark, _saved(spark, sf, "ply")).select("id", "x", "y", "z", "nx")


@query(_sql("wide", 6, x="CAST(CAST(x AS FLOAT) AS DOUBLE)", y="y", z="z", nx="CAST(CAST(nx AS FLOAT) AS DOUBLE)"))
def file_ply_ascii(spark, sf):
    return _out(files.load(spark, _saved(spark, sf, "ply", False)), 6, x=F.col("x"), y=F.col("y"), z=F.col("z"), nx=F.col("nx"))


@query(f"{WIDE} SELECT id, round(CAST(CAST(x AS FLOAT) AS DOUBLE), 5) + 0.0 AS x, 0.6 AS r, 0.8 AS g, 1.0 AS b FROM wide")
def file_ply_plain(spark, sf):
    """Without the file's own attributes: the default colour."""
    p = files.load(spark, _saved(spark, sf, "ply"), keep_attributes=False)
    d = dict(zip("rgb", files.DEFAULT_COLOR, strict=True))
    return p.select("id", (F.round("x", 5) + 0.0).alias("x"), *[F.when(F.col(c) == d[c], v).alias(c) for c, v in zip("rgb", (0.6, 0.8, 1.0), strict=True)])


@query(f"{ROUND} FROM wide")
def file_pcd(spark, sf):
    return files.load(spark, _saved(spark, sf, "pcd")).select("id", "x", "y", "z")


@query(_sql("wide", 6, x="x", y="y", z="z"))
def file_pcd_ascii(spark, sf):
    return _out(files.load(spark, _saved(spark, sf, "pcd", False)), 6, x=F.col("x"), y=F.col("y"), z=F.col("z"))


@query(_sql("wide", 6, x="x", y="y", z="z"))
def file_txt(spark, sf):
    return _out(files.load(spark, _saved(spark, sf, "txt")), 6, x=F.col("x"), y=F.col("y"), z=F.col("z"))


@query(_sql("wide", 6, x="x", y="y", z="z"))
def file_txt_strict(spark, sf):
    return _out(files.read_txt(spark, _saved(spark, sf, "txt"), strict=True), 6, x=F.col("x"), y=F.col("y"), z=F.col("z"))


@query(_sql("wide", 6, x="x", y="y", z="z"))
def file_txt_distributed(spark, sf):
    """The places within files differ, so the rows are compared by the cloud's nearest point."""
    path = _file(spark, "d")
    files.save_text_distributed(embedding_cloud(spark, sf).select("id", "x", "y", "z"), path)
    back = files.read_txt(spark, path).select(*[F.round(a, 6).alias(a) for a in "xyz"])
    own = embedding_cloud(spark, sf).select("id", *[F.round(a, 6).alias(a) for a in "xyz"])
    return own.join(back.distinct(), ["x", "y", "z"]).select("id", *[(F.col(a) + 0.0).alias(a) for a in "xyz"])


def _point_set(spark, sf) -> DataFrame:
    e = embedding_cloud(spark, sf)
    return e.select("id", "x", "y", "z", F.abs("nx").alias("r"), F.abs("ny").alias("g"), F.abs("nz").alias("b"), "nx", "ny", "nz", (F.abs("x") + 0.5).alias("radius"))


@query(f"{ROUND}, CAST(CAST(abs(nx) AS FLOAT) AS DOUBLE) AS r, CAST(CAST(nz AS FLOAT) AS DOUBLE) AS nz, CAST(CAST(abs(x) + 0.5 AS FLOAT) AS DOUBLE) AS radius FROM wide")
def file_point_set(spark, sf):
    path = _file(spark, "pset")
    files.save(_point_set(spark, sf), path)
    return files.load(spark, path).select("id", "x", "y", "z", "r", "nz", "radius")


@query(_sql("wide", 5, x="CAST(CAST(x AS FLOAT) AS DOUBLE)", radius="CAST(CAST(abs(x) + 0.5 AS FLOAT) AS DOUBLE)", nx="CAST(CAST(nx AS FLOAT) AS DOUBLE)"))
def file_point_set_ply(spark, sf):
    path = _file(spark, "ply")
    files.save_point_set(_point_set(spark, sf), path)
    return _out(files.load_point_set(spark, path), 5, x=F.col("x"), radius=F.col("radius"), nx=F.col("nx"))


@query(f"{ROUND}, round(greatest(0, least(255, round(e7 * 128 + 128))) / 128 - 1, 6) + 0.0 AS q0, "
       "round((floor(greatest(0.0, least(1.0, 0.5 + 0.28209479177387814 * e8)) * 255 + 0.5) / 255 - 0.5) / 0.28209479177387814, 6) + 0.0 AS dc FROM wide")  # fmt: skip
def file_splat(spark, sf):
    """32-byte records; an interchange file is written on the driver."""
    p = _wide(spark, sf).orderBy("id").toPandas()
    path = _file(spark, "splat")
    rot = p[["e7", "e9", "e10", "e11"]].to_numpy()
    write_bytes(path, [codec.splat_bytes(p[["x", "y", "z"]].to_numpy(), np.zeros((len(p), 3)), p[["e8"] * 3].to_numpy(), p["e12"].to_numpy(), rot)])
    s = files.load(spark, path)
    return s.select("id", "x", "y", "z", (F.round(F.col("rot")[0], 6) + 0.0).alias("q0"), (F.round(F.col("f_dc")[0], 6) + 0.0).alias("dc"))


_PP = "(id * 2654435761 % 4294967296)"


@query(f"{WIDE}, c AS (SELECT id AS ci, x AS lo, x + 1 + abs(y) AS hi FROM wide), p AS (SELECT id, {_PP} AS pp FROM wide) "
       "SELECT p.id, round(lo + (hi - lo) * ((pp >> 21) & 2047) / 2047.0, 6) + 0.0 AS x, round(lo + (hi - lo) * ((pp >> 11) & 1023) / 1023.0, 6) + 0.0 AS y, round(lo + (hi - lo) * (pp & 2047) / 2047.0, 6) + 0.0 AS z, "
       "round(CASE WHEN pp & 255 <= 0 THEN -40 WHEN pp & 255 >= 255 THEN 40 ELSE ln((pp & 255) / 255.0 / (1 - (pp & 255) / 255.0)) END, 6) + 0.0 AS opacity FROM p JOIN c ON c.ci = p.id // 256")  # fmt: skip
def splat_unpack(spark, sf):
    """Packed splats and their chunks, joined on id div 256."""
    e = embedding_cloud(spark, sf)
    pp = F.expr("(id * 2654435761) % 4294967296")
    packed = e.select("id", pp.alias("pp"), pp.alias("pr"), pp.alias("ps"), pp.alias("pc"))
    lo, hi = F.col("x"), F.col("x") + 1 + F.abs("y")
    chunks = e.select(F.col("id").alias("ci"), *[lo.alias(f"min_{a}") for a in "xyz"], *[hi.alias(f"max_{a}") for a in "xyz"])
    s = files.unpack_splats(packed, chunks)
    return _out(s, 6, x=F.col("x"), y=F.col("y"), z=F.col("z"), opacity=F.col("opacity"))


# ---- small operators

@query("SELECT o_orderkey AS id, o_custkey AS value, least(4294967295, coalesce(sum(o_custkey) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS \"offset\" FROM orders")
def exclusive_scan(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("value"))
    return agg.exclusive_scan(o, "value").select("id", "value", F.col("offset").cast("bigint").alias("offset"))


@query("SELECT count(*) AS generated, count(*) FILTER (WHERE l_tax > 0.02) AS active, count(*) FILTER (WHERE l_tax > 0.02 AND l_discount > 0.05) AS drawn FROM lineitem")
def frame_counters(spark, sf):
    t = spark.read.parquet(f"{sf}/lineitem.parquet")
    return agg.frame_stats(t.select((F.col("l_tax") > 0.02).alias("active"), (F.col("l_discount") > 0.05).alias("drawn")))


@query(f"{WIDE} SELECT count(*) * 24 AS bytes FROM wide")
def memory_bytes(spark, sf):
    return agg.memory_bytes(embedding_cloud(spark, sf).drop("label"))


@query(f"{WIDE} SELECT round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM wide")
def object_center(spark, sf):
    return agg.object_center(embedding_cloud(spark, sf)).select(*[F.round(a, 6).alias(a) for a in "xyz"])


@query(_sql("wide", 6, r="abs(x) / (SELECT max(abs(x)) FROM wide)"))
def gray_colors(spark, sf):
    e = embedding_cloud(spark, sf).withColumn("v", F.abs("x"))
    return _out(filters.gray_colors(e.select("id", "v"), "v"), 6, r=F.col("r"))


@query(f"{WIDE} SELECT id, x > 0 AS inside FROM wide")
def scene_split(spark, sf):
    yes, no = filters.split_scene(embedding_cloud(spark, sf).select("id", (F.col("x") > 0).alias("inlier")))
    return yes.withColumn("inside", F.lit(True)).unionByName(no.withColumn("inside", F.lit(False)))


@query(f"{WIDE} SELECT id, round((x - 1) * (x - 1) + (y - 2) * (y - 2) + (z - 3) * (z - 3), 6) AS d2, row_number() OVER (ORDER BY (x - 1) * (x - 1) + (y - 2) * (y - 2) + (z - 3) * (z - 3) DESC, id) - 1 AS place FROM wide")
def depth_sorted(spark, sf):
    """The places in the sorted rows, numbered as their partitions stand."""
    s = splat.depth_sorted(embedding_cloud(spark, sf).select("id", "x", "y", "z"), (1, 2, 3))
    placed = s.coalesce(1).withColumn("place", F.monotonically_increasing_id())  # one partition keeps the order, and numbers from 0
    return placed.select("id", F.round("d2", 6).alias("d2"), "place")


_DEG = {"x": 10.0, "y": 20.0, "z": 30.0}
_TRIG = ", ".join(f"cos(radians({v!r})) AS c{a}, sin(radians({v!r})) AS s{a}" for a, v in _DEG.items())
_TURN = {
    "x": "(cy_ * cz + sy_ * sx * sz) * {0} + (-cy_ * sz + sy_ * sx * cz) * {1} + sy_ * cx * {2}",
    "y": "cx * sz * {0} + cx * cz * {1} - sx * {2}",
    "z": "(-sy_ * cz + cy_ * sx * sz) * {0} + (sy_ * sz + cy_ * sx * cz) * {1} + cy_ * cx * {2}",
}


@query(f"{WIDE}, a AS (SELECT {_TRIG.replace(' AS cy', ' AS cy_').replace(' AS sy', ' AS sy_')}) SELECT id, "
       + ", ".join(f"round(CASE WHEN id % 7 = 0 THEN {_TURN[k].format('(x - 1)', '(y - 2)', '(z - 3)')} + {c} ELSE {k} END, 6) + 0.0 AS {k}" for k, c in zip("xyz", (1, 2, 3), strict=True))
       + ", " + ", ".join(f"round(CASE WHEN id % 7 = 0 THEN {_TURN[k].format('nx', 'ny', 'nz')} ELSE n{k} END, 6) + 0.0 AS n{k}" for k in "xyz") + " FROM wide, a")
def rotate_selected(spark, sf):
    e = embedding_cloud(spark, sf)
    m = selection.rotation_about((1.0, 2.0, 3.0), (10.0, 20.0, 30.0))
    t = selection.transform_selected(e, e.where("id % 7 = 0").select("id"), m)
    return _out(t, 6, **{c: F.col(c) for c in ("x", "y", "z", "nx", "ny", "nz")})


@query("WITH v AS (SELECT id % 3 AS mesh, id // 3 AS vid FROM (SELECT vec_id AS id FROM embeddings)), n AS (SELECT mesh, count(*) AS n FROM v GROUP BY mesh), "
       "s AS (SELECT mesh, coalesce(sum(n) OVER (ORDER BY mesh ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM n) "
       "SELECT v.mesh, vid + s AS a, vid + s + 1 AS b, vid + s + 2 AS c FROM v JOIN s USING (mesh)")  # fmt: skip
def concatenated_meshes(spark, sf):
    e = embedding_cloud(spark, sf)
    v = e.select((F.col("id") % 3).alias("mesh"), F.floor(F.col("id") / 3).alias("vid"), "x", "y", "z")
    f = v.select("mesh", F.col("vid").alias("a"), (F.col("vid") + 1).alias("b"), (F.col("vid") + 2).alias("c"))
    return selection.concatenate_meshes(v, f)[1]


@query(f"{WIDE}, p AS (SELECT a.id, a.nx AS ux, a.ny AS uy, a.nz AS uz, b.nx AS mx, b.ny AS my, b.nz AS mz, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2) + pow(b.z - a.z, 2)) AS d FROM wide a JOIN wide b ON b.id = a.id + 1), "
       "e AS (SELECT *, (uy * dz - uz * dy) / d AS cx, (uz * dx - ux * dz) / d AS cy, (ux * dy - uy * dx) / d AS cz FROM p), "
       "l AS (SELECT *, sqrt(cx * cx + cy * cy + cz * cz) AS l FROM e), v AS (SELECT *, cx / l AS vx, cy / l AS vy, cz / l AS vz FROM l) "
       "SELECT id, round(vx * mx + vy * my + vz * mz, 6) + 0.0 AS alpha, round((ux * dx + uy * dy + uz * dz) / d, 6) + 0.0 AS phi, "
       "round(atan2((uy * vz - uz * vy) * mx + (uz * vx - ux * vz) * my + (ux * vy - uy * vx) * mz, ux * mx + uy * my + uz * mz), 6) + 0.0 AS theta FROM v")  # fmt: skip
def pair_features(spark, sf):
    e = embedding_cloud(spark, sf)
    b = e.select((F.col("id") - 1).alias("id"), *[F.col(a).alias(f"q{a}") for a in "xyz"], *[F.col(f"n{a}").alias(f"m{a}") for a in "xyz"])
    j = e.join(b, "id")
    d = [F.col(f"q{a}") - F.col(a) for a in "xyz"]
    dist = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    f = features.pair_features([F.col(f"n{a}") for a in "xyz"], [F.col(f"m{a}") for a in "xyz"], d, dist)
    return _out(j, 6, alpha=f[0], phi=f[1], theta=f[2])


@query(_sql("wide", 6, huber="CASE WHEN abs(x) <= 0.1 THEN 1.0 ELSE 0.1 / abs(x) END", tukey="CASE WHEN abs(x) < 0.1 THEN pow(1 - pow(abs(x) / 0.1, 2), 2) ELSE 0.0 END", none="1.0"))
def robust_weights(spark, sf):
    e = embedding_cloud(spark, sf)
    d = F.abs("x")
    return _out(e, 6, **{k: registration.robust_weight(d, k, 0.1) for k in ("huber", "tukey", "none")})


_RAST = (
    f"{WIDE}, {TRIANGLES}, s AS (SELECT id, " + ", ".join(
        f"(2 * {p}x / ({p}z + 2) + 1) / 2 * 64 AS {p}u, (1 - 2 * {'by_' if p == 'b' else p + 'y'} / ({p}z + 2)) / 2 * 64 AS {p}v, {p}z + 2 AS {p}w" for p in "abc") + " FROM tri), "
    "t AS (SELECT *, (bu - au) * (cv - av) - (bv - av) * (cu - au) AS area FROM s), "
    "f AS (SELECT px, py, aw, bw, cw, ((bu - px - 0.5) * (cv - py - 0.5) - (bv - py - 0.5) * (cu - px - 0.5)) / area AS u, ((cu - px - 0.5) * (av - py - 0.5) - (cv - py - 0.5) * (au - px - 0.5)) / area AS v "
    "FROM t, range(0, 64) a(px), range(0, 64) b(py) WHERE area <> 0)"
)


@query(f"{_RAST} SELECT CAST(px AS INT) AS px, CAST(py AS INT) AS py, round(1 / max(u / aw + v / bw + (1 - u - v) / cw), 6) AS front FROM f WHERE u >= 0 AND v >= 0 AND u + v <= 1 GROUP BY px, py")
def triangle_depth(spark, sf):
    vp = ((2.0, 0.0, 0.0, 0.0), (0.0, 2.0, 0.0, 0.0), (0.0, 0.0, 1.0, 1.0), (0.0, 0.0, 1.0, 2.0))
    d = pick.triangle_depth(_triangles(spark, sf), vp, 64, 64)
    return d.select("px", "py", F.round("front", 6).alias("front"))


_X = lambda o, a, b: f"((x{a} - x{o}) * (y{b} - y{o}) - (y{a} - y{o}) * (x{b} - x{o}))"


@query(f"{WIDE}, q AS (SELECT a.id, {', '.join(f'{t}.x AS x{k}, {t}.y AS y{k}' for k, t in enumerate('abcd'))} FROM wide a JOIN wide b ON b.id = a.id + 1 JOIN wide c ON c.id = a.id + 2 JOIN wide d ON d.id = a.id + 3) "
       f"SELECT id, ({_X(0, 1, 2)} > 0) <> ({_X(0, 1, 3)} > 0) AND ({_X(2, 3, 0)} > 0) <> ({_X(2, 3, 1)} > 0) AS crosses, "
       f"(({_X(0, 1, 3)} >= 0) AND ({_X(1, 2, 3)} >= 0) AND ({_X(2, 0, 3)} >= 0)) OR (({_X(0, 1, 3)} <= 0) AND ({_X(1, 2, 3)} <= 0) AND ({_X(2, 0, 3)} <= 0)) AS inside FROM q")  # fmt: skip
def plane_geometry(spark, sf):
    """Whether segments cross, and points lie in polygons."""
    e = embedding_cloud(spark, sf)
    corner = lambda k: e.select((F.col("id") - k).alias("id"), F.array("x", "y").alias(f"p{k}"))
    q = corner(0).join(corner(1), "id").join(corner(2), "id").join(corner(3), "id")

    @F.pandas_udf("struct<crosses: boolean, inside: boolean>")
    def look(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        rows = [(surface.segments_cross(p, q, r, s), surface.point_in_polygon(s, np.array([p, q, r]))) for p, q, r, s in zip(a, b, c, d, strict=True)]
        return pd.DataFrame(rows, columns=["crosses", "inside"])

    return q.select("id", look("p0", "p1", "p2", "p3").alias("l")).select("id", "l.crosses", "l.inside")


@query(f"{WIDE}, t AS (SELECT max(x) AS x1, min(x) AS x0, max(y) AS y1, min(y) AS y0 FROM wide) "
       "SELECT i, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, 0.25 AS z FROM (SELECT 0 AS i, x0 AS x, y0 AS y FROM t UNION ALL SELECT 1, x0, y1 FROM t UNION ALL SELECT 2, x1, y1 FROM t UNION ALL SELECT 3, x1, y0 FROM t)")  # fmt: skip
def plane_overlay(spark, sf):
    """The corners in one order, as the turning sense is the plane's."""
    from pyspark.sql.window import Window

    p = agg.plane_polygon(embedding_cloud(spark, sf), (0.0, 0.0, 1.0, -0.25))
    x, y = F.round("x", 6) + 0.0, F.round("y", 6) + 0.0
    placed = p.select(x.alias("x"), y.alias("y"), F.round("z", 6).alias("z"))
    w = Window.partitionBy("z")
    i = F.when(F.col("x") == F.min("x").over(w), F.when(F.col("y") == F.min("y").over(w), 0).otherwise(1)).otherwise(F.when(F.col("y") == F.max("y").over(w), 2).otherwise(3))
    return placed.withColumn("i", i).select("i", "x", "y", "z")


@query(f"{WIDE}, a AS (SELECT id % 24 AS px, id // 24 AS py, abs(x) AS u, abs(y) AS v FROM wide WHERE id // 24 < 20), "
       "w AS (SELECT range AS k FROM range(0, 5)), "
       "m AS (SELECT w.k AS wx, q.k AS wy, avg(u) AS mu, avg(v) AS mv, var_samp(u) AS su, var_samp(v) AS sv, covar_samp(u, v) AS c FROM a, w, (SELECT range AS k FROM range(0, 4)) q WHERE px BETWEEN w.k * 4 AND w.k * 4 + 7 AND py BETWEEN q.k * 4 AND q.k * 4 + 7 GROUP BY 1, 2) "
       "SELECT round(avg((2 * mu * mv + 0.0001) * (2 * c + 0.0009) / ((mu * mu + mv * mv + 0.0001) * (su + sv + 0.0009))), 6) AS ssim FROM m")  # fmt: skip
def image_ssim(spark, sf):
    """Images of 24 x 20 pixels made of the cloud's first rows."""
    e = embedding_cloud(spark, sf).select((F.col("id") % 24).cast("int").alias("px"), F.floor(F.col("id") / 24).cast("int").alias("py"), F.abs("x").alias("u"), F.abs("y").alias("v")).where("py < 20")
    a, b = (e.select("px", "py", *[F.col(c).alias(k) for k in "rgb"]) for c in "uv")
    return splat.ssim(a, b, 24, 20).select(F.round("ssim", 6).alias("ssim"))


@query(f"{WIDE} SELECT id, id % 7 = 0 AS chosen FROM wide")
def selection_lookup(spark, sf):
    """Rows looked up by their numbers, and the rest."""
    e = embedding_cloud(spark, sf).select("id")
    sel = e.where("id % 7 = 0")
    return sel.withColumn("chosen", F.lit(True)).unionByName(selection.invert(e, sel).withColumn("chosen", F.lit(False)))


_SUMS = ", ".join(f"round(sum(m.{a} * emb.{b}), 5) AS h{a}{b}" for a in "xyz" for b in "xyz")


@query(f"WITH {EMB_SQL}, m AS (SELECT id, x * 0.9 + 0.01 AS x, y * 0.9 AS y, z * 0.9 - 0.01 AS z FROM emb), "
       "p AS (SELECT m.id, emb.id AS nid, row_number() OVER (PARTITION BY m.id ORDER BY (emb.x - m.x) * (emb.x - m.x) + (emb.y - m.y) * (emb.y - m.y) + (emb.z - m.z) * (emb.z - m.z), emb.id) AS k, "
       "(emb.x - m.x) * (emb.x - m.x) + (emb.y - m.y) * (emb.y - m.y) + (emb.z - m.z) * (emb.z - m.z) AS d2 FROM m, emb) "
       f"SELECT {_SUMS}, round(avg(d2), 8) AS fitness FROM p JOIN m USING (id) JOIN emb ON emb.id = p.nid WHERE k = 1")  # fmt: skip
def rigid_sums(spark, sf):
    """What one step of the closest-point fit gathers: nearest pairs and their sums."""
    e = embedding_cloud(spark, sf)
    moved = e.select("id", (F.col("x") * 0.9 + 0.01).alias("x"), (F.col("y") * 0.9).alias("y"), (F.col("z") * 0.9 - 0.01).alias("z"))
    s = registration.rigid_sums(registration.matches(moved, e, 0.0))
    return s.select(*[F.round(f"h{a}{b}", 5).alias(f"h{a}{b}") for a in "xyz" for b in "xyz"], F.round("fitness", 8).alias("fitness"))


_BYTE = "CAST(floor({} * 255 + 0.5) AS BIGINT)"


@query("WITH p AS (SELECT l_suppkey AS px, l_linenumber AS py, CAST(round(l_extendedprice / 1000) AS FLOAT) AS d, "
       f"{_BYTE.format('l_discount')} * 65536 + {_BYTE.format('l_tax')} * 256 + {_BYTE.format('l_quantity / 50.0')} AS k FROM lineitem) "
       "SELECT px, py, CAST(min(d) AS DOUBLE) AS depth, arg_min(k, d * 16777216.0::DOUBLE + k) AS packed FROM p GROUP BY px, py")  # fmt: skip
def scatter_nearest(spark, sf):
    """The nearest point of each pixel, at equal depth the least colour."""
    t = spark.read.parquet(f"{sf}/lineitem.parquet")
    p = t.select(F.col("l_suppkey").alias("px"), F.col("l_linenumber").alias("py"), F.round(F.col("l_extendedprice") / 1000).alias("depth"),
                 F.col("l_discount").alias("r"), F.col("l_tax").alias("g"), (F.col("l_quantity") / 50.0).alias("b"))
    return splat.scatter(p, "px", "py").select("px", "py", F.col("depth").cast("double").alias("depth"), "packed")


@query()
def splat_particles_3d(spark, sf):
    return splat.render_particles(_splats(spark, sf), VIEW, 60.0, 24, 24, radial=True, sets=4)


@query(f"{WIDE}, b AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM (SELECT round(x, 1) AS x, round(y, 1) AS y FROM wide)), "
       "c AS (SELECT x0 AS x, y0 AS y FROM b UNION SELECT x0, y1 FROM b UNION SELECT x1, y0 FROM b UNION SELECT x1, y1 FROM b) SELECT round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, 0.5 AS z FROM c")  # fmt: skip
def plane_hull(spark, sf):
    """The hull of the corners of the cloud's box, in a plane."""
    e = embedding_cloud(spark, sf).select(F.round("x", 1).alias("x"), F.round("y", 1).alias("y"), "z")
    b = e.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    c = b.select(F.inline(F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(0.0).alias("z")) for x in ("x0", "x1") for y in ("y0", "y1")])))
    return surface.plane_hull(c, (0.0, 0.0, 1.0, -0.5)).select((F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"), F.round("z", 6).alias("z"))
