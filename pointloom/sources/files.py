"""Readers and writers of point and splat files as DataFrames.

Binary files have rows of one width, so a Python data source cuts them into row
ranges that tasks read by themselves; text goes through Spark's own reader.
Bytes are fetched through Spark's file systems for the header and through the file store for
ranges. ``id`` is the row's place in the file, fixed at the source.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.aggregates import fnv1a64
from ..plans.filestore import read_bytes, read_range, remove_tree, write_bytes
from .codec import (
    HEADER_LIMIT, SPLAT_BYTES, ascii_rows, pcd_body, pcd_head, pcd_header, ply_body, ply_head, ply_header, point_set_columns, point_set_groups, point_set_head, splat_records,
    unpack_rgb, vertex_columns,
)

ROWS = 1 << 20
POINT = "id bigint, x double, y double, z double, r double, g double, b double, nx double, ny double, nz double, radius double"
SPLAT = "id bigint, x double, y double, z double, nx double, ny double, nz double, f_dc array<double>, opacity double, scale array<double>, rot array<double>, sh_degree int, sh_rest array<double>"
DEFAULT_COLOR = (0.6, 0.8, 1.0)


class Range(InputPartition):
    def __init__(self, start: int, count: int) -> None:
        self.start, self.count = start, count


def ranges(n: int, rows: int = ROWS) -> list[Range]:
    return [Range(i, min(rows, n - i)) for i in range(0, n, rows)] or [Range(0, 0)]


def _batches(columns: dict, start: int, n: int) -> Iterator:
    """Arrow batches of columns (arrays, rows of arrays, or None) with their ids."""
    import pyarrow as pa

    for at in range(0, n, 65_536):
        end = min(n, at + 65_536)
        out = {"id": pa.array(np.arange(start + at, start + end), pa.int64())}
        for name, c in columns.items():
            if c is None:
                out[name] = pa.nulls(end - at, pa.float64())
            elif c.ndim == 2:
                flat = pa.array(np.ascontiguousarray(c[at:end]).ravel(), pa.float64())
                out[name] = pa.ListArray.from_arrays(pa.array(np.arange(end - at + 1) * c.shape[1], pa.int32()), flat)
            else:
                out[name] = pa.array(c[at:end], pa.int32() if c.dtype.kind == "i" else pa.float64())
        yield pa.RecordBatch.from_pydict(out)


def _point_rows(cols: dict[str, np.ndarray], start: int) -> Iterator:
    names = ("x", "y", "z", "r", "g", "b", "nx", "ny", "nz", "radius")
    return _batches({c: np.asarray(cols[c], float) if c in cols else None for c in names}, start, len(cols["x"]))


def _splat_batches(p, normal, dc, o, s, q, degree, h, start: int) -> Iterator:
    cols = {a: p[:, k] for k, a in enumerate("xyz")} | {f"n{a}": normal[:, k] for k, a in enumerate("xyz")}
    return _batches(cols | {"f_dc": dc, "opacity": o, "scale": s, "rot": q, "sh_degree": degree, "sh_rest": h}, start, len(p))


def sh_degree(rest: int) -> int:
    """Of the number of f_rest properties."""
    return {0: 0, 9: 1, 24: 2, 45: 3}.get(rest, 0)


class _PlyReader(DataSourceReader):
    def __init__(self, path: str, splat: bool) -> None:
        self.path, self.splat = path, splat
        self.head = ply_header(read_range(path, 0, HEADER_LIMIT))

    def partitions(self):
        v = self.head.element("vertex")
        return [Range(0, v.count)] if self.head.format == "ascii" else ranges(v.count)

    def rows(self, part: Range) -> np.ndarray:
        v = self.head.element("vertex")
        if self.head.format == "ascii":
            lines = [x for x in read_bytes(self.path)[self.head.size :].decode("latin-1").splitlines() if x.strip() and not x.startswith("#")]
            skip = 0
            for e in self.head.elements:
                if e.name == "vertex":
                    break
                skip += e.count
            got = ascii_rows(lines[skip : skip + v.count], v.dtype("<"))
            if len(got) < v.count:
                raise ValueError(f"{self.path}: {len(got)} of {v.count} vertices")
            return got
        d = v.dtype(self.head.order)
        raw = read_range(self.path, self.head.offset("vertex") + part.start * d.itemsize, part.count * d.itemsize)
        if len(raw) < part.count * d.itemsize:
            raise ValueError(f"{self.path}: vertex data ends early")
        return np.frombuffer(raw, d)

    def read(self, part: Range):
        rows = self.rows(part)
        if self.splat:
            yield from splat_rows(rows, part.start)
        else:
            yield from _point_rows(vertex_columns(rows), part.start)


def splat_rows(r: np.ndarray, start: int) -> Iterator[tuple]:
    names = r.dtype.names
    need = ["x", "y", "z", "f_dc_0", "f_dc_1", "f_dc_2", "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3"]
    if missing := [n for n in need if n not in names]:
        raise ValueError(f"no property {missing[0]}")
    rest = sorted((n for n in names if n.startswith("f_rest_")), key=lambda n: int(n[7:]))
    take = lambda cols: np.stack([r[c].astype(float) for c in cols], 1) if cols else np.zeros((len(r), 0))
    normal = take(["nx", "ny", "nz"]) if all(f"n{a}" in names for a in "xyz") else np.zeros((len(r), 3))
    p, dc, s, q, h = take(["x", "y", "z"]), take(need[3:6]), take(need[7:10]), take(need[10:14]), take(rest)
    o, degree = r["opacity"].astype(float), sh_degree(len(rest))
    yield from _splat_batches(p, normal, dc, o, s, q, np.full(len(r), degree, np.int32), h, start)


class PlySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pointloom_ply"

    def schema(self) -> str:
        return SPLAT if self.options.get("kind") == "splat" else POINT

    def reader(self, schema):
        return _PlyReader(self.options["path"], self.options.get("kind") == "splat")


class _PcdReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.head = path, pcd_header(read_range(path, 0, HEADER_LIMIT))

    def partitions(self):
        return ranges(self.head.points) if self.head.data == "binary" else [Range(0, self.head.points)]

    def read(self, part: Range):
        h = self.head
        if h.data == "binary":
            raw = read_range(self.path, h.size + part.start * h.dtype.itemsize, part.count * h.dtype.itemsize)
            if len(raw) < part.count * h.dtype.itemsize:
                raise ValueError(f"{self.path}: point data ends early")
            rows = np.frombuffer(raw, h.dtype)
            cols = {a: rows[a].astype(float) for a in "xyz"}
            packed = rows["rgb"] if "rgb" in h.fields else None
        elif h.data == "ascii":
            good = []
            for line in read_bytes(self.path)[h.size :].decode("latin-1").splitlines():
                try:
                    v = [float(w) for w in line.split()]
                except ValueError:
                    continue
                if len(v) >= len(h.fields):
                    good.append(v)
            if len(good) < h.points:
                raise ValueError(f"{self.path}: {len(good)} of {h.points} points")
            table = np.array(good[: h.points], float).reshape(-1, max(len(h.fields), 3) if not good else len(good[0]))
            cols = {a: table[:, h.fields.index(a)] for a in "xyz"}
            packed = table[:, h.fields.index("rgb")].astype(np.float32) if "rgb" in h.fields else None
        else:
            raise ValueError(f"{self.path}: {h.data} data isn't supported")
        if packed is not None:
            cols |= dict(zip("rgb", unpack_rgb(packed), strict=True))
        yield from _point_rows(cols, part.start)


class PcdSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pointloom_pcd"

    def schema(self) -> str:
        return POINT

    def reader(self, schema):
        return _PcdReader(self.options["path"])


class _SplatReader(DataSourceReader):
    def __init__(self, path: str, size: int) -> None:
        if size % SPLAT_BYTES:
            raise ValueError(f"{path}: the size isn't a multiple of 32")
        self.path, self.n = path, size // SPLAT_BYTES

    def partitions(self):
        return ranges(self.n)

    def read(self, part: Range):
        d = splat_records(read_range(self.path, part.start * SPLAT_BYTES, part.count * SPLAT_BYTES))
        n = part.count
        yield from _splat_batches(d["p"], np.zeros((n, 3)), d["f_dc"], d["opacity"], d["scale"], d["rot"], np.zeros(n, np.int32), np.zeros((n, 0)), part.start)


class SplatSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pointloom_splat"

    def schema(self) -> str:
        return SPLAT

    def reader(self, schema):
        return _SplatReader(self.options["path"], int(self.options["bytes"]))


def register(spark: SparkSession) -> None:
    for s in (PlySource, PcdSource, SplatSource):
        spark.dataSource.register(s)


def _size(spark: SparkSession, path: str) -> int:
    return spark.read.format("binaryFile").load(path).select("length").first()["length"]


def read_txt(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """``x y z [r g b]`` lines. Loose: empty, # and unreadable lines are passed
    over; if any channel is above 1 all are divided by 255; without colours the
    default one. Strict: single spaces, lines of fewer than three parts passed over, a bad number fails
    and names its line. The line's place is its byte order within the file."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"))
    if strict:
        w = F.split("value", " ")
        rows = lines.where(F.size(w) >= 3).select("at", *[_strict(w[i], "value").alias(a) for i, a in enumerate("xyz")])
        return _dense(rows)
    w = F.split(F.trim("value"), r"\s+")
    num = [F.expr(f"try_cast(try_element_at(w, {i + 1}) AS DOUBLE)") for i in range(6)]
    rows = lines.where("trim(value) <> '' AND NOT startswith(ltrim(value), '#')").withColumn("w", w).select("at", *[n.alias(c) for n, c in zip(num, "xyzrgb", strict=True)])
    rows = rows.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    top = rows.agg((F.max(F.greatest("r", "g", "b")) > 1).alias("bytes"))
    k = F.when(F.col("bytes"), 255.0).otherwise(1.0)
    full = F.col("r").isNotNull() & F.col("g").isNotNull() & F.col("b").isNotNull()
    colored = rows.crossJoin(F.broadcast(top)).select("at", "x", "y", "z", *[F.when(full, F.col(c) / k).otherwise(d).alias(c) for c, d in zip("rgb", DEFAULT_COLOR, strict=True)])  # one row
    return _dense(colored)


def _strict(part: Column, line: str) -> Column:
    v = part.try_cast("double")
    return F.coalesce(v, F.raise_error(F.concat(F.lit("bad number in line: "), F.col(line))))


def _dense(rows: DataFrame) -> DataFrame:
    from ..operators.selection import renumber

    return renumber(rows.withColumnRenamed("at", "id"))


def load(spark: SparkSession, path: str, keep_attributes: bool = True) -> DataFrame:
    """By extension: .pcd, .ply, .txt, .splat, .pset. Without ``keep_attributes``
    a PLY's own colours and normals give way to the default colour."""
    register(spark)
    ext = os.path.splitext(path)[1].lower()
    if ext == ".ply":
        if is_splat_ply(path):
            return read_splats(spark, path)
        df = spark.read.format("pointloom_ply").option("path", path).load()
        if not keep_attributes:
            df = df.select("id", "x", "y", "z", *[F.lit(v).alias(c) for c, v in zip("rgb", DEFAULT_COLOR, strict=True)])
        return df
    if ext == ".pcd":
        return spark.read.format("pointloom_pcd").option("path", path).load()
    if ext == ".txt":
        return read_txt(spark, path)
    if ext == ".splat":
        return read_splats(spark, path)
    if ext == ".pset":
        cols = point_set_columns(read_bytes(path))
        return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(cols["x"])), **cols}))
    raise ValueError(f"unknown extension {ext!r}")


def is_splat_ply(path: str) -> bool:
    try:
        v = ply_header(read_range(path, 0, HEADER_LIMIT)).element("vertex")
    except ValueError:
        return False
    names = {n for n, _ in v.properties}
    return {"f_dc_0", "opacity", "scale_0", "rot_0"} <= names or "packed_position" in names


def read_splats(spark: SparkSession, path: str) -> DataFrame:
    """.splat, plain or compressed splat .ply."""
    register(spark)
    if path.lower().endswith(".splat"):
        return spark.read.format("pointloom_splat").option("path", path).option("bytes", str(_size(spark, path))).load()
    head = ply_header(read_range(path, 0, HEADER_LIMIT))
    if head.element("chunk") is None:
        return spark.read.format("pointloom_ply").option("path", path).option("kind", "splat").load()
    chunk, vertex = head.element("chunk"), head.element("vertex")
    raw = np.frombuffer(read_range(path, head.offset("chunk"), chunk.count * 4 * len(chunk.properties)), "<f4").reshape(chunk.count, -1)
    chunks = spark.createDataFrame(pd.DataFrame(raw.astype(float), columns=[n for n, _ in chunk.properties]).assign(ci=np.arange(chunk.count)))
    at = head.offset("vertex")

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for s in df["id"]:
                n = min(ROWS, vertex.count - int(s))
                v = np.frombuffer(read_range(path, at + 16 * int(s), 16 * n), "<u4").reshape(n, 4).astype(np.int64)
                yield pd.DataFrame(v, columns=["pp", "pr", "ps", "pc"]).assign(id=np.arange(int(s), int(s) + n))

    parts = spark.range(0, max(1, vertex.count), ROWS).mapInPandas(packed, "pp bigint, pr bigint, ps bigint, pc bigint, id bigint")
    return unpack_splats(parts, chunks)


def unpack_splats(packed: DataFrame, chunks: DataFrame) -> DataFrame:
    """Packed integers (id, pp, pr, ps, pc) and their chunks of 256 (ci, min_..,
    max_..) to splats, in built-in expressions and one join on id div 256."""
    j = packed.withColumn("ci", F.expr("id div 256")).join(chunks, "ci")
    have = set(chunks.columns)
    bits = lambda c, shift, n: (F.shiftright(c, shift).bitwiseAND(F.lit((1 << n) - 1)) / float((1 << n) - 1))

    def lerp(name: str, t: Column) -> Column:
        lo, hi = (F.col(f"{m}_{name}") if f"{m}_{name}" in have else F.lit(0.0) for m in ("min", "max"))
        return lo + (hi - lo) * t

    xyz = lambda c: (bits(c, 21, 11), bits(c, 11, 10), bits(c, 0, 11))
    part = [(bits("pr", s, 10) - 0.5) * float(np.sqrt(2)) for s in (20, 10, 0)]
    rest = F.sqrt(F.greatest(F.lit(0.0), 1 - part[0] * part[0] - part[1] * part[1] - part[2] * part[2]))
    which = F.shiftright("pr", 30).bitwiseAND(F.lit(3))
    rot = F.when(which == 0, F.array(rest, *part))
    for k in (1, 2, 3):
        q = list(part)
        q.insert(k, rest)
        rot = rot.when(which == k, F.array(*q))
    a = bits("pc", 0, 8)
    opacity = F.when(a <= 0, -40.0).when(a >= 1, 40.0).otherwise(F.log(a / (1 - a)))
    return j.select(
        "id", *[lerp(n, t).alias(n) for n, t in zip("xyz", xyz("pp"), strict=True)], *[F.lit(0.0).alias(f"n{n}") for n in "xyz"],
        F.array(*[lerp(n, bits("pc", s, 8)) for n, s in zip("rgb", (24, 16, 8), strict=True)]).alias("f_dc"), opacity.alias("opacity"),
        F.array(*[lerp(f"scale_{n}", t) for n, t in zip("xyz", xyz("ps"), strict=True)]).alias("scale"), rot.alias("rot"),
        F.lit(0).alias("sh_degree"), F.array().cast("array<double>").alias("sh_rest"),
    )


def _txt_body(cols: dict[str, np.ndarray], binary: bool = False) -> bytes:
    names = [c for c in "xyzrgb" if c in cols]
    return "".join(" ".join(f"{v:.6f}" for v in r) + "\n" for r in zip(*[cols[c].tolist() for c in names], strict=True)).encode()


def save(df: DataFrame, path: str, binary: bool = True) -> None:
    """One interchange file by extension (.ply, .pcd, .txt, .pset), rows in id order.
    Columns with a null are left out. Tasks encode ranges of ids and write them beside
    the file; the driver then strings the pieces together, one at a time."""
    ext = os.path.splitext(path)[1].lower()
    if ext not in (".ply", ".pcd", ".txt", ".pset"):
        raise ValueError(f"unknown extension {ext!r}")
    known = [c for c in ("x", "y", "z", "r", "g", "b", "nx", "ny", "nz", "radius") if c in df.columns]
    seen = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in known]).first()
    n, names = seen["n"], [c for c in known if seen[c] == seen["n"]]
    groups = point_set_groups(names) if ext == ".pset" else [tuple(names)]
    body = {".ply": ply_body, ".pcd": pcd_body, ".txt": _txt_body}.get(ext)
    out = f"{path}.{uuid.uuid4().hex}.parts"

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for seq, b in enumerate(batches):
            cols = {c: b[c].to_numpy(float) for c in names}
            for k, g in enumerate(groups):
                data = np.stack([cols[c] for c in g], 1).astype("<f4").tobytes() if body is None else body(cols, binary)
                write_bytes(f"{out}/{k}-{part:06d}-{seq:06d}", [data])
                yield pd.DataFrame([(k, part, seq)], columns=["k", "part", "seq"])

    ranged = df.select("id", *names).repartitionByRange("id").sortWithinPartitions("id")
    pieces = sorted(map(tuple, ranged.mapInPandas(encode, "k int, part int, seq int").collect()))  # a row for each piece of some thousands of points
    each = lambda: (read_bytes(f"{out}/{k}-{p:06d}-{s:06d}") for k, p, s in pieces)
    if ext == ".pset":
        h = fnv1a64(b"")
        for piece in each():
            h = fnv1a64(piece, h)
        head = point_set_head(names, n, h)
    else:
        head = ply_head(names, n, binary) if ext == ".ply" else pcd_head(n, binary) if ext == ".pcd" else b""
    write_bytes(path, chain([head], each()))
    remove_tree(out)


def save_text_distributed(df: DataFrame, path: str) -> None:
    """``x y z [r g b]`` lines in id order, many files, no driver."""
    names = [c for c in "xyzrgb" if c in df.columns]
    df.orderBy("id").select(F.format_string(" ".join(["%.6f"] * len(names)), *names).alias("value")).write.text(path)


def hash_to_hex(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def load_point_set(spark: SparkSession, path: str) -> DataFrame:
    """A PLY as a point set: colours from sRGB to linear (default where there are none),
    radius from the bounds where there is none; raises if a rule is broken."""
    from ..functions.scalar import srgb_to_linear
    from ..operators.aggregates import default_radius, validate

    df = load(spark, path)
    radius = default_radius(df).withColumnRenamed("radius", "__r")
    df = df.crossJoin(F.broadcast(radius)).withColumn("radius", F.coalesce("radius", "__r")).drop("__r")  # one row
    df = df.withColumns({c: srgb_to_linear(F.coalesce(c, F.lit(v))) for c, v in zip("rgb", DEFAULT_COLOR, strict=True)})
    if not df.where("nx IS NULL").isEmpty():
        df = df.drop("nx", "ny", "nz")
    broken = validate(df).first()
    if broken:
        raise ValueError(f"{path}: point {broken['id']}: {broken['message']}")
    return df


def save_point_set(df: DataFrame, path: str) -> None:
    """A point set as PLY, colours from linear to sRGB."""
    from ..functions.scalar import linear_to_srgb

    save(df.withColumns({c: linear_to_srgb(c) for c in "rgb"}), path)
