"""Headers and record layouts of point files, in numpy."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

#: Scalar type names of PLY headers.
PLY_TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
HEADER_LIMIT = 1 << 20


@dataclass
class Element:
    name: str
    count: int
    properties: list[tuple[str, str]] = field(default_factory=list)
    has_list: bool = False

    def dtype(self, order: str) -> np.dtype:
        return np.dtype([(n, t if t[1] == "1" else order + t) for n, t in self.properties])


@dataclass
class PlyHeader:
    format: str
    elements: list[Element]
    size: int

    def element(self, name: str) -> Element | None:
        return next((e for e in self.elements if e.name == name), None)

    @property
    def order(self) -> str:
        return ">" if "big" in self.format else "<"

    def offset(self, name: str) -> int:
        """Bytes from the file's start to a binary element's first row."""
        at = self.size
        for e in self.elements:
            if e.name == name:
                return at
            if e.has_list:
                raise ValueError(f"a list before {name} in a binary file")
            at += e.count * e.dtype(self.order).itemsize
        raise ValueError(f"no element {name}")


def ply_header(head: bytes) -> PlyHeader:
    end = head.find(b"end_header")
    if not head.startswith(b"ply") or end < 0:
        raise ValueError("not a PLY file")
    size = head.index(b"\n", end) + 1
    kind, elements = "", []
    for line in head[:size].decode("latin-1").splitlines()[1:]:
        w = line.split()
        if not w or w[0] in ("comment", "obj_info", "end_header"):
            continue
        if w[0] == "format":
            kind = w[1]
        elif w[0] == "element":
            elements.append(Element(w[1], int(w[2])))
        elif w[0] == "property":
            if w[1] == "list":
                elements[-1].has_list = True
            elif w[1] not in PLY_TYPES:
                raise ValueError(f"unknown PLY type {w[1]}")
            else:
                elements[-1].properties.append((w[2], PLY_TYPES[w[1]]))
        else:
            raise ValueError(f"unknown PLY header line {line!r}")
    v = next((e for e in elements if e.name == "vertex"), None)
    if kind not in ("ascii", "binary_little_endian", "binary_big_endian") or v is None:
        raise ValueError("no format or no vertex element")
    if v.has_list:
        raise ValueError("a list in the vertex element")
    return PlyHeader(kind, elements, size)


def vertex_columns(rows: np.ndarray) -> dict[str, np.ndarray]:
    """x, y, z and what there is of r, g, b (integers scaled by their type's
    largest), nx, ny, nz, radius, as doubles."""
    names = rows.dtype.names
    for a in "xyz":
        if a not in names:
            raise ValueError(f"no property {a}")
    out = {a: rows[a].astype(float) for a in "xyz"}
    for source in (("red", "green", "blue"), ("r", "g", "b")):
        if all(c in names for c in source):
            for c, s in zip("rgb", source, strict=True):
                v = rows[s]
                out[c] = v.astype(float) / np.iinfo(v.dtype).max if v.dtype.kind in "iu" else v.astype(float)
            break
    if all(f"n{a}" in names for a in "xyz"):
        out |= {f"n{a}": rows[f"n{a}"].astype(float) for a in "xyz"}
    if "radius" in names:
        out["radius"] = rows["radius"].astype(float)
    return out


def ascii_rows(lines: list[str], dtype: np.dtype) -> np.ndarray:
    lines = [x for x in lines if x.strip() and not x.lstrip().startswith("#")]
    out = np.zeros(len(lines), dtype)
    for i, x in enumerate(lines):
        w = x.split()
        if len(w) < len(dtype.names):
            raise ValueError(f"too few values in {x!r}")
        out[i] = tuple(float(v) if dtype[k].kind == "f" else int(v) for k, v in enumerate(w[: len(dtype.names)]))
    return out


def _ply_fields(names) -> list[tuple[str, str, str]]:
    """(column, property, type) of the columns there are."""
    fields = [(c, c, "f4") for c in ("x", "y", "z", "nx", "ny", "nz", "radius") if c in names]
    return fields + ([(c, n, "u1") for c, n in zip("rgb", ("red", "green", "blue"), strict=True)] if "r" in names else [])


def ply_head(names, n: int, binary: bool = True) -> bytes:
    head = ["ply", f"format {'binary_little_endian' if binary else 'ascii'} 1.0", f"element vertex {n}"]
    head += [f"property {'uchar' if t == 'u1' else 'float'} {a}" for _, a, t in _ply_fields(names)] + ["end_header", ""]
    return "\n".join(head).encode()


def ply_body(cols: dict[str, np.ndarray], binary: bool = True) -> bytes:
    """x, y, z and what there is of normals, radius and r, g, b (0-1, written as
    rounded bytes; NaN as 0)."""
    fields = _ply_fields(cols)
    rows = np.zeros(len(cols["x"]), np.dtype([(a, "<" + t if t != "u1" else t) for _, a, t in fields]))
    for c, a, t in fields:
        rows[a] = cols[c] if t != "u1" else np.floor(np.clip(np.nan_to_num(cols[c]), 0, 1) * 255 + 0.5)
    if binary:
        return rows.tobytes()
    return "".join(" ".join(str(v) if isinstance(v, int) else f"{v:.6f}" for v in r) + "\n" for r in rows.tolist()).encode()


def ply_bytes(cols: dict[str, np.ndarray], binary: bool = True) -> bytes:
    return ply_head(cols, len(cols["x"]), binary) + ply_body(cols, binary)


@dataclass
class PcdHeader:
    fields: list[str]
    dtype: np.dtype
    points: int
    data: str
    size: int


def pcd_header(head: bytes) -> PcdHeader:
    got: dict[str, list[str]] = {}
    at = 0
    while "DATA" not in got:
        end = head.find(b"\n", at)
        if end < 0:
            raise ValueError("not a PCD file")
        w = head[at:end].decode("latin-1").split()
        at = end + 1
        if w and not w[0].startswith("#"):
            got[w[0].upper()] = w[1:]
    names = got.get("FIELDS") or got.get("COLUMNS") or []
    if not all(a in names for a in "xyz"):
        raise ValueError("no x, y, z fields")
    sizes, kinds = got.get("SIZE", ["4"] * len(names)), got.get("TYPE", ["F"] * len(names))
    counts = got.get("COUNT", ["1"] * len(names))
    code = {"F": "f", "I": "i", "U": "u"}
    parts = [(n, f"<{code[k.upper()]}{s}", (int(c),)) if c != "1" else (n, f"<{code[k.upper()]}{s}") for n, s, k, c in zip(names, sizes, kinds, counts, strict=True)]
    points = int((got.get("POINTS") or [str(int(got.get("WIDTH", ["0"])[0]) * int(got.get("HEIGHT", ["1"])[0]))])[0])
    return PcdHeader(names, np.dtype(parts), points, got["DATA"][0].lower(), at)


def unpack_rgb(packed: np.ndarray) -> list[np.ndarray]:
    """The colour whose bits are a float's or integer's."""
    bits = packed.astype(np.float32).view(np.uint32) if packed.dtype.kind == "f" else packed.astype(np.uint32)
    return [(bits >> np.uint32(s) & np.uint32(255)).astype(float) / 255 for s in (16, 8, 0)]


def pcd_head(n: int, binary: bool = True) -> bytes:
    return f"# .PCD v0.7 - Point Cloud Data file format\nVERSION 0.7\nFIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nWIDTH {n}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {n}\nDATA {'binary' if binary else 'ascii'}\n".encode()


def pcd_body(cols: dict[str, np.ndarray], binary: bool = True) -> bytes:
    p = np.stack([cols[a] for a in "xyz"], 1)
    return p.astype("<f4").tobytes() if binary else "".join("%.6f %.6f %.6f\n" % tuple(r) for r in p.tolist()).encode()


def pcd_bytes(cols: dict[str, np.ndarray], binary: bool = True) -> bytes:
    return pcd_head(len(cols["x"]), binary) + pcd_body(cols, binary)


SPLAT_BYTES = 32


def splat_records(data: bytes) -> dict[str, np.ndarray]:
    """32-byte records: position and scale as floats, colour and alpha as bytes, the
    quaternion as bytes about 128."""
    if len(data) % SPLAT_BYTES:
        raise ValueError("the size isn't a multiple of 32")
    r = np.frombuffer(data, np.dtype([("p", "<f4", 3), ("s", "<f4", 3), ("c", "u1", 4), ("q", "u1", 4)]))
    a = r["c"][:, 3] / 255.0
    with np.errstate(divide="ignore"):
        opacity = np.where(a <= 0, -40.0, np.where(a >= 1, 40.0, np.log(np.maximum(a, 1e-300) / np.maximum(1 - a, 1e-300))))
    return {"p": r["p"].astype(float), "scale": np.log(np.maximum(r["s"].astype(float), 1e-6)), "f_dc": (r["c"][:, :3] / 255.0 - 0.5) / 0.28209479177387814,
            "opacity": opacity, "rot": (r["q"].astype(float) - 128) / 128}


def splat_bytes(p, scale, f_dc, opacity, rot) -> bytes:
    """The reverse of ``splat_records``."""
    n = len(p)
    r = np.zeros(n, np.dtype([("p", "<f4", 3), ("s", "<f4", 3), ("c", "u1", 4), ("q", "u1", 4)]))
    r["p"], r["s"] = p, np.exp(scale)
    rgb = np.clip(0.5 + 0.28209479177387814 * np.asarray(f_dc), 0, 1)
    r["c"] = np.floor(np.c_[rgb, 1 / (1 + np.exp(-np.asarray(opacity)))] * 255 + 0.5)
    r["q"] = np.clip(np.round(np.asarray(rot) * 128 + 128), 0, 255)
    return r.tobytes()


POINT_SET_MAGIC = b"PSET"


def point_set_groups(names) -> list[tuple[str, ...]]:
    """The columns of the body's stretches, in their order."""
    return [("x", "y", "z"), ("r", "g", "b"), ("radius",)] + ([("nx", "ny", "nz")] if "nx" in names else [])


def point_set_head(names, n: int, body_hash: int) -> bytes:
    """Magic, version, flags, count, hash of the body (FNV-1a)."""
    return struct.pack("<4sIIIQQ", POINT_SET_MAGIC, 1, int("nx" in names), 0, n, body_hash)


def point_set_bytes(cols: dict[str, np.ndarray]) -> bytes:
    """The head; then positions, colours, radii, and normals if there are any, as floats."""
    from ..operators.aggregates import fnv1a64

    body = b"".join(np.stack([cols[c] for c in g], 1).astype("<f4").tobytes() for g in point_set_groups(cols))
    return point_set_head(cols, len(cols["x"]), fnv1a64(body)) + body


def point_set_columns(data: bytes) -> dict[str, np.ndarray]:
    from ..operators.aggregates import fnv1a64

    magic, version, has, _, n, h = struct.unpack_from("<4sIIIQQ", data)
    width = 4 * (10 if has else 7)
    if magic != POINT_SET_MAGIC or version != 1 or len(data) != 32 + n * width:
        raise ValueError("not a point set file of this version and size")
    if fnv1a64(data[32:]) != h:
        raise ValueError("the body has another hash than the header")
    out, at = {}, 32
    for g in [("x", "y", "z"), ("r", "g", "b"), ("radius",)] + ([("nx", "ny", "nz")] if has else []):
        v = np.frombuffer(data, "<f4", n * len(g), at).reshape(n, len(g)).astype(float)
        at += v.size * 4
        out |= {c: v[:, i] for i, c in enumerate(g)}
    return out


def pfm_bytes(rgb: np.ndarray) -> bytes:
    """A linear float image, bottom row first."""
    h, w, _ = rgb.shape
    return f"PF\n{w} {h}\n-1.0\n".encode() + rgb[::-1].astype("<f4").tobytes()
