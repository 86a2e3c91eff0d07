"""Scenes, and the text commands that make and change them.

A command parses to an operator on a lazy DataFrame; work happens when a count or
metric is asked for. Answers: ``OK``, ``Id:n``, ``Count:n``, ``Yes``/``No``, a value, or
``Error:message``.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files, generators
from . import aggregates, cluster, features, filters, fitting, registration, surface


@dataclass
class Scene:
    id: int
    name: str
    df: DataFrame
    visible: bool = True

    @property
    def has_normals(self) -> bool:
        return "nx" in self.df.columns


@dataclass
class World:
    """Named clouds with ids that only rise; each is also a temporary view."""

    spark: SparkSession
    scenes: dict[int, Scene] = field(default_factory=dict)
    metrics: dict[str, str] = field(default_factory=dict)
    next_id: int = 1
    active: int | None = None

    def add(self, name: str, df: DataFrame) -> int:
        i, self.next_id = self.next_id, self.next_id + 1
        self.scenes[i] = Scene(i, name, df)
        df.createOrReplaceTempView(f"scene_{i}")
        return i

    def find(self, i: int) -> Scene:
        if i not in self.scenes:
            raise ValueError(f"no scene {i}")
        return self.scenes[i]

    def remove(self, i: int) -> None:
        self.find(i)
        del self.scenes[i]
        self.spark.catalog.dropTempView(f"scene_{i}")

    def clear(self) -> None:
        for i in list(self.scenes):
            self.remove(i)

    def export(self) -> DataFrame | None:
        return filters.visible_union([(s.df, s.visible) for s in self.scenes.values()])

    def table(self) -> DataFrame:
        rows = [(s.id, s.name, s.visible, f"scene_{s.id}", s.has_normals) for s in self.scenes.values()]
        return self.spark.createDataFrame(rows, "scene_id int, name string, visible boolean, view_name string, has_normals boolean")


log = logging.getLogger(__name__)


def strict_numbers(arg: str, count: int) -> list[float]:
    """Exactly ``count`` comma-separated numbers; anything else is refused."""
    parts = arg.split(",")
    if len(parts) != count:
        raise ValueError(f"{count} numbers wanted, {len(parts)} given")
    return [float(p) for p in parts]


def numbers(arg: str, *defaults: float) -> list[float]:
    """Comma-separated numbers; what is missing or unreadable takes its default."""
    parts, out = arg.split(",") if arg else [], []
    for i, d in enumerate(defaults):
        try:
            out.append(float(parts[i]))
        except (IndexError, ValueError):
            out.append(d)
    return out


class Dispatcher:
    """``name:arg`` to an answer. The first argument of an operator is a scene's id."""

    def __init__(self, world: World) -> None:
        self.w = world
        c: dict[str, Callable[[str], str]] = {
            "Clear": self._clear, "GetSceneCount": lambda a: f"Count:{len(self.w.scenes)}", "GetLastSceneId": lambda a: f"Id:{self.w.next_id - 1}",
            "GetScenePointCount": lambda a: f"Count:{self._scene(a).df.count()}", "GetSceneHasNormals": lambda a: "Yes" if self._scene(a).has_normals else "No",
            "GetSceneNormalCount": lambda a: f"Count:{self._scene(a).df.count() if self._scene(a).has_normals else 0}",
            "GetLastMetric": self._metric, "SetActiveScene": self._activate, "LoadPly": lambda a: self._new("load", files.load(self.w.spark, a)),
            "GenerateSphere": lambda a: self._gen(generators.sphere, a, ("radius", 1.0), ("n", 1000)),
            "GenerateCylinder": lambda a: self._gen(lambda s, **k: generators.cylinder(s, axis="y", **k), a, ("radius", 1.0), ("height", 2.0), ("n", 1000)),
            "GenerateCone": lambda a: self._gen(generators.cone, a, ("radius", 1.0), ("height", 2.0), ("n", 1000)),
            "GenerateRect": lambda a: self._gen(generators.grid_rectangle, a, ("width", 1.0), ("depth", 1.0), ("u", 10), ("v", 10)),
            "GenerateGroundScene": lambda a: self._gen(generators.ground_scene, a, ("n", 2000), ("size", 20.0)),
            "DuplicateSceneTransformed": self._duplicate,
            "DownSample": lambda a: self._op("downsample", a, (0.1,), lambda d, v: aggregates.voxel_downsample(d, v).select(F.col("first_id").alias("id"), "x", "y", "z")),
            "FilterDensity": lambda a: self._split("density", a, (0.1,), lambda d, r: filters.density_filter(d, r)),
            "FilterCurvature": lambda a: self._op("curvature", a, (0.1, 0.1), lambda d, r, t: filters.curvature_filter(d, r, t)),
            "EstimateNormals": lambda a: self._op("normals", a, (0.1,), lambda d, r: d.drop("nx", "ny", "nz").join(features.normals(d, radius=r), "id")),
            "OrientNormals": lambda a: self._op("oriented", a, (0, 0, 10), lambda d, x, y, z: features.orient_normals(d, (x, y, z))),
            "EstimatePrincipalCurvature": lambda a: self._op("principal", a, (0.1,), self._principal),
            "EstimateFPFH": lambda a: self._op("fpfh", a, (10,), lambda d, k: d.join(features.fpfh(d, int(k)), "id")),
            "DetectBoundary": lambda a: self._op("boundary", a, (0.1, features.MAX_GAP), lambda d, r, g: d.join(features.boundary(d, radius=r, max_gap=g), "id")),
            "ClusterDbscan": lambda a: self._op("dbscan", a, (0.1, 5), lambda d, e, m: self._clusters(d, cluster.dbscan(d, e, int(m)))),
            "ClusterRegionGrowing": lambda a: self._op("clusters", a, (0.1,), lambda d, r: self._clusters(d, cluster.distance_clusters(d, r))),
            "SegmentRegionGrowing": lambda a: self._op("regions", a, (30, 5, 1.0, 10), self._regions),
            "ExtractGround": lambda a: self._split("ground", a, (1.0,), lambda d, c: d.join(cluster.ground(d, c), "id").withColumnRenamed("ground", "inlier")),
            "MLSSmooth": lambda a: self._op("smooth", a, (0.1,), lambda d, r: features.mls_smooth(d, radius=r)),
            "MLSUpsample": lambda a: self._op("upsampled", a, (0.1, 0.05, 0.025), lambda d, r, u, s: features.mls_upsample(d, radius=r, up_radius=u, step=s), hide=False),
            "ConvexHull2D": lambda a: self._op("hull", a, (), surface.convex_hull_2d, hide=False),
            "ConcaveHull2D": lambda a: self._op("outline", a, (3,), lambda d, k: surface.concave_hull_2d(d, int(k)), hide=False),
            "ICPAlign": lambda a: self._align(a, lambda s, t, n: registration.icp(s, t, int(n))),
            "ICPAlignPointToPlane": lambda a: self._align(a, lambda s, t, n: registration.icp_point_to_plane(s, t, int(n))),
            "GlobalRegister": lambda a: self._align(a, self._global),
        }
        for kind in fitting.KINDS:
            c[f"Ransac{kind.capitalize()}"] = lambda a, k=kind: self._ransac(k, a)
        self.commands = c | {"CheckCommandCatalog": lambda a: self._catalog()}

    def run(self, line: str) -> str:
        name, _, arg = line.strip().partition(":")
        try:
            if name not in self.commands:
                return f"Error:unknown command {name}"
            return self.commands[name](arg)
        except Exception as e:
            log.warning("command %s failed", name, exc_info=True)
            return f"Error:{str(e).splitlines()[0] if str(e) else type(e).__name__}"

    def _catalog(self) -> str:
        """OK if every command can be called by its name and no two differ by case alone."""
        low = [n.lower() for n in self.commands]
        bad = [n for n, f in self.commands.items() if not callable(f) or not n.isidentifier() or low.count(n.lower()) > 1]
        return f"Error:{','.join(bad)}" if bad else "OK"

    def _scene(self, arg: str) -> Scene:
        part = arg.split(",")[0].strip()
        return self.w.find(int(float(part)) if part else self.w.active if self.w.active is not None else self.w.next_id - 1)

    def _new(self, name: str, df: DataFrame) -> str:
        return f"Id:{self.w.add(name, df)}"

    def _clear(self, arg: str) -> str:
        self.w.clear()
        return "OK"

    def _activate(self, arg: str) -> str:
        self.w.active = self._scene(arg).id
        return "OK"

    def _metric(self, arg: str) -> str:
        return self.w.metrics.get(arg, f"Error:no metric {arg}")

    def _gen(self, f, arg: str, *params) -> str:
        values = numbers(arg, *[d for _, d in params])
        return self._new("generated", f(self.w.spark, **{n: type(d)(v) for (n, d), v in zip(params, values, strict=True)}))

    def _rest(self, arg: str, defaults) -> list[float]:
        return numbers(arg.partition(",")[2], *defaults)

    def _op(self, name: str, arg: str, defaults, f, hide: bool = True) -> str:
        s = self._scene(arg)
        out = self._new(name, f(s.df, *self._rest(arg, defaults)))
        s.visible = s.visible and not hide
        return out

    def _split(self, name: str, arg: str, defaults, f) -> str:
        s = self._scene(arg)
        a, b = filters.split_scene(f(s.df, *self._rest(arg, defaults)))
        out = self._new(name, a)
        self.w.add(f"{name} rest", b)
        s.visible = False
        return out

    def _clusters(self, df: DataFrame, labels: DataFrame) -> DataFrame:
        n = labels.where("cluster_id > 0").select("cluster_id").distinct().count()
        self.w.metrics["clusterCount"] = str(n)
        return df.join(labels, "id")

    def _regions(self, df: DataFrame, k, degrees, curvature, least) -> DataFrame:
        if "nx" not in df.columns:
            df = df.join(features.normals(df, k=10), "id")
        r = cluster.region_growing(df.join(features.curvature(df, k=10), "id"), int(k), math.radians(degrees), curvature, int(least))
        self.w.metrics["regionCount"] = str(r.where("region >= 0").select("region").distinct().count())
        return df.join(r, "id")

    def _principal(self, df: DataFrame, r: float) -> DataFrame:
        p = features.principal_curvatures(df, radius=r)
        m = features.principal_summary(p).first()
        self.w.metrics |= {"meanK1": str(m["mean_k1"]), "meanK2": str(m["mean_k2"])}
        return df.join(p, "id")

    def _ransac(self, kind: str, arg: str) -> str:
        s = self._scene(arg)
        it, thr, least = self._rest(arg, (200, 0.05, 50))
        m, df = fitting.ransac(s.df, kind, int(it), thr, int(least))
        if m is None:
            return f"Error:no {kind} found"
        self.w.metrics |= {"inlierCount": str(m["inliers"]), **{k: str(m["h"][k]) for k in fitting.KINDS[kind]}}
        a, b = filters.split_scene(df)
        out = self._new(kind, a)
        self.w.add(f"{kind} rest", b)
        s.visible = False
        return out

    def _global(self, s: DataFrame, t: DataFrame, n: float):
        s, t = ((d if "nx" in d.columns else d.join(features.normals(d, k=10), "id")) for d in (s, t))
        return registration.global_registration(s, t, features.fpfh(s, 10), features.fpfh(t, 10), int(n))

    def _align(self, arg: str, f) -> str:
        ids = arg.split(",")
        s, t = self._scene(ids[0]), self._scene(ids[1])
        a = f(s.df, t.df, numbers(",".join(ids[2:]), 50)[0])
        if a is None:
            return "Error:no alignment found"
        self.w.metrics |= {"fitness": str(a.fitness), "iterations": str(a.iterations), "scale": str(a.scale)}
        out = self._new("aligned", registration.apply(s.df, a))
        s.visible = False
        return out

    def _duplicate(self, arg: str) -> str:
        s = self._scene(arg)
        deg, x, y, z = self._rest(arg, (0, 0, 0, 0))
        c, n = math.cos(math.radians(deg)), math.sin(math.radians(deg))
        return self._new("copy", filters.transform(s.df, [[c, 0, n], [0, 1, 0], [-n, 0, c]], [x, y, z]))


def run_scenario(d: Dispatcher, steps: list[dict]) -> list[tuple[str, str, bool]]:
    """Steps ``{command, expect?, expect_prefix?, expect_not?, expect_range?,
    store_as?, strip_prefix?, repeat?}``; ``${name}`` stands for a stored answer."""
    kept: dict[str, str] = {}
    out = []
    for s in steps:
        for _ in range(int(s.get("repeat", 1))):
            line = s["command"]
            for k, v in kept.items():
                line = line.replace("${" + k + "}", v)
            got = d.run(line)
            bare = got.removeprefix(s.get("strip_prefix", ""))
            if s.get("store_as"):
                kept[s["store_as"]] = bare
            ok = "expect" not in s or got == s["expect"]
            ok &= "expect_prefix" not in s or got.startswith(s["expect_prefix"])
            ok &= "expect_not" not in s or got != s["expect_not"]
            if "expect_range" in s:
                lo, hi = s["expect_range"]
                try:
                    ok &= lo <= float(bare.partition(":")[2] or bare) <= hi
                except ValueError:
                    ok = False
            out.append((line, got, ok))
    return out
