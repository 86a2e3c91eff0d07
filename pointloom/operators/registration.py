"""Rigid registration: nearest-point joins, sums, and a small solve a round."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import kabsch, rodrigues
from ..functions.rng import uniform
from ..plans.filestore import read_bytes, write_bytes
from ..plans.materialize import cut, shared_dir
from ..plans.neighbors import knn_pairs
from .filters import transform


@dataclass
class Alignment:
    rotation: np.ndarray = field(default_factory=lambda: np.eye(3))
    translation: np.ndarray = field(default_factory=lambda: np.zeros(3))
    scale: float = 1.0
    iterations: int = 0
    fitness: float = float("inf")
    converged: bool = False
    matched: int = 0


def robust_weight(d: Column, kernel: str | None, delta: float) -> Column:
    """Huber: 1 up to delta, delta / d beyond. Tukey: (1 - (d / delta)^2)^2, 0 beyond."""
    if kernel is None or kernel == "none":
        return F.lit(1.0)
    if kernel == "huber":
        return F.when(d <= delta, 1.0).otherwise(F.lit(delta) / d)
    if kernel == "tukey":
        u = 1 - (d / delta) * (d / delta)
        return F.when(d < delta, u * u).otherwise(0.0)
    raise ValueError(f"unknown kernel {kernel}")


def apply(df: DataFrame, a: Alignment) -> DataFrame:
    return transform(df, (a.scale * a.rotation).tolist(), a.translation.tolist())


def matches(source: DataFrame, target: DataFrame, max_distance: float, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each source point with its nearest target point: sx.., tx.., d2."""
    m = knn_pairs(source.select("id", "x", "y", "z"), target, 1, exclude_self=False, carry=carry)
    j = m.join(source.select("id", "x", "y", "z"), "id")
    out = j.select(
        *[F.col(a).alias(f"s{a}") for a in "xyz"], *[(F.col(a) + F.col(f"d{a}")).alias(f"t{a}") for a in "xyz"],
        (F.col("dist") * F.col("dist")).alias("d2"), *[f"n_{c}" for c in carry],
    )
    return out.where(F.col("d2") <= max_distance * max_distance) if max_distance > 0 else out


def rigid_sums(m: DataFrame, weight: Column | None = None) -> DataFrame:
    """One row of the weighted sums that a rigid fit of s to t needs."""
    w = weight if weight is not None else F.lit(1.0)
    cross = [F.sum(w * F.col(f"s{a}") * F.col(f"t{b}")).alias(f"h{a}{b}") for a in "xyz" for b in "xyz"]
    sq = F.sum(w * sum((F.col(f"s{a}") * F.col(f"s{a}") for a in "xyz"), F.lit(0.0))).alias("ss")
    fit = F.avg("d2").alias("fitness") if "d2" in m.columns else F.lit(0.0).alias("fitness")
    return m.agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), *[F.sum(w * F.col(f"{p}{a}")).alias(f"{p}{a}") for p in "st" for a in "xyz"], *cross, sq, fit)


def rigid_transform(r, scale: bool = False):
    """(R, t, s) from the sums, or None if the weights vanish."""
    if not r["n"] or r["w"] is None or r["w"] < 1e-9:
        return None
    w = r["w"]
    cs, ct = (np.array([r[f"{p}{a}"] for a in "xyz"]) / w for p in "st")
    h = np.array([[r[f"h{a}{b}"] for b in "xyz"] for a in "xyz"]) - w * np.outer(cs, ct)
    return kabsch(w, cs, ct, h, r["ss"] - w * cs @ cs, scale)


def _compose(a: Alignment, r: np.ndarray, t: np.ndarray, s: float) -> None:
    a.rotation, a.translation, a.scale = r @ a.rotation, s * r @ a.translation + t, s * a.scale


def icp(source: DataFrame, target: DataFrame, iterations: int = 50, tolerance: float = 1e-6, max_distance: float = 0.0,
        kernel: str | None = None, delta: float = 1.0, scale: bool = False) -> Alignment:
    """Point-to-point. A round is a nearest-point join and one aggregate of sums;
    the source is never rewritten, the transform so far is folded in. Fitness is
    the mean squared distance before a step; stops when it changes by less than the tolerance."""
    out, before = Alignment(), float("inf")
    w = robust_weight(F.sqrt("d2"), kernel, delta)
    for k in range(iterations):
        r = rigid_sums(matches(apply(source, out), target, max_distance), w).first()
        step = rigid_transform(r, scale) if r["n"] >= 3 else None
        if step is None:
            break
        out.fitness, out.matched, out.iterations = r["fitness"], r["n"], k + 1
        _compose(out, *step)
        if abs(before - out.fitness) < tolerance:
            out.converged = True
            break
        before = out.fitness
    return out


def icp_point_to_plane(source: DataFrame, target: DataFrame, iterations: int = 50, tolerance: float = 1e-6, max_distance: float = 0.0,
                       kernel: str | None = None, delta: float = 1.0) -> Alignment:
    """Gauss-Newton on the distances along the target's normals; needs six matches
    and gives the best alignment seen, not the last."""
    now, best, before = Alignment(), Alignment(), float("inf")
    for k in range(iterations + 1):
        m = matches(apply(source, now), target, max_distance, carry=("nx", "ny", "nz"))
        s, n = [F.col(f"s{a}") for a in "xyz"], [F.col(f"n_n{a}") for a in "xyz"]
        e = sum(((F.col(f"t{a}") - F.col(f"s{a}")) * n[i] for i, a in enumerate("xyz")), F.lit(0.0))
        j = [s[1] * n[2] - s[2] * n[1], s[2] * n[0] - s[0] * n[2], s[0] * n[1] - s[1] * n[0], *n]
        w = robust_weight(F.abs(e), kernel, delta)
        sums = [F.sum(w * j[a] * j[b]).alias(f"a{a}{b}") for a in range(6) for b in range(a, 6)] + [F.sum(w * j[a] * e).alias(f"b{a}") for a in range(6)]
        r = m.agg(F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("fitness"), *sums).first()
        if r["n"] < 6:
            break
        now.fitness, now.matched = r["fitness"], r["n"]
        if r["fitness"] < best.fitness:
            best = Alignment(now.rotation, now.translation, 1.0, now.iterations, r["fitness"], False, r["n"])
        if abs(before - r["fitness"]) < tolerance or k == iterations:
            best.converged = k < iterations
            break
        before = r["fitness"]
        a = np.zeros((6, 6))
        for p in range(6):
            for q in range(p, 6):
                a[p, q] = a[q, p] = r[f"a{p}{q}"]
        x = np.linalg.lstsq(a, np.array([r[f"b{p}"] for p in range(6)]), rcond=1e-12)[0]
        _compose(now, rodrigues(x[:3]), x[3:], 1.0)
        now.iterations = k + 1
    return best


#: Histograms compared at a time: of the source, of the target, and in a file of the target.
STRIPE, BLOCK, FILE = 4000, 1000, 16_000


def _by_norm(df: DataFrame) -> DataFrame:
    """(id, histogram, norm) in ranges of norms, each range in order."""
    norm = F.sqrt(F.aggregate("histogram", F.lit(0.0), lambda a, x: a + x * x))
    df = cut(df.select("id", "histogram", norm.alias("norm")).where(F.col("norm") < float("inf")))
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartitionByRange(parts, "norm").sortWithinPartitions("norm")


def _stripes(batches, size: int):
    """(ids, histograms) of ``size`` rows, fewer at the end."""
    held, n = [], 0
    for df in batches:
        for lo in range(0, len(df), size):
            part = df.iloc[lo : lo + size]
            if n + len(part) > size:
                yield np.concatenate([p["id"] for p in held]), np.stack([h for p in held for h in p["histogram"]])
                held, n = [], 0
            held.append(part)
            n += len(part)
    if n:
        yield np.concatenate([p["id"] for p in held]), np.stack([h for p in held for h in p["histogram"]])


def feature_matches(source: DataFrame, target: DataFrame) -> DataFrame:
    """``(id, nid, d2)``: the target histogram nearest to each source histogram, the
    lower id on ties. The target lies in files of the shared folder in the order of norms, which workers
    read as they need them, so no pair of blocks is shuffled; a task compares some 4,000 with 1,000
    histograms at a time by a matrix product, those of like norms first, and none whose norms alone
    put them beyond the nearest so far. What comes within rounding of the least is measured
    exactly. Histograms that aren't finite match nothing."""
    import uuid

    import pandas as pd
    from pyspark import TaskContext

    folder = f"{shared_dir(source.sparkSession)}/features-{uuid.uuid4().hex}"

    def write(batches):
        for k, (ids, h) in enumerate(_stripes(batches, FILE)):
            path, norm = f"{folder}/{TaskContext.get().partitionId()}-{k}", np.sqrt((h * h).sum(1))
            write_bytes(path, [np.ascontiguousarray(v).tobytes() for v in (ids.astype(np.int64), h.astype(np.float64))])
            yield pd.DataFrame({"path": [path], "n": [len(h)], "lo": [norm.min()], "hi": [norm.max()]})

    files = [tuple(r) for r in _by_norm(target).mapInPandas(write, "path string, n bigint, lo double, hi double").collect()]  # one row a file
    top = max((hi for *_, hi in files), default=0.0)

    def run(batches):
        for ids, a in _stripes(batches, STRIPE):
            aa = (a * a).sum(1)
            lo, hi, slack = np.sqrt(aa.min()), np.sqrt(aa.max()), 1e-9 * (1 + aa + top * top)
            best, nid = np.full(len(a), np.inf), np.zeros(len(a), np.int64)
            left = np.concatenate([-2 * a, np.ones((len(a), 1)), aa[:, None]], 1)
            apart = lambda f: max(0.0, f[2] - hi, lo - f[3])  # noqa: E731, B023
            for path, n, *ends in sorted(files, key=apart):
                if apart((path, n, *ends)) ** 2 > (best + slack).max():
                    break
                data = read_bytes(path)
                nids, g = np.frombuffer(data, np.int64, n), np.frombuffer(data, np.float64, offset=8 * n).reshape(n, -1)
                gg = (g * g).sum(1)
                for at in range(0, n, BLOCK):
                    b, bb = g[at : at + BLOCK], gg[at : at + BLOCK]
                    if max(0.0, np.sqrt(bb.min()) - hi, lo - np.sqrt(bb.max())) ** 2 > (best + slack).max():
                        continue
                    d = left @ np.concatenate([b, bb[:, None], np.ones((len(b), 1))], 1).T
                    least = np.minimum(d.min(1), best)
                    live = np.flatnonzero(d.min(1) <= least + slack)
                    row, col = np.nonzero(d[live] <= (least + slack)[live, None])
                    row = live[row]
                    exact, found = ((a[row] - b[col]) ** 2).sum(1), nids[at + col]
                    order = np.lexsort((found, exact, row))
                    order = order[np.unique(row[order], return_index=True)[1]]
                    row, exact, found = row[order], exact[order], found[order]
                    new = (exact < best[row]) | ((exact == best[row]) & (found < nid[row]))
                    best[row[new]], nid[row[new]] = exact[new], found[new]
            met = np.isfinite(best)
            yield pd.DataFrame({"id": ids[met], "nid": nid[met], "d2": best[met]})

    met = _by_norm(source).mapInPandas(run, "id bigint, nid bigint, d2 double")
    return met.groupBy("id").agg(F.min(F.struct("d2", "nid")).alias("m")).select("id", "m.nid", F.col("m.d2").alias("d2"))


def global_registration(source: DataFrame, target: DataFrame, source_fpfh: DataFrame, target_fpfh: DataFrame, iterations: int = 1000,
                        max_distance: float = 0.05, sample: int = 3, edge_tolerance: float = 0.15, min_inliers: int = 3, seed: int = 42,
                        pool: int = 5000) -> Alignment | None:
    """RANSAC over feature matches: samples whose edges differ by more than the
    tolerance are passed over, the others give rigid fits, which are scored over all
    matches in one pass; the best is fitted again to its inliers. Samples are drawn from the
    ``pool`` matches with the smallest hashes."""
    m = feature_matches(source_fpfh, target_fpfh)
    s = source.select("id", *[F.col(a).alias(f"s{a}") for a in "xyz"])
    t = target.select(F.col("id").alias("nid"), *[F.col(a).alias(f"t{a}") for a in "xyz"])
    m = cut(m.join(s, "id").join(t, "nid"))
    got = m.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(pool).collect()
    if len(got) < max(sample, 3):
        return None
    p = np.array([[r[f"s{a}"] for a in "xyz"] for r in got])
    q = np.array([[r[f"t{a}"] for a in "xyz"] for r in got])
    rows = []
    for i in range(iterations):
        pick = np.argsort(uniform(seed + i, np.arange(len(got))), kind="stable")[:sample]
        a, b = p[pick], q[pick]
        la, lb = (np.linalg.norm(x - np.roll(x, 1, axis=0), axis=1) for x in (a, b))
        if (la < 1e-9).any() or (np.abs(la - lb) / np.maximum(la, lb) > edge_tolerance).any():
            continue
        r, tr, _ = kabsch(sample, a.mean(0), b.mean(0), (a - a.mean(0)).T @ (b - b.mean(0)), 0.0)
        rows.append((i, *map(float, r.ravel()), *map(float, tr)))
    if not rows:
        return None
    names = [f"r{i}{j}" for i in range(3) for j in range(3)] + ["t0", "t1", "t2"]
    h = source.sparkSession.createDataFrame(rows, "iteration int, " + ", ".join(f"{n} double" for n in names))
    err = [sum((F.col(f"r{i}{j}") * F.col(f"s{a}") for j, a in enumerate("xyz")), F.col(f"t{i}")) - F.col(f"t{b}") for i, b in enumerate("xyz")]
    near = err[0] * err[0] + err[1] * err[1] + err[2] * err[2] <= max_distance * max_distance
    scored = m.join(F.broadcast(h), F.lit(True)).where(near).groupBy(*["iteration", *names]).agg(F.count(F.lit(1)).alias("inliers"))
    top = scored.orderBy(F.col("inliers").desc(), "iteration").first()
    if top is None or top["inliers"] < min_inliers:
        return None
    r, tr = np.array([[top[f"r{i}{j}"] for j in range(3)] for i in range(3)]), np.array([top[f"t{i}"] for i in range(3)])
    fixed = [sum((F.col(f"s{a}") * float(r[i, j]) for j, a in enumerate("xyz")), F.lit(float(tr[i]))) - F.col(f"t{b}") for i, b in enumerate("xyz")]
    d2 = fixed[0] * fixed[0] + fixed[1] * fixed[1] + fixed[2] * fixed[2]
    inliers = m.where(d2 <= max_distance * max_distance).withColumn("d2", d2)
    sums = rigid_sums(inliers).first()
    fit = rigid_transform(sums)
    if fit is None:
        return None
    return Alignment(fit[0], fit[1], 1.0, iterations, sums["fitness"], True, top["inliers"])
