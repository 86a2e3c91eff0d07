"""SimHash near-duplicate groups by a segment-popcount embedding.

A 64-bit fingerprint is cut into 16 segments of 4 bits; the vector of the
segments' bit counts is its embedding. Flipping one bit moves the embedding by
one step along one axis, so the Manhattan distance of two embeddings never
exceeds the number of differing bits: fingerprints within 2 bits have embeddings
within 2 steps, and then some lattice cell lies within one step of both. The
range join is therefore an equi-join on cells: every distinct fingerprint visits
its own cell and at most 32 neighbours. The bit counts of all 16 segments fit
one BIGINT (a nibble each), so cells are plain integers.

What meets in a cell is only a candidate. A cell with two fingerprints is
verified by the bits of their exclusive-or. A fuller cell is verified without
pairs: two fingerprints differ in at most 2 bits exactly when some 64-bit value
is within one bit of both, so its members are grouped by those values (at most 4
of them per member and cell), and at most 65 fingerprints can share one. Large groups of copies
therefore cost time in proportion to their size. Exact copies collapse to one
fingerprint before any of this, by an aggregate that combines on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import repeat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.materialize import cut
from .text import unused

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: Shingles whose bits are summed at a time.
BLOCK = 1 << 16

_ONES = 0x1111111111111111


def simhash64(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint as a signed 64-bit integer; null and wordless texts: 0."""
    import numpy as np
    import xxhash

    if not text:
        return 0
    # bytes.split() parts at the ASCII white space alone, bytes.lower() changes A-Z alone
    w = text.encode("utf-8", "replace").lower().split()
    if not w:
        return 0
    if len(w) < shingle:
        grams = iter([b" ".join(w)])
        n = 1
    else:
        grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False))
        n = len(w) - shingle + 1
    counts = np.zeros(64, np.int64)
    done = 0
    while done < n:
        k = min(BLOCK, n - done)
        raw = b"".join(xxhash.xxh64_digest(g, s) for g, s in zip(grams, repeat(seed, k)))
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        done += k
    return int(np.packbits(2 * counts > n).view(">i8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", more: Sequence[Column] = ()) -> DataFrame:
    """``(doc_id, fp, *more)`` for every row; other columns are not read."""

    @F.pandas_udf("bigint")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash64(t) for t in texts], dtype="int64")

    return docs.select(F.col(id_col).alias("doc_id"), fp(F.col(text_col)).alias("fp"), *more)


def _embedding(x: str) -> str:
    """SQL for the 16 bit counts of ``x``, a nibble each."""
    return "(" + " + ".join(f"(shiftrightunsigned({x}, {k}) & {_ONES}L)" for k in range(4)) + ")"


def cells(fps: DataFrame) -> DataFrame:
    """``(fp, emb, step, cell)``: the cells within one step of each ``fp``. step
    0 is the own cell, 1-16 are one bit more in a segment, 17-32 one bit less.
    Cells that no fingerprint's embedding can have are left out."""
    up = [f"if((shiftrightunsigned(emb, {4 * j}) & 15) < 4, emb + {1 << (4 * j)}L, NULL)" for j in range(16)]
    down = [f"if((shiftrightunsigned(emb, {4 * j}) & 15) > 0, emb - {1 << (4 * j)}L, NULL)" for j in range(16)]
    return (
        fps.select("fp", F.expr(_embedding("fp")).alias("emb"))
        .selectExpr("fp", f"posexplode(array(emb, {', '.join(up + down)})) AS (step, cell)")
        .where("cell IS NOT NULL")
    )


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(a, b)``: edges whose closure is that of all pairs of distinct
    fingerprints with at most ``max_bits`` (2) differing bits."""
    if max_bits != 2:
        raise ValueError("the one-step cells and midpoints hold for 2 bits")
    c = cells(fps)
    filled = c.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")
    ).where("n > 1")
    two = filled.where(f"n = 2 AND bit_count(lo ^ hi) <= {max_bits}").select(
        F.col("hi").alias("a"), F.col("lo").alias("b")
    )
    base = "4 * ((step - 1) % 16)"
    flips = ", ".join(
        f"if((shiftrightunsigned(fp, {base} + {k}) & 1) = if(step <= 16, 0, 1), fp ^ shiftleft(1L, {base} + {k}), NULL)"
        for k in range(4)
    )
    shared = (
        c.join(filled.where("n > 2").select("cell"), "cell")
        .selectExpr("fp", f"explode(if(step = 0, array(fp), array({flips}))) AS mid")
        .where("mid IS NOT NULL")
        .groupBy("mid")
        .agg(F.collect_set("fp").alias("near"))  # 65 values at most lie within one bit of mid
        .where("size(near) > 1")
        .selectExpr("explode(near) AS a", "array_min(near) AS b")
        .where("a <> b")
    )
    return two.unionByName(shared).distinct()


def _groups(marked: DataFrame) -> DataFrame:
    """``(fp, component_id, d, t)`` of rows ``(doc_id, fp, t)``: each fingerprint
    with its component's smallest doc_id, and the t that goes with it, the least of several."""
    first = F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").alias("d"), "t"))
    fps = cut(marked.groupBy("fp").agg(F.min(first).alias("first")))
    roots = connected_components(links(fps.select("fp")))
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("v")).select("root", "v.*")
    return rooted.select("fp", "root").join(firsts, "root").select("fp", F.col("d").alias("component_id"), "d", "t")


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    Fingerprints that differ in at most 2 bits are linked; a component is what
    links reach, and component_id is its smallest doc_id. Defined cases: null,
    empty and wordless texts have fingerprint zero and are linked like any
    other; equal texts always share a component; rows with a null doc_id come
    back with null and never give a component its id unless it has no other;
    repeated rows come back as often as they came; an empty table gives none.
    Columns other than the two named are ignored.
    """
    marked = cut(fingerprints(docs, text_col, id_col))
    named = _groups(marked.withColumn("t", F.lit(0))).select("fp", "component_id")
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, the one with the
    smallest doc_id; of several texts with that doc_id the one of the least hash,
    and of rows equal in both any one. Rows with a null doc_id cannot be named and
    stay; null and wordless texts are one group; an empty table stays empty; all
    columns stay, whatever their names."""
    t = unused(docs, "__t")
    marked = cut(fingerprints(docs, more=[F.xxhash64("text").alias("t")]))
    kept = _groups(marked).where("d IS NOT NULL").select(F.col("d").alias("__d"), F.col("t").alias("__of")).distinct()
    rows = docs.where("doc_id IS NOT NULL").withColumn(t, F.xxhash64("text"))
    one = rows.join(kept, (rows["doc_id"] == kept["__d"]) & (rows[t] == kept["__of"]), "left_semi").dropDuplicates(["doc_id", t])
    return one.drop(t).unionByName(docs.where("doc_id IS NULL"))
