"""Variable-capacity best-fit packing of documents into training sequences.

Documents longer than the largest permitted length are cut into pieces of it. Pieces
are dealt by a hash of document, piece and (of equal rows) copy to shards of some
tens of thousands, of which each is packed by itself, longest piece first: a piece goes to the open bin that it
leaves the least room in. If none has room, a bin is opened with the permitted
length whose cost for each token it can expect to hold is least, given what is
still to be packed and would fit behind the piece. At the end every bin shrinks
to the least permitted length that holds its contents. A shard of this size
leaves far less than one bin in a hundred unfilled, so shards cost next to nothing, and no
piece, bin or source is ever seen by more than one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import cut
from .text import words

CAPACITIES = (512, 1024, 2048, 4096)
#: The cost of a sequence of c tokens, in tokens: OVERHEAD + c * (1 + c / QUADRATIC).
OVERHEAD, QUADRATIC = 16, 32_768
SHARD = 20_000
#: Equal rows numbered by one task at a time.
STRETCH = 10_000


def pack(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, quadratic: int = QUADRATIC) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and place in the bin of each piece, and each bin's final capacity.
    Pieces of equal length are taken in the order given."""
    caps = sorted(capacities)
    if len(lengths) and int(lengths.max()) > caps[-1]:
        raise ValueError("a piece is longer than the largest capacity")
    order = np.argsort(-lengths, kind="stable")
    bin_of, slot = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used: list[int] = []
    held: list[int] = []
    open_by_room: list[list[int]] = [[] for _ in range(caps[-1] + 1)]
    rooms = 0  # bit r: some open bin has r tokens of room
    at_length = np.bincount(lengths, minlength=caps[-1] + 1) if len(lengths) else np.zeros(caps[-1] + 1, int)
    # tokens of the pieces up to each length; pieces come in falling length, so for what is still to come it holds below the present length
    below = np.cumsum(at_length * np.arange(len(at_length))).tolist()
    for i in order.tolist():
        n = int(lengths[i])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms &= ~(1 << room)
        else:
            best = None
            for c in caps:
                if c >= n:
                    behind = min(c - n, below[min(c - n, n)])
                    cost = (overhead + c * (1 + c / quadratic)) / max(1, n + behind)
                    if best is None or cost < best[0]:
                        best = (cost, c)
            room, b = best[1], len(used)
            used.append(0)
            held.append(0)
        bin_of[i], slot[i] = b, held[b]
        used[b] += n
        held[b] += 1
        room -= n
        if room:
            open_by_room[room].append(b)
            rooms |= 1 << room
        # a bin without room takes pieces of no tokens only
        elif n == 0:
            open_by_room[0].append(b)
            rooms |= 1
    fill = np.array(used, np.int64)
    return bin_of, slot, np.array(caps, np.int64)[np.searchsorted(caps, fill)] if len(fill) else fill


def pack_documents(
    docs: DataFrame,
    length_col: str = "n_tokens",
    id_col: str = "doc_id",
    capacities: tuple[int, ...] = CAPACITIES,
    shard: int = SHARD,
) -> DataFrame:
    """``(doc_id, piece, start, n_tokens, bin_id, slot, capacity)``, one row for
    each piece of each row of ``docs``; piece k holds the document's tokens from
    ``start`` on; bin_id is unique, slot the place in the bin.

    Defined cases: null and negative lengths count as zero; a row without tokens is one piece of
    none; equal lengths are taken in the order of document and piece; null
    doc_ids are packed like others; repeated rows are packed as often as they
    come, and neither they nor null ids meet in one shard; an empty table gives none; other columns are ignored. Equal input gives
    equal output whatever its partitions, up to the order of identical rows.
    """
    top = max(capacities)
    n = F.greatest(F.coalesce(F.col(length_col).cast("bigint"), F.lit(0)), F.lit(0))
    # equal rows are counted and numbered anew, in stretches, so that they are dealt like others
    rows = cut(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), n.alias("n")).groupBy("doc_id", "n").agg(F.count(F.lit(1)).alias("copies")))
    total = rows.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("n") / top)) * F.col("copies")).alias("n")).first()["n"] or 0
    shards = max(1, -(-int(total) // shard))
    runs = rows.select("doc_id", "n", "copies", F.explode(F.expr(f"sequence(0L, (copies - 1) div {STRETCH})")).alias("run"))
    if shards > 1:
        runs = runs.repartition("doc_id", "n", "run")
    pieces = (
        runs.select("doc_id", "n", F.explode(F.expr(f"sequence(run * {STRETCH}, least(copies, (run + 1) * {STRETCH}) - 1)")).alias("copy"))
        .select("doc_id", "n", "copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.ceil(F.col("n") / top) - 1))).alias("piece"))
        .select("doc_id", "copy", "piece", (F.col("piece") * top).alias("start"), F.least(F.lit(top), F.col("n") - F.col("piece") * top).alias("n_tokens"))
    )
    caps = tuple(capacities)

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["doc_id", "copy", "piece", "n_tokens"], kind="stable", na_position="first")
        b, slot, cap = pack(df["n_tokens"].to_numpy(np.int64), caps)
        return pd.DataFrame(
            {
                "doc_id": df["doc_id"].astype("Int64"),
                "piece": df["piece"],
                "start": df["start"],
                "n_tokens": df["n_tokens"],
                "bin_id": int(key[0]) << 32 | b,
                "slot": slot.astype(np.int32),
                "capacity": cap[b].astype(np.int32) if len(cap) else slot.astype(np.int32),
            }
        )

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "copy", "n_tokens"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(
        run, "doc_id bigint, piece bigint, start bigint, n_tokens bigint, bin_id bigint, slot int, capacity int"
    )


def word_lengths(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, n_tokens)``: a document's words and one separator, a row for every
    row; null and wordless texts count the separator alone."""
    n = F.size(words(F.coalesce(F.col(text_col), F.lit("")))) + 1
    return docs.select(F.col(id_col).alias("doc_id"), n.cast("bigint").alias("n_tokens"))
