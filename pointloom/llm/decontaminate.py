"""Benchmark decontamination with an Aho-Corasick automaton.

Item and document texts are normalised alike: A-Z lower-cased, every ASCII
character but letters and digits a gap, words joined by one space. The patterns
are all windows of 8 consecutive item words (an item of fewer is one window),
with a space at both ends so that only whole words match. One automaton holds
them all; a document is scanned once, overlapping matches included, and the end
of each match leads to the item words' place in the document and, by the words'
own places, to offsets in the original text.

Tasks make the patterns and write them to the shared folder, in blocks of about
``BLOCK_PATTERNS`` by their hash; the driver sees their number and the blocks'
paths, and nothing is broadcast. Workers read the one block, or take several one
after another for a stretch of texts at a time, so neither the driver's nor a
worker's memory grows with the benchmark.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.filestore import read_bytes, write_bytes
from ..plans.materialize import cut, shared_dir
from .text import unused

WINDOW = 8
MIN_ITEMS = 2
#: Windows in one automaton: about 150 MB.
BLOCK_PATTERNS = 400_000
#: Characters of text held while several blocks are gone through.
HELD_TEXT = 64_000_000

T = TypeVar("T")

_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def norm_words(text: str | None) -> list[bytes]:
    """The normalised words, in UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


def windows(text: str | None, size: int = WINDOW) -> list[str]:
    w = norm_words(text)
    if not w:
        return []
    return [f" {b' '.join(w[i : i + size]).decode('utf-8', 'replace')} " for i in range(max(1, len(w) - size + 1))]


def write_patterns(
    benchmark: DataFrame,
    text_col: str = "text",
    id_col: str = "item_id",
    size: int = WINDOW,
    limit: int = BLOCK_PATTERNS,
) -> list[str]:
    """The windows of a benchmark table, made by tasks and written to the shared
    folder in blocks of about ``limit`` by their hash; the driver gets the blocks'
    paths. Rows without an id take part under the name ``null``; rows without
    words have no window."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for name, text in zip(df["name"], df["text"], strict=True):
                found = list(dict.fromkeys(windows(text, size)))
                for at in range(0, len(found), 50_000):
                    some = found[at : at + 50_000]
                    yield pd.DataFrame({"pattern": some, "name": [name] * len(some)})

    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("name"), F.col(text_col).alias("text"))
    pairs = cut(items.mapInPandas(each, "pattern string, name string").distinct())
    blocks = -(-pairs.agg(F.count_distinct("pattern")).first()[0] // limit)
    if not blocks:
        return []
    out = f"{shared_dir(benchmark.sparkSession)}/patterns-{uuid.uuid4().hex}"

    def write(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        path = f"{out}/block-{key[0]:06d}.json"
        rows = df.sort_values(["pattern", "name"]).groupby("pattern", sort=False)["name"]
        write_bytes(path, (json.dumps([p, list(names)]).encode() + b"\n" for p, names in rows))
        return pd.DataFrame({"path": [path]})

    dealt = pairs.withColumn("block", F.pmod(F.xxhash64("pattern"), F.lit(blocks)))
    return sorted(r["path"] for r in dealt.groupBy("block").applyInPandas(write, "path string").collect())


def automaton(path: str):
    """The automaton of a block that ``write_patterns`` wrote."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for line in read_bytes(path).splitlines():
        p, names = json.loads(line)
        a.add_word(p, (p.count(" ") - 1, names))
    a.make_automaton()
    return a


def scan(text: str | None, found) -> tuple[int, np.ndarray, set[str]]:
    """The number of words, whether each is hit, and the item ids that occur.
    ``found``: the automata."""
    w = norm_words(text)
    hit = np.zeros(len(w), bool)
    names: set[str] = set()
    if w:
        line = f" {b' '.join(w).decode('utf-8', 'replace')} "
        ends = None
        for a in found:
            for end, (n, items) in a.iter(line):
                if ends is None:  # the place of the space behind each word
                    ends = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 32)[1:]
                last = int(np.searchsorted(ends, end))
                hit[last - n + 1 : last + 1] = True
                names.update(items)
    return len(w), hit, names


Found = tuple[int, np.ndarray, set[str]]


def scanned(batches: Iterator[T], texts: Callable[[T], list[str | None]], paths: list[str]) -> Iterator[tuple[T, list[Found]]]:
    """Each batch with what ``scan`` finds in its texts. One block's automaton is
    kept. Of several, each is built in turn for some 64 MB of texts, so that one
    automaton and those texts are in memory at a time."""
    if len(paths) < 2:
        kept = [automaton(p) for p in paths]
        for b in batches:
            yield b, [scan(t, kept) for t in texts(b)]
        return

    def through(held: list[T]) -> Iterator[tuple[T, list[Found]]]:
        found: list[list[Found]] = []
        for path in paths:
            a = [automaton(path)]
            new = [[scan(t, a) for t in texts(b)] for b in held]
            if found:
                for old, more in zip(found, new, strict=True):
                    old[:] = [(n, h | g, s | r) for (n, h, s), (_, g, r) in zip(old, more, strict=True)]
            else:
                found = new
        return zip(held, found, strict=True)

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += sum(len(t or "") for t in texts(b))
        if size >= HELD_TEXT:
            yield from through(held)
            held, size = [], 0
    if held:
        yield from through(held)


def spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as character ranges of the original text."""
    import re

    out: list[tuple[int, int]] = []
    before = False
    for m, h in zip(re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text), hit, strict=True):
        if h:
            out[len(out) - before :] = [(out[-1][0] if before else m.start(), m.end())]
        before = bool(h)
    return out


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    min_items: int = MIN_ITEMS,
    with_spans: bool = False,
    limit: int = BLOCK_PATTERNS,
) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated[, spans])``.

    A document word is hit if it lies in any occurrence of a window; n_items
    counts the items that have an occurring window, items_sha256 is of their
    ids, sorted as strings and joined by commas; contaminated: at least
    ``min_items``. ``spans``: (start, end) character ranges of the hit words.
    Defined cases: null and wordless texts have no words and no hits; a benchmark
    without words hits nothing; null doc_ids and repeated rows come back as they
    came; an item_id of several rows counts once; an empty table gives none; other
    columns are ignored. Beyond ``limit`` windows there are several automata; the
    result is the same.
    """
    paths = write_patterns(benchmark, limit=limit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df, found in scanned(batches, lambda b: b["text"].tolist(), paths):
            texts = df["text"].tolist()
            out = {
                "doc_id": df["doc_id"],
                "n_words": [n for n, _, _ in found],
                "n_hit": [int(h.sum()) for _, h, _ in found],
                "n_items": [len(s) for _, _, s in found],
                "items_sha256": [hashlib.sha256(",".join(sorted(s)).encode()).hexdigest() for _, _, s in found],
                "contaminated": [len(s) >= min_items for _, _, s in found],
            }
            if with_spans:
                out["spans"] = [
                    [{"start": a, "end": b} for a, b in spans(t, h)] if h.any() else []
                    for t, (_, h, _) in zip(texts, found, strict=True)
                ]
            yield pd.DataFrame(out)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    if with_spans:
        schema += ", spans array<struct<start: int, end: int>>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, min_items: int = MIN_ITEMS) -> DataFrame:
    """``docs`` without the contaminated rows; the remaining rows lose the
    passages they share with fewer items. Scanning and cutting take one pass over the rows; no join.
    Columns and their order stay, whatever their names; n_chars, if there, is counted
    anew. Null and wordless texts stay as they are, repeated rows and null doc_ids are
    judged by their own text, and an empty table stays empty."""
    paths = write_patterns(benchmark)
    new = unused(docs, "__clean")

    @F.pandas_udf("string")
    def cleaned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s, found in scanned(batches, pd.Series.tolist, paths):
            out = []
            for t, (_, hit, names) in zip(s.tolist(), found, strict=True):
                if len(names) >= min_items:
                    out.append(None)
                elif t is None:
                    out.append("")
                elif hit.any():
                    at, parts = 0, []
                    for a, b in spans(t, hit):
                        parts.append(t[at:a])
                        at = b
                    out.append("".join([*parts, t[at:]]))
                else:
                    out.append(t)
            yield pd.Series(out, dtype="object")

    rows = docs.withColumn(new, cleaned("text")).where(F.col(new).isNotNull())
    text = F.when(F.col("text").isNotNull(), F.col(new))
    cols = []
    for f in docs.schema:
        if f.name == "text":
            cols.append(text.alias("text"))
        elif f.name == "n_chars":
            cols.append(F.when(text == F.col("text"), F.col("n_chars")).otherwise(F.length(text)).cast(f.dataType).alias("n_chars"))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return rows.select(cols)


#: The same by joining the strings of all windows.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS i FROM documents),
  b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
  p AS (SELECT DISTINCT item, least(len(w), 8) AS n, array_to_string(w[k:k + least(len(w), 8) - 1], ' ') AS words FROM b, range(1, (SELECT max(len(w)) + 2 FROM b)) AS r(k) WHERE len(w) > 0 AND k <= greatest(1, len(w) - 7)),
  s AS (SELECT DISTINCT n FROM p),
  e AS (SELECT i, w, unnest(range(1, len(w) + 1)) AS k FROM d),
  m AS (SELECT i, k, p.n, item FROM (SELECT i, k, n, array_to_string(w[k:k + n - 1], ' ') AS words FROM e, s WHERE k + n - 1 <= len(w)) JOIN p USING (n, words)),
  h AS (SELECT i, count(DISTINCT c) AS n_hit FROM (SELECT i, unnest(range(k, k + n)) AS c FROM (SELECT DISTINCT i, k, n FROM m)) GROUP BY i),
  t AS (SELECT i, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT i, item FROM m) GROUP BY i)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN h USING (i) LEFT JOIN t USING (i)"""
