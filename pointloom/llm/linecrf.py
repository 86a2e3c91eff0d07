"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's state score is linear in what is
measured on it and on its two neighbours; a 2 x 2 table scores the step from one
line's label to the next. Forward-backward gives every line's probability of
being good; their mean, weighted by the lines' lengths, is carried to the
document's score by a logistic curve.

Only documents are labelled. The field is first fitted with every line labelled
as its document; then the lines of bad documents that it finds good are
relabelled (the worst line of each stays bad), it is fitted again, and the curve
is fitted on the documents' means. The sample for fitting has at most
``SAMPLE_DOCS`` documents, those with the smallest hash of doc_id, and at most
``SAMPLE_LINES`` lines in all; measurements are made on the executors, so the driver
gets some 100 bytes a line. Scoring reads every document whole, once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import cut

SAMPLE_DOCS = 4000
#: Lines of the whole sample, some 50 MB of features on the driver.
SAMPLE_LINES = 200_000
THRESHOLD = 0.3
FOLDS = 5
ROUNDS = 150
L2 = 1e-3
#: Documents measured together, by characters.
CHUNK = 1 << 19

_CLASS = np.zeros(256, np.uint8)
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 1
_CLASS[ord("!")] = 2
_CLASS[ord("A") : ord("Z") + 1] = 3
_CLASS[ord("a") : ord("z") + 1] = 4
_CLASS[0xC2:0xF5] = 4  # the first byte of a character beyond ASCII
_CLASS[ord("0") : ord("9") + 1] = 5
N_OWN, N_NEAR = 11, 5
N_FEATURES = N_OWN + 2 * N_NEAR


def measure(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines (float32, a row each), their lengths in bytes, and
    the number of lines of each text. Lines without a word are passed over; a text without any
    counts as one empty line."""
    raw: list[bytes] = []
    words: list[tuple[int, int, int, int]] = []
    n_lines = []
    for t in texts:
        seen: set[bytes] = set()
        before = len(raw)
        for line in (t or "").encode("utf-8", "replace").split(b"\n"):
            w = line.split()
            if not w:
                continue
            raw.append(line)
            words.append((len(w), len(set(w)), sum(map(eq, w, w[1:])), line in seen))
            seen.add(line)
        if len(raw) == before:
            raw.append(b" ")
            words.append((0, 0, 0, False))
        n_lines.append(len(raw) - before)
    length = np.array([len(r) for r in raw], np.int64)
    kind = _CLASS[np.frombuffer(b"".join(raw), np.uint8)]
    start = np.r_[0, np.cumsum(length)[:-1]]
    count = [np.add.reduceat((kind == k).astype(np.int64), start) if len(start) else length for k in range(1, 6)]
    symbols, bangs, upper, letters, digits = (c.astype(np.float64) for c in count)
    w = np.array(words, np.float64).reshape(-1, 4)
    n = np.maximum(w[:, 0], 1)
    near = np.stack(
        [
            np.minimum(symbols / n, 2),
            np.minimum(bangs / n, 2),
            upper / np.maximum(upper + letters, 1),
            w[:, 2] / n,
            np.where(w[:, 0] >= 8, 1 - w[:, 1] / n, 0),
        ],
        axis=1,
    )
    last = np.array([r.rstrip()[-1:] in (b".", b"?", b"!") for r in raw], np.float64)
    own = [np.ones(len(raw)), digits / np.maximum(length, 1), np.minimum(length / n, 30) / 10, np.log1p(w[:, 0]) / 5, last, w[:, 3]]
    first = np.zeros(len(raw), bool)
    first[np.r_[0, np.cumsum(n_lines)[:-1]].astype(int) if n_lines else []] = True
    final = np.r_[first[1:], True] if len(first) else first
    prev = np.where(first[:, None], 0, np.roll(near, 1, axis=0))
    succ = np.where(final[:, None], 0, np.roll(near, -1, axis=0))
    return np.column_stack([*own, near, prev, succ]).astype(np.float32), length, np.array(n_lines, np.int64)


def forward_backward(score: np.ndarray, n_lines: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability that each line is good, expected label steps (2 x 2), and the
    log of all partition sums. ``score``: a line's log odds of good before its
    neighbours speak; ``step``: log weights from bad and good (rows) to bad and
    good. All texts advance together, the longest first so that those that have
    ended drop off the end."""
    order = np.argsort(-n_lines, kind="stable")
    start = np.r_[0, np.cumsum(n_lines)[:-1]][order]
    size = n_lines[order]
    alive = len(size) - np.searchsorted(size[::-1], np.arange(size[0] if len(size) else 0), side="right")
    top = np.maximum(score, 0)
    emit = np.stack([np.exp(-top), np.exp(score - top)], axis=1)
    go = np.exp(step)
    alpha = np.zeros((len(score), 2))
    scale = np.ones(len(score))
    for t, k in enumerate(alive):
        at = start[:k] + t
        a = emit[at] * (alpha[at - 1] @ go if t else 1.0)
        scale[at] = c = a.sum(axis=1)
        alpha[at] = a / c[:, None]
    beta = np.ones((len(score), 2))
    steps = np.zeros((2, 2))
    for t in range(len(alive) - 2, -1, -1):
        at = start[: alive[t + 1]] + t
        b = emit[at + 1] * beta[at + 1] / scale[at + 1, None]
        steps += go * (alpha[at].T @ b)
        beta[at] = b @ go.T
    good = alpha[:, 1] * beta[:, 1]
    return good / (alpha * beta).sum(axis=1), steps, float(np.log(scale).sum() + top.sum())


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    slope: float = 0.0
    offset: float = 0.0

    def lines(self, x: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        return forward_backward(np.clip(x @ self.weights, -30, 30), n_lines, self.step)[0]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out, at = [], 0
        while at < len(texts):
            end, total = at, 0
            while end < len(texts) and (end == at or total < CHUNK):
                total += len(texts[end] or "")
                end += 1
            x, length, n = measure(texts[at:end])
            out.append(document_means(self.lines(x, n), length, n))
            at = end
        q = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * (q - 0.5) + self.offset, -30, 30)))


def document_means(good: np.ndarray, length: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    start = np.r_[0, np.cumsum(n_lines)[:-1]].astype(int)
    w = np.maximum(length, 1).astype(np.float64)
    return np.add.reduceat(good * w, start) / np.add.reduceat(w, start)


def _fit_field(m: Model, x: np.ndarray, n_lines: np.ndarray, label: np.ndarray) -> None:
    """Gradient ascent with Adam steps on the mean log-likelihood of a line."""
    inside = np.ones(len(label), bool)
    inside[np.r_[0, np.cumsum(n_lines)[:-1]].astype(int)] = False
    here = np.flatnonzero(inside)
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[here - 1], label[here]), 1)
    p = np.r_[m.weights, m.step.ravel()]
    mean, var = np.zeros_like(p), np.zeros_like(p)
    for k in range(1, ROUNDS + 1):
        good, steps, _ = forward_backward(np.clip(x @ p[:N_FEATURES], -30, 30), n_lines, p[N_FEATURES:].reshape(2, 2))
        g = np.r_[x.T @ (label - good), (seen - steps).ravel()] / len(label) - L2 * p
        mean, var = 0.9 * mean + 0.1 * g, 0.99 * var + 0.01 * g * g
        p = p + 0.3 / (1 + k / 50) * (mean / (1 - 0.9**k)) / (np.sqrt(var / (1 - 0.99**k)) + 1e-9)
    m.weights, m.step = p[:N_FEATURES], p[N_FEATURES:].reshape(2, 2)


def fit(x: np.ndarray, length: np.ndarray, n_lines: np.ndarray, quality: np.ndarray) -> Model:
    """The model of labelled documents; with none, every score is 1/2."""
    m = Model()
    if not len(quality):
        return m
    x = x.astype(np.float64)
    doc = np.repeat(np.arange(len(quality)), n_lines)
    label = quality[doc].astype(np.int64)
    _fit_field(m, x, n_lines, label)
    good = m.lines(x, n_lines)
    worst = np.minimum.reduceat(good, np.r_[0, np.cumsum(n_lines)[:-1]].astype(int))[doc]
    label = np.where((label == 0) & (good > 0.5) & (good > worst), 1, label)
    _fit_field(m, x, n_lines, label)
    q = document_means(m.lines(x, n_lines), length, n_lines) - 0.5
    a = np.stack([q, np.ones_like(q)], axis=1)
    c = np.zeros(2)
    for _ in range(50):  # Newton steps for the curve
        p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        g = a.T @ (quality - p) - 0.05 * c
        c = c + np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(2), g)
    m.slope, m.offset = float(c[0]), float(c[1])
    return m


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out. Null ids: 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(1))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of labelled rows outside the held-out fold: the first
    SAMPLE_DOCS labelled ids by their hash, less those whose lines would make the
    sample longer than SAMPLE_LINES lines. Of several rows with one doc_id, the text
    of the least hash is taken."""
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(SAMPLE_DOCS)
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for i, q, t in zip(df["doc_id"], df["quality"], df["text"], strict=True):
                x, length, n = measure([t])
                rows.append((i, q, int(n[0]), x.tobytes(), length.tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "quality", "n", "x", "length"])

    measured = cut(
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")  # at most SAMPLE_DOCS pairs of numbers
        .groupBy("doc_id", "quality")
        .agg(F.min(F.struct(F.xxhash64("text").alias("t"), "text")).alias("v"))
        .select("doc_id", "quality", "v.text")
        .mapInPandas(run, "doc_id bigint, quality int, n int, x binary, length binary")
    )
    taken, room = [], SAMPLE_LINES
    for r in measured.select("doc_id", "n").orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if r["n"] <= room:
            taken.append(r["doc_id"])
            room -= r["n"]
    got = measured.where(F.col("doc_id").isin(taken)).collect()
    got.sort(key=lambda r: r["doc_id"])
    if not got:
        return Model()
    return fit(
        np.concatenate([np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES) for r in got]),
        np.concatenate([np.frombuffer(r["length"], np.int64) for r in got]),
        np.array([r["n"] for r in got], np.int64),
        np.array([r["quality"] for r in got], np.float64),
    )


def score_column(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        return pd.Series(model.scores(s.tolist()), dtype="float64")

    return score(text)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    Scores come from the text alone. Defined cases: null and wordless texts are
    one empty line; a label that is null or neither 0 nor 1 is not learned from,
    the lesser of several labels of a doc_id is; without labels every score is
    1/2; null doc_ids count as not held out; repeated rows come back as they
    came; an empty table gives none; other columns are ignored.
    """
    model = train(docs, labels)
    scored = docs.select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), score_column(model, F.col("text")).alias("score")
    )
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all columns as
    they were. Null and wordless texts are scored as one empty line; repeated rows
    and null doc_ids are judged by their own text; an empty table stays empty."""
    return docs.where(score_column(train(docs, labels), F.col("text")) >= threshold)
