"""Level of detail of a viewer as a state machine over time-stamped frames."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MOVING, SETTLING, REFINING, CONVERGED = "Moving", "Settling", "Refining", "Converged"


@dataclass
class LodController:
    """Moving while the camera moves; Settling until it has rested for ``settle_ms``;
    Refining while repeats grow by frame times; Converged at ``target``."""

    settle_ms: float = 100.0
    low_ms: float = 20.0
    high_ms: float = 40.0
    target: int = 64
    most: int = 8
    state: str = MOVING
    repeats: int = 1
    total: int = 0
    rested_ms: float = 0.0

    def step(self, moved: bool, frame_ms: float) -> str:
        if moved:
            self.state, self.repeats, self.total, self.rested_ms = MOVING, 1, 0, 0.0
            return self.state
        self.rested_ms += frame_ms
        if self.state in (MOVING, SETTLING):
            self.state = REFINING if self.rested_ms >= self.settle_ms else SETTLING
            return self.state
        if self.state == CONVERGED and self.total < self.target:
            self.state = REFINING
        if self.state == REFINING:
            if frame_ms < self.low_ms:
                self.repeats = min(self.most, self.repeats + 1)
            elif frame_ms > self.high_ms:
                self.repeats = max(1, self.repeats - 1)
            self.total = min(self.target, self.total + self.repeats)
            if self.total >= self.target:
                self.state = CONVERGED
        return self.state


def lod_states(frames: DataFrame, settle_ms: float = 100.0, low_ms: float = 20.0, high_ms: float = 40.0, target: int = 64) -> DataFrame:
    """Streaming ``(viewer, seq, moved, frame_ms)`` to the state after each frame;
    the controller of each viewer is kept as the stream's state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        c = LodController(settle_ms, low_ms, high_ms, target)
        if kept.exists:
            c.state, c.repeats, c.total, c.rested_ms = kept.get
        for df in batches:
            df = df.sort_values("seq")
            rows = [(key[0], int(s), c.step(bool(m), float(f)), c.repeats, c.total) for s, m, f in zip(df["seq"], df["moved"], df["frame_ms"], strict=True)]
            yield pd.DataFrame(rows, columns=["viewer", "seq", "state", "repeats", "total"])
        kept.update((c.state, c.repeats, c.total, c.rested_ms))

    return frames.groupBy("viewer").applyInPandasWithState(
        run, "viewer string, seq bigint, state string, repeats int, total int",
        "state string, repeats int, total int, rested double", "append", GroupStateTimeout.NoTimeout,
    )
