"""Progress of long operators, and a way to stop them.

Operators that go in rounds cut their lineage behind each one; every cut is a step
that is reported to whoever listens, and at which a stopped run ends.
"""

from __future__ import annotations

import contextvars
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Cancelled(RuntimeError):
    """The run was stopped by its ``Progress``."""


class Progress:
    """Counts the steps of what runs inside ``reporting``; ``cancel`` may be called from any thread."""

    def __init__(self, listen: Callable[[int, str], None] | None = None) -> None:
        self.steps, self._listen, self._stopped = 0, listen, threading.Event()
        self.group = f"pointloom-{uuid.uuid4().hex}"
        self._spark: SparkSession | None = None

    def step(self, what: str) -> None:
        if self._stopped.is_set():
            raise Cancelled(f"stopped before step {self.steps + 1}: {what}")
        self.steps += 1
        if self._listen:
            self._listen(self.steps, what)

    def cancel(self) -> None:
        """End the run at its next step, and the jobs it has running at once."""
        self._stopped.set()
        if self._spark is not None:
            self._spark.sparkContext.cancelJobGroup(self.group)


_now: contextvars.ContextVar[Progress | None] = contextvars.ContextVar("pointloom_progress", default=None)


@contextmanager
def reporting(spark: SparkSession, progress: Progress) -> Iterator[Progress]:
    """Report the steps of the operators called inside to ``progress``."""
    progress._spark = spark
    token = _now.set(progress)
    spark.sparkContext.setJobGroup(progress.group, "pointloom", interruptOnCancel=True)
    try:
        yield progress
    finally:
        _now.reset(token)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def step(what: str) -> None:
    if (p := _now.get()) is not None:
        p.step(what)
