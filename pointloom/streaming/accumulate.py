"""Progressive refinement as streams of ensembles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_mean(samples: DataFrame) -> DataFrame:
    """Streaming or batch ``(version, px, py, r, g, b)`` to the mean of each pixel.
    The state is one row a pixel and version: sums and a count; use output mode
    ``update`` or ``complete``. A change of any image parameter is a new version,
    so old samples never mix in."""
    return samples.groupBy("version", "px", "py").agg(
        *[F.avg(c).alias(c) for c in "rgb"], F.count(F.lit(1)).alias("samples")
    )


def version_key(params: dict) -> int:
    """A key that changes with any image parameter; the budget of ensembles a frame
    and their target don't count."""
    import hashlib

    kept = sorted((k, repr(v)) for k, v in params.items() if k not in ("ensembles_per_frame", "target_ensembles"))
    return int.from_bytes(hashlib.blake2b(repr(kept).encode(), digest_size=8).digest(), "big", signed=True)


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events in windows, closed by a watermark. A stream's
    watermark needs instants: its local times are taken in the session's zone."""
    if events.isStreaming and events.schema["ts"].dataType.simpleString() == "timestamp_ntz":
        events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def profile_map(df: DataFrame, col: str = "profile") -> DataFrame:
    """``key=value;...`` records as a map."""
    return df.withColumn("metrics", F.expr(f"str_to_map({col}, ';', '=')"))


def ensembles_left(mode: str, done: int, per_frame: int, target: int) -> int:
    """Ensembles the next frame may add: one a frame when off, else up to 8 at a time and
    none beyond the target; raising the target goes on."""
    if mode == "off":
        return 1
    return max(0, min(max(1, min(8, per_frame)), target - done))


def reusable(reset: bool, calibration: str, compact: bool, drift: float, bound: float) -> bool:
    """Whether a kept set of particles may be projected anew in place of sampling."""
    return not reset and calibration == "none" and compact and drift <= bound
