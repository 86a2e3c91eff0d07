"""Lineage cuts and the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from . import progress


def shared_dir(spark: SparkSession) -> str:
    """The folder that every node can reach: spark.checkpoint.dir, or the
    context's own checkpoint folder, or (only where neither is set and driver and
    tasks are one process, as in tests) a new temporary one."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="pointloom-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written rows, so
    that lineage stays short and a lost executor costs no recomputation. A step of
    whatever ``progress`` reports."""
    spark = df.sparkSession
    progress.step("cut")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
