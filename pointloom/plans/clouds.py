"""Point clouds read from the standard tables, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def embedding_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y, z from the first three dimensions, nx, ny, nz from the next three
    at unit length, label. Doubles before any arithmetic."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    d = [F.col("embedding")[k].cast("double") for k in range(6)]
    length = F.sqrt(d[3] * d[3] + d[4] * d[4] + d[5] * d[5])
    return e.select(
        F.col("vec_id").alias("id"), d[0].alias("x"), d[1].alias("y"), d[2].alias("z"),
        (d[3] / length).alias("nx"), (d[4] / length).alias("ny"), (d[5] / length).alias("nz"), "label",
    )


EMB_SQL = """
emb AS (SELECT id, x, y, z, a / l AS nx, b / l AS ny, c / l AS nz, label FROM (
  SELECT *, sqrt(a * a + b * b + c * c) AS l FROM (
    SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z,
      CAST(embedding[4] AS DOUBLE) AS a, CAST(embedding[5] AS DOUBLE) AS b, CAST(embedding[6] AS DOUBLE) AS c, label FROM embeddings)))"""


def lineitem_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x = quantity, y = 100 discounts, z = thousandths of the price; no id."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select(
        F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_extendedprice") / 1000).alias("z"),
        (F.col("l_extendedprice") / 10000).alias("h"),
    )


LINE_SQL = "line AS (SELECT l_quantity AS x, l_discount * 100 AS y, l_extendedprice / 1000 AS z, l_extendedprice / 10000 AS h FROM lineitem)"
