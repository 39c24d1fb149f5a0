"""Tables to grids: aggregate rows to cells, fill up the cells that have none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import GridSpec

SIDE = 16
LINES = GridSpec((SIDE, SIDE, SIDE))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem on a periodic 16 x 16 x 16 grid of keys. Fields are whole numbers: f quantity, g rows, h line numbers, w discount percents."""
    d = read(spark, sf_dir, "lineitem")
    key = lambda c, a: F.pmod(F.col(c), F.lit(SIDE)).cast("int").alias(a)
    cells = d.groupBy(key("l_partkey", "x"), key("l_suppkey", "y"), key("l_orderkey", "z")).agg(
        F.sum(F.round("l_quantity").cast("long")).cast("double").alias("f"),
        F.count(F.lit(1)).cast("double").alias("g"),
        F.sum(F.col("l_linenumber").cast("long")).cast("double").alias("h"),
        F.sum(F.round(F.col("l_discount") * 100).cast("long")).cast("double").alias("w"),
    )
    return LINES.dense(cells)


GRID = f"""cells AS (
  SELECT CAST(l_partkey % {SIDE} AS INTEGER) AS x, CAST(l_suppkey % {SIDE} AS INTEGER) AS y, CAST(l_orderkey % {SIDE} AS INTEGER) AS z,
    CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS DOUBLE) AS f, CAST(count(*) AS DOUBLE) AS g,
    CAST(sum(CAST(l_linenumber AS BIGINT)) AS DOUBLE) AS h, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) AS w
  FROM lineitem GROUP BY 1, 2, 3
), grid AS (
  SELECT k.x, k.y, k.z, coalesce(f, 0) AS f, coalesce(g, 0) AS g, coalesce(h, 0) AS h, coalesce(w, 0) AS w
  FROM (SELECT CAST(a.range AS INTEGER) AS x, CAST(b.range AS INTEGER) AS y, CAST(c.range AS INTEGER) AS z FROM range({SIDE}) a, range({SIDE}) b, range({SIDE}) c) k
  LEFT JOIN cells USING (x, y, z)
)"""


def event_grid(spark: SparkSession, sf_dir: str, seconds: int = 3600) -> tuple[DataFrame, GridSpec]:
    """events on a line of time bins: v cents, n rows. Bins without events are there, with zeros."""
    bin_ = F.expr(f"unix_timestamp(ts) div {seconds}")
    d = read(spark, sf_dir, "events").groupBy(bin_.alias("bin")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).cast("double").alias("v"), F.count(F.lit(1)).cast("double").alias("n"))
    lo, hi = d.agg(F.min("bin"), F.max("bin")).first()
    spec = GridSpec((int(hi - lo) + 1 if lo is not None else 1, 1, 1), periodic=(False, False, False))
    cells = d.select((F.col("bin") - F.lit(lo)).cast("int").alias("x"), F.lit(0).alias("y"), F.lit(0).alias("z"), "v", "n")
    return spec.dense(cells), spec
