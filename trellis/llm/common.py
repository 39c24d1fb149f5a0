"""What several operators of this subpackage share: the shared folder, distributed running totals, components."""

from __future__ import annotations

import atexit
import contextlib
import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word, and white space, of the contracts: ASCII white space only.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of a window of running_total, about.
BUCKET_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local runs that leave it unset, a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _local_dir()
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@functools.cache
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="trellis-")


def scratch_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes when the driver's Python ends."""
    return _scratch(spark.sparkContext.applicationId, shared_dir(spark))


@functools.cache
def _scratch(application: str, shared: str) -> str:
    path = f"{shared}/trellis-{application}"
    atexit.register(lambda: _remove(SparkSession.getActiveSession(), path))
    return path


def _remove(spark: SparkSession | None, path: str) -> None:
    if spark is None:
        return
    with contextlib.suppress(Exception):  # what can't be removed does no harm
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder as Parquet and read again: lineage ends there, and no lost executor makes it be computed anew."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes staged tables that nothing reads any more. Loops call it for the state that the next one has replaced."""
    for t in tables:
        _remove(t.sparkSession, t._staged_at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def unit_hash(*columns, seed: int = 0) -> Column:
    """A number in [0, 1) that looks random and depends on the columns and the seed only."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double")) / F.lit(float(1 << 53))


def numbered(rows: DataFrame, columns: list[str], out: str) -> DataFrame:
    """rows, staged, with out: 0, 1, 2, ... for rows that are alike in the columns.

    Rows are numbered within each part of the table first and parts' counts are added up, so rows that are all alike, however
    many, are no window of one task. Which of the rows that are alike gets which number is open, and makes no difference.
    """
    d = rows.select("*", F.xxhash64(*columns).alias("_like"), F.spark_partition_id().alias("_part"))
    d = staged(d, "parts")
    inside = F.row_number().over(Window.partitionBy("_like", "_part").orderBy("_like")) - 1
    each = d.groupBy("_like", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_like").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = each.select("_like", "_part", before.alias("_before")).where("_before > 0")
    d = d.withColumn("_inside", inside).join(offsets, ["_like", "_part"], "left")
    return d.withColumn(out, F.col("_inside") + F.coalesce("_before", F.lit(0))).drop("_like", "_part", "_inside", "_before")


def bucket_count(rows: int) -> int:
    return max(256, rows // BUCKET_ROWS)


def running_total(df: DataFrame, group: list[str], unit: str, order: list[str], value: str, out: str, buckets: int) -> DataFrame:
    """Adds out: the sum of value over the rows of the group that come before in the order of (unit, *order).

    unit is a column in [0, 1) that spreads each group's rows evenly. Rows are cut into buckets by it; sums per
    (group, bucket) are pre-aggregated, their running totals come from that small table, and a window over one bucket
    does the rest. So no task holds a group, however large the group is. group must hold no nulls.
    """
    d = df.withColumn("_b", F.least(F.floor(F.col(unit) * buckets).cast("int"), F.lit(buckets - 1)))
    keys = [*group, "_b"]
    sums = d.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    w = (Window.partitionBy(*group) if group else Window.partitionBy()).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys).orderBy(unit, *order).rowsBetween(Window.unboundedPreceding, -1)
    return d.join(offsets, keys).withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_b", "_before")


def in_order(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """df with a column for each of sums {out: value}: the total of value over all rows that come before in the order.

    Ranges of the order are parts of a written table; windows run over one part, and parts' totals (one row for each part) are
    added up. Rows must differ in the order's columns.
    """
    d = staged(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy("_part").agg(*(F.sum(v).alias(f"_{o}") for o, v in sums.items()))
    before = totals.select("_part", *(F.coalesce(F.sum(f"_{o}").over(parts), F.lit(0)).alias(f"_{o}") for o in sums))
    d = d.select("*", *(F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(o) for o, v in sums.items())).join(before, "_part")
    return d.withColumns({o: F.col(o) + F.col(f"_{o}") for o in sums}).drop("_part", *(f"_{o}" for o in sums))


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) to (node, component): the smallest node reachable, for every node on an edge.

    Alternates large-star and small-star steps; each is one aggregation and one join, so a node with very many
    neighbours is no group in one task. Ends when the edges stay as they are. Loops and repeated edges do no harm.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        last, now = now, staged(small.where("a <> b").distinct(), "edges")
        dropped(last)
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b"), F.col("b")).distinct())
