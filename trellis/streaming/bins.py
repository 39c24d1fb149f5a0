"""Event streams on a time grid. The batch engine has no stream of its own; this is an extension for unbounded input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import stencil as S
from ..spec import GridSpec


def binned(events: DataFrame, width: str, late: str, time: str = "ts", value: str = "value") -> DataFrame:
    """Sums and counts by time bin, with a watermark: a bin is final when no event of it may come."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w")).agg(F.sum(value).alias("v"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "v", "n")


def smoothed(bins: DataFrame, seconds: int, stencil: S.Stencil) -> DataFrame:
    """A finite set of bins with a one-axis stencil over them; bins without events count as zeros."""
    at = bins.select(F.expr(f"unix_timestamp(start) div {seconds}").alias("bin"), F.col("v").cast("double").alias("v"))
    lo, hi = at.agg(F.min("bin"), F.max("bin")).first()
    if lo is None:
        return bins.sparkSession.createDataFrame([], "bin long, v double, smooth double")
    spec = GridSpec((int(hi - lo) + 1, 1, 1), periodic=(False, False, False))
    grid = spec.dense(at.select((F.col("bin") - lo).cast("int").alias("x"), F.lit(0).alias("y"), F.lit(0).alias("z"), "v"))
    done = S.apply(grid, spec, {"smooth": (stencil, "v")}, ("v",))
    return done.select((F.col("x") + F.lit(lo)).cast("long").alias("bin"), "v", "smooth")


def each_batch(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    """Starts the stream with an action for each micro-batch."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(act).start()
