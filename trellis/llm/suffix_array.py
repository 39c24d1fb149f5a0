"""Suffix arrays of many sequences by distributed prefix doubling, their longest common prefixes and the intervals of these.

Ranks. A class of suffixes that agree on their first k items has the number of suffixes in classes before it as its rank. A
round makes depth 2k of depth k: a suffix's pair is its rank and that of the suffix k items further on; pairs are counted, map
side first, put in order by ranges, and get their places within the rank they share so far. A suffix is done when its class is
its own, or when its sequence ends within 2k items; sequences with no other suffixes leave, so a round handles what still
repeats. Rounds end when all are done: log2 of the longest repeated run. A rank that is done is no other class's in later rounds.

Common prefixes. Neighbours in the array are taken back through the rounds' pairs: where the first ranks differ, these go on
to the round before; where they agree, k items are common and the second ranks go on. Intervals are stretches of neighbours with
`least` common items or more. Each is a maximal repeat; its depth is the least of its common prefixes.

DataFrame functions only. No window has more rows than one sequence, one range of an order or one row per range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dropped, in_order, staged

#: Second ranks of suffixes that end, and of those that go on with an item found once.
ENDS, ALONE = -1, -2


def place() -> Column:
    """Order of suffixes of different sequences: by doc, null last."""
    return F.struct(F.col("doc").isNull().alias("last"), F.col("doc").alias("doc"), F.col("key").alias("key"), F.col("pos").alias("pos"))


def is_first() -> Column:
    return F.col("first.doc").eqNullSafe(F.col("doc")) & (F.col("first.key") == F.col("key")) & (F.col("first.pos") == F.col("pos"))


def _doubled(active: DataFrame, k: int, level: int) -> tuple[DataFrame, DataFrame]:
    """Suffixes ranked at depth k to (suffixes at depth 2k, pairs (rank, one, two))."""
    whole = Window.partitionBy("key", "doc")
    rows = active.withColumn("_open", F.max(~F.col("done")).over(whole)).withColumn("_next", F.first("rank").over(whole.orderBy("pos").rangeBetween(k, k))).where("_open")
    two = F.when(F.col("left") == k, ENDS).otherwise(F.coalesce("_next", F.lit(ALONE))).cast("long")
    rows = rows.withColumn("two", two).drop("_open", "_next")
    rows = staged(rows.withColumn("hole", F.when(F.col("two") == ALONE, F.struct("key", "doc", "pos"))), "pairs")
    todo = rows.where("NOT done").withColumnRenamed("rank", "one").drop("done", "born")
    counted = todo.groupBy("one", "two", "hole").agg(F.count(F.lit(1)).alias("n"))
    pairs = in_order(counted, ["one", "two", "hole"], {"_before": "n"})
    starts = pairs.groupBy("one").agg(F.min("_before").alias("_start"))
    pairs = staged(pairs.join(starts, "one").select("one", "two", "hole", "n", (F.col("one") + F.col("_before") - F.col("_start")).alias("rank")), "ranks")
    same = (F.col("t.one") == F.col("p.one")) & (F.col("t.two") == F.col("p.two")) & F.col("t.hole").eqNullSafe(F.col("p.hole"))
    new = todo.alias("t").join(pairs.alias("p"), same).select("doc", "key", "pos", "left", "rank", ((F.col("n") == 1) | (F.col("left") < 2 * k)).alias("done"))
    old = rows.where("done").select("doc", "key", "pos", "left", "rank", "done", "born")
    out = staged(new.withColumn("born", F.lit(level)).unionByName(old), "suffixes")
    dropped(rows)
    return out, pairs.select("rank", "one", "two")


def build(items: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """items (doc, key, pos, left, rank: of items found twice or more) to the array's suffixes (doc, key, pos, left, rank, born), and each round's pairs."""
    active = items.select("doc", "key", "pos", "left", "rank", F.lit(False).alias("done"), F.lit(0).alias("born"))
    found, rounds, k = [], [], 1
    while True:
        level = len(rounds) + 1
        active, pairs = _doubled(active, k, level)
        rounds.append(pairs)
        found.append(active.where((F.col("born") == level) & F.col("done")).drop("done"))
        if active.where("NOT done").isEmpty():
            return reduce(DataFrame.unionByName, found), rounds
        k *= 2


def _common(neighbours: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """neighbours (rank, x, y, at) to (rank, common): items that the classes x and y of round `at` have in common."""
    now = None
    for level in range(len(rounds), 0, -1):
        pairs, k = rounds[level - 1], 1 << (level - 1)
        own = neighbours.where(F.col("at") == level).select("rank", "x", "y", F.lit(0).cast("long").alias("common"))
        now = own if now is None else now.unionByName(own)
        a = pairs.select(F.col("rank").alias("x"), F.col("one").alias("x1"), F.col("two").alias("x2"))
        b = pairs.select(F.col("rank").alias("y"), F.col("one").alias("y1"), F.col("two").alias("y2"))
        both = F.coalesce(F.col("x1") == F.col("y1"), F.lit(False))
        now = now.join(a, "x", "left").join(b, "y", "left")
        now = staged(now.select(
            "rank", F.when(both, F.col("x2")).otherwise(F.coalesce("x1", "x")).alias("x"), F.when(both, F.col("y2")).otherwise(F.coalesce("y1", "y")).alias("y"),
            (F.col("common") + F.when(both, k).otherwise(0)).alias("common")), "common")
    return now.select("rank", "common")


def repeats(items: DataFrame, least: int) -> DataFrame:
    """(doc, key, pos, depth, first): suffixes in intervals of `least` common items or more, the interval's depth and its first place."""
    suffixes, rounds = build(items)
    suffixes = suffixes.where(F.col("left") >= least)
    classes = suffixes.groupBy("rank").agg(F.count(F.lit(1)).alias("n"), F.max("born").alias("born"), F.min("left").alias("left"), F.min(place()).alias("first"))
    classes = staged(classes.repartitionByRange("rank").withColumn("_part", F.spark_partition_id()), "array")
    line = Window.partitionBy("_part").orderBy("rank")
    earlier = Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    before = classes.groupBy("_part").agg(F.max(F.struct("rank", "born")).alias("_last")).select("_part", F.max("_last").over(earlier).alias("_last"))
    pairs = classes.select("_part", "rank", "born", F.lag(F.struct("rank", "born")).over(line).alias("_prev")).join(before, "_part")
    pairs = pairs.withColumn("_prev", F.coalesce("_prev", "_last")).where("_prev IS NOT NULL")
    neighbours = staged(pairs.select("rank", F.col("rank").alias("y"), F.col("_prev.rank").alias("x"), F.greatest("born", "_prev.born").alias("at")), "neighbours")
    c = classes.join(_common(neighbours, rounds), "rank", "left").withColumn("_cut", F.coalesce(F.col("common") < least, F.lit(True)))
    c = staged(c, "prefixes")
    begun = F.max(F.when(F.col("_cut"), F.col("rank")))
    carried = c.groupBy("_part").agg(begun.alias("_b")).select("_part", F.max("_b").over(earlier).alias("_b"))
    c = c.withColumn("_in", begun.over(line.rowsBetween(Window.unboundedPreceding, 0))).join(carried, "_part")
    c = staged(c.select("rank", "n", "left", "first", "common", "_cut", F.coalesce("_in", "_b").alias("interval")), "classes")
    depth = F.min(F.least("left", F.when(~F.col("_cut"), F.col("common"))))
    intervals = c.groupBy("interval").agg(F.sum("n").alias("_n"), F.min("first").alias("first"), depth.alias("depth")).where("_n > 1").drop("_n")
    known = staged(c.select("rank", "interval").join(intervals, "interval").select("rank", "first", "depth"), "intervals")
    return suffixes.select("doc", "key", "pos", "rank").join(known, "rank").drop("rank")
