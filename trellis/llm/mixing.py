"""Mixing sources to target weights: a time-varying curriculum.

Every source gets a target number of words: its weight's share of the budget, stopped at a number of times its own size,
the excess shared again by weight. Documents of a source are put in a seeded order; its demand runs through that order,
and through it again, until the target is met. A source's weight changes over training time t in [0, 1] by a schedule, straight
between given times; its integral is the cumulative demand, and inverting that at a document's place in the demand gives the document's
training position. Documents are range-sorted by position.

Native: DataFrame functions only. Defined cases: a null text has size 0; a null source is a source of its own, last;
sources and documents without words take nothing and have no position; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, bucket_count, in_order, numbered, running_total, staged, table, text_of, unit_hash

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
MOST = 2
RAMP = 0.5
SEED = 17


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """(_null, _src, _k, source_size, target) for each source.

    In order of cap / weight, a source is capped if the level that the others would reach is at or above its own; the
    level at the first that isn't capped holds for all that follow. Sources may be very many: both orders are ranges of a table.
    """
    s = sized.groupBy("_null", "_src").agg(F.sum("size").alias("source_size")).withColumn("_one", F.lit(1).cast("long"))
    s = in_order(s, ["_null", "_src"], {"_k": "_one"})
    s = s.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_k") % len(weights) + 1).cast("int")))
    s = s.withColumn("_cap", F.col("source_size") * F.lit(float(most))).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    s = staged(in_order(s, ["_ratio", "_k"], {"_capped": "_cap", "_before": "_w"}), "targets")
    size, weight = s.agg(F.sum("source_size"), F.sum("_w")).first()
    level = (F.lit(float(size or 0)) * budget - F.col("_capped")) / (F.lit(float(weight or 0)) - F.col("_before"))
    free = s.where(level < F.col("_ratio")).agg(F.min_by(level, F.struct("_ratio", "_k"))).first()[0]
    target = F.col("_cap") if free is None else F.least(F.col("_cap"), F.col("_w") * F.lit(free))
    return s.select("_null", "_src", "_k", "source_size", target.alias("target"))


def position_of(done: Column, knots: list[Column]) -> Column:
    """The time at which a source has met the part `done` of its demand, when its weight runs straight from knot to knot over [0, 1].

    The integral of the weight is a quadratic in each stretch; the one that holds the demand is inverted.
    """
    n = len(knots) - 1
    areas = [(a + b) / 2 for a, b in zip(knots, knots[1:])]
    left = done * sum(areas[1:], areas[0])
    out = None
    for i in range(n - 1, -1, -1):
        y = F.greatest(left - sum(areas[:i], F.lit(0.0)), F.lit(0.0))
        a, bend = knots[i], knots[i + 1] - knots[i]
        u = F.try_divide(2.0 * y, a + F.sqrt(F.greatest(a * a + 2.0 * bend * y, F.lit(0.0))))
        at = F.least((F.coalesce(u, F.lit(0.0)) + i) / n, F.lit(1.0))
        out = at if out is None else F.when(left <= sum(areas[1 : i + 1], areas[0]), at).otherwise(out)
    return out


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST, ramp: float = RAMP, seed: int = SEED, buckets: int | None = None,
    schedules: Mapping[str | None, Sequence[float]] | None = None,
) -> DataFrame:
    """doc_id, size, source_size, target, taken, laps (array of words taken and position, one for each time round), in order of first position.

    schedules: by source, its weight over time at equally spaced times from 0 to 1, not negative and not all 0; all of one length. Sources that
    aren't named go from 1 + ramp to 1 - ramp and the other way, in turn.
    """
    if most != int(most) or most < 1:
        raise ValueError("most is a whole number of laps")
    schedules = dict(schedules or {})
    n = {len(v) for v in schedules.values()} or {2}
    if len(n) > 1 or min(n) < 2 or any(min(v) < 0 or not max(v) for v in schedules.values()):
        raise ValueError("schedules have one length, two weights at least, none below 0 and not all 0")
    n = n.pop()
    sized = docs.select("doc_id", F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("_src"), F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("_key"))
    sized = numbered(sized, ["_null", "_src", "doc_id", "size"], "_copy")
    sized = staged(sized.withColumn("_u", unit_hash("doc_id", "size", "_copy", seed=seed)), "sizes")
    placed = running_total(sized, ["_null", "_src"], "_u", ["doc_id", "size", "_copy"], "size", "_at", buckets or bucket_count(sized.count()))
    placed = placed.join(targets(sized, weights, budget, most), ["_null", "_src"])
    side = F.when(F.col("_k") % 2 == 0, 1.0).otherwise(-1.0) * ramp
    knots = []
    for i in range(n):
        c = F.lit(1.0) + side * (1 - 2 * i / (n - 1))
        for source, line in schedules.items():
            c = F.when(F.col("_null") if source is None else ~F.col("_null") & (F.col("_src") == source), float(line[i])).otherwise(c)
        knots.append(c.alias(f"_w{i}"))
    placed = placed.select("*", *knots)

    def lap(i):
        start = F.col("_at") + F.col("source_size") * i
        words = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - start)).cast("long")
        at = F.when(words > 0, position_of(start / F.col("target"), [F.col(f"_w{i}") for i in range(n)]))
        return F.struct(words.alias("words"), at.alias("position"))

    laps = F.filter(F.array(*(lap(i) for i in range(int(most)))), lambda x: x.words > 0)
    placed = placed.withColumn("laps", laps).withColumn("position", F.when(F.size("laps") > 0, F.col("laps")[0].position))
    taken = F.aggregate("laps", F.lit(0).cast("long"), lambda a, x: a + x.words)
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "laps", "position", "_key").orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, in order of training position; columns as in docs.

    Where a source's demand ends within a document, the copy has the words up to there, joined by spaces. Rows repeated as
    a whole are one row that is taken for all of them.
    """
    same = ["__mix_key", "__mix_id", "__mix_no"]  # plain keys, so that the join's exchange, the only one of texts before the sort, serves the window too
    known = lambda d, key: d.withColumns({"__mix_key": key, "__mix_id": F.coalesce(d.doc_id.cast("string"), F.lit("")), "__mix_no": d.doc_id.isNull()})
    chosen = known(mix(docs, **settings).where(F.size("laps") > 0), F.col("_key"))
    chosen = chosen.groupBy(*same).agg(F.flatten(F.collect_list("laps")).alias("__mix_laps"), F.first("size").alias("__mix_size"))
    d = known(docs, F.xxhash64("doc_id", "text")).join(chosen, same)
    d = d.withColumn("__mix_n", F.row_number().over(Window.partitionBy(*same).orderBy("__mix_size"))).where("__mix_n = 1")
    d = d.withColumn("__mix_lap", F.explode("__mix_laps"))
    text = F.when(F.col("__mix_lap.words") >= F.col("__mix_size"), F.col("text")).otherwise(F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})")), F.lit(1), F.col("__mix_lap.words").cast("int")), " "))
    d = d.withColumn("text", text).orderBy("__mix_lap.position", "__mix_key")
    return d.select(*(f"`{c}`" for c in docs.columns))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position")
