"""Sharding by proportional stratified interleaving.

Within each source, rows are ranked in a seeded shuffle; the fractional rank (rank + 1/2) / n spreads every source evenly
over [0, 1). All rows sorted by it form one sequence in which any stretch has the mixture of the whole; cut into equal
stretches, every shard has it too. Row counts of shards differ by one at most (law `rows`).

Defined cases: null texts have no bytes; a null source is a source of its own; repeated rows are rows like others,
each with a place in the shuffle of its own;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_count, numbered, running_total, staged, table, text_of, unit_hash

SHARDS = 16
SEED = 29


def shards(docs: DataFrame, n: int = SHARDS, seed: int = SEED, buckets: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; one row per row of docs."""
    if n < 1:
        raise ValueError("at least one shard")
    text = F.encode(text_of(), "UTF-8")
    rows = docs.select("doc_id", F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("_src"), (F.octet_length(text_of()) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = numbered(rows, ["_null", "_src", "doc_id", "size", "text_crc32"], "_copy")
    rows = staged(rows.withColumn("_u", unit_hash("doc_id", "text_crc32", "_copy", seed=seed)).withColumn("_one", F.lit(1).cast("long")), "rows")
    total = max(1, rows.count())
    buckets = buckets or bucket_count(total)
    counts = rows.groupBy("_null", "_src").agg(F.sum("_one").alias("_n"))
    ranked = running_total(rows, ["_null", "_src"], "_u", ["doc_id", "text_crc32", "size", "_copy"], "_one", "_rank", buckets).join(counts, ["_null", "_src"])
    ranked = staged(ranked.withColumn("_f", (F.col("_rank") + 0.5) / F.col("_n")), "ranked")
    placed = running_total(ranked, [], "_f", ["_null", "_src", "_u", "doc_id", "_rank"], "_one", "_place", buckets)
    placed = placed.withColumn("_shard", F.expr(f"(_place * {n}) div {total}L"))
    first = F.expr(f"(_shard * {total}L + {n - 1}) div {n}")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").cast("int").alias("shard"), (F.col("_place") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))
