"""SimHash near-dedup with pivot distance tables.

A text's fingerprint has a bit set where over half of the hashes of its word shingles have it set. Two fingerprints are
linked if at most `radius` bits differ; groups are the components of the links.

Pivot table. Each distinct fingerprint has a row of Hamming distances to reference fingerprints: a base pattern, 32 patterns
that differ from it in two neighbouring bits each, and random ones. By the triangle inequality the rows of linked fingerprints
differ by `radius` at most in every coordinate. Distances to random references are all near 32 and tell little, so the table is
searched by the others: a bit that differs moves the distance to the base and that to one reference apart, and no other, so of
the 32 differences to the base's distance at most 2 change. In 4 groups of 8 at least 2 groups are equal: candidates
are the fingerprints that share the distances of two groups, found by a join on the table's columns, six keys for each. A pair
with a coordinate more than `radius` apart is discarded; those that survive are verified bit by bit.

A key shared by more than `most` fingerprints isn't paired up. Its fingerprints are linked exactly by way of
their neighbours: two are at most 2 apart if and only if some pattern is at most 1 from either. Such a pattern has 65
fingerprints around it at most, each is linked to the least of them, and no pairs are made.

similar() and cleaned() are the operator for word shingles and a similarity; see simhash_wide.

Defined cases: a null or blank text has fingerprint zero and is linked like any other; of fewer words than a shingle has,
the whole sequence is the one shingle; rows repeated are linked like others; a component's id is its smallest doc_id, nulls
passed over; an empty table gives an empty result. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import functools
import random
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, staged, table

RADIUS = 2
BITS = 64
#: References beside the base that differ from it in neighbouring bits, groups that their coordinates are in, and random references.
NEAR, GROUPS, RANDOM = 32, 4, 12
#: Fingerprints of one key that are paired up; beyond that, the way by neighbours.
MOST = 64


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """bytes.split() splits at ASCII white space only, and bytes.lower() lower-cases A-Z only."""
    import xxhash

    w = text.lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype=np.uint64)
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", words, seed) for x in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64), pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@functools.cache
def references(near: int = NEAR, other: int = RANDOM, seed: int = 7) -> list[int]:
    """The base, `near` patterns that differ from it in one block of bits each, and random ones, as longs."""
    draw = random.Random(seed)
    base, width = draw.getrandbits(BITS), BITS // near
    block = (1 << width) - 1
    return [_signed(x) for x in (base, *(base ^ block << width * k for k in range(near)), *(draw.getrandbits(BITS) for _ in range(other)))]


def pivot_row(fp: str = "fp") -> Column:
    """A row of the pivot table: distances to the references."""
    return F.array(*(F.bit_count(F.col(fp).bitwiseXOR(F.lit(r))).cast("byte") for r in references()))


def candidate_keys(row: str = "row") -> Column:
    """For two groups of coordinates each, a number that is equal if and only if all their distances to the base's distance are."""
    at = lambda k: (F.element_at(row, k + 2).cast("long") - F.element_at(row, 1).cast("long")) / 2 + 1  # noqa: E731  0, 1 or 2
    size = NEAR // GROUPS
    groups = [sum((at(g * size + k).cast("long") * 3**k for k in range(1, size)), at(g * size).cast("long")) for g in range(GROUPS)]
    return F.array(*(a * 3**size + b for a, b in combinations(groups, 2)))


def links(fps: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b) that have the same components as all pairs at most radius bits apart."""
    if radius != RADIUS:
        raise ValueError("groups of coordinates and neighbours are chosen for 2 bits")
    keyed = fps.select("fp", pivot_row().alias("row")).select("fp", F.posexplode(candidate_keys()).alias("pair", "key"))
    counts = keyed.groupBy("pair", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = staged(keyed.join(counts, ["pair", "key"]), "shared")
    small = shared.where(F.col("n") <= most).select("pair", "key", "fp", pivot_row().alias("row"))
    other = small.withColumnsRenamed({"fp": "b", "row": "other"})
    far = F.exists(F.zip_with("row", "other", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), lambda d: d > radius)
    pairs = small.join(other, ["pair", "key"]).where((F.col("fp") < F.col("b")) & ~far & (_apart("fp", "b") <= radius)).select(F.col("fp").alias("a"), "b")
    crowd = shared.where(F.col("n") > most).select("fp").distinct()
    near = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(BITS)))
    around = crowd.select("fp", F.explode(near).alias("near"))
    least = F.min("fp").over(Window.partitionBy("near"))
    hubs = around.select(F.col("fp").alias("b"), least.alias("a")).where("a <> b").select("a", "b")
    return pairs.unionAll(hubs).distinct()


def groups(prints: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """(doc_id, fp) to doc_id, fp, component_id."""
    prints = staged(prints, "fingerprints")
    reps = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    found = components(links(reps.select("fp"), radius, most))
    named = reps.join(found, reps.fp == found.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_fp = staged(named.join(least, "component").select("fp", "component_id"), "components")  # so that the join can split a fingerprint that very many rows have
    return prints.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def similar(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id, component_id: documents linked if their sets of word shingles have a Jaccard similarity of at least `least`."""
    from .simhash_wide import groups as wide

    return wide(docs, words, least).select("doc_id", "component_id")


def cleaned(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """One document of each group of similar ones, that with the smallest doc_id; of rows with one id and text, that with the least other columns."""
    stay = similar(docs, words, least).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__near_stays")).distinct()
    d = docs.join(stay, docs.doc_id == stay["__near_stays"])
    plain = [F.col(f"`{f.name}`").cast("string") for f in docs.schema.fields if f.name != "text"]
    order = Window.partitionBy("__near_stays", F.xxhash64("text")).orderBy(*plain)
    d = d.withColumn("__near_n", F.row_number().over(order)).where("__near_n = 1")
    return d.select(*(f"`{c}`" for c in docs.columns))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(fingerprints(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
