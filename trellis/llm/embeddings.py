"""Embedding near-dedup by Euclidean p-stable hashing.

Vectors are normalised; a hash is floor((a.v + b) / width) with normal a and uniform b; a table's key joins `k` hashes.
At cosine 0.9 two unit vectors are sqrt(0.2) apart, which sets the chance that they share a key; k follows the number of
vectors, so that a key has some tens of unrelated ones, and the number of tables follows k and the wanted recall.

Most of what shares a key is unrelated, so vectors don't travel with every key. First a row of a key is an id and SKETCH sign bits of
further projections; of a bucket go on only those that have another one whose bits differ in as few places as a link's may
(a link is lost there with a probability below 0.000001). Then vectors are fetched for these alone, and pairs in one bucket
are checked by exact cosines in double precision, block by block. A pair that shares keys in several
tables counts in the first of them only. A bucket gives out, for each vector, its number of links and the least vector
of its part: never its pairs. A bucket with more than `most` vectors is dealt to pairs of blocks, so no task has it whole.
Equal vectors are put together first and count by their number.

Defined cases: vectors that are null, zero or empty, or have null or non-finite components, link with nothing, and so do rows
with a null vec_id, which are their own component; vectors of different lengths never link; rows repeated under one id count
each; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, staged, table

COSINE = 0.9
WIDTH = 1.0
RECALL = 0.97
#: Unrelated vectors of a bucket, about; vectors of a bucket that one task compares.
OCCUPANCY, MOST = 64, 2048
SEED = 5
#: Sign bits that decide which members of a bucket are compared.
SKETCH = 128


def chance(distance: float, width: float = WIDTH) -> float:
    """That one hash is the same for two vectors so far apart."""
    c = width / distance
    return 1 - math.erfc(c / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def plan(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Hashes of a key, and tables."""
    near, far = chance(math.sqrt(2 - 2 * cosine)), chance(math.sqrt(2))
    k = max(2, round(math.log(max(2.0, n / OCCUPANCY)) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k))


def sketch_limit(cosine: float, miss: float = 1e-6) -> int:
    """Sign bits in which two vectors of that cosine differ at most, but for a probability of `miss`."""
    p, tail = math.acos(max(-1.0, min(1.0, cosine))) / math.pi, 1.0
    for k in range(SKETCH + 1):
        tail -= math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)
        if tail <= miss:
            return k
    return SKETCH


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def hashed(vectors: DataFrame, k: int, tables: int, width: float = WIDTH, seed: int = SEED) -> DataFrame:
    """(rep long, n long, embedding array) to rep, n, vector (binary, components as stored), keys (array, one for each table), sketch (two longs)."""

    def run(batches):
        drawn: dict[int, tuple] = {}
        for b in batches:
            reps, ns, cells = b.column(0), b.column(1), b.column(2)
            sizes = np.diff(cells.offsets.to_numpy())
            flat = cells.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            for d in np.unique(sizes):
                if d not in drawn:
                    r = np.random.default_rng([seed, int(d)])
                    drawn[d] = (r.standard_normal((int(d), k * tables)), r.uniform(0, width, k * tables), r.integers(1 << 62, size=k, dtype=np.int64) * 2 + 1, r.standard_normal((int(d), SKETCH)))
                a, shift, odd, signs = drawn[d]
                at = np.flatnonzero(sizes == d)
                raw = flat[(ends[at] - d)[:, None] + np.arange(d)]
                v = unit(raw)
                h = np.floor((v @ a + shift) / width).astype(np.int64).reshape(len(at), tables, k)
                with np.errstate(over="ignore"):
                    keys = ((h + 1000) * odd).sum(axis=2)
                    keys = (((keys ^ (keys >> 29)) * odd[0] + int(d)) >> 32).astype(np.int32)  # two buckets that fall together do no harm
                bits = np.packbits(v @ signs >= 0, axis=1).view(np.int64)
                yield pa.record_batch(
                    [reps.take(pa.array(at)), ns.take(pa.array(at)), pa.array([x.tobytes() for x in raw], pa.binary()), pa.array(list(keys), pa.list_(pa.int32())), pa.array(bits[:, 0]), pa.array(bits[:, 1]), pa.array(np.full(len(at), d, np.int32))],
                    names=["rep", "n", "vector", "keys", "s0", "s1", "d"],
                )

    return vectors.select("rep", "n", "embedding").mapInArrow(run, "rep long, n long, vector binary, keys array<int>, s0 long, s1 long, d int")


def _compare(t: int, side: np.ndarray, crossed: bool, rep, n, v, keys, d, cosine: float):
    """(rep, links, least) for a bucket or a pair of blocks of it. crossed: only pairs between the two sides count."""
    near = v @ v.T >= cosine
    np.fill_diagonal(near, False)
    near &= d[:, None] == d[None, :]
    if crossed:
        near &= side[:, None] != side[None, :]
    i, j = np.nonzero(near)
    if t and len(i):
        new = ~(keys[i, :t] == keys[j, :t]).any(axis=1)
        i, j = i[new], j[new]
    if not len(i):
        return None
    links = np.bincount(i, n[j], len(rep)).astype(np.int64)
    least = rep.copy()
    while True:
        after = least.copy()
        np.minimum.at(after, i, least[j])
        if (after == least).all():
            break
        least = after
    hit = np.flatnonzero(links)
    return rep[hit], links[hit], least[hit]


BUCKET = ["t", "key", "lo", "hi"]


def _dealt(rows: DataFrame, most: int) -> DataFrame:
    """rows with t and key, one for each member of a bucket of two or more; buckets beyond `most` dealt to pairs of blocks (lo, hi)."""
    many = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    full = rows.join(many, ["t", "key"])
    blocks = F.ceil(F.col("many") / (most // 2)).cast("int")
    side = F.when(F.col("many") > most, F.pmod(F.xxhash64("rep"), blocks).cast("int")).otherwise(0)
    others = F.when(F.col("many") > most, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.lit(0)))
    full = full.withColumn("side", side).withColumn("other", F.explode(others))
    full = full.withColumns({"lo": F.least("side", "other"), "hi": F.greatest("side", "other")}).drop("other", "many")
    return full


def _by_bucket(work):
    """A function for mapInArrow that calls work(rows of one bucket) for each bucket of sorted rows; work gives a tuple of arrays or None."""

    def run(batches):
        def edges(b):
            new = np.zeros(len(b), bool)
            new[:1] = True
            for c in BUCKET:
                x = b.column(c).to_numpy()
                new[1:] |= x[1:] != x[:-1]
            return np.flatnonzero(new)

        def give(b):
            cuts = [*edges(b), len(b)]
            out = [x for i, j in zip(cuts, cuts[1:]) if j - i > 1 and (x := work(b.slice(i, j - i)))]
            if out:
                yield pa.record_batch([pa.array(np.concatenate([x[c] for x in out])) for c in range(len(out[0]))], names=[f"c{c}" for c in range(len(out[0]))])

        held = None  # rows of the last bucket so far: it may go on in the next batch
        for b in batches:
            if not len(b):
                continue
            whole = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks().to_batches()[0]
            last = int(edges(whole)[-1])
            held = whole.slice(last)
            yield from give(whole.slice(0, last))
        if held is not None:
            yield from give(held)

    return run


def found(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, most: int = MOST) -> DataFrame:
    """(rep, n, embedding), distinct and sound, to (rep, links, least): what each bucket says of the vectors that have links in it."""
    k, tables = plan(vectors.count(), cosine, recall)
    kind = np.float32 if dict(vectors.dtypes)["embedding"] == "array<float>" else np.float64
    h = staged(hashed(vectors, k, tables), "hashed")
    limit = sketch_limit(cosine)

    def close(g):
        """Members with another one whose sketch is near enough; in a pair of blocks, one of the other side."""
        s = np.stack([g.column("s0").to_numpy(), g.column("s1").to_numpy()]).view(np.uint64)
        near = (np.bitwise_count(s[0][:, None] ^ s[0]) .astype(np.uint8) + np.bitwise_count(s[1][:, None] ^ s[1])) <= limit
        np.fill_diagonal(near, False)
        if g.column("lo")[0].as_py() != g.column("hi")[0].as_py():
            side = g.column("side").to_numpy()
            near &= side[:, None] != side
        hit = np.flatnonzero(near.any(axis=1))
        if not len(hit):
            return None
        t, key = g.column("t")[0].as_py(), g.column("key")[0].as_py()
        return g.column("rep").to_numpy()[hit], np.full(len(hit), t, np.int32), np.full(len(hit), key, np.int32)

    keyed = h.select("rep", "s0", "s1", F.posexplode("keys").alias("t", "key"))
    dealt = _dealt(keyed, most).repartition(*BUCKET).sortWithinPartitions(*BUCKET)
    maybe = dealt.select(*BUCKET, "side", "rep", "s0", "s1").mapInArrow(_by_bucket(close), "c0 long, c1 int, c2 int")
    maybe = staged(maybe.toDF("rep", "t", "key").distinct(), "maybe")

    def exact(g):
        d = g.column("d").to_numpy()
        v = np.zeros((len(g), int(d.max())))
        for size in np.unique(d):  # vectors of other lengths can share a key by chance
            at = np.flatnonzero(d == size)
            v[at, :size] = unit(np.frombuffer(b"".join(g.column("vector").take(pa.array(at)).to_pylist()), kind).reshape(-1, size))
        t, lo, hi = (g.column(c)[0].as_py() for c in ("t", "lo", "hi"))
        keys = g.column("keys").flatten().to_numpy().reshape(len(g), t)
        return _compare(t, g.column("side").to_numpy(), lo != hi, g.column("rep").to_numpy(), g.column("n").to_numpy(), v, keys, d, cosine)

    full = _dealt(maybe, most).join(h.select("rep", "n", "vector", "keys", "d"), "rep")
    full = full.withColumn("keys", F.slice("keys", 1, F.col("t"))).repartition(*BUCKET).sortWithinPartitions(*BUCKET)
    return full.select(*BUCKET, "side", "rep", "n", "vector", "keys", "d").mapInArrow(_by_bucket(exact), "c0 long, c1 long, c2 long").toDF("rep", "links", "least")


def near_dedup(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, most: int = MOST) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors."""
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    v = staged(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")), "vectors")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("embedding", lambda x: x != 0)
    good = v.where(sound)
    classes = staged(good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    got = staged(found(classes, cosine, recall, most), "links")
    links = got.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(got.where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b")))
    known = classes.join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    known = staged(known, "known")  # so that the join can split a vector that very many rows have
    out = good.join(known, "embedding").select("vec_id", "n_links", "component_id")
    rest = v.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionAll(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "embeddings"))
