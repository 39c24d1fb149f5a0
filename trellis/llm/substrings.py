"""Substring dedup over words, by prefix-partitioned suffix trees.

A window is `window` consecutive words of one document. A word is removed if a window that covers it starts a second
time anywhere. Suffixes matter only up to that depth, so the suffix tree is cut there: its nodes at depth `window` with
two leaves or more are what is looked for, and runs of their leaves are the maximal repeats.

Prefixes. Each suffix belongs to the group of a prefix of variable length: the words from its start up to the end of the
`gram` words whose hash is the least in its window. Equal windows have equal such prefixes, so a subtree is complete within
its group, and neighbouring suffixes mostly share one. Groups are dealt to buckets, whose number follows the input, so a
bucket fits into a task's memory.

First round: prefixes that end in a gram found only once have one suffix each and no subtree. Grams are counted, each
batch's own copies put together before the shuffle, and such groups are dropped. Second round: in groups that are left,
leaves are sorted by their path of `window` words, and nodes with two or more leaves are kept. Both rounds join leaves to the
keys that repeat; a key with very many leaves is one row on the other side of that join and its leaves can be split.

Paths are 64-bit hashes. Rows are told apart by a 64-bit hash of doc_id and text.

Defined cases: a null text has no words; shorter documents have no window and lose nothing; rows repeated are copies of
each other, so all their windows repeat; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, staged, table, text_of

WINDOW = 35
GRAM = 8
#: Bytes of text for each bucket; bytes that are hashed at once; leaves held before a batch is given out.
BUCKET_BYTES, SLICE_BYTES, HOLD = 20_000_000, 250_000, 2_000_000

U = np.uint64
_BYTE = np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64)
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return (x ^ (x >> U(29))) * U(0xFF51AFD7ED558CCD) ^ x >> U(31)


def _powers(odd: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    out = []
    for base in (odd, pow(odd, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[:1] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Hashes:
    """Hashes of the words of many texts, and of runs of words, by running sums of powers."""

    def __init__(self):
        self.size = 0

    def room(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, 2 * self.size)
            self.powers = [_powers(odd, self.size) for odd in _ODD]

    def over(self, values: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        p, inverse = self.powers[which]
        s = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * p[: len(values)], out=s[1:])
        return _mix((s[end] - s[start]) * inverse[start])

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word, and the number of words of each text."""
        self.room(len(data) + 1)
        solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.concatenate(([False], solid[:-1])) & ~edge[:-1]
        after = np.concatenate((solid[1:], [False])) & ~edge[1:]
        start, end = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
        counts = np.diff(np.searchsorted(start, offsets, side="left"))
        return self.over(_BYTE[data], start, end, 0), counts


def _sliding(x: np.ndarray, n: int, f) -> np.ndarray:
    """f (minimum or maximum) over n neighbours from each place on."""
    k = 1
    while 2 * k <= n:
        x, k = f(x[:-k], x[k:]), 2 * k
    return x if k == n else f(x[: len(x) - (n - k)], x[n - k :])


def slices(texts: pa.Array):
    """(first, data, offsets): texts from `first` on, as bytes, about SLICE_BYTES at once. Nulls are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + SLICE_BYTES, side="right")) - 1)
        yield i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def leaves(h: Hashes, data: np.ndarray, offsets: np.ndarray, window: int, gram: int):
    """(counts, valid, least, grams, words): of each word of the texts, whether a window starts there, the least gram hash in it, the gram's hash."""
    words, counts = h.words(data, offsets)
    n = len(words)
    if n < window:
        return counts, np.zeros(0, bool), np.zeros(0, U), np.zeros(0, U), words
    ends = np.repeat(np.cumsum(counts), counts)
    valid = np.arange(n) + window <= ends
    at = np.arange(n - gram + 1)
    grams = h.over(words, at, at + gram, 1)
    least = np.zeros(n, U)
    low = _sliding(grams, window - gram + 1, np.minimum)
    least[: len(low)] = low
    return counts, valid, least, grams, words


def _blobs(held: list, buckets: int, wide: bool):
    """Held leaves (key, row, at[, paths]) to rows (bucket, keys, rows, ats, paths), each sorted by key."""
    key, row, at = (np.concatenate([x[k] for x in held]) for k in range(3))
    n = np.concatenate([x[3] for x in held])
    b = (key % U(buckets)).astype(np.int64)
    order = np.lexsort((key, b))
    cuts = np.flatnonzero(np.diff(b[order], prepend=-1))
    first = np.cumsum(n) - n
    paths = np.concatenate([x[4] for x in held]) if wide else None
    out: list[list] = [[], [], [], [], [], []]
    for i, j in zip(cuts, [*cuts[1:], len(order)]):
        o = order[i:j]
        took = n[o]
        cells = [int(b[o[0]]), key[o].tobytes(), row[o].tobytes(), at[o].tobytes(), took.tobytes()]
        if wide:
            cells.append(paths[np.repeat(first[o] - (np.cumsum(took) - took), took) + np.arange(took.sum())].tobytes())
        else:
            cells.append(b"")
        for c, v in zip(out, cells):
            c.append(v)
    kinds = [pa.int32(), *[pa.binary()] * 5]
    return pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds)], names=["bucket", "keys", "rows", "ats", "ns", "paths"])


BLOBS = "bucket int, keys binary, rows binary, ats binary, ns binary, paths binary"


def _of(cell, kind) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), kind)


def _repeated(blobs: DataFrame, column: str) -> DataFrame:
    """(bucket, again): of the hashes in the column, those that occur twice or more, sorted."""

    def once(batches):
        for b in batches:
            ones, many = [], []
            for cell in b.column(1):
                v, c = np.unique(_of(cell, U), return_counts=True)
                ones.append(v.tobytes())
                many.append(v[c > 1].tobytes())
            yield pa.record_batch([b.column(0), pa.array(ones, pa.binary()), pa.array(many, pa.binary())], names=["bucket", "ones", "many"])

    def merge(t: pa.Table) -> pa.Table:
        v, c = np.unique(np.concatenate([_of(x, U) for x in t.column("ones")]), return_counts=True)
        again = np.union1d(v[c > 1], np.concatenate([_of(x, U) for x in t.column("many")]))
        return pa.table({"bucket": pa.array([t.column("bucket")[0].as_py()], pa.int32()), "again": pa.array([again.tobytes()], pa.binary())})

    return blobs.select("bucket", column).mapInArrow(once, "bucket int, ones binary, many binary").groupBy("bucket").applyInArrow(merge, "bucket int, again binary")


def _within(values: np.ndarray, again: np.ndarray) -> np.ndarray:
    if not len(again):
        return np.zeros(len(values), bool)
    return again[np.minimum(np.searchsorted(again, values), len(again) - 1)] == values


def _runs(row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of rows to (row, begin, end) of runs of neighbouring places."""
    order = np.lexsort((at, row))
    row, at = row[order], at[order]
    new = np.flatnonzero((np.diff(row, prepend=0) != 0) | (np.diff(at, prepend=-9) != 1))
    if len(row):
        new = np.union1d(new, [0])
    last = np.concatenate((new[1:], [len(row)])) - 1 if len(new) else new
    return row[new], at[new], at[last] + 1


def _kept(blobs: DataFrame, again: DataFrame, deep: bool) -> DataFrame:
    """Leaves whose key (deep: whose path) repeats, as (row, begin, end)."""

    def run(batches):
        for b in batches:
            found: list[list] = [[], [], []]
            for keys, rows, ats, ns, paths, repeat in zip(*b.columns[1:]):
                row, at, n, more = _of(rows, np.int64), _of(ats, np.int32), _of(ns, np.int32), _of(repeat, U)
                if deep:
                    hit = _within(_of(paths, U), more)
                    place = np.repeat(at - (np.cumsum(n) - n).astype(np.int32), n) + np.arange(n.sum(), dtype=np.int32)
                    row, at = np.repeat(row, n)[hit], place[hit]
                else:
                    hit = _within(_of(keys, U), more)
                    row, at = row[hit], at[hit]
                for c, v in zip(found, _runs(row, at)):
                    c.append(v)
            cells = [np.concatenate([*c, np.zeros(0, k)]).astype(k) for c, k in zip(found, (np.int64, np.int32, np.int32))]
            yield pa.record_batch([pa.array(c) for c in cells], names=["row", "begin", "end"])

    return blobs.join(again, "bucket").select("bucket", "keys", "rows", "ats", "ns", "paths", "again").mapInArrow(run, "row long, begin int, end int")


def _spans(found: DataFrame) -> DataFrame:
    return found.groupBy("row").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))  # of one document


def _anchors(docs: DataFrame, buckets: int, window: int, gram: int) -> DataFrame:
    """docs (_row, _text) to leaves of the first round: each gram that is the least of some window."""

    def run(batches):
        h, held, size = Hashes(), [], 0
        for b in batches:
            rows = b.column(0).to_numpy()
            for first, data, offsets in slices(b.column(1)):
                counts, valid, least, grams, words = leaves(h, data, offsets, window, gram)
                if not valid.any():
                    continue
                span = window - gram + 1
                seen = np.concatenate((np.zeros(span - 1, U), np.where(valid, least, U(0))))
                chosen = np.flatnonzero(_sliding(seen, span, np.maximum)[: len(grams)] == grams)
                doc = np.repeat(np.arange(len(counts)), counts)[chosen]
                at = chosen - (np.cumsum(counts) - counts)[doc]
                held.append((grams[chosen], rows[first + doc], at.astype(np.int32), np.ones(len(chosen), np.int32)))
                size += len(chosen)
                if size >= HOLD:
                    yield _blobs(held, buckets, False)
                    held, size = [], 0
        if held:
            yield _blobs(held, buckets, False)

    return docs.mapInArrow(run, BLOBS)


def _suffixes(docs: DataFrame, buckets: int, window: int, gram: int) -> DataFrame:
    """docs (_row, _text, spans of repeated grams) to leaves of the second round: runs of suffixes of one prefix group, with their paths."""

    def run(batches):
        h, held, size = Hashes(), [], 0
        for b in batches:
            rows = b.column(0).to_numpy()
            spans = b.column(2)
            for first, data, offsets in slices(b.column(1)):
                counts, valid, least, grams, words = leaves(h, data, offsets, window, gram)
                if not valid.any():
                    continue
                part = spans.slice(first, len(counts))
                each = np.diff(part.offsets.to_numpy())
                base = np.repeat(np.cumsum(counts) - counts, each)
                inner = part.flatten()
                begin, end = base + inner.field("begin").to_numpy(), base + inner.field("end").to_numpy()
                often = np.zeros(len(words) + 1, np.int64)
                np.add.at(often, begin, 1)
                np.add.at(often, end, -1)
                often = np.cumsum(often)[: len(grams)] > 0
                # a window stays if its least gram repeats: the least over the repeated grams alone is the same
                low = np.full(len(words), ~U(0))
                some = _sliding(np.where(often, grams, ~U(0)), window - gram + 1, np.minimum)
                low[: len(some)] = some
                stay = np.flatnonzero(valid & (low == least))
                if not len(stay):
                    continue
                path = h.over(words, stay, stay + window, 2)
                doc = np.repeat(np.arange(len(counts)), counts)[stay]
                key = least[stay]
                new = np.flatnonzero((np.diff(stay, prepend=-9) != 1) | (np.diff(doc, prepend=-1) != 0) | (key != np.concatenate((~key[:1], key[:-1]))))
                n = np.diff(np.append(new, len(stay))).astype(np.int32)
                at = (stay - (np.cumsum(counts) - counts)[doc])[new].astype(np.int32)
                held.append((key[new], rows[first + doc[new]], at, n, path))
                size += len(stay)
                if size >= HOLD:
                    yield _blobs(held, buckets, True)
                    held, size = [], 0
        if held:
            yield _blobs(held, buckets, True)

    return docs.mapInArrow(run, BLOBS)


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs (_row, _text) to (row, spans): for each document with repeated windows, where they start, as runs."""
    if window < gram:
        gram = window
    size = docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = int(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES))
    first = staged(_anchors(docs, buckets, window, gram), "grams")
    again = _spans(_kept(first, _repeated(first, "keys"), False))
    left = docs.join(again, docs._row == again.row).select("_row", "_text", "spans")
    second = staged(_suffixes(left, buckets, window, gram), "suffixes")
    dropped(first)
    return _spans(_kept(second, _repeated(second, "paths"), True))


def rows_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("_row"), text_of().alias("_text"))


def cut(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, removed (runs of words: begin, end), and the kept text if asked for."""
    known = rows_of(docs)
    found = repeats(known.select("_row", "_text"), window, gram)

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for text, spans in zip(b.column(1), b.column(2)):
                words = text.as_buffer().to_pybytes().split()
                runs: list[list[int]] = []
                for s in sorted((x["begin"], x["end"]) for x in spans.as_py() or ()):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1] + window - 1)
                    else:
                        runs.append([s[0], s[1] + window - 1])
                kept, at = [], 0
                for begin, end in runs:
                    kept += words[at:begin]
                    at = end
                kept += words[at:]
                joined = b" ".join(kept)
                cells = (len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), [{"begin": x, "end": y} for x, y in runs], joined.decode() if with_text else None)
                for c, v in zip(out, cells):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])), pa.string())
            cols = [pa.array(c, t) for c, t in zip(out, kinds)]
            yield pa.record_batch([b.column(0), *cols[: 4 + with_text]], names=["doc_id", "n_words", "n_removed", "kept_sha256", "removed", "kept_text"][: 5 + with_text])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<begin:int,end:int>>" + ", kept_text string" * with_text
    return known.join(found, known._row == found.row, "left").select(F.col("doc_id").cast("long").alias("doc_id"), "_text", "spans").mapInArrow(run, schema)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(table(spark, sf_dir, "documents"))
