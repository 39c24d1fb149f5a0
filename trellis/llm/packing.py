"""Best-fit packing of documents into sequences of bounded length, by hierarchical residual packing.

A document is its ids and an end id. One that is longer than a sequence is cut into pieces of a full sequence; its first
piece may be shorter. Pieces are spread over groups of bounded size by a hash. Each group packs its pieces best-fit, longest
first, and emits the bins that are full or nearly so. Underfull bins go up a tree as items: a group of the next level
packs the underfull bins of `fan` groups best-fit again, up to one group at the root. A group sends up at most `carry`
bins, the emptiest; its other bins are final too, so the root's work is bounded and no piece is ever dropped.

Defined cases: a null or empty text is the end id alone; repeated rows are packed like others, each piece by itself;
an empty table gives an empty result. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

LENGTH = 1024
END = 2
#: A bin with at most this much room is final at once.
SLACK = 8
#: Pieces of a group at most, about; groups that one group of the next level takes; bins that a group sends up.
GROUP, FAN, CARRY = 200_000, 32, 4096
#: Chunks that a worker's cache holds.
CACHE = 400_000


class Chunks(dict):
    """The ids (little-endian unsigned 32-bit) of a chunk of text: what stands between two spaces, the space before it included.

    Keys: a chunk after a space is itself; one at the start of the text or after a line break has a NUL before it.
    In the byte-level pattern no token but white space goes over a space that has other characters on both sides, so
    ids of such chunks, joined, are the ids of the text. Texts that hold the text of an added token, such as an end mark, go
    to the tokenizer itself, which gives the added token's id.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = tuple(x["content"] for x in spec["added_tokens"])
        special = set(self.added)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        table = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
        ranks = {bytes(table[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, key: str) -> bytes:
        import array

        if len(self) >= CACHE:
            self.clear()
        text = key[1:] if key[0] == "\0" else key if key == "\n" else " " + key
        out = self[key] = array.array("I", self.fast.encode_ordinary(text)).tobytes()
        return out

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        odd = "\0" in text or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[0] in " \n" or text[-1] in " \n"
        odd = odd or len(text.split()) != text.count(" ") + text.count("\n") + 1  # white space together, at an end, or of another kind
        if odd or any(a in text for a in self.added):  # an added token's text is one id, whatever stands around it
            import array

            return array.array("I", self.slow.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, ("\0" + text.replace("\n", " \n \0")).split(" ")))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary), one row per piece."""

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        chunks, last = Chunks(path or vocabulary()), end.to_bytes(4, "little")
        for b in batches:
            out = defaultdict(list)
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = chunks.ids(text.as_py() or "") + last
                n, at, k = len(ids) // 4, 0, 0
                size = n % length or length
                while at < n:
                    part = ids[4 * at : 4 * (at + size)]
                    out["doc_id"].append(doc)
                    out["piece"].append(k)
                    out["start"].append(at)
                    out["length"].append(size)
                    out["ids_crc32"].append(zlib.crc32(part))
                    if with_ids:
                        out["ids"].append(part)
                    at, k, size = at + size, k + 1, length
            types = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.binary()} if with_ids else {})
            yield pa.record_batch([pa.array(out[k], t) for k, t in types.items()], names=list(types))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES + ", ids binary" * with_ids)


def best_fit(sizes: list[int], length: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item, in the order given, and what each bin holds. Of bins with room, the fullest takes an item."""
    room: list[list[int]] = [[] for _ in range(length + 1)]
    mask, bins, offsets, used = 0, [], [], []
    for s in sizes:
        fits = mask >> s
        if fits:
            free = s + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                mask &= ~(1 << free)
        else:
            free, b = length, len(used)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += s
        if free - s:
            room[free - s].append(b)
            mask |= 1 << (free - s)
    return bins, offsets, used


def _pack(items: DataFrame, level: int, length: int, slack: int, carry: int) -> DataFrame:
    """items (g, item, size) to (g, item, bin, at, used, up): used of the item's bin; up if the bin goes to the next level."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by([("size", "descending"), ("item", "ascending")])
        g = t.column("g")[0].as_py()
        bins, at, used = best_fit(t.column("size").to_pylist(), length)
        open_ = sorted((u, b) for b, u in enumerate(used) if u < length - slack)[:carry]
        up = {b for _, b in open_}
        first = (level << 58) | (g << 30)
        return pa.table({"g": t.column("g"), "item": t.column("item"), "bin": pa.array([first + b for b in bins], pa.int64()), "at": pa.array(at, pa.int64()), "used": pa.array([used[b] for b in bins], pa.int64()), "up": pa.array([b in up for b in bins], pa.bool_())})

    return items.groupBy("g").applyInArrow(run, "g long, item long, bin long, at long, used long, up boolean")


def pack(parts: DataFrame, length: int = LENGTH, slack: int = SLACK, group: int = GROUP, fan: int = FAN, carry: int = CARRY) -> DataFrame:
    """parts with a column length to the same rows with sequence_id and offset."""
    spark = parts.sparkSession
    parts = staged(parts.withColumn("_item", F.monotonically_increasing_id()), "pieces")
    n = parts.count()
    groups = max(1, -(-n // group))
    items = parts.select(F.pmod(F.xxhash64("_item"), F.lit(groups)).alias("g"), F.col("_item").alias("item"), F.col("length").alias("size"))
    got = placed = staged(_pack(items, 0, length, slack, carry), "packed")
    where = got.select(F.col("item").alias("_item"), F.col("bin").alias("_bin"), F.col("at").alias("_at"))
    level = 0
    while groups > 1:
        level, groups = level + 1, -(-groups // fan)
        items = placed.where("up").select(F.expr(f"g div {fan}").alias("g"), F.col("bin").alias("item"), F.col("used").alias("size")).distinct()
        placed = staged(_pack(items, level, length, slack, carry), "packed")
        moved = placed.select(F.col("item").alias("_bin"), F.col("bin").alias("_to"), F.col("at").alias("_more"))
        where = where.join(moved, "_bin", "left").select("_item", F.coalesce("_to", "_bin").alias("_bin"), (F.col("_at") + F.coalesce("_more", F.lit(0))).alias("_at"))
    return parts.join(where.withColumnsRenamed({"_bin": "sequence_id", "_at": "offset"}), "_item").drop("_item")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))
