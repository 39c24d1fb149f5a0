"""WARC archives compressed with Zstandard: a writer, and a reader that loads the dictionary and decodes a frame per record.

An archive begins with a skippable frame that holds the dictionary, plain or itself compressed; each record after it is
one frame. The reader streams a file block by block, so its memory is one record and one block, and validates each
record: version line, the named headers that must be there, the block's length against Content-Length, the two line
breaks at the end, and the payload of a response against its digest.

Files are written under names that no other attempt uses, and listed in a table that Spark commits. What a lost executor
leaves behind isn't listed, so a task that runs again does no harm.

Defined cases: a null payload is written as an empty one; records with one page_id are records each; a page without an
id gets a record without a target of its own and is always a response; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, staged, table

MAGIC = 0xFD2FB528
DICTIONARY_MAGIC = 0x184D2A5D
MUST = ("warc-type", "warc-record-id", "warc-date", "content-length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST = 1000
BLOCK = 1 << 20
#: An archive is closed after so many bytes of blocks. A record's size at most.
ROLL, LARGEST = 64 << 20, 1 << 30
#: The dictionary is trained on this many pages at most, of at most so many bytes each.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 200, 16_384, 32_768
DATE = "2024-01-01T00:00:00Z"
PREFIX = "<urn:page:"


def record(kind: str, page, url: str | None, payload: bytes, sha1: str, refers_to=None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    name = f"{PREFIX}{page}>" if page is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, sha1)}>"
    head = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode())]
    if url is not None:
        head.append(("WARC-Target-URI", " ".join(url.split())))
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"{PREFIX}{refers_to}>")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def train(pages: DataFrame, payload: str) -> bytes:
    """A dictionary from a bounded sample; empty if there is too little to train on."""
    import zstandard

    ids = [r[0] for r in pages.where(F.col("page_id").isNotNull()).select("page_id").orderBy(F.xxhash64("page_id")).limit(SAMPLE).collect()]
    rows = pages.where(F.col("page_id").isin(ids) & (F.length(payload) > 0)).select(F.substring(F.encode(payload, "UTF-8"), 1, SAMPLE_BYTES)).limit(SAMPLE).collect() if ids else []
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [bytes(r[0]) for r in rows]).as_bytes() if len(rows) > 7 else b""
    except zstandard.ZstdError:
        return b""


def write(pages: DataFrame, folder: str, dictionary: bytes = b"", level: int = 3, roll: int = ROLL) -> DataFrame:
    """pages (page_id, url, payload string, sha1, refers_to) to a committed list (path, records) of archives in folder."""

    def run(batches):
        import zstandard
        from pyarrow import fs

        there, root = fs.FileSystem.from_uri(folder)
        there.create_dir(root, recursive=True)
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        z = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True, write_content_size=True)
        out, name, n, size, done = None, "", 0, 0, []
        for b in batches:
            for page, url, payload, sha1, to in zip(*(c.to_pylist() if k != 2 else c for k, c in enumerate(b.columns))):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.zst", 0, 0
                    out = there.open_output_stream(f"{root}/{name}")
                    if dictionary:
                        out.write(DICTIONARY_MAGIC.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary)
                raw = record("response" if to is None else "revisit", page, url, payload.as_buffer().to_pybytes() if payload.is_valid else b"", sha1, to)
                out.write(z.compress(raw))
                n, size = n + 1, size + len(raw)
                if size >= roll:
                    out.close()
                    done.append((f"{folder}/{name}", n))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", n))
        yield pa.record_batch([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["path", "records"])

    cols = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("payload").cast("string").alias("payload"), "sha1", F.col("refers_to").cast("long").alias("refers_to")]
    return staged(pages.select(*cols).mapInArrow(run, "path string, records long"), "archives")


def frames(stream, largest: int = LARGEST):
    """(offset, bytes) of each record of an archive; loads the dictionary of the leading skippable frame, if there is one."""
    import zstandard

    data, at = stream.read(BLOCK), 0
    known = None
    first = True
    while data:
        while len(data) < 8 and (more := stream.read(BLOCK)):
            data += more
        if len(data) < 8:
            raise ValueError(f"cut off at byte {at}")
        magic, size = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:8], "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            while len(data) < 8 + size and (more := stream.read(max(BLOCK, 8 + size - len(data)))):
                data += more
            if len(data) < 8 + size:
                raise ValueError(f"skippable frame cut off at byte {at}")
            if magic == DICTIONARY_MAGIC and first:
                body = bytes(data[8 : 8 + size])
                if int.from_bytes(body[:4], "little") == MAGIC:
                    body = zstandard.ZstdDecompressor().decompress(body, max_output_size=LARGEST)
                known = zstandard.ZstdCompressionDict(body)
            data, at, first = data[8 + size :] or stream.read(BLOCK), at + 8 + size, False
            continue
        if magic != MAGIC:
            raise ValueError(f"no frame at byte {at}")
        first = False
        z, start, parts, total = zstandard.ZstdDecompressor(dict_data=known).decompressobj(), at, [], 0
        while True:
            part = z.decompress(data)
            total += len(part)
            if total > largest:
                raise ValueError(f"record at byte {start} is larger than {largest} bytes")
            parts.append(part)
            at += len(data) - len(z.unused_data)
            data = z.unused_data
            if z.eof:
                break
            data = stream.read(BLOCK)
            if not data:
                raise ValueError(f"record at byte {start} is cut off")
        yield start, b"".join(parts)
        data = data or stream.read(BLOCK)


def parse(raw: bytes) -> dict:
    """A record's headers (lower-case names), its block, the HTTP headers and payload of it. ValueError if it isn't valid."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or not lines[0].startswith(b"WARC/1."):
        raise ValueError("no version line")
    named: dict[str, str] = {}
    for line in lines[1:]:
        k, colon, v = line.partition(b":")
        if not colon or not k.strip():
            raise ValueError(f"header without a name: {line[:60]!r}")
        named[k.strip().decode().lower()] = v.strip().decode()
    if missing := [k for k in MUST if k not in named]:
        raise ValueError(f"no {', '.join(missing)}")
    if not named["content-length"].isdigit():
        raise ValueError("Content-Length is no number")
    n = int(named["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {n}, the block has {len(rest) - 4} bytes or no end")
    block = rest[:n]
    http, sep, payload = block.partition(b"\r\n\r\n")
    fields = {k.strip().decode("latin-1").lower(): v.strip().decode("latin-1") for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:])} if sep else {}
    kind, said = named["warc-type"], named.get("warc-payload-digest", "")
    digest = base64.b32decode(said[5:]).hex() if said.startswith("sha1:") and len(said) == 37 else None
    length = len(payload)
    if kind == "response":
        got = hashlib.sha1(payload).hexdigest()
        if digest not in (None, got):
            raise ValueError("the payload has another digest")
        if fields.get("content-length", str(length)) != str(length):
            raise ValueError("the payload has another length than its HTTP header says")
        digest = got
    elif kind == "revisit":
        if "warc-refers-to" not in named or digest is None or not fields.get("content-length", "").isdigit():
            raise ValueError("a revisit names no record, digest or length")
        length = int(fields["content-length"])
    return {"named": named, "kind": kind, "payload": payload, "digest": digest, "length": length}


READ = "archive string, at long, record_id string, record_type string, uri string, refers_to string, payload_bytes long, payload_digest string"


def read(archives: DataFrame, with_payload: bool = False, batch_bytes: int = 16 << 20) -> DataFrame:
    """A list of archives (column path) to a row per record; payload (binary) too, if asked for. A record that isn't valid ends the job."""

    def run(batches):
        from pyarrow import fs

        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * with_payload
        names = [x.split()[0] for x in READ.split(", ")] + ["payload"] * with_payload
        for b in batches:
            for path in b.column(0).to_pylist():
                there, name = fs.FileSystem.from_uri(path)
                rows, size = defaultdict(list), 0
                with there.open_input_stream(name) as f:
                    for at, raw in frames(f):
                        try:
                            x = parse(raw)
                        except ValueError as e:
                            raise ValueError(f"{path}, byte {at}: {e}") from e
                        h = x["named"]
                        for k, v in zip(names, (path, at, h["warc-record-id"], x["kind"], h.get("warc-target-uri"), h.get("warc-refers-to"), x["length"], x["digest"], x["payload"])):
                            rows[k].append(v)
                        size += 500 + len(raw) * with_payload
                        if size >= batch_bytes:
                            yield pa.record_batch([pa.array(rows[k], t) for k, t in zip(names, types)], names=names)
                            rows, size = defaultdict(list), 0
                if rows:
                    yield pa.record_batch([pa.array(rows[k], t) for k, t in zip(names, types)], names=names)

    paths = archives.select("path")
    tasks = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return paths.repartition(tasks).mapInArrow(run, READ + ", payload binary" * with_payload)


def revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Adds payload, sha1 and refers_to: the largest page_id with the same payload of at least `least` bytes, null for that page itself."""
    html = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select("page_id", "url", html.alias("payload")).withColumn("sha1", F.sha1(F.encode("payload", "UTF-8")))
    large = F.octet_length("payload") >= least
    again = p.where(large).groupBy("sha1").agg(F.max("page_id").alias("_to"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("sha1").alias("_sha1"), "_to")
    again = staged(again, "payloads")
    p = p.join(again, (F.col("sha1") == F.col("_sha1")) & large, "left")
    return p.select("page_id", "url", "payload", "sha1", F.when(F.col("_to") != F.col("page_id"), F.col("_to")).alias("refers_to"))


def op1_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to archives and read back."""
    pages = table(spark, sf_dir, "pages")
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archives = write(revisits(pages), folder if "://" in folder else f"file://{folder}", train(pages, "html"))
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return read(archives).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


OP1_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT payload_digest, max(page_id) AS to_id FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN g.to_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN g.to_id <> p.page_id THEN g.to_id END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes >= 1000
"""
