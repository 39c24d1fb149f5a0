"""Line dedup: a suffix array over documents' sequences of line IDs, by distributed prefix doubling (`suffix_array`).

A line's ID is the rank of its 128-bit hash among the lines found twice or more. Intervals of the suffix array whose suffixes have
`min_lines` lines or more in common are maximal repeated runs; in each the suffix that is first by doc_id and place is the
original, and the lines that the others have in common with it are deleted. Single lines of `min_words` words or more that
repeat count too: they are the intervals of the first round, before any doubling.

Native: DataFrame functions only. Defined cases: a null text has no lines and stays null; an empty text has one empty
line; rows repeated as a whole are one document; a null doc_id comes last; copies that overlap their original are copies
too; an empty table gives an empty result. Other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import suffix_array
from .common import SPACE, WORD, in_order, staged, table

MIN_LINES = 3
MIN_WORDS = 10


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(doc: str = "doc_id", text: str = "text") -> Column:
    return F.xxhash64(doc, text)


def has_words(line: str, least: int) -> Column:
    """Whether the line has at least so many words; reads it no further than that, and no character twice."""
    return F.col(line).rlike(rf"\A{SPACE[:-1]}*+(?:{WORD}+{SPACE}+){{{least - 1}}}{WORD[:-1]}") if least > 0 else F.lit(True)


def later_copies(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, key, begin, end): stretches of lines that are later copies, whole runs, one row per stretch."""
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("doc"), _key().alias("key"), _lines(F.col("text")).alias("lines"))
    lines = texts.select("doc", "key", F.size("lines").alias("size"), F.posexplode("lines").alias("pos", "line"))
    ab = [F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b")]
    lines = lines.select("doc", "key", "pos", (F.col("size") - F.col("pos")).alias("left"), *ab, has_words("line", min_words).alias("long"))
    found_twice = lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ids = staged(in_order(found_twice, ["a", "b"], {"rank": "n"}).drop("n"), "ids")  # a table of its own: its join can split a line found very often
    one = staged(lines.join(ids, ["a", "b"]).select("doc", "key", "pos", "left", "rank", "long"), "lines")
    single = one if min_lines <= 1 else one.where("long")  # intervals of one line or more are the classes before any doubling
    first = staged(single.groupBy("rank").agg(F.min(suffix_array.place()).alias("first")), "first")
    found = single.join(first, "rank").where(~suffix_array.is_first()).select("doc", "key", "pos", (F.col("pos") + 1).alias("end"))
    if min_lines > 1:
        runs = suffix_array.repeats(one, min_lines)
        found = found.unionByName(runs.where(~suffix_array.is_first()).select("doc", "key", "pos", (F.col("pos") + F.col("depth")).alias("end")))
    order = Window.partitionBy("key", "doc").orderBy("pos", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.sum(F.when(F.col("pos") <= F.col("_reach"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn("_reach", reach).withColumn("_run", new).groupBy("doc", "key", "_run").agg(F.min("pos").alias("begin"), F.max("end").alias("end")).drop("_run")


def dedup(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with `__line_kept` (the text without later copies), `__line_count` and `__line_cuts` (array of begin, end) in addition."""
    cuts = later_copies(docs.select("doc_id", "text"), min_lines, min_words).groupBy("key", "doc").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("__line_cuts"))
    cuts = cuts.withColumnsRenamed({"key": "__line_cut", "doc": "__line_doc"})
    d = docs.withColumn("__line_key", _key())
    d = d.join(cuts, (d["__line_key"] == cuts["__line_cut"]) & d.doc_id.eqNullSafe(cuts["__line_doc"]), "left").drop("__line_key", "__line_cut", "__line_doc")
    left = F.filter(_lines(F.col("text")), lambda _, i: ~F.exists("__line_cuts", lambda r: (i >= r.begin) & (i < r.end)))
    kept = F.when(F.col("__line_cuts").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return d.withColumn("__line_kept", kept).withColumn("__line_count", F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines(F.col("text")))).cast("long"))


def cleaned(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with their texts cut, columns as they were; n_chars, if there is one, follows. A document of which no word is left goes."""
    d = dedup(docs, min_lines, min_words)
    d = d.where(F.col("__line_cuts").isNull() | F.col("__line_kept").rlike(WORD)).withColumn("text", F.col("__line_kept"))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(F.col("__line_cuts").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return d.select(*(f"`{c}`" for c in docs.columns))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the kept lines, joined by line breaks)."""
    d = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.coalesce(F.aggregate("__line_cuts", F.lit(0).cast("long"), lambda a, r: a + r.end - r.begin), F.lit(0).cast("long"))
    return d.select("doc_id", F.col("__line_count").alias("n_lines"), gone.alias("n_removed"), F.sha2(F.encode(F.coalesce("__line_kept", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 10 AS long,
    lead(line, 1) OVER d AS b, lead(line, 2) OVER d AS c,
    row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) > 1 AS again1
  FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
), x AS (
  SELECT *, c IS NOT NULL AND row_number() OVER (PARTITION BY line, b, c ORDER BY doc_id, pos) > 1 AS again3 FROM w
), y AS (
  SELECT doc_id, pos, line, (long AND again1) OR again3 OR coalesce(lag(again3, 1) OVER d, false) OR coalesce(lag(again3, 2) OVER d, false) AS gone
  FROM x WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
), z AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
  FROM y GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN z USING (doc_id)
"""
