"""Exact dedup: a persistent digest index, bucketed and sorted by hash.

New rows get a digest of their normalised text. A sort-merge anti-join against the index finds the digests that are
new; these are appended, with the smallest doc_id and the count of their group. Digests that the index has already
keep the document that the index names.

Defined cases: a null text counts as empty. Rows repeated with one doc_id count each in group_size, and each is marked
as the one that stays; null ids are passed over for it. An empty table gives an empty result. Columns other than doc_id
and text are not looked at.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, dropped, staged, table, text_of

#: Buckets of a new index at least, and digests of a bucket at most: beyond that the index is dealt to twice as many.
BUCKETS, BUCKET_DIGESTS = 64, 4_000_000
COLUMNS = "text_sha256 STRING, keep_id BIGINT, group_size BIGINT"


class DigestIndex:
    """A table (text_sha256, keep_id, group_size) in the warehouse, bucketed and sorted by the digest.

    It outlives the session: open it again by its name to deduplicate the next batch against all earlier ones. It is in a folder
    named after its number of buckets, so a session whose catalogue doesn't know the table finds it, too. Batches are appended
    in one write, after their digests were staged, so a failed append leaves no half of a decision; when the index gets more
    buckets it is written anew beside itself, and the old folder goes only when the new one is complete.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int = BUCKETS, bucket_digests: int = BUCKET_DIGESTS):
        self.spark, self.name, self.least, self.most = spark, name, buckets, bucket_digests
        self.root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name}"

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    @property
    def buckets(self) -> int:
        """Of the index as it is; 0 if there is none."""
        files, path = self._files()
        if not files.exists(path(self.root)):
            return 0
        names = [str(x.getPath().getName()) for x in files.listStatus(path(self.root))]
        return max((int(n[1:]) for n in names if files.exists(path(f"{self.root}/{n}/_SUCCESS"))), default=0)

    def exists(self) -> bool:
        return self.buckets > 0

    def _opened(self, buckets: int) -> str:
        name = f"{self.name}_b{buckets}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({COLUMNS}) USING parquet CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {buckets} BUCKETS LOCATION '{self.root}/b{buckets}'")
        return name

    def read(self) -> DataFrame:
        return self.spark.table(self._opened(self.buckets))

    def _write(self, rows: DataFrame, buckets: int) -> None:
        name = self._opened(buckets)
        rows = rows.select("text_sha256", F.col("keep_id").cast("long").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"))
        rows.repartition(buckets, "text_sha256").write.mode("append").bucketBy(buckets, "text_sha256").sortBy("text_sha256").saveAsTable(name)
        self.spark.catalog.refreshTable(name)

    def append(self, rows: DataFrame, at_most: int) -> None:
        """at_most: digests that the rows hold at most."""
        now = self.buckets
        held = self.read().count() if now else 0
        wanted = now or self.least
        while wanted * self.most < held + at_most:
            wanted *= 2
        if now and wanted > now:
            old = self.read()
            files, path = self._files()
            files.delete(path(f"{self.root}/b{wanted}"), True)  # what an earlier try has left
            self._write(old, wanted)
            self._forget(now)
        self._write(rows, wanted)

    def _forget(self, buckets: int) -> None:
        files, path = self._files()
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_b{buckets}")
        files.delete(path(f"{self.root}/b{buckets}"), True)

    def drop(self) -> None:
        if now := self.buckets:
            self._forget(now)
        files, path = self._files()
        files.delete(path(self.root), True)


def digest_of(column: str = "text"):
    return F.sha2(F.encode(F.regexp_replace(text_of(column), SPACE, " "), "UTF-8"), 256)


def dedup(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Adds the batch to the index; returns doc_id, keep_id, group_size, kept, text_sha256, one row per row of docs.

    group_size counts the batch. keep_id is the document that the index holds for the text: of this batch the one with
    the smallest doc_id, unless an earlier batch has the text. The result doesn't read the index any more.
    """
    digests = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of().alias("text_sha256")), "digests")
    groups = staged(digests.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    new = groups.join(index.read().hint("merge"), "text_sha256", "left_anti") if index.exists() else groups
    index.append(staged(new, "new") if index.exists() else new, groups.count())
    held = index.read().select("text_sha256", "keep_id")
    # a table of its own: a join of two plain shuffles can split a digest that very many rows have
    known = staged(groups.select("text_sha256", "group_size").join(held.hint("merge"), "text_sha256"), "known")
    dropped(groups)
    return (
        digests.join(known, "text_sha256")
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents against an index that starts empty and goes when it has been asked."""
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    found = dedup(table(spark, sf_dir, "documents"), index)
    index.drop()
    return found


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
