"""Exact dedup against a persistent digest index (DataFrame operations only).

The index is a table in a folder, bucketed and sorted by SHA-256 digest; a marker file
in the folder holds its number of buckets, so any later session opens it by its path.
A table is taken in in BATCHES ranges of doc_id, the largest first.  A batch is reduced
to one row per digest (partial aggregation, so that a hot text costs one row per map
task), anti-joined with the index by sort-merge, where the index side is not shuffled,
and the new digests are appended.  So the first document of a digest is the one with the
largest doc_id of its table, and what an earlier table published stays.

Defined results: a null text is the empty text; equal texts form one group; the
row with the largest doc_id stays, unless the index already had the text; rows
without a doc_id stay only in groups where no row has one; of repeated rows (same
doc_id and text) one stays; texts of any length are hashed whole.  group_size counts
the rows of the table at hand.  An empty table gives no rows.  Extra columns, of any
name, are carried and never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

#: A digest with at least this share of all rows, and this many rows, is joined by
#: broadcast; so at most HOT_ONE_IN digests are, of about 60 bytes each.
HOT_ONE_IN, HOT_ROWS = 1000, 1000
#: Ranges of doc_id in which a table is taken in.
BATCHES = 2

_MARK = "_buckets-"


def digest(text: str = "text"):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


class DigestIndex:
    """Digest -> keep_id, bucketed and sorted by digest, in a folder of its own."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = (path or store.new_path(spark, "digest-index")).rstrip("/")
        self.name = f"digest_index_{uuid.uuid4().hex}"
        self._open(buckets or store.partitions(spark))

    def _open(self, buckets: int) -> None:
        """Register the folder under a name of this session; its files and buckets are kept."""
        found = store.listing(self.spark, self.path)
        marks = [int(x.removeprefix(_MARK)) for x in found if x.startswith(_MARK)]
        if found and not marks:
            raise ValueError(f"{self.path} holds files but no digest index")
        self.buckets = marks[0] if marks else buckets
        if not marks:
            store.touch(self.spark, f"{self.path}/{_MARK}{buckets}")
        self.spark.sql(f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT) USING parquet OPTIONS (compression 'zstd') CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def ingest(self, digests: DataFrame) -> None:
        """Add the digests (doc_id, digest, ...) that the index lacks; those it has keep their row."""
        edges = digests.agg(F.percentile_approx("doc_id", [i / BATCHES for i in range(1, BATCHES)])).first()[0] or []
        edges = sorted(set(edges), reverse=True)
        ranges = [F.col("doc_id") > edges[0], *[(F.col("doc_id") > low) & (F.col("doc_id") <= high) for high, low in zip(edges, edges[1:], strict=False)], F.col("doc_id").isNull() | (F.col("doc_id") <= edges[-1])] if edges else [F.lit(True)]
        for batch in ranges:
            fresh = digests.filter(batch).groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
            fresh = fresh.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
            fresh.repartition(self.buckets, "digest").write.insertInto(self.name)
            self.spark.catalog.refreshTable(self.name)

    def close(self) -> None:
        """Take the index out of the session's catalogue; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, copies), written once: repeated rows are counted, not expanded."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), digest(text).alias("digest"))
    return store.table(rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies")), "exact-digests")


def _look_up(rows: DataFrame, index: DataFrame) -> DataFrame:
    """rows (doc_id, digest, copies) with keep_id and group_size; hot digests by a bounded broadcast."""
    groups = rows.groupBy("digest").agg(F.sum("copies").alias("group_size"))
    groups = store.table(groups.join(index.hint("merge"), "digest"), "exact-groups")
    least = max(HOT_ROWS, -(-rows.count() // HOT_ONE_IN))
    hot = groups.filter(F.col("group_size") >= least).select("digest", F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size"))
    marked = rows.join(F.broadcast(hot), "digest", "left")
    # A hot row's own key has 8 bytes and so meets no digest of 32.
    marked = marked.withColumn("key", F.when(F.col("hot_size").isNull(), F.col("digest")).otherwise(F.unhex(F.lpad(F.hex(F.xxhash64("doc_id")), 16, "0"))))
    joined = marked.join(groups.select(F.col("digest").alias("key"), "keep_id", "group_size").hint("merge"), "key", "left")
    cold = F.col("hot_size").isNull()
    return joined.select("doc_id", "digest", "copies", F.when(cold, F.col("keep_id")).otherwise(F.col("hot_id")).alias("keep_id"), F.coalesce("group_size", "hot_size").alias("group_size"))


def classify(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    own = index or DigestIndex(docs.sparkSession)
    rows = digests(docs)
    own.ingest(rows)
    found = _look_up(rows, own.read())
    if index is None:
        own.close()
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return found.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The documents that stay, with all their columns; taken in again, a table gives the same ones."""
    own = index or DigestIndex(docs.sparkSession)
    rows = digests(docs)
    own.ingest(rows)
    key, owner, mark = store.free(docs, "digest", "keep_id", "keep_digest")
    keys = own.read().select(F.col("digest").alias(mark), F.col("keep_id").alias(owner))
    if index is None:
        own.close()
    # Only one document of a group has both its digest and its keep_id, so no key is hot.
    kept = docs.withColumn(key, digest("text")).join(keys, F.col(owner).eqNullSafe(F.col("doc_id").cast("long")) & (F.col(key) == F.col(mark)), "left_semi")
    if rows.filter("copies > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", key])
    store.drop(rows)
    return kept.select(*docs.columns)
