"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 of the text. Documents come in batches. A batch is
reduced to one row per digest (map-side combined, so a digest that a third of the rows share costs one row per
task); a sort-merge anti-join against the index, whose side is read bucket by bucket and not shuffled, finds the
digests that are new, and a semi-join those that are known. Both are appended, the known ones as counts of what
the batch adds, so a digest's rows together say how often it was seen and which id stays. The files of a bucket
are sorted each; Spark sorts a bucket that has several files again before it merges. Only DataFrame operations
are used.

Defined results: a null text counts as empty, empty texts are equal to each other; ids are compared as
given, repeated ids count as rows of their own; a null id never wins over another; an empty batch appends
nothing; columns other than the id and the text are ignored. Of equal texts the row with the largest id stays,
over all batches that the index has seen, so a later batch may take the place of a row of an earlier one; the
size of a group counts the rows of all batches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, id_text, materialize

#: A table without an index of its own is taken in as so many batches, dealt by a hash of the id.
BATCHES = 3


class DigestIndex:
    """The table (digest, keep_id, n, fresh), bucketed and sorted by digest; fresh rows are the first of their digest."""

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None):
        self.spark, self.table = spark, table
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def known(self) -> DataFrame:
        """(digest) of all that the index has, each once."""
        return self.spark.table(self.table).filter("fresh").select("digest")

    def read(self) -> DataFrame:
        """(digest, keep_id, group_size), one row for each digest; the buckets are aggregated where they lie."""
        return self.spark.table(self.table).groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))

    def append(self, rows: DataFrame) -> None:
        """Each task holds whole buckets, so a batch adds at most one file to each."""
        (
            rows.select("digest", "keep_id", "n", "fresh")
            .repartition(self.buckets, "digest")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(self.table)
        )

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): the texts are read once and go no further."""
    d = id_text(docs, id_col, text_col)
    return d.select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))


def ingest(batch: DataFrame, index: DigestIndex) -> None:
    """Append to the index the digests of a batch of (doc_id, digest) that it lacks, and counts of those that it has."""
    groups = batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    if not index.exists():
        index.append(groups.limit(0).withColumn("fresh", F.lit(True)))
    groups = groups.repartition(index.buckets, "digest")  # as the index is dealt
    fresh = groups.join(index.known().hint("merge"), "digest", "left_anti").withColumn("fresh", F.lit(True))
    known = groups.join(index.known().hint("merge"), "digest", "left_semi").withColumn("fresh", F.lit(False))
    index.append(fresh.unionByName(known))


def mark(batch: DataFrame, index: DigestIndex) -> DataFrame:
    """One row per document of the batch, with what the index says of its text.

    Rows of hot digests take their group from a broadcast of at most 1 / HOT_SHARE rows and join under a
    key of their own, so no task gets a hot group; the rest join by sort and merge.
    """
    groups = index.read()
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    hot = groups.filter(F.col("group_size") > max(1.0, total * HOT_SHARE)).select(
        F.col("digest").alias("digest_hot"), F.col("keep_id").alias("keep_hot"), F.col("group_size").alias("size_hot")
    )
    wide = batch.join(F.broadcast(hot), F.col("digest") == F.col("digest_hot"), "left").withColumn(
        "probe", F.when(F.col("digest_hot").isNull(), F.col("digest")).otherwise(F.unhex(F.sha2(F.concat_ws("#", F.lit("hot"), F.col("doc_id")).cast("binary"), 256)))
    )
    rest = groups.select(F.col("digest").alias("digest_in"), F.col("keep_id").alias("keep_in"), F.col("group_size").alias("size_in"))
    return wide.join(rest.hint("merge"), F.col("probe") == F.col("digest_in"), "left").select(
        "doc_id",
        F.coalesce("keep_hot", "keep_in").alias("keep_id"),
        F.coalesce("size_hot", "size_in").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.coalesce("keep_hot", "keep_in")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def dedup(docs: DataFrame, index: DigestIndex | None = None, batches: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs; the index grows by them.

    docs are taken in as one batch, or as several, dealt by a hash of the id. Without an index one is made, in
    BATCHES batches, and dropped when the result is written.
    """
    spark = docs.sparkSession
    own = index is None
    index = index or DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    batches = batches or (BATCHES if own else 1)
    rows = materialize(digests(docs, id_col, text_col), "digests")
    for k in range(batches):
        ingest(rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(batches)) == k) if batches > 1 else rows, index)
    out = mark(rows, index)
    if own:
        out = materialize(out, "marked")
        index.drop()
    return out
