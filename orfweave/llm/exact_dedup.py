"""Operator 6, exact dedup over a persistent digest index.

The index is a table bucketed and sorted by digest, one row for each distinct normalised text met so far.
A batch of new documents is reduced to its distinct digests (partial aggregation before the shuffle, so a
large group of copies costs one row a task), the digests that the index lacks are found by a sort-merge
anti-join that reads the index without shuffling it, and those are appended. Then every document looks up
who stands for its digest.

A batch may be run again, after a lost job for example: index rows of the same batch count as its own, so the answer is the
same and nothing is appended twice. Of batches that brought in one text at the same time the one with the smallest name
has it for all who read later.

Text is normalised by replacing each run of white space by one space; nulls count as empty. Among equal
texts of a batch the smallest id stays (null ids last; among rows that repeat an id, the first by position
in the input); a text that an earlier batch brought in is not kept again. Each row gives one row; an empty
table gives none. Columns other than the id and the text aren't read by
deduplicate() and pass through kept_documents().
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orfweave.plans.scratch import delete, shared_folder

from .common import WHITESPACE, Scratch, fresh, partitions, table, whole_text


def digest(text_column: str = "text") -> Column:
    return F.sha2(F.regexp_replace(whole_text(text_column), WHITESPACE, " "), 256)


class DigestIndex:
    """The index as a table of the catalog whose files lie at a given place. Where the catalog has lost the table
    (a new session over an in-memory catalog), attach() makes it known again with the same buckets."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int):
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets

    @classmethod
    def attach(cls, spark: SparkSession, name: str, path: str, id_type: str = "bigint", buckets: int | None = None) -> DigestIndex:
        index = cls(spark, name, path, buckets or partitions(spark))
        if not spark.catalog.tableExists(name):
            spark.sql(f"CREATE TABLE {name} (digest STRING, keep_id {id_type}, batch STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {index.buckets} BUCKETS LOCATION '{path}'")
        return index

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        # written in the buckets' own order, so that there's one file for a bucket and batch
        rows.select("digest", "keep_id", "batch").repartition(self.buckets, "digest").write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.name)

    def drop(self) -> None:
        """Forgets the table and deletes its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.path, self.spark.sparkContext._jsc.hadoopConfiguration())


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str = "0", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id, keep_id, group_size (rows of this batch with the digest), kept and text_sha256. Appends what
    is new to the index."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "dedup")
    # a row's position tells repeated rows apart; it is only used while docs keeps its files and their order
    own = docs.select(F.col(id_column).alias("id"), digest(text_column).alias("digest"), F.monotonically_increasing_id().alias("row"))
    keyed = scratch.write(own, "digests")
    classes = _classes(keyed, index, scratch, batch)
    found = keyed.join(classes, "digest")
    return found.select(F.col("id").alias(id_column), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("digest").alias("text_sha256"))


def _classes(keyed: DataFrame, index: DigestIndex, scratch: Scratch, batch: str) -> DataFrame:
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row")))
    groups = scratch.write(keyed.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")), "groups")
    # the table's buckets make this a sum without a shuffle
    known = index.read().groupBy("digest").agg(F.min(F.struct("batch", "keep_id")).alias("owner"))
    others = known.where(F.col("owner.batch") != batch)
    # the hint holds where Spark would broadcast a small index
    new = groups.join(others.select("digest").hint("merge"), "digest", "left_anti")
    added = scratch.write(new.select("digest", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size"), "new")
    old = groups.join(others.select("digest", F.col("owner.keep_id").alias("keep_id")).hint("merge"), "digest")
    old = scratch.write(old.select("digest", "keep_id", F.lit(-1).cast("long").alias("keep_row"), "group_size"), "old")
    # written before the append, which changes what the index says
    missing = scratch.write(added.join(index.read().select("digest").hint("merge"), "digest", "left_anti"), "missing")
    index.append(missing.withColumn("batch", F.lit(batch)))
    return added.unionByName(old)


def kept_documents(docs: DataFrame, index: DigestIndex, batch: str = "0", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents that stay, with all their columns. A document is found again by digest and id, which few rows share;
    of rows that repeat both one stays."""
    scratch = Scratch(docs.sparkSession, "dedup")
    own, stay_digest, stay_id = fresh(docs, "own_digest", "stay_digest", "stay_id")
    marked = docs.withColumn(own, digest(text_column))
    keyed = marked.select(F.col(id_column).alias("id"), F.col(own).alias("digest"), F.monotonically_increasing_id().alias("row"))
    stay = _classes(scratch.write(keyed, "digests"), index, scratch, batch).where("keep_row >= 0")
    stay = stay.select(F.col("digest").alias(stay_digest), F.col("keep_id").alias(stay_id))
    found = marked.join(stay, (F.col(own) == F.col(stay_digest)) & F.col(id_column).eqNullSafe(F.col(stay_id)), "left_semi")
    return found.dropDuplicates([own]).drop(own)


def new_index(spark: SparkSession, id_type: str = "bigint") -> DigestIndex:
    """An empty index of its own in the shared folder."""
    name = f"orfweave_digests_{uuid.uuid4().hex}"
    return DigestIndex.attach(spark, name, f"{shared_folder(spark)}/{name}", id_type)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: exact duplicates among documents, against an index that is empty at first."""
    index = new_index(spark)
    rows = deduplicate(table(spark, sf_dir, "documents"), index)
    # what is returned reads the classes, not the index
    index.drop()
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
