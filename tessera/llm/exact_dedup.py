"""Exact deduplication against a persistent digest index (native).

The index is a Parquet table bucketed and sorted by the digest of the normalised text. A
batch of documents is reduced to one row per digest, the digests that the index lacks are
found by a sort-merge anti-join on the buckets, and only those are appended.

Defined results:
- A null text counts as empty; white space is deleted before hashing, so empty and
  white-space-only texts are one group.
- Within a batch the row with the most code points in the original text stays, then the one
  with the smallest doc_id (a null doc_id comes last). Against earlier batches the row that is
  already in the index stays, however long the new one is.
- Rows that repeat both doc_id and text are separate rows of the result; one of them stays.
- Running a batch again under its name gives the same result: its digests are found as its own.
- A very long text is hashed whole. One job at a time may write to an index.
- An empty table gives an empty result. Columns other than those named are ignored (drop_copies
  keeps them; the names digest and length are its own).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACE, cut, partitions, repeated, table, whole


class DigestIndex:
    """A bucketed table (digest binary, keep_id long, batch string), one row per digest ever kept.

    With a path the table is external, and a later session that opens the same path and
    name goes on with it; the number of buckets must be the same then.
    """

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, buckets: int | None = None):
        self.spark, self.name, self.buckets = spark, name, buckets or partitions(spark)
        at = f" LOCATION '{path}'" if path else ""
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet"
            f" CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS{at}"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame, batch: str) -> None:
        """Append the digests of groups (digest, keep_id; digests distinct) that are new."""
        fresh = groups.select("digest", "keep_id", F.lit(batch).alias("batch")).join(
            self.rows().select("digest").hint("merge"), "digest", "left_anti"
        )
        (
            fresh.repartition(self.buckets, "digest")
            .write.mode("append").format("parquet")
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        )
        self.spark.catalog.refreshTable(self.name)


def with_digest(docs: DataFrame) -> DataFrame:
    """docs with the digest of the normalised text and the original's length in code points."""
    text = whole("text")
    digest = F.unhex(F.sha2(F.regexp_replace(text, f"{SPACE}+", "").cast("binary"), 256))
    return docs.withColumns({"digest": digest, "length": F.length(text).cast("long")})


def decide(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """Deduplicate docs among themselves and against the index, then append what is new.

    Returns a row per distinct (doc_id, digest, length) with copies (equal rows), keep_id,
    group_size (rows of this batch with that text) and keeps (one of the copies stays). A text
    with a third of all rows is salted: groups are first reduced per (digest, salt), and the
    reduced rows go back to the salts they came from, so that no task gets a whole group.
    """
    spark = docs.sparkSession
    named = with_digest(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = cut(named.groupBy("doc_id", "digest", "length").agg(F.count("*").alias("copies")))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(max(64, partitions(spark)))))
    best = F.struct((-F.col("length")).alias("shorter"), F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"))
    salted = rows.groupBy("digest", "salt").agg(F.min(best).alias("best"), F.sum("copies").alias("n"))
    groups = cut(
        salted.groupBy("digest").agg(
            F.min("best")["id"].alias("keep_id"), F.min("best")["shorter"].alias("shorter"),
            F.sum("n").alias("group_size"), F.collect_set("salt").alias("salts"),
        )
    )
    index.append(groups, batch)
    known = index.rows().select("digest", F.col("keep_id").alias("indexed_id"), "batch")
    found = groups.join(known.hint("merge"), "digest").select(
        "digest", "group_size", "indexed_id", "shorter",
        (F.col("batch") == batch).alias("own"), F.explode("salts").alias("salt"),
    )
    one = F.col("own") & F.col("doc_id").eqNullSafe(F.col("indexed_id")) & (F.col("length") == -F.col("shorter"))
    return rows.join(found, ["digest", "salt"]).select(
        "doc_id", "digest", "length", "copies", F.col("indexed_id").alias("keep_id"), "group_size", one.alias("keeps")
    )


def dedup_batch(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """A row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    decided = repeated(decide(docs, index, batch), F.col("copies"), "copy")
    return decided.select("doc_id", "keep_id", "group_size", (F.col("keeps") & (F.col("copy") == 0)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Rows that nothing repeats pass an anti-join with those that go; of equal rows that stay,
    one is taken.
    """
    decided = cut(decide(docs, index, batch))
    rows = with_digest(docs)
    key = ["doc_id", "digest", "length"]

    def meet(right: DataFrame, how: str) -> DataFrame:
        right = right.select(*key).hint("shuffle_hash")
        same = rows["doc_id"].cast("long").eqNullSafe(right["doc_id"]) & (rows["digest"] == right["digest"]) & (rows["length"] == right["length"])
        return rows.join(right, same, how)

    left = meet(decided.where("NOT keeps OR copies > 1"), "left_anti")
    again = decided.where("keeps AND copies > 1")
    if not again.isEmpty():
        left = left.unionByName(meet(again, "left_semi").dropDuplicates(key))
    return left.drop("digest", "length")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one batch over a new, empty index."""
    index = DigestIndex(spark, f"digests_{uuid.uuid4().hex}")
    return dedup_batch(table(spark, sf_dir, "documents"), index, "first")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER w = 1 AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
