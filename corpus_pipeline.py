"""The corpus pipeline: from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to the
shared folder and read again as the next stage's docs. All but the last return the columns of
documents. The result is a row per piece of a document: doc_id, piece, start, length, ids_crc32,
sequence_id and offset.

Defined results: null and empty texts go in the first stage; rows that repeat a document go in the
second, but for one; a null doc_id is kept and is near to nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import dominance_packing, exact_dedup, language_id, partenum_join, secret_ledger
from tessera.llm.shared import cut, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no language that the others teach: no letters, or far from every centroid.

    lang stays as it was: the prediction decides only what goes.
    """
    model = language_id.fit(language_id.training_rows(docs))
    return language_id.predict(docs.select(*COLUMNS), model, keep_text=True).where(~F.col("rejected")).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    index = exact_dedup.DigestIndex(spark, f"pipeline_{uuid.uuid4().hex}")
    return exact_dedup.drop_copies(docs.select(*COLUMNS), index, "pipeline")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near-equal shingle sets, the one with the smallest doc_id stays.

    Rows are told apart by doc_id and text, as texts that share a doc_id are documents of their own;
    equal texts went in the stage before.
    """
    placed = partenum_join.join_documents(docs)
    gone = cut(placed.where("NOT stays").select("doc_id", "digest").distinct())
    rows = docs.select(*COLUMNS).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    return rows.join(gone.hint("shuffle_hash"), ["doc_id", "digest"], "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret's span becomes a mark; all documents stay."""
    ledger = secret_ledger.BlobLedger(spark, f"{shared_dir(spark)}/ledger_{uuid.uuid4().hex}")
    found = secret_ledger.scan_versions(docs.select(F.col("doc_id").alias("path"), "text"), ledger).where(F.size("spans") > 0)
    found = cut(found.distinct()).hint("shuffle_hash")
    rows = docs.select(*COLUMNS).withColumn("blob", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    same = rows["doc_id"].eqNullSafe(found["path"]) & (rows["blob"] == found["blob"])
    clean = F.when(F.col("spans").isNotNull(), secret_ledger.redact(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    rows = rows.join(found, same, "left").withColumn("text", clean)
    return rows.withColumn("n_chars", F.when(F.col("spans").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens in as few sequences as possible."""
    return dominance_packing.pack(cut(dominance_packing.pieces(docs)))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("secret_scans", redact_secrets),
    ("packing", pack_sequences),
]

#: Near copies, language and tokens have no SQL; a brute-force version checks the rows instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


pipeline = run
