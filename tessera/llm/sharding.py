"""Sharding by fixed virtual slots (native).

Records hash by doc_id and text into a fixed number of virtual slots; bytes are summed per slot, and
a versioned table maps every slot, those without records as well, to a shard. Rebalancing edits
that map: whole slots move, records never hash anew. A record that is repeated more than HOT times
would fill its slot; its copies are dealt to as many slots as they need.

Defined results: a null text has no bytes and checksum 0; a null doc_id hashes by its text alone;
rows that share a doc_id are told apart by their text; repeated rows are placed one by one, in any
order among themselves; slots of equal size (ties) are placed by number, each in the lowest of the
shards with the fewest bytes; a very long text counts with all its bytes; an empty table gives an
empty result; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, shared_dir, table, whole

#: Virtual slots; every map version has this many rows, whatever the data.
SLOTS = 4096
#: Copies of one record that share a virtual slot.
HOT = 1024
#: Bytes that a record costs besides its text.
OVERHEAD = 8
#: Most hot records that are broadcast; more are joined by shuffle.
BROADCAST = 100_000


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of each record."""
    text = whole("text").cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def spread_copies(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """rows (written already) with the copies of records that are repeated more than HOT times
    dealt to several slots, by their place in the table."""
    key = ["doc_id", "text_crc32", "size"]
    hot = cut(rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > HOT))
    if hot.isEmpty():
        return rows
    same = F.struct(*(rows[k] for k in key)).eqNullSafe(F.struct(*(hot[k] for k in key)))
    salt = F.pmod(F.col("at"), F.ceil(F.col("n") / HOT))
    slot = F.when(F.col("n").isNotNull(), F.pmod(F.xxhash64("doc_id", "text_crc32", salt), F.lit(slots)).cast("int")).otherwise(F.col("virtual_slot"))
    numbered = rows.withColumn("at", F.monotonically_increasing_id())
    joined = numbered.join(F.broadcast(hot) if hot.count() <= BROADCAST else hot, same, "left").select(*(rows[c] for c in key), rows["virtual_slot"], "at", "n")
    return cut(joined.select(*key, slot.alias("virtual_slot")))


def slot_bytes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, bytes, n) of every slot, 0 where it holds nothing."""
    held = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(held, "virtual_slot", "left").na.fill(0)


def assign_slots(by_slot: DataFrame, shards: int, version: int = 0) -> DataFrame:
    """A slot map: largest slot first, each to the shard with the fewest bytes so far.

    One row folds over the slots (SLOTS of them at most, so the fold is of bounded size).
    """
    order = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), F.col("virtual_slot").alias("slot"))))
    state = F.struct(
        F.array_repeat(F.lit(0).cast("long"), shards).alias("load"),
        F.expr("cast(array() as array<struct<slot:int,shard:int>>)").alias("map"),
    )

    def place(acc, x):
        at = (F.array_position(acc["load"], F.array_min(acc["load"])) - 1).cast("int")
        return F.struct(
            F.transform(acc["load"], lambda v, i: F.when(i == at, v - x["less"]).otherwise(v)).alias("load"),
            F.concat(acc["map"], F.array(F.struct(x["slot"].alias("slot"), at.alias("shard")))).alias("map"),
        )

    folded = by_slot.agg(order.alias("o")).select(F.explode(F.aggregate("o", state, place)["map"]).alias("m"))
    return folded.select(F.lit(version).alias("version"), F.col("m.slot").alias("virtual_slot"), F.col("m.shard").alias("shard"))


def rebalance(slot_map: DataFrame, by_slot: DataFrame, shards: int, version: int) -> DataFrame:
    """The next version of the map for one more shard: slots move only into the new shard.

    Each old shard gives slots, smallest hash of the slot number first, until it has given
    1/shards of its own bytes.
    """
    w = Window.partitionBy("shard").orderBy(F.xxhash64("virtual_slot"), "virtual_slot")
    held = slot_map.join(by_slot, "virtual_slot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    given = F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0))
    all_own = F.sum("bytes").over(Window.partitionBy("shard"))
    moved = (given * F.lit(shards) <= all_own) & (F.col("bytes") > 0)
    return held.select(
        F.lit(version).alias("version"), "virtual_slot",
        F.when(moved, F.lit(shards - 1)).otherwise(F.col("shard")).cast("int").alias("shard"),
    )


def save_map(slot_map: DataFrame, path: str) -> None:
    """Add a version of the map to the table at path; earlier versions stay readable."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("virtual_slot int, shard int, version int").parquet(path).where(F.col("version") == version).select("version", "virtual_slot", "shard")


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Rows with shard and slot, the row's gapless place in its shard.

    Places count on from virtual slot to virtual slot of a shard; the window over rows is
    within a virtual slot, so no task sorts a whole shard. The map has a fixed number of
    rows and may be broadcast.
    """
    counts = slot_map.join(rows.groupBy("virtual_slot").agg(F.count("*").alias("n")), "virtual_slot", "left").na.fill(0, ["n"])
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(counts.select("virtual_slot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    known = F.coalesce("shard", F.raise_error(F.lit("a virtual slot that the map lacks")).cast("int")).alias("shard")
    return rows.withColumn("i", F.row_number().over(within)).join(F.broadcast(starts), "virtual_slot", "left").select(
        "doc_id", "size", "text_crc32", known, (F.col("first") + F.col("i") - 1).alias("slot"), "virtual_slot"
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 23 with sizes near equal (law `bytes`); slot is the place in the shard.

    The map is stored as version 0, then edited for one more shard and stored as version 1;
    next_shard is the record's shard under that.
    """
    rows = spread_copies(cut(sized(table(spark, sf_dir, "documents"))))
    path = f"{shared_dir(spark)}/slot_map_{uuid.uuid4().hex}"
    by_slot = cut(slot_bytes(rows))
    save_map(assign_slots(by_slot, 24), path)
    save_map(rebalance(load_map(spark, path, 0), by_slot, 25, 1), path)
    later = load_map(spark, path, 1).select("virtual_slot", F.col("shard").alias("next_shard"))
    return place(rows, load_map(spark, path, 0)).join(F.broadcast(later), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "next_shard"
    )
