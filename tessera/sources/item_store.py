"""Items and their blocks in one append-only table, written in one pass.

A build appends, for every item it tried, a row of kind `item` (kept or skipped, with the reason and the
number of blocks) and a row of kind `block` per block. Items are told apart by KEY: path, subtune,
content hash, budget and the settings that shape blocks; null parts count as equal. The latest build that
has an item decides; its blocks count only if they are all there, each of the right width.

Parquet folders: kind=item or kind=block, then build. Builds have growing numbers; one writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ("sid", "subtune", "content_md5", "frames", "seq_len", "stride", "codec")
SCHEMA = (
    "split string, sid string, subtune int, content_md5 string, frames long, seq_len int, stride int, codec string, status string, reason string,"
    " n_blocks long, block_idx long, width int, block array<smallint>, kind string, build long"
)


def same_key(a: DataFrame, b: DataFrame) -> Column:
    out = F.lit(True)
    for c in KEY:
        out = out & a[c].eqNullSafe(b[c])
    return out


class ItemStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def rows(self, kind: str) -> DataFrame:
        """All rows of a kind, of all builds; corrupt files are left out, and what they held counts as missing."""
        try:
            found = self.spark.read.schema(SCHEMA).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            found = self.spark.createDataFrame([], SCHEMA)
        return found.where(F.col("kind") == kind)

    def next_build(self) -> int:
        return 1 + (self.rows("item").agg(F.max("build")).first()[0] or 0)

    def items(self) -> DataFrame:
        """(KEY, split, status, reason, n_blocks, build): the latest entry of every item, reduced map-side."""
        last = F.max(F.struct("build", "status", "reason", "n_blocks", "split")).alias("l")
        return self.rows("item").groupBy(*KEY).agg(last).select(*KEY, "l.*")

    def whole(self) -> DataFrame:
        """Latest entries that hold what they say: skipped ones, and kept ones all of whose blocks are stored.
        The blocks themselves are not read for it."""
        held = self.rows("block").where(F.col("width") == F.col("seq_len") + 1).groupBy(*KEY, "build").agg(F.count_distinct("block_idx").alias("_held"))
        items = self.items()
        joined = items.join(held, same_key(items, held) & (items["build"] == held["build"]), "left").select(*(items[c] for c in items.columns), "_held")
        return joined.where((F.col("status") == "skipped") | (F.col("_held") == F.col("n_blocks"))).drop("_held")

    def pending(self, entries: DataFrame) -> DataFrame:
        """Entries (with KEY) that no build has tried, or whose blocks are not all stored."""
        done = self.whole()
        return entries.join(done, same_key(entries, done), "left_anti")

    def blocks(self, seq_len: int, stride: int) -> DataFrame:
        """The blocks of all whole items at these settings, each once; the filter prunes row groups."""
        done = self.whole().where((F.col("status") == "kept") & (F.col("seq_len") == seq_len) & (F.col("stride") == stride))
        rows = self.rows("block").where((F.col("seq_len") == seq_len) & (F.col("stride") == stride) & (F.col("width") == seq_len + 1))
        found = rows.join(done.select(*KEY, "build"), same_key(rows, done) & (rows["build"] == done["build"]), "left_semi")
        return found.drop("kind", "status", "reason", "n_blocks", "width")

    def append(self, items: DataFrame, build: int) -> None:
        """Rows of one build, with the columns of SCHEMA but build. They are written by the tasks that make them."""
        rows = items.withColumn("build", F.lit(build).cast("long"))
        names = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]
        rows.select(*names).sortWithinPartitions("kind", "sid", "subtune", "block_idx").write.mode("append").partitionBy("kind", "build").parquet(self.path)

    def compact(self, path: str) -> ItemStore:
        """A new store at path with the latest entry of every item and the blocks of whole ones, each with
        its build; readers move over once it is written."""
        items = self.items().withColumns({"kind": F.lit("item"), "block_idx": F.lit(-1).cast("long"), "width": F.lit(None).cast("int"), "block": F.lit(None).cast("array<smallint>")})
        done = self.whole().where("status = 'kept'")
        rows = self.rows("block")
        blocks = rows.join(done.select(*KEY, "build"), same_key(rows, done) & (rows["build"] == done["build"]), "left_semi")
        out = items.unionByName(blocks.select(*items.columns))
        out.write.partitionBy("kind", "build").parquet(path)
        return ItemStore(self.spark, path)
