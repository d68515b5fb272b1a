"""From manifests to stored blocks: look up the budget, recover tokens, cut windows, keep skip reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.expressions import resolve
from ..sources.file_scan import file_sizes, scan_files
from ..sources.item_store import KEY, ItemStore, same_key
from ..sources.text_sources import read_manifest
from .boundary import Codec, recover
from .splits import attach_budget, limit_entries, skip_reason, union_splits
from .windowing import window_at, window_count, windows


COUNTS = "split string, split_ord int, kept long, skipped long"


def with_budget(entries: DataFrame, durations: DataFrame, cfg: EngineConfig) -> DataFrame:
    """entries (content, subtune, ...) with content_md5 and frames."""
    named = entries.withColumn("content_md5", F.md5("content"))
    return attach_budget(named.withColumn("md5", F.col("content_md5")), durations, cfg.ntsc).drop("md5")


def recover_budgeted(entries: DataFrame, codec: Codec, untried: str | None = None) -> DataFrame:
    """entries (content, frames, ...) with ids and skip_reason, without content, in one pass. Only entries
    with a source and a budget reach the codec, and of these not those where the column untried holds."""
    able = F.col("content").isNotNull() & F.col("frames").isNotNull()
    able = able & ~F.col(untried) if untried else able
    flagged = entries.withColumns({"_found": F.col("content").isNotNull(), "content": F.when(able, F.col("content"))})
    done = recover(flagged, codec)
    size = F.coalesce(F.size("ids"), F.lit(0))
    reason = F.when(F.col("error").isNotNull(), F.lit("codec")).otherwise(skip_reason(F.col("_found"), F.col("frames"), size))
    return done.withColumn("skip_reason", reason).drop("error", "_found")


def recover_entries(entries: DataFrame, durations: DataFrame, codec: Codec, cfg: EngineConfig) -> DataFrame:
    """entries (sid, subtune, content, ...) with ids, skip_reason and content_md5, without content."""
    return recover_budgeted(with_budget(entries, durations, cfg), codec)


def build_blocks(recovered: DataFrame, cfg: EngineConfig) -> DataFrame:
    """The blocks of all entries that were kept."""
    kept = recovered.where(F.col("skip_reason").isNull())
    blocks = windows(kept, "ids", cfg.seq_len, cfg.stride)
    return blocks.withColumns({"seq_len": F.lit(cfg.seq_len), "stride": F.lit(cfg.stride)})


def build_store(manifests: list[tuple[str, DataFrame]], durations: DataFrame, codec: Codec, cfg: EngineConfig, store: ItemStore, name: str = "codec") -> DataFrame:
    """Build the items of manifests (split, entries) into store, and return (split, split_ord, kept, skipped).

    entries (line_no, sid, subtune, content) are limited to cfg.max_files each (0: none) before
    anything else. What the store holds in whole under the same key is not tried again; its status
    counts. All else runs through the codec once and is appended as build number one more than the
    last. Counts are observed in the pass that writes; as nothing is shuffled between, each task
    counts once. An entry that is listed several times counts each time and is stored once. A build
    that has nothing to write leaves no number.
    """
    if not manifests:
        return store.spark.createDataFrame([], COUNTS)
    limited = [(split, limit_entries(df.select("line_no", "sid", "subtune", "content"), cfg.max_files)) for split, df in manifests]
    return _build(union_splits(limited, mentions=True), [split for split, _ in manifests], durations, codec, cfg, store, name)


def build_corpus(
    spark: SparkSession, manifests: list[tuple[str, str]], root: str, durations: DataFrame, codec: Codec, cfg: EngineConfig, store: ItemStore, staging: str, name: str = "codec"
) -> DataFrame:
    """As build_store, from manifest files: (split, path) each, with paths of sources below root.

    Manifests are limited first; then only the files they name are opened, each once. staging is a new
    folder for the listing of these. A missing manifest is an empty one.
    """
    if not manifests:
        return build_store([], durations, codec, cfg, store)
    limited = [(split, limit_entries(read_manifest(spark, path), cfg.max_files)) for split, path in manifests]
    named = union_splits(limited, mentions=True).withColumn("sid", resolve(F.col("relpath"), root))
    file_sizes(named, "sid").write.parquet(staging)
    entries = scan_files(spark.read.parquet(staging), ["mention", "line_no"], "sid").drop("size", "content_md5", "missing")
    return _build(entries, [split for split, _ in manifests], durations, codec, cfg, store, name)


def _build(entries: DataFrame, named: list[str], durations: DataFrame, codec: Codec, cfg: EngineConfig, store: ItemStore, name: str) -> DataFrame:
    """The build of entries (split, split_ord, mention, line_no, sid, subtune, content), whose splits are named in order."""
    entries = with_budget(entries, durations, cfg)
    entries = entries.withColumns({"seq_len": F.lit(cfg.seq_len), "stride": F.lit(cfg.stride), "codec": F.lit(name)})
    again = F.row_number().over(Window.partitionBy(*KEY).orderBy("mention", "line_no")) > 1
    entries = entries.withColumn("again", again)
    held = store.whole().select(*KEY, F.col("status").alias("held"))
    known = entries.join(held, same_key(entries, held), "left").select(*(entries[c] for c in entries.columns), "held").withColumn("known", F.col("held").isNotNull())
    done = recover_budgeted(known, codec, "known")
    status = F.coalesce("held", F.when(F.col("skip_reason").isNull(), F.lit("kept")).otherwise(F.lit("skipped")))
    n = F.when(F.col("skip_reason").isNull(), window_count(F.size("ids"), cfg.seq_len, cfg.stride)).otherwise(F.lit(0))
    items = done.withColumns({"status": status, "n_blocks": n.cast("long")}).withColumnRenamed("skip_reason", "reason")
    splits = list(dict.fromkeys(named))
    seen = Observation()
    count = lambda i, s: F.count_if((F.col("split_ord") == i) & (F.col("status") == s)).alias(f"{s} {i}")
    counted = items.observe(seen, *(count(i, s) for i in range(len(splits)) for s in ("kept", "skipped")))
    # one row for the item, with index -1, and one for each of its blocks
    rows = counted.where("NOT known AND NOT again").withColumn("block_idx", F.explode(F.sequence(F.lit(-1).cast("long"), F.col("n_blocks") - 1)))
    block = F.when(F.col("block_idx") >= 0, window_at("ids", F.col("block_idx"), cfg.stride, cfg.seq_len + 1).cast("array<smallint>"))
    rows = rows.withColumns({"block": block, "kind": F.when(F.col("block_idx") < 0, "item").otherwise("block"), "width": F.when(F.col("block_idx") >= 0, F.lit(cfg.seq_len + 1))})
    store.append(rows, store.next_build())
    got = seen.get
    made = [(split, i, got[f"kept {i}"], got[f"skipped {i}"]) for i, split in enumerate(splits)]
    return store.spark.createDataFrame(made, COUNTS)
