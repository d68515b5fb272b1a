"""Every operator as a query over the driver's tables.

The tables hold no manifests, tokens or registers, so each query derives its input from theirs by
rules that SQL can state as well; sql.py has the same in SQL.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import bfloat16
from ..functions import expressions as X
from ..operators import block_index, boundary, build, change_log, choose, metrics, prompts, runs, sampling, splits, windowing
from ..sources import block_store, file_scan, item_store, npy_blocks, shuffled_store, text_sources

VOCAB = 256
#: Window length and strides of the queries.
SEQ = 16
#: Ranges of program ids and their labels: a made-up vocabulary, as the real one is not public.
RANGES = [("byte", 0, 3, "BYTE_{n}"), ("cmd", 4, 6, "CMD_{n}"), ("note", 7, 15, "NOTE_{d}"), ("end", 16, 16, "END")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(array: Column | str) -> Column:
    """An array as text, which every engine hashes alike."""
    array = F.col(array) if isinstance(array, str) else array
    return F.array_join(array.cast("array<string>"), ",")


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and the executors share: in the one that the session names, or,
    where the executors are threads of the driver, beside the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-shared"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table of its own, so that what reads it twice makes it once."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", "lang", windowing.toy_tokens(F.col("text"), VOCAB).alias("ids"))


def blocks(spark: SparkSession, sf_dir: str, stride: int = SEQ) -> DataFrame:
    return windowing.windows(tokens(spark, sf_dir), "ids", SEQ, stride)


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks per document, by the closed formula: no block is made to be counted."""
    n = windowing.window_count(F.size("ids"), SEQ, SEQ)
    return tokens(spark, sf_dir).select(F.col("doc_id").alias("file_ord"), n.cast("long").alias("n"))


def index_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all documents: texts are read once, and what is left of them is written."""
    return written(block_index.build_index(written(counts(spark, sf_dir))))


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_of(spark, sf_dir)
    return block_index.with_global_index(blocks(spark, sf_dir).withColumnRenamed("doc_id", "file_ord"), index)


def flagship_window_totals(spark, sf_dir):
    real = F.size(F.filter(X.xy(F.col("block"))[1], lambda y: y != 0))
    return blocks(spark, sf_dir).groupBy("source", "lang").agg(F.count("*").alias("n_blocks"), F.sum(real).alias("n_targets"), F.count_distinct("doc_id").alias("n_docs"))


def manifest_parse(spark, sf_dir):
    name, size = F.translate("p_name", " ", "_"), F.col("p_size").cast("string")
    kind = F.col("p_partkey") % 5
    line = (
        F.when(kind == 0, F.concat(name, F.lit(" \t"), size)).when(kind == 1, F.concat(F.lit("# "), name)).when(kind == 2, F.lit("  "))
        .when(kind == 3, F.concat("p_brand", F.lit("/x.sid  "), size)).otherwise(F.concat(name, F.lit("  "), size, F.lit(" # "), F.col("p_type")))
    )
    return text_sources.parse_manifest(table(spark, sf_dir, "part").select("p_partkey", line.alias("line")))


def eval_spec_parse(spark, sf_dir):
    spec = F.concat(F.lit(" eval-"), "n_name", F.lit(" = /lists/a="), F.col("n_nationkey").cast("string"), F.lit(";;bare ; x=/b.list;"))
    return text_sources.parse_eval_spec(table(spark, sf_dir, "nation").select("n_nationkey", spec.alias("spec")), "spec")


def _duration() -> Column:
    text = lambda c: c.cast("string")
    m, s, kind = text(F.col("o_orderkey") % 97), F.lpad(text(F.col("o_custkey") % 60), 2, "0"), F.col("o_orderkey") % 4
    return (
        F.when(kind == 0, F.concat(m, F.lit(":"), s)).when(kind == 1, F.concat(m, F.lit(":"), s, F.lit("."), text(F.col("o_orderkey") % 1000)))
        .when(kind == 2, F.concat(text(F.col("o_custkey") % 3), F.lit(":"), m, F.lit(":"), s)).otherwise(s)
    )


def duration_seconds(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.duration_seconds(_duration()).alias("seconds"))


def frame_budget(spark, sf_dir):
    seconds = X.duration_seconds(_duration())
    return table(spark, sf_dir, "orders").select("o_orderkey", X.frame_budget(seconds).alias("pal"), X.frame_budget(seconds, ntsc=True).alias("ntsc"))


def _durations(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id")
    times = F.concat((d % 7).cast("string"), F.lit(":"), F.lpad((d % 60).cast("string"), 2, "0"), F.lit("  0:30"))
    line = F.when(d % 11 == 0, F.concat(F.lit("; "), F.md5(F.col("text").cast("binary")))).otherwise(
        F.concat(F.upper(F.md5(F.col("text").cast("binary"))), F.lit("="), F.when(d % 13 == 0, F.lit("")).otherwise(times)))
    return text_sources.last_wins(text_sources.parse_durations(table(spark, sf_dir, "documents").select("doc_id", line.alias("line"))), "doc_id")


def duration_index_lastwins(spark, sf_dir):
    return _durations(spark, sf_dir).select("md5", joined("times").alias("times"))


def duration_lookup(spark, sf_dir):
    entries = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"), (F.col("doc_id") % 4).cast("int").alias("subtune"))
    return splits.attach_budget(entries, _durations(spark, sf_dir)).select("doc_id", "subtune", F.col("frames").isNotNull().alias("found"), F.coalesce("frames", F.lit(0)).alias("frames"))


def content_md5(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"))


def token_encode(spark, sf_dir):
    return tokens(spark, sf_dir).select("doc_id", joined(X.encode(F.col("ids"))).alias("ids"))


def token_decode(spark, sf_dir):
    return tokens(spark, sf_dir).select("doc_id", joined(X.decode(F.transform("ids", lambda x: (x * 7) % 19 - 1), 12)).alias("ids"))


def token_label(spark, sf_dir):
    ids = tokens(spark, sf_dir).select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return ids.select("id", X.token_label(F.col("id"), RANGES).alias("label"), "n")


def vocabulary(spark, sf_dir):
    """The dense table of all model ids, their labels and how often the documents have them."""
    ids = tokens(spark, sf_dir).select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    dense = spark.range(VOCAB + 1).select(F.col("id"), X.token_label(F.col("id"), RANGES).alias("label"))
    return dense.join(ids, "id", "left").select("id", "label", F.coalesce("n", F.lit(0)).alias("n"))


def _windows(stride: int):
    return lambda spark, sf_dir: blocks(spark, sf_dir, stride).select("doc_id", "block_idx", joined("block").alias("block"))


def xy_shift(spark, sf_dir):
    x, y = X.xy(F.col("block"))
    return blocks(spark, sf_dir).select("doc_id", "block_idx", joined(x).alias("x"), joined(y).alias("y"))


def block_path(spark, sf_dir):
    sid = F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit(".sid"))).otherwise(F.col("url"))
    rel = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/"), sid)).otherwise(sid)
    sub = F.col("page_id") % 5
    return table(spark, sf_dir, "pages").select("page_id", X.block_path(sid, sub).alias("blocks"), X.resolve(rel, "/root/dir").alias("resolved"))


def path_suffix(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.path_suffix(F.col("url"), (F.col("page_id") % 4).cast("int")).alias("path"))


def split_union(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    parts = [("train", docs.where("lang = 'en'")), ("eval-de", docs.where("lang = 'de'")), ("train", docs.where("lang = 'fr'")), ("eval-de", docs.where("lang = 'de'"))]
    return splits.union_splits(parts).groupBy("split", "split_ord").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def split_fallback(spark, sf_dir):
    sources = table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("split_ord")).select(F.col("source").alias("split"), "split_ord")
    named = sources.unionByName(spark.range(1).select(F.lit("val").alias("split"), F.lit(10**9).cast("long").alias("split_ord")))
    wanted = [("src3", named), ("none", named), ("none", sources)]
    out = [splits.select_split(df, w).withColumn("case", F.lit(i)) for i, (w, df) in enumerate(wanted)]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _reasons(spark, sf_dir) -> DataFrame:
    rows = tokens(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "quality").dropDuplicates(["doc_id"]), "doc_id", "left")
    frames = F.when(F.col("quality") == 1, F.size("ids"))
    return rows.select("doc_id", F.col("source").alias("split"), splits.skip_reason(F.col("quality").isNotNull(), frames, F.size("ids")).alias("skip_reason"))


def skip_reasons(spark, sf_dir):
    return _reasons(spark, sf_dir)


def kept_skipped(spark, sf_dir):
    return splits.kept_skipped(_reasons(spark, sf_dir))


def max_files_limit(spark, sf_dir):
    entries = table(spark, sf_dir, "documents").select("doc_id", "source")
    return splits.limit_entries(entries, 50, "doc_id")


def _keyed(spark, sf_dir, stride: Column) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("sid"), F.lit(1).alias("subtune"), F.md5(F.col("text").cast("binary")).alias("content_md5"), F.lit(SEQ).alias("seq_len"), stride.cast("int").alias("stride"), "doc_id")


def cache_decision(spark, sf_dir):
    stride = F.when(F.col("doc_id") % 3 == 0, F.lit(SEQ // 2)).otherwise(F.lit(SEQ))
    store = _keyed(spark, sf_dir, stride).drop("doc_id").withColumn("block_idx", F.lit(0))
    return block_store.cache_decision(_keyed(spark, sf_dir, F.lit(SEQ)), store).select("doc_id", "cached")


def cache_pending(spark, sf_dir):
    stride = F.when(F.col("doc_id") % 3 == 0, F.lit(SEQ // 2)).otherwise(F.lit(SEQ))
    return block_store.pending(_keyed(spark, sf_dir, F.lit(SEQ)), _keyed(spark, sf_dir, stride)).select("doc_id")


def block_store_roundtrip(spark, sf_dir):
    rows = windowing.windows(tokens(spark, sf_dir).join(_keyed(spark, sf_dir, F.lit(SEQ)), "doc_id"), "ids", SEQ, SEQ)
    path = scratch(spark)
    block_store.write_blocks(rows.select("sid", "subtune", "content_md5", "block_idx", "block", "seq_len", "stride"), path)
    return block_store.read_blocks(spark, path, SEQ, SEQ).select("sid", "block_idx", joined("block").alias("block"))


class WordLengths:
    """The stand-in codec on bytes: a word's program id is its length; it refuses a source with a `$`."""

    def encode(self, content: bytes, subtune: int, frames: int) -> list[int]:
        text = content.decode()
        if "$" in text:
            raise ValueError("no driver matches")
        return [len(w) % VOCAB for w in re.findall(r"[^\x20\x09-\x0D]+", text)][:frames]

    def decodes(self, ids: list[int]) -> bool:
        return sum(ids) % 3 != 0


def _manifests(spark, sf_dir) -> list[tuple[str, DataFrame]]:
    """A manifest per language; some sources are missing, some subtunes have no time."""
    docs = table(spark, sf_dir, "documents")
    content = F.when(F.col("doc_id") % 17 != 0, F.col("text").cast("binary"))
    rows = docs.select("lang", F.col("doc_id").alias("line_no"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".sid")).alias("sid"), (F.col("doc_id") % 4).cast("int").alias("subtune"), content.alias("content"))
    return [(split, rows.where(F.col("lang") == lang).drop("lang")) for split, lang in (("train", "en"), ("eval-de", "de"), ("eval-x", "fr"), ("eval-x", "es"))]


def _built(spark, sf_dir, *when: Column) -> tuple[item_store.ItemStore, DataFrame]:
    """The store after a build of the entries for which each of when holds, one after the other; the last counts."""
    store, durations = item_store.ItemStore(spark, scratch(spark)), written(_durations(spark, sf_dir))
    cfg, counts = EngineConfig(seq_len=SEQ, max_files=0), None
    for own in when:
        counts = build.build_store([(split, rows.where(own)) for split, rows in _manifests(spark, sf_dir)], durations, WordLengths(), cfg, store)
    return store, counts


def build_counts(spark, sf_dir):
    """What a build kept and skipped, observed in the pass that wrote it."""
    return _built(spark, sf_dir, F.lit(True))[1]


def build_blocks(spark, sf_dir):
    """The blocks that a build stored."""
    rows = _built(spark, sf_dir, F.lit(True))[0].blocks(SEQ, SEQ)
    return rows.select("split", "sid", "subtune", "block_idx", joined("block").alias("block"))


def build_items(spark, sf_dir):
    """The items after a build of some entries, then one of all: what the first has is not built again."""
    store, counts = _built(spark, sf_dir, F.col("line_no") % 3 == 0, F.lit(True))
    return store.items().select("split", "sid", "status", "reason", "n_blocks", "build")


def build_counts_again(spark, sf_dir):
    """The second build's counts: what is stored counts, too."""
    return _built(spark, sf_dir, F.col("line_no") % 3 == 0, F.lit(True))[1]


def _corpus(spark, sf_dir) -> tuple[item_store.ItemStore, DataFrame]:
    """From manifest files, sources and a file of durations to the store; some sources are missing."""
    base = scratch(spark)
    parts = _manifests(spark, sf_dir)
    for i, (_, rows) in enumerate(parts):
        file_scan.write_files(rows.where("content IS NOT NULL").select(F.concat(F.lit(f"{base}/in/"), "sid").alias("path"), "content"))
        lines = rows.repartition(1).sortWithinPartitions("line_no").select(F.concat("sid", F.lit("\t"), F.col("subtune").cast("string")).alias("value"))
        lines.write.text(f"{base}/manifest{i}")
    times = written(_durations(spark, sf_dir))
    times.repartition(1).select(F.concat("md5", F.lit("="), F.array_join("times", " ")).alias("value")).write.text(f"{base}/durations")
    cfg, store = EngineConfig(seq_len=SEQ, max_files=0), item_store.ItemStore(spark, f"{base}/store")
    named = [(split, f"{base}/manifest{i}") for i, (split, _) in enumerate(parts)] + [("eval-none", f"{base}/no such manifest")]
    counts = build.build_corpus(spark, named, f"{base}/in", text_sources.read_durations(spark, f"{base}/durations"), WordLengths(), cfg, store, f"{base}/listing")
    return store, counts


def corpus_counts(spark, sf_dir):
    """Kept and skipped of each split, from manifest files to stored blocks in one build."""
    return _corpus(spark, sf_dir)[1]


def corpus_blocks(spark, sf_dir):
    rows = _corpus(spark, sf_dir)[0].blocks(SEQ, SEQ)
    return rows.select("split", F.regexp_extract("sid", r"[^/]+/[^/]+$", 0).alias("sid"), "subtune", "block_idx", joined("block").alias("block"))


def _npy(spark, sf_dir) -> DataFrame:
    """Files of blocks, one a document, and the manifest of all documents: some name no file."""
    base = scratch(spark)
    name = F.concat(F.lit(f"{base}/"), "source", F.lit("/"), X.block_path(F.concat(F.col("doc_id").cast("string"), F.lit(".sid")), F.lit(1)))
    rows = blocks(spark, sf_dir)
    npy_blocks.write_npy(rows.where("doc_id % 5 <> 0").withColumn("path", name), SEQ)
    return written(file_scan.file_sizes(table(spark, sf_dir, "documents").select("doc_id", name.alias("path"))))


def npy_roundtrip(spark, sf_dir):
    """Blocks written as `.npy` files and read again by ranges of rows."""
    counted = npy_blocks.npy_counts(_npy(spark, sf_dir), SEQ)
    return npy_blocks.read_npy(counted, SEQ, range_bytes=4096).select("doc_id", "block_idx", joined("block").alias("block"))


def scan_manifest(spark, sf_dir):
    """The files that a manifest names, hashed; missing ones with their reason."""
    rows = file_scan.scan_files(_npy(spark, sf_dir), ["doc_id"])
    return rows.select("doc_id", "size", F.length("content").cast("long").alias("read"), F.md5("content").eqNullSafe(F.col("content_md5")).alias("same"), "missing")


def block_counts(spark, sf_dir):
    return block_index.block_counts(blocks(spark, sf_dir), "doc_id")


def global_index(spark, sf_dir):
    return block_index.build_index(written(counts(spark, sf_dir)))


def index_lookup(spark, sf_dir):
    index = index_of(spark, sf_dir)
    total = index.agg(F.sum("n")).first()[0]
    asked = table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") * 7919) % total).alias("idx"))
    return block_index.lookup(asked, index)


def get_block(spark, sf_dir):
    return block_index.get_block(blocks(spark, sf_dir).withColumnRenamed("doc_id", "file_ord"), 7, 1).select("file_ord", "block_idx", joined("block").alias("block"))


def seeded_shuffle(spark, sf_dir):
    files = written(counts(spark, sf_dir).select(F.col("file_ord").alias("file"), "n"))
    return block_index.build_index(block_index.seeded_shuffle(files, "file", 3))


def sample_exact_n(spark, sf_dir):
    """Numbers are drawn and then looked up: no block is made to be counted or drawn."""
    index = index_of(spark, sf_dir)
    numbers = spark.range(index.agg(F.sum("n")).first()[0] or 0).select(F.col("id").alias("global_idx"))
    drawn = sampling.sample_exact(numbers, 0.05, seed=5, epoch=2)
    return block_index.lookup(drawn, index, on="global_idx").select("global_idx", "file_ord", "block_idx")


def sample_passes(spark, sf_dir):
    """A fraction over 1: two whole passes in orders of their own and a part of a third, in batches."""
    index = index_of(spark, sf_dir)
    numbers = spark.range(index.agg(F.sum("n")).first()[0] or 0).select(F.col("id").alias("global_idx"))
    drawn = sampling.sample_exact(numbers, 2.3, seed=5, epoch=2)
    return sampling.batches(drawn, 8, "draw", "global_idx").select("batch", joined(F.transform("members", lambda m: m["global_idx"])).alias("members"))


def _sampled(spark, sf_dir) -> DataFrame:
    rows = numbered(spark, sf_dir).select("global_idx", "block")
    total = index_of(spark, sf_dir).agg(F.sum("n")).first()[0] or 0
    path = scratch(spark)
    shuffled_store.write_shuffled(rows, path, total, seed=7, files=8)
    return shuffled_store.fetch(spark, path, 0.05, seed=7, epoch=3)


def sampled_blocks(spark, sf_dir):
    """A sample from the store in seeded order: only its range of places is read."""
    return _sampled(spark, sf_dir).select("draw", "global_idx", joined("x").alias("x"), joined("y").alias("y"))


def sampled_batches(spark, sf_dir):
    """The same sample in batches of inputs and targets."""
    made = sampling.batches(_sampled(spark, sf_dir), 8, "draw", "x", "y")
    return made.select("batch", F.size("members").cast("long").alias("n"), *(joined(F.flatten(F.col(f"members.{c}"))).alias(c) for c in ("x", "y")))


def _split_files(spark, sf_dir) -> DataFrame:
    """Files of several manifests: one split is named twice, one has no file."""
    rows = written(tokens(spark, sf_dir).select("doc_id", "lang", windowing.window_count(F.size("ids"), SEQ, SEQ).cast("long").alias("n")))
    parts = [("eval-fr", "fr"), ("train", "en"), ("eval-de", "de"), ("none", "xx"), ("eval-fr", "es"), ("eval-de", "de")]
    return splits.union_splits([(name, rows.where(F.col("lang") == lang).withColumnRenamed("doc_id", "line_no")) for name, lang in parts], mentions=True)


def split_index(spark, sf_dir):
    return block_index.split_index(_split_files(spark, sf_dir)).select("split", "mention", "line_no", "n", "cum")


def split_loaders(spark, sf_dir):
    return block_index.loaders(block_index.split_index(_split_files(spark, sf_dir)), 8)


def split_batches(spark, sf_dir):
    """Batches of each split's blocks in its own numbers."""
    index = written(block_index.split_index(_split_files(spark, sf_dir)))
    rows = blocks(spark, sf_dir).select(F.col("doc_id").alias("line_no"), "block_idx", "block")
    places = index.select("split", "mention", "line_no", "cum")
    numbered_rows = rows.join(places, "line_no").withColumn("global_idx", F.col("cum") + F.col("block_idx"))
    made = sampling.batches(numbered_rows, 8, "global_idx", "line_no", "block", keys=("split",))
    first = F.transform("members", lambda m: F.concat_ws(":", m["line_no"].cast("string"), m["block"][0].cast("string")))
    return made.select("split", "batch", F.size("members").cast("long").alias("n"), joined(first).alias("members"))


def sample_with_replacement(spark, sf_dir):
    index = index_of(spark, sf_dir)
    return sampling.sample_with_replacement(blocks(spark, sf_dir), index, 500, seed=9)


def numbered_blocks(spark, sf_dir):
    return numbered(spark, sf_dir).select("global_idx", "file_ord", "block_idx", joined("block").alias("block"))


def batches(spark, sf_dir):
    total = index_of(spark, sf_dir).agg(F.sum("n")).first()[0] or 0
    made = sampling.batches(spark.range(total).select(F.col("id").alias("global_idx")), 8)
    return made.select("batch", F.size("members").cast("long").alias("n"), joined(F.transform("members", lambda m: m["global_idx"])).alias("members"))


def fan_out(spark, sf_dir):
    return sampling.fan_out(table(spark, sf_dir, "benchmark").select("item_id"), 3)


def prompt_select(spark, sf_dir):
    rows = blocks(spark, sf_dir).withColumn("path", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")))
    return prompts.select_prompts(rows, 8, 6, 5).select("path", joined("prompt").alias("prompt"), joined("truth").alias("truth"))


def prompt_slice(spark, sf_dir):
    rows = prompts.prompt_slice(tokens(spark, sf_dir), "ids", 4, 10)
    return rows.select("doc_id", joined("prompt").alias("prompt"), F.col("n_generate").cast("long").alias("n_generate"), joined("compare").alias("compare"))


def _truth_pred(spark, sf_dir) -> DataFrame:
    """Truth and a prediction that is off at every third place and may be longer."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", windowing.toy_tokens(F.col("text"), VOCAB).alias("gt"))
    off = F.transform("gt", lambda x, i: F.when((x + i) % 3 == 0, x + 1).otherwise(x))
    return rows.select("item_id", "gt", F.concat(off, F.array(F.lit(1), F.lit(2))).alias("pred"))


def concat_stream(spark, sf_dir):
    return _truth_pred(spark, sf_dir).select("item_id", joined(F.concat(F.slice("gt", 1, 3), "pred")).alias("ids"))


def greedy_accuracy(spark, sf_dir):
    return _truth_pred(spark, sf_dir).select("item_id", F.round(X.overlap_accuracy(F.col("gt"), F.col("pred")), 9).alias("acc"))


def _compared(spark, sf_dir) -> DataFrame:
    rows = _truth_pred(spark, sf_dir)
    return metrics.compare(rows.select("item_id", F.col("gt").alias("ids")), rows.select("item_id", F.col("pred").alias("ids")), "item_id")


def gt_pred_compare(spark, sf_dir):
    """As the comparison file has it: gt is blank beyond the truth's end."""
    return _compared(spark, sf_dir).select("item_id", "i", F.coalesce(F.col("gt").cast("string"), F.lit("")).alias("gt"), "pred")


def compare_csv(spark, sf_dir):
    """The comparison file, written and read again."""
    path = scratch(spark)
    metrics.write_compare(_compared(spark, sf_dir).select("item_id", "i", "gt", "pred"), path)
    rows = spark.read.option("header", True).schema("item_id long, i int, gt string, pred long").csv(path)
    return rows.withColumn("gt", F.coalesce("gt", F.lit("")))


def truth_fallback(spark, sf_dir):
    ids = prompts.continuation(F.col("pred"), F.col("gt"), F.size("gt") % 4 != 0)
    return _truth_pred(spark, sf_dir).select("item_id", joined(ids).alias("ids"))


def macro_accuracy(spark, sf_dir):
    pairs = _compared(spark, sf_dir).where(F.col("gt").isNotNull())
    return metrics.macro_accuracy(pairs, "item_id").select("item_id", F.round("macro_accuracy", 9).alias("macro_accuracy"))


def argmax_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", X.argmax(F.col("embedding")).alias("pred"))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("label")).alias("correct"), F.sum("pred").alias("preds"))


def top_k(spark, sf_dir):
    best = table(spark, sf_dir, "embeddings").select("vec_id", X.top_k(F.col("embedding"), 3, 0.5).alias("best"))
    return best.select("vec_id", joined(F.transform("best", lambda x: x["id"])).alias("ids"), F.round(F.get("best", F.lit(0))["p"], 6).alias("p"))


def choose_token(spark, sf_dir):
    """Two steps of tokens drawn at a temperature, from all ids and from the three largest."""
    rows = table(spark, sf_dir, "embeddings").withColumn("step", F.explode(F.array(F.lit(0), F.lit(1))))
    key = (F.col("vec_id"), F.col("step"))
    return rows.select("vec_id", "step", X.choose_token(F.col("embedding"), 0.8, *key, seed=4).alias("any"), X.choose_token(F.col("embedding"), 0.8, *key, k=3, seed=4).alias("of_three"))


def narrow_bfloat16(spark, sf_dir):
    """Vectors as the 16 bits of bfloat16."""
    rows = bfloat16.narrow_bfloat16(table(spark, sf_dir, "embeddings"), ["vec_id", "embedding"], as_bits=True)
    return rows.select("vec_id", joined("embedding").alias("bits"))


def cross_entropy(spark, sf_dir):
    at = (F.col("label") % F.size("embedding")).cast("int")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(X.cross_entropy(F.col("embedding").cast("array<double>"), at), 6).alias("loss"), F.round(X.cross_entropy(F.col("embedding").cast("array<double>"), at, 0.1), 6).alias("smoothed"))


def _scored(spark, sf_dir) -> DataFrame:
    """A token per line item: y is 0 (padding) at times, the loss a whole number of hundredths."""
    y = F.col("l_quantity").cast("int") % 5
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("split"), (F.col("l_orderkey") % 50).alias("batch"), y.alias("y"), (F.col("l_linenumber") % 5).alias("pred"), F.round(F.col("l_discount") * 100).alias("loss"))


def masked_mean(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("split", "batch").agg(F.round(metrics.masked_mean(F.col("loss"), F.col("y")), 9).alias("loss"))


def subset_metrics(spark, sf_dir):
    made = metrics.subset_metrics(metrics.batch_partials(_scored(spark, sf_dir), "split", "batch"), "split")
    return made.select("split", "loss_sum", "correct_sum", "tok_sum", F.round("loss", 9).alias("loss"), F.round("acc", 9).alias("acc"))


def micro_macro(spark, sf_dir):
    made = metrics.micro_macro(metrics.batch_partials(_scored(spark, sf_dir), "split", "batch"))
    return made.select(*(F.round(c, 9).alias(c) for c in ("micro_loss", "micro_acc", "macro_loss", "macro_acc")), "subsets")


def micro_rollup(spark, sf_dir):
    return metrics.micro_rollup(metrics.batch_partials(_scored(spark, sf_dir), "split", "batch"))


def _history(spark, sf_dir) -> DataFrame:
    return _scored(spark, sf_dir).groupBy("split", F.col("batch").alias("epoch")).agg(F.sum("loss").alias("val_loss"))


def best_epoch(spark, sf_dir):
    return metrics.best_epoch(_history(spark, sf_dir), "val_loss", "epoch", "split")


def early_stop(spark, sf_dir):
    return metrics.early_stop(_history(spark, sf_dir), "val_loss", "epoch", 3, 1.0, "split")


def early_stop_threshold(spark, sf_dir):
    """A falling loss per customer, checked order by order, with a threshold."""
    loss = (F.lit(100) - F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))) * 4 + F.col("o_orderkey") % 11
    history = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", loss.cast("double").alias("loss"))
    return metrics.early_stop(history, "loss", "o_orderkey", 3, 6.0, "o_custkey", threshold=350.0)


def epoch_scores(spark, sf_dir):
    """Of all subsets, and of one alone."""
    partials = metrics.batch_partials(_scored(spark, sf_dir), "split", "batch")
    rows = [metrics.epoch_scores(df).withColumn("of", F.lit(of)) for of, df in (("all", partials), ("one", partials.where("split = 'R'")))]
    return rows[0].unionByName(rows[1]).select("of", F.round("val_loss", 9).alias("val_loss"), F.round("val_acc", 9).alias("val_acc"))


def _gate(spark, sf_dir) -> DataFrame:
    rows = _truth_pred(spark, sf_dir).select(F.col("item_id").cast("string").alias("path"), X.overlap_accuracy(F.col("gt"), F.col("pred")).alias("acc"), (F.size("gt") % 4 != 0).alias("decodes"))
    return metrics.gate_report(rows, 0.25, 0.5)


def gate_report(spark, sf_dir):
    return _gate(spark, sf_dir).select(
        "passed", F.round("mean_greedy_acc", 9).alias("mean_greedy_acc"), F.round("decode_rate", 9).alias("decode_rate"), "n_prompts", "reason",
        F.array_join(F.transform("per_prompt", lambda p: F.concat_ws(":", p["path"], F.round(p["acc"] * 1000000).cast("long").cast("string"), p["decodes"].cast("string"))), ",").alias("per_prompt"))


def gate_run(spark, sf_dir):
    """The gate from a listing of block files to its report."""
    cfg = EngineConfig(seq_len=SEQ, prompt_seq_len=6, gen_tokens=5, n_prompts=100, vocab=VOCAB, min_acc=0.01, grammar_min=0.5)
    counted = written(npy_blocks.npy_counts(_npy(spark, sf_dir), SEQ))
    report = runs.run_gate(counted, boundary.ToyGenerator(), WordLengths(), cfg)
    hits = F.array_join(F.transform("per_prompt", lambda p: F.concat_ws(":", F.regexp_extract(p["path"], r"[^/]+/[^/]+$", 0), F.round(p["acc"] * 1000000).cast("long").cast("string"), p["decodes"].cast("string"))), ",")
    return report.select("passed", F.round("mean_greedy_acc", 9).alias("mean_greedy_acc"), F.round("decode_rate", 9).alias("decode_rate"), "n_prompts", hits.alias("per_prompt"))


def predict_run(spark, sf_dir):
    """Three predictions each from the first block of a file of the split wanted, and of the one that stands in for it."""
    docs = tokens(spark, sf_dir)
    files = docs.select("doc_id", "source", F.dense_rank().over(Window.partitionBy("source").orderBy("doc_id")).alias("r"))
    order = docs.groupBy("source").agg(F.min("doc_id").alias("split_ord"))
    rows = windowing.windows(docs, "ids", SEQ, SEQ).join(files, ["doc_id", "source"]).join(order, "source")
    rows = written(rows.select(F.col("source").alias("split"), "split_ord", (F.col("r") - 1).cast("long").alias("file_ord"), "block_idx", "block"))
    made = []
    for wanted in ("src3", "no such split"):
        cfg = EngineConfig(seq_len=SEQ, prompt_seq_len=4, max_seq_len=10, predictions=3, predict_set=wanted, vocab=VOCAB)
        made.append(runs.predict(rows, boundary.ToyGenerator(), WordLengths(), cfg, start_seq=1).withColumn("wanted", F.lit(wanted)))
    return made[0].unionByName(made[1]).select("wanted", "p", joined("ids").alias("ids"), F.round("acc", 9).alias("acc"), "decodes", joined("program").alias("program"))


def gate_json(spark, sf_dir):
    """The report's line of JSON, read again by its fields."""
    line = metrics.gate_json(_gate(spark, sf_dir).drop("per_prompt")).select(F.substring_index("line", "EVENT_GATE_RESULT ", -1).alias("j"))
    return line.select(F.get_json_object("j", "$.passed").alias("passed"), F.get_json_object("j", "$.n_prompts").alias("n_prompts"), F.get_json_object("j", "$.min_acc").alias("min_acc"))


def _states(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("chip"), F.col("event_id").alias("frame"), F.col("event_type").alias("reg"), (F.floor(F.col("value")) % 3).cast("long").alias("val"))


def change_log_q(spark, sf_dir):
    return change_log.change_log(_states(spark, sf_dir), X.PAL_CYCLES, "chip")


def forward_fill(spark, sf_dir):
    states = _states(spark, sf_dir)
    log = change_log.change_log(states, X.PAL_CYCLES, "chip")
    return change_log.forward_fill(log, states.select("chip", "frame", "reg"), X.PAL_CYCLES, "chip")


def latest_with_fallback(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("dir"), (F.col("event_type") == "click").alias("best"), "ts", F.format_string("%08d.ckpt", "event_id").alias("path"))
    return choose.latest_with_fallback(rows, "best", "ts", "path", "dir").select("dir", "path", "best")


def prune_and_narrow(spark, sf_dir):
    rows = choose.prune_and_narrow(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_extendedprice", "l_missing", "l_tax"])
    return rows.withColumns({"l_extendedprice": F.round(F.col("l_extendedprice").cast("double"), 1), "l_tax": F.round(F.col("l_tax").cast("double"), 4)})
