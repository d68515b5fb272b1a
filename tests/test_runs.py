"""Whole runs, and the parts that no query reaches."""

import hashlib
import json
import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.config import EngineConfig
from tessera.operators import boundary, change_log, metrics, runs, splits
from tessera.sources import file_scan, npy_blocks, shuffled_store, text_sources


def listing(spark, tmp_path, files):
    for name, blocks in files.items():
        np.save(tmp_path / name, np.array(blocks, dtype=np.int16))
    entries = spark.createDataFrame([(f"{tmp_path}/{name}",) for name in files], "path string")
    return npy_blocks.npy_counts(file_scan.file_sizes(entries), 4)


def test_gate_opens_files_until_it_has_enough(spark, tmp_path, monkeypatch):
    short, good = [[1, 2, 0, 0, 0]], [[1, 0, 0, 0, 0], [3, 4, 0, 5, 6], [9, 9, 9, 9, 9]]
    files = {f"{i:03}.blocks.npy": good if i in (2, 60, 61) else short for i in range(70)}
    counted = listing(spark, tmp_path, files).cache()
    asked, read = [], runs.read_npy
    monkeypatch.setattr(runs, "read_npy", lambda df, n: (asked.append(df.count()), read(df, n))[1])
    cfg = EngineConfig(seq_len=4, prompt_seq_len=3, gen_tokens=9, n_prompts=1, vocab=50)
    got = runs.gate_prompts(counted, cfg).collect()
    assert [(r["path"][-14:], r["prompt"], r["truth"]) for r in got] == [("002.blocks.npy", [3, 4, 5], [6])] and asked == [4]
    asked.clear()
    report = runs.run_gate(counted, boundary.ToyGenerator(), boundary.ToyCodec(50), EngineConfig(seq_len=4, prompt_seq_len=3, gen_tokens=9, n_prompts=3, vocab=50, min_acc=0.9)).first()
    assert asked == [12, 48, 70] and (report["passed"], report["n_prompts"], report["mean_greedy_acc"]) == (True, 3, 1.0)
    none = runs.run_gate(counted.where(F.col("path").endswith("000.blocks.npy")), boundary.ToyGenerator(), boundary.ToyCodec(50), cfg).first()
    assert (none["passed"], none["reason"]) == (False, "no prompts")


def test_gate_lines(spark):
    scored = spark.createDataFrame([("a", 0.5, True), ("b", 0.25, False)], "path string, acc double, decodes boolean")
    first, *rest = [r["line"] for r in metrics.gate_lines(scored, 0.1, 0.5).collect()]
    report = json.loads(first.removeprefix("EVENT_GATE_RESULT "))
    assert (report["passed"], report["mean_greedy_acc"], report["n_prompts"]) == (True, 0.375, 2) and "per_prompt" not in report
    assert [json.loads(x) for x in rest] == [{"path": "a", "acc": 0.5, "decodes": True}, {"path": "b", "acc": 0.25, "decodes": False}]


def test_predict(spark):
    rows = [("val", 1, 0, 0, [1, 2, 3, 4, 9]), ("val", 1, 0, 1, [7, 8, 9, 10, 0]), ("train", 0, 0, 0, [5, 5, 5, 5, 5])]
    blocks = spark.createDataFrame(rows, "split string, split_ord int, file_ord long, block_idx long, block array<smallint>")
    cfg = EngineConfig(seq_len=4, prompt_seq_len=2, max_seq_len=5, predictions=2, predict_set="other", vocab=9)
    run = lambda c=cfg, **at: [tuple(r) for r in runs.predict(blocks, boundary.ToyGenerator(), boundary.ToyCodec(8), c, **at).orderBy("p").collect()]
    # 10 is no id of this vocabulary; 9 is program id 8, which doesn't decode, so the truth is rendered
    assert run() == [(p, [1, 2, 3, 4, 5], [1, 2, 3, 4, 9], 2 / 3, True, [0, 1, 2, 3, 4]) for p in (0, 1)]
    assert run(start_block=1)[0][1:] == ([7, 8, 9, 10, 11], [7, 8, 9, 10, 0], 2 / 3, False, [6, 7, 8])
    assert run(start_seq=5) == []
    strict = EngineConfig(seq_len=4, prompt_seq_len=2, max_seq_len=5, predict_set="train", min_acc=0.5)
    with pytest.raises(Exception, match="accuracy below"):
        run(strict)
    whole = EngineConfig(seq_len=4, prompt_seq_len=5, max_seq_len=7, predict_set="val", vocab=9)
    assert run(whole)[0][3] is None  # the block has no more tokens to compare with


def test_train_batches(spark, tmp_path):
    rows = spark.range(50).select(F.col("id").alias("global_idx"), F.array(F.col("id"), F.col("id") + 1, F.lit(0)).cast("array<smallint>").alias("block"))
    store = str(tmp_path / "store")
    shuffled_store.write_shuffled(rows, store, 50, seed=2, files=2)
    plain = {r["batch"]: r["members"] for r in runs.train_batches(spark, store, EngineConfig(batch_size=8, shuffle=0)).collect()}
    assert [m["x"] for b in range(7) for m in plain[b]] == [[i, i + 1] for i in range(50)] and len(plain[6]) == 2
    drawn = {r["batch"]: r["members"] for r in runs.train_batches(spark, store, EngineConfig(batch_size=8, shuffle=0.5, seed=2), epoch=1).collect()}
    got = [m for b in range(4) for m in drawn[b]]
    assert [m["draw"] for m in got] == list(range(25)) and len({m["x"][0] for m in got}) == 25 and all(m["y"] == [m["x"][1], 0] for m in got)


def test_validate(spark):
    rows = [("a", 0, 1, [0.0, 2.0, 1.0]), ("a", 0, 0, [9.0, 0.0, 0.0]), ("a", 1, 2, [0.0, 3.0, 1.0]), ("b", 0, 2, [0.0, 0.0, 5.0])]
    df = spark.createDataFrame(rows, "split string, batch int, y int, logits array<double>")
    loss = lambda v, y: math.log(sum(map(math.exp, v))) - v[y]
    parts = [loss(v, y) for _, _, y, v in rows if y]
    cfg = EngineConfig()
    assert tuple(runs.validate(df, cfg).first()) == pytest.approx((sum(parts) / 3, 2 / 3))
    assert tuple(runs.validate(df.where("split = 'a'"), cfg).first()) == pytest.approx((sum(parts[:2]) / 2, 0.5))
    assert runs.validate(df, EngineConfig(label_smoothing=0.1)).first()["val_loss"] > sum(parts) / 3


def test_negative_limit(spark):
    lines = spark.range(10_000).select((F.col("id") * 3).alias("line_no"), F.lit("x").alias("v"))
    got = splits.limit_entries(lines, -9_990)
    assert got.columns == lines.columns and sorted(r["line_no"] for r in got.collect()) == [3 * i for i in range(10)]
    assert splits.limit_entries(lines, -20_000).count() == 0


def test_listings_and_dumps(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    for name in ("a.sid", "sub/b.sid", "sub/c.txt"):
        (tmp_path / "in" / name).write_text(name * 3)
    name = lambda r: r["path"].split("/in/")[1]
    got = {name(r): r["md5"] for r in text_sources.file_hashes(spark, f"{tmp_path}/in", "*.sid").collect()}
    assert got == {n: hashlib.md5((n * 3).encode()).hexdigest() for n in ("a.sid", "sub/b.sid")}
    listed = text_sources.list_files(spark, f"{tmp_path}/in")
    assert {name(r) for r in listed.collect()} == {"a.sid", "sub/b.sid", "sub/c.txt"} and "content" not in listed._jdf.queryExecution().executedPlan().toString()
    log = spark.createDataFrame([(20, 1, 5), (0, 0, 1), (20, 0, 2)], "clock long, reg int, val int").coalesce(1)
    change_log.write_change_log(log, str(tmp_path / "dump"), irq=10)
    assert pq.read_table(str(tmp_path / "dump")).to_pylist() == [{"clock": c, "reg": r, "val": v, "irq": 10} for c, r, v in ((0, 0, 1), (20, 0, 2), (20, 1, 5))]
