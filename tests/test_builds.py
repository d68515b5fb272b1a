"""Stores, builds, scans and folds against brute force."""

import glob
import math
import os
import random
import stat

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.config import EngineConfig
from tessera.functions import bfloat16
from tessera.functions import expressions as X
from tessera.functions.arrow_batches import slices
from tessera.operators import block_index, boundary, build, metrics, sampling, splits
from tessera.operators.fold import ordered_fold
from tessera.sources import file_scan, npy_blocks, shuffled_store, text_sources
from tessera.sources.item_store import ItemStore


def stopped(values, patience, delta, threshold):
    """The library's rule, a check at a time; the state before anything was accepted is infinite."""
    best, wait, out = math.inf, 0, []
    for v in values:
        if v is None or not math.isfinite(v):
            why = "not finite"
        elif threshold is not None and v < threshold:
            why = "threshold"
        elif v - (-delta) < best:
            best, wait, why = v, 0, None
        else:
            wait += 1
            why = "patience" if wait >= patience else None
        out.append((None if best == math.inf else best, wait, why, why is not None, True))
        if why:
            break
    last = out[-1][:2] if out else ()
    return out + [(*last, None, False, False)] * (len(values) - len(out))


def test_early_stop(spark):
    slow = [10.0, 9.5, 9.0, 8.5, 8.0, 7.5, 7.4, 7.3, 7.2]
    histories = {"slow": slow, "nan": [3.0, float("nan"), 1.0], "null": [None, 1.0], "low": [5.0, 2.0, 0.5, 9.0], "flat": [1.0] * 6, "none": [float("inf")]}
    rng = random.Random(1)
    histories |= {f"r{i}": [round(rng.uniform(0, 20) - j / 3, 2) for j in range(rng.randint(1, 40))] for i in range(20)}
    # epochs have gaps: patience counts checks
    rows = [(k, 7 * i + i % 3, v) for k, values in histories.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "run string, epoch int, val_loss double").repartition(3)
    for patience, delta, threshold in ((3, 1.0, None), (1, 0.0, None), (4, 0.5, 1.0)):
        got = {}
        for r in metrics.early_stop(df, "val_loss", "epoch", patience, delta, "run", threshold=threshold).orderBy("run", "epoch").collect():
            got.setdefault(r["run"], []).append(tuple(r[c] for c in ("best", "wait", "reason", "stop", "ran")))
        assert got == {k: stopped(v, patience, delta, threshold) for k, v in histories.items()}
    one = [r["best"] for r in metrics.early_stop(df.where("run = 'slow'"), "val_loss", "epoch", 3, 1.0).orderBy("epoch").collect()]
    assert one == [10, 10, 10, 8.5, 8.5, 8.5, 7.4, 7.4, 7.4]  # 8.5 is a gain, though 9 was never one
    with pytest.raises(ValueError, match="patience"):
        metrics.early_stop(df, "val_loss", "epoch", 0, 1.0)


def test_fold_over_batches(spark):
    """State goes on from batch to batch, and starts anew at each key, null among them."""
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        df = spark.createDataFrame([(k, i, i + 1) for k in ("a", None, "b") for i in range(10)], "k string, i int, v int")
        got = ordered_fold(df, ["k"], ["i"], lambda: 0, lambda s, v: (s + v, (s + v,)), ["v"], "total long").collect()
        assert {(r["k"], r["i"]): r["total"] for r in got} == {(k, i): (i + 1) * (i + 2) // 2 for k in ("a", None, "b") for i in range(10)}
        assert ordered_fold(df.where("false"), [], ["i"], lambda: 0, lambda s, v: (s, (s,)), ["v"], "total long").count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


def test_epoch_scores(spark):
    rows = [("a", 0, 2.0, 1, 4), ("a", 1, 9.0, 2, 2), ("b", 0, 1.0, 0, 1)]
    df = spark.createDataFrame(rows, "split string, batch int, loss_sum double, correct_sum long, tok_sum long")
    assert tuple(metrics.epoch_scores(df).first()) == pytest.approx((12 / 7, 3 / 7))
    assert tuple(metrics.epoch_scores(df.where("split = 'a'")).first()) == pytest.approx(((0.5 + 4.5) / 2, (0.25 + 1) / 2))


def test_splits_have_indexes_of_their_own(spark):
    """Train first; empty splits vanish; a repeated name goes on where it was; batches keep to one split."""
    files = lambda *n: spark.createDataFrame([(i, x) for i, x in enumerate(n)], "line_no long, n long")
    parts = [("x", files(3, 0, 2)), ("train", files(5)), ("gone", files(0, 0)), ("x", files(4)), ("y", files())]
    index = block_index.split_index(splits.union_splits(parts, mentions=True))
    got = {(r["split"], r["mention"], r["line_no"]): r["cum"] for r in index.collect()}
    assert got == {("x", 0, 0): 0, ("x", 0, 2): 3, ("x", 3, 0): 5, ("train", 1, 0): 0}
    assert [tuple(r) for r in block_index.loaders(index, 4).orderBy("loader").collect()] == [(0, "train", 5, 2), (1, "x", 9, 3)]
    rows = index.withColumn("block_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("global_idx", F.col("cum") + F.col("block_idx"))
    made = sampling.batches(rows, 4, "global_idx", keys=("split",)).collect()
    assert {(r["split"], r["batch"]): [m["global_idx"] for m in r["members"]] for r in made} == {
        ("train", 0): [0, 1, 2, 3], ("train", 1): [4], ("x", 0): [0, 1, 2, 3], ("x", 1): [4, 5, 6, 7], ("x", 2): [8]}
    many = spark.range(20_000).select(F.lit("s").alias("split"), F.lit(0).alias("split_ord"), F.lit(0).alias("mention"), F.col("id").alias("line_no"), (F.col("id") % 3).alias("n"))
    wrong = block_index.split_index(many).where(F.col("cum") != F.expr("line_no div 3 * 3 + case line_no % 3 when 2 then 1 else 0 end"))
    assert wrong.count() == 0


def test_files_of_a_shuffled_store_stay_small(spark, tmp_path):
    """The more blocks, the more files; each has places of its own, next to each other."""
    n, path = 2000, str(tmp_path / "store")
    rows = spark.range(n).select(F.col("id").alias("global_idx"), F.array("id").cast("array<int>").alias("block"))
    shuffled_store.write_shuffled(rows, path, n, seed=1, files=3, file_blocks=200)
    files = spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.min("place").alias("a"), F.max("place").alias("b"), F.count("*").alias("n"))
    found = files.orderBy("a").collect()
    assert len(found) == 10 and max(r["n"] for r in found) < 300
    assert sum(r["n"] for r in found) == n and all(r["b"] - r["a"] + 1 == r["n"] for r in found)


def test_codec_sees_bounded_slices():
    """Python objects are made of a few rows and bytes at a time, whatever a batch has, and of a long value alone."""
    batch = pa.RecordBatch.from_arrays([pa.array([b"x" * 100] * 2500 + [None, b"y" * (3 << 20), b"z"])], ["content"])
    sizes = [part.num_rows for part in slices([batch], "content")]
    assert sum(sizes) == batch.num_rows and max(sizes) <= 1000
    assert all(part.num_rows == 1 or sum(len(x or b"") for x in part["content"].to_pylist()) <= 1 << 20 for part in slices([batch], "content"))


def test_codec_holds_a_slice(spark):
    """recover hands on the results of a slice before it takes the next, and loses no row."""

    class Numbers:
        def __init__(self):
            self.n = 0

        def encode(self, content, subtune, frames):
            self.n += 1
            return [int(content)]

    class Frame:  # entries whose tasks run here
        schema = spark.createDataFrame([], "subtune int, frames long, content binary").schema

        def mapInArrow(self, each, schema):
            return each

    codec = Numbers()
    columns = [pa.array([1] * 5000, pa.int32()), pa.array([9] * 5000), pa.array([str(i).encode() if i % 5 else None for i in range(5000)], pa.binary())]
    out = boundary.recover(Frame(), codec)(iter([pa.RecordBatch.from_arrays(columns, ["subtune", "frames", "content"])]))
    first = next(out)
    assert first.num_rows == 1000 and codec.n == 800
    ids = first["ids"].to_pylist() + [x for part in out for x in part["ids"].to_pylist()]
    assert ids == [[i + 1] if i % 5 else None for i in range(5000)]


def test_a_folder_is_made_once(tmp_path, monkeypatch):
    """Files of one folder ask for it once; the folder is named as the caller names it."""
    made, asked = set(), []

    class Asked:
        def __init__(self, system):
            self.system = system

        def create_dir(self, folder, recursive):
            asked.append(folder)
            self.system.create_dir(folder, recursive=recursive)

        def __getattr__(self, name):
            return getattr(self.system, name)

    was = file_scan.opened
    monkeypatch.setattr(file_scan, "opened", lambda path: (Asked(was(path)[0]), was(path)[1]))
    for i, folder in enumerate("aab"):
        file_scan.save(f"{tmp_path}/{folder}/{i}", b"x", made)
    assert asked == [f"{tmp_path}/a", f"{tmp_path}/b"]
    assert sorted(os.listdir(tmp_path / "a")) == ["0", "1"] and os.listdir(tmp_path / "b") == ["2"]


def test_sample_reads_its_range_only(spark, tmp_path):
    """Any fraction draws each block as often as it should; a small one touches few row groups."""
    n, path = 20_000, str(tmp_path / "store")
    rows = spark.range(n).select(F.col("id").alias("global_idx"), F.array(F.col("id"), F.col("id") + 1, F.lit(0)).cast("array<int>").alias("block"))
    shuffled_store.write_shuffled(rows, path, n, seed=1, files=3, group_bytes=1 << 14)
    places = {r["place"]: r["global_idx"] for r in spark.read.parquet(path).select("place", "global_idx").collect()}
    assert sorted(places) == list(range(n)) and sorted(places.values()) == list(range(n))
    assert sum(abs(places[i] - i) for i in range(n)) / n > n / 5  # far from the old order
    for fraction in (0, 0.05, 1.0, 2.2):
        drawn = shuffled_store.fetch(spark, path, fraction, seed=1, epoch=4).select("draw", "global_idx", "x", "y").collect()
        assert sorted(r["draw"] for r in drawn) == list(range(int(fraction * n)))
        times = np.bincount([r["global_idx"] for r in drawn], minlength=n)
        assert times.min() >= int(fraction) and times.max() <= math.ceil(fraction)
        assert all(r["x"] == [r["global_idx"], r["global_idx"] + 1] and r["y"] == [r["global_idx"] + 1, 0] for r in drawn)
    one, two = ({r["global_idx"] for r in shuffled_store.fetch(spark, path, 0.05, seed=1, epoch=e).collect()} for e in (1, 2))
    assert one != two
    groups = touched = 0
    wanted = [(a, b) for _, _, a, b in shuffled_store.ranges(n, 0.05, 1, 4)]
    for name in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        for i in range(meta.num_row_groups):
            own = next(meta.row_group(i).column(j).statistics for j in range(meta.num_columns) if meta.row_group(i).column(j).path_in_schema == "place")
            groups += 1
            touched += any(own.min < b and own.max >= a for a, b in wanted)
    assert groups >= 20 and touched <= 0.05 * groups + 4
    plan = shuffled_store.fetch(spark, path, 0.05, seed=1, epoch=4)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(place" in plan


def counting(marks: str):
    """A codec that leaves a mark for every item it is run on; made here, as workers can't import tests."""

    class Counting:
        def encode(self, content, subtune, frames):
            open(f"{marks}/{random.random()}", "w").close()
            if content.startswith(b"!"):
                raise ValueError("refused")
            return list(content[:frames])

    return Counting()


def manifests(spark, items):
    rows = [(i, *item) for i, item in enumerate(items)]
    return [("train", spark.createDataFrame(rows, "line_no int, sid string, subtune int, content binary"))]


def test_builds(spark, tmp_path):
    """A second build runs the codec on nothing of the first; what is broken or changed is built anew."""
    marks = tmp_path / "marks"
    marks.mkdir()
    ran = lambda: [len(os.listdir(marks)), [os.remove(f"{marks}/{x}") for x in os.listdir(marks)]][0]
    codec, cfg = counting(str(marks)), EngineConfig(seq_len=4, max_files=0)
    items = [("a.sid", 1, bytearray(range(20))), ("b.sid", 1, None), ("c.sid", 1, bytearray(b"!x")), ("d.sid", 2, bytearray(b"dddd")), ("e.sid", 1, bytearray(b"e")), ("a.sid", 1, bytearray(range(20)))]
    all_items = [*items, ("f.sid", 1, bytearray(b"ffff"))]
    durations = spark.createDataFrame([(c,) for _, _, c in all_items if c], "c binary").distinct().select(F.md5("c").alias("md5"), F.array(F.lit("0:30")).alias("times"))
    store = ItemStore(spark, str(tmp_path / "store"))
    first = build.build_store(manifests(spark, items), durations, codec, cfg, store)
    assert [tuple(r) for r in first.collect()] == [("train", 0, 2, 4)] and ran() >= 3
    states = lambda s=store: {r["sid"]: (r["status"], r["reason"], r["n_blocks"], r["build"]) for r in s.items().collect()}
    assert states() == {"a.sid": ("kept", None, 5, 1), "b.sid": ("skipped", "no source", 0, 1), "c.sid": ("skipped", "codec", 0, 1), "d.sid": ("skipped", "no budget", 0, 1), "e.sid": ("skipped", "too short", 0, 1)}
    again = build.build_store(manifests(spark, items), durations, codec, cfg, store)
    assert [tuple(r) for r in again.collect()] == [("train", 0, 2, 4)] and ran() == 0
    assert store.pending(spark.createDataFrame([], "sid string, subtune int, content_md5 string, frames long, seq_len int, stride int, codec string")).count() == 0
    # one more item, and a content that changed
    changed = [("a.sid", 1, bytearray(range(20))), ("b.sid", 1, bytearray(b"ffff")), ("f.sid", 1, bytearray(b"ffff"))]
    more = build.build_store(manifests(spark, changed), durations, codec, cfg, store)
    assert [tuple(r) for r in more.collect()] == [("train", 0, 3, 0)] and ran() == 2
    assert states()["f.sid"] == ("kept", None, 1, 2)  # a build that finds nothing to do leaves no number
    blocks = lambda s: sorted((r["sid"], r["block_idx"], tuple(r["block"])) for r in s.blocks(4, 4).collect())
    whole = blocks(store)
    assert [b for s, _, b in whole if s == "a.sid"] == [tuple([i + 1 for i in range(20)][k : k + 5] + [0] * (5 - len(range(20)[k : k + 5]))) for k in range(0, 17, 4)]
    # a broken file is a miss, and is built again
    for name in glob.glob(f"{tmp_path}/store/kind=block/build=1/*.parquet"):
        with open(name, "wb") as f:
            f.write(b"PAR1 nothing")
        os.remove(f"{os.path.dirname(name)}/.{os.path.basename(name)}.crc")
    assert {s for s, _, _ in blocks(store)} == {"b.sid", "f.sid"}
    build.build_store(manifests(spark, items), durations, codec, cfg, store)
    assert ran() == 2 and blocks(store) == whole and states()["a.sid"][3] == 3  # a.sid twice, as it is listed twice
    small = store.compact(str(tmp_path / "small"))
    assert states(small) == states(store) and blocks(small) == whole
    build.build_store(manifests(spark, items), durations, codec, cfg, small)
    assert ran() == 0
    # settings are part of the key; the limit comes before the codec
    build.build_store(manifests(spark, items), durations, codec, EngineConfig(seq_len=4, block_stride=2, max_files=1), store)
    assert ran() == 1
    assert build.build_store([], durations, codec, cfg, store).count() == 0


def test_scan_opens_only_what_is_named(spark, tmp_path):
    named = tmp_path / "in"
    named.mkdir()
    contents = {f"{named}/{i}": os.urandom(50 * i) for i in range(8)}
    for path, content in contents.items():
        with open(path, "wb") as f:
            f.write(content)
    other = named / "unnamed"
    other.write_text("x")
    os.mkfifo(named / "never")  # whoever opens this waits for ever
    paths = [*contents, f"file://{named}/3", f"{named}/gone", f"{named}", None]
    sized = file_scan.file_sizes(spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "line int, path string")).cache()
    assert {r["path"]: r["size"] for r in sized.collect()} == {**{p: len(c) for p, c in contents.items()}, f"file://{named}/3": 150, f"{named}/gone": None, f"{named}": None, None: None}
    for with_content in (True, False):
        got = file_scan.scan_files(sized, ["line"], with_content=with_content, task_bytes=1 << 21).collect()
        assert len(got) == len(paths)
        for r in got:
            content = contents.get((r["path"] or "").removeprefix("file://"))
            assert r["missing"] == (None if content is not None else "no file")
            assert r["content_md5"] == (None if content is None else __import__("hashlib").md5(content).hexdigest())
            if with_content:
                assert r["content"] == content
    os.chmod(other, 0)
    if os.geteuid():  # root reads everything
        odd = file_scan.file_sizes(spark.createDataFrame([(0, str(other))], "line int, path string"))
        assert file_scan.scan_files(odd, ["line"]).first()["missing"].startswith("unreadable")
    assert stat.S_ISFIFO(os.stat(named / "never").st_mode)


def test_npy_files(spark, tmp_path):
    """Files of numpy and of our own; all that is no block file is a miss."""
    cases = {"good": np.arange(36, dtype=np.int16).reshape(4, 9), "wide": np.arange(27, dtype=">i4").reshape(3, 9), "bytes": np.ones((2, 9), np.uint8)}
    bad = {"narrow": np.zeros((3, 5), np.int16), "none": np.zeros((0, 9), np.int16), "flat": np.zeros(9, np.int16), "real": np.zeros((3, 9)), "columns": np.asfortranarray(np.zeros((3, 9), np.int16))}
    for name, array in (cases | bad).items():
        np.save(tmp_path / f"{name}.npy", array)
    (tmp_path / "text.npy").write_text("no array")
    (tmp_path / "empty.npy").write_bytes(b"")
    (tmp_path / "short.npy").write_bytes((tmp_path / "good.npy").read_bytes()[:-3])
    names = [*cases, *bad, "text", "empty", "short", "gone"]
    entries = spark.createDataFrame([(n, f"{tmp_path}/{n}.npy") for n in names], "name string, path string")
    counted = npy_blocks.npy_counts(file_scan.file_sizes(entries), 8).cache()
    assert {r["name"]: r["n_blocks"] for r in counted.collect()} == {n: len(cases[n]) if n in cases else None for n in names}
    for size in (1, 200, 1 << 20):
        got = {(r["name"], r["block_idx"]): list(r["block"]) for r in npy_blocks.read_npy(counted, 8, range_bytes=size).collect()}
        assert got == {(n, i): row for n, a in cases.items() for i, row in enumerate(a.tolist())}
    spark.dataSource.register(npy_blocks.NpySource)
    source = spark.read.format("npy_blocks").option("seq_len", 8)
    for at in (str(tmp_path), f"file://{tmp_path}"):
        found = {(os.path.basename(r["path"]), r["block_idx"]): list(r["block"]) for r in source.option("range_bytes", 100).load(at).collect()}
        assert found == {(f"{n}.npy", i): row for n, a in cases.items() for i, row in enumerate(a.tolist())}
    one = source.option("range_bytes", 72).load(f"{tmp_path}/good.npy")
    assert one.count() == 4 and one.rdd.getNumPartitions() == 4 and source.load(f"{tmp_path}/none.npy").count() == 0
    rows = [(f"{tmp_path}/out/{k}/x.npy", i, [k * 100 + i * 9 + j for j in range(9)]) for k in range(5) for i in range(k + 1)]
    df = spark.createDataFrame(rows, "path string, block_idx long, block array<int>").repartition(3)
    assert npy_blocks.write_npy(df, 8) == (5, 15)
    for k in range(5):
        assert np.load(f"{tmp_path}/out/{k}/x.npy").tolist() == [b for p, _, b in rows if f"/out/{k}/" in p]
        assert os.listdir(f"{tmp_path}/out/{k}") == ["x.npy"]
    with pytest.raises(Exception, match="numbers"):
        npy_blocks.write_npy(df, 9)


def test_choose_token(spark):
    """As often as the softmax says, whatever the row; one of the largest alone is the largest."""
    logits = [0.3, 2.0, -1.0, 1.5, 2.0]
    rows = spark.range(20_000).withColumn("logits", F.array(*map(F.lit, logits)))
    for temperature, k in ((1.0, None), (0.5, None), (2.0, 3)):
        got = {r[0]: r[1] for r in rows.groupBy(X.choose_token(F.col("logits"), temperature, F.col("id"), k=k, seed=1).alias("t")).count().collect()}
        allowed = [1, 4, 3] if k else range(5)
        weight = {i: math.exp(logits[i] / temperature) for i in allowed}
        for i in range(5):
            p = weight.get(i, 0) / sum(weight.values())
            assert abs(got.get(i, 0) - 20_000 * p) <= 5 * math.sqrt(20_000 * p * (1 - p)) + (p > 0)
    for greedy in (X.choose_token(F.col("logits"), 0, F.col("id")), X.choose_token(F.col("logits"), 3.0, F.col("id"), k=1)):
        assert {r[0] for r in rows.select(greedy).distinct().collect()} == {1}
    with pytest.raises(ValueError, match="temperature"):
        X.choose_token(F.col("logits"), -1.0)


def nearest(x):
    """The nearest of all 16-bit floats, by search; the even one of two as near."""
    if math.isnan(x):
        return 0x7FC0
    down = int(np.float32(x).view(np.uint32)) >> 16
    size = lambda b: float(np.uint32(b << 16).view(np.float32)) if (b & 0x7FFF) != 0x7F80 else math.copysign(2.0**128, -1 if b >> 15 else 1)
    if math.isinf(np.float32(x)):
        return down
    options = [down, down + 1]
    return min(options, key=lambda b: (abs(size(b) - float(np.float32(x))), b & 1))


def test_bfloat16(spark):
    rng = np.random.default_rng(3)
    odd = [0.0, -0.0, 1.0, 1.00390625, 1.01171875, 3.3895313892515355e38, 3.4e38, -3.4e38, float("inf"), float("-inf"), float("nan"), 1e-40, 1e-45, 1e300, 2.5]
    values = [*odd, *rng.normal(size=200).tolist(), *(rng.normal(size=50) * 1e-38).tolist()]
    with np.errstate(over="ignore"):
        expected = [nearest(v) for v in values]
    rows = [(i, v, [v, None], {i: v}, (v, [{"k": v}]), "s") for i, v in enumerate(values)] + [(-1, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "i int, d double, a array<float>, m map<int,double>, s struct<x:double,y:array<map<string,float>>>, t string")
    with np.errstate(over="ignore"):
        got = {r["i"]: r for r in bfloat16.narrow_bfloat16(df, as_bits=True).collect()}
    assert tuple(got[-1])[1:] == (None,) * 5
    for i, bits in enumerate(expected):
        r, n = got[i], int(np.uint16(bits).view(np.int16))
        assert (r["d"], r["a"], r["m"], r["s"]["x"], r["s"]["y"], r["t"]) == (n, [n, None], {i: n}, n, [{"k": n}], "s")
    plain = bfloat16.narrow_bfloat16(df, ["d", "i", "other"])
    assert plain.dtypes == [("i", "int"), ("d", "float")]
    for r in plain.where("i >= 0").collect():
        back = np.uint32(expected[r["i"]] << 16).view(np.float32)
        assert r["d"] == back or math.isnan(r["d"]) and math.isnan(back)


def test_corpus_from_manifest_files(spark, tmp_path):
    """Files beyond the limit are not opened; a missing manifest is empty; relative and whole paths; one codec run each."""
    marks = tmp_path / "marks"
    marks.mkdir()
    root = tmp_path / "root"
    root.mkdir()
    for name, content in (("a.sid", bytes(range(12))), ("b.sid", b"bb"), ("c.sid", b"!no")):
        (root / name).write_bytes(content)
    os.mkfifo(root / "never.sid")
    (tmp_path / "train").write_text(f"a.sid\t1\n# none\n\n{root}/b.sid\ngone.sid\t3\nnever.sid\n")
    (tmp_path / "eval").write_text("c.sid 1\n")
    (tmp_path / "times").write_text("".join(f"{__import__('hashlib').md5(c).hexdigest().upper()}=0:30 0:20\n" for c in (bytes(range(12)), b"bb", b"!no")))
    durations = text_sources.read_durations(spark, str(tmp_path / "times"))
    store = ItemStore(spark, str(tmp_path / "store"))
    named = [("train", f"{tmp_path}/train"), ("eval", f"{tmp_path}/eval"), ("empty", f"{tmp_path}/none"), ("eval", f"{tmp_path}/eval")]
    cfg = EngineConfig(seq_len=4, max_files=3)
    counts = build.build_corpus(spark, named, str(root), durations, counting(str(marks)), cfg, store, str(tmp_path / "listing"))
    assert [tuple(r) for r in counts.orderBy("split_ord").collect()] == [("train", 0, 2, 1), ("eval", 1, 0, 2), ("empty", 2, 0, 0)]
    got = {os.path.basename(r["sid"]): (r["split"], r["status"], r["reason"], r["n_blocks"]) for r in store.items().collect()}
    assert got == {"a.sid": ("train", "kept", None, 3), "b.sid": ("train", "kept", None, 1), "gone.sid": ("train", "skipped", "no source", 0), "c.sid": ("eval", "skipped", "codec", 0)}
    assert [list(r["block"]) for r in store.blocks(4, 4).where(F.col("sid").endswith("b.sid")).collect()] == [[ord("b") + 1] * 2 + [0] * 3]
    assert len(os.listdir(marks)) == 4  # c.sid is listed twice
