"""Literal cases of the operators."""

import itertools

import pytest
from pyspark.sql import functions as F

from tessera.config import EngineConfig
from tessera.functions import expressions as X
from tessera.operators import block_index, boundary, build, change_log, choose, metrics, prompts, sampling, splits, windowing
from tessera.sources import block_store, text_sources


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_manifest(spark, tmp_path):
    path = tmp_path / "m.list"
    path.write_text("A/Tune.sid\t2\n# comment\n\nB/Other.sid\nC#x.sid\t3\r\nD/e.sid 4\nF.sid \t5\n")
    got = [tuple(r) for r in text_sources.read_manifest(spark, str(path)).orderBy("line_no").collect()]
    assert got == [(0, "A/Tune.sid", 2), (3, "B/Other.sid", 1), (4, "C", 1), (5, "D/e.sid", 4), (6, "F.sid ", 5)]
    path.write_text("A.sid\tx\n")
    with pytest.raises(Exception, match="CAST"):
        text_sources.read_manifest(spark, str(path)).collect()
    (tmp_path / "empty").write_text("")
    assert text_sources.read_manifest(spark, str(tmp_path / "empty")).count() == 0


def test_eval_spec(spark):
    df = spark.createDataFrame([("eval-A=/a.list;eval-B-x=/b.list",), ("",), (None,)], "spec string")
    assert [tuple(r) for r in text_sources.parse_eval_spec(df, "spec").collect()] == [(0, "eval-A", "/a.list"), (1, "eval-B-x", "/b.list")]


def test_durations(spark, tmp_path):
    path = tmp_path / "d"
    path.write_text("[Database]\n; /path=1\nABC=2:00 1:00\nabc=0:56\nempty=\n")
    got = {r["md5"]: r["times"] for r in text_sources.read_durations(spark, str(path)).collect()}
    assert got == {"abc": ["0:56"], "empty": []}


@pytest.mark.parametrize(("token", "seconds"), [("0:56", 56.0), ("1:17", 77.0), ("4:33.108", 273.108), ("1:02:03", 3723.0), ("4:33.5", 273.005), ("56", 56.0)])
def test_duration_seconds(spark, token, seconds):
    assert value(spark, X.duration_seconds(F.lit(token))) == pytest.approx(seconds, abs=1e-9)


def test_frame_budget(spark):
    assert value(spark, X.frame_budget(F.lit(120.0))) == 985248 * 120 // 19656 == 6014
    assert value(spark, X.frame_budget(F.lit(60.0))) == 3007
    assert value(spark, X.frame_budget(F.lit(60.0), ntsc=True)) != 3007
    times = F.array(F.lit("2:00"), F.lit("1:00"))
    assert [value(spark, X.pick_time(times, F.lit(i))) for i in (-1, 0, 1, 2, 3)] == [None, None, "2:00", "1:00", None]


def test_paths(spark):
    assert value(spark, X.block_path(F.lit("/a/Tune.sid"), F.lit(2))) == "/a/Tune.2.blocks.npy"
    cases = {("/tmp/foo.wav", 0): "/tmp/foo.wav", ("/tmp/foo.wav", 3): "/tmp/foo.3.wav", ("/tmp/foo", 5): "/tmp/foo.5", ("out.csv", 1): "out.1.csv", ("/x/y.tar.gz", 1): "/x/y.tar.1.gz"}
    for (path, p), out in cases.items():
        assert value(spark, X.path_suffix(F.lit(path), F.lit(p))) == out
    assert value(spark, X.resolve(F.lit("a"), "/r")) == "/r/a"
    assert value(spark, X.resolve(F.lit("/a"), "/r")) == "/a"


def by_hand(ids, seq_len, stride):
    out, start = [], 0
    while start < max(1, len(ids) - 1) and len(ids) >= 2:
        part = ids[start : start + seq_len + 1]
        out.append(part + [0] * (seq_len + 1 - len(part)))
        if start + seq_len + 1 >= len(ids):
            break
        start += stride
    return out


def test_windows(spark):
    cases = [(k, n, s, t) for k, (n, s, t) in enumerate(itertools.product(range(0, 34, 3), (1, 4, 8), (1, 3, 4, 8, 11)))]
    for s, t in {(s, t) for _, _, s, t in cases}:
        own = [(k, list(range(1, n + 1))) for k, n, a, b in cases if (a, b) == (s, t)]
        df = spark.createDataFrame(own, "k int, ids array<int>")
        got = {}
        for r in windowing.windows(df, "ids", s, t).orderBy("k", "block_idx").collect():
            got.setdefault(r["k"], []).append(list(r["block"]))
        for k, ids in own:
            assert got.get(k, []) == by_hand(ids, s, t), (ids, s, t)
            if s == t:
                assert sum(sum(y > 0 for y in b[1:]) for b in got.get(k, [])) == max(0, len(ids) - 1)


def test_index(spark):
    counts = spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "file_ord long, n long")
    index = block_index.build_index(counts)
    got = [tuple(r) for r in index.orderBy("file_ord").collect()]
    assert got == [(0, 2, 0), (2, 1, 2)]
    asked = spark.createDataFrame([(0,), (2,), (1,)], "idx long")
    assert sorted(tuple(r) for r in block_index.lookup(asked, index).collect()) == [(0, 0, 0), (1, 0, 1), (2, 2, 0)]
    for bad in (-1, 3):
        with pytest.raises(Exception, match="out of range"):
            block_index.lookup(spark.createDataFrame([(bad,)], "idx long"), index).collect()
    many = spark.range(3000).select(F.col("id").alias("file_ord"), (F.col("id") % 4).alias("n"))
    index = block_index.build_index(many)
    total = index.agg(F.sum("n")).first()[0]
    found = block_index.lookup(spark.range(total).withColumnRenamed("id", "idx"), index).join(index, "file_ord")
    assert found.where(F.col("cum") + F.col("block_idx") == F.col("idx")).count() == total


def test_splits(spark):
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "i int")
    got = splits.union_splits([("train", rows(1)), ("a", rows(2)), ("train", rows(3))])
    assert sorted(tuple(r) for r in got.collect()) == [(1, "train", 0), (2, "a", 1), (3, "train", 0)]
    names = got.select("split", "split_ord").distinct()
    assert splits.select_split(names, "a").first()["split"] == "a"
    assert splits.select_split(names, "zzz").first()["split"] == "train"
    assert splits.select_split(names.where(F.lit(False)), "a").count() == 0
    lines = spark.createDataFrame([(i,) for i in range(5)], "line_no int")
    assert [splits.limit_entries(lines, n).count() for n in (0, 2, 9, -2)] == [5, 2, 5, 3]


def test_sampling(spark):
    rows = spark.range(10).withColumnRenamed("id", "global_idx")
    assert sampling.sample_exact(rows, 0.5).count() == 5
    assert sampling.sample_exact(rows, 0.05).count() == 0
    assert sampling.sample_exact(rows, 2.0).count() == 20
    assert sampling.sample_exact(rows, 0.5, epoch=1).collect() == sampling.sample_exact(rows, 0.5, epoch=1).collect()
    assert sampling.draws(spark.range(1), 20, 10).where("idx >= 0 AND idx < 10").count() == 20
    got = {r["batch"]: [m["global_idx"] for m in r["members"]] for r in sampling.batches(rows, 4).collect()}
    assert got == {0: [0, 1, 2, 3], 1: [4, 5, 6, 7], 2: [8, 9]}
    assert sampling.fan_out(rows, 3).count() == 30 and sampling.fan_out(rows, 0).count() == 0


def test_prompts(spark):
    blocks = spark.createDataFrame([("b", 0, [1, 2, 0, 0, 0]), ("b", 1, [1, 0, 2, 3, 4]), ("a", 0, [9, 8, 7, 6, 5]), ("c", 0, [1, 0, 0, 0, 0])], "path string, block_idx int, block array<int>")
    got = [(r["path"], list(r["prompt"]), list(r["truth"])) for r in prompts.select_prompts(blocks, 8, 3, 2).collect()]
    assert got == [("a", [9, 8, 7], [6, 5]), ("b", [1, 2, 3], [4])]
    assert prompts.select_prompts(blocks, 0, 3, 2).count() == 1
    assert prompts.select_prompts(blocks, 8, 3, 0).count() == 0
    seq = spark.createDataFrame([(list(range(1, 11)),)], "ids array<int>")
    r = prompts.prompt_slice(seq, "ids", 4, 6).first()
    assert (len(r["prompt"]), r["n_generate"], len(r["compare"])) == (4, 2, 6)
    with pytest.raises(ValueError, match="above"):
        prompts.prompt_slice(seq, "ids", 6, 6)


def test_metrics(spark):
    df = spark.createDataFrame([(float(v), 1) for v in (1, 2, 3, 4)], "v double, y int")
    assert df.agg(metrics.masked_mean(F.col("v"), F.col("y"))).first()[0] == 2.5
    assert df.agg(metrics.masked_mean(F.col("v"), F.col("y") * 0)).first()[0] == 0.0
    pads = spark.createDataFrame([("s", 0, 0, 0, 1.0), ("s", 1, 5, 5, 2.0)], "split string, batch int, y int, pred int, loss double")
    r = metrics.subset_metrics(metrics.batch_partials(pads, "split", "batch"), "split").first()
    assert (r["loss_sum"], r["correct_sum"], r["tok_sum"]) == (2.0, 1, 2)
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 4)], "gt int, pred int")
    assert metrics.macro_accuracy(pairs).first()[0] == pytest.approx((0.5 + 1 + 0 + 0) / 4)
    none = spark.createDataFrame([], "path string, acc double, decodes boolean")
    r = metrics.gate_report(none, 0.0, 0.5).first()
    assert (r["passed"], r["reason"], r["n_prompts"]) == (False, "no prompts", 0)
    one = spark.createDataFrame([("a", 0.5, True), ("b", 0.0, False)], "path string, acc double, decodes boolean")
    assert metrics.gate_report(one, 0.2, 0.5).first()["passed"]
    with pytest.raises(RuntimeError, match="gate"):
        metrics.require(metrics.gate_report(one, 0.3, 0.5))


def test_cross_entropy(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    for eps in (0.0, 0.1):
        logits, y = rng.normal(size=11) * 30, 4
        logp = logits - logits.max() - np.log(np.exp(logits - logits.max()).sum())
        expected = -(1 - eps) * logp[y] - eps * logp.mean()
        got = value(spark, X.cross_entropy(F.array(*map(F.lit, logits.tolist())), F.lit(y), eps))
        assert got == pytest.approx(expected, abs=1e-9)


def test_change_log(spark):
    rows = [(f, r, f if r == 0 else (0x41 if f % 2 else 0x40) if r == 4 else 0x0F if r == 24 else 0) for f in range(6) for r in range(25)]
    states = spark.createDataFrame(rows, "frame long, reg int, val int")
    log = change_log.change_log(states)
    assert log.count() == 25 + 2 * 5
    assert log.where("reg = 24").count() == 1
    back = change_log.forward_fill(log, states.select("frame", "reg"))
    assert sorted(tuple(r) for r in back.select("frame", "reg", "val").collect()) == sorted(rows)
    assert change_log.change_log(states.where(F.lit(False))).count() == 0


def test_choose(spark):
    def pick(*rows, explicit=None):
        return choose.choose_checkpoint(spark.createDataFrame(list(rows), "path string, modified int"), explicit)

    assert pick(("/l/a.ckpt", 9), ("/l/best-1.ckpt", 1), ("/l/best-2.ckpt", 2)) == "/l/best-2.ckpt"
    assert pick(("/l/a.ckpt", 9), ("/l/b.ckpt", 9)) == "/l/b.ckpt"
    assert pick(("/l/a.ckpt", 9), explicit="/x") == "/x"
    with pytest.raises(FileNotFoundError):
        pick(("/l/readme", 1))


def test_build(spark, tmp_path):
    cfg = EngineConfig(seq_len=8, vocab=100)
    entries = spark.createDataFrame(
        [("a.sid", 1, bytearray(range(20))), ("b.sid", 1, None), ("c.sid", 1, bytearray(b"x")), ("d.sid", 2, bytearray(b"yyyy")), ("e.sid", 1, bytearray(b""))], "sid string, subtune int, content binary")
    durations = entries.where("content IS NOT NULL").select(F.md5("content").alias("md5"), F.array(F.lit("2:00")).alias("times"))
    made = build.recover_entries(entries, durations, boundary.ToyCodec(100), cfg)
    assert {r["sid"]: r["skip_reason"] for r in made.collect()} == {"a.sid": None, "b.sid": "no source", "c.sid": "too short", "d.sid": "no budget", "e.sid": "codec"}
    blocks = build.build_blocks(made, cfg)
    block_store.write_blocks(blocks.select("sid", "subtune", "content_md5", "block_idx", "block", "seq_len", "stride"), str(tmp_path / "store"))
    back = block_store.read_blocks(spark, str(tmp_path / "store"), 8, 8)
    assert [list(r["block"]) for r in back.orderBy("block_idx").collect()] == by_hand(list(range(1, 21)), 8, 8)
    assert block_store.read_blocks(spark, str(tmp_path / "store"), 8, 4).count() == 0
    ids = spark.createDataFrame([([1, 2],), ([100],), ([],)], "ids array<int>")
    assert [r[0] for r in ids.select(boundary.decodes(boundary.ToyCodec(100), F.col("ids"))).collect()] == [True, False, False]
    assert [list(r[0]) for r in ids.select(boundary.generate(boundary.ToyGenerator(), F.col("ids"), 2)).collect()] == [[3, 4], [101, 102], [1, 2]]
    with pytest.raises(ValueError, match="positive"):
        EngineConfig(seq_len=0)


def test_render(spark):
    """A frame per vector, a row per register; keys go along."""
    from tessera.operators.boundary import render

    class Steps:
        def render(self, ids):
            return [[i, i + 1] for i in ids]

    programs = spark.createDataFrame([("a", [1, 2]), ("b", [])], "path string, ids array<long>")
    got = sorted(tuple(r) for r in render(programs, Steps(), "path").collect())
    assert got == [("a", 0, 0, 1), ("a", 0, 1, 2), ("a", 1, 0, 2), ("a", 1, 1, 3)]


def test_missing_manifest_is_empty(spark, tmp_path):
    from tessera.sources.text_sources import read_manifest

    assert read_manifest(spark, str(tmp_path / "none.txt")).count() == 0
    (tmp_path / "some.txt").write_text("a.sid  1\n")
    assert [tuple(r)[1:] for r in read_manifest(spark, str(tmp_path / "some.txt")).collect()] == [("a.sid", 1)]


def test_sample_exact(spark):
    """The first n of the hash order, whichever group of it n ends in."""
    import hashlib

    from tessera.operators.sampling import sample_exact

    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    order = sorted(range(1000), key=lambda i: md5(md5(f"{i}|4") + "1"))
    rows = spark.range(1000).withColumnRenamed("id", "global_idx")
    later = [sorted(range(1000), key=lambda i, p=p: md5(md5(f"{i}|4") + f"1|{p}")) for p in (1, 2)]
    for fraction in (0, 0.0005, 0.31, 1, 2, 2.25):
        got = [r[0] for r in sample_exact(rows, fraction, seed=4, epoch=1).orderBy("draw").collect()]
        assert got == [*order, *later[0], *later[1]][: int(fraction * 1000)]
    draws = [r["draw"] for r in sample_exact(rows, 2.25).collect()]
    assert sorted(draws) == list(range(2250))
    assert sample_exact(rows.where("global_idx < 0"), 0.5).count() == 0
    with pytest.raises(ValueError, match="negative"):
        sample_exact(rows, -0.1)
