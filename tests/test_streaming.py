from tessera.operators import change_log
from tessera.streaming.change_stream import change_stream


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f % 2, "ab"[f % 3 == 0], f, f // 5 % 3) for f in range(60)]
    schema = "chip long, reg string, frame long, val long"
    for i in range(3):
        spark.createDataFrame(rows[20 * i : 20 * i + 20], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = change_stream(stream).writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "at")).outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = sorted(tuple(r) for r in spark.table("changes").select("chip", "reg", "clock", "val").collect())
    log = change_log.change_log(spark.createDataFrame(rows, schema), change_log.PAL_CYCLES, "chip")
    assert got == sorted(tuple(r) for r in log.select("chip", "reg", "clock", "val").collect())
