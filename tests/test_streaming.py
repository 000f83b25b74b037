from threadloom.streaming import snapshots

SCHEMA = "user_id bigint, day int, attitude_score double, ts timestamp_ntz"


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows = events.selectExpr("user_id", "day(ts) AS day", "(value - 50) / (value + 50) AS attitude_score", "ts").repartition(4)
    rows.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for name, f in (("attitudes", snapshots.running_attitudes), ("volume", snapshots.window_volume)):
        q = f(stream()).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = {r[0]: round(float(r[1]), 9) for r in spark.table(name).collect()}
        assert got == {r[0]: round(float(r[1]), 9) for r in f(spark.read.parquet(f"{tmp_path}/in")).collect()}
