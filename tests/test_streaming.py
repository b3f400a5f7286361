import datetime as dt

from turnloom.streaming import live


def test_live_merge_equals_batch(tmp_path, spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("p", at + dt.timedelta(seconds=i), float(s), float(s) + 1, w, t) for i, (s, w, t) in enumerate([(0, "a", "x"), (1.2, "a", "y"), (2.5, "b", "z"), (9, "b", "v"), (20, "a", "end")])]
    ddl = "project_id string, at timestamp, start double, end double, speaker string, text string"
    src, n = str(tmp_path / "in"), "live_merge"
    spark.createDataFrame(rows[:3], ddl).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(ddl).parquet(src)
    q = live.merge_live(stream).writeStream.format("memory").queryName(n).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    spark.createDataFrame(rows[3:], ddl).coalesce(1).write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    got = {(r["start"], r["end"], r["speaker"], r["text"]) for r in spark.table(n).collect()}
    assert {(0.0, 2.2, "a", "x y"), (2.5, 3.5, "b", "z"), (9.0, 10.0, "b", "v")} <= got
