from pyspark.sql import functions as F

from resonara.streaming.framing import event_frames

from .conftest import SF


def test_stream_equals_table_once_the_watermark_has_passed(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    parts = [tmp_path / "in" / str(k) for k in range(2)]
    cut = events.agg(F.percentile_approx(F.col("ts").cast("double"), 0.5)).first()[0]
    events.where(F.col("ts").cast("double") <= cut).coalesce(1).write.parquet(str(parts[0]))
    events.where(F.col("ts").cast("double") > cut).coalesce(1).write.parquet(str(parts[1]))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = event_frames(stream).writeStream.format("memory").queryName("frames").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.track, r.begin): (r.n, round(r.total, 6)) for r in spark.table("frames").collect()}
    want = {(r.track, r.begin): (r.n, round(r.total, 6)) for r in event_frames(events).collect()}
    assert len(got) > 100 and all(want[k] == v for k, v in got.items())
