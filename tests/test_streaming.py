from __future__ import annotations

from pyspark.sql import functions as F

from dayspans.streaming.episodes import stream_sessions

DATA = "/root/testdata/sf0.001"


def test_stream_gives_the_table_result(spark, tmp_path):
    """All sessions that the watermark has closed come out of the stream as they do from the table."""
    events = spark.read.parquet(f"{DATA}/events.parquet").select("user_id", "ts")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = stream_sessions(stream, ["user_id"], gap="6 hours").writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.read.schema("user_id long, start_time timestamp, end_time timestamp, n_events long").parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in stream_sessions(events, ["user_id"], gap="6 hours").collect()}
    last = events.agg(F.max("ts")).first()[0]
    closed = {r for r in want if (last - r[2].replace(tzinfo=None)).total_seconds() > 8 * 3600}
    assert got and closed <= got <= want
