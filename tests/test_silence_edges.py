"""Gaps and ends of silence to the microsecond, as the batch rule has them."""

from pyspark.sql import functions as F

from plinth.streaming import live

HOUR, TEN = 3_600_000_000, 600_000_000


def test_gaps_count_in_microseconds(spark, tmp_path):
    end = 1_700_000_000_000_000 + 2 * HOUR
    last = end - TEN - HOUR  # silent for the whole gap when the watermark has come
    rows = [(1, last), (2, last + 1), (3, last - 5 * HOUR + 400), (3, last - 4 * HOUR + 401), (4, last - 5 * HOUR + 999), (4, last - 4 * HOUR + 999), (9, end)]
    events = spark.createDataFrame(rows, "series_id long, us long").select("series_id", F.timestamp_micros("us").alias("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = live.silences(stream, 3_600_000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.schema("series_id long, n long, last_ms long").parquet(str(tmp_path / "out")).collect())
    ms = lambda us: us // 1000
    assert got == [(1, 1, ms(last)), (3, 1, ms(last - 5 * HOUR)), (3, 1, ms(last - 4 * HOUR)), (4, 2, ms(last - 4 * HOUR))]
