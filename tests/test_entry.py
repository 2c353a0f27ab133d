import __spark_entry__ as entry
from plinth import catalogue


def test_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(catalogue.queries()) <= set(q) and set(o) <= set(q) and len(catalogue.queries()) > 80


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["query_id", "ord", "rank", "score"] and rows.count() > 0


def test_streams_equal_batches(spark, small):
    assert {r.what: r.n for r in catalogue.queries()["stream_equals_batch"](spark, small).collect()} == {w: spark.read.parquet(f"{small}/events.parquet").count() for w in ("stabiliser", "streaks")}
