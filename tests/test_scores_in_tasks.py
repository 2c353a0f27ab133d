"""Retrieval that sums scores up inside the tasks gives the rows of joined postings, and shuffles no posting."""

import pytest
from pyspark.sql import functions as F

from plinth.operators import retrieval


@pytest.fixture
def docs(spark):
    some = [(i, ("en", "fr")[i % 2], " ".join(f"w{(i * j) % (5 + j)}" for j in range(1, 9))) for i in range(300)]
    # Copies tie; ords that repeat count together; texts and types may be missing.
    odd = [(900 + i, "en", some[7][2]) for i in range(20)] + [(3, "en", "w1 w1 rare"), (3, "en", "w2"), (990, None, "w1 rare"), (991, "en", None), (992, "en", " ")]
    return spark.createDataFrame(some + odd, "ord long, type string, text string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def joined(monkeypatch, make):
    with monkeypatch.context() as m:
        m.setattr(retrieval, "SENT_ROWS", 0)
        return rows(make())


def test_equal_to_joins(spark, docs, monkeypatch):
    asked = spark.createDataFrame([(1, "w1 w2 w2 rare"), (2, "w0 w3 w4 w5"), (3, "nothing"), (4, None), (5, "w7")], "query_id long, query string")
    requests = asked.select(F.col("query_id").alias("req_id"), "query", (F.col("query_id") * 3).cast("int").alias("k"), F.when(F.col("query_id") % 2 == 0, "fr").alias("doc_type"))
    for make in (lambda: retrieval.bm25(docs, asked, 7), lambda: retrieval.bm25(docs, asked, 7, types=["fr"]), lambda: retrieval.token_overlap(docs, asked, 7), lambda: retrieval.search_guide(docs, requests)):
        assert rows(make()) == joined(monkeypatch, make)


def test_no_posting_is_shuffled(spark, docs):
    """The rows of the plan that is left are the hits of the tasks, not postings."""
    asked = spark.createDataFrame([(1, "w1 w2"), (2, "w3")], "query_id long, query string")
    for hits in (retrieval.bm25(docs, asked, 2), retrieval.token_overlap(docs, asked, 2)):
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "FileScan parquet" in plan


def test_queries_in_small_groups(spark, monkeypatch):
    """A task has the scores of some queries at a time; the rows are those of all queries at once."""
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5 - 2), 1.0]) for i in range(200)], "vec_id long, embedding array<float>")
    asked = vectors.filter("vec_id < 11").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    whole = rows(retrieval.vector_top_k(vectors, asked, 4))
    monkeypatch.setattr(retrieval, "QUERIES", 3)
    assert rows(retrieval.vector_top_k(vectors, asked, 4)) == whole and len(whole) == 44
