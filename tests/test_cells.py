"""The block index shuffles no posting, and chunks that share an ord count together."""

import random

from plinth.operators import blocks, retrieval


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def made(spark):
    rng = random.Random(5)
    some = [(i, ("a", "b", None)[i % 3], " ".join(f"w{min(int(rng.expovariate(0.05)), 99)}" for _ in range(rng.randrange(1, 30)))) for i in range(400)]
    # Some ords come again, in one type or another, of one length or another.
    again = [(i, ("a", "b")[i % 2], some[i + 1][2]) for i in range(0, 60, 3)] + [(5, "b", "w1 w2 w3"), (5, "b", "w1 w1 w9"), (5, "a", "w2")]
    docs = spark.createDataFrame(some + again, "ord long, type string, text string")
    asked = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(80)}" for _ in range(rng.randrange(1, 6)))) for i in range(30)], "query_id long, query string")
    return docs, asked


def test_shared_ords_count_together(spark, tmp_path, monkeypatch):
    docs, asked = made(spark)
    index = blocks.build(docs, str(tmp_path / "i"), span=20)
    for types in (None, ["b"]):
        assert rows(blocks.answer(index, asked, 5, types).hits) == rows(retrieval.bm25(docs, asked, 5, types))
    monkeypatch.setattr(blocks, "SENT_BYTES", 2000)  # several groups of queries
    assert rows(blocks.top_k(index, asked, 5)) == rows(retrieval.bm25(docs, asked, 5))


def test_cells_are_made_where_chunks_are_read(spark, tmp_path):
    """As many chunks as there are rows, in cells of one type; the plan left for the hits reads rows of tasks alone."""
    docs, asked = made(spark)
    docs = docs.dropDuplicates(["ord"])
    index = blocks.build(docs, str(tmp_path / "i"), span=20)
    assert index.cells.selectExpr("sum(size(ords))").first()[0] == docs.count()
    assert index.cells.selectExpr("max(size(array_distinct(kinds)))", "max(size(ords))").first() == (1, 20)
    plan = blocks.top_k(index, asked, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
