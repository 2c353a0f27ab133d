"""The block index against plain BM25, the learnt vector index against exact search."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plinth.operators import blocks, retrieval, vector_index
from tests.test_retrieval import ask, corpus


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_blocks_equal_plain_bm25(spark, tmp_path):
    rng = random.Random(1)
    texts = [(i, rng.choice(("a", "b", None)), " ".join(f"w{min(int(rng.expovariate(0.05)), 300)}" for _ in range(rng.randrange(40)))) for i in range(600)]
    docs = spark.createDataFrame(texts + [(900, "a", None), (901, "a", "")], "ord long, type string, text string")
    asked = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(120)}" for _ in range(rng.randrange(1, 7)))) for i in range(40)] + [(50, ""), (51, None), (52, "nowhere")], "query_id long, query string")
    index = blocks.build(docs, str(tmp_path / "i"), span=40)
    for types in (None, ["b"]):
        for seed in (1, 40):
            assert rows(blocks.answer(index, asked, 5, types, seed=seed).hits) == rows(retrieval.bm25(docs, asked, 5, types))
    again = blocks.load(spark, str(tmp_path / "i"))
    assert rows(blocks.top_k(again, asked, 3)) == rows(retrieval.bm25(docs, asked, 3))
    assert blocks.top_k(blocks.build(docs.filter("false")), asked, 3).count() == 0


def test_blocks_with_falling_sums(spark):
    """Most words in most chunks: the mean idf is below 0, and so are the weights."""
    docs = spark.createDataFrame([(i, "t", "a b c" if i else "a d") for i in range(6)], "ord long, type string, text string")
    asked = ask(spark, "a d", "a b", "d")
    assert rows(blocks.top_k(blocks.build(docs), asked, 2)) == rows(retrieval.bm25(docs, asked, 2))
    assert rows(blocks.top_k(blocks.build(corpus(spark)), ask(spark, "能天使 技能", "敌人"), 5)) == rows(retrieval.bm25(corpus(spark), ask(spark, "能天使 技能", "敌人"), 5))


def test_most_postings_stay_unread(spark):
    """A rare word sets a threshold that the frequent one can't reach: of its postings only the cells of the rare word's chunks are read."""
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, "t", " ".join(["common"] * (i % 5 < 2) + [f"r{i % 500}"] + [f"f{rng.randrange(3000)}" for _ in range(8)])) for i in range(5000)], "ord long, type string, text string")
    asked = ask(spark, *[f"r{i} common" for i in range(20)])
    a = blocks.answer(blocks.build(docs, span=25), asked, 5)
    assert rows(a.hits) == rows(retrieval.bm25(docs, asked, 5))
    read, all_ = blocks.postings_read(a)
    assert read < 0.2 * all_, (read, all_)


def test_vector_index(spark, tmp_path):
    """Clustered vectors: few lists hold a query's neighbours; every row is indexed, whatever the sample."""
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(10)] for _ in range(40)]
    data = [(i, [x + rng.gauss(0, 0.15) for x in rng.choice(centres)]) for i in range(4000)]
    odd = [(5000, None), (5001, []), (5002, [math.nan] * 10), (5003, [0.0] * 10), (5004, [1.0]), (5005, [None] * 10)]
    vectors = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>")
    queries = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    model = vector_index.fit(vectors, sample=1500)
    index = vector_index.save(vectors, str(tmp_path / "v"), model)
    assert index.vectors.count() == 4000 and index.codes.select(F.explode("rows")).count() == 4000
    found = vector_index.search(index, queries, 10)
    good = vectors.filter("vec_id < 5000")
    exact = retrieval.vector_top_k(good, queries.filter("query_id < 5000"), 10)
    got = vector_index.recall(found, exact).first()
    read = vector_index.probed(index, queries).join(index.vectors.groupBy("list").count(), "list").agg(F.sum("count")).first()[0]
    assert got.queries == 80 and got.recall >= 0.9 and read < 0.25 * 80 * 4000, (got, read, model.probes, model.refine)
    assert found.groupBy("query_id").count().filter("count <> 10").count() == 0
    # All lists and all hits refined: the exact answer.
    whole = vector_index.search(index, queries, 10, probes=10_000, refine=500)
    assert vector_index.recall(whole, exact).first().recall == 1.0
    assert vector_index.fit(vectors.filter("false")) is None
    plan = index.vectors.filter(F.col("list").isin([1, 2]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [list" in plan


@pytest.mark.parametrize("n", [1, 3])
def test_vector_index_of_few_rows(spark, tmp_path, n):
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(n)], "vec_id long, embedding array<double>")
    index = vector_index.save(vectors, str(tmp_path / "v"), vector_index.fit(vectors))
    got = vector_index.search(index, vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 2).collect()
    assert len(got) == n * min(n, 2) and all(r.vec_id == r.query_id for r in got if r["rank"] == 0)
