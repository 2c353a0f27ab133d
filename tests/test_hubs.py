"""The first edges of nodes: one sort for all nodes but hubs, whose rows are cut before they are shuffled."""

from pyspark.sql import functions as F

from plinth.operators import graph


def edges(spark):
    ids = spark.range(400)
    hub = ids.select(F.lit("hub").alias("src"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("dst"))
    both = hub.unionByName(ids.select(F.concat(F.lit("s"), (F.col("id") % 90).cast("string")).alias("src"), F.concat(F.lit("x"), (F.col("id") % 7).cast("string")).alias("dst")))
    return both.select("src", "dst", F.lit("R").alias("relation"), F.concat(F.lit("k"), F.monotonically_increasing_id().cast("string")).alias("key"))


def test_hubs_and_others_give_the_same_rows(spark, tmp_path, monkeypatch):
    edges(spark).write.parquet(str(tmp_path / "e"))
    e = spark.read.parquet(str(tmp_path / "e"))
    plain = graph.node_detail(e, 5)
    monkeypatch.setattr(graph, "HUB", 100)
    split = graph.node_detail(e, 5)
    want = {}
    for r in e.collect():
        for node, rank, other, way in ((r.src, 0, r.dst, "out"), (r.dst, 1, r.src, "in")):
            want.setdefault(node, []).append((rank, other, r.key, way))
    rows = sorted((node, way, other, key, i + 1, len(of), len(of) > 5) for node, of in want.items() for i, (_, other, key, way) in enumerate(sorted(of)[:5]))
    for df in (plain, split):
        assert sorted(map(tuple, df.select("node_id", "direction", "neighbour", "key", "pos", "total", "truncated").collect())) == rows
    # Only a hub is cut before the shuffle; nothing else is sorted twice or joined with its total.
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" not in text(plain) and "Join" not in text(plain) and "WindowGroupLimit" in text(split)
