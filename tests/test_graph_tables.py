"""Graph tables in buckets, views of nodes with their attributes, records of enemies without a page."""

import json

from pyspark.sql import functions as F

from plinth.operators import graph
from plinth.sources import writers

NODE = "node_id string, kind string, name string, class string, star int, defense double, hp double"
NODES = [("operator:a", "operator", "a", "术师", 5, -1.0, -1.0), ("operator:b", "operator", "b", "", -1, -1.0, -1.0), ("enemy:x", "enemy", "x", "", -1, 500.0, 9.0), ("enemy:lone", "enemy", "lone", "", -1, -1.0, -1.0)]
EDGES = [("operator:a", "enemy:x", "COUNTERS", "r1"), ("operator:a", "enemy:x", "COUNTERS", "r2"), ("operator:b", "enemy:x", "COUNTERS", "r1"), ("operator:a", "enemy:gone", "COUNTERS", "r1")]


def frames(spark):
    return spark.createDataFrame(NODES, NODE), spark.createDataFrame(EDGES, "src string, dst string, relation string, key string")


def test_views_have_attributes(spark):
    got = {r.node_id: r for r in graph.node_view(*frames(spark), cap=2).collect()}
    assert json.loads(got["operator:a"].attrs) == {"kind": "operator", "name": "a", "class": "术师", "star": 5} and json.loads(got["enemy:x"].attrs)["hp"] == 9.0
    assert (got["enemy:x"].total, got["enemy:x"].truncated, len(got["enemy:x"].neighbours)) == (3, True, 2) and got["enemy:x"].neighbours[0]["name"] == "a"
    assert (got["enemy:lone"].total, got["enemy:lone"].neighbours) == (0, [])
    assert [n["node_id"] for n in got["operator:a"].neighbours] == ["enemy:gone", "enemy:x"] and got["operator:a"].neighbours[0].kind is None


def test_hops_shuffle_no_edges(spark, tmp_path):
    nodes, edges = frames(spark)
    names = writers.write_graph_tables(nodes, edges, "small_graph", str(tmp_path / "g"), buckets=4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out, known = spark.table(names["out"]), spark.table(names["nodes"])
        joined = known.join(out, F.col("node_id") == F.col("src"))
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 4
        hop = graph.neighbours_of(nodes.filter("kind = 'operator'"), out)
        plan = hop._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and hop.count() == 4  # the start alone
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert {(r.what, r.kind, r.n) for r in spark.table(names["stats"]).collect()} == {("node", "operator", 2), ("node", "enemy", 2), ("node", None, 4), ("edge", "COUNTERS", 4), ("edge", None, 4)}


def test_light_records_say_all_that_rows_say(spark):
    rows = spark.createDataFrame([(0, "新", "3", "x", "1.5", "900", "精英"), (1, "新", "4", "5", "2", "1", "普通"), (2, "旧", "1", "1", "1", "1", None)], "ord int, enemy string, defense string, resistance string, speed string, hp string, position string")
    known = spark.createDataFrame([("旧",)], "page string")
    r = graph.light_records(rows, known).collect()
    assert [(x.page, x.defense, x.resistance, x.speed, x.hp, x.position) for x in r] == [("新", 3.0, None, 1.5, 900.0, "精英")]
    r = graph.light_records(rows.drop("speed", "hp", "position"), known).first()
    assert (r.hp, r.position, r.speed) == (None, "", None)


def test_focus_with_skills(spark):
    con = spark.createDataFrame([("s", "x")], "stage string, enemy string")
    cou = spark.createDataFrame([("x", "a", 0.5), ("x", "a", 0.9), ("x", "b", 0.7)], "page string, name string, weight double")
    stars = spark.createDataFrame([("a", 5), ("b", 6)], "name string, star int")
    skills = spark.createDataFrame([("a", "k2"), ("a", "k1"), ("b", None)], "name string, skill string")
    got = graph.focus_subgraph(con, cou, stars, 2, skills).orderBy("pos").collect()
    assert [(r.name, r.weight, r.skills) for r in got] == [("a", 0.9, ["k1", "k2"]), ("b", 0.7, [])]


def test_a_bucket_is_one_file(spark, tmp_path):
    nodes, edges = frames(spark)
    wide = spark.range(400).selectExpr("'operator:' || id as src", "'enemy:' || id % 7 as dst", "'COUNTERS' as relation", "'r1' as key").repartition(8)
    writers.write_graph_tables(nodes, edges.unionByName(wide), "wide_graph", str(tmp_path / "w"), buckets=4)
    for part in ("nodes", "out", "in"):
        assert 0 < len(list((tmp_path / "w" / part).glob("part-*"))) <= 4
