"""Counters by classes against the pairs written out; tables are as long as the inputs, not as their pairs."""

import itertools

from pyspark.sql import functions as F

from plinth.operators import classes, graph, lookup


def tables(spark):
    foes = [(f"p{i}", 900.0 if i % 2 else 1.0, 60.0 if i % 3 == 0 else 0.0, 3.0 if i % 5 == 0 else None) for i in range(30)]
    enemies = spark.createDataFrame([(p, p, d, r, v, "", "") for p, d, r, v in foes], "page string, display string, defense double, resistance double, speed double, desc string, traits string")
    ops = [(f"o{i:02d}", f"c{i % 3}", i % 4 if i % 7 else None, *flags) for i, flags in enumerate(list(itertools.product([True, False], repeat=4)) * 3)]
    signals = spark.createDataFrame(ops, "name string, class string, star int, is_caster boolean, is_physical_dps boolean, has_arts_or_true boolean, has_control boolean")
    rows = [(f"s{i % 11}", i, f"p{i * 7 % 40}", i, "1") for i in range(120)]
    stages = spark.createDataFrame(rows, "stage string, ord int, enemy string, count int, level string")
    skills = signals.select("name", F.concat(F.lit("k"), "class").alias("skill"))
    return enemies, signals, stages, skills, graph.enemy_rules(enemies), graph.operator_answers(signals)


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    left, right = (sorted(map(str, (tuple(r) for r in x.select(*sorted(a.columns)).collect()))) for x in (a, b))
    assert left and left == right


def test_classes_equal_pairs(spark):
    enemies, signals, rows, skills, rules, answers = tables(spark)
    con, cou = graph.contains_edges(rows), graph.counters(rules, signals)
    nodes = graph.node_table(signals, skills, enemies, spark.createDataFrame([("s1", "t")], "code string, title string"))
    edges = graph.edge_table(skills, con, cou, graph.recommendations(con, cou))
    ops, facts = nodes.filter("kind = 'operator'").select("name", "star", "class"), edges.filter("relation in ('HAS_SKILL', 'CONTAINS_ENEMY')")
    ranked = graph.operators_for_stage(nodes, edges)
    same(classes.recommendations(rows, rules, answers), graph.recommendations(con, cou))
    same(classes.operators_for_stage(rows, rules, answers, ops), ranked)
    same(classes.best_for_stage(rows, rules, answers, ops, 5), ranked.filter("rank <= 5"))
    same(classes.graph_stats(nodes, facts, rows, rules, answers), graph.graph_stats(nodes, edges))
    same(classes.counter_heavy(rules, answers, enemies, ops, 800.0, 7), graph.counter_heavy(nodes, edges, 800.0, 7))
    same(classes.focus_subgraph(con, rules, answers, signals.select("name", "star"), 3, skills), graph.focus_subgraph(con, cou, signals.select("name", "star"), 3, skills))
    same(classes.node_detail(facts, rules, answers, 6), graph.node_detail(edges.filter("relation <> 'RECOMMENDS'"), 6))
    same(classes.stage_subgraph(con, rows, rules, answers, 5), graph.stage_subgraph(edges, cap=5))
    req = spark.createDataFrame([(i, f"s{i % 12}", [["c1"], [], ["c0", "c2"]][i % 3], [None, 1][i % 2], [2, None][i % 2], [3, None][i % 2], ["o01"]) for i in range(20)], "req_id long, stage string, classes array<string>, min_star int, max_star int, top_n int, exclude array<string>")
    same(classes.recommend(rows, rules, answers, ops, req), lookup.recommend(ranked, req))


def test_counters_are_spread(spark):
    """All enemies meet one rule: a shuffle by the rule would put every pair into one task."""
    enemies, signals, *_ = tables(spark)
    found = graph.counters(graph.enemy_rules(enemies.withColumn("defense", F.lit(900.0)).withColumn("resistance", F.lit(0.0)).withColumn("speed", F.lit(None).cast("double"))), signals)
    assert found.groupBy(F.spark_partition_id()).count().count() > 1


def test_hop_tables_hold_no_pairs(spark):
    enemies, signals, rows, skills, rules, answers = tables(spark)
    nodes = graph.node_table(signals, skills, enemies, spark.createDataFrame([], "code string, title string"))
    more, edges = classes.hop_tables(nodes, graph.contains_edges(rows), rules, answers)
    assert edges.count() == graph.contains_edges(rows).count() + rules.count() + answers.count()
    assert more.count() == nodes.count() + 3


def test_a_text_meets_a_pages_names_once(spark):
    """Requests that repeat a text don't each meet all names of the page."""
    skills = spark.range(50).select(F.lit("p").alias("page"), F.col("id").alias("ord"), F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("skill"))
    asked = spark.range(400).select(F.col("id").alias("req_id"), F.lit("p").alias("page"), F.when(F.col("id") % 2 == 0, F.lit(" n007 ")).otherwise("01").alias("skill_name"))
    got = lookup.skill_lookup(asked, skills).groupBy("skill").count().collect()
    assert {r.skill: r["count"] for r in got} == {"n007": 200, "n001": 200}
    plan = lookup.skill_lookup(asked, skills)._jdf.queryExecution().optimizedPlan().toString()
    assert all("Join" in line for line in plan.splitlines() if "Contains(" in line)  # a join of different texts, not an aggregate over requests
