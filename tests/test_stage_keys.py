"""A stage's code, title and heads of its title are keys of one join, and only what is shown of a stage is shuffled."""

from pyspark.sql import functions as F

from plinth.operators import lookup


def test_one_join_finds_a_stage(spark):
    stages = spark.createDataFrame([(1, "A", "one two three"), (2, "A", "one two"), (3, "B", "A"), (4, None, "x y"), (5, "C", None), (6, "D", "one two")], "ord int, code string, title string")
    asked = spark.createDataFrame([(1, " A "), (2, "one two"), (3, "one"), (4, "x"), (5, "C"), (6, "three"), (7, None), (8, "one two three")], "req_id int, name string")
    found = lookup.resolve_stage(asked, stages)
    got = {r.req_id: (r.code, r.title, r.found) for r in found.collect()}
    miss = (None, None, False)
    assert got == {1: ("A", "one two", True), 2: ("A", "one two", True), 3: ("A", "one two three", True), 4: (None, "x y", True), 5: ("C", None, True), 6: miss, 7: miss, 8: ("A", "one two three", True)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_entries_that_are_not_shown_stay_behind(spark):
    stages = spark.range(3).select(F.col("id").alias("ord"), F.lit("A").alias("code"), F.lit("t").alias("title"), F.create_map(F.lit("a"), F.col("id").cast("string"), F.lit("hidden"), F.lit("x")).alias("normal"), F.array(F.create_map(F.lit("q"), F.lit("1"), F.lit("e"), F.lit(""))).alias("enemies"))
    got = lookup.stage_lookup(spark.createDataFrame([(1, "A"), (2, "none")], "req_id int, name string"), stages, {"a": "b"}, ["q", "e"])
    assert [(r.req_id, r.code, r.info, r.enemies, r.found) for r in got.orderBy("req_id").collect()] == [(1, "A", {"b": "2"}, [{"q": "1"}], True), (2, None, None, None, False)]
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert next(i for i, x in enumerate(plan) if "Aggregate" in x and "max_by" in x) < next(i for i, x in enumerate(plan) if "map_filter" in x or "hidden" in x)
