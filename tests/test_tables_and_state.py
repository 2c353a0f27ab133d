"""Upserts by bucket, lines with their numbers, a file for each entity, and stream state that ends."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from plinth.sources import readers, writers
from plinth.sources.entity_files import EntityWriter
from plinth.streaming import live


def files(base):
    return {os.path.join(d, f) for d, _, names in os.walk(base) for f in names if f.startswith("part-")}


def test_small_batches_rewrite_a_small_part(spark, tmp_path):
    base = str(tmp_path / "t")
    rows = spark.range(2000).select("id", F.lit(1).alias("batch"), F.lit("a").alias("_side"), F.lit("b").alias("row"))
    writers.upsert(spark, base, rows, batch=0, buckets=16)
    before = files(base)
    assert len(before) == 16
    new = spark.createDataFrame([(7, 2, "c", "d", 9)], "id long, batch int, _side string, row string, more int")
    touched = writers.upsert(spark, base, new, batch=1, buckets=4)
    after = files(base)
    assert len(touched) == 1 and len(after) == 16 and len(before & after) == 15  # the folders' number stays that of the table
    assert writers.upsert(spark, base, spark.createDataFrame([(7, 1, "z", "z", 0)], new.schema), batch=1) == [] and files(base) == after
    got = writers.read_table(spark, base)
    assert got.count() == 2000 and got.filter("id = 7").first().asDict() == {"id": 7, "batch": 2, "_side": "c", "row": "d", "more": 9} and got.filter("id = 8").first().more is None
    writers.upsert(spark, base, spark.createDataFrame([(None, 1, "n", "n", 0), (None, 3, "m", "n", 0)], new.schema), batch=2)
    assert [r["_side"] for r in writers.read_table(spark, base).filter("id is null").collect()] == ["m"]
    assert writers.upsert(spark, base, new.filter("false"), batch=3) == []
    with pytest.raises(ValueError):
        writers.upsert(spark, base, spark.range(1).withColumn(writers.BUCKET, F.lit(1)))


def test_upserted_takes_the_last(spark):
    old = spark.createDataFrame([(1, 5, "old"), (2, 5, "old"), (3, None, "old")], "id long, batch int, v string")
    new = spark.createDataFrame([(2, 1, "new"), (3, None, "new"), (4, None, "none"), (4, 0, "zero")], "id long, batch int, v string")
    assert {(r.id, r.v) for r in writers.upserted(old, new).collect()} == {(1, "old"), (2, "new"), (3, "new"), (4, "zero")}
    maps = spark.createDataFrame([(1, {"a": 1})], "id long, m map<string, int>")
    assert writers.upserted(maps, maps).count() == 1


def test_line_numbers_across_splits(spark, tmp_path):
    lines = [json.dumps({"q": str(i), "pad": "é" * (i % 90)}, ensure_ascii=False) for i in range(3000)]
    for i in (0, 17, 1234, 2999):
        lines[i] = "{broken"
    lines[500] = ""
    lines[700] = json.dumps({"q": None})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(lines), encoding="utf-8")
    (tmp_path / "in" / "b.jsonl").write_text('{"q": "x"}\n\nbad', encoding="utf-8")
    path, old = str(tmp_path / "in"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 10
        want = {("a.jsonl", i + 1) for i in (0, 17, 700, 1234, 2999)} | {("b.jsonl", 3)}
        assert {(r.file, r.line) for r in readers.bad_lines(spark, path, "q string", ["q"]).collect()} == want
        kept = readers.jsonl(spark, path, "q string", "keep", ["q"])
        assert kept.count() == 3001 and {(r.file, r.line) for r in kept.filter("bad").collect()} == want
        assert kept.filter("not bad and file = 'a.jsonl' and cast(q as int) + 1 <> line").count() == 0
        with pytest.raises(ValueError, match="bad line 1 in a.jsonl"):
            readers.jsonl(spark, path, "q string", "raise", ["q"])
        assert readers.jsonl(spark, path, "q string", required=["q"]).count() == 2995
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_file_for_each_entity(spark, tmp_path):
    rows = spark.createDataFrame([("a/b", "k:1", 1), ("a:b", "k:1", 2), ("甲", "k:1", 3), (None, None, 4), ("x", "", 5)], "title string, category string, n int").repartition(3)
    out = tmp_path / "e"
    for _ in range(2):  # again: the same files
        assert writers.write_entity_files(rows, str(out)) == 4
        assert sorted(str(p.relative_to(out)) for p in out.rglob("*.json")) == ["_/_.json", "_/x.json", "k_1/a_b.json", "k_1/甲.json"]
        assert not list(out.glob("_staging*"))
    assert json.loads((out / "k_1" / "a_b.json").read_text())["n"] == 2
    # A task that dies in the middle leaves nothing at the place of the entities but whole files, and its repeat no double ones.
    writer = EntityWriter(str(tmp_path / "f"))

    class Cell:
        def __init__(self, folder, name, json):
            self.folder, self.name, self.json = folder, name, json

    def dying():
        yield Cell("k", "one", "{}")
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(dying())
    assert writer.write(iter([Cell("k", "one", "{}"), Cell("k", "two", "{}")])).files == 2
    writer.commit([])
    assert sorted(p.name for p in (tmp_path / "f").rglob("*") if p.is_file()) == ["one.json", "two.json"]


@pytest.mark.parametrize("which", ["value", "list", "map"])
def test_state_ends_with_silence(spark, tmp_path, which):
    spark.createDataFrame([(k, i, i % 3) for k in range(3) for i in range(40)], "series_id long, ord long, kept int").write.json(str(tmp_path / "in"))
    rows = spark.readStream.schema("series_id long, ord long, kept int").json(str(tmp_path / "in"))
    if which == "value":
        out = live.streaks(rows, silent_ms=1500)
    elif which == "list":
        out = live.last_frames(rows, 4, silent_ms=1500)
    else:
        plan = spark.createDataFrame([("s", 0.0, "boss", 1, "plan")], "stage_id string, expected_sec double, enemy string, count int, source string")
        states = rows.select("series_id", F.lit("s").alias("stage_id"), "ord", F.col("ord").cast("double").alias("elapsed"), F.array(F.lit("boss")).alias("seen"))
        out = live.presence_stream(states, plan, silent_ms=1500)
    q = out.writeStream.format("memory").queryName(f"silent_{which}").option("checkpointLocation", str(tmp_path / "log")).outputMode("append").trigger(processingTime="300 milliseconds").start()
    try:
        totals, end = [], time.time() + 90
        while time.time() < end and not (totals and max(totals) >= 3 and totals[-1] == 0):
            totals += [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress[-1:] if p["stateOperators"]]
            assert q.exception() is None
            time.sleep(0.3)
        assert max(totals) >= 3 and totals[-1] == 0, totals[-5:]
        assert spark.table(f"silent_{which}").count() == 120
    finally:
        q.stop()


def test_states_go_on_over_batches(spark, tmp_path):
    """Two micro-batches: the list and the map carry over."""
    for n in range(2):
        spark.createDataFrame([(1, 10 * n + i, ["a"] if n == 0 and i == 2 else []) for i in range(3)], "series_id long, ord long, seen array<string>").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        time.sleep(0.1)
    plan = spark.createDataFrame([("s", 0.0, "a", 1, "plan")], "stage_id string, expected_sec double, enemy string, count int, source string")

    def finished(name, make):
        rows = spark.readStream.schema("series_id long, ord long, seen array<string>").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        q = make(rows).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert {r.ord: r.recent for r in finished("last4", lambda rows: live.last_frames(rows, 4))}[12] == [2, 10, 11, 12]
    got = finished("sure", lambda rows: live.presence_stream(rows.select("series_id", F.lit("s").alias("stage_id"), "ord", F.col("ord").cast("double").alias("elapsed"), "seen"), plan))
    assert {r.ord: r.source for r in got} == {0: "plan", 1: "plan", 2: "cv", 10: "cv", 11: "cv", 12: "cv"}
