"""Files of entities are read back in the tasks: the plan has no entry for each file."""

import json

from plinth.sources import readers, writers


def test_files_are_read_where_they_are_dealt(spark, tmp_path):
    rows = [(f"t {i}", ["a", "b/c", None][i % 3], i, "é\n" * (i % 5)) for i in range(300)]
    out = str(tmp_path / "e")
    assert writers.write_entity_files(spark.createDataFrame(rows, "title string, category string, n int, text string").coalesce(1), out) == 300
    (tmp_path / "e" / "a" / "other.txt").write_text("not an entity")
    (tmp_path / "e" / "_staging-lost").mkdir()
    back = readers.entity_files(spark, out)
    assert not back.inputFiles()
    got = sorted((r.folder, r.name, json.loads(r.json)["n"], json.loads(r.json)["text"]) for r in back.collect())
    assert got == sorted((["a", "b_c", "_"][i % 3], f"t {i}", i, text) for i, (_, _, _, text) in enumerate(rows))
    assert readers.entity_files(spark, str(tmp_path / "none")).count() == 0
