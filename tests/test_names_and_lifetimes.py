"""Many names at once against a naive matcher; units on the field as intervals against the state copied from action to action; the reasons of examples."""

import random
import time

from pyspark.sql import functions as F

from plinth.functions import names
from plinth.functions.text import words, words_with_names
from plinth.operators import curation


def naive(listed, text):
    own = sorted({n.lower() for n in listed if 2 <= len(n) <= 20}, key=lambda n: -len(n))
    found, rest, i = [], "", 0
    while i < len(text):
        hit = next((n for n in own if text.startswith(n, i)), None)
        if hit:
            found.append(hit)
            rest += " "
            i += len(hit)
        else:
            rest += text[i]
            i += 1
    return found, rest


def test_six_thousand_names(spark):
    rng = random.Random(6)
    listed = ["".join(rng.choice("abc新约能天使甲乙丙 ") for _ in range(rng.randrange(1, 9))) for _ in range(6000)] + ["a", "x" * 21, "Ab"]
    texts = ["".join(rng.choice("abcABC新约能天使甲乙丙 .") for _ in range(rng.randrange(80))) for _ in range(60)] + ["", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    split = names.splitter(spark, listed)
    got = {r.id: (r.s["names"], r.s.rest) for r in frame.select("id", split(F.col("text")).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (naive(listed, t.lower()) if t is not None else ([], None))
    few = listed[:40]
    a = frame.select("id", names.named_words(spark, few)(F.col("text")).alias("t"), words_with_names(F.col("text"), few).alias("w"), words(F.col("text")).alias("plain")).collect()
    assert all(r.t == (r.w or []) for r in a)
    assert [r.t for r in frame.select(names.named_words(spark, [])(F.col("text")).alias("t"), "id").orderBy("id").collect()] == [r.plain or [] for r in sorted(a, key=lambda r: r.id)]


def test_flanked_names(spark):
    row = spark.createDataFrame([("w1-1 11-1 1-1。1-1x",)], "t string").select(names.splitter(spark, ["1-1"], flank=True)(F.col("t")).alias("s")).first()
    assert row.s["names"] == ["1-1"] and row.s.rest == "w1-1 11-1  。1-1x"


def test_time_grows_with_the_text_not_the_names():
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh") for _ in range(200_000))
    took = []
    for n in (100, 20_000):
        found = names.automaton(["".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(n)])
        began = time.perf_counter()
        names.spans(found, text)
        took.append(time.perf_counter() - began)
    assert took[1] < 20 * took[0]


def test_lifetimes_equal_copied_state(spark):
    rng = random.Random(9)
    kinds = ["deploy"] * 5 + ["retreat"] * 4 + ["skill"]
    jobs = [(f"j{j}", [(rng.choice(kinds), rng.choice(["a", "b", "c", "d", "e", None, ""]), rng.choice([[rng.randrange(3), rng.randrange(2)], None, []]), rng.choice(["上", None])) for _ in range(n)]) for j, n in enumerate((0, 1, 3, 40, 200, 200))]
    frame = spark.createDataFrame(jobs, "job_id string, actions array<struct<type: string, name: string, location: array<int>, direction: string>>")
    want = {(r.job_id, r.idx): [tuple(u) for u in r.units] for r in frame.select("job_id", F.posexplode(curation.deployed_before()).alias("idx", "units")).collect()}
    rows = frame.select("job_id", F.posexplode("actions").alias("idx", "a")).select("job_id", "idx", "a.*")
    for width in (1, 7, 64):
        assert {(r.job_id, r.idx): [tuple(u) for u in r.units] for r in curation.units_before(rows, width).collect()} == want
    assert {(r.job_id, r.idx): r.n_before for r in curation.count_before(rows).collect()} == {k: len(v) for k, v in want.items()}
    assert max(map(len, want.values())) >= 3


def test_reasons(spark):
    action = "struct<type:string,name:string,kills:int,cost_changes:string,location:array<int>,direction:string>"
    acts = [("deploy", n, 1, None, [1, 2], "上") for n in ("射", "辅", "术", "医", "卫", "装置")] + [("skill", "射", 2, None, None, None), ("skill", "卫", 2, None, None, None)]
    jobs = spark.createDataFrame([("j", "3-8", None, acts)], f"job_id string, stage_name string, title string, actions array<{action}>")
    cards = [("射", "狙击", "速射手", "优先空中", ["强击", "连射"]), ("辅", "辅助", "凝滞师", "减速", None), ("术", "术师", "中坚", "法伤", []), ("医", "医疗", "医师", "治疗", []), ("卫", "近卫", "剑豪", "两击", [])]
    operators = spark.createDataFrame(cards, "name string, class string, branch string, trait string, skills array<string>")
    stages = spark.createDataFrame([("3-8", "黄昏", {}, [("碎骨", "100")])], "code string, title string, params map<string,string>, enemies array<struct<name:string,defense:string>>")
    rows = curation.examples(jobs, stages, operators).orderBy("idx").collect()
    second = [r.answer.split("\n")[3] for r in rows]
    assert "优先空中" in second[0] and "减速" in second[1] and "法术输出" in second[2] and "射、辅、术" in second[3]
    assert "两击" not in second[4] and "无卡" in second[5] and "强击、连射" in second[6] and "候选" not in second[7]
    assert "前排" in curation.examples(jobs.withColumn("actions", F.slice("actions", 4, 1)), stages, operators).first().answer
    assert "破甲：碎骨" in curation.examples(jobs, stages.withColumn("enemies", F.transform("enemies", lambda e: F.struct(e["name"].alias("name"), F.lit("1,500").alias("defense")))), operators).filter("idx = 2").first().answer
    assert curation.examples(jobs, stages, operators.drop("skills")).count() == 8


def test_quantiles_and_places_keep_all_columns(spark, monkeypatch):
    import numpy as np

    from plinth.functions import ordering
    from plinth.operators import lookup

    monkeypatch.setattr(ordering, "RANGE", 37)
    rng = random.Random(12)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, float(rng.randrange(20)), rng.random()])) for _ in range(400)] + [("one", 5.0), ("none", None)]
    got = {r.g: r for r in ordering.exact_quantiles(spark.createDataFrame(data, "g string, v double"), ["g"], "v", {"low": 0.0, "mid": 0.5, "high": 0.95, "top": 1.0}).collect()}
    for g in ("a", "b", None, "one"):
        x = [v for k, v in data if k == g and v is not None]
        assert got[g].n == len(x) and np.allclose([got[g][c] for c in ("low", "mid", "high", "top")], np.quantile(x, [0, 0.5, 0.95, 1]))
    assert "none" not in got
    rows = spark.createDataFrame([(i, f"k{i}", f"r{i}", f"a{i}") for i in range(200)], "id int, _key string, range string, at string").repartition(3)
    out = ordering.running(ordering.placed(rows, -F.col("id")), "place", F.lit(2))
    assert all((r["_key"], r.range, r["at"], r.place, r.running) == (f"k{r.id}", f"r{r.id}", f"a{r.id}", 200 - r.id, 2 * (200 - r.id)) for r in out.collect())
    skills = spark.createDataFrame([("p", 1, "fire"), ("p", 0, "ice storm")], "page string, ord int, skill string")
    asked = spark.createDataFrame([(1, "p", "ice"), (2, "p", "none"), (3, "q", "x")], "req_id int, page string, skill_name string")
    assert {r.req_id: (r.skill, r.message) for r in lookup.skill_lookup(asked, skills).collect()} == {1: ("ice storm", ""), 2: (None, "available: ice storm、fire"), 3: (None, "available: ")}

