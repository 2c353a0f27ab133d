import json

import pytest
from pyspark.sql import functions as F

from plinth.operators import extract
from plinth.sources import readers, writers


def write(folder, **files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        (folder / name.replace("__", ".")).write_text(text, encoding="utf-8")
    return str(folder)


def test_entities(spark, tmp_path):
    p = write(tmp_path / "a", x__json='{"name": "甲"}', y__json='{"name": "乙"}')
    assert {(r.stem, r.name) for r in readers.entities(spark, p, "name string").collect()} == {("x", "甲"), ("y", "乙")}
    p = write(tmp_path / "b", x__json='{"name": "甲"}', bad__json='{"name": ')
    with pytest.raises(Exception):
        readers.entities(spark, p, "name string").collect()
    good, bad = readers.entities_lenient(spark, p, "name string")
    assert [r.stem for r in good.collect()] == ["x"] and [r.stem for r in bad.collect()] == ["bad"]
    assert readers.entities(spark, str(tmp_path / "none"), "name string").count() == 0
    with pytest.raises(Exception):
        readers.entities(spark, str(tmp_path / "none"), "name string", missing="error").count()


def test_jsonl(spark, tmp_path):
    p = write(tmp_path / "j", a__jsonl='{"q": "1"}\nnot json\n\n{"q": null}\n  \n{"q": "2"}\n')
    assert sorted(r.q for r in readers.jsonl(spark, p, "q string", required=["q"]).collect()) == ["1", "2"]
    assert readers.jsonl(spark, p, "q string", "keep", ["q"]).filter("bad").count() == 2
    with pytest.raises(Exception, match="bad line"):
        readers.jsonl(spark, p, "q string", "raise", ["q"]).collect()


def test_pages_tiers_episodes(spark, tmp_path):
    item = {"data": [{"id": 1, "content": json.dumps({"stage_name": "s"})}, {"id": 2, "content": "{bad"}]}
    p = write(tmp_path / "p", page_1__json=json.dumps(item), page_2__json="{broken")
    assert [(r.id, r.content.stage_name) for r in readers.paged_items(spark, p, "id: int", "stage_name string").collect()] == [(1, "s")]
    t = write(tmp_path / "t", t__json='{"甲": {"tier": "T0", "score": 1.5}}', l__json="[1]")
    assert readers.tier_list(spark, f"{t}/t.json").first()[:3] == ("甲", "T0", 1.5) and readers.tier_list(spark, f"{t}/no.json").count() == 0
    with pytest.raises(Exception, match="not a map"):
        readers.tier_list(spark, f"{t}/l.json").collect()
    e = write(tmp_path / "e", **{"ok-1__json": '{"outcome": "win"}', "bad id__json": '{"outcome": "win"}'})
    assert [r.episode_id for r in readers.episodes(spark, e, "outcome string").collect()] == ["ok-1"]
    assert {r.name for r in readers.stems(spark, t).collect()} == {"t", "l"}
    assert readers.annotated_timeline(spark, {"s": [{"time_sec": 5, "enemy": "x"}]}).first() == ("s", 0, 5.0, "x", 1)
    assert readers.merged({"main": spark.range(1).toDF("a"), "event": spark.range(1).toDF("b")}).columns == ["a", "part", "b"]


def test_validation(spark):
    pairs = spark.createDataFrame([("p", "a", "b"), ("p", " a", "a "), ("", "a", "b")], "prompt string, chosen string, rejected string")
    good, bad = readers.split_valid(pairs, readers.preference_checks())
    assert good.count() == 1 and [r.reason for r in bad.collect()] == ["equal", "blank"]
    jobs = spark.createDataFrame([("s", ([1],)), ("", ([1],)), ("s", ([],))], "stage_name string, details struct<actions:array<int>>")
    assert [r.reason for r in readers.split_valid(jobs, readers.job_checks())[1].collect()] == ["no stage", "no actions"]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "甲", "k"), (2, "a/b:c", "k")], "id long, title string, category string")
    assert writers.write_jsonl(rows, str(tmp_path / "out")) == 2 and spark.read.json(str(tmp_path / "out")).count() == 2
    base = str(tmp_path / "table")
    for _ in range(2):
        writers.upsert(spark, base, rows)
    writers.upsert(spark, base, spark.createDataFrame([(2, "new", "k")], "id long, title string, category string"))
    assert {r.id: r.title for r in writers.read_table(spark, base).collect()} == {1: "甲", 2: "new"}
    writers.upsert(spark, base, rows.limit(1), reset=True)
    assert writers.read_table(spark, base).count() == 1 and writers.read_table(spark, base + "-no") is None
    writers.write_entities(rows, str(tmp_path / "entities"))
    assert {r.safe_name for r in spark.read.parquet(str(tmp_path / "entities")).collect()} == {"甲", "a_b_c"}
    assert writers.not_done(rows, rows.filter("id = 1"), "id").first().id == 2 and writers.not_done(rows, None, "id").count() == 2
    report = writers.run_report(spark.createDataFrame([("a", "done"), ("b", "failed"), ("c", "done")], "k string, status string"), "k")
    assert {r.status: (r.n, r["items"]) for r in report.collect()} == {"done": (2, "a,c"), "failed": (1, "b")}
    ids = spark.createDataFrame([("a b/c",), ("--",), ("_x-",)], "r string").select(writers.episode_id(F.col("r")).alias("i")).collect()
    assert [r.i for r in ids] == ["a-b-c", "episode", "x"]


HTML = """<html><head><title>3-8 黄昏</title><script>var operator = {"name": "芬", "star": 2, "class": "先锋", 'x': 1,};</script></head><body>
<div class="mw-heading"><h2 id="特性">特性</h2></div><table><tr><th>分支</th><th>条件</th></tr><tr><td>猎手</td><td>精英阶段0</td></tr><tr><td>精英阶段1</td><td>甲</td></tr><tr><td>精英阶段2</td><td>乙</td></tr><tr><td>分支信息</td></tr><tr><td>说明</td></tr></table>
<div class="mw-heading"><h2 id="获得方式">获得方式</h2></div><table><tr><th>获得</th><td>寻访</td></tr></table>
<div class="mw-heading"><h2 id="属性">属性</h2></div><table class="char-extra-attr-table"><tr><th>再部署时间</th><td>70</td></tr></table><table class="wikitable char-base-attr-table"><tr><th></th><th>初始</th><th>满级</th></tr><tr><td>攻击</td><td> 10 </td><td>2 0</td></tr><tr><td></td></tr></table>
<div class="mw-heading"><h2 id="技能">技能</h2></div><table class="nomobile"><tr><td></td><td>冲锋</td><td>自动</td></tr><tr><th>等级</th><th>描述</th><th>初始</th></tr><tr><td>1</td><td>快</td><td>0</td><td>5</td><td>10</td></tr></table>
<div><h2 id="级别1">级别1</h2></div><table class="wikitable"><tr><th>名称</th><th>地位<br>战斗中所使用的数据</th></tr><tr><td>碎骨</td><td>精英</td></tr><tr><th>防御力（基础）</th><td>500</td><th>生命自回速度</th><td>0</td></tr><tr><th>重量</th><td>3</td><th>未知项</th><td>x</td></tr><tr><td>尾<i>硬</i><i> 快 </i></td></tr></table>
<div><h2 id="级别2">级别2</h2></div><table class="enemy-info-level"><tr><th>防御力</th><td>600</td><th>天赋</th><td>硬；快</td></tr></table>
<div><h2 id="敌人">敌人</h2></div><table class="navbox"><tr><td>nav</td></tr></table><table><tr><th>图</th></tr><tr><th>名称</th><th>数量</th></tr><tr><td>碎骨</td><td>2</td></tr><tr><td>短</td></tr></table></body></html>"""
PLAIN = '<h2 id="特性">特性</h2><table><tr><th>分支</th><th>描述</th></tr><tr><td>速射手</td><td>优先攻击空中单位</td></tr></table>'


def test_page_tables(spark):
    pages = spark.createDataFrame([(1, HTML), (2, None), (3, PLAIN)], "page_id long, html string")
    rows = extract.rows_of(extract.cells(pages)).cache()
    assert rows.filter("section = '属性'").count() == 3
    op = {r.page_id: r for r in extract.operator_records(pages, rows).collect()}
    assert op[1].trait == {"分支": "猎手", "描述": "精英阶段1：甲；精英阶段2：乙", "分支信息": "说明"} and op[3].trait == {"分支": "速射手", "描述": "优先攻击空中单位"}
    assert op[1].obtain == {"获得": "寻访"} and op[1].extra_attrs == {"再部署时间": "70"} and op[2].skills is None
    assert op[1].stages == ["初始", "满级"] and op[1].rows == {"攻击": ["10", "2 0"]}
    assert [(k.name, k.type, [tuple(v) for v in k.levels]) for k in op[1].skills] == [("冲锋", "自动", [("1", "快", "0", "5", "10")])]
    level = {r.level: r for r in extract.enemy_levels(rows).collect()}
    assert level[1].data == {"名称": "碎骨", "地位": "精英", "防御力": "500", "生命自回速度": "0", "重量": "3", "未知项": "x"} and level[1].traits == ["硬", "快"]
    assert level[2].data == {"防御力": "600", "天赋": "硬；快"} and level[2].traits == ["硬；快"]
    assert [r.enemy for r in extract.stage_enemies(rows.filter("section = '敌人'")).collect()] == [{"名称": "碎骨", "数量": "2"}]
    assert extract.titles(pages).filter("page_id = 1").first().code == "3-8"
    assert extract.stage_cards(rows.filter("section = '敌人'")).count() == 1


def test_wide_tables_lose_nothing(spark):
    wide = "<table class='char-base-attr-table'><tr><th></th>" + "".join(f"<th>{i}</th>" for i in range(150)) + "</tr><tr><td>a</td>" + "".join(f"<td>{i}</td>" for i in range(150)) + "</tr></table>"
    deep = "<h2 id='技能'>s</h2><table class='nomobile'><tr><td>n</td><td>t</td></tr><tr><th>等级</th><th>b</th><th>c</th></tr>" + "<tr><td>1</td><td>d</td><td>0</td><td>5</td><td>9</td></tr>" * 1200 + "</table>"
    rows = extract.rows_of(extract.cells(spark.createDataFrame([(1, "<h2 id='属性'>x</h2>" + wide + deep)], "page_id long, html string")))
    g = extract.growth(rows).first()
    assert len(g.stages) == 150 and len(g.rows["a"]) == 150 and len(extract.skills(rows).first().levels) == 1200


def test_script_objects():
    assert json.loads(extract.js_object('var a = 1; var op = {"n": "it\\\'s {x}", "l": [1, 2,],};', "op")) == {"n": "it's {x}", "l": [1, 2]}
    assert extract.js_object("var op = {bad", "op") == "{}" and extract.js_object(None, "op") == "{}" and extract.js_object("var op = {a: 1};", "op") == "{}"
