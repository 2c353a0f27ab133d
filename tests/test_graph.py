from plinth.operators import audit, graph, lookup

ENEMY = "page string, display string, defense double, resistance double, speed double, desc string, traits string"


def rules(spark):
    rows = [("重装", "重装", 900.0, 10.0, 1.0, "", ""), ("法师", "法师", 100.0, 60.0, None, "", ""), ("犬", "犬", None, None, None, "", "高速移动"), ("空", "空", None, None, None, None, None)]
    return spark.createDataFrame(rows, ENEMY)


def test_rules_and_counters(spark):
    got = {(r.page, r.rule[:2]) for r in graph.enemy_rules(rules(spark)).collect()}
    assert got == {("重装", "R1"), ("法师", "R2"), ("犬", "R3")}
    sig = spark.createDataFrame([("术", True, False, True, False), ("狙", False, True, False, True), ("辅", False, False, True, True)], "name string, is_caster boolean, is_physical_dps boolean, has_arts_or_true boolean, has_control boolean")
    got = {(r.page, r["name"]): (r.basis, r.weight) for r in graph.counters(graph.enemy_rules(rules(spark)), sig).collect()}
    assert got == {("重装", "术"): ("class", 1.0), ("重装", "辅"): ("skill_keyword", 0.6), ("法师", "狙"): ("class", 1.0), ("犬", "狙"): ("skill_keyword", 0.6), ("犬", "辅"): ("skill_keyword", 0.6)}


def test_graph_queries(spark):
    sig = spark.createDataFrame([("术", "术师", 5), ("狙", "狙击", 4)], "name string, class string, star int")
    skills = spark.createDataFrame([("术", "火球")], "name string, skill string")
    foes = spark.createDataFrame([("重装", "重装", 500.0, 0.0, 1.0, "", ""), ("轻", "轻", 100.0, 0.0, 1.0, "", "")], ENEMY)
    stages = spark.createDataFrame([("3-8", "3-8 黄昏")], "code string, title string")
    rows = spark.createDataFrame([("3-8", 1, "重装", 2, "1"), ("3-8", 2, "重装", 9, "2"), ("3-8", 3, "轻", 1, "1")], "stage string, ord int, enemy string, count int, level string")
    con = graph.contains_edges(rows)
    cou = spark.createDataFrame([("重装", "R1", "术", "class", 1.0, ""), ("重装", "R3", "术", "k", 0.6, ""), ("轻", "R2", "狙", "class", 1.0, ""), ("轻", "R2", "术", "class", 0.6, "")], "page string, rule string, name string, basis string, weight double, reason string")
    rec = graph.recommendations(con, cou)
    top = {r["name"]: r for r in rec.collect()}
    assert top["术"].score == 1.6 and top["术"].support == 2 and top["术"].matched_rules == "R1、R2、R3"
    nodes, edges = graph.node_table(sig, skills, foes, stages), graph.edge_table(skills, con, cou, rec)
    assert graph.skills_of_operator(nodes, edges, "术").first().skill == "火球"
    assert {r.enemy: r["count"] for r in graph.enemies_in_stage(nodes, edges, "3-8").collect()} == {"重装": "2", "轻": "1"}
    assert [r.operator for r in graph.operators_for_stage(nodes, edges, "3-8").orderBy("rank").collect()] == ["术", "狙"]
    heavy = graph.counter_heavy(nodes, edges, 300).collect()
    assert [(r.operator, r.score, r.enemies) for r in heavy] == [("术", 1.6, "重装")]
    assert graph.operators_countering(nodes, edges, "重装").count() == 2 and graph.enemies_countered_by(nodes, edges, "狙").count() == 1
    assert graph.neighbours(nodes, edges, "operator:nobody").count() == 0
    assert {(r.what, r.kind): r.n for r in graph.graph_stats(nodes, edges).collect()}[("node", None)] == 6
    detail = graph.node_detail(edges, cap=1).filter("node_id = 'operator:术'").collect()
    assert len(detail) == 1 and detail[0].truncated
    dup = edges.selectExpr("src", "dst", "key", "1 as ord").unionByName(edges.selectExpr("src", "dst", "key", "2 as ord"))
    assert graph.first_edges(dup).count() == edges.count()
    assert graph.focus_subgraph(con, cou, sig.select("name", "star"), 1).count() == 2
    assert graph.stage_subgraph(edges, cap=1).filter("relation = 'RECOMMENDS'").first().truncated


def test_signals_and_records(spark):
    pages = spark.sql("select '甲' source, named_struct('class', '术师', 'branch', 'b', 'star_rating', 5, 'tag', '输出') meta, array(named_struct('type', '自动', 'levels', array(named_struct('desc', '造成眩晕')))) skills")
    s = graph.operator_signals(pages).first()
    assert s.is_caster and s.has_control and not s.has_arts_or_true and not s.is_physical_dps
    foe = spark.sql("select 'X(形态)' source, 'X' name, array(named_struct('level', 0, 'data', map('防御力', '1'), 'traits', array('t')), named_struct('level', 1, 'data', map('名称', 'X', '防御力', ' 800 ', '法术抗性', '—'), 'traits', array('t'))) levels")
    e = graph.enemy_records(foe).first()
    assert (e.page, e.display, e.defense, e.resistance) == ("X(形态)", "X", 800.0, None)


def test_names(spark):
    pages = spark.createDataFrame([("X(甲)", "X", 0), ("X(乙丙)", "X", 1), ("Y", "Y", 2), ("Y(z)", "Y", 3)], "page string, display string, ord int")
    asked = spark.createDataFrame([("X",), ("Y",), ("Q",), ("Y(z)",)], "display string")
    assert {r.display: r.page for r in graph.resolve_names(asked, pages).collect()} == {"X": "X(甲)", "Y": "Y", "Q": "Q", "Y(z)": "Y(z)"}
    stages = spark.createDataFrame([(0, "1-1", "1-1 开局"), (1, "3-8", "3-8 黄昏"), (2, "3-8", "3-8 再")], "ord int, code string, title string")
    req = spark.createDataFrame([(1, " 3-8 "), (2, "1-1 开局"), (3, "9-9")], "req_id long, name string")
    assert {r.req_id: (r.title, r.found) for r in lookup.resolve_stage(req, stages).collect()} == {1: ("3-8 再", True), 2: ("1-1 开局", True), 3: (None, False)}
    light = graph.light_records(spark.createDataFrame([(0, "新", "3", "x"), (1, "新", "4", "5"), (2, "Y", "1", "1")], "ord int, enemy string, defense string, resistance string"), pages)
    assert [(r.page, r.defense, r.resistance) for r in light.collect()] == [("新", 3.0, None)]


def test_lookups(spark):
    ranked = spark.createDataFrame([("s", "a", "c1", 5, 2.0, 1), ("s", "b", "c1", -1, 1.0, 2), ("s", "c", "c2", 6, 0.5, 3)], "stage string, operator string, class string, star int, score double, rank long")
    req = spark.createDataFrame([(1, "s", ["c1"], 4, None, 8, []), (2, "s", [], None, None, 1, ["a"]), (3, "t", [], None, None, 1, [])], "req_id long, stage string, classes array<string>, min_star int, max_star int, top_n int, exclude array<string>")
    assert sorted((r.req_id, r.operator) for r in lookup.recommend(ranked, req).collect()) == [(1, "a"), (2, "b")]
    bad = lookup.out_of_bounds(spark.createDataFrame([(0, 3), (21, 7), (5, 1)], "k int, min_star int")).collect()
    assert [r.problems for r in bad] == [["k"], ["k", "min_star"], []]
    skills = spark.createDataFrame([("p", 0, "过载模式"), ("p", 1, "模式")], "page string, ord int, skill string")
    ask = spark.createDataFrame([(1, "p", "模式"), (2, "p", "过载"), (3, "p", "无"), (4, "q", "x")], "req_id long, page string, skill_name string")
    got = {r.req_id: r for r in lookup.skill_lookup(ask, skills).collect()}
    assert (got[1].skill, got[2].skill, got[3].found, got[3].message) == ("模式", "过载模式", False, "available: 过载模式、模式") and not got[4].found
    foes = spark.sql("select 'E' page, 'E' display, array(named_struct('level', 0, 'data', map('防御力', '1', '空', '')), named_struct('level', 1, 'data', map('防御力', '2'))) levels")
    ask = spark.createDataFrame([(1, "E", 1), (2, "E", None), (3, "E", 7), (4, "F", None)], "req_id long, name string, level int")
    got = lookup.enemy_lookup(ask, foes, ["防御力", "空"]).collect()
    assert sorted((r.req_id, r.level) for r in got if r.found) == [(1, 1), (2, 0), (2, 1)] and {r.req_id: r.message for r in got}[3] == "levels: 0、1"


def test_bundle(spark):
    states = spark.createDataFrame([(1, "s", [("碎骨", 3), ("士兵", 5)], [("翎羽", 2), ("克洛丝", 3)]), (2, " ", [], [])], "state_id long, stage_id string, enemies array<struct<name:string,observed_count:int>>, cards array<struct<name:string,cost:int>>")
    hits = spark.createDataFrame([(1, "g" * 200, 0)], "state_id long, content string, rank int")
    foes = spark.createDataFrame([("s", "碎骨")], "stage string, enemy string")
    ranked = spark.createDataFrame([("s", "术", 1.6, 1), ("s", "狙", 1.0, 9)], "stage string, operator string, score double, rank long")
    facts = spark.createDataFrame([("碎骨", "硬"), ("士兵", "软"), ("翎羽", "快")], "name string, text string")
    got = {r.state_id: r for r in lookup.context_bundle(states, hits, foes, ranked, facts, facts).collect()}
    assert [c.split("|")[1] for c in got[1].citations] == ["guide", "s", "术", "士兵", "碎骨", "翎羽"] and {c.split("|")[2] for c in got[1].citations} == {"retrieved", "fact", "inferred"}
    assert got[2].text == "" and got[2].citations == []


def test_audits(spark):
    pages = spark.createDataFrame([("a", "", None, [("",)], {}), ("b", "b", (3,), [("s",)], {"k": "v"})], "source string, name string, meta struct<star:int>, skills array<struct<name:string>>, trait map<string,string>")
    got = {r.issue: r.n for r in audit.issue_counts(audit.issues(pages, "source", audit.operator_checks())).collect()}
    assert got == {"no_name": 1, "no_meta": 1, "skill_without_name": 1, "no_trait": 1, "title_differs": 1}
    total = audit.summarise({"operator": audit.issue_counts(audit.issues(pages, "source", audit.operator_checks()))}).filter("kind is null").first()
    assert total.issues == 5
