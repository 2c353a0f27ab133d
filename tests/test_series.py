from pyspark.sql import functions as F

from plinth.operators import episodes, ranking, timeline, video


def stable(spark, values):
    rows = spark.createDataFrame([("s", i, v, 0.9) for i, v in enumerate(values)], "series_id string, ts long, value int, confidence double")
    return [(r.value, r.status, r.confidence) for r in timeline.stabilise(rows).orderBy("ts").collect()]


def test_stabiliser(spark):
    assert [s for _, s, _ in stable(spark, [15, 16])] == ["ok", "ok"]
    assert stable(spark, [16, 15])[1] == (15, "uncertain", 0.4)
    assert stable(spark, [15, 25])[1][1] == "ok" and stable(spark, [15, 26])[1][1] == "uncertain"
    assert stable(spark, [15, 100, 100])[2][1] == "ok"
    assert stable(spark, [None, 15]) == [(0, "missing", 0.0), (15, "ok", 0.9)]


def test_spawn_plan_and_presence(spark):
    foes = spark.createDataFrame([("a", 0, "X", ""), ("a", 1, "Y", "3"), ("b", 0, "X", "1")], "stage_id string, ord int, enemy string, count string")
    notes = spark.createDataFrame([("b", 0, 5.0, "X", 2), ("b", 1, 40.0, "X", 1)], "stage_id string, ord int, time_sec double, enemy string, count int")
    plan = timeline.spawn_plan(foes, notes)
    assert sorted((r.stage_id, r.expected_sec, r["count"], r.source) for r in plan.collect()) == [("a", 0.0, 1, "estimated"), ("a", 6.0, 3, "estimated"), ("b", 5.0, 2, "annotated"), ("b", 40.0, 1, "annotated")]
    states = spark.createDataFrame([(1, "a", 3.0), (2, "b", 50.0), (3, "b", 1.0)], "state_id long, stage_id string, elapsed double")
    sure = spark.createDataFrame([("b", "X", 10.0)], "stage_id string, enemy string, t double")
    assert sorted((r.state_id, r.enemy, r["count"], r.source) for r in timeline.presence(states, plan, sure).collect()) == [(1, "X", 1, "estimated"), (2, "X", 3, "cv")]


def test_numbers_detections_throttle_evidence(spark):
    items = spark.createDataFrame([(1, [("a1", 0.5), ("b22", 0.9), ("33", 0.9), ("x", 1.0)]), (2, [])], "frame_id long, items array<struct<text:string,score:double>>")
    assert {r.frame_id: (r.number, r.score) for r in timeline.best_number(items).collect()} == {1: (22, 0.9), 2: (None, 0.0)}
    d = spark.createDataFrame([(1, "a", 0.2), (1, "a", 0.35), (1, "b", 0.1)], "frame_id long, label string, confidence double")
    assert {r.label: r.confirmed for r in timeline.confirmed(d).collect()} == {"a": True, "b": False}
    e = spark.createDataFrame([("k", t) for t in (0.0, 1.0, 1.9, 2.5, 4.4, 4.6)], "k string, t double")
    assert [r.t for r in timeline.throttle(e, "k", "t").orderBy("t").collect()] == [0.0, 2.5, 4.6]
    assert sorted(r.t for r in timeline.throttle_buckets(e, "k", "t").collect()) == [0.0, 2.5, 4.4]
    refs = spark.createDataFrame([(1, 0, "inferred", "x"), (1, 1, "fact", "y"), (1, 2, "fact", "y"), (1, 3, "fact", "a")], "state_id long, ord int, bucket string, ref string")
    assert timeline.evidence_lines(refs).first().line == "fact: y、a\ninferred: x"


def test_alignment(spark):
    def one(segs, t, tolerance=8.0):
        s = spark.createDataFrame([("v", i, str(a), str(b), f"s{i}") for i, (a, b) in enumerate(segs)], "video_id string, ord long, start string, end string, text string")
        c = spark.createDataFrame([("v", 1, t)], "video_id string, chart_id long, t double")
        r = video.align(c, video.segments(s), tolerance).first()
        return r.speech, r.delta, r.matched

    assert one([(8, 16)], 12.0) == ("s0", 0.0, True)
    assert one([(0, 5), (20, 25)], 18.0, 5.0) == ("s1", -4.5, True)
    assert one([(0, 4)], 100.0) == (None, 98.0, False)
    assert one([], 1.0) == (None, None, False)
    assert one([(16, 8), (0, 40)], 12.0) == ("s0", 0.0, True)
    assert one([("x", 3), (0, 2)], 1.5) == ("s1", 0.5, True)


def test_video_tables(spark):
    kinds = [("second", ["Beta", "二"]), ("first", ["Alpha"])]
    v = spark.createDataFrame([("alpha and beta", []), ("x", ["ALPHA"]), (None, None)], "title string, tags array<string>")
    got = video.categorise(v, kinds).collect()
    assert [(r.category, r.keyword) for r in got] == [("second", "Beta"), ("first", "Alpha"), ("other", "")]
    ok, no = video.partition_allowed(video.categorise(v, kinds), ["first"])
    assert (ok.count(), no.count()) == (1, 2)
    ids = spark.createDataFrame([("https://x/BV1234567890?p",), (" z ",)], "u string").select(video.video_id(F.col("u")).alias("i")).collect()
    assert [r.i for r in ids] == ["BV1234567890", "z"]
    frames = video.frame_timeline(spark.createDataFrame([("v", 10.0)], "bv_id string, duration_sec double"), 5.0).collect()
    assert [(r["index"], r.timestamp) for r in frames] == [(1, 0.0), (2, 5.0), (3, 10.0)]
    near = spark.createDataFrame([(7.5, 9), (7.6, 9), (99.0, 3)], "anchor double, n_frames int").select(video.nearest_frame(None, 5.0).alias("i")).collect()
    assert [r.i for r in near] == [2, 3, 3]
    raw = [("v", 5.0, '```json\n{"chart_type": "table", "operator": "A", "confidence": 0.9}\n```'), ("v", 6.0, '{"chart_type": "table", "operator": "主角干员名", "confidence": 0.9}'), ("v", 6.5, '{"chart_type": "table", "operator": "A", "data": {"title": "示例标题"}, "confidence": 0.9}'), ("v", 0.0, '{"chart_type": "table", "confidence": 0.9}'), ("v", 7.0, "no json")]
    got = video.read_charts(spark.createDataFrame(raw, "video_id string, timestamp_sec double, raw string")).collect()
    assert [(r.chart_type, r.kept) for r in got] == [("table", True), ("unknown", False), ("unknown", False), ("table", False), ("unknown", False)] and got[4].raw == "no json"
    p = spark.createDataFrame([("v", 65.0, "table", "A", [{"a": "1"}], None, "hi", True), ("v", 0.0, "tier_list", "A", None, {"T1": ["x"], "T0": ["y", "z"]}, None, False)], "video_id string, t double, chart_type string, operator string, rows array<map<string,string>>, tiers map<string,array<string>>, speech string, matched boolean")
    got = video.records(p, spark.createDataFrame([("v", "T", "U")], "bv_id string, title string, uploader string")).orderBy("t").collect()
    assert got[0].answer == "T0：y、z\nT1：x\n" + video.UNMATCHED and "01:05" in got[1].question and got[1].answer == "a=1\nhi"


def test_rewards(spark):
    schema = "episode_id string, step int, life int, cost int, cost_limit int, dt_sec double"
    rows = [("w", 0, 3, 0, 99, 1.0), ("d", 0, 3, 0, 99, 1.0), ("d", 1, 2, 0, 99, 1.0), ("d", 2, None, 0, 99, 1.0), ("d", 3, 0, 0, 99, 1.0), ("c", 0, 3, 99, 99, 2.0), ("h", 0, 3, 99, 99, 0.5), ("b", 0, 3, 98, 99, 2.0)]
    obs = spark.createDataFrame(rows, schema)
    ends = spark.createDataFrame([("w", "win"), ("d", "defeat"), ("c", "odd"), ("h", "timeout"), ("b", "timeout")], "episode_id string, outcome string")
    got = {r.episode_id: r for r in episodes.rewards(obs, ends).collect()}
    assert (got["w"].total, got["w"].life_end) == (100.0, 3) and (got["d"].total, got["d"].leaked, got["d"].life_start, got["d"].life_end) == (-30.0, 3, 3, 0)
    assert (got["c"].total, got["c"].outcome) == (-2.0, "aborted") and got["h"].total == -0.5 and got["b"].total == 0.0
    own = episodes.rewards(obs, ends, {"win": 50.0, "leak": 20.0, "overcost": 3.0}).filter("episode_id = 'd'").first()
    assert own.total == -60.0
    items = episodes.reward_items(obs)
    assert sorted((r.episode_id, r.step, r.name, r.delta) for r in items.collect()) == [("c", 0, "overcost", -2.0), ("d", 1, "leak", -10.0), ("d", 3, "leak", -20.0), ("h", 0, "overcost", -0.5)]
    assert episodes.step_rewards(items).count() == 4
    t = obs.withColumn("cleared", F.col("episode_id") == "w")
    assert {r.episode_id: r.outcome for r in episodes.terminations(t, 9).collect()} == {"w": "win", "d": "defeat", "c": "aborted", "h": "aborted", "b": "aborted"}


def test_logs(spark):
    logs = spark.sql("select 'e' id, 's' stage_id, 'win' outcome, 'mock' backend, 1.5D duration_sec, cast(null as struct<total:double>) reward, array(named_struct('step', 0, 'cost', 5, 'life', 3, 'latency_ms', map('think', 3D, 'act', 1D)), named_struct('step', 1, 'cost', 7, 'life', 3, 'latency_ms', map('think', 1D))) steps")
    assert episodes.listing(logs).first()[4:] == (2, 1.5, None) and "steps" not in episodes.summary(logs).columns and "steps" in episodes.summary(logs, True).columns
    rows = episodes.steps(logs)
    lat = episodes.long_latencies(rows)
    assert {(r.step, r.stage): r.ms for r in lat.collect()}[(0, "total")] == 4.0
    assert {(r.step, r.stage): r.share for r in episodes.latency_shares(lat).collect()}[(0, "think")] == 0.75
    s = episodes.latency_summary(lat).filter("stage = 'think'").first()
    assert (s.n, s["mean"], s.p50, s.p95) == (2, 2.0, 2.0, 2.9)
    assert [(r.cost_before, r.cost_after) for r in episodes.trend(rows).orderBy("step").collect()] == [(None, 5), (5, 7)]
    acts = spark.createDataFrame([("a", True), ("b", True), ("b", False), ("c", False)], "id string, ok boolean")
    assert {r.id: r.verdict for r in episodes.verdicts(acts).collect()} == {"a": "good", "b": "risky", "c": "bad"}


def test_plans(spark):
    schema = "plan_id int, cost int, cost_ok boolean, hand map<string,int>, deployed array<string>, free array<string>, ready array<string>, has_enemies boolean, actions array<struct<action:string,operator_id:string,grid_pos:string,skill_id:int>>"
    acts = [("deploy", "a", "A1", None), ("deploy", "b", "A1", None), ("deploy", "b", "A2", None), ("deploy", "z", "A3", None), ("deploy", "a", "A3", None), ("skill", "f", None, 1), ("skill", "f", None, 2), ("retreat", "q", None, None), ("wait", None, None, None), ("deploy", "c", "A9", None)]
    p = spark.createDataFrame([(1, 12, True, {"a": 10, "b": 5, "c": 1}, ["f"], ["A1", "A2", "A3"], ["f#1"], True, acts)], schema)
    got = episodes.feasibility(p).orderBy("idx").collect()
    assert [r.reason for r in got] == ["", "cell taken by plan", "cost short", "not in hand", "already deployed", "", "skill not ready", "not on field", "", "cell not free"]
    kept = spark.createDataFrame([(1, 0, "wait", None, None), (1, 1, "deploy", "y", "医疗"), (1, 2, "deploy", "x", "先锋"), (1, 3, "deploy", "w", "?"), (1, 4, "deploy", "v", "近卫"), (1, 5, "deploy", "u", "重装")], "plan_id int, idx int, action string, operator_id string, class string")
    assert [r.operator_id for r in episodes.deploy_order(kept).orderBy("pos").collect()] == ["v", "x", "u", "w", "y", None]
    s = spark.createDataFrame([("s", i, k) for i, k in enumerate([0, 0, 0, 2, 0])], "series_id string, ts int, kept int")
    assert [(r.streak, r.flagged, r.confidence) for r in episodes.noop_streaks(s).orderBy("ts").collect()] == [(1, False, 0.35), (2, False, 0.35), (3, True, 0.2), (0, False, 0.9), (1, False, 0.35)]
    a = spark.createDataFrame([("deploy", "a", "a3", None, None), ("deploy", "", "33", 1, None), ("skill", "a", None, 4, None), ("wait", None, None, None, 70000), ("retreat", "a", "A1", None, None), ("fly", None, None, None, None)], "action string, operator_id string, grid_pos string, skill_id int, duration_ms int")
    assert [r.problems for r in episodes.action_problems(a).collect()] == [[], ["no operator", "bad cell", "skill not allowed"], ["bad skill"], ["bad duration"], ["cell not allowed"], ["unknown action"]]


def ledger(spark, n, raids, normal=(), raid=(), window=6):
    stages = spark.createDataFrame([(f"1-{i}", f"t{i}", i in raids) for i in range(1, n + 1)], "stage_id string, title string, has_raid boolean")
    done = spark.createDataFrame([(s, "normal") for s in normal] + [(s, "raid") for s in raid] + [("9-9", "normal")], "stage_id string, kind string")
    rows = ranking.ledger(stages, done, window)
    return rows, ranking.ledger_totals(rows, current=0).first()


def test_ledger(spark):
    rows, t = ledger(spark, 3, {1, 2})
    assert (t.remaining_normal, t.remaining_raid, t.immediate, t.short_term, t.long_term) == (3, 2, 1, 4, 0)
    rows, t = ledger(spark, 10, set())
    assert (t.immediate, t.short_term, t.long_term) == (1, 6, 3)
    rows, t = ledger(spark, 10, set(), window=0)
    assert (t.immediate, t.short_term, t.long_term) == (1, 0, 9)
    rows, t = ledger(spark, 3, {1, 2}, ["1-1", "1-2"], ["1-1"])
    assert (t.remaining_normal, t.remaining_raid, t.immediate, t.decision, t.projected) == (1, 1, 2, 2, 2) and t.immediate + t.short_term + t.long_term == t.remaining_normal + t.remaining_raid
    assert [r.stage_id for r in ranking.next_stages(rows).collect()] == ["1-2", "1-3"]
    codes = spark.createDataFrame([("10-1",), ("2-9",), ("x",), ("1-12",)], "c string").orderBy(*ranking.main_order(F.col("c"))).collect()
    assert [r.c for r in codes] == ["1-12", "2-9", "10-1", "x"]


def test_priorities(spark):
    rows = [("a", "先锋", 1, 30, True, ["输出"], {"m": 9}, 2), ("b", "狙击", 2, 80, True, [], {}, 2), ("c", "先锋", 0, 1, False, [], {}, 2), ("d", "狙击", 2, 80, True, [], {"m": 5}, 2)]
    ops = spark.createDataFrame(rows, "name string, profession string, elite int, level int, owned boolean, tags array<string>, materials_to_next map<string,int>, target_elite int")
    tiers = spark.createDataFrame([("b", "t0", None)], "name string, tier string, score double")
    got = {r["name"]: r for r in ranking.priorities(ops, ["先锋"], ["输出"], {"m": 5}, tiers).collect()}
    assert got["a"].score == 30 + 20 + 30 * (0.35 + 0.15) - 5 and got["a"].materials_missing == {"m": 4} and got["a"]["rank"] == 1
    assert got["b"].score == 40.0 and got["d"].score == 15.0 and got["d"].materials_ready and "c" not in got
    assert [r["name"] for r in ranking.unowned_relevant(ops, ["先锋"], []).collect()] == ["c"]
    perf = spark.createDataFrame([("x", 10.0, 12.0), ("y", 10.0, 8.0), ("z", 10.0, 10.5), ("n", 10.0, 0.0), ("m", 10.0, None)], "metric string, baseline_ms double, actual_ms double")
    assert {r.metric: (r.change_pct, r.status) for r in ranking.regressions(perf).collect()} == {"x": (20.0, "REGRESSION"), "y": (-20.0, "IMPROVED"), "z": (5.0, "OK")}
