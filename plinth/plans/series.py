"""Timelines, episodes and rankings: events.user_id = series or episode, events.value = reading; suppliers as operators, orders as stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.operators import episodes, ranking, timeline, video
from plinth.plans.registry import Tables, query

def seconds():
    """Seconds since the first day of the events."""
    return F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200


def readings(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("series_id"), "ts", F.col("event_id").alias("ord"), F.when(F.col("event_type") != "error", F.floor("value").cast("int")).alias("value"), F.lit(0.9).alias("confidence"))


_STABLE = """
r as (select user_id as series_id, event_id as ord, ts, case when event_type <> 'error' then floor(value)::int end as value from events),
l as (select *, last_value(value ignore nulls) over (partition by series_id order by ts, ord rows between unbounded preceding and 1 preceding) as last from r)
"""


@query(f"""
with {_STABLE}
select series_id, ord, coalesce(value, last, 0) as value, case when value is null then 'missing' when last is not null and (value < last or value - last > 10) then 'uncertain' else 'ok' end as status,
  case when value is null then 0.0 when last is not null and (value < last or value - last > 10) then 0.4 else 0.9 end::double as confidence from l
""")
def reading_stabiliser(t: Tables) -> DataFrame:
    return timeline.stabilise(readings(t)).drop("ts")


@query("""
with s as (select user_id as series_id, event_id, ts, event_type = 'purchase' as kept from events),
i as (select *, sum(kept::int) over (partition by series_id order by ts, event_id) as island from s),
k as (select series_id, event_id, case when kept then 0 else count(*) filter (where not kept) over (partition by series_id, island order by ts, event_id) end as streak from i)
select event_id, series_id, streak, streak >= 3 as flagged from k
""")
def noop_streak(t: Tables) -> DataFrame:
    steps = t.events.select("event_id", F.col("user_id").alias("series_id"), F.struct("ts", "event_id").alias("ts"), (F.col("event_type") == "purchase").cast("int").alias("kept"))
    return episodes.noop_streaks(steps).select("event_id", "series_id", "streak", "flagged")


@query("""
select min(event_id) as event_id from (select event_id, user_id, floor(epoch(ts) / 3600) as b, row_number() over (partition by user_id, floor(epoch(ts) / 3600) order by ts, event_id) as r from events) where r = 1 group by user_id, b
""")
def throttle_first(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "user_id", F.struct(seconds().alias("s"), "event_id").alias("at"), seconds().alias("s"))
    return timeline.throttle_buckets(e, "user_id", "s", 3600.0).select("event_id")


@query("""
with recursive e as (select event_id, user_id, (epoch_us(ts) / 1000000.0)::double as s, row_number() over (partition by user_id order by ts, event_id) as r from events),
walk as (
  select user_id, event_id, s from e where r = 1
  union all
  select w.user_id, n.event_id, n.s from walk w, lateral (select min((e.s, e.r, e.event_id)) as x from e where e.user_id = w.user_id and e.s >= w.s + 3600) l, lateral (select x[1] as s, x[3] as event_id) n where x is not null)
select event_id, user_id from walk
""")
def throttle_exact(t: Tables) -> DataFrame:
    """Events at least an hour after the last one let through, per user."""
    return timeline.throttle(t.events.select("event_id", "user_id", seconds().alias("s")), "user_id", "s", 3600.0).select("event_id", "user_id")


@query("""
with p as (select l_orderkey as stage_id, l_linenumber as ord, l_partkey::varchar as enemy, greatest(l_quantity::int - 25, 1) as count, l_suppkey, l_extendedprice from lineitem),
known as (select distinct stage_id from p where stage_id % 3 = 0),
g as (select stage_id, row_number() over (partition by stage_id order by ord, l_suppkey, l_extendedprice) - 1 as ord, enemy, count from p where stage_id not in (select stage_id from known))
select stage_id, ord, ord * 6.0 as expected_sec, count, 'estimated' as source from g
union all select stage_id, ord, ord * 5.0, count, 'annotated' from p where stage_id % 3 = 0
""")
def spawn_plan(t: Tables) -> DataFrame:
    return plan(t).select("stage_id", "ord", "expected_sec", "count", "source")


def plan(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("stage_id"), "l_linenumber", F.struct("l_linenumber", "l_suppkey", "l_extendedprice").alias("ord"), F.col("l_partkey").cast("string").alias("enemy"), (F.col("l_quantity").cast("int") - 25).cast("string").alias("count"))
    marked = rows.filter("stage_id % 3 = 0").select("stage_id", F.col("l_linenumber").alias("ord"), (F.col("l_linenumber") * 5.0).alias("time_sec"), "enemy", F.greatest(F.col("count").cast("int"), F.lit(1)).alias("count"))
    return timeline.spawn_plan(rows, marked)


@query("""
with p as (select l_orderkey as stage_id, l_linenumber as n, l_partkey::varchar as enemy, greatest(l_quantity::int - 25, 1) as c, l_suppkey, l_extendedprice from lineitem),
g as (
  select stage_id, enemy, c, n * 5.0 as t, 'annotated' as source from p where stage_id % 3 = 0
  union all select stage_id, enemy, c, (row_number() over (partition by stage_id order by n, l_suppkey, l_extendedprice) - 1) * 6.0, 'estimated' from p where stage_id % 3 <> 0),
conf as (select stage_id, enemy, min(t) as t from g where stage_id % 2 = 0 group by all)
select o_orderkey as state_id, g.enemy, sum(c)::bigint as count, case when any_value(conf.t) <= 12 then 'cv' else any_value(g.source) end as source
from orders join g on g.stage_id = o_orderkey and g.t <= 12 left join conf on conf.stage_id = g.stage_id and conf.enemy = g.enemy group by o_orderkey, g.enemy
""")
def spawn_presence(t: Tables) -> DataFrame:
    """Each order's stage at 12 seconds; enemies of even stages are confirmed when first expected."""
    p = plan(t)
    states = t.orders.select(F.col("o_orderkey").alias("state_id"), F.col("o_orderkey").alias("stage_id"), F.lit(12.0).alias("elapsed"))
    sure = p.filter("stage_id % 2 = 0").groupBy("stage_id", "enemy").agg(F.min("expected_sec").alias("t"))
    return timeline.presence(states, p, sure)


# -- transcripts -------------------------------------------------------------------------------------------------------------------------------


@query("with v as (select o_orderkey as bv_id, o_totalprice / 1000 as d from orders) select bv_id, unnest(range(0, floor((d + 1e-6) / 5)::bigint + 1)) + 1 as index, round(unnest(range(0, floor((d + 1e-6) / 5)::bigint + 1)) * 5.0, 3) as timestamp from v")
def frame_timeline(t: Tables) -> DataFrame:
    return video.frame_timeline(t.orders.select(F.col("o_orderkey").alias("bv_id"), (F.col("o_totalprice") / 1000).alias("duration_sec")))


_ALIGN = """
seg as (select user_id, event_id as ord, epoch_us(ts) / 1e6 - 1704067200 as a, epoch_us(ts) / 1e6 - 1704067200 + value as b from events where event_type = 'view'),
pt as (select user_id, event_id as chart_id, epoch_us(ts) / 1e6 - 1704067200 as t from events where event_type = 'click')
"""


@query(f"""
with {_ALIGN},
j as (select chart_id, t, ord, (a + b) / 2 as mid, t between a and b as inside from pt left join seg using (user_id)),
r as (select *, row_number() over (partition by chart_id order by not coalesce(inside, false), abs(t - mid), ord) as r from j)
select chart_id, case when inside or abs(t - mid) <= 600 then ord else -1 end as segment, coalesce(round(t - mid, 3), 0) as delta, coalesce(inside or abs(t - mid) <= 600, false) as matched from r where r = 1
""")
def nearest_interval_align(t: Tables) -> DataFrame:
    """Clicks of a user against that user's views as intervals [ts, ts + value]."""
    at = seconds()
    segs = video.segments(t.events.filter("event_type = 'view'").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("ord"), at.alias("start"), (at + F.col("value")).alias("end"), F.col("event_id").cast("string").alias("text")))
    charts = t.events.filter("event_type = 'click'").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("chart_id"), at.alias("t"))
    return video.align(charts, segs, 600.0).select("chart_id", F.coalesce(F.col("speech").cast("long"), F.lit(-1)).alias("segment"), F.coalesce("delta", F.lit(0.0)).alias("delta"), "matched")


@query(f"""
with {_ALIGN}, j as (select chart_id, t, ord, a from pt join seg using (user_id)),
r as (select *, row_number() over (partition by chart_id order by abs(a - t), ord) as r from j)
select chart_id, ord as nearest, round(a - t, 3) as off from r where r = 1
""")
def nearest_frame(t: Tables) -> DataFrame:
    at = seconds()
    points = t.events.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("index"), at.alias("t"))
    anchors = t.events.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("anchor_id"), at.alias("t"))
    return video.nearest_point(anchors, points, "user_id", 600.0).filter("index is not null").select(F.col("anchor_id").alias("chart_id"), F.col("index").alias("nearest"), F.round(F.col("timestamp") - F.col("anchor"), 3).alias("off"))


# -- episodes ----------------------------------------------------------------------------------------------------------------------------------


def observations(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select(F.col("user_id").alias("episode_id"), (F.row_number().over(w) - 1).alias("step"), F.when(F.col("event_type") != "error", F.floor(F.col("value") / 20).cast("int")).alias("life"), F.floor("value").cast("int").alias("cost"), F.lit(99).alias("cost_limit"), F.lit(0.5).alias("dt_sec"))


_EPISODES = """
o as (select user_id as episode_id, row_number() over (partition by user_id order by ts, event_id) - 1 as step, case when event_type <> 'error' then floor(value / 20)::int end as life, floor(value)::int as cost from events),
d as (select *, greatest(last_value(life ignore nulls) over (partition by episode_id order by step rows between unbounded preceding and 1 preceding) - life, 0) as drop from o)
"""


@query(f"""
with {_EPISODES},
g as (select episode_id, coalesce(sum(drop), 0)::bigint as leaked, count(*) filter (where cost >= 99) * 0.5 as over, arg_min(life, step) filter (where life is not null) as life_start, arg_max(life, step) filter (where life is not null) as life_end from d group by episode_id)
select episode_id, case when episode_id % 2 = 0 then 'win' else 'aborted' end as outcome, round(case when episode_id % 2 = 0 then 100 else 0 end - 10.0 * leaked - over, 3)::double as total, leaked, over::double as overcost_sec, life_start, life_end from g
""")
def episode_reward(t: Tables) -> DataFrame:
    outcomes = t.events.select(F.col("user_id").alias("episode_id")).distinct().withColumn("outcome", F.when(F.col("episode_id") % 2 == 0, "win").otherwise("strange"))
    return episodes.rewards(observations(t), outcomes).select("episode_id", "outcome", "total", "leaked", "overcost_sec", "life_start", "life_end")


@query(f"with {_EPISODES}, i as (select episode_id, step, -10.0 * drop as delta from d where drop > 0 union all select episode_id, step, -0.5 from d where cost >= 99) select episode_id, step, round(sum(delta), 3)::double as reward from i group by all")
def step_rewards(t: Tables) -> DataFrame:
    return episodes.step_rewards(episodes.reward_items(observations(t)))


@query(f"with {_EPISODES} select episode_id, coalesce(arg_min(case when life <= 0 then 'defeat' when cost > 300 then 'win' else 'timeout' end, step) filter (where life <= 0 or cost > 300 or step >= 40), 'aborted') as outcome from o group by episode_id")
def outcome_verdict(t: Tables) -> DataFrame:
    return episodes.terminations(observations(t).withColumn("cleared", F.col("cost") > 300), 40)


@query("select event_type as stage, count(*) as n, round(avg(value), 3) as mean, round(quantile_cont(value, 0.5), 3) as p50, round(quantile_cont(value, 0.95), 3) as p95, round(quantile_cont(value, 0.99), 3) as p99, min(value) as shortest, max(value) as longest from events group by 1")
def latency_summary(t: Tables) -> DataFrame:
    return episodes.latency_summary(t.events, "event_type", "value").withColumnRenamed("event_type", "stage")


@query("select event_type as stage, count(*) as n, round(avg(value), 3) as mean, round(quantile_cont(value, 0.5), 3) as p50, round(quantile_cont(value, 0.95), 3) as p95, round(quantile_cont(value, 0.99), 3) as p99, min(value) as shortest, max(value) as longest from events group by 1")
def latency_quantiles(t: Tables) -> DataFrame:
    """The same summary without a group's values in one buffer."""
    return episodes.latency_quantiles(t.events, "event_type", "value").withColumnRenamed("event_type", "stage")


@query("select user_id as id, event_type as stage, round(sum(value), 2) as ms, round(sum(value) / sum(sum(value)) over (partition by user_id), 4) as share from events group by user_id, event_type")
def latency_shares(t: Tables) -> DataFrame:
    rows = t.events.groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("stage")).agg(F.sum("value").alias("ms")).withColumn("step", F.lit(0))
    return episodes.latency_shares(rows).select("id", "stage", F.round("ms", 2).alias("ms"), "share")


@query("select user_id as id, count(*) as total, count(*) filter (where event_type <> 'error') as succeeded, count(*) filter (where event_type = 'error') as failed, case when count(*) filter (where event_type = 'error') = 0 then 'good' when count(*) filter (where event_type <> 'error') = 0 then 'bad' else 'risky' end as verdict from events group by 1")
def action_verdicts(t: Tables) -> DataFrame:
    return episodes.verdicts(t.events.select(F.col("user_id").alias("id"), (F.col("event_type") != "error").alias("ok")))


@query("select user_id as id, count(*) as step_count, min(event_id) as first_event from events group by 1")
def episode_list(t: Tables) -> DataFrame:
    """Episodes made of events, listed with the number of their steps."""
    e = t.events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("steps"))
    logs = e.select(F.col("user_id").alias("id"), F.lit("s").alias("stage_id"), F.lit("win").alias("outcome"), F.lit("log").alias("backend"), F.lit(1.0).alias("duration_sec"), F.lit(None).cast("struct<total:double>").alias("reward"), "steps")
    first = episodes.steps(logs).filter("pos = 0").select("id", F.col("event_id").alias("first_event"))
    return episodes.listing(logs).join(first, "id").select("id", "step_count", "first_event")


@query()
def plan_feasibility(t: Tables) -> DataFrame:
    """Each order as a plan: its lines deploy their parts."""
    a = F.struct(F.col("l_linenumber").alias("o"), F.struct(F.when(F.col("l_returnflag") == "R", "retreat").otherwise("deploy").alias("action"), (F.col("l_partkey") % 9).cast("string").alias("operator_id"), F.concat(F.lit("A"), (F.col("l_suppkey") % 6).cast("string")).alias("grid_pos"), F.lit(1).alias("skill_id")).alias("a"))
    g = t.lineitem.groupBy(F.col("l_orderkey").alias("plan_id")).agg(F.array_sort(F.collect_list(a)).alias("s"))
    hand = F.create_map(*[x for i in range(7) for x in (F.lit(str(i)), F.lit(i + 5))])
    p = g.select("plan_id", F.lit(20).alias("cost"), F.lit(True).alias("cost_ok"), hand.alias("hand"), F.array(F.lit("8")).alias("deployed"), F.array(*[F.lit(f"A{i}") for i in range(5)]).alias("free"), F.array().cast("array<string>").alias("ready"), F.lit(True).alias("has_enemies"), F.transform("s", lambda x: x.a).alias("actions"))
    return episodes.feasibility(p).select("plan_id", "idx", "kept", "reason")


# -- rankings ----------------------------------------------------------------------------------------------------------------------------------


def roster(t: Tables) -> DataFrame:
    n, k = F.col("s_nationkey"), F.col("s_suppkey")
    return t.supplier.select(F.col("s_name").alias("name"), F.concat(F.lit("class"), (n % 4).cast("string")).alias("profession"), (k % 3).cast("int").alias("elite"), (k * 7 % 90).cast("int").alias("level"), (k % 5 > 0).alias("owned"), F.array(F.concat(F.lit("role"), (n % 3).cast("string"))).alias("tags"), F.create_map(F.lit("m1"), (k % 12).cast("int"), F.lit("m2"), (k % 3).cast("int")).alias("materials_to_next"), (k % 2 * 2).cast("int").alias("target_elite"))


@query("""
with o as (select s_name as name, s_nationkey % 4 = 1 as prof, s_nationkey % 3 = 2 as role, s_suppkey % 3 as elite, s_suppkey * 7 % 90 as level, s_suppkey % 2 * 2 as target, greatest(s_suppkey % 12 - 5, 0) as m1, greatest(s_suppkey % 3 - 1, 0) as m2 from supplier where s_suppkey % 5 > 0),
s as (select name, m1 = 0 and m2 = 0 as materials_ready, case when prof then 30 else 0 end + case when role then 20 else 0 end
  + 30 * least(1, greatest(0, target - elite) / 2.0::double * 0.7 + case when target <> 0 then greatest(0.0, least(1.0, (60 - level) / 60.0::double)) * 0.3 else 0 end) + case when m1 = 0 and m2 = 0 then 15 else -5 end as raw from o)
select name, round(raw, 2) as score, materials_ready, row_number() over (order by round(raw, 2) desc, name) as rank from s
""")
def priority_rank(t: Tables) -> DataFrame:
    return ranking.priorities(roster(t), ["class1"], ["role2"], {"m1": 5, "m2": 1}).select("name", "score", "materials_ready", "rank")


@query("select s_name as name, concat_ws(',', case when s_suppkey % 12 > 5 then 'm1=' || (s_suppkey % 12 - 5) end, case when s_suppkey % 3 > 1 then 'm2=' || (s_suppkey % 3 - 1) end) as missing from supplier")
def material_missing(t: Tables) -> DataFrame:
    have = F.create_map(F.lit("m1"), F.lit(5), F.lit("m2"), F.lit(1))
    gap = F.map_entries(ranking.missing_materials(F.col("materials_to_next"), have))
    return roster(t).select("name", F.array_join(F.transform(F.array_sort(gap), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), ",").alias("missing"))


def stage_ledger(t: Tables) -> DataFrame:
    code = F.concat((F.col("o_orderkey") % 20 + 1).cast("string"), F.lit("-"), F.floor(F.col("o_orderkey") / 20).cast("string"))
    stages = t.orders.select(code.alias("stage_id"), F.col("o_orderpriority").alias("title"), (F.col("o_orderkey") % 3 == 0).alias("has_raid"))
    done = t.orders.filter("o_orderstatus = 'F'").select(code.alias("stage_id"), F.lit("normal").alias("kind")).unionByName(t.orders.filter("o_orderstatus = 'F' and o_orderkey % 2 = 0").select(code.alias("stage_id"), F.lit("raid").alias("kind")))
    return ranking.ledger(stages, done)


_LEDGER = """
s as (select o_orderkey % 20 + 1 as c, o_orderkey // 20 as i, o_orderkey % 3 = 0 as raid, o_orderstatus = 'F' as n, o_orderstatus = 'F' and o_orderkey % 2 = 0 as r from orders),
p as (select *, not n and coalesce(lag(n) over (order by c, i), true) as open from s),
q as (select *, sum((not n and not open)::int) over (order by c, i) as nth from p),
k as (select *, case when n then null when open then 'immediate' when nth <= 6 then 'short_term' else 'long_term' end as tier from q),
led as (
  select c || '-' || i as stage_id, 'normal' as kind, n as done, tier, false as locked from k
  union all select c || '-' || i, 'raid', r, case when r then null when n then 'immediate' when tier = 'immediate' then 'short_term' else tier end, not r and not n from k where raid)
"""


@query(f"with {_LEDGER} select * from led")
def ledger_tiers(t: Tables) -> DataFrame:
    return stage_ledger(t).drop("title")


@query(f"""
with {_LEDGER}, g as (select count(*) filter (where kind = 'normal' and done) as earned_normal, count(*) filter (where kind = 'normal' and not done) as remaining_normal, count(*) filter (where kind = 'raid' and done) as earned_raid, count(*) filter (where kind = 'raid' and not done) as remaining_raid,
  count(*) filter (where tier = 'immediate') as immediate, count(*) filter (where tier = 'short_term') as short_term, count(*) filter (where tier = 'long_term') as long_term from led)
select *, immediate + short_term as decision, 10 + remaining_normal + remaining_raid as projected, ((10 + remaining_normal + remaining_raid) * 180) // 600 as pulls, greatest(0, ceil(100 * 600 / 180.0)::bigint - (10 + remaining_normal + remaining_raid)) as gap from g
""")
def ledger_totals(t: Tables) -> DataFrame:
    return ranking.ledger_totals(stage_ledger(t), current=10, planned_pulls=100)


@query("""
with p as (select l_suppkey as metric, avg(l_extendedprice) filter (where l_linenumber <= 3) as b, avg(l_extendedprice) filter (where l_linenumber > 3) as a from lineitem group by 1)
select metric, round((a - b) / b * 100, 1) + 0.0 as change_pct, case when (a - b) / b > 0.1 then 'REGRESSION' when (a - b) / b < -0.1 then 'IMPROVED' else 'OK' end as status from p where a > 0 and b > 0
""")
def perf_regression(t: Tables) -> DataFrame:
    early = F.col("l_linenumber") <= 3
    p = t.lineitem.groupBy(F.col("l_suppkey").alias("metric")).agg(F.avg(F.when(early, F.col("l_extendedprice"))).alias("baseline_ms"), F.avg(F.when(~early, F.col("l_extendedprice"))).alias("actual_ms"))
    # Adding zero turns -0.0 into 0.0.
    return ranking.regressions(p).withColumn("change_pct", F.col("change_pct") + 0.0)
