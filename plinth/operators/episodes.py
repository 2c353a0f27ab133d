"""Episode logs: listings, rewards, terminations, latencies, verdicts and feasibility audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.ordering import exact_quantiles

REWARD = {"win": 100.0, "leak": 10.0, "overcost": 1.0}
OUTCOMES = ["win", "defeat", "timeout", "aborted"]
LATENCIES = ["perceive", "knowledge", "think", "plan", "act", "log"]
#: The order in which classes are deployed, and that of any other class.
DEPLOY_ORDER, DEPLOY_OTHERS = {"先锋": 0, "近卫": 0, "重装": 1, "狙击": 1, "术师": 1, "医疗": 2, "辅助": 2, "特种": 2}, 1
CELL = r"^[A-Z]{1,2}[0-9]{1,2}$"


def listing(episodes: DataFrame) -> DataFrame:
    """id, stage_id, outcome, backend, step_count, duration_sec, total_reward (null where absent), by id. Reads no step beyond its count."""
    return episodes.select("id", "stage_id", "outcome", "backend", F.coalesce(F.size("steps"), F.lit(0)).cast("long").alias("step_count"), "duration_sec", F.col("reward.total").alias("total_reward"))


def summary(episodes: DataFrame, embed_steps: bool = False) -> DataFrame:
    return episodes if embed_steps else episodes.drop("steps")


def steps(episodes: DataFrame) -> DataFrame:
    return episodes.select("id", F.posexplode("steps").alias("pos", "s")).select("id", "pos", "s.*")


def reward_items(observations: DataFrame, config: dict[str, float] = REWARD) -> DataFrame:
    """episode_id, step, name (leak or overcost), delta: leaks for drops of life between consecutive known readings, overcost for time at the cost limit. observations: episode_id, step, life, cost, cost_limit, dt_sec."""
    last = F.last("life", True).over(Window.partitionBy("episode_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    o = observations.withColumn("drop", F.greatest(last - F.col("life"), F.lit(0))).withColumn("over", F.when((F.col("dt_sec") > 0) & (F.col("cost") >= F.col("cost_limit")), F.col("dt_sec")))
    item = F.explode(F.array_compact(F.array(F.when(F.col("drop") > 0, F.struct(F.lit("leak").alias("name"), (-config["leak"] * F.col("drop")).alias("delta"))), F.when(F.col("over") > 0, F.struct(F.lit("overcost").alias("name"), (-config["overcost"] * F.col("over")).alias("delta"))))))
    return o.select("episode_id", "step", item.alias("i")).select("episode_id", "step", "i.name", F.round("i.delta", 3).alias("delta"))


def rewards(observations: DataFrame, outcomes: DataFrame, config: dict[str, float] = REWARD) -> DataFrame:
    """episode_id, outcome, win_bonus, leak_penalty, overcost_penalty, total (3 places), life_start, life_end, leaked, overcost_sec, summary. outcomes: episode_id, outcome (unknown ones become aborted)."""
    w = Window.partitionBy("episode_id").orderBy("step")
    last = F.last("life", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    o = observations.withColumn("drop", F.greatest(last - F.col("life"), F.lit(0))).withColumn("over", F.when((F.col("dt_sec") > 0) & (F.col("cost") >= F.col("cost_limit")), F.col("dt_sec")).otherwise(0.0))
    known = F.col("life").isNotNull()
    g = o.groupBy("episode_id").agg(F.coalesce(F.sum("drop"), F.lit(0)).cast("long").alias("leaked"), F.sum("over").alias("over"), F.min_by(F.when(known, F.col("life")), F.when(known, F.col("step"))).alias("life_start"), F.max_by(F.when(known, F.col("life")), F.when(known, F.col("step"))).alias("life_end"))
    g = g.join(outcomes.select("episode_id", F.when(F.col("outcome").isin(OUTCOMES), F.col("outcome")).otherwise("aborted").alias("outcome")), "episode_id")
    win = F.when(F.col("outcome") == "win", config["win"]).otherwise(0.0)
    leak, over = -config["leak"] * F.col("leaked"), -config["overcost"] * F.col("over")
    g = g.select("episode_id", "outcome", win.alias("win_bonus"), F.round(leak, 3).alias("leak_penalty"), F.round(over, 3).alias("overcost_penalty"), F.round(win + leak + over, 3).alias("total"), "life_start", "life_end", "leaked", F.round("over", 3).alias("overcost_sec"))
    return g.withColumn("summary", F.format_string("total %.1f = win %.1f, leak %.1f (%d), overcost %.1f (%.1fs)", "total", "win_bonus", "leak_penalty", "leaked", "overcost_penalty", "overcost_sec"))


def step_rewards(items: DataFrame) -> DataFrame:
    return items.groupBy("episode_id", "step").agg(F.round(F.sum("delta"), 3).alias("reward"))


def terminations(observations: DataFrame, max_steps: int) -> DataFrame:
    """episode_id, outcome: of the first step that ends it: life 0 or less is defeat, then cleared is win, then the last step allowed is timeout; none: aborted. observations: episode_id, step, life, cleared."""
    end = F.when(F.col("life") <= 0, "defeat").when(F.coalesce("cleared", F.lit(False)), "win").when(F.col("step") >= max_steps, "timeout")
    return observations.groupBy("episode_id").agg(F.coalesce(F.min_by(end, F.when(end.isNotNull(), F.col("step"))), F.lit("aborted")).alias("outcome"))


def decision_brief(decisions: DataFrame) -> DataFrame:
    """id, summary, analysis, evidence: the decision's evidence, or the knowledge's citations where it has none. decisions: id, summary, analysis, evidence and citations (arrays of struct level, source)."""
    return decisions.select("id", F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("analysis", F.lit("")).alias("analysis"), F.when(F.size("evidence") > 0, F.col("evidence")).otherwise(F.col("citations")).alias("evidence"))


def verdicts(actions: DataFrame) -> DataFrame:
    """id, total, succeeded, failed, verdict: good without failures, bad with nothing else, else risky. actions: id, ok."""
    g = actions.groupBy("id").agg(F.count("*").alias("total"), F.count_if("ok").alias("succeeded")).withColumn("failed", F.col("total") - F.col("succeeded"))
    return g.withColumn("verdict", F.when(F.col("failed") == 0, "good").when(F.col("succeeded") == 0, "bad").otherwise("risky"))


def long_latencies(step_rows: DataFrame, stages: list[str] = LATENCIES) -> DataFrame:
    """id, step, stage, ms, with a row `total` for the sum. step_rows: id, step, latency_ms map."""
    known = F.map_filter("latency_ms", lambda k, v: k.isin(stages))
    total = F.create_map(F.lit("total"), F.aggregate(F.map_values(known), F.lit(0.0), lambda a, v: a + v))
    return step_rows.select("id", "step", F.explode(F.map_concat(known, total)).alias("stage", "ms"))


def latency_summary(rows: DataFrame, by: str = "stage", value: str = "ms") -> DataFrame:
    """Per stage: n, mean, p50, p95, p99, shortest, longest; percentiles interpolate linearly and are exact."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    g = rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), p.alias("p"), F.min(value).alias("shortest"), F.max(value).alias("longest"))
    return g.select(by, "n", F.round("mean", 3).alias("mean"), *[F.round(F.col("p")[i], 3).alias(a) for i, a in enumerate(("p50", "p95", "p99"))], "shortest", "longest")


def latency_quantiles(rows: DataFrame, by: str = "stage", value: str = "ms") -> DataFrame:
    """The summary for stages with more distinct values than a buffer holds: the same columns, with percentiles from places in the whole order."""
    places = exact_quantiles(rows, [by], value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}).withColumnRenamed(by, "of").drop("n")
    g = rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("shortest"), F.max(value).alias("longest"))
    both = g.join(places, F.col(by).eqNullSafe(F.col("of")), "left")
    return both.select(by, "n", F.round("mean", 3).alias("mean"), *[F.round(c, 3).alias(c) for c in ("p50", "p95", "p99")], "shortest", "longest")


def latency_shares(rows: DataFrame) -> DataFrame:
    """id, step, stage, ms, share of the step's time (4 places)."""
    rows = rows.filter("stage <> 'total'")
    return rows.withColumn("share", F.round(F.try_divide(F.col("ms"), F.sum("ms").over(Window.partitionBy("id", "step"))), 4))


def trend(step_rows: DataFrame) -> DataFrame:
    """id, step, cost_before, cost_after, life: each step with the cost that the step before left."""
    return step_rows.withColumn("cost_before", F.lag("cost").over(Window.partitionBy("id").orderBy("step"))).select("id", "step", "cost_before", F.col("cost").alias("cost_after"), "life")


def feasibility(plans: DataFrame) -> DataFrame:
    """plan_id, idx, action, kept, reason for each action of a plan, in order: a kept deployment spends cost and takes its cell and operator. plans: plan_id, cost, cost_ok, hand map<string,int>, deployed array<string>, free array<string>,
    ready array<string> ('operator#skill'), has_enemies, actions array<struct<action, operator_id, grid_pos, skill_id>>."""
    reason = """case
      when a.action = 'deploy' then case
        when not map_contains_key(hand, a.operator_id) then 'not in hand'
        when array_contains(deployed, a.operator_id) or array_contains(s.planned, a.operator_id) then 'already deployed'
        when array_contains(s.used, a.grid_pos) then 'cell taken by plan'
        when not coalesce(array_contains(free, a.grid_pos), false) then 'cell not free'
        when not cost_ok then 'unstable reading'
        when hand[a.operator_id] > s.cost then 'cost short'
        else '' end
      when a.action = 'skill' then case
        when not array_contains(deployed, a.operator_id) then 'not on field'
        when not array_contains(ready, concat(a.operator_id, '#', a.skill_id)) then 'skill not ready'
        when not has_enemies then 'no enemies'
        else '' end
      when a.action = 'retreat' then if(array_contains(deployed, a.operator_id), '', 'not on field')
      when a.action = 'wait' then ''
      else 'unknown action' end"""
    start = "named_struct('cost', cost, 'used', cast(array() as array<string>), 'planned', cast(array() as array<string>), 'out', cast(array() as array<string>))"
    spend = f"(({reason}) = '' and a.action = 'deploy')"
    step = f"named_struct('cost', if({spend}, s.cost - hand[a.operator_id], s.cost), 'used', if({spend}, array_append(s.used, a.grid_pos), s.used), 'planned', if({spend}, array_append(s.planned, a.operator_id), s.planned), 'out', array_append(s.out, {reason}))"
    why = F.expr(f"aggregate(actions, {start}, (s, a) -> {step}, s -> s.out)")
    return plans.withColumn("_why", why).select("plan_id", F.posexplode(F.arrays_zip("actions", "_why")).alias("idx", "z")).select("plan_id", "idx", F.col("z.actions").alias("action"), (F.col("z._why") == "").alias("kept"), F.col("z._why").alias("reason"))


def deploy_order(kept: DataFrame, order: dict[str, int] = DEPLOY_ORDER) -> DataFrame:
    """plan_id, pos and the kept actions: deployments by their class's priority, then name; the others after, as they were. kept: plan_id, idx, action, operator_id, class."""
    prio = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("class")), F.lit(DEPLOY_OTHERS))
    dep = F.col("action") == "deploy"
    w = Window.partitionBy("plan_id").orderBy(F.when(dep, 0).otherwise(1), F.when(dep, prio), F.when(dep, F.col("operator_id")), "idx")
    return kept.withColumn("pos", F.row_number().over(w).cast("long"))


def noop_streaks(steps: DataFrame, threshold: int = 3) -> DataFrame:
    """steps with streak (steps without anything kept in a row, up to here), flagged (at `threshold` or more) and confidence (0.9 or 0.5 by cost_ok; 0.35 with nothing kept, 0.2 when flagged). steps: series_id, ts, kept, and cost_ok where known."""
    w = Window.partitionBy("series_id").orderBy("ts")
    island = F.sum((F.col("kept") > 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    s = steps.withColumn("_i", island)
    streak = F.when(F.col("kept") > 0, 0).otherwise(F.count(F.when(F.col("kept") <= 0, 1)).over(Window.partitionBy("series_id", "_i").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("streak", streak.cast("long")).drop("_i").withColumn("flagged", F.col("streak") >= threshold)
    base = F.when(F.col("cost_ok"), 0.9).otherwise(0.5) if "cost_ok" in steps.columns else F.lit(0.9)
    return s.withColumn("confidence", F.when(F.col("flagged"), 0.2).when(F.col("streak") > 0, 0.35).otherwise(base))


def action_problems(actions: DataFrame) -> DataFrame:
    """actions with problems: what breaks each action type's rules. actions: action, operator_id, grid_pos, skill_id, duration_ms."""
    a, named = F.col("action"), F.trim(F.coalesce("operator_id", F.lit(""))) != ""
    cell = F.coalesce(F.upper(F.trim("grid_pos")).rlike(CELL), F.lit(False))
    has = lambda c: F.col(c).isNotNull()
    tag = lambda t, cond: F.when(cond, F.lit(t))
    unit = a.isin("deploy", "skill", "retreat")
    tags = [
        tag("unknown action", ~F.coalesce(a.isin("deploy", "skill", "retreat", "wait"), F.lit(False))), tag("no operator", unit & ~named), tag("bad cell", (a == "deploy") & ~cell), tag("skill not allowed", a.isin("deploy", "retreat", "wait") & has("skill_id")), tag("duration not allowed", unit & has("duration_ms")),
        tag("cell not allowed", a.isin("skill", "retreat", "wait") & has("grid_pos")), tag("no skill", (a == "skill") & ~has("skill_id")), tag("bad skill", (a == "skill") & has("skill_id") & ~F.col("skill_id").between(1, 3)), tag("no duration", (a == "wait") & ~has("duration_ms")), tag("bad duration", (a == "wait") & has("duration_ms") & ~F.col("duration_ms").between(0, 60_000)), tag("operator not allowed", (a == "wait") & named),
    ]
    return actions.withColumn("problems", F.array_compact(F.array(*tags)))
