"""Development priorities, a progress ledger and performance regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.ordering import placed, running

WEIGHTS = {"need_match": 50.0, "power_gap": 30.0, "material_ready": 15.0, "material_short": -5.0}
#: Scores of tiers without a score of their own.
TIER_SCORES = {"T0": 40.0, "T1": 30.0, "T2": 20.0, "T3": 10.0}
FULL_LEVEL, WINDOW, DRAW, CRYSTAL = 60, 6, 600, 180


def missing_materials(need: Column, stock: Column) -> Column:
    """need minus stock, where above 0. Both map<string,int>; null maps count as empty."""
    empty = F.create_map().cast("map<string,int>")
    gap = F.map_zip_with(F.coalesce(need, empty), F.coalesce(stock, empty), lambda k, n, s: F.coalesce(n, F.lit(0)) - F.coalesce(s, F.lit(0)))
    return F.map_filter(gap, lambda k, v: v > 0)


def covers(need: Column, stock: Column) -> Column:
    return F.size(missing_materials(need, stock)) == 0


def priorities(operators: DataFrame, professions: list[str], roles: list[str], stock: dict[str, int], tiers: DataFrame | None = None, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """name, rank, score (2 places), materials_ready, materials_missing, reasons, evidence of owned operators. operators: name, profession, elite, level, owned, tags, materials_to_next, target_elite; tiers: name, tier, score."""
    spark = operators.sparkSession
    tiers = tiers if tiers is not None else spark.createDataFrame([], "name string, tier string, score double")
    o = operators.filter("owned").join(tiers.select("name", F.upper("tier").alias("tier"), F.col("score").alias("tier_given")), "name", "left")
    asked = F.array(*[F.lit(r) for r in roles]).cast("array<string>")
    have = F.create_map(*[F.lit(x) for kv in stock.items() for x in kv]).cast("map<string,int>") if stock else F.create_map().cast("map<string,int>")
    right = F.coalesce(F.col("profession").isin(professions), F.lit(False)) if professions else F.lit(False)
    shared = F.array_sort(F.array_intersect(F.coalesce("tags", F.array().cast("array<string>")), asked))
    match = F.when(right, weights["need_match"] * 0.6).otherwise(0.0) + F.when(F.size(shared) > 0, weights["need_match"] * 0.4).otherwise(0.0)
    elite = F.greatest(F.lit(0), F.col("target_elite") - F.col("elite"))
    level = F.when(F.col("target_elite") != 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (FULL_LEVEL - F.col("level")) / FULL_LEVEL))).otherwise(0.0)
    gap = weights["power_gap"] * F.least(F.lit(1.0), elite / 2 * 0.7 + level * 0.3)
    named = F.create_map(*[F.lit(x) for kv in TIER_SCORES.items() for x in kv])
    tier = F.coalesce("tier_given", F.try_element_at(named, F.col("tier")), F.lit(0.0))
    lacking = missing_materials(F.col("materials_to_next"), have)
    wants = F.coalesce(F.size("materials_to_next"), F.lit(0)) > 0
    ready = wants & (F.size(lacking) == 0)
    material = F.when(~wants, 0.0).when(ready, weights["material_ready"]).otherwise(weights["material_short"])
    reasons = F.array_compact(F.array(F.when(right, "profession asked for"), F.when(F.size(shared) > 0, F.concat(F.lit("roles: "), F.array_join(shared, "、"))), F.when(elite > 0, F.format_string("elite %d to %d", "elite", "target_elite")), F.when(F.col("level") < FULL_LEVEL, F.format_string("level %d", "level")), F.when(F.col("tier").isNotNull(), F.concat(F.lit("tier "), "tier")), F.when(~wants, "no materials stated").when(ready, "materials ready").otherwise(F.concat(F.lit("short: "), F.array_join(F.transform(F.array_sort(F.map_entries(lacking)), lambda e: F.concat(e.key, F.lit("×"), e.value.cast("string"))), "、")))))
    evidence = F.array_sort(F.array_compact(F.array(F.when((F.size(shared) > 0) | (elite > 0) | (F.col("level") < FULL_LEVEL), "inferred:rule"), F.when(F.col("tier").isNotNull() | F.col("tier_given").isNotNull(), "retrieved:tier_list"))))
    out = o.select("name", F.round(match + gap + tier + material, 2).alias("score"), ready.alias("materials_ready"), F.when(ready, F.create_map().cast("map<string,int>")).otherwise(lacking).alias("materials_missing"), reasons.alias("reasons"), evidence.alias("evidence"))
    return placed(out, -F.col("score"), F.col("name"), name="rank")


def unowned_relevant(operators: DataFrame, professions: list[str], roles: list[str]) -> DataFrame:
    asked = F.array(*[F.lit(r) for r in roles]).cast("array<string>")
    fits = F.coalesce(F.col("profession").isin(professions) if professions else F.lit(False), F.lit(False)) | F.coalesce(F.arrays_overlap("tags", asked), F.lit(False))
    return operators.filter(~F.col("owned") & fits).select("name").orderBy("name")


def main_order(code: Column) -> tuple[Column, Column, Column]:
    """Sort keys: main stages by chapter and number, all others after them by code."""
    chapter, number = (F.regexp_extract(code, r"^(\d+)-(\d+)$", i).try_cast("int") for i in (1, 2))
    return F.coalesce(chapter, F.lit(2**31 - 1)), F.coalesce(number, F.lit(2**31 - 1)), code


def main_stages(stages: DataFrame) -> DataFrame:
    """stage_id, title, has_raid of main stages. stages: stage_id, title, raid map."""
    return stages.filter(F.col("stage_id").rlike(r"^\d+-\d+$")).select("stage_id", "title", (F.coalesce(F.size("raid"), F.lit(0)) > 0).alias("has_raid"))


def ledger(stages: DataFrame, progress: DataFrame, window: int = WINDOW) -> DataFrame:
    """stage_id, title, kind (normal or raid), done, tier (null when done), locked: a pending stage is immediate if it is the first or the one before is done; of the rest the first `window` are short_term, others long_term. A raid is immediate once its stage is done, else it follows its
    stage, but not before short_term. Unknown ids in progress count for nothing. stages: stage_id, title, has_raid; progress: stage_id, kind.

    The stages are one ordered list: each gets its place, looks up the one before by place, and pending ones are counted in ranges of places."""
    done = progress.select("stage_id", "kind").distinct().groupBy("stage_id").agg(F.bool_or(F.col("kind") == "normal").alias("n"), F.bool_or(F.col("kind") == "raid").alias("r"))
    s = stages.join(done, "stage_id", "left").withColumn("n", F.coalesce("n", F.lit(False))).withColumn("r", F.coalesce("r", F.lit(False)))
    s = placed(s, *main_order(F.col("stage_id")))
    s = s.join(s.select((F.col("place") + 1).alias("place"), F.col("n").alias("before")), "place", "left").withColumn("open", ~F.col("n") & F.coalesce("before", F.lit(True)))
    s = running(s, "place", (~F.col("n") & ~F.col("open")).cast("int"), "nth")
    tier = F.when(F.col("n"), None).when(F.col("open"), "immediate").when(F.col("nth") <= window, "short_term").otherwise("long_term")
    s = s.withColumn("tier", tier)
    normal = F.struct(F.lit("normal").alias("kind"), F.col("n").alias("done"), F.col("tier").alias("tier"), F.lit(False).alias("locked"))
    raid_tier = F.when(F.col("r"), None).when(F.col("n") | False, "immediate").when(F.col("tier") == "immediate", "short_term").otherwise(F.col("tier"))
    raid = F.struct(F.lit("raid").alias("kind"), F.col("r").alias("done"), raid_tier.alias("tier"), (~F.col("r") & ~F.col("n")).alias("locked"))
    return s.select("stage_id", "title", F.explode(F.array_compact(F.array(normal, F.when(F.col("has_raid"), raid)))).alias("x")).select("stage_id", "title", "x.*")


def ledger_totals(rows: DataFrame, current: int = 0, per_normal: int = 1, per_raid: int = 1, planned_pulls: int = 0) -> DataFrame:
    """One row: earned and remaining by kind, immediate, short_term, long_term, decision (immediate + short_term), projected (current + remaining), pulls (what projected buys) and gap (what planned pulls lack)."""
    worth = F.when(F.col("kind") == "normal", per_normal).otherwise(per_raid)
    add = lambda cond: F.coalesce(F.sum(F.when(cond, worth)), F.lit(0)).cast("long")
    g = rows.agg(*[add((F.col("kind") == k) & (F.col("done") == d)).alias(f"{n}_{k}") for k in ("normal", "raid") for n, d in (("earned", True), ("remaining", False))], *[add(F.col("tier") == t).alias(t) for t in ("immediate", "short_term", "long_term")])
    g = g.withColumn("decision", F.col("immediate") + F.col("short_term")).withColumn("projected", F.lit(current) + F.col("remaining_normal") + F.col("remaining_raid"))
    return g.withColumn("pulls", F.floor(F.col("projected") * CRYSTAL / DRAW).cast("long")).withColumn("gap", F.greatest(F.lit(0), F.ceil(F.lit(planned_pulls) * DRAW / CRYSTAL).cast("long") - F.col("projected")))


def next_stages(rows: DataFrame, k: int = 5) -> DataFrame:
    """The first k distinct stages to go for: immediate ones, then short-term ones, each in the main order."""
    best = rows.filter(F.col("tier").isin("immediate", "short_term")).groupBy("stage_id").agg(F.min(F.when(F.col("tier") == "immediate", 0).otherwise(1)).alias("t"))
    return best.orderBy("t", *main_order(F.col("stage_id"))).limit(k).select("stage_id")


def regressions(perf: DataFrame, threshold: float = 0.1) -> DataFrame:
    """metric, change_pct (1 place), status of measured metrics (an actual of 0 or less, or none, is left out). perf: metric, baseline_ms, actual_ms."""
    r = (F.col("actual_ms") - F.col("baseline_ms")) / F.col("baseline_ms")
    return perf.filter((F.col("actual_ms") > 0) & (F.col("baseline_ms") > 0)).select("metric", F.round(r * 100, 1).alias("change_pct"), F.when(r > threshold, "REGRESSION").when(r < -threshold, "IMPROVED").otherwise("OK").alias("status"))
