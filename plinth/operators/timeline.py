"""Time-series logic over readings, spawn plans and detections."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.text import lenient_int

JUMP, LOW, INTERVAL, DETECTED = 10, 0.4, 6.0, 0.35
BUCKETS = ["fact", "cv", "estimated", "annotated", "retrieved", "inferred", "mock"]


def stabilise(readings: DataFrame, jump: int = JUMP, low: float = LOW) -> DataFrame:
    """series_id, ts, value, status, confidence: a null is `missing` (the last value, or 0, with confidence 0); a drop, or a rise of more than `jump`, against the last reading is `uncertain` (confidence `low` at most); else `ok`.
    An uncertain reading becomes the last reading all the same. readings: series_id, ts, value, confidence (ord breaks ties of ts where there is one)."""
    order = ["ts", "ord"] if "ord" in readings.columns else ["ts"]
    last = F.last("value", True).over(Window.partitionBy("series_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    r = readings.withColumn("last", last)
    odd = F.col("last").isNotNull() & ((F.col("value") < F.col("last")) | (F.col("value") - F.col("last") > jump))
    status = F.when(F.col("value").isNull(), "missing").when(odd, "uncertain").otherwise("ok")
    conf = F.when(F.col("value").isNull(), 0.0).when(odd, F.least("confidence", F.lit(low))).otherwise(F.col("confidence"))
    return r.select("series_id", *order, F.coalesce("value", "last", F.lit(0)).alias("value"), status.alias("status"), conf.alias("confidence"))


def best_number(results: DataFrame) -> DataFrame:
    """frame_id, number, score: the text with the highest score that holds digits (the first on ties). results: frame_id, items array<struct<text, score>>."""
    rows = results.select("frame_id", F.posexplode_outer("items").alias("i", "x"))
    digits = F.regexp_replace("x.text", r"\D", "")
    n = F.when(digits != "", digits.try_cast("int"))
    return rows.groupBy("frame_id").agg(F.max_by(F.struct(n.alias("number"), F.col("x.score").alias("score")), F.when(n.isNotNull(), F.struct("x.score", -F.col("i")))).alias("b")).select("frame_id", "b.number", F.coalesce("b.score", F.lit(0.0)).alias("score"))


def enemy_counts(rows: DataFrame) -> DataFrame:
    """stage_id, ord, enemy, count: blank or bad counts are 1, and no count is below 1; rows without an enemy go."""
    return rows.filter(F.trim(F.coalesce("enemy", F.lit(""))) != "").select("stage_id", "ord", F.trim("enemy").alias("enemy"), F.greatest(lenient_int(F.col("count"), 1), F.lit(1)).alias("count"))


def spawn_plan(enemies: DataFrame, annotated: DataFrame, interval: float = INTERVAL) -> DataFrame:
    """stage_id, ord, expected_sec, enemy, count, source: the annotated timeline of a stage where there is one, else an entry every `interval` seconds in the enemies' order. annotated: stage_id, ord, time_sec, enemy, count."""
    known = annotated.select("stage_id").distinct()
    w = Window.partitionBy("stage_id").orderBy("ord")
    guess = enemy_counts(enemies).join(known, "stage_id", "left_anti").withColumn("n", F.row_number().over(w) - 1)
    return annotated.select("stage_id", F.col("ord").cast("long").alias("ord"), F.col("time_sec").cast("double").alias("expected_sec"), "enemy", F.col("count").cast("int").alias("count"), F.lit("annotated").alias("source")).unionByName(guess.select("stage_id", F.col("n").cast("long").alias("ord"), (F.col("n") * interval).alias("expected_sec"), "enemy", F.col("count").cast("int").alias("count"), F.lit("estimated").alias("source")))


def presence(states: DataFrame, plan: DataFrame, confirmations: DataFrame | None = None) -> DataFrame:
    """state_id, enemy, count, source: entries expected by the state's time, summed for each enemy; cv if a confirmation came at or before that time (it sticks), else the plan's source.

    states: state_id, stage_id, elapsed; confirmations: stage_id, enemy, t. Running totals come from one sorted pass over each (stage, enemy), so states never meet all entries."""
    conf = confirmations if confirmations is not None else states.sparkSession.createDataFrame([], "stage_id string, enemy string, t double")
    foes = plan.select("stage_id", "enemy").distinct()
    kind = lambda k, t, c, s, i: [F.lit(k).alias("kind"), t.cast("double").alias("t"), c.cast("long").alias("c"), s.alias("s"), i.alias("state_id")]
    none, text = F.lit(None).cast("long"), F.lit(None).cast("string")
    entry = plan.select("stage_id", "enemy", *kind(0, F.col("expected_sec"), F.col("count"), F.col("source"), none))
    sure = conf.select("stage_id", "enemy", *kind(1, F.col("t"), F.lit(0), text, none))
    asked = states.join(foes, "stage_id").select("stage_id", "enemy", *kind(2, F.col("elapsed"), F.lit(0), text, F.col("state_id").cast("long")))
    w = Window.partitionBy("stage_id", "enemy").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = entry.unionByName(sure).unionByName(asked).select("*", F.sum("c").over(w).alias("n"), F.max((F.col("kind") == 1).cast("int")).over(w).alias("confirmed"), F.last("s", True).over(w).alias("plan_source"), F.count(F.when(F.col("kind") == 0, 1)).over(w).alias("entries"))
    return seen.filter("kind = 2 and entries > 0").select("state_id", "enemy", F.col("n").alias("count"), F.when(F.col("confirmed") == 1, "cv").otherwise(F.col("plan_source")).alias("source"))


def confirmed(detections: DataFrame, threshold: float = DETECTED) -> DataFrame:
    """frame_id, label, confirmed: whether a detection of the label reaches the threshold."""
    return detections.groupBy("frame_id", "label").agg((F.max("confidence") >= threshold).alias("confirmed"))


def throttle_buckets(events: DataFrame, key: str, ts: str, seconds: float = 2.0) -> DataFrame:
    """The first event of each key in each bucket of `seconds`: an approximation of a minimum interval that partial aggregates can make."""
    slot = F.floor(F.col(ts) / seconds)
    rest = [c for c in events.columns]
    return events.groupBy(F.col(key).alias("_k"), slot.alias("_s")).agg(F.min_by(F.struct(*rest), ts).alias("r")).select("r.*")


def throttle(events: DataFrame, key: str, ts: str, seconds: float = 2.0) -> DataFrame:
    """Events at least `seconds` after the last one that was let through, per key; exact. Each depends on the one before, which no window can say, so a key's rows pass a small loop in time order, batch by batch: a key of any length needs one number of
    memory."""
    cols = events.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, last = object(), 0.0
        for pdf in batches:
            keep = []
            for k, t in zip(pdf[key].to_numpy(), pdf[ts].to_numpy()):
                due = k != who or t - last >= seconds
                if due:
                    who, last = k, t
                keep.append(due)
            yield pdf[keep]

    return events.repartition(F.col(key)).sortWithinPartitions(key, ts).mapInPandas(run, events.schema).select(*cols)


def evidence_lines(refs: DataFrame, buckets: list[str] = BUCKETS) -> DataFrame:
    """state_id, line: per state the evidence by bucket in the buckets' order, each reference once, in order. refs: state_id, ord, bucket, ref."""
    at = F.array_position(F.array(*[F.lit(b) for b in buckets]), F.col("bucket"))
    g = refs.filter(at > 0).groupBy("state_id", at.alias("b"), "bucket").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "ref"))), lambda x: x.ref)).alias("refs"))
    return g.groupBy("state_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", F.concat("bucket", F.lit(": "), F.array_join("refs", "、")).alias("t")))), lambda x: x.t), "\n").alias("line"))
