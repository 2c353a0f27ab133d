"""Transcript and frame tables: categories, frame timelines, nearest-interval alignment, model output parsing, records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.text import lenient_double, minutes_seconds

TOLERANCE, CONFIDENCE = 8.0, 0.6
#: Literals of the prompt's example, which a model may echo (fixed values).
ECHOED = ["主角干员名", "示例干员", "干员名", "example_operator", "示例标题", "example_title", "T0示例"]
UNMATCHED = "（无对应语音）"


def category(text: Column, kinds: list[tuple[str, list[str]]], other: str = "other") -> Column:
    """Struct (category, keyword): the first kind in order with a keyword in the text, and its first such keyword; case doesn't count."""
    low = F.lower(text)
    hits = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w.lower())), F.struct(F.lit(k).alias("category"), F.lit(w).alias("keyword"))) for k, ws in kinds for w in ws]))
    return F.coalesce(F.get(hits, F.lit(0)), F.struct(F.lit(other).alias("category"), F.lit("").alias("keyword")))


def categorise(videos: DataFrame, kinds: list[tuple[str, list[str]]]) -> DataFrame:
    """videos with category and keyword, from title and tags."""
    blob = F.concat_ws(" ", "title", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "))
    return videos.withColumn("_c", category(blob, kinds)).withColumn("category", F.col("_c.category")).withColumn("keyword", F.col("_c.keyword")).drop("_c")


def partition_allowed(videos: DataFrame, allowed: list[str]) -> tuple[DataFrame, DataFrame]:
    ok = F.coalesce(F.col("category").isin(allowed), F.lit(False))
    return videos.filter(ok), videos.filter(~ok)


def video_id(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(url, r"BV[0-9A-Za-z]{10}", 0), F.lit("")), F.trim(url))


def flatten_meta(raw: DataFrame, kinds: list[tuple[str, list[str]]], allowed: list[str]) -> DataFrame:
    """bv_id, title, uploader, publish_time, duration_sec, tags, category, keyword, kept: a category that only the full meta shows is checked again."""
    base = raw.select(video_id(F.coalesce("bv_id", "url")).alias("bv_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("uploader", F.lit("")).alias("uploader"), F.coalesce("publish_time", F.lit("")).alias("publish_time"), F.coalesce(lenient_double(F.col("duration")), F.lit(0.0)).alias("duration_sec"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    return categorise(base, kinds).withColumn("kept", F.col("category").isin(allowed))


def frame_timeline(videos: DataFrame, step: float = 5.0) -> DataFrame:
    """bv_id, index (from 1), timestamp (3 places): a frame every `step` seconds, both ends in."""
    n = F.floor((F.col("duration_sec") + 1e-6) / step).cast("int")
    return videos.filter(F.col("duration_sec") >= 0).select("bv_id", F.explode(F.sequence(F.lit(0), n)).alias("i")).select("bv_id", (F.col("i") + 1).cast("long").alias("index"), F.round(F.col("i") * step, 3).alias("timestamp"))


def nearest_frame(anchors: DataFrame, step: float) -> Column:
    """The index of the frame nearest to `anchor` on a fixed grid (the first on ties), found by arithmetic instead of a search; limited to frames 1 to n_frames."""
    low = F.floor(F.col("anchor") / step)
    i = F.when(F.col("anchor") - low * step <= (low + 1) * step - F.col("anchor"), low).otherwise(low + 1)
    return F.greatest(F.lit(1), F.least(F.col("n_frames"), i + 1)).cast("long")


def nearest_point(anchors: DataFrame, points: DataFrame, key: str, width: float) -> DataFrame:
    """anchor rows with the nearest point of the same key (first by index on ties). A backward and a forward as-of in one sorted pass over the union, so no pair is made. anchors: key, anchor_id, t;
    points: key, index, t."""
    both = anchors.select(key, "t", F.lit(1).alias("is_anchor"), "anchor_id", F.lit(None).cast("long").alias("index")).unionByName(points.select(key, "t", F.lit(0).alias("is_anchor"), F.lit(None).cast("long").alias("anchor_id"), F.col("index").cast("long")))
    p = F.when(F.col("is_anchor") == 0, F.struct("t", "index"))
    w = Window.partitionBy(key)
    # Points come before anchors of the same time, and of equal points the first is nearest from both sides.
    back = F.last(p, True).over(w.orderBy("t", "is_anchor", F.col("index").desc()).rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(p, True).over(w.orderBy("t", F.col("is_anchor").desc(), "index").rowsBetween(0, Window.unboundedFollowing))
    out = both.withColumn("b", back).withColumn("a", ahead).filter("is_anchor = 1")
    pick = F.when(F.col("b").isNull() | (F.abs(F.col("a.t") - F.col("t")) < F.abs(F.col("t") - F.col("b.t"))), F.col("a")).otherwise(F.col("b"))
    return out.withColumn("n", F.coalesce(pick, F.col("b"), F.col("a"))).select(key, "anchor_id", F.col("t").alias("anchor"), F.col("n.index").alias("index"), F.col("n.t").alias("timestamp"))


def parse_model_json(raw: Column, schema: str) -> Column:
    """The JSON of a model's answer, in a closed or open code fence or bare; null if it isn't one."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)(?:```|$)", 1)
    return F.from_json(F.trim(F.when(fenced != "", fenced).otherwise(raw)), schema)


def read_charts(answers: DataFrame, echoed: list[str] = ECHOED, threshold: float = CONFIDENCE) -> DataFrame:
    """video_id, timestamp_sec, chart_type, operator, data, confidence, kept, raw: failures and echoes of the example become unknown with confidence 0 (failures keep 500 characters of the answer). answers:
    video_id, timestamp_sec, raw."""
    p = answers.withColumn("_p", parse_model_json(F.col("raw"), "chart_type string, operator string, data string, confidence double"))
    fine = F.coalesce(F.col("_p.chart_type").isNotNull(), F.lit(False))
    echo = F.coalesce(F.col("_p.operator").isin(echoed), F.lit(False)) | F.coalesce(F.get_json_object("_p.data", "$.title").isin(echoed), F.lit(False))
    ok = fine & ~echo
    conf = F.when(ok, F.coalesce("_p.confidence", F.lit(0.0))).otherwise(0.0)
    return p.select("video_id", "timestamp_sec", F.when(ok, F.col("_p.chart_type")).otherwise("unknown").alias("chart_type"), F.when(ok, F.col("_p.operator")).alias("operator"), F.when(ok, F.col("_p.data")).alias("data"), conf.alias("confidence"), ((F.col("timestamp_sec") > 0) & (conf >= threshold)).alias("kept"), F.when(~fine, F.substring("raw", 1, 500)).alias("raw"))


def segments(raw: DataFrame) -> DataFrame:
    """video_id, ord, start, end, mid, text: bounds cast and put in order; rows without both bounds go."""
    a, b = lenient_double(F.col("start")), lenient_double(F.col("end"))
    return raw.select("video_id", "ord", F.least(a, b).alias("start"), F.greatest(a, b).alias("end"), F.when(a.isNull() | b.isNull(), None).otherwise((a + b) / 2).alias("mid"), "text").filter("mid is not null")


def align(charts: DataFrame, segs: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """chart rows with speech, delta (timestamp minus the segment's middle, 3 places) and matched. Of the segments that contain the time (both ends in) the one with the nearest middle; else the nearest middle, matched if it is within
    the tolerance (beyond it, delta alone stays). charts: video_id, chart_id, t; segs: see segments.

    Containing segments come from a join on video and time slot, where a segment is in each slot that it touches; the nearest middle comes from one sorted pass. No chart meets all segments of its video."""
    slot = max(tolerance, 1.0)
    slots = segs.select("video_id", "ord", "start", "end", "mid", "text", F.explode(F.sequence(F.floor(F.col("start") / slot), F.floor(F.col("end") / slot))).alias("slot"))
    asked = charts.select("video_id", "chart_id", "t", F.floor(F.col("t") / slot).alias("slot"))
    inside = asked.join(slots, ["video_id", "slot"]).filter("t between start and end").groupBy("chart_id").agg(F.min_by(F.struct("mid", "text"), F.struct(F.abs(F.col("t") - F.col("mid")), F.col("ord"))).alias("inside"))
    near = nearest_point(charts.select("video_id", F.col("chart_id").alias("anchor_id"), "t"), segs.select("video_id", F.col("ord").alias("index"), F.col("mid").alias("t")), "video_id", slot)
    near = near.join(segs.select("video_id", F.col("ord").alias("index"), "text"), ["video_id", "index"], "left").select(F.col("anchor_id").alias("chart_id"), F.struct(F.col("timestamp").alias("mid"), "text").alias("near"), F.col("timestamp").isNotNull().alias("any"))
    out = charts.join(inside, "chart_id", "left").join(near, "chart_id", "left")
    best = F.coalesce("inside", F.when(F.col("any"), F.col("near")))
    delta = F.round(F.col("t") - best.mid, 3)
    matched = F.coalesce(F.col("inside").isNotNull() | (F.abs(F.col("t") - best.mid) <= tolerance), F.lit(False))
    return out.select("chart_id", "video_id", "t", F.when(matched, best.text).alias("speech"), delta.alias("delta"), matched.alias("matched"))


def table_lines(data: Column, first: int = 3) -> Column:
    """Lines of a chart's rows: the first few of an array of maps."""
    return F.transform(F.slice(data, 1, first), lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e.key, F.lit("="), e.value)), "，"))


def focus_lines(data: Column, key: str) -> Column:
    """Lines of one row, without the key that names it."""
    return F.transform(F.map_entries(F.map_filter(data, lambda k, v: k != key)), lambda e: F.concat(e.key, F.lit("="), e.value))


def tier_lines(tiers: Column) -> Column:
    """Lines `tier: names` in the order of the tiers."""
    return F.transform(F.array_sort(F.map_entries(tiers)), lambda e: F.concat(e.key, F.lit("："), F.array_join(e.value, "、")))


def records(pairs: DataFrame, videos: DataFrame) -> DataFrame:
    """question, answer, evidence of each aligned chart. pairs: video_id, t, chart_type, operator, rows (array of maps), tiers (map of arrays), speech, matched; videos: bv_id, title, uploader."""
    at = minutes_seconds(F.col("t"))
    joined = pairs.join(videos.select(F.col("bv_id").alias("video_id"), "title", "uploader"), "video_id", "left")
    body = F.when(F.col("chart_type") == "table", F.array_join(table_lines(F.col("rows")), "\n")).when(F.col("chart_type") == "tier_list", F.array_join(tier_lines(F.col("tiers")), "\n")).otherwise(F.lit(""))
    speech = F.when(F.col("matched"), F.col("speech")).otherwise(UNMATCHED)
    question = F.concat(F.lit("视频《"), F.coalesce("title", F.lit("")), F.lit("》"), at, F.lit(" 的图表说明了什么？"))
    evidence = F.create_map(F.lit("chart"), F.lit("retrieved:video_chart"), F.lit("speech"), F.when(F.col("matched"), "retrieved:transcript").otherwise("none"))
    return joined.select("video_id", "t", question.alias("question"), F.concat_ws("\n", F.nullif(body, F.lit("")), speech).alias("answer"), evidence.alias("evidence"))
