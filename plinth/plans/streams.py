"""Streams over the events table, run to its end (availableNow) and read back: each must give what its batch twin gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.functions.shared import shared_folder
from plinth.operators import episodes, timeline
from plinth.plans.registry import Tables, query
from plinth.streaming import live


def scratch(t: Tables) -> str:
    """A new folder where all executors can write."""
    return shared_folder(t.spark, "stream")


def event_stream(t: Tables) -> DataFrame:
    return t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parquet*")


def run(t: Tables, rows: DataFrame) -> DataFrame:
    """What an append stream gives once it has seen all there is."""
    out = scratch(t)
    q = rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.schema(T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])).parquet(f"{out}/rows")


@query("select user_id, count(*) as n, arg_max(event_id, ts) as last_event from events group by user_id")
def stream_latest(t: Tables) -> DataFrame:
    """The latest event of each user, kept up by a stream in complete mode."""
    out = scratch(t)
    rows = live.latest(event_stream(t), columns=["event_id", "ts"]).select("user_id", "n", F.col("frame.event_id").alias("last_event"))
    q = rows.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/rows")).option("checkpointLocation", f"{out}/log").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.parquet(f"{out}/rows")


@query("""
with r as (select user_id as series_id, event_id as ord, case when event_type <> 'error' then floor(value)::bigint end as value from events),
l as (select *, last_value(value ignore nulls) over (partition by series_id order by ord rows between unbounded preceding and 1 preceding) as last from r)
select series_id, ord, coalesce(value, last, 0) as value, case when value is null then 'missing' when last is not null and (value < last or value - last > 10) then 'uncertain' else 'ok' end as status from l
""")
def stream_stabiliser(t: Tables) -> DataFrame:
    r = event_stream(t).select(F.col("user_id").alias("series_id"), F.col("event_id").alias("ord"), F.when(F.col("event_type") != "error", F.floor("value").cast("double")).alias("value"), F.lit(0.9).alias("confidence"))
    return run(t, live.stabilised(r)).select("series_id", "ord", "value", "status")


@query("""
with s as (select user_id as series_id, event_id as ord, event_type = 'purchase' as kept from events), i as (select *, sum(kept::int) over (partition by series_id order by ord) as island from s)
select series_id, ord, case when kept then 0 else count(*) filter (where not kept) over (partition by series_id, island order by ord) end as streak from i
""")
def stream_streaks(t: Tables) -> DataFrame:
    s = event_stream(t).select(F.col("user_id").alias("series_id"), F.col("event_id").alias("ord"), (F.col("event_type") == "purchase").cast("int").alias("kept"))
    return run(t, live.streaks(s)).select("series_id", "ord", "streak")


@query("""
with o as (select user_id as episode_id, event_id as step, case when event_type <> 'error' then floor(value / 20)::int end as life, floor(value)::int as cost from events),
d as (select *, greatest(last_value(life ignore nulls) over (partition by episode_id order by step rows between unbounded preceding and 1 preceding) - life, 0) as drop from o)
select episode_id, step, 'leak' as name, (-10.0 * drop)::double as delta from d where drop > 0 union all select episode_id, step, 'overcost', -0.5::double from d where cost >= 99
""")
def stream_reward(t: Tables) -> DataFrame:
    o = event_stream(t).select(F.col("user_id").alias("episode_id"), F.col("event_id").alias("step"), F.when(F.col("event_type") != "error", F.floor(F.col("value") / 20).cast("double")).alias("life"), F.floor("value").cast("int").alias("cost"), F.lit(99).alias("cost_limit"), F.lit(0.5).alias("dt_sec"))
    return run(t, live.reward_stream(o))


@query("""
with r as (select user_id as series_id, event_id as ord, row_number() over (partition by user_id order by event_id) as n, min(event_id) over (partition by user_id order by event_id rows between 15 preceding and current row) as oldest from events)
select series_id, ord, least(n, 16) as n_recent, oldest from r
""")
def stream_last_frames(t: Tables) -> DataFrame:
    f = event_stream(t).select(F.col("user_id").alias("series_id"), F.col("event_id").alias("ord"))
    return run(t, live.last_frames(f)).select("series_id", "ord", F.size("recent").cast("long").alias("n_recent"), F.get("recent", F.lit(0)).alias("oldest"))


@query("""
with s as (select user_id as series_id, event_id as ord, value, max((event_type = 'purchase')::int) over (partition by user_id order by event_id) as sure from events)
select series_id, ord, 'boss' as enemy, case when value >= 60 then 5 else 2 end as count, case when sure = 1 then 'cv' else 'estimated' end as source from s where value >= 6
""")
def stream_presence(t: Tables) -> DataFrame:
    """A plan of one enemy at 6 and 60 seconds; a purchase confirms it for good."""
    plan = t.spark.createDataFrame([("s", 6.0, "boss", 2, "estimated"), ("s", 60.0, "boss", 3, "estimated")], "stage_id string, expected_sec double, enemy string, count int, source string")
    s = event_stream(t).select(F.col("user_id").alias("series_id"), F.lit("s").alias("stage_id"), F.col("event_id").alias("ord"), F.col("value").alias("elapsed"), F.when(F.col("event_type") == "purchase", F.array(F.lit("boss"))).otherwise(F.array().cast("array<string>")).alias("seen"))
    return run(t, live.presence_stream(s, plan))


@query("select event_id % 1000 as id, max(event_id) as batch from events group by 1")
def stream_dedup_upsert(t: Tables) -> DataFrame:
    """Micro-batches upserted into a table in buckets."""
    from plinth.sources.writers import read_table

    out = scratch(t)
    rows = event_stream(t).select((F.col("event_id") % 1000).alias("id"), F.col("event_id").alias("batch"))
    live.upsert_stream(rows, f"{out}/table", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    return read_table(t.spark, f"{out}/table").select("id", "batch")


@query("select 'stabiliser' as what, count(*) as n from events union all select 'streaks', count(*) from events")
def stream_equals_batch(t: Tables) -> DataFrame:
    """How many rows of two streams equal those of their batch twins: all of them."""
    a = run(t, live.stabilised(event_stream(t).select(F.col("user_id").alias("series_id"), F.col("event_id").alias("ord"), F.floor("value").cast("double").alias("value"), F.lit(0.9).alias("confidence"))))
    b = timeline.stabilise(t.events.select(F.col("user_id").alias("series_id"), F.col("event_id").alias("ts"), F.floor("value").cast("int").alias("value"), F.lit(0.9).alias("confidence"))).withColumnRenamed("ts", "ord")
    same = a.join(b, ["series_id", "ord", "value", "status"]).agg(F.count("*").alias("n")).select(F.lit("stabiliser").alias("what"), "n")
    steps = F.col("user_id").alias("series_id"), F.col("event_id").alias("ord"), (F.col("event_type") == "purchase").cast("int").alias("kept")
    c = run(t, live.streaks(event_stream(t).select(*steps)))
    d = episodes.noop_streaks(t.events.select(*steps).withColumnRenamed("ord", "ts")).withColumnRenamed("ts", "ord")
    return same.unionByName(c.join(d, ["series_id", "ord", "streak"]).agg(F.count("*").alias("n")).select(F.lit("streaks").alias("what"), "n"))


@query("""
with e as (select user_id as series_id, ts, lag(ts) over (partition by user_id order by ts) as before from events),
s as (select *, sum((before is null or ts - before > interval 1 hour)::int) over (partition by series_id order by ts rows unbounded preceding) as session from e),
c as (select series_id, session, count(*) as n, max(ts) as last from s group by all)
select series_id, n, epoch_us(last) // 1000 as last_ms from c where epoch_us(last) + 3600000000 <= (select epoch_us(max(ts)) // 1000 * 1000 from events) - 600000000
""")
def stream_silences(t: Tables) -> DataFrame:
    """Users who had no event for an hour: event-time timers, as far as the watermark of the whole table comes (the last event, in whole milliseconds, less ten
    minutes)."""
    return run(t, live.silences(event_stream(t).select(F.col("user_id").alias("series_id"), F.col("ts").cast("timestamp").alias("ts")), 3_600_000))


@query("""
with r as (select event_id % 5000 as id, max({'n': event_id // 7 % 3, 'batch': event_id}) as last from events group by 1)
select id, last.batch as batch, 'v' || last.batch % 10 as value from r
""")
def upsert_in_buckets(t: Tables) -> DataFrame:
    """Three micro-batches, one of them twice; the later batch wins, inside one the later event. Only the folders that a batch falls into are written anew."""
    from plinth.sources import writers

    base = f"{scratch(t)}/table"
    rows = t.events.select((F.col("event_id") % 5000).alias("id"), F.col("event_id").alias("batch"), F.concat(F.lit("v"), (F.col("event_id") % 10).cast("string")).alias("value"))
    for n in (0, 1, 1, 2):
        writers.upsert(t.spark, base, rows.filter(F.pmod(F.floor(F.col("batch") / 7), F.lit(3)) == n), batch=n)
    return writers.read_table(t.spark, base).select("id", "batch", "value")


@query("""
with c as (select conv_id, turn, conv_id % 16 as part, (conv_id * 31 + turn) % 11 = 0 as bad, row_number() over (partition by conv_id % 16 order by conv_id, turn) as line from conversations)
select part, conv_id, turn, line from c where bad
""")
def jsonl_bad_lines(t: Tables) -> DataFrame:
    """Conversations as JSON lines in files by conversation, one in eleven cut off: the bad lines with their numbers."""
    from plinth.sources import readers

    out = f"{scratch(t)}/lines"
    cut_off = F.concat(F.lit('{"conv_id": '), "conv_id", F.lit(', "turn": '), "turn")
    value = F.when((F.col("conv_id") * 31 + F.col("turn")) % 11 == 0, cut_off).otherwise(F.to_json(F.struct("conv_id", "turn", "role", "text")))
    rows = t.conversations.select(F.pmod("conv_id", F.lit(16)).alias("part"), "conv_id", "turn", value.alias("value"))
    rows.repartition("part").sortWithinPartitions("part", "conv_id", "turn").select("part", "value").write.partitionBy("part").text(out)
    found = readers.bad_lines(t.spark, out, "conv_id long, turn long, role string, text string")
    n = lambda i: F.regexp_extract("value", r"^\{.conv_id.: (\d+), .turn.: (\d+)$", i).cast("long")
    return found.select((n(1) % 16).alias("part"), n(1).alias("conv_id"), n(2).alias("turn"), "line")


@query("select count(*) as files, count(*) as entities, true as same from customer")
def entity_files(t: Tables) -> DataFrame:
    """A JSON file for each customer, by market segment, read back: as many files as customers, with the same rows."""
    from plinth.sources import readers, writers

    out = f"{scratch(t)}/entities"
    rows = t.customer.select("c_custkey", F.col("c_name").alias("title"), F.col("c_mktsegment").alias("category"))
    n = writers.write_entity_files(rows, out)
    read = F.from_json("json", "c_custkey long, title string, category string").alias("r")
    back = readers.entity_files(t.spark, out).select(read, F.struct("folder", "name").alias("file")).select("r.*", "file")
    same = back.join(rows.withColumnRenamed("c_custkey", "k"), (F.col("c_custkey") == F.col("k")) & (back.title == rows.title) & (back.category == rows.category), "left_semi").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))
    return same.select("files", F.lit(n).cast("long").alias("entities"), (F.col("n") == n).alias("same"))
