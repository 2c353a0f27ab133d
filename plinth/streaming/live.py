"""Streams: latest frame, last frames, stabilised readings, no-op streaks, rewards, spawn presence, silent keys, upserts.

Stateful ones are processors of transformWithState with one small state a key, never a history: a value (the last reading, a streak, the last life), a list (the last
frames) or a map (confirmed names), kept in RocksDB, so states may outgrow the memory. Rows of a micro-batch are put in time order by the processor, since Spark keeps
none inside a key. With silent_ms the state of keys that fall silent that long ends: values and lists by a timer, which every batch of the key puts off, map entries by
their own time to live. Such a query always has a next batch to run, so it suits unbounded streams, not availableNow.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LAST, LATE = 16, "10 minutes"


def latest(frames: DataFrame, key: str = "user_id", ts: str = "ts", columns: list[str] | None = None) -> DataFrame:
    """key, frame (the last by time), n (frames so far). The same plan serves streams (update or complete mode) and tables."""
    cols = columns or [c for c in frames.columns if c != key]
    return frames.groupBy(key).agg(F.max_by(F.struct(*cols), ts).alias("frame"), F.count("*").alias("n"))


def deduplicated(frames: DataFrame, key: str, ts: str = "ts", late: str = LATE) -> DataFrame:
    """The first row of each key inside the watermark; later ones and late data are dropped, so the state stays bounded."""
    return frames.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that transformWithState needs, for the session's streams that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Processor(StatefulProcessor):
    """Folds each key's rows in time order; step(state, row) gives (state, output tuples). The state is a tuple in a value state."""

    def __init__(self, order: str, step: Callable, start: tuple, names: list[str], schema: str, silent_ms: int | None) -> None:
        self.order, self.step, self.start, self.names, self.schema, self.silent_ms = order, step, start, names, schema, silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)
        self.due = handle.getValueState("due", "at long") if self.silent_ms else None

    def load(self) -> tuple:
        return tuple(self.state.get()) if self.state.exists() else self.start

    def store(self, before: tuple, now: tuple) -> None:
        self.state.update(now)

    def end(self) -> None:
        self.state.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = now = self.load()
        found = []
        for r in pd.concat(list(rows)).sort_values(self.order, kind="stable").itertuples(index=False):
            now, got = self.step(now, r)
            found += [(*key, *x) for x in got]
        self.store(before, now)
        if self.due is not None:
            if self.due.exists():
                self.handle.deleteTimer(self.due.get()[0])
            at = int(time.time() * 1000) + self.silent_ms
            self.handle.registerTimer(at)
            self.due.update((at,))
        yield pd.DataFrame(found, columns=self.names)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.end()
        self.due.clear()
        yield pd.DataFrame([], columns=self.names)

    def close(self) -> None:
        pass


class _ListProcessor(_Processor):
    """The state is (a list,), in a list state: rows that only come to its end are appended, else it is written anew."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.items = handle.getListState("items", self.schema)

    def load(self) -> tuple:
        return ([x[0] for x in self.items.get()],)

    def store(self, before: tuple, now: tuple) -> None:
        old, new = before[0], now[0]
        if new[: len(old)] == old:
            if len(new) > len(old):
                self.items.appendList([(x,) for x in new[len(old) :]])
        else:
            self.items.put([(x,) for x in new])

    def end(self) -> None:
        self.items.clear()


class _SetProcessor(_Processor):
    """The state is (a sorted list of names,), in a map state: only new names are written. With silent_ms each name lives that long after it was last seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.due, self.silent_after, self.silent_ms = None, self.silent_ms, None
        self.known = handle.getMapState("known", "name string", "at long", self.silent_after)

    def load(self) -> tuple:
        return (sorted(x[0] for x in self.known.keys()),)

    def store(self, before: tuple, now: tuple) -> None:
        at = int(time.time() * 1000)
        for name in set(now[0]) if self.silent_after else set(now[0]) - set(before[0]):
            self.known.updateValue((name,), (at,))


def _stateful(rows: DataFrame, key: str, order: str, step: Callable, start: tuple, out: str, state: str, silent_ms: int | None = None, kind: type[_Processor] = _Processor) -> DataFrame:
    names = [c.strip().split(" ")[0] for c in out.split(", ")]
    use_rocksdb(rows.sparkSession)
    return rows.groupBy(key).transformWithStateInPandas(kind(order, step, start, names, state, silent_ms), out, "append", "ProcessingTime" if silent_ms else "None")


def _null(x) -> bool:
    return x is None or x != x


def stabilised(readings: DataFrame, jump: int = 10, low: float = 0.4, silent_ms: int | None = None) -> DataFrame:
    """The stream twin of timeline.stabilise. readings: series_id long, ts, value, confidence, ord (orders the rows). State: the last reading."""

    def step(state, r):
        (last, known) = state
        if _null(r.value):
            return state, [(int(r.ord), int(last) if known else 0, "missing", 0.0)]
        odd = known and (r.value < last or r.value - last > jump)
        return (int(r.value), True), [(int(r.ord), int(r.value), "uncertain" if odd else "ok", min(float(r.confidence), low) if odd else float(r.confidence))]

    return _stateful(readings, "series_id", "ord", step, (0, False), "series_id long, ord long, value long, status string, confidence double", "last long, known boolean", silent_ms)


def streaks(steps: DataFrame, threshold: int = 3, silent_ms: int | None = None) -> DataFrame:
    """The stream twin of episodes.noop_streaks. steps: series_id long, ord, kept. State: the streak."""

    def step(state, r):
        n = 0 if r.kept > 0 else state[0] + 1
        return (n,), [(int(r.ord), n, n >= threshold)]

    return _stateful(steps, "series_id", "ord", step, (0,), "series_id long, ord long, streak long, flagged boolean", "n long", silent_ms)


def reward_stream(observations: DataFrame, leak: float = 10.0, overcost: float = 1.0, silent_ms: int | None = None) -> DataFrame:
    """The stream twin of episodes.reward_items. observations: episode_id long, step, life, cost, cost_limit, dt_sec. State: the last life."""

    def step(state, r):
        last, known = state
        out = []
        if not _null(r.life):
            if known and r.life < last:
                out.append((int(r.step), "leak", round(-leak * (last - r.life), 3)))
            last, known = int(r.life), True
        if not _null(r.dt_sec) and r.dt_sec > 0 and not _null(r.cost) and not _null(r.cost_limit) and r.cost >= r.cost_limit:
            out.append((int(r.step), "overcost", round(-overcost * r.dt_sec, 3)))
        return (last, known), out

    return _stateful(observations, "episode_id", "step", step, (0, False), "episode_id long, step long, name string, delta double", "last long, known boolean", silent_ms)


def last_frames(frames: DataFrame, size: int = LAST, silent_ms: int | None = None) -> DataFrame:
    """series_id, ord, recent: after each row the last `size` rows' ords, oldest first. State: that list. frames: series_id long, ord."""

    def step(state, r):
        recent = [*state[0], int(r.ord)][-size:]
        return (recent,), [(int(r.ord), recent)]

    return _stateful(frames, "series_id", "ord", step, ([],), "series_id long, ord long, recent array<long>", "ord long", silent_ms, _ListProcessor)


def presence_stream(states: DataFrame, plan: DataFrame, silent_ms: int | None = None) -> DataFrame:
    """series_id, ord, enemy, count, source after each state: entries expected by then, cv once a detection confirmed the enemy (it sticks). A static join gives each row its stage's plan as one array; State: the confirmed names.
    states: series_id long, stage_id, ord, elapsed, seen (array of names); plan: stage_id, expected_sec, enemy, count, source."""
    per = plan.groupBy("stage_id").agg(F.collect_list(F.struct("expected_sec", "enemy", "count", "source")).alias("plan"))
    joined = states.join(per, "stage_id").select("series_id", "ord", "elapsed", "seen", "plan")

    def step(state, r):
        sure = sorted({*state[0], *(r.seen if r.seen is not None else [])})
        counts: dict[str, list] = {}
        for e in sorted(r.plan, key=lambda e: e["expected_sec"]):
            if e["expected_sec"] <= r.elapsed:
                have = counts.setdefault(e["enemy"], [0, ""])
                have[0] += int(e["count"])
                have[1] = e["source"]
        return (sure,), [(int(r.ord), k, n, "cv" if k in sure else s) for k, (n, s) in sorted(counts.items())]

    return _stateful(joined, "series_id", "ord", step, ([],), "series_id long, ord long, enemy string, count long, source string", "name string", silent_ms, _SetProcessor)


def fan_out(frames: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str):
    """One query that hands each micro-batch to several sinks; the batch is kept while they run, so the source is read once."""

    def each(batch: DataFrame, n: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, n)
        finally:
            batch.unpersist()

    return frames.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def tail_jsonl(spark, path: str, schema: str, files: int = 100) -> DataFrame:
    """A stream of JSON lines from files as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


class _Silence(StatefulProcessor):
    """A value state (rows and last time, in microseconds) and an event-time timer that each later row puts off."""

    def __init__(self, gap_ms: int) -> None:
        self.gap = 1000 * gap_ms

    def timer(self, last: int) -> int:
        """The first whole millisecond, as watermarks have, by which the gap has passed."""
        return -(-(last + self.gap) // 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", "n long, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, last = self.state.get() if self.state.exists() else (0, None)
        before, ended = last, []
        for at in sorted(int(x) for r in rows for x in r.at_us):
            if last is not None and at - last > self.gap:
                ended.append((*key, n, last // 1000))
                n = 0
            n, last = n + 1, at if last is None else max(at, last)
        if last != before:
            if before is not None:
                self.handle.deleteTimer(self.timer(before))
            self.handle.registerTimer(self.timer(last))
        self.state.update((n, last))
        yield pd.DataFrame(ended, columns=["series_id", "n", "last_ms"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, last = self.state.get()
        self.state.clear()
        yield pd.DataFrame([(*key, n, last // 1000)], columns=["series_id", "n", "last_ms"])

    def close(self) -> None:
        pass


def silences(frames: DataFrame, gap_ms: int, late: str = LATE) -> DataFrame:
    """series_id, n (rows since it was last silent), last_ms: a row whenever a key has had none for gap_ms of event time. frames: series_id long, ts (a timestamp)."""
    use_rocksdb(frames.sparkSession)
    timed = frames.withWatermark("ts", late).select("series_id", "ts", F.unix_micros("ts").alias("at_us"))
    return timed.groupBy("series_id").transformWithStateInPandas(_Silence(gap_ms), "series_id long, n long, last_ms long", "append", "EventTime")


def upsert_stream(rows: DataFrame, base: str, checkpoint: str, key: str = "id", writer: str = "stream"):
    """Upserts each micro-batch into the table under base; a batch that is repeated after a failure changes nothing."""
    from plinth.sources.writers import upsert

    return rows.writeStream.foreachBatch(lambda batch, n: upsert(batch.sparkSession, base, batch, key, batch=n, writer=writer) and None).option("checkpointLocation", checkpoint)
