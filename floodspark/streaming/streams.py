"""Structured Streaming forms of the batch operators.

Each takes a streaming DataFrame and returns one, with watermarks that bound its state; run() writes
one to files until the input that is there is done.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from floodspark.operators.alerts import TEXTS
from floodspark.operators.kept import shared_folder
from floodspark.operators.series import _direction


def folder(spark: SparkSession) -> str:
    """A new folder under the one that driver and executors share."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def keyed_state(spark: SparkSession) -> None:
    """Names the state store that state of several variables and timers needs, for the streams that start from here on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").parquet(f"{path}*")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The rows that a stream gives for the input there is, from the files it wrote.

    Each batch has a folder of its own, which a repeated batch writes anew, so that none counts twice. In
    update mode a key may have a row for each batch; in complete mode only the last batch's rows count.
    """
    spark, to = stream.sparkSession, folder(stream.sparkSession)
    done: list[str] = []

    def put(rows: DataFrame, batch: int) -> None:
        path = f"{to}/rows/batch={batch}"
        rows.write.mode("overwrite").parquet(path)
        if mode == "complete":
            done.clear()
        done.append(path)

    q = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{to}/progress").foreachBatch(put)
    q.start().awaitTermination()
    paths = list(dict.fromkeys(done))
    return spark.read.schema(stream.schema).parquet(*paths) if paths else spark.createDataFrame([], stream.schema)


def latest(stream: DataFrame) -> DataFrame:
    """The newest reading of each gauge once the input there is has been read: a later batch replaces only by a newer reading."""
    spark, to = stream.sparkSession, folder(stream.sparkSession)
    once = stream.withWatermark("ts", "6 hours").dropDuplicatesWithinWatermark(["user_id", "ts"])
    last: list[str] = []

    def merge(rows: DataFrame, batch: int) -> None:
        new = rows.select("user_id", "ts", "value")
        before = [p for p in last if p != f"{to}/{batch}"]
        if before:
            new = new.unionByName(spark.read.parquet(before[-1]))
        best = new.groupBy("user_id").agg(F.max_by(F.struct("ts", "value"), "ts").alias("r")).select("user_id", "r.*")
        best.write.mode("overwrite").parquet(f"{to}/{batch}")
        last[:] = [*before[-1:], f"{to}/{batch}"]

    once.writeStream.foreachBatch(merge).option("checkpointLocation", f"{to}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(last[-1]) if last else once.select("user_id", "ts", "value")


def late_days(stream: DataFrame, rollup: DataFrame, raw: DataFrame, today: str) -> DataFrame:
    """rollup after late events: each past day that a batch brings events of is recomputed from raw and replaces its row.

    Days are partitions, and a batch overwrites only those that it touches.
    """
    spark, to = stream.sparkSession, folder(stream.sparkSession)
    rollup.write.partitionBy("day").parquet(f"{to}/days")

    def repair(rows: DataFrame, batch: int) -> None:
        days = rows.select(F.date_format("ts", "yyyy-MM-dd").alias("day")).filter(F.col("day") < today).distinct()
        # As literals, so that raw by days reads no others; a batch of files brings few days.
        again = raw.filter(F.col("day").isin([r.day for r in days.collect()])).groupBy("day").agg(*counts_of_day())
        again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{to}/days")

    stream.writeStream.foreachBatch(repair).option("checkpointLocation", f"{to}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rollup.schema).parquet(f"{to}/days").select(*rollup.columns)


def visit_batches(stream: DataFrame, most: int = 20) -> DataFrame:
    """Flushed batches (visitor, at, events of type and gauge_id) to single events, which share the batch's visitor; at most so many of a batch count."""
    return stream.select("visitor", "at", F.posexplode(F.slice("events", 1, most)).alias("pos", "e")).select("visitor", "at", "pos", "e.*")


def day_rollup(stream: DataFrame) -> DataFrame:
    """Closed days only: day, visitors (distinct), pageviews of each visitor's first event kept apart by the first dedupe."""
    day = stream.withWatermark("ts", "1 day").withColumn("day", F.to_date("ts"))
    return (
        day.dropDuplicatesWithinWatermark(["day", "user_id"])
        .groupBy(F.window("ts", "1 day"))
        .agg(F.count("*").alias("visitors"))
        .select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "visitors")
    )


def counts_of_day() -> list:
    return [F.count_if(F.col("event_type") == "view").alias("pageviews"), F.count_if(F.col("event_type") == "click").alias("opens")]


def day_counts(stream: DataFrame) -> DataFrame:
    """Closed days only: day, pageviews, opens."""
    return (
        stream.withWatermark("ts", "1 day")
        .groupBy(F.window("ts", "1 day"))
        .agg(*counts_of_day())
        .select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "pageviews", "opens")
    )


def trends(stream: DataFrame, span: str = "3 hours", slide: str = "15 minutes") -> DataFrame:
    """Slope of each gauge over sliding windows: gauge_id, until, rate, direction, n."""
    h = F.unix_seconds("ts") / 3600.0 - 473_352.0  # hours since 2024
    g = (
        stream.filter("value > -100")
        .withWatermark("ts", "1 day")
        .groupBy("user_id", F.window("ts", span, slide))
        .agg(F.regr_slope("value", h).alias("slope"), F.count("*").alias("n"), (F.max(F.unix_seconds("ts")) - F.min(F.unix_seconds("ts"))).alias("span"))
    )
    rate, direction = _direction(F.col("slope"), F.col("n"), F.col("span"))
    return g.select(F.col("user_id").alias("gauge_id"), F.col("window.end").alias("until"), rate.alias("rate"), direction.alias("direction"), "n")


class _Rise(StatefulProcessor):
    """A gauge's last readings, and whether it rises quickly: (open, time of the last reading)."""

    def __init__(self, hours: float, least: float, silence_s: int) -> None:
        self.span, self.least, self.silence = int(hours * 3600), least, silence_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.readings = handle.getListState("readings", "t long, v double")
        self.flag = handle.getValueState("flag", "open boolean, last long")

    def _rows(self, key: tuple, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            out = pd.DataFrame([(int(key[0]), *r) for r in rows], columns=["gauge_id", "state", "at", "event_id", "rate"])
            out["at"] = pd.to_datetime(out["at"], unit="s", utc=True)
            yield out.astype({"event_id": "Int64", "rate": "float64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        x = pd.concat([f[["event_id", "ts", "value"]] for f in rows])
        at = x.ts.map(lambda t: int(t.timestamp() // 1)).to_numpy(np.int64)
        order = np.lexsort((x.event_id.to_numpy(), at))
        held = list(self.readings.get()) if self.readings.exists() else []
        t = np.concatenate([np.array([r[0] for r in held], np.int64), at[order]])
        v = np.concatenate([np.array([r[1] for r in held], float), x.value.to_numpy(float)[order]])
        event = np.concatenate([np.full(len(held), -1), x.event_id.to_numpy()[order]])
        by = np.argsort(t, kind="stable")
        t, v, event = t[by], v[by], event[by]
        lo, hi = np.searchsorted(t, t - self.span), np.searchsorted(t, t, "right")
        n = hi - lo
        # About the middle, so that sums of squares keep their digits.
        h, y = (t - t.mean()) / 3600, v - v.mean()
        sx, sy, sxy, sxx = ((c := np.concatenate([[0.0], np.cumsum(z)]))[hi] - c[lo] for z in (h, y, h * y, h * h))
        with np.errstate(divide="ignore", invalid="ignore"):
            rate = (sxy - sx * sy / n) / (sxx - sx * sx / n)
        hit = (n >= 4) & (t - t[lo] >= 5400) & (rate >= self.least)
        open_, last = self.flag.get() if self.flag.exists() else (False, -1)
        out = []
        for i in np.flatnonzero((event >= 0) & (t >= last)):
            if open_ and t[i] - last >= self.silence:
                out.append(("clear", last + self.silence, None, None))
                open_ = False
            if hit[i] != open_:
                open_ = bool(hit[i])
                out.append(("open" if open_ else "clear", int(t[i]), int(event[i]), float(rate[i])))
            last = int(t[i])
        self.flag.update((open_, last))
        keep = t >= last - self.span
        self.readings.put([(int(a), float(b)) for a, b in zip(t[keep], v[keep])])
        # Once for silence, once for what is held.
        for wait in (self.silence, self.span):
            self.handle.registerTimer((last + wait) * 1000)
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() // 1000
        open_, last = self.flag.get() if self.flag.exists() else (False, -1)
        quiet = open_ and now >= last + self.silence
        if quiet:
            self.flag.update((False, last))
            yield from self._rows(key, [("clear", last + self.silence, None, None)])
        if last >= 0 and now >= last + max(self.span, self.silence):
            self.readings.clear()
            self.flag.clear()


def rapid_rise(stream: DataFrame, hours: float = 3, least: float = 1.0, silence_minutes: int = 90, late: str = "1 day") -> DataFrame:
    """When gauges begin to rise quickly and cease to: gauge_id, state (open or clear), at, event_id and rate of the reading that says so.

    A gauge rises quickly while the slope over its last hours is at least least feet an hour; the flag is cleared by a reading
    at which it is not, or after silence_minutes of event time without one. Readings in another unit than feet
    (unit, where the stream has it) do not count. State holds the last hours and goes when event time has left them behind. What
    comes out is the same however the readings, in order of time, fall into batches; a late reading counts in the slopes after it.
    """
    keyed_state(stream.sparkSession)
    feet = F.coalesce(F.lower(F.trim("unit")) == "ft", F.lit(True)) if "unit" in stream.columns else F.lit(True)
    return (
        stream.filter(feet & (F.col("value") > -100))
        .withWatermark("ts", late)
        .groupBy("user_id")
        .transformWithStateInPandas(_Rise(hours, least, silence_minutes * 60), "gauge_id long, state string, at timestamp, event_id long, rate double", "append", "EventTime")
    )


def silent(stream: DataFrame, minutes: int = 90, hours: int = 6) -> DataFrame:
    """Gauges that fall silent: gauge_id, last reading's time and state, "old" after minutes and "no data" after hours of event time."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, stage = state.get
            said = ["old", "no data"][stage:] if state.getCurrentWatermarkMs() >= last + hours * 3_600_000 else ["old"][stage:]
            if "no data" in said:
                state.remove()
            else:
                state.update((last, 1))
                state.setTimeoutTimestamp(max(last + hours * 3_600_000, state.getCurrentWatermarkMs() + 1))
            yield pd.DataFrame({"gauge_id": [key[0]] * len(said), "last": [pd.Timestamp(last, unit="ms", tz="UTC")] * len(said), "state": said})
            return
        newest = max(int(f.ts.max().timestamp() * 1000) for f in frames)
        newest = max(newest, state.get[0]) if state.exists else newest
        state.update((newest, 0))
        state.setTimeoutTimestamp(max(newest + minutes * 60_000, state.getCurrentWatermarkMs() + 1))

    return (
        stream.withWatermark("ts", "0 seconds")
        .groupBy("user_id")
        .applyInPandasWithState(step, "gauge_id long, last timestamp, state string", "last long, stage int", "append", GroupStateTimeout.EventTimeTimeout)
    )


#: What a message keeps in state, and an event has of it.
_MESSAGE = ("id", "event", "level", "ends", "expires", "ugc", "area_desc", "shape", *TEXTS)


class _Events(StatefulProcessor):
    """An event's messages by id, and in one value all that is known of it besides.

    Each call to the store is a round trip, so that a call of the processor reads either once and writes what has changed, and one
    timer waits for whatever happens first. Times are milliseconds.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.messages = handle.getMapState("messages", "id long", "message string")
        # Time of the last cancellation, what was last said, and the timer that waits; -1 for no time.
        self.known = handle.getValueState("known", "gone long, version int, state string, event string, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        known = self.known.get() if self.known.exists() else None
        gone = known[0] if known else -1
        # A key without known state has no messages either.
        held = self._held() if known else {}
        before, new = set(held), {}
        for r in rows:
            sent = r["sent_ms"]
            if r["cancels"] and sent is not None:
                gone = max(gone, sent)
            if r["opens"] and sent is not None:
                m = {c: r[c] for c in _MESSAGE} | {"sent": sent, "ends": r["ends"], "expires": r["expires"], "ugc": r["ugc"] or []}
                until = _until(m)
                if until is None or until > now:
                    new[m["id"]] = m
        yield from self._changed(key, now, gone, held | new, before, new, known)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        gone, version, state, event, _ = self.known.get()
        held = self._held()
        yield from self._changed(key, now, gone, held, set(held), {}, (gone, version, state, event, -1))

    def _held(self) -> dict:
        return {id_: json.loads(text) for (id_,), (text,) in self.messages.iterator()}

    def _changed(self, key, now: int, gone: int, held: dict, before: set, new: dict, known: tuple | None) -> Iterator[Row]:
        _, version, state, event, timer = known or (-1, 0, "", "", -1)
        live, dead = [], []
        for m in held.values():
            until = _until(m)
            (live if m["sent"] > gone and (until is None or until > now) else dead).append(m)
        for m in dead:
            if m["id"] in before:
                self.messages.removeKey((m["id"],))
        for m in live:
            if m["id"] in new:
                self.messages.updateValue((m["id"],), (json.dumps(m),))
        row = None
        if live or state == "open":
            said = "open" if live else "cancelled" if any(m["sent"] <= gone for m in dead) else "over"
            merged = _merged(live) if live else json.loads(event)
            text = json.dumps(merged)
            if (said, text) != (state, event):
                version, state, event = version + 1, said, text
                row = Row(**{"key": key[0], "version": version, "state": state} | merged)
        if 0 <= gone < now:  # what a cancellation could still cancel would be late by now
            gone = -1
        wait = min([t for t in map(_until, live) if t is not None] + ([gone + 1] if gone >= 0 else []), default=-1)
        # A timer that comes too early finds nothing to say and waits on.
        if wait >= 0 and (timer < 0 or wait < timer):
            self.handle.registerTimer(wait)
            timer = wait
        if (gone, version, state, event, timer) != known:
            self.known.update((gone, version, state, event, timer))
        if row:
            yield row


#: An event's columns; the times among them are milliseconds until they leave the stream.
EVENT = "key string, version int, state string, id long, event string, level string, sent long, ends long, expires long, n long, ugc array<string>, area_desc string, shape string, " + ", ".join(
    f"{c} {'long' if c == 'effective' else 'string'}" for c in TEXTS
)
_TIMES = ("sent", "ends", "expires", "effective")


def _until(m: dict) -> int | None:
    return m["expires"] if m["ends"] is None else m["ends"]


def _merged(live: list[dict]) -> dict:
    """operators.alerts.merge_events() for the messages of one event."""
    order = sorted(live, key=lambda m: (-m["sent"], m["id"]))
    last = lambda c: max((m[c] for m in order if m[c] is not None), default=None)
    areas = [a.strip(" ") for m in order for a in (m["area_desc"] or "").split(";")]
    first = order[0]
    return {c: first[c] for c in ("id", "event", "level", "sent", *TEXTS)} | {
        "ends": last("ends"), "expires": last("expires"), "n": len(order), "ugc": list(dict.fromkeys(c for m in order for c in m["ugc"])),
        "area_desc": "; ".join(dict.fromkeys(a for a in areas if a)), "shape": next((m["shape"] for m in order if m["shape"]), None),
    }


def alert_events(stream: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Messages (key, id, sent, ends, expires, event, level, ugc, area_desc, opens, cancels, and texts and shape where they have them) to events.

    A row comes out whenever an event changes: its key, a version that counts up, its state (open, cancelled, or over) and all that
    merge_events() says of its live messages: those newer than its last cancellation whose own end event time has not passed. A
    cancelled event, and one that is over, keeps what was last said of it; a newer message opens it again. The last version of each key is the same however
    the messages fall into batches, as long as none is later than late. State goes as messages end.
    """
    keyed_state(stream.sparkSession)
    spare = [F.lit(None).cast("timestamp" if c == "effective" else "string").alias(c) for c in (*TEXTS, "shape") if c not in stream.columns]
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp")).alias("sent_ms" if c == "sent" else c)
    x = stream.select("*", *spare)
    plain = [c for c in ("key", *_MESSAGE, "opens", "cancels") if c not in _TIMES]
    events = (
        x.select(*plain, "sent", *map(ms, _TIMES))
        .withWatermark("sent", late)
        .groupBy("key")
        .transformWithState(_Events(), EVENT, "append", "EventTime")
    )
    return events.withColumns({c: F.timestamp_millis(c) for c in _TIMES})


def last_versions(events: DataFrame) -> DataFrame:
    """The last row of each event."""
    rest = [c for c in events.columns if c != "key"]
    return events.groupBy("key").agg(F.max_by(F.struct(*rest), "version").alias("r")).select("key", "r.*")
