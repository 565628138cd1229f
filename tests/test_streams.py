"""Streams fed in one, several and many batches: what comes out does not depend on how the rows fall into batches, and equals the batch form."""

import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from floodspark.operators import alerts, series
from floodspark.streaming import streams as st

START = pd.Timestamp("2024-07-04 00:00:00", tz="UTC")


def stream(spark, rows, schema, batches, to):
    """rows, in order, as a stream that takes one file a batch."""
    to.mkdir()
    size = -(-len(rows) // batches)
    for i in range(batches):
        part = spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1)
        part.write.parquet(str(to / f"x{i}"))
        (file,) = (to / f"x{i}").glob("*.parquet")
        file.rename(to / f"{i:03d}.parquet")
        os.utime(to / f"{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(to / "*.parquet"))


READING = "event_id long, user_id long, event_type string, ts timestamp, value double, unit string"


def readings():
    """Three gauges every 15 minutes for 30 hours, with quick rises, silences, sentinels, and one gauge in metres."""
    rng, rows = random.Random(4), []
    for g in (1, 2, 3, 4):
        v = 5.0
        for i in range(120):
            if g < 4 and (g * 31 + i // 9) % 5 == 0:
                continue  # silent for over two hours
            v += rng.choice([0.0, 0.02, -0.02]) + (0.6 if (i // 10 + g) % 4 == 0 else -0.15)
            rows.append((START + pd.Timedelta(minutes=15 * i + g), g, -999.0 if rng.random() < 0.03 else round(v, 2), "m" if g == 4 else "ft"))
    rows.sort()
    return [(i, g, ("view", "click")[i % 2], t.to_pydatetime(), v, u) for i, (t, g, v, u) in enumerate(rows)]


def rises(rows, silence=5400):
    """Changes of the flag, reading by reading."""
    out, by = [], {}
    for e, g, _, t, v, u in rows:
        if v > -100 and u == "ft":
            by.setdefault(g, []).append((int(t.timestamp()), v, e))
    mark = max(x[0] for r in by.values() for x in r) - 86400
    for g, r in by.items():
        open_, last = False, None
        for t, _, e in r:
            if open_ and t - last >= silence:
                out.append((g, "clear", last + silence, None))
                open_ = False
            near = [(a, b) for a, b, _ in r if t - 10800 <= a <= t]
            rate = None
            if len(near) >= 4 and t - near[0][0] >= 5400:
                mx, my = (sum(c) / len(near) for c in zip(*near))
                rate = sum((a - mx) * (b - my) for a, b in near) / sum((a - mx) ** 2 for a, _ in near) * 3600
            now = rate is not None and rate >= 1
            if now != open_:
                out.append((g, "open" if now else "clear", t, e))
            open_, last = now, t
        if open_ and last + silence <= mark:
            out.append((g, "clear", last + silence, None))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_quick_rises(spark, tmp_path, batches):
    rows = readings()
    got = st.run(st.rapid_rise(stream(spark, rows, READING, batches, tmp_path / "in"))).collect()
    want = rises(rows)
    assert sorted(((r.gauge_id, r.state, int(r["at"].timestamp()), r.event_id) for r in got), key=str) == want
    assert {x[1] for x in want} == {"open", "clear"} and any(x[3] is None for x in want)
    # The flag after the last reading is what the batch form says of it.
    replay = series.trend_replay(spark.createDataFrame([(r[1], r[0], r[3], r[4]) for r in rows if r[5] == "ft"], "gauge_id long, pos long, t timestamp, v double").withColumn("t", F.col("t").cast("timestamp_ntz")))
    last = replay.groupBy("gauge_id").agg(F.max_by(F.coalesce((F.col("direction") == "rising") & (F.col("rate") >= 1), F.lit(False)), F.struct("t", "pos")).alias("flag"))
    flags = {r.gauge_id: r.flag for r in last.collect()}
    seen = {}
    for r in sorted(got, key=lambda r: (r["at"], r.event_id or 0)):
        seen[r.gauge_id] = r.state
    newest = {r[1]: r[3].timestamp() for r in rows if r[5] == "ft" and r[4] > -100}
    quiet = {r.gauge_id for r in got if r.event_id is None and r["at"].timestamp() > newest[r.gauge_id]}
    assert all((seen.get(g) == "open") == (flag and g not in quiet) for g, flag in flags.items())


@pytest.mark.parametrize("batches", [1, 4])
def test_newest_readings_days_and_late_days(spark, tmp_path, batches):
    rows = readings()
    rows = rows + rows[-40:-20]  # a repeated stretch
    frame = spark.createDataFrame(rows, READING)
    newest = {r[1]: (r[3], r[4]) for r in rows if r[0] == max(x[0] for x in rows if x[1] == r[1])}
    got = {r.user_id: (r.ts, r.value) for r in st.latest(stream(spark, rows, READING, batches, tmp_path / "a")).collect()}
    assert {g: x[1] for g, x in got.items()} == {g: x[1] for g, x in newest.items()} and len(got) == 4
    raw = frame.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    whole = {r.day: (r.pageviews, r.opens) for r in raw.groupBy("day").agg(*st.counts_of_day()).collect()}
    early = raw.filter("event_type = 'view'").groupBy("day").agg(*st.counts_of_day())
    late = [r for r in rows if r[2] == "click"]
    fixed = st.late_days(stream(spark, late, READING, batches, tmp_path / "b"), early, raw, "2024-07-05")
    assert {r.day: (r.pageviews, r.opens) for r in fixed.collect()} == {d: x if d < "2024-07-05" else (x[0], 0) for d, x in whole.items()}


MESSAGE = (
    "id long, cap_id string, vtec string, event string, status string, message_type string, sent timestamp, ends timestamp, expires timestamp, ugc array<string>, area_desc string, catastrophic boolean, headline string, instruction string"
)


def messages():
    rng, rows = random.Random(8), []
    for i in range(160):
        sent = START + pd.Timedelta(minutes=10 * i)
        action = rng.choice(["NEW", "CON", "CON", "EXT", "CAN", "UPG"])
        ends = rng.choice([None, sent + pd.Timedelta(hours=rng.randrange(1, 30))])
        expires = rng.choice([None, sent + pd.Timedelta(hours=rng.randrange(1, 9))])
        vtec = rng.choice([f"/O.{action}.KEWX.FF.W.{i % 9:04d}.240704T0000Z-240706T0000Z/", None])
        kind = rng.choice([None, "Update", "Cancel"]) if i % 6 == 0 else None
        codes = [f"TXC{rng.randrange(12):03d}" for _ in range(rng.randrange(4))]
        date = lambda t: None if t is None else t.to_pydatetime()
        rows.append((i, f"urn:{i}", vtec, rng.choice(["Flash Flood Warning", "Flood Watch", "Wind Advisory"]), None, kind, date(sent), date(ends), date(expires), codes, "; ".join(f"Area {c[-1]}" for c in codes), i % 7 == 0, f"h{i}", rng.choice([None, f"go {i}"])))
    return rows


def _roles(frame, now):
    x = frame
    for c in ("sent", "ends", "expires"):
        x = x.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return alerts.with_roles(x, F.lit(now).cast("timestamp_ntz"))


def _events(frame):
    at = [F.col(c).cast("timestamp").alias(c) for c in ("sent", "ends", "expires")]
    level = alerts.C.alert_level(F.col("event"), F.col("catastrophic")).alias("level")
    return _roles(frame, "1970-01-01 00:00:00").select("key", "id", *at, "event", level, "ugc", "area_desc", "headline", "instruction", "opens", "cancels")


_KEPT = ["key", "id", "event", "level", "headline", "instruction", "sent", "ends", "expires", "n", "ugc", "area_desc"]


def _rows(df):
    plain = [F.col(c).cast("timestamp_ntz").alias(c) if c in ("sent", "ends", "expires") else F.col(c) for c in _KEPT]
    return sorted(map(repr, df.select(*plain).collect()))


@pytest.mark.parametrize("batches, late, shuffled", [(1, "0 seconds", False), (2, "0 seconds", False), (5, "0 seconds", False), (5, "30 days", True)])
def test_events_of_any_batches_are_the_merged_events(spark, tmp_path, batches, late, shuffled):
    rows = messages()
    given = random.Random(1).sample(rows, len(rows)) if shuffled else rows
    given = given + given[-1:]  # the last one comes twice
    got = st.last_versions(st.run(st.alert_events(_events(stream(spark, given, MESSAGE, batches, tmp_path / "in")), late)))
    mark = max(r[6] for r in rows) if late == "0 seconds" else pd.Timestamp(0)
    flat = _roles(spark.createDataFrame(rows, MESSAGE), str(mark))
    want = alerts.merge_events(alerts.without_cancelled(flat.drop("key", "v", "opens", "cancels").withColumn("polys", F.lit(None).cast("array<array<array<struct<lon:double,lat:double>>>>")), F.lit(str(mark)).cast("timestamp_ntz")))
    assert _rows(got.filter("state = 'open'")) == _rows(want)
    states = {r.state for r in got.collect()}
    assert "open" in states and (batches == 1 or shuffled or "over" in states)
