"""Feed readers on hand-written files."""

import json

import pytest
from pyspark.sql import functions as F

from floodspark.operators import alerts
from floodspark.sources import feeds, sinks, tracks


def files(spark, *bodies, **more):
    return spark.createDataFrame([(b, "x/2024-01-05/a.json", "G", "08167500") for b in bodies], "body string, path string, gauge_id string, site string")


def test_gauge_feed_accepts_array_and_object(spark):
    g = {"lid": "ABCT2", "state": {"abbreviation": "TX"}, "latitude": 30.0, "status": {"observed": {"primary": -999, "primaryUnit": " ", "validTime": "0001-01-01T00:00:00Z"}}}
    other = {"lid": "OKLA2", "state": {"abbreviation": "OK"}}
    got = feeds.gauge_feed(files(spark, json.dumps([g, other]), json.dumps({"gauges": [g]}))).collect()
    assert [(r.gauge_id, r.v, r.t, r.feed_unit) for r in got] == [("ABCT2", -999.0, None, None)] * 2


def test_site_values_and_series(spark):
    body = {"value": {"timeSeries": [{"sourceInfo": {"siteCode": [{"value": "081"}]}, "values": [{"value": [{"dateTime": "2024-01-01T00:00:00-05:00", "value": "1.5"}, {"dateTime": "x", "value": "Ice"}]}]}]}}
    got = feeds.site_values(files(spark, json.dumps(body))).collect()
    assert [(r.site, r.v, r.t and r.t.hour) for r in got] == [("081", 1.5, 5), ("081", None, None)]
    series = {"issuedTime": "0001-01-01T00:00:00Z", "primaryUnits": "ft", "data": [{"validTime": "2024-01-01T00:00:00Z", "primary": 2.0}]}
    r = feeds.series(files(spark, json.dumps(series))).first()
    assert (r.v, r.issued_at, r.unit) == (2.0, None, "ft")


def test_alert_feed_without_features_fails(spark):
    assert feeds.alert_feed(files(spark, '{"features": []}')).count() == 0
    with pytest.raises(Exception, match="without features"):
        feeds.alert_feed(files(spark, '{"title": "down"}')).collect()


def test_peaks_by_header_name(spark):
    body = "# note\nagency\tpeak_dt\tgage_ht\n5s\t10d\t8s\nUSGS\t1998-06\t20.5\nUSGS\t2001-01-02\t\n"
    assert [(r.date, r.stage) for r in feeds.peaks(files(spark, body)).collect()] == [("1998-06", 20.5), ("2001-01-02", None)]


def test_cameras_overrides_track_and_lines(spark):
    cam = [{"camId": "a", "nwisId": "123", "lat": "30.5", "lng": "-97.1", "stateAbrv": "TX"}]
    r = feeds.cameras(files(spark, json.dumps(cam))).first()
    assert (r.site, r.lat, r.lon, r.hidden) == (None, 30.5, -97.1, False)
    assert feeds.overrides(files(spark, '{"byName": {"Lake X": "ABCT2"}}')).collect() == [("Lake X", "ABCT2")]
    got = feeds.track_events(files(spark, '{"type": "pageview"}', '[{"type": "gauge_open"}]')).collect()
    assert [(r.day, r.type) for r in got] == [("2024-01-05", "pageview"), ("2024-01-05", "gauge_open")]
    lines = {"features": [{"properties": {"name": "R"}, "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}}, {"properties": {}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [0, 1], [0, 0]]]}}]}
    got = feeds.waterways(files(spark, json.dumps(lines))).collect()
    assert [(r.kind, len(r.coords)) for r in got] == [("LineString", 2), ("Polygon", 4)]


def test_empty_snapshot_is_refused(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01")], "gauge_id long, snapshot_at string")
    with pytest.raises(ValueError):
        sinks.write_snapshot(rows.limit(0), str(tmp_path))
    sinks.write_snapshot(rows, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/latest").count() == 1


def test_feed_bodies_become_messages_and_events(spark):
    """Lists of VTEC, zones alone, shapes in collections, threats, missing times, cancellations and tests, by the rules one by one."""
    sq = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]
    vtec = lambda action, etn, c="O": f"/{c}.{action}.KEWX.FF.W.{etn:04d}.240704T0000Z-240706T0000Z/"

    def feature(id_, sent, event="Flash Flood Warning", v=None, shape=None, **more):
        params = {"VTEC": v} if v else {}
        params |= {k: more.pop(k) for k in ("flashFloodDamageThreat", "NWSheadline") if k in more}
        return {"id": id_, "geometry": shape, "properties": {"id": id_, "event": event, "sent": sent, "parameters": params, "status": "Actual"} | more}

    features = [
        feature("a", "2024-07-04T01:00:00-05:00", v=["none", vtec("NEW", 1)], geocode={"UGC": ["TXC001", "TXC002", "TXC001"]}, areaDesc="A; B", shape={"type": "Polygon", "coordinates": [sq]}, flashFloodDamageThreat=["catastrophic"], ends="2024-07-06T00:00:00Z"),
        feature("b", "2024-07-04T08:00:00Z", v=[vtec("CON", 1)], affectedZones=["https://x/zones/county/TXC003", "https://x/bad"], areaDesc="B; C", headline=" ", NWSheadline=["WATER RISES"], senderName="NWS X", expires="2024-07-05T00:00:00Z"),
        feature("c", None, event="Flood Watch", effective="2024-07-04T03:00:00Z", shape={"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 2]}, {"type": "MultiPolygon", "coordinates": [[sq]]}]}),
        feature("d", "soon", event="Flood Watch", status="Test"),
        feature("e", "2024-07-04T02:00:00Z", v=[vtec("NEW", 2)]),
        feature("f", "2024-07-04T03:00:00Z", v=[vtec("CAN", 2)], event="Flash Flood Statement"),
        feature("g", "2024-07-04T02:00:00Z", v=[vtec("NEW", 3, "T")]),
        feature("h", "2024-07-04T02:00:00Z", event="Tornado Warning"),
        feature("i", "2024-07-04", event="Flood Advisory", ends="2024-07-04T00:00:00Z"),
    ]
    bodies = spark.createDataFrame([(0, json.dumps({"type": "FeatureCollection", "features": features}))], "number long, body string")
    now = F.lit("2024-07-04 12:00:00").cast("timestamp_ntz")
    m = feeds.alert_messages(feeds.alert_feed(bodies), now)
    got = {r.cap_id: r for r in m.collect()}
    assert [got[k].id for k in "abc"] == [0, 1, 2]
    assert (got["a"].vtec, got["a"].ugc, got["a"].catastrophic, str(got["a"].sent)) == (vtec("NEW", 1), ["TXC001", "TXC002"], True, "2024-07-04 06:00:00")
    assert (got["b"].ugc, got["b"].headline, got["b"].sender_name, got["b"].polys) == (["TXC003"], "WATER RISES", "NWS X", None)
    assert str(got["c"].sent) == "2024-07-04 03:00:00" and len(got["c"].polys) == 1 and str(got["d"].sent) == "2024-07-04 12:00:00" and str(got["i"].sent) == "2024-07-04 12:00:00"
    assert got["c"].web == "https://www.weather.gov/alerts" and got["a"].web == "https://www.weather.gov/ewx/"
    e = {r.key: r for r in alerts.merge_events(alerts.without_cancelled(m, now)).collect()}
    assert e.keys() == {"KEWX.FF.W.0001", "c"}
    one = e["KEWX.FF.W.0001"]
    assert (one.id, one.level, one.headline, one.n, one.ugc, one.area_desc, one.sender_name) == (1, "flash", "WATER RISES", 2, ["TXC003", "TXC001", "TXC002"], "B; C; A", "NWS X")
    assert (str(one.ends), str(one.expires), len(one.own_polys)) == ("2024-07-06 00:00:00", "2024-07-05 00:00:00", 1)
    with pytest.raises(Exception, match="without features"):
        feeds.alert_feed(spark.createDataFrame([("<html>",)], "body string")).collect()


def test_body_kinds(spark):
    good = '{"alerts":[{"id":"a","event":"e","ugc":["x"]}],"updatedAt":null,"ok":true}'
    cases = [
        (good, "alerts", None), (good.replace("null", '"2024"'), "alerts", None), (good.replace("null", "5"), None, "another shape"), (good.replace("true", '"yes"'), None, "another shape"),
        (good.replace('["x"]', '"x"'), None, "another shape"), ('{"gauges":{"A":1},"updatedAt":"t"}', "processed", None), ('{"gauges":[1],"updatedAt":"t"}', "list", None), ("[]", "list", None),
        ('{"gauges":null,"updatedAt":"t"}', None, "another shape"), ("{", None, "no JSON"), ("", None, "no JSON"), (None, None, "no JSON"), ("7", None, "another shape"),
    ]
    x = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, body string")
    assert {r.i: (r.kind, r.reason) for r in feeds.body_kinds(x).collect()} == {i: c[1:] for i, c in enumerate(cases)}


def test_times_of_strict_form(spark):
    cases = {"2024-07-04T01:00:00-05:00": "2024-07-04 06:00:00", "2024-07-04T01:00:00.5Z": "2024-07-04 01:00:00.500000", "2024-07-04T01:00Z": "2024-07-04 01:00:00", "2024-07-04": None, "2024-07-04 01:00:00": None, "0001-01-01T00:00:00Z": None, "now": None}
    x = spark.createDataFrame([(c,) for c in cases], "t string")
    assert {r.t: None if r.u is None else str(r.u) for r in x.select("t", feeds.time_of(F.col("t")).alias("u")).collect()} == cases


def test_usage_files_are_compacted_once(spark, tmp_path):
    """Late files, a repeated run, and a crash between writing and deleting lose and double nothing."""
    raw, store = str(tmp_path / "raw"), str(tmp_path / "store")

    def put(day, name, *events):
        (tmp_path / "raw" / day).mkdir(parents=True, exist_ok=True)
        (tmp_path / "raw" / day / f"{name}.json").write_text(json.dumps(list(events) if len(events) != 1 else events[0]))

    view = lambda who, ref=None: {"type": "pageview", "visitor": who} | ({"referrer": ref} if ref else {})
    open_ = lambda who, gauge: {"type": "gauge_open", "visitor": who, "gaugeId": gauge}
    put("2024-01-01", "a", view("u", "x.org"), open_("u", "G1"), open_("v", "G1"))
    put("2024-01-01", "b", view("w"))
    put("2024-01-02", "c", view("u", "x.org"))
    put("2024-01-03", "d", view("u"), view("u"))

    def days():
        return {r.day: (r.pageviews, r.visitors, dict(r.gauge_opens), dict(r.referrers)) for r in tracks.day_rows(spark, raw, store).collect()}

    first = {"2024-01-01": (2, 3, {"G1": 2}, {"x.org": 1}), "2024-01-02": (1, 1, {}, {"x.org": 1}), "2024-01-03": (2, 1, {}, {})}
    assert days() == first
    tracks.compact(spark, raw, store, "2024-01-03", delete=False)  # as if it stopped before deleting
    assert days() == first
    tracks.compact(spark, raw, store, "2024-01-03")
    assert days() == first and sorted(p.parent.name for p in (tmp_path / "raw").glob("*/*.json")) == ["2024-01-03"]
    tracks.compact(spark, raw, store, "2024-01-03")
    put("2024-01-01", "late", view("u"), view("z"))
    late = first | {"2024-01-01": (4, 4, {"G1": 2}, {"x.org": 1})}
    assert days() == late
    tracks.compact(spark, raw, store, "2024-01-03")
    assert days() == late and not (tmp_path / "raw" / "2024-01-01" / "late.json").exists()
    # A table that was never finished does not count.
    (tmp_path / "store" / "part-unfinished").mkdir()
    assert days() == late
    total = tracks.totals(tracks.day_rows(spark, raw, store)).first()
    assert (total.days, total.pageviews, total.visitors, dict(total.gauge_opens), dict(total.referrers)) == (3, 7, 6, {"G1": 2}, {"x.org": 2})
