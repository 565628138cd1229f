"""Rules that SQL does not show one by one, and operators that SQL cannot say, against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from floodspark.functions import alerts as A
from floodspark.functions import geo as G
from floodspark.functions import status as S
from floodspark.operators import alerts, details, nearby, rivers, search, series, status
from floodspark.sources import feeds, sinks

NOW = "2024-07-05 12:00:00"
MESSAGE = "id long, cap_id string, vtec string, event string, status string, message_type string, sent string, ends string, expires string, ugc array<string>, area_desc string, catastrophic boolean"


def messages(spark, *rows):
    """Rows of (vtec action or None, event, message_type, sent hour, ends hour, area)."""
    at = lambda h: None if h is None else f"2024-07-05 {h:02d}:00:00"
    data = [
        (i, f"urn:{i}", a and f"/O.{a}.KEWX.FF.W.0043.250704T0619Z-000000T0000Z/", e, "Actual", m, at(sent), at(ends), None, [f"TXC00{i % 3}"], area, i == 3)
        for i, (a, e, m, sent, ends, area) in enumerate(rows)
    ]
    x = spark.createDataFrame(data, MESSAGE).withColumn("polys", F.lit(None).cast("array<array<array<struct<lon:double,lat:double>>>>"))
    for c in ("sent", "ends", "expires"):
        x = x.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return x


def test_only_cancellations_cancel(spark):
    now = F.lit(NOW).cast("timestamp_ntz")
    flash = "Flash Flood Warning"
    x = messages(
        spark,
        ("NEW", flash, None, 1, None, "a"), ("UPG", flash, None, 2, None, "b"), (None, "Flood Watch", None, 3, None, "c"), (None, "Flood Watch", None, 3, 11, "d"),
        ("CON", flash, "Ack", 4, None, "e"), ("CON", "Flood Statement", "Update", 5, 20, "f; a ;;"),
    )
    left = alerts.without_cancelled(x, now)
    assert {(r.id, r.key) for r in left.collect()} == {(0, "KEWX.FF.W.0043"), (2, "urn:2"), (5, "KEWX.FF.W.0043")}
    e = alerts.merge_events(left).filter("key = 'KEWX.FF.W.0043'").first()
    assert (e.id, e.level, e.n, e.area_desc, e.ugc) == (5, "warning", 2, "f; a", ["TXC002", "TXC000"])
    for action, kind in (("CAN", None), ("CON", "Cancel")):
        y = x.unionByName(messages(spark, (action, "Wind Advisory", kind, 1, None, "")).withColumn("id", F.lit(9).cast("long")))
        assert {r.id for r in alerts.without_cancelled(y, now).collect()} == {2, 5}


def test_levels(spark):
    df = spark.createDataFrame([("Flash Flood Warning", True), ("Flash Flood Statement", True), ("Flash Flood Warning", None), ("Flash Flood Watch", True), ("Flood Statement", True), ("Flood Advisory", None)], "e string, c boolean")
    assert [r.x for r in df.select(A.alert_level(F.col("e"), F.col("c")).alias("x")).collect()] == ["emergency", "emergency", "flash", "watch", "warning", "advisory"]


def test_texts(spark):
    df = spark.createDataFrame([("a\r\nb  c\n\n\n\u2022 d\n- e\nf\n * g", " a\x01\x02b  c ")], "x string, y string")
    r = df.select(A.reflow_text(F.col("x")).alias("x"), A.clean_text(F.col("y"), 4).alias("y"), A.clean_text(F.lit("  "), 4).alias("z")).first()
    assert (r.x, r.y, r.z) == ("a b c\n\n\u2022 d\n- e f\n * g", "a b…", None)
    stages = spark.createDataFrame([(12.3,), (100.0,), (-0.001,), (None,)], "v double")
    assert [r.x for r in stages.select(S.format_stage(F.col("v")).alias("x")).collect()] == ["12.3", "100", "0", None]


def test_shapes(spark):
    sq = lambda a, b: [[a, a], [b, a], [b, b], [a, b]]
    raw = [[sq(0.0, 4.0), sq(1.0, 3.0), [[0.0, 0.0], [1.0, 1.0]]], [[[0.0, 99.0], [1.0, 1.0], [2.0, 0.0], [0.0, 0.0]]]]
    df = spark.createDataFrame([(1, raw), (2, []), (3, [[sq(10.0, 12.0)]])], "id int, g array<array<array<array<double>>>>").withColumn("p", rivers.clean_polygons(F.col("g")))
    got = {r.id: (r.p, r.x) for r in df.select("id", "p", rivers.representative_point(F.col("p")).alias("x")).collect()}
    assert [len(p) for p in got[1][0]] == [2] and len(got[1][0][0][0]) == 5
    assert tuple(got[1][1]) == (0.5, 2.0) and got[2] == ([], None) and tuple(got[3][1]) == (11.0, 11.0)


def test_search_scores(spark):
    names = ["San Antonio River", "San Pedro at Antonio", "Huntsville at Hunt", "Hunt", "Fort Worth", "Café Ñandú", "Antonio San"]
    docs = spark.createDataFrame([(i, n, 0, f"ID{i}T2") for i, n in enumerate(names)], "doc_id long, name string, rank int, code string")
    ask = spark.createDataFrame(list(enumerate(["san antonio", "hunt", "ft wor", "id3t", "cafe nandu", "san zzz", ""])), "query_id long, query string")
    got = {}
    for r in search.search(ask, docs).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    assert got == {0: [(0, 140), (1, 115), (6, 100)], 1: [(3, 115), (2, 100)], 2: [(4, 120)], 3: [(3, 60)], 4: [(5, 140)]}


def test_searches_against_every_document(spark):
    """Every query against every document by the rule, with words that stand for each other, repeated words, and long beginnings."""
    rng = random.Random(11)
    words = ["fort", "ft", "saint", "st", "sandy", "san", "creek", "cr", "a", "an", "extraordinarily", "extraordinary", "extra", "mount", "mt", "near"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 6))), i % 3, rng.choice(["AB12", "an", None])) for i in range(120)]
    asks = [(i, " ".join(w[: rng.randrange(1, 16)] for w in rng.choices(words, k=rng.randrange(0, 4)))) for i in range(80)]
    name = lambda w: search.ALIASES.get(w, w)
    want = {}
    for q, ask in asks:
        typed = ask.split()
        for d, text, rank, code in docs:
            tokens = text.split() + ([code.lower()] if code else [])
            best = [max(((100 if name(t) == name(w) else 60 if t.startswith(w) else 0, -i) for i, t in enumerate(tokens)), default=(0, 0)) for w in typed]
            if typed and all(p for p, _ in best):
                at = [-i for _, i in best]
                score = sum(p for p, _ in best) / len(typed) + 25 * (len(at) > 1 and at == list(range(at[0], at[0] + len(at)))) + 15 * (at[0] == 0)
                want.setdefault(q, {})[d] = int(score + 0.5)
    got = {}
    found = search.search(spark.createDataFrame(asks, "query_id long, query string"), spark.createDataFrame(docs, "doc_id long, name string, rank int, code string"), most=1000).collect()
    for r in found:
        got.setdefault(r.query_id, {})[r.doc_id] = r.score
        assert r.total == len(want[r.query_id])
    assert got == want and len(found) == sum(map(len, want.values())) > 500


def test_points_in_shapes_of_many_cells(spark):
    """Stars with holes, shapes of several parts, open rings and corners on the borders of cells, against the even-odd rule for whole shapes."""
    rng = random.Random(5)

    def star(x, y, most, n):
        turn = sorted(rng.random() * 6.283 for _ in range(n))
        ring = [(x + (r := most * (0.4 + 0.6 * rng.random())) * math.cos(a), y + r * math.sin(a)) for a in turn]
        return ring + ring[: rng.randrange(2)]  # closed, or left open

    box = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.5), (0.0, 1.5), (0.0, 0.0)]
    shapes = {"box": [[box]], "ring": [[box, [(0.5, 0.5), (0.5, 1.0), (1.5, 1.0), (1.5, 0.5), (0.5, 0.5)]]], "tiny": [[star(1.1, 0.7, 0.02, 5)]]}
    for i in range(12):
        x, y = rng.uniform(-3, 3), rng.uniform(-3, 3)
        shapes[f"s{i}"] = [[star(x, y, 1.7, 9), star(x, y, 0.5, 6)]] + [[star(x + 1, y + 1, 1.2, 7)]] * (i % 2)
    points = [(i, rng.uniform(-4, 4), rng.uniform(-4, 4)) for i in range(3000)] + [(3000 + i, 0.25 * (i // 12) - 1, 0.25 * (i % 12) - 1) for i in range(144)]
    points += [(9000, float("nan"), 1.0), (9001, None, 1.0)]

    def inside(lat, lon, rings):
        odd = False
        for ring in rings:
            for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
                odd ^= (y0 > lat) != (y1 > lat) and lon < (x1 - x0) * (lat - y0) / (y1 - y0) + x0
        return odd

    want = sorted((i, name) for i, lat, lon in points[:-2] for name, polys in shapes.items() if any(inside(lat, lon, rings) for rings in polys))
    df = spark.createDataFrame(list(shapes.items()), "pid string, polys array<array<array<struct<lon:double,lat:double>>>>")
    pts = spark.createDataFrame(points, "id long, lat double, lon double")
    for size in (0.5, 0.13):
        assert sorted((r.id, r.pid) for r in nearby.points_in_polygons(pts, df, size).collect()) == want
    cells = nearby.polygon_cells(df, 0.13)
    assert cells.filter("whole").count() > 500 and len(want) > 2000


def test_neighbours_at_high_latitudes_and_across_the_date_line(spark):
    rng = random.Random(3)
    a = [(i, rng.choice([78.0, 89.9, -85.0, 10.0]) + rng.random() * 0.1, rng.choice([179.9, -179.9, 0.0]) + rng.random() * 0.2 - 0.1) for i in range(60)]
    a = [(i, y, (x + 180) % 360 - 180) for i, y, x in a]
    p = spark.createDataFrame(a, "id long, lat double, lon double")
    q = p.select(F.col("id").alias("rid"), F.col("lat").alias("rlat"), F.col("lon").alias("rlon"))
    want = {(r.id, r.rid) for r in p.crossJoin(q).filter(G.haversine_km(F.col("lat"), F.col("lon"), F.col("rlat"), F.col("rlon")) <= 25).collect()}
    got = [(r.id, r.rid) for r in nearby.within(p, q, 25).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 200


def test_hints_reach_any_distance(spark):
    places = spark.createDataFrame([(1, "Red", 30.0, -97.0, 10), (2, "Red", 31.0, -97.0, 20_000), (3, "Blue", 45.0, -97.0, 20_000)], "id long, name string, lat double, lon double, population long")
    assert {(r.id, r.landmark) for r in search.place_hint(places).collect()} == {(1, "Blue"), (2, "Blue")}


def test_forecast_views(spark):
    now = F.lit(NOW).cast("timestamp_ntz")
    t = "struct<action:double,minor:double,moderate:double,major:double>"
    f = "struct<stage:double,unit:string,t:timestamp_ntz,category:string>"
    ahead, gone = ("2024-07-06 00:00:00", "2024-07-01 00:00:00")
    rows = [(i, "ft", (1.0, 2.0, 3.0, 4.0), x and (2.5, "m", None, "minor"), x) for i, x in enumerate([None, ahead, gone, ahead, None, None, None])]
    gauges = spark.createDataFrame(rows, f"id long, unit string, thresholds {t}, f struct<stage:double,unit:string,t:string,category:string>, at string")
    gauges = gauges.withColumn("forecast", F.when(F.col("at").isNotNull(), F.struct("f.stage", "f.unit", F.col("at").cast("timestamp_ntz").alias("t"), "f.category")).cast(f))
    details_ = spark.createDataFrame([(3, True, 2, gone), (4, True, 0, gone), (5, True, 3, gone), (2, False, 0, None), (6, False, 0, None)], "gauge_id long, has_forecast boolean, n_points int, issued_at string")
    details_ = details_.withColumn("issued_at", F.col("issued_at").cast("timestamp_ntz")).withColumn("unit", F.lit(None).cast("string"))
    crests = spark.createDataFrame([(3, ahead, 4.5)], "gauge_id long, t string, v double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = {r.gauge_id: (r.view, r.v, r.unit, r.category, r.stale) for r in series.forecast_view(gauges, details_, crests, now).collect()}
    nothing = (None, None, None, False)
    assert got == {0: ("loading", *nothing), 1: ("crest", 2.5, "m", "minor", False), 2: ("unavailable", *nothing), 3: ("crest", 4.5, "ft", "major", True), 4: ("none", *nothing), 5: ("expired", *nothing), 6: ("unavailable", *nothing)}


def test_sinks_and_lists_refuse_empty_input(spark, tmp_path):
    places = spark.createDataFrame([(1, "a", 5), (2, "b", 9)], "id long, name string, population long")
    with pytest.raises(ValueError):
        sinks.write_places(places, str(tmp_path / "p"))
    sinks.write_places(places, str(tmp_path / "p"), least=2)
    assert [r.id for r in spark.read.parquet(str(tmp_path / "p")).collect()] == [2, 1]
    feed = spark.createDataFrame([], "gauge_id string, name string, lat double, lon double")
    with pytest.raises(ValueError):
        feeds.slim_list(feed)
    pieces = spark.createDataFrame([(7, 5, [(1.0, 2.0), (3.0, 4.0)])], "feature_id long, owner long, coords array<struct<lon:double,lat:double>>")
    assert sinks.segments_geojson(pieces).first().feature == '{"type":"Feature","properties":{"gaugeId":5,"featureId":7},"geometry":{"type":"LineString","coordinates":[[1.0,2.0],[3.0,4.0]]}}'
    gz = tmp_path / "g.txt"
    gz.write_text("GEOID|NAME|INTPTLAT|INTPTLONG  \n48001|Anderson  |+31.8|-95.6  \n")
    assert tuple(feeds.gazetteer(spark, str(gz)).first()) == ("48001", "Anderson", 31.8, -95.6)


def test_dark_when_the_sun_is_down(spark):
    df = spark.createDataFrame([("2024-06-21 18:00:00",), ("2024-06-21 06:00:00",)], "t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    assert [r.x for r in df.select(G.is_dark(F.col("t"), F.lit(30.0), F.lit(-97.0)).alias("x")).collect()] == [False, True]


def test_photo_addresses(spark):
    good = f"https://{details.IMAGE_HOST}/720/CAM_1/CAM_1___2024-01-02T03-04-05Z.jpg"
    bad = [good.replace("CAM_1___", "CAM_2___"), good.replace("https", "http"), good.replace("usgs", "x"), good + "?a", good.replace("/720", "/x/720")]
    df = spark.createDataFrame([(u,) for u in (good, *bad, None)], "u string")
    assert [r.x for r in df.select(details.valid_image_url(F.col("u")).alias("x")).collect()] == [True] + [False] * 6


def test_chunks_of_time_change_nothing(spark):
    rng = random.Random(12)
    rows = [(g, i, 1_704_067_200 + i * 900 + rng.randrange(60), round(rng.random() * 9, 2)) for g in (1, 2) for i in range(900) if rng.random() < 0.8]
    x = spark.createDataFrame(rows, "gauge_id long, pos long, s long, v double").select("gauge_id", "pos", F.timestamp_seconds("s").cast("timestamp_ntz").alias("t"), "v")
    replay = lambda days: sorted(map(repr, series.trend_replay(x, chunk_days=days).collect()))
    assert replay(1) == replay(10_000) and len(replay(1)) == len(rows)


def test_last_good_reads_one_by_one(spark):
    rng = random.Random(13)
    t, rows = 1_704_067_200, []
    for i in range(300):
        t += rng.choice([60, 600, 7200, 30_000])
        rows.append((rng.choice(["a", "b"]), i, t, rng.random() < 0.3, i))
    x = spark.createDataFrame(rows, "feed string, pos long, s long, ok boolean, n long").withColumn("t", F.timestamp_seconds("s").cast("timestamp_ntz"))
    want, good = {}, {}
    for f, i, s, ok, n in rows:
        if ok:
            good[f] = (s, n)
        usable = f in good and s - good[f][0] < 6 * 3600
        want[i] = (good[f][1] if usable else None, usable and not ok, not usable)
    assert {r.pos: (r.n, r.stale, r.error) for r in status.last_good_read(x.drop("s")).collect()} == want


def test_segments_as_geojson(spark):
    pieces = spark.createDataFrame([(7, 5, [[(1.0, 2.0), (3.0, 4.0)]]), (8, 5, [[(1.0, 2.0), (3.0, 4.0)], [(5.0, 6.0), (7.0, 8.0)]])], "feature_id long, owner long, coords array<array<struct<lon:double,lat:double>>>")
    got = [r.feature for r in sinks.segments_geojson(pieces).collect()]
    assert '"LineString","coordinates":[[1.0,2.0],[3.0,4.0]]' in got[0] and '"MultiLineString","coordinates":[[[1.0,2.0],[3.0,4.0]],[[5.0,6.0],[7.0,8.0]]]' in got[1]


def test_nearest_staged_owner_under_a_gauge(spark):
    line = [(-100.0 + i * 0.01, 30.0) for i in range(5)]
    parts = spark.createDataFrame([(1, 1, "R", 5, line), (2, 1, "R", 6, [(-99.96, 30.0), (-99.9, 30.0)])], "part_id long, feature_id long, name string, owner long, coords array<struct<lon:double,lat:double>>")
    staged = spark.createDataFrame([(5, 30.0, -100.0), (6, 30.0, -99.9)], "owner long, olat double, olon double")
    gauges = spark.createDataFrame([(10, 30.001, -99.98), (6, 30.0, -99.9), (11, 31.0, -99.98)], "id long, lat double, lon double")
    assert {(r.id, r.owner) for r in rivers.staged_neighbor(gauges, staged, parts).collect()} == {(10, 5)}


def _off(p, a, b):
    d = (b[0] - a[0], b[1] - a[1])
    n = d[0] ** 2 + d[1] ** 2
    t = min(1, max(0, ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / n)) if n else 0
    return math.dist(p, (a[0] + t * d[0], a[1] + t * d[1]))


def _circle(x, y, r, n, noise=0.0, seed=8):
    rng = random.Random(seed)
    ring = [(x + r * math.cos(2 * math.pi * i / n) + rng.random() * noise, y + r * math.sin(2 * math.pi * i / n) + rng.random() * noise) for i in range(n)]
    return [*ring, ring[0]]


_SHAPES = "key long, polys array<array<array<struct<lon:double,lat:double>>>>"


def test_simplified_shapes_stay_close_and_keep_their_area(spark):
    area = lambda r: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:]))) / 2
    whole, hole = _circle(0, 0, 1, 314, 0.004), _circle(0.1, 0.1, 0.4, 200, 0.002)
    dot, thin = _circle(0.5, 0.5, 0.001, 30), [(0.0, 0.0), (1.0, 0.00001), (2.0, 0.0), (0.0, 0.0)]
    shapes = [(1, [[whole, hole, dot]]), (2, [[_circle(5, 5, 0.5, 90)], [dot], [_circle(9, 9, 0.3, 50), thin]]), (3, [[dot, hole]]), (4, [[thin]]), (5, None), (6, []), (7, [[[(0.0, 0.0), (0.0, 0.0), (0.1, 0.0), (0.1, 0.1), (0.1, 0.1), (0.0, 0.0)]]])]
    got = {r.key: r.polys and [[[tuple(c) for c in ring] for ring in p] for p in r.polys] for r in rivers.simplify(spark.createDataFrame(shapes, _SHAPES), 0.02).collect()}
    assert {k: v and [len(p) for p in v] for k, v in got.items()} == {1: [2], 2: [1, 1], 3: None, 4: None, 5: None, 6: None, 7: [1]}
    assert got[7] == [[[(0.0, 0.0), (0.1, 0.0), (0.1, 0.1), (0.0, 0.0)]]]
    for ring, out in ((whole, got[1][0][0]), (hole, got[1][0][1]), (_circle(5, 5, 0.5, 90), got[2][0][0])):
        assert out[0] == out[-1] and len(out) < len(ring) / 4
        assert all(any(math.dist(p, q) < 1e-4 for q in ring) for p in out)
        assert max(min(_off(p, a, b) for a, b in zip(out, out[1:])) for p in ring) <= 0.0202
        assert abs(area(out) - area(ring)) < 0.05 * area(ring)


def test_payload_ladder(spark):
    rows = [(r, k, 100, k % 3 != 0, [[_circle(k, 0, 0.2 + 0.05 * k, 400, 0.003, k)]]) for r in (1, 2, 3, 4) for k in range(6)] + [(1, 9, 100, True, None)]
    schema = "response long, key long, rest long, of_zones boolean, polys array<array<array<struct<lon:double,lat:double>>>>"
    df = spark.createDataFrame([r for r in rows if r[0] == 1], schema)
    sizes = {r.key: r.bytes for r in rivers.payload_ladder(df, 10**9).collect()}
    full = sum(sizes.values()) + 700
    assert all(r.tolerance is None and not r.dropped for r in rivers.payload_ladder(df, full).collect())
    once = rivers.payload_ladder(df, full - 1).collect()
    assert {r.tolerance for r in once} == {0.004} and not any(r.dropped for r in once)
    assert all((r.bytes < sizes[r.key]) == (r.of_zones and r.polys is not None) for r in once)
    coarse = {r.key: r for r in rivers.payload_ladder(df, 1).collect()}
    assert {r.tolerance for r in coarse.values()} == {0.016} and {k for k, r in coarse.items() if r.dropped} == {1, 2, 4, 5}
    assert all((r.polys is None) == (r.dropped or k == 9) for k, r in coarse.items())
    least = sum(r.bytes for r in coarse.values()) + 700
    largest = max((r for r in coarse.values() if r.of_zones), key=lambda r: r.bytes)
    some = rivers.payload_ladder(df, least - 1).collect()
    assert [r.key for r in some if r.dropped] == [largest.key]
    assert rivers.payload_ladder(spark.createDataFrame(rows, schema), 10**9).count() == len(rows)


def test_plain_letters_of_all_scripts(spark):
    import unicodedata

    letters = [chr(i) for i in range(0x80, 0x110000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) != "Cn"]

    def plain(x):
        x = "".join(c for c in unicodedata.normalize("NFD", x) if not 0x300 <= ord(c) <= 0x36F).lower()
        return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else "" if c in "'’ʼ`" else " " for c in x).split())

    df = spark.createDataFrame([(i, f"a{c}b") for i, c in enumerate(letters)], "i int, x string")
    got = {r.i: r.y for r in df.select("i", search.normalize_text(F.col("x")).alias("y")).collect()}
    assert [(hex(ord(c)), got[i], plain(f"a{c}b")) for i, c in enumerate(letters) if got[i] != plain(f"a{c}b")] == []


def test_local_date_keeps_midnight_only(spark):
    """A date without a time is stored as midnight; half a second later it is the evening before in Texas."""
    at = ("2024-01-05 00:00:00", "2024-01-05 00:00:00.000001", "2024-01-05 00:00:00.5", "2024-01-05 06:00:00")
    x = spark.createDataFrame([(i, a) for i, a in enumerate(at)], "i int, a string")
    for dates, first in ((True, "2024-01-05"), (False, "2024-01-04")):
        day = details.local_date(F.col("a").cast("timestamp"), F.lit("America/Chicago"), ("America/Chicago",), dates)
        assert [r.d for r in x.select(day.cast("string").alias("d"), "i").orderBy("i").collect()] == [first, "2024-01-04", "2024-01-04", "2024-01-05"]


def test_times_count_to_the_nearest_millisecond(spark):
    """As epoch_ms() of the SQL does, on both sides of 1970; the sun's elevation goes by it."""
    want = {"2024-01-05 00:00:00.000499": 1704412800000, "2024-01-05 00:00:00.0005": 1704412800001, "1969-12-31 23:59:59.9995": -1, "1969-12-31 23:59:59.9996": 0, "1969-12-31 23:59:59.998": -2, "2300-01-01 00:00:00.123999": 10413792000124}
    x = spark.createDataFrame([(a, m) for a, m in want.items()], "a string, m long").withColumn("t", F.col("a").cast("timestamp"))
    sun = lambda t: G.sun_elevation_deg(t, F.lit(30.0), F.lit(-97.0))
    for r in x.select("a", "m", S.epoch_ms(F.col("t")).alias("ms"), (sun(F.col("t")) == sun(F.timestamp_millis("m"))).alias("same")).collect():
        assert (r.a, r.ms, r.same) == (r.a, r.m, True)


def test_time_grids_go_by_the_nearest_millisecond(spark):
    """Less than half a millisecond before a step is that step, as in the SQL."""
    x = spark.createDataFrame([("2024-01-10 00:07:29.9994",), ("2024-01-10 00:07:29.9996",), ("2024-01-10 00:09:59.9994",), ("2024-01-10 00:09:59.9996",)], "a string").withColumn("t", F.col("a").cast("timestamp"))
    start = F.lit("2024-01-10").cast("timestamp_ntz")
    got = x.select(*[F.date_format(S.time_bucket(F.col("t"), 5, nearest=n), "mm").alias(str(n)) for n in (True, False)], S.timeline_step(F.col("t"), start, 1152).alias("step")).collect()
    assert [tuple(r) for r in got] == [("05", "05", 0), ("10", "05", 1), ("10", "05", 1), ("10", "10", 1)]


def test_targets_of_a_grid_are_not_broadcast(spark):
    """Spark takes an exploded grid for as small as the gauges; lookups keep repeated targets and ties."""
    gauges = spark.range(3).repartition(2, "id").distinct()
    ts = lambda x: F.lit(x).cast("timestamp_ntz")
    wanted = series.targets(gauges, ts("2024-01-01 00:00:00"), ts("2024-01-01 01:00:00"), 30)
    rows = [(0, 5, "2024-01-01 00:20:00", 1.0), (0, 4, "2024-01-01 00:40:00", 2.0), (0, 6, "2024-01-01 01:29:59", 3.0), (1, 7, "2023-12-31 23:30:00", 4.0), (1, 8, "2024-01-01 01:30:01", 5.0)]
    readings = spark.createDataFrame(rows, "gauge_id long, pos long, t string, v double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    x = series.history_asof(readings, wanted.unionByName(wanted.filter("gauge_id = 1")))
    got = sorted((r.gauge_id, r.target.strftime("%H:%M"), r.v) for r in x.collect())
    no = [(1, "00:30", None), (1, "01:00", None)]
    assert got[:3] == [(0, "00:00", 1.0), (0, "00:30", 2.0), (0, "01:00", 2.0)]
    assert [g for g in got if g[0] == 1] == [(1, "00:00", 4.0)] * 2 + [no[0]] * 2 + [no[1]] * 2 and len(got) == 12
    assert "Broadcast" not in x._jdf.queryExecution().executedPlan().toString()


def joins(df):
    """Rows that each join of a collected query made."""
    out, work = [], [df._jdf.queryExecution().executedPlan()]
    while work:
        p = work.pop()
        kind = p.getClass().getSimpleName()
        if kind.endswith("QueryStageExec"):
            work.append(p.plan())
        elif kind == "AdaptiveSparkPlanExec":
            work.append(p.executedPlan())
        if "Join" in kind:
            out.append(p.metrics().apply("numOutputRows").value())
        work += [p.children().apply(i) for i in range(p.children().size())]
    return out


def test_equal_queries_are_searched_once(spark):
    """300 times the same three letters against 300 names that begin with them: not 90,000 pairs."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("Smallville").alias("name"), (F.col("id") % 50).alias("rank"))
    x = search.search(spark.range(300).select(F.col("id").alias("query_id"), F.lit("sma").alias("query")), docs, most=5)
    got = x.collect()
    want = [(d, 75, i + 1, 300) for i, d in enumerate((49, 99, 149, 199, 249))]
    assert len(got) == 1500 and all(sorted(((r.doc_id, r.score, r.place, r.total) for r in got if r.query_id == q), key=lambda t: t[2]) == want for q in (0, 150, 299))
    assert max(joins(x)) <= 1500


def test_queries_of_the_same_words_are_one(spark):
    """However they are written; each keeps its own rows. Words in another order are another query, empty ones find nothing."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("Small Ring "), F.col("id").cast("string")).alias("name"), F.lit(1).alias("rank"), F.lit("Q").alias("code"))
    asked = ["small ring", " Smáll  RING! ", "ring small", "", None, "ring 7"] + ["Small-Ring"] * 100
    x = search.search(spark.createDataFrame(list(enumerate(asked)), "query_id long, query string"), docs)
    got = {}
    for r in x.collect():
        got.setdefault(r.query_id, []).append((r.place, r.doc_id, r.score, r.total))
    first = [(i + 1, i, 140, 400) for i in range(30)]
    assert sorted(got[0]) == sorted(got[1]) == sorted(got[50]) == first and set(got) == {0, 1, 2, 5, *range(6, 106)}
    assert sorted(got[2]) == [(i + 1, i, 100, 400) for i in range(30)]
    assert sorted(got[5]) == [(1, 7, 125, 11), *[(i + 2, 70 + i, 105, 11) for i in range(10)]]
    assert max(joins(x)) <= 30 * len(asked)


def test_first_circle_fits_the_crowd(spark):
    """3,000 marks in 100 km x 100 km: places meet some of them at first, not those of 40 km; the nearest are as by brute force."""
    rng = random.Random(5)
    spots = [(i, round(30 + rng.random() * 0.9, 5), round(-97 + rng.random(), 5), rng.choice("abc")) for i in range(3000)] + [(3000, 45.0, -80.0, "a"), (3001, 45.0, -80.0, "b")]
    x = spark.createDataFrame(spots, "id long, lat double, lon double, name string")
    marks = x.select(F.col("id").alias("rid"), F.col("lat").alias("rlat"), F.col("lon").alias("rlon"), F.col("name").alias("landmark"))
    assert nearby._crowded_km(marks, 4, 40.0) < 2.5
    got = {r.id: (r.rid, r.distance) for r in nearby.nearest(x, marks, 1, differ=("name", "landmark")).select("id", "rid", "distance").collect()}
    assert set(got) == set(range(3002)) and got[3000][0] == 3001
    for i, lat, lon, name in spots[:200]:
        h = lambda s: math.sin(math.radians(s[1] - lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(s[1])) * math.sin(math.radians(s[2] - lon) / 2) ** 2
        assert math.isclose(got[i][1], 2 * G.EARTH_KM * math.asin(math.sqrt(min(h(s) for s in spots if s[3] != name))), rel_tol=1e-9, abs_tol=1e-9)


def test_alerts_are_ranked_once_for_each_set_of_shapes(spark):
    """400 points in one zone, half of them in a shape that 20 of 60 alerts share: two lists are ranked, not 400."""
    box = lambda x, y, w: [[[(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]]]
    polys = "array<array<array<struct<lon:double,lat:double>>>>"
    zones = spark.createDataFrame([("TXC001", box(0.0, 0.0, 2.0)), ("TXC002", None)], f"code string, polys {polys}")
    kinds = lambda i: box(0.0, 0.0, 1.0) if i < 20 else None
    rows = [(f"k{i:02d}", ("advisory", "flash", "watch")[i % 3], f"2024-01-0{1 + i % 4} 00:00:00", ["TXC001", "TXC001" if i % 2 else "TXC009"], kinds(i), kinds(i) or (None if i > 55 else box(0.0, 0.0, 2.0))) for i in range(60)]
    events = spark.createDataFrame(rows, f"key string, level string, sent string, ugc array<string>, own_polys {polys}, polys {polys}").withColumn("sent", F.col("sent").cast("timestamp_ntz"))
    points = spark.range(400).select("id", (0.1 + F.col("id") % 2 * 1.5).alias("lat"), F.lit(0.3).alias("lon")).unionByName(spark.createDataFrame([(400, 5.0, 5.0)], "id long, lat double, lon double"))
    x = nearby.alerts_at(points, events, zones)
    got = {}
    for r in x.collect():
        got.setdefault(r.id, []).append((r.place, r.pid, r.level))
    order = lambda keep: [(n + 1, r[0], r[1]) for n, r in enumerate(sorted(filter(keep, rows), key=lambda r: (-A.LEVELS.index(r[1]), -int(r[2][9]), r[0])))]
    assert set(got) == set(range(400))
    for i in (0, 1, 398, 399):
        assert sorted(got[i]) == order(lambda r, i=i: (i % 2 == 0 or r[4] is None) and r[5] is not None)
    assert max(joins(x)) <= 1000


def test_pairs_of_points_and_gauges_are_no_rows(spark, monkeypatch):
    """500 points and 500 gauges in 40 km, some equal, some far, off the globe or without a rank, in groups of 50: as by brute force."""
    monkeypatch.setattr(nearby, "GROUP", 50)
    monkeypatch.setattr(nearby, "STEP", 1 << 12)
    rng = random.Random(3)
    spot = lambda: (30 + rng.randrange(300) / 1000, -97 + rng.randrange(300) / 1000)
    gauges = [(i, *spot(), rng.choice((None, 0, 1, 6))) for i in range(500)] + [(500 + i, 30.1, -96.9, 1) for i in range(3)] + [(600, 31.0, -97.0, 2), (601, float("nan"), 0.0, 1), (602, 30.0, None, 1)]
    points = [(i, *spot()) for i in range(500)] + [(500, 31.3, -97.0), (501, 40.0, -97.0), (502, 91.0, 0.0)]
    g = spark.createDataFrame(gauges, "rid long, rlat double, rlon double, rank int")
    x = nearby.nearby_gauges(spark.createDataFrame(points, "id long, lat double, lon double"), g, most=60)
    got = {}
    for r in x.collect():
        got.setdefault(r.id, []).append((r.place, r.rid, r.total, r.beyond_radius))
    assert max(joins(x)) < 30_000 and set(got) == set(range(502))
    for i, lat, lon in points[::25] + points[500:502]:
        def km(g):
            h = math.sin((math.radians(g[1]) - math.radians(lat)) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(g[1])) * math.sin(math.radians(g[2] - lon) / 2) ** 2
            return 2 * G.EARTH_KM * math.asin(min(1.0, math.sqrt(h)))

        ok = [q for q in gauges if q[0] < 601]
        hits = sorted((q for q in ok if km(q) <= 40), key=lambda q: (q[3] is None, -(q[3] or 0), round(km(q), 9), q[0]))
        far = sorted(ok, key=lambda q: (round(km(q), 9), q[0]))[:5]
        want = [(n + 1, q[0], len(hits) or 5, not hits) for n, q in enumerate(hits[:60] or far)]
        # Gauges as far as each other but for the last digits may stand in either order.
        assert [w[::2] + w[3:] for w in want] == [r[::2] + r[3:] for r in sorted(got[i])]
        assert [round(km(gauges[r[1]] if r[1] < 503 else gauges[503]), 6) for r in sorted(got[i])] == [round(km(gauges[w[1]] if w[1] < 503 else gauges[503]), 6) for w in want]


def test_batches_of_shapes_are_thinned_as_each_shape():
    """Random stars, squares, slivers, holes, repeated points, nulls and empty shapes, from the middle of an array."""
    import pyarrow as pa

    rng = random.Random(9)

    def ring():
        n, x, y, w = rng.choice((0, 1, 3, 4, 9, 60)), rng.random() * 9, rng.random() * 9, rng.choice((0.0005, 0.003, 0.02, 0.5))
        pts = [{"lon": x + w * (1 + rng.choice((0, rng.random()))) * math.cos(6.283 * i / max(n, 1)), "lat": y + w * math.sin(6.283 * i / max(n, 1))} for i in range(n)]
        pts = [p for p in pts for _ in range(rng.choice((1, 1, 1, 2)))]
        return pts + pts[:1]

    shapes = [rng.choice((None, [], [[]])) if rng.random() < 0.1 else [[ring() for _ in range(rng.randrange(4))] for _ in range(rng.randrange(4))] for _ in range(600)]
    kind = pa.list_(pa.list_(pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))))
    for part in (pa.array(shapes, kind).slice(7, 500), pa.array(shapes, kind).slice(3, 0), pa.array([None, []], kind)):
        assert rivers._thin_all(part, 0.002).to_pylist() == [rivers._thin_polygons(s, 0.002) for s in part.to_pylist()]


def test_gauges_near_places_are_counted_in_groups(spark):
    """300 places and 300 gauges in the same town: 90,000 pairs are counted, but no join makes them."""
    towns = spark.range(300).select("id", (30 + F.col("id") * 0.0001).alias("lat"), F.lit(-97.0).alias("lon"), F.lit("x").alias("name"))
    gauges = spark.range(300).select(F.col("id").alias("rid"), (30.01 + F.col("id") * 0.0001).alias("rlat"), F.lit(-97.0).alias("rlon"), F.lit(0).alias("rank"))
    x = details.gauges_near_place(towns, gauges)
    got = x.groupBy("id").agg(F.first("total").alias("n"), F.min("distance").alias("d"), F.count("*").alias("rows"))
    rows = got.collect()
    assert len(rows) == 300 and all((r.n, r.rows) == (300, 100) for r in rows) and max(joins(got)) < 20_000
    assert math.isclose(min(r.d for r in rows if r.id < 100), 0.0001 * math.pi / 180 * G.EARTH_KM, rel_tol=1e-6)
