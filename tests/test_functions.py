"""Rules of single columns and operators on hand-written rows."""

from pyspark.sql import functions as F

from floodspark.functions import alerts as A
from floodspark.functions import status as S
from floodspark.operators import nearby, rivers, series


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'double' if isinstance(v, float) else 'string'}" for n, v in values.items()))
    return df.select(column.alias("x")).first().x if names else None


def test_stage_sentinels(spark):
    for v, ok in ((-999.0, False), (-9999.0, False), (-100.0, False), (0.0, True), (-3.5, True), (float("nan"), False), (float("inf"), False)):
        assert one(spark, S.valid_stage(F.col("v")), v=v) is ok


def test_null_and_empty_thresholds_differ(spark):
    t = "struct<action:double,minor:double,moderate:double,major:double>"
    df = spark.createDataFrame([(1, None), (2, (-9999.0, None, None, None)), (3, (None, 5.0, None, 9.0))], f"id int, t {t}")
    clean = S.sanitize_thresholds(F.col("t"))
    got = {r.id: (r.known, r.c, r.d) for r in df.select("id", clean.isNotNull().alias("known"), S.categorize_by_stage(F.lit(6.0), F.col("t")).alias("c"),
           S.display_category(F.lit("no_flooding"), F.lit(6.0), F.col("t"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-01 01:00:00").cast("timestamp_ntz")).alias("d")).collect()}
    assert got == {1: (False, "not_defined", "no_flooding"), 2: (True, "not_defined", "no_stages"), 3: (True, "minor", "no_flooding")}


def test_flood_category_is_never_downgraded_by_age(spark):
    at, ref = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    df = spark.createDataFrame([(c,) for c in S.CATEGORIES], "c string")
    got = {r.c: r.d for r in df.select("c", S.display_category(F.col("c"), F.lit(1.0), F.lit(None).cast("struct<action:double,minor:double,moderate:double,major:double>"), at, ref).alias("d")).collect()}
    assert got["major"] == "major" and got["action"] == "action" and got["no_flooding"] == "not_defined"


def test_half_up_rounding(spark):
    assert one(spark, S.half_up(F.col("v")), v=-12.5) == -12.0
    assert one(spark, S.half_up(F.col("v")), v=12.5) == 13.0


def test_vtec_and_texts(spark):
    v = one(spark, A.parse_vtec(F.col("x")), x="/O.NEW.KEWX.FF.W.0043.250704T0619Z-000000T0000Z/")
    assert (v["office"], v["etn"], v["ends"], v["begins"].hour) == ("KEWX", "0043", None, 6)
    assert one(spark, A.parse_vtec(F.col("x")), x="none") is None
    assert one(spark, A.reflow_text(F.col("x")), x="a\nb\n\n* c\nd\n* e") == "a b\n\n* c d\n* e"
    assert one(spark, A.clean_statement(F.col("x"), 5), x="ab\x01 cdefg") == "ab c…"


def test_downsampling_keeps_extremes(spark):
    rows = [(1, i, i * 60, 500.0 if i == 123 else -5.0 if i == 77 else float(i % 7)) for i in range(1000)]
    df = spark.createDataFrame(rows, "gauge_id long, pos long, s long, v double").withColumn("t", F.timestamp_seconds("s").cast("timestamp_ntz"))
    got = [r.pos for r in series.downsample(df, 40).collect()]
    assert len(got) <= 40 and {0, 77, 123, 999} <= set(got)
    assert series.downsample(df.filter("pos < 30"), 40).count() == 30


def test_interpolation_edges(spark):
    ts = lambda s: F.timestamp_seconds(F.lit(0) + F.col(s)).cast("timestamp_ntz")
    pts = spark.createDataFrame([(1, 0, 36000, 1.0), (1, 1, 43200, 3.0), (1, 2, 43200, 9.0)], "gauge_id long, pos long, s long, v double").withColumn("t", ts("s"))
    want = spark.createDataFrame([(1, 10), (1, 18000), (1, 36000), (1, 39600), (1, 43200), (1, 43201)], "gauge_id long, s long").select("gauge_id", ts("s").alias("target"))
    got = [r.v for r in series.forecast_interpolate(pts, want).orderBy("target").collect()]
    assert got == [None, 1.0, 1.0, 2.0, 3.0, None]


def test_point_in_polygon_with_hole(spark):
    ring = lambda a, b: [(a, a), (b, a), (b, b), (a, b), (a, a)]
    polys = spark.createDataFrame([("p", [[ring(0.0, 4.0), ring(1.0, 2.0)]])], "pid string, polys array<array<array<struct<lon:double,lat:double>>>>")
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 3.9, 3.9), (4, 5.0, 1.0)], "id long, lat double, lon double")
    assert sorted(r.id for r in nearby.points_in_polygons(pts, polys).collect()) == [1, 3]


def test_radius_join_agrees_with_all_pairs(spark):
    from floodspark.functions import geo as G

    a = spark.range(60).select("id", (25 + F.col("id") * 7 % 31 / 3).alias("lat"), (-100 + F.col("id") * 11 % 37 / 3).alias("lon"))
    b = a.select(F.col("id").alias("rid"), F.col("lat").alias("rlat"), F.col("lon").alias("rlon"))
    want = {(r.id, r.rid) for r in a.crossJoin(b).filter(G.haversine_km(F.col("lat"), F.col("lon"), F.col("rlat"), F.col("rlon")) <= 90).collect()}
    assert {(r.id, r.rid) for r in nearby.within(a, b, 90).select("id", "rid").collect()} == want


def test_river_cut_conserves_length_and_splits_half_way(spark):
    coords = [(-100.0 + i * 0.01, 30.0) for i in range(11)]
    parts = spark.createDataFrame([(1, 7, None, 0, coords)], "part_id long, feature_id long, name string, owner long, coords array<struct<lon:double,lat:double>>")
    gauges = spark.createDataFrame([(5, 30.0, -100.0), (6, 30.0, -99.9)], "id long, lat double, lon double")
    net = rivers.network(parts)
    bridges = rivers.gap_bridges(parts)
    cands = rivers.candidates(gauges, parts)
    dist = rivers.distances(cands, net, bridges, rivers.part_boxes(gauges, rivers.segments(parts)))
    pieces = rivers.owner_pieces(net, dist, parts.select("part_id", "owner"), cands.select("id", "part_id", "along")).orderBy("piece").collect()
    n = net.first().len_m
    assert [p.owner for p in pieces] == [5, 6]
    assert abs(pieces[0].to_m - n / 2) < 1 and pieces[0].from_m == 0 and abs(pieces[-1].to_m - n) < 1e-6


def test_nearest_takes_far_and_few_gauges(spark):
    import math

    a = [(1, 30.0, -97.0), (2, -40.0, 170.0), (3, 60.0, 10.0), (4, None, 5.0)]
    b = [(i, 30.0 + i / 3, -97.0 + i) for i in range(6)] + [(20, -41.0, 171.0), (21, 5.0, 120.0)]

    def km(p, q):
        x, y = math.radians(p[1]), math.radians(q[1])
        h = math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))

    points = spark.createDataFrame(a, "id long, lat double, lon double")
    for some, more in ((b[:3], {}), (b, {"block": 3})):
        gauges = spark.createDataFrame(some, "rid long, rlat double, rlon double")
        got = sorted((r.id, r.place, r.rid) for r in nearby.nearest(points, gauges, 5, 80.0, **more).collect())
        assert got == [(p[0], i, q[0]) for p in a[:3] for i, q in enumerate(sorted(some, key=lambda q: (km(p, q), q[0]))[:5], 1)]
