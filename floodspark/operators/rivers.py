"""River lines as a network: nodes, gaps, candidates, distances along it, and owners of stretches."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from floodspark.functions import geo as G
from floodspark.functions.alerts import office_link
from floodspark.operators.kept import Kept
from floodspark.operators.nearby import snap_to_lines, within

REACH_M, SNAP_M, SOURCE_M, BRIDGE_M, TIE_M, SLIVER_M = 40_000.0, 750.0, 150.0, 1_000.0, 0.5, 3.0
#: Parts in a candidate's box up to which one group searches them.
LARGE = 20_000


def segments(parts: DataFrame) -> DataFrame:
    """parts (part_id, coords: array of lon, lat) to part_id, seq, ends, length_m and start_m (length before)."""
    pairs = F.arrays_zip(F.slice("coords", 1, F.size("coords") - 1).alias("a"), F.slice("coords", 2, F.size("coords") - 1).alias("b"))
    x = parts.filter(F.size("coords") > 1).select("part_id", F.posexplode(pairs).alias("seq", "s"))
    x = x.select("part_id", "seq", F.col("s.a.lat").alias("lat0"), F.col("s.a.lon").alias("lon0"), F.col("s.b.lat").alias("lat1"), F.col("s.b.lon").alias("lon1"))
    x = x.withColumn("length_m", G.equirect_m(F.col("lat0"), F.col("lon0"), F.col("lat1"), F.col("lon1")))
    before = Window.partitionBy("part_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return x.withColumn("start_m", F.coalesce(F.sum("length_m").over(before), F.lit(0.0)))


def node(p: Column) -> Column:
    """A point's key, rounded to 1e-5 degrees."""
    return F.concat_ws(",", F.round(p["lon"] * 1e5).cast("long").cast("string"), F.round(p["lat"] * 1e5).cast("long").cast("string"))


def network(parts: DataFrame) -> DataFrame:
    """part_id, name, feature_id, start_node, end_node, len_m."""
    length = segments(parts).groupBy("part_id").agg(F.sum("length_m").alias("len_m"))
    ends = parts.select("part_id", "name", "feature_id", node(F.col("coords")[0]).alias("start_node"), node(F.element_at("coords", -1)).alias("end_node"))
    return ends.join(length, "part_id")


def degrees(net: DataFrame) -> DataFrame:
    """How many parts end at each node; a part that ends where it begins counts once."""
    ends = net.select(F.explode(F.array_distinct(F.array("start_node", "end_node"))).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def name_compatible(a: Column, b: Column) -> Column:
    """Equal names, or one of them unknown."""
    return a.isNull() | b.isNull() | (a == b)


def gap_bridges(parts: DataFrame, metres: float = BRIDGE_M) -> DataFrame:
    """For each loose end, the nearest loose end of another part of a compatible name under metres away: a, b, distance, name; each pair once.

    A bridge has the name of the parts that it joins, or of the one that has a name. Distances are planar, at
    the latitude of the end that looks; of a pair that finds each other, the shorter counts.
    """
    net = network(parts)
    loose = degrees(net).filter("degree = 1").select("node")
    ends = parts.select("part_id", "name", F.explode(F.array(F.col("coords")[0], F.element_at("coords", -1))).alias("p"))
    e = ends.select("part_id", "name", node(F.col("p")).alias("node"), "p.lat", "p.lon").dropDuplicates(["part_id", "node"]).join(loose, "node")
    left = e.select(F.col("node").alias("id"), "lat", "lon", F.col("part_id").alias("part"), F.col("name").alias("n0"))
    right = e.select(F.col("node").alias("rid"), F.col("lat").alias("rlat"), F.col("lon").alias("rlon"), F.col("part_id").alias("rpart"), F.col("name").alias("n1"))
    # Distances on the sphere differ from planar ones by less than a fiftieth.
    near = within(left, right, metres * 1.02 / 1000, metres=True).filter((F.col("part") != F.col("rpart")) & name_compatible(F.col("n0"), F.col("n1")))
    flat = F.hypot((F.col("rlat") - F.col("lat")) * G.DEGREE_LAT_M, (F.col("rlon") - F.col("lon")) * G.DEGREE_LON_M * F.cos(F.radians("lat")))
    near = near.withColumn("distance", flat).filter(F.col("distance") < metres).withColumn("name", F.coalesce("n0", "n1"))
    best = near.groupBy("id").agg(F.min_by(F.struct("rid", "distance", "name"), F.struct("distance", "rid")).alias("m"))
    pairs = best.select(F.least("id", "m.rid").alias("a"), F.greatest("id", "m.rid").alias("b"), "m.distance", "m.name")
    return pairs.groupBy("a", "b").agg(F.min("distance").alias("distance"), F.min("name").alias("name"))


def candidates(gauges: DataFrame, parts: DataFrame) -> DataFrame:
    """Staged gauges (id, lat, lon) with the parts that they stand on: id, part_id, distance, along, river.

    The nearest named part within SNAP_M gives the river's name; a gauge stands on all parts of a
    compatible name that are at most SOURCE_M farther than it (than the nearest of all, where none has a name).
    """
    snapped = snap_to_lines(gauges, segments(parts), SNAP_M).join(parts.select("part_id", "name"), "part_id")
    w = Window.partitionBy("id")
    named = F.min(F.when(F.col("name").isNotNull(), F.struct("distance", "part_id", "name"))).over(w)
    x = snapped.withColumn("named", named).withColumn("nearest", F.min("distance").over(w))
    reference = F.coalesce(F.col("named.distance"), F.col("nearest"))
    x = x.filter((F.col("distance") <= reference + SOURCE_M) & name_compatible(F.col("name"), F.col("named.name")))
    return x.select("id", "part_id", "distance", "along", F.col("named.name").alias("river"))


def _ways(net: DataFrame, bridges: DataFrame) -> DataFrame:
    """Parts and bridges, in both directions: a, b, m, name."""
    one = net.select(F.col("start_node").alias("a"), F.col("end_node").alias("b"), F.col("len_m").alias("m"), "name")
    two = one.unionByName(bridges.select("a", "b", F.col("distance").alias("m"), "name"))
    return two.unionByName(two.select(F.col("b").alias("a"), F.col("a").alias("b"), "m", "name"))


def _starts(cands: DataFrame, net: DataFrame) -> DataFrame:
    """Each candidate's distance to the ends of the parts that it stands on: id, river, node, metres."""
    on = cands.join(net.select("part_id", "start_node", "end_node", "len_m"), "part_id")
    ends = F.explode(F.array(F.struct(F.col("start_node").alias("node"), F.col("along").alias("metres")), F.struct(F.col("end_node").alias("node"), (F.col("len_m") - F.col("along")).alias("metres"))))
    return on.select("id", "river", ends.alias("e")).select("id", "river", "e.node", "e.metres")


def distances(cands: DataFrame, net: DataFrame, bridges: DataFrame, boxes: DataFrame, reach: float = REACH_M, large: int = LARGE) -> DataFrame:
    """Distance along the river from each candidate to each node within reach: id, river, node, metres.

    A candidate goes only through parts and bridges of a name that is compatible with its river's.
    boxes (id, part_id) says which parts lie near a candidate: the straight line is never longer than
    the way along rivers, so these parts hold all that it reaches. A candidate with at most large of them is
    searched in one group; those with more are searched together, round by round, by joins (frontier()).
    """
    sizes = boxes.groupBy("id").count().filter(F.col("count") > large).select("id")
    if sizes.isEmpty():
        return _searched(cands, net, bridges, boxes, reach)
    few = lambda df: df.join(sizes, "id", "left_anti")
    many = cands.join(sizes, "id", "left_semi")
    return _searched(few(cands), net, bridges, few(boxes), reach).unionByName(frontier(many, net, bridges, reach))


def frontier(cands: DataFrame, net: DataFrame, bridges: DataFrame, reach: float = REACH_M) -> DataFrame:
    """distances() by relaxing all candidates' open nodes at once: each round joins them with the ways and keeps the shorter distances.

    Rounds are kept as Parquet, so that neither a task nor the driver holds a network; they end when no
    distance shrinks any more, after as many as the most parts on a way within reach.
    """
    kept = Kept(net.sparkSession)
    ways = kept.keep(_ways(net, bridges), "ways")
    start = _starts(cands, net).filter(F.col("metres") <= reach)
    now = kept.keep(start.groupBy("id", "node").agg(F.first("river").alias("river"), F.min("metres").alias("metres")).withColumn("open", F.lit(True)), "now")
    while not now.filter("open").isEmpty():
        step = now.filter("open").join(ways, F.col("node") == F.col("a")).filter(name_compatible(F.col("river"), F.col("name")))
        step = step.select("id", F.col("b").alias("node"), "river", (F.col("metres") + F.col("m")).alias("metres"), F.lit(None).cast("double").alias("before")).filter(F.col("metres") <= reach)
        both = step.unionByName(now.select("id", "node", "river", "metres", F.col("metres").alias("before")))
        shorter = F.min("before").isNull() | (F.min("metres") < F.min("before"))
        now = kept.keep(both.groupBy("id", "node").agg(F.first("river").alias("river"), F.min("metres").alias("metres"), shorter.alias("open")), "now")
    kept.drop("ways")
    return now.select("id", "river", "node", "metres")


def _searched(cands: DataFrame, net: DataFrame, bridges: DataFrame, boxes: DataFrame, reach: float) -> DataFrame:
    """distances(), with one group for each candidate and the ways in its box."""
    edges = net.select("part_id", "start_node", "end_node", "len_m", "name")
    own = boxes.join(edges, "part_id").select("id", F.lit(False).alias("start"), F.col("start_node").alias("a"), F.col("end_node").alias("b"), F.col("len_m").alias("m"), "name")
    nodes = own.select("id", F.explode(F.array("a", "b")).alias("a")).distinct()
    gaps = nodes.join(bridges, "a").select("id", F.lit(False).alias("start"), "a", "b", F.col("distance").alias("m"), "name")
    starts = _starts(cands, net).select("id", F.lit(True).alias("start"), F.col("node").alias("a"), F.lit(None).cast("string").alias("b"), F.col("metres").alias("m"), F.col("river").alias("name"))

    def search(x: pd.DataFrame) -> pd.DataFrame:
        begin = x[x.start]
        river = next((n for n in begin.name if isinstance(n, str)), None)
        graph: dict[str, list[tuple[str, float]]] = {}
        for r in x[~x.start].itertuples():
            if river is None or not isinstance(r.name, str) or r.name == river:
                graph.setdefault(r.a, []).append((r.b, r.m))
                graph.setdefault(r.b, []).append((r.a, r.m))
        heap = [(float(r.m), r.a) for r in begin.itertuples()]
        heapq.heapify(heap)
        done: dict[str, float] = {}
        while heap:
            d, n = heapq.heappop(heap)
            if n in done or d > reach:
                continue
            done[n] = d
            for to, m in graph.get(n, []):
                if to not in done:
                    heapq.heappush(heap, (d + m, to))
        return pd.DataFrame({"id": x.id.iloc[0], "river": river, "node": list(done), "metres": list(done.values())})

    return starts.unionByName(own).unionByName(gaps).groupBy("id").applyInPandas(search, "id long, river string, node string, metres double")


def part_boxes(gauges: DataFrame, net_segments: DataFrame, km: float = REACH_M / 1000) -> DataFrame:
    """(id, part_id) of parts whose bounding box, km wider on each side, holds a gauge: all within km are among them."""
    size = max(km / 111.0, 1e-3)
    low = lambda c: F.min(F.least(f"{c}0", f"{c}1"))
    high = lambda c: F.max(F.greatest(f"{c}0", f"{c}1"))
    box = net_segments.groupBy("part_id").agg(low("lat").alias("s"), high("lat").alias("n"), low("lon").alias("w"), high("lon").alias("e"))
    pad = km / 110.574 * 1.01
    most = F.least(F.greatest(F.abs("s"), F.abs("n")) + pad, F.lit(89.0))
    wide = pad / F.cos(F.radians(most))
    box = box.select("part_id", (F.col("s") - pad).alias("s"), (F.col("n") + pad).alias("n"), (F.col("w") - wide).alias("w"), (F.col("e") + wide).alias("e"))
    cells = box.select("*", F.explode(F.sequence(G.cell(F.col("s"), size), G.cell(F.col("n"), size))).alias("cy"))
    cells = cells.select("*", F.explode(F.sequence(G.cell(F.col("w"), size), G.cell(F.col("e"), size))).alias("cx"))
    placed = gauges.select("id", "lat", "lon", G.cell(F.col("lat"), size).alias("cy"), G.cell(F.col("lon"), size).alias("cx"))
    return placed.join(cells, ["cy", "cx"]).filter(F.col("lat").between(F.col("s"), F.col("n")) & F.col("lon").between(F.col("w"), F.col("e"))).select("id", "part_id")


def owner_pieces(net: DataFrame, dist: DataFrame, owners: DataFrame, sources: DataFrame, reach: float = REACH_M, tie: float = TIE_M, sliver: float = SLIVER_M) -> DataFrame:
    """Cuts parts where their nearest candidate changes: part_id, piece, owner, from_m, to_m of the parts that change.

    dist (id, river, node, metres) and sources (id, part_id, along) are distances() and candidates(); owners
    (part_id, owner) are the owners so far. Each place goes to the candidate with the shortest way along rivers of
    its name, the smaller id where two are equal; places beyond reach of all keep their owner, and so do those where the
    owner's way is at most tie longer. Pieces shorter than sliver join the one before them (the first, the one after).

    A candidate's way to a place leads over the part's start or its end, or it stands on the part. Over the
    start, all ways grow alike along the part, so only the shortest one and the owner's matter, and as much holds for the end:
    a part needs four numbers and the gauges on it, which are aggregated before they meet.
    """
    fits = name_compatible(F.col("river"), F.col("name"))
    start = net.join(dist, net["start_node"] == dist["node"]).filter(fits).select("part_id", "id", F.col("metres").alias("up"), F.lit(None).cast("double").alias("down"))
    end = net.join(dist, net["end_node"] == dist["node"]).filter(fits).select("part_id", "id", F.lit(None).cast("double").alias("up"), F.col("metres").alias("down"))
    none = F.lit(None).cast("double")
    on = sources.select("part_id", "id", none.alias("up"), none.alias("down"), F.struct("along", "id").alias("spot"))
    ways = start.unionByName(end).withColumn("spot", F.lit(None).cast("struct<along:double,id:bigint>")).unionByName(on)
    ways = ways.join(owners, "part_id", "left")
    mine = F.col("id") == F.col("owner")
    best = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("m"), "id")))
    x = ways.groupBy("part_id").agg(
        F.first("owner").alias("owner"), best("up").alias("up"), best("down").alias("down"), F.min(F.when(mine, F.col("up"))).alias("own_up"),
        F.min(F.when(mine, F.col("down"))).alias("own_down"), F.array_sort(F.collect_set("spot")).alias("spots"), F.bool_or(~F.coalesce(mine, F.lit(False))).alias("foreign"),
    )
    x = x.filter("foreign").drop("foreign").join(net.select("part_id", "len_m"), "part_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                owner = None if pd.isna(r.owner) else int(r.owner)
                pair = lambda w: None if w is None else (w["m"], w["id"])
                number = lambda v: None if pd.isna(v) else v
                spots = [(p["along"], p["id"]) for p in r.spots]
                cuts = _cut(r.len_m, owner, pair(r.up), pair(r.down), number(r.own_up), number(r.own_down), spots, reach, tie, sliver)
                rows += [(r.part_id, i, *c) for i, c in enumerate(cuts)]
            out = pd.DataFrame(rows, columns=["part_id", "piece", "owner", "from_m", "to_m"])
            yield out.astype({"part_id": "int64", "piece": "int32", "owner": "Int64", "from_m": "float64", "to_m": "float64"})

    return x.mapInPandas(run, "part_id long, piece int, owner long, from_m double, to_m double")


def _cut(n: float, owner: int | None, up, down, own_up, own_down, spots: list, reach: float, tie: float, sliver: float) -> list[tuple[int | None, float, float]]:
    """(owner, from, to) of a part n metres long; nothing where it stays whole with its owner.

    up and down are (metres, id) to the part's start and end, own_up and own_down the owner's, spots (place, id) gauges on it.
    """
    # Lines: metres at place 0 with slope 1, at place n with slope -1, and gauges on the part, from which metres grow both ways.
    base, slope, ids = [], [], []
    for m, i, s in ((*(up or (None, None)), 1), (own_up, owner, 1), (*(down or (None, None)), -1), (own_down, owner, -1), *((a, i, 0) for a, i in spots)):
        if m is not None:
            base.append(m if s == 1 else m + n if s == -1 else m)
            slope.append(s)
            ids.append(i)
    base, slope, ids = np.array(base, float), np.array(slope), np.array(ids, np.int64)
    own = ids == (owner if owner is not None else np.iinfo(np.int64).min)
    at = base[slope == 0]
    rising = np.concatenate([base[slope == 1], -at])
    falling = np.concatenate([base[slope == -1], at])
    marks = [np.array([0.0, n]), at, reach - base[slope == 1], base[slope == -1] - reach, at - reach, at + reach]
    nodes_up, nodes_down = np.flatnonzero(slope == 1), np.flatnonzero(slope == -1)
    cross = lambda u, d: marks.extend([((d - u) / 2 + e) for e in (0.0, tie / 2, -tie / 2)])
    for i in nodes_up:
        cross(base[i], falling)
    for i in nodes_down:
        cross(rising, base[i])
    if len(at) > 1:
        order = np.sort(at)
        cross(-order[:-1], order[1:])
        for a in base[(slope == 0) & own]:  # the owner's gauges meet all others, for ties
            cross(-a, at)
            cross(-at, a)
    edges = np.unique(np.concatenate(marks))
    edges = edges[(edges >= 0) & (edges <= n)]
    runs: list[list] = []
    for lo, hi in zip(edges, edges[1:]):
        p = (lo + hi) / 2
        c = np.where(slope == 0, np.abs(p - base), base + slope * p)
        least = c.min()
        if least > reach:
            who = owner
        elif own.any() and c[own].min() <= least + tie:
            who = owner
        else:
            who = int(ids[c <= least + 1e-9].min())
        if runs and runs[-1][0] == who:
            runs[-1][2] = float(hi)
        else:
            runs.append([who, float(lo), float(hi)])
    for k, r in enumerate(runs):
        if r[2] - r[1] < sliver and len(runs) > 1:
            r[0] = runs[k - 1][0] if k else runs[1][0]
    out: list[list] = []
    for r in runs:
        if out and out[-1][0] == r[0]:
            out[-1][2] = r[2]
        else:
            out.append(r)
    return [] if not out or (len(out) == 1 and out[0][0] == owner) else [tuple(r) for r in out]


def _at(line: Column, m: Column) -> Column:
    """The point of a line (array of m, lon, lat) at a distance along it: its first or last point, or one between two, rounded to 1e-5 degrees."""
    i = F.least(F.greatest(F.size(F.filter(line, lambda v: v["m"] <= m)), F.lit(1)), F.size(line) - 1)
    p, q = line[i - 1], line[i]
    t = F.when(q["m"] > p["m"], F.least(F.lit(1.0), F.greatest(F.lit(0.0), (m - p["m"]) / (q["m"] - p["m"])))).otherwise(0.0)
    point = lambda v: F.struct(v["lon"].alias("lon"), v["lat"].alias("lat"))
    cut = F.struct(*[F.round(p[k] + t * (q[k] - p[k]), 5).alias(k) for k in ("lon", "lat")])
    last = F.element_at(line, -1)
    return F.when(m <= 0, point(line[0])).when(m >= last["m"] - 1e-6, point(last)).otherwise(cut)


def piece_lines(pieces: DataFrame, parts: DataFrame) -> DataFrame:
    """The lines that pieces are: part_id, feature_id, name, piece, owner, changed, metres, coords. Parts without pieces are whole, with their own owner.

    Cut points are rounded, so that both sides of a cut share one; what is left of no length goes.
    """
    x = segments(parts)
    last = x.groupBy("part_id").agg(F.max_by(F.struct((F.col("start_m") + F.col("length_m")).alias("m"), F.col("lon1").alias("lon"), F.col("lat1").alias("lat")), "seq").alias("end"))
    starts = x.groupBy("part_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.col("start_m").alias("m"), F.col("lon0").alias("lon"), F.col("lat0").alias("lat")))).alias("v"))
    point = lambda v: F.struct(v["m"].alias("m"), v["lon"].alias("lon"), v["lat"].alias("lat"))
    lines = starts.join(last, "part_id").select("part_id", F.concat(F.transform("v", point), F.array("end")).alias("line"))
    cut = pieces.select("part_id", "piece", F.col("owner").alias("new"), "from_m", "to_m", F.lit(True).alias("changed"))
    all_ = parts.select("part_id", "feature_id", "name", F.col("owner").alias("own")).join(lines, "part_id").join(cut, "part_id", "left")
    to = F.coalesce("to_m", F.element_at("line", -1)["m"])
    changed = F.coalesce("changed", F.lit(False))
    owner = F.when(changed, F.col("new")).otherwise(F.col("own"))
    y = all_.select("part_id", "feature_id", "name", F.coalesce("piece", F.lit(0)).alias("piece"), owner.alias("owner"), changed.alias("changed"), "line", F.coalesce("from_m", F.lit(0.0)).alias("a"), to.alias("z"))
    inner = F.transform(F.filter("line", lambda v: (v["m"] > F.col("a")) & (v["m"] < F.col("z"))), lambda v: F.struct(v["lon"].alias("lon"), v["lat"].alias("lat")))
    whole = F.concat(F.array(_at(F.col("line"), F.col("a"))), inner, F.array(_at(F.col("line"), F.col("z"))))
    # Points of the part itself stay, repeated ones too; a cut that rounds to its neighbour is that neighbour.
    own_points = F.transform("line", lambda v: F.struct(v["lon"].alias("lon"), v["lat"].alias("lat")))
    y = y.withColumn("coords", F.when(F.col("changed"), whole).otherwise(own_points))
    y = y.withColumn("coords", F.when(F.col("changed"), F.filter("coords", lambda v, i: (i == 0) | (v != F.get("coords", F.greatest(i - 1, F.lit(0)))))).otherwise(F.col("coords")))
    return y.filter(F.size("coords") > 1).select("part_id", "feature_id", "name", "piece", "owner", "changed", (F.col("z") - F.col("a")).alias("metres"), "coords")


def regroup(pieces: DataFrame, parts: DataFrame) -> DataFrame:
    """One row for each feature and owner: kind (LineString, or MultiLineString of several pieces), pieces, km, and their coordinates in order."""
    y = piece_lines(pieces, parts)
    held = F.transform(F.array_sort(F.collect_list(F.struct("part_id", "piece", "coords"))), lambda v: v["coords"])
    kind = F.when(F.count("*") > 1, "MultiLineString").otherwise("LineString")
    return y.groupBy("feature_id", "owner").agg(kind.alias("kind"), F.count("*").alias("pieces"), (F.sum("metres") / 1000).alias("km"), held.alias("coords"))


def segmentation(parts: DataFrame, gauges: DataFrame, metres: float = BRIDGE_M) -> tuple[DataFrame, DataFrame]:
    """Pieces of parts (part_id, feature_id, name, owner, coords) that change hands, and the candidates among staged gauges (id, lat, lon)."""
    net, cands = network(parts), candidates(gauges, parts)
    dist = distances(cands, net, gap_bridges(parts, metres), part_boxes(gauges, segments(parts)))
    return owner_pieces(net, dist, parts.select("part_id", "owner"), cands.select("id", "part_id", "along")), cands


def segment_stats(features: DataFrame, parts: DataFrame, pieces: DataFrame, cands: DataFrame) -> DataFrame:
    """One row of counters of a segmentation; features (feature_id, kind) are all features, lakes and points among them."""
    line = F.col("kind").isin("LineString", "MultiLineString")
    before = features.agg(F.count("*").alias("features_in"), F.count_if(line).alias("river_features_in"))
    lines = piece_lines(pieces, parts)
    by_feature = lines.groupBy("feature_id").agg(F.bool_or("changed").alias("changed"), F.count_distinct(F.coalesce(F.col("owner").cast("string"), F.lit(""))).alias("owners")).filter("changed")
    more = by_feature.agg(F.count("*").alias("features_changed"), F.coalesce(F.sum(F.col("owners") - 1), F.lit(0)).alias("more"))
    touched = lines.filter("changed").groupBy("part_id").agg(F.sum(F.size("coords")).alias("now")).join(parts.select("part_id", F.size("coords").alias("was")), "part_id")
    vertices = touched.agg(F.count("*").alias("parts_touched"), F.coalesce(F.sum(F.col("now") - F.col("was")), F.lit(0)).alias("added_vertices"))
    who = cands.agg(F.count_distinct("id").alias("candidates"))
    rows = before
    for other in (more, vertices, who):
        rows = rows.unionByName(other, allowMissingColumns=True)
    one = rows.agg(*[F.max(c).alias(c) for c in rows.columns])  # one row each, with columns of their own
    out = lambda c: (F.col(c) + F.col("more")).alias(c.replace("_in", "_out"))
    return one.select("features_in", out("features_in"), "river_features_in", out("river_features_in"), "features_changed", "parts_touched", "added_vertices", "candidates")


def staged_neighbor(gauges: DataFrame, staged: DataFrame, parts: DataFrame) -> DataFrame:
    """For gauges without stages (id, lat, lon): the nearest staged owner (owner, olat, olon) of the lines under them, within reach.

    parts (part_id, owner, coords) are segmented lines. The nearest line must be within SNAP_M; owners of lines at most SOURCE_M farther count.
    """
    snapped = snap_to_lines(gauges, segments(parts), SNAP_M + SOURCE_M).join(parts.select("part_id", "owner"), "part_id")
    snapped = snapped.withColumn("nearest", F.min("distance").over(Window.partitionBy("id")))
    close = snapped.filter((F.col("nearest") <= SNAP_M) & (F.col("distance") <= F.col("nearest") + SOURCE_M))
    x = close.join(staged, "owner").join(gauges.select("id", "lat", "lon"), "id")
    m = G.equirect_m(F.col("lat"), F.col("lon"), F.col("olat"), F.col("olon"))
    return x.withColumn("m", m).filter((F.col("m") <= REACH_M) & (F.col("id") != F.col("owner"))).groupBy("id").agg(F.min_by("owner", F.struct("m", "owner")).alias("owner"), F.min("m").alias("m"))


def _thinned(p: np.ndarray, tolerance: float) -> np.ndarray:
    """The points of a line (n, 2) that Douglas and Peucker's rule keeps; both ends stay."""
    keep = np.zeros(len(p), bool)
    keep[[0, -1]] = True
    work = [(0, len(p) - 1)]
    while work:
        i, j = work.pop()
        if j > i + 1:
            d, q = p[j] - p[i], p[i + 1 : j] - p[i]
            t = np.clip((q @ d) / (d @ d), 0, 1) if d @ d > 0 else np.zeros(len(q))
            off = ((q - t[:, None] * d) ** 2).sum(1)
            k = int(off.argmax())
            if off[k] > tolerance * tolerance:
                keep[i + 1 + k] = True
                work += [(i, i + 1 + k), (i + 1 + k, j)]
    return p[keep]


def _thin_ring(ring: list, tolerance: float) -> list | None:
    """A closed ring of points, thinned between its first point and the one farthest from it; None for a sliver.

    Points are rounded to 4 places and neighbours that are equal then are one; what has under three points or an area below tolerance squared is a sliver.
    """
    p = np.array([[c["lon"], c["lat"]] for c in ring], float).reshape(-1, 2)[:-1]
    if len(p) < 3:
        return None
    far = 1 + int(((p[1:] - p[0]) ** 2).sum(1).argmax())
    both = np.concatenate([_thinned(p[: far + 1], tolerance), _thinned(np.concatenate([p[far:], p[:1]]), tolerance)[1:-1]])
    q = np.floor(both * 1e4 + 0.5) / 1e4
    q = q[np.append(True, (q[1:] != q[:-1]).any(1))]
    if len(q) > 1 and (q[0] == q[-1]).all():
        q = q[:-1]
    if len(q) < 3:
        return None
    q = np.concatenate([q, q[:1]])
    area = (q[:-1, 0] * q[1:, 1] - q[1:, 0] * q[:-1, 1]).sum() / 2
    return None if abs(area) < tolerance * tolerance else [{"lon": a, "lat": b} for a, b in q]


def _thin_polygons(polys, tolerance: float) -> list | None:
    """Polygons with their holes, thinned; a polygon goes with its outer ring, a hole by itself. None if nothing is left."""
    out = []
    for poly in polys if polys is not None else ():
        outer = _thin_ring(poly[0], tolerance) if len(poly) else None
        if outer:
            out.append([outer, *filter(None, (_thin_ring(h, tolerance) for h in poly[1:]))])
    return out or None


_POLYS = "array<array<array<struct<lon:double,lat:double>>>>"


def _within(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items of groups of such lengths, one group after the other: the group, and the place in it."""
    group = np.repeat(np.arange(len(lengths)), lengths)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _thin_all(shapes: pa.Array, tolerance: float) -> pa.Array:
    """_thin_polygons() of all shapes of a batch at once: each step splits the parts of all their rings."""
    lengths = lambda a: pc.fill_null(pc.list_value_length(a), 0).to_numpy()
    polys = shapes.flatten()
    rings = polys.flatten()
    points = rings.flatten()
    n_polys, n_rings, n_points = lengths(shapes), lengths(polys), lengths(rings)
    xy = np.column_stack([pc.struct_field(points, c).to_numpy(zero_copy_only=False) for c in ("lon", "lat")]).astype(float).reshape(-1, 2)
    # Rings of three points at least, without their last one, with the first one again at the end.
    valid = np.flatnonzero(n_points > 3)
    size = n_points[valid]
    of, at = _within(size)
    begin = (np.cumsum(n_points) - n_points)[valid]
    p = xy[begin[of] + np.where(at == size[of] - 1, 0, at)]
    start = np.cumsum(size) - size
    keep = at == 0

    def highest(value: np.ndarray, group: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The highest value of each group, and where it is first."""
        top = np.maximum.reduceat(value, begins)
        hit = np.flatnonzero((value == top[group]) | np.isnan(top[group]))
        return top, hit[np.append(True, group[hit][1:] != group[hit][:-1])]

    if len(valid):
        inner = (at > 0) & (at < size[of] - 1)
        where = np.flatnonzero(inner)
        _, first = highest(((p[where] - p[start][of[where]]) ** 2).sum(1), of[where], np.cumsum(size - 2) - (size - 2))
        far = where[first]
        keep[far] = True
        i, j = np.concatenate([start, far]), np.concatenate([far, start + size - 1])
        while (more := j > i + 1).any():
            i, j = i[more], j[more]
            n = j - i - 1
            part, k = _within(n)
            k = i[part] + 1 + k
            d, q = (p[j] - p[i])[part], p[k] - p[i][part]
            dd = (d * d).sum(1)
            t = np.where(dd > 0, np.clip((q * d).sum(1) / np.where(dd > 0, dd, 1), 0, 1), 0)
            top, first = highest(((q - t[:, None] * d) ** 2).sum(1), part, np.cumsum(n) - n)
            split = top > tolerance * tolerance
            middle = k[first][split]
            keep[middle] = True
            i, j = np.concatenate([i[split], middle]), np.concatenate([middle, j[split]])
    q, of = np.floor(p[keep] * 1e4 + 0.5) / 1e4, of[keep]
    fresh = np.append(True, (q[1:] != q[:-1]).any(1) | (of[1:] != of[:-1]))[: len(q)]
    q, of = q[fresh], of[fresh]
    left = np.bincount(of, minlength=len(valid))
    last = np.cumsum(left) - 1
    again = (left > 1) & (q[last - left + 1] == q[last]).all(1)
    stays = np.ones(len(q), bool)
    stays[last[again]] = False
    q, left = q[stays], left - again
    # Closed again, with their areas.
    of, at = _within(left + 1)
    closed = q[(np.cumsum(left) - left)[of] + np.where(at == left[of], 0, at)]
    cross = np.append(closed[:-1, 0] * closed[1:, 1] - closed[1:, 0] * closed[:-1, 1], 0.0)[: len(closed)]
    area = np.bincount(of, np.where(at < left[of], cross, 0.0), len(valid)) / 2
    good = np.zeros(len(n_points), bool)
    good[valid] = (left >= 3) & ~(np.abs(area) < tolerance * tolerance)
    closed, left = closed[good[valid][of]], (left + 1)[good[valid]]
    # A polygon goes with its outer ring.
    poly_of, place = _within(n_rings)
    outer = np.zeros(len(n_rings), bool)
    outer[poly_of[(place == 0) & good]] = True
    ring_stays = good & outer[poly_of]
    closed, left = closed[np.repeat(ring_stays[good], left)], left[ring_stays[good]]
    shape_of, _ = _within(n_polys)
    rings_left, polys_left = np.bincount(poly_of[ring_stays], minlength=len(n_rings))[outer], np.bincount(shape_of[outer], minlength=len(n_polys))
    offsets = lambda n: np.append(0, np.cumsum(n)).astype(np.int32)
    point = pa.StructArray.from_arrays([pa.array(closed[:, 0]), pa.array(closed[:, 1])], ["lon", "lat"])
    out = pa.ListArray.from_arrays(offsets(rings_left), pa.ListArray.from_arrays(offsets(left), point))
    # An offset that is null makes a null.
    return pa.ListArray.from_arrays(pa.array(offsets(polys_left), mask=np.append(polys_left == 0, False)), out)


def simplify(shapes: DataFrame, tolerance: float = 0.002, column: str = "polys") -> DataFrame:
    """shapes with their polygons (column: outer ring, then holes) thinned to a tolerance in degrees; null where nothing is left."""

    at = shapes.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                thin = _thin_all(part.column(at), tolerance).cast(part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays([thin if k == at else c for k, c in enumerate(part.columns)], names=part.schema.names)

    return shapes.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shapes.schema))  # as text, so that all may be null


#: Tolerances that are tried one after the other, each on the outlines that the one before left.
LADDER = (0.004, 0.008, 0.016)


def payload_ladder(alerts: DataFrame, most: int = 600_000, ladder: tuple[float, ...] = LADDER) -> DataFrame:
    """alerts (response, key, rest: bytes without the outline, of_zones, polys) with the outlines that let each response keep to most bytes.

    As long as a response is larger, the outlines that come from zones get coarser, step by step (one that would
    vanish stays as it is). If it is still larger then, its largest such outlines are dropped, one by one, until it is not. Adds tolerance (null where
    nothing was made coarser), bytes of each outline, and dropped. An outline's bytes are those of its coordinates as JSON.
    """
    steps = range(len(ladder) + 1)

    at, zoned = alerts.columns.index("polys"), alerts.columns.index("of_zones")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                all_ = []
                for polys, of_zones in zip(part.column(at).to_pylist(), part.column(zoned).to_pylist()):
                    forms = [polys]
                    for tolerance in ladder:
                        forms.append((_thin_polygons(forms[-1], tolerance) if of_zones and forms[-1] is not None else None) or forms[-1])
                    all_.append(forms)
                kept = [c for k, c in enumerate(part.columns) if k != at]
                names = [n for k, n in enumerate(part.schema.names) if k != at]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(all_, pa.list_(part.schema.field(at).type))], names=[*names, "forms"])

    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in alerts.schema if f.name != "polys")
    x = alerts.mapInArrow(run, f"{rest}, forms array<{_POLYS}>")
    text = lambda p: F.to_json(F.transform(p, lambda poly: F.transform(poly, lambda ring: F.transform(ring, lambda c: F.array(c["lon"], c["lat"])))))
    x = x.withColumn("sizes", F.transform("forms", lambda p: F.coalesce(F.octet_length(text(p)), F.lit(0)).cast("long")))
    total = x.groupBy("response").agg(F.sum("rest").alias("r"), *[F.sum(F.col("sizes")[k]).alias(f"s{k}") for k in steps])
    first = F.coalesce(*[F.when(F.col("r") + F.col(f"s{k}") <= most, F.lit(k)) for k in steps], F.lit(len(ladder)))
    total = total.select("response", first.alias("step"), (F.col("r") + F.get(F.array(*[F.col(f"s{k}") for k in steps]), first)).alias("total"))
    x = x.join(total, "response").withColumn("polys", F.get("forms", F.col("step"))).withColumn("bytes", F.get("sizes", F.col("step")))
    drops = F.col("of_zones") & F.col("polys").isNotNull()
    # Largest first; one goes as long as what is left before it is still too much.
    w = Window.partitionBy("response").orderBy(F.col("bytes").desc(), "key").rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.sum(F.when(drops, F.col("bytes")).otherwise(0)).over(w), F.lit(0))
    x = x.withColumn("dropped", drops & (F.col("total") - gone > most))
    tolerance = F.get(F.array(F.lit(None).cast("double"), *map(F.lit, ladder)), F.col("step"))
    kept = [c for c in alerts.columns if c != "polys"]
    return x.select(*kept, F.when(~F.col("dropped"), F.col("polys")).alias("polys"), tolerance.alias("tolerance"), "bytes", "dropped")


def ring_area(ring: Column) -> Column:
    """Signed area of a closed ring in square degrees."""
    n = F.size(ring)
    cross = F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda p, q: p["lon"] * q["lat"] - q["lon"] * p["lat"])
    return F.aggregate(cross, F.lit(0.0), lambda s, x: s + x) / 2


def bounds(ring: Column) -> Column:
    lim = lambda f, k: f(F.transform(ring, lambda p: p[k]))
    return F.struct(lim(F.array_min, "lon").alias("west"), lim(F.array_min, "lat").alias("south"), lim(F.array_max, "lon").alias("east"), lim(F.array_max, "lat").alias("north"))


def closed_ring(ring: Column) -> Column:
    """A ring of points, closed; null for fewer than 4 of them or where any position is not valid."""
    valid = F.forall(ring, lambda p: F.coalesce(G.valid_position(p["lat"], p["lon"]), F.lit(False)))
    shut = F.when(ring[0] == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    return F.when(F.when(F.size(ring) >= 3, valid & (F.size(shut) >= 4)), shut)


def clean_ring(ring: Column) -> Column:
    """A ring of [lon, lat, ...] lists as closed points; null for fewer than 4 of them or where any position is not valid."""
    valid = F.forall(ring, lambda p: (F.size(p) >= 2) & F.coalesce(G.valid_position(p[1], p[0]), F.lit(False)))
    points = F.transform(ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    shut = F.when(points[0] == F.element_at(points, -1), points).otherwise(F.concat(points, F.slice(points, 1, 1)))
    return F.when(F.when(F.size(ring) >= 3, valid & (F.size(shut) >= 4)), shut)


def clean_polygons(polygons: Column) -> Column:
    """Polygons (outer ring, then holes) with a usable outer ring, less the holes that are none; none at all gives an empty array."""
    rings = F.transform(polygons, lambda c: F.transform(c, clean_ring))
    usable = F.filter(rings, lambda rs: (F.size(rs) > 0) & rs[0].isNotNull())
    return F.coalesce(F.transform(usable, lambda rs: F.filter(rs, lambda r: r.isNotNull())), F.array().cast("array<array<array<struct<lon:double,lat:double>>>>"))


def _edges(ring: Column) -> Column:
    n = F.size(ring)
    return F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def representative_point(polygons: Column) -> Column:
    """A point inside: the centroid of the largest polygon, or the middle of its widest stretch at the centroid's latitude; null without polygons."""
    sized = F.transform(polygons, lambda rs, i: F.struct(F.abs(ring_area(rs[0])).alias("area"), (-i).alias("first"), rs.alias("rings")))
    rings = F.array_max(sized)["rings"]
    outer = rings[0]
    total = lambda f: F.aggregate(F.transform(_edges(outer), f), F.lit(0.0), lambda s, x: s + x)
    cross = lambda e: e["p"]["lon"] * e["q"]["lat"] - e["q"]["lon"] * e["p"]["lat"]
    area = ring_area(outer)
    flat = F.abs(area) <= 1e-12
    cx = F.when(flat, outer[0]["lon"]).otherwise(total(lambda e: (e["p"]["lon"] + e["q"]["lon"]) * cross(e)) / (6 * area))
    cy = F.when(flat, outer[0]["lat"]).otherwise(total(lambda e: (e["p"]["lat"] + e["q"]["lat"]) * cross(e)) / (6 * area))

    def at_latitude(y: Column) -> Column:
        meets = F.filter(F.flatten(F.transform(rings, _edges)), lambda e: (e["q"]["lat"] > y) != (e["p"]["lat"] > y))
        return F.array_sort(F.transform(meets, lambda e: (e["p"]["lon"] - e["q"]["lon"]) * (y - e["q"]["lat"]) / (e["p"]["lat"] - e["q"]["lat"]) + e["q"]["lon"]))

    def choose(x: Column, y: Column, xs: Column) -> Column:
        inside = F.size(F.filter(xs, lambda v: v > x)) % 2 == 1
        pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(xs) / 2).cast("int") - 1), lambda k: F.struct((xs[2 * k + 1] - xs[2 * k]).alias("wide"), (-k).alias("first"), ((xs[2 * k] + xs[2 * k + 1]) / 2).alias("mid")))
        other = F.when(F.size(xs) >= 2, F.array_max(pairs)["mid"])
        return F.when(inside, F.struct(x.alias("lon"), y.alias("lat"))).when(other.isNotNull(), F.struct(other.alias("lon"), y.alias("lat"))).otherwise(F.struct(outer[0]["lon"].alias("lon"), outer[0]["lat"].alias("lat")))

    known = F.array(F.struct(cx.alias("x"), cy.alias("y")))
    found = F.transform(F.transform(known, lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), at_latitude(c["y"]).alias("xs"))), lambda c: choose(c["x"], c["y"], c["xs"]))[0]
    return F.when(F.size(polygons) > 0, found)


def map_link(polygons: Column, office: Column) -> Column:
    """The point forecast page of a place inside the shape, or the office's page where there is no shape."""
    p = representative_point(polygons)
    return F.when(p.isNotNull(), F.format_string("https://forecast.weather.gov/MapClick.php?lat=%.4f&lon=%.4f", p["lat"], p["lon"])).otherwise(office_link(office))
