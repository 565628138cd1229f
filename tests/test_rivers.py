"""River networks against walks in plain Python: names, gaps, reach, owners, and what stays the same."""

import heapq
import math
import random
from collections import defaultdict

import pytest

from floodspark.operators import features, graph, rivers

PART = "part_id long, feature_id long, name string, owner long, coords array<struct<lon:double,lat:double>>"
LAT, LON = 110_574.0, 111_320.0


def length(a, b):
    return math.hypot((b[1] - a[1]) * LAT, (b[0] - a[0]) * LON * math.cos(math.radians((a[1] + b[1]) / 2)))


def whole(coords):
    return sum(length(a, b) for a, b in zip(coords, coords[1:]))


def key(p):
    return round(p[0] * 1e5), round(p[1] * 1e5)


def fits(a, b):
    return a is None or b is None or a == b


def snapped(gauge, coords):
    """Distance and place of the closest approach of (lat, lon) to a line."""
    lat, lon = gauge
    best, before = (math.inf, 0.0), 0.0
    kx = LON * math.cos(math.radians(lat))
    for a, b in zip(coords, coords[1:]):
        ax, ay, bx, by = (a[0] - lon) * kx, (a[1] - lat) * LAT, (b[0] - a[0]) * kx, (b[1] - a[1]) * LAT
        t = min(1, max(0, -(ax * bx + ay * by) / (bx * bx + by * by))) if bx or by else 0
        best = min(best, (math.hypot(ax + t * bx, ay + t * by), before + t * length(a, b)))
        before += length(a, b)
    return best


class Walk:
    """Distances of gauges {id: (lat, lon)} along parts {id: (name, coords)}, as the rules say, one by one."""

    def __init__(self, parts, gauges):
        self.parts, self.sources, self.river, self.metres = parts, {}, {}, {}
        ways, at = defaultdict(list), defaultdict(list)
        for k, (name, c) in parts.items():
            ways[key(c[0])].append((key(c[-1]), whole(c), name))
            ways[key(c[-1])].append((key(c[0]), whole(c), name))
            for p in {key(c[0]): c[0], key(c[-1]): c[-1]}.values():
                at[key(p)].append((k, name, p))
        self.bridges = {}
        loose = {n: ends[0] for n, ends in at.items() if len(ends) == 1}
        for n, (k, name, p) in loose.items():
            kx = LON * math.cos(math.radians(p[1]))
            near = [(math.hypot((q[0] - p[0]) * kx, (q[1] - p[1]) * LAT), f"{m[0]},{m[1]}", m, other) for m, (j, other, q) in loose.items() if j != k and fits(name, other)]
            near = [x for x in near if x[0] < 1000]
            if near:
                d, _, m, other = min(near, key=lambda x: x[:2])
                pair = tuple(sorted((n, m)))
                self.bridges[pair] = min(self.bridges.get(pair, (math.inf, None)), (d, name or other), key=lambda x: x[0])
        for (n, m), (d, name) in self.bridges.items():
            ways[n].append((m, d, name))
            ways[m].append((n, d, name))
        for g, place in gauges.items():
            near = sorted((*snapped(place, c), k) for k, (_, c) in parts.items())
            near = sorted((d, k, s) for d, s, k in near if d <= 750)
            if not near:
                continue
            named = [x for x in near if parts[x[1]][0] is not None]
            river = parts[named[0][1]][0] if named else None
            limit = (named or near)[0][0] + 150
            self.river[g] = river
            self.sources[g] = {k: s for d, k, s in near if d <= limit and fits(river, parts[k][0])}
            heap, done = [], {}
            for k, s in self.sources[g].items():
                c = parts[k][1]
                heap += [(s, key(c[0])), (whole(c) - s, key(c[-1]))]
            heapq.heapify(heap)
            while heap:
                d, n = heapq.heappop(heap)
                if n in done or d > 40_000:
                    continue
                done[n] = d
                for m, w, name in ways[n]:
                    if fits(river, name):
                        heapq.heappush(heap, (d + w, m))
            self.metres[g] = done

    def costs(self, k, place):
        """The way from each gauge to a place on a part, where there is one within reach."""
        name, c = self.parts[k]
        n, out = whole(c), {}
        for g, done in self.metres.items():
            ways = [abs(place - self.sources[g][k])] if k in self.sources[g] else []
            if fits(self.river[g], name):
                ways += [done[key(c[0])] + place] if key(c[0]) in done else []
                ways += [done[key(c[-1])] + n - place] if key(c[-1]) in done else []
            if ways:
                out[g] = min(ways)
        return out


def random_network(seed, step=0.06, size=5):
    """Parts between neighbours of a grid, of two names or none, some with a gap at one end; some parts are 25 to 60 km long."""
    rng = random.Random(seed)
    grid = {(i, j): (-100 + i * step + rng.random() * 0.02, 30 + j * step + rng.random() * 0.02) for i in range(size) for j in range(size)}
    parts = {}
    for p in grid:
        for q in ((p[0] + 1, p[1]), (p[0], p[1] + 1)):
            if q in grid and rng.random() < 0.75:
                a, b = grid[p], grid[q]
                if rng.random() < 0.2:
                    a = (a[0] + (b[0] - a[0]) * 0.05, a[1] + (b[1] - a[1]) * 0.05)
                middle = ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2 + 0.004)
                coords = [tuple(round(x, 5) for x in v) for v in (a, middle, b)]
                parts[len(parts)] = (rng.choice(["A", "A", "B", None]), coords)
    spots = rng.sample(sorted(parts), 6)
    gauges = {100 + i: (parts[k][1][1][1] + rng.random() * 0.004, parts[k][1][1][0]) for i, k in enumerate(spots)}
    return parts, gauges


def frames(spark, parts, gauges, owner=lambda k: 900 + k % 3):
    rows = [(k, owner(k) - 900 if owner(k) >= 900 else owner(k), name, owner(k), c) for k, (name, c) in parts.items()]
    return spark.createDataFrame(rows, PART), spark.createDataFrame([(g, *p) for g, p in gauges.items()], "id long, lat double, lon double")


@pytest.mark.parametrize("seed, step", [(5, 0.06), (6, 0.3)])
def test_distances_and_owners_along_random_named_networks(spark, seed, step):
    parts, gauges = random_network(seed, step)
    walk = Walk(parts, gauges)
    p, g = frames(spark, parts, gauges)
    net, cands, bridges = rivers.network(p), rivers.candidates(g, p), rivers.gap_bridges(p)
    assert {(r.id, r.part_id): r.river for r in cands.collect()} == {(i, k): walk.river[i] for i, s in walk.sources.items() for k in s}
    got = {tuple(sorted(tuple(map(int, x.split(","))) for x in (r.a, r.b))): (r.distance, r.name) for r in bridges.collect()}
    assert got.keys() == walk.bridges.keys() and all(math.isclose(got[k][0], d, abs_tol=1e-6) and got[k][1] == n for k, (d, n) in walk.bridges.items())
    boxes = rivers.part_boxes(g, rivers.segments(p))
    ways = [rivers.distances(cands, net, bridges, boxes, large=n) for n in (20_000, 5)]
    for dist in ways:  # in groups, and by joins where a box holds more than 5 parts
        found = {(r.id, tuple(map(int, r.node.split(",")))): r.metres for r in dist.collect()}
        want = {(i, n): d for i, done in walk.metres.items() for n, d in done.items()}
        assert found.keys() == want.keys() and all(math.isclose(found[k], want[k], abs_tol=1e-6) for k in want)
    rows = rivers.owner_pieces(net, ways[1], p.select("part_id", "owner"), cands.select("id", "part_id", "along")).collect()
    assert rows
    beyond = foreign = 0
    for k, (_, c) in parts.items():
        n, owner = whole(c), 900 + k % 3
        own = sorted((r for r in rows if r.part_id == k), key=lambda r: r.piece)
        pieces = [(r.owner, r.from_m, r.to_m) for r in own] or [(owner, 0.0, n)]
        assert pieces[0][1] == 0 and math.isclose(pieces[-1][2], n) and all(math.isclose(a[2], b[1]) and a[0] != b[0] for a, b in zip(pieces, pieces[1:]))
        for who, a, z in pieces:
            for f in (0.02, 0.25, 0.5, 0.75, 0.98):
                place = a + f * (z - a)
                costs = walk.costs(k, place)
                least = min(costs.values(), default=math.inf)
                if who == owner:
                    assert least >= 40_000 - 3.5
                    beyond += 1
                else:
                    assert costs[who] <= least + 3.5 and least <= 40_000 + 3.5
                    foreign += 1
    assert foreign and (beyond or step < 0.1)
    lines = rivers.piece_lines(spark.createDataFrame(rows, "part_id long, piece int, owner long, from_m double, to_m double"), p).collect()
    total = sum(whole([tuple(v) for v in r.coords]) for r in lines)
    assert math.isclose(total, sum(whole(c) for _, c in parts.values()), rel_tol=1e-5)
    kept = defaultdict(set)
    for r in lines:
        kept[r.part_id] |= {tuple(v) for v in r.coords}
    assert all(set(c) <= kept[k] for k, (_, c) in parts.items())


def segmented(spark, parts, gauges, owner):
    p, g = frames(spark, parts, gauges, owner)
    pieces, cands = rivers.segmentation(p, g)
    return p, pieces, cands, sorted(rivers.piece_lines(pieces, p).collect(), key=lambda r: (r.part_id, r.piece))


def test_a_second_segmentation_changes_nothing(spark):
    parts, gauges = random_network(11, 0.15)
    _, _, _, once = segmented(spark, parts, gauges, lambda k: 900 + k % 3)
    again = {i: (r.name, [tuple(v) for v in r.coords]) for i, r in enumerate(once)}
    _, pieces, _, _ = segmented(spark, again, dict(reversed(gauges.items())), lambda i: once[i].owner)
    assert len(once) > len(parts) and pieces.collect() == []


def line(a, b, step=1.0, lat=30.0):
    """Points from a to b kilometres east."""
    per = 111.320 * math.cos(math.radians(lat))
    n = max(1, round((b - a) / step))
    return [(round(-100 + (a + (b - a) * i / n) / per, 5), lat) for i in range(n + 1)]


def owners(spark, parts, gauges, owner=lambda k: 900 + k):
    _, _, _, lines = segmented(spark, parts, gauges, owner)
    return {k: [r.owner for r in lines if r.part_id == k] for k in parts}, lines


def test_rules_of_the_cut(spark):
    at = lambda km: (30.0, line(0, km)[-1][0])
    # Half way between two gauges, in the middle of one long segment; both sides share the cut.
    got, lines = owners(spark, {0: ("R", line(0, 20, 20))}, {4: at(4), 5: at(12)})
    assert got == {0: [4, 5]} and lines[0].coords[-1] == lines[1].coords[0] and abs(lines[0].coords[-1].lon - line(0, 8)[-1][0]) < 2e-5
    # Beyond 40 km the owner stays.
    got, lines = owners(spark, {0: ("R", line(0, 80, 2))}, {4: at(10)})
    assert got == {0: [4, 900]} and abs(lines[0].coords[-1].lon - line(0, 50)[-1][0]) < 3e-5
    # A creek of another name, small gaps of one name and of two, a large gap, unnamed rivers.
    creek = [line(0, 10)[-1], (line(0, 11)[-1][0], 30.01), (line(0, 12)[-1][0], 30.02)]
    parts = {0: ("R", line(0, 10)), 1: ("Creek", creek)}
    assert owners(spark, parts, {4: at(5)})[0] == {0: [4], 1: [901]}
    assert owners(spark, {0: (None, line(0, 10)), 1: (None, creek)}, {4: at(5)})[0] == {0: [4], 1: [4]}
    parts = {0: ("R", line(0, 5)), 1: ("R", line(5.4, 10)), 2: ("R", line(13, 15)), 3: ("Other", line(15.4, 20))}
    assert owners(spark, parts, {4: at(1)})[0] == {0: [4], 1: [4], 2: [902], 3: [903]}
    # Two gauges at one place: the smaller id. The owner's own gauge keeps what ties.
    assert owners(spark, {0: ("R", line(0, 20))}, {7: at(10), 4: at(10)})[0] == {0: [4]}
    assert owners(spark, {0: ("R", line(0, 20))}, {7: at(10), 4: at(10)}, lambda k: 7)[0] == {0: [7]}
    # Slack is measured from the nearest named line, though an unnamed one lies nearer.
    unnamed, named = line(0, 10), [(x, 30.003) for x, _ in line(0, 10)]
    got, _ = owners(spark, {0: (None, unnamed), 1: ("A", named)}, {4: (30.0, line(0, 5)[-1][0])})
    assert got == {0: [4], 1: [4]}


def test_segment_counters(spark):
    at = lambda km: (30.0, line(0, km)[-1][0])
    parts = {0: ("R", line(0, 10)), 1: ("R", line(10, 20)), 2: ("X", line(200, 210))}
    p, g = frames(spark, parts, {4: at(5), 5: at(17)}, lambda k: 900 if k < 2 else 902)
    pieces, cands = rivers.segmentation(p, g)
    kinds = spark.createDataFrame([(0, "MultiLineString"), (2, "LineString"), (50, "Polygon"), (51, "Point")], "feature_id long, kind string")
    assert rivers.segment_stats(kinds, p, pieces, cands).first().asDict() == {
        "features_in": 4, "features_out": 5, "river_features_in": 2, "river_features_out": 3, "features_changed": 1, "parts_touched": 2, "added_vertices": 1, "candidates": 2,
    }
    grouped = {(r.feature_id, r.owner): (r.kind, r.pieces) for r in rivers.regroup(pieces, p).collect()}
    assert grouped == {(0, 4): ("MultiLineString", 2), (0, 5): ("LineString", 1), (2, 902): ("LineString", 1)}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)]
    least = {i: i for e in edges for i in e} | {500: 500}
    for _ in range(len(edges)):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    nodes = spark.createDataFrame([(i,) for i in least], "node long")
    assert {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), nodes).collect()} == least


def test_features_go_to_gauges(spark):
    at = lambda km: (30.0, line(0, km)[-1][0])
    parts = {0: ("R", line(0, 10)), 1: ("R", line(10, 20)), 2: ("R", line(20, 30)), 3: ("R", line(35, 38)), 4: ("S", line(20, 25)), 5: (None, line(50, 60)), 6: ("R", line(90, 99))}
    p, g = frames(spark, parts, {4: at(2), 5: at(19), 6: at(55), 7: (31.0, -100.0)})
    sq = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]
    shape = "lake_id long, polys array<array<array<struct<lon:double,lat:double>>>>"
    lakes = spark.createDataFrame([(1, [[sq(at(2)[1] + 0.001, 29.999, 0.01)]]), (2, [[sq(at(19)[1] - 0.05, 29.95, 0.1)]]), (3, [[sq(-99.0, 31.0, 0.1)]])], shape)
    got = {(r.kind, r.id): r.gauge_id for r in features.feature_gauges(g, p, lakes).collect()}
    assert got == {("line", 0): 4, ("line", 1): 5, ("line", 2): 5, ("line", 3): 5, ("line", 5): 6, ("lake", 1): 4, ("lake", 2): 5}
    joined = {r.part_id: r.gauge_id for r in features.line_gauges(g, p, connected=True).collect()}
    assert joined == {0: 4, 1: 5, 2: 5, 5: 6}
