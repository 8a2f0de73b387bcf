"""Searches that depend on searches, graph rebuild, draw order, overlaps and timing sketches against plain Python."""

import heapq
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strideframe.operators import corridor, graph, lines, ordering, outings, reports, routes
from strideframe.operators import aggregates as A
from strideframe.operators import kernels as K
from strideframe.streaming import sessions as T


def dijkstra(arcs, src, dst, factor=lambda u, v: 1.0):
    best, todo = {src: (0.0, None)}, [(0.0, src)]
    while todo:
        g, u = heapq.heappop(todo)
        if g > best[u][0]:
            continue
        for v, c in arcs.get(u, {}).items():
            new = g + c * factor(u, v)
            if v not in best or new < best[v][0]:
                best[v] = (new, u)
                heapq.heappush(todo, (new, v))
    path, at = [], dst
    while at in best and best[at][1] is not None:
        path.append((best[at][1], at))
        at = best[at][1]
    return path[::-1]


def both(edges):
    arcs = {}
    for u, v, c in edges:
        for a, b in ((u, v), (v, u)):
            arcs.setdefault(a, {})[b] = min(c, arcs.get(a, {}).get(b, math.inf))
    return arcs


@pytest.fixture(scope="module")
def net():
    rng = random.Random(5)
    grid = [(i, j) for i in range(7) for j in range(7)]
    ids = {p: k for k, p in enumerate(grid)}
    edges = [(ids[i, j], ids[i + a, j + b], 40 + rng.random() * 60) for i, j in grid for a, b in ((0, 1), (1, 0), (1, 1)) if (i + a, j + b) in ids and rng.random() < 0.85]
    return edges + [(100, 101, 5.0)]


def test_circuits_shun_edges_of_earlier_legs(spark, net):
    edges = spark.createDataFrame(net, "u int, v int, cost double")
    loops = [(1, "plain", 0, 24, 27, None), (1, "x4", 0, 24, 27, 4.0), (2, "x8", 48, 3, 10, 8.0), (3, "x4", 0, 100, 5, 4.0), (4, "x4", 5, 5, 20, 4.0)]
    hops = graph.circuits(edges, spark.createDataFrame(loops, "od_id int, variant string, start int, a int, b int, factor double")).collect()
    arcs = both(net)
    for od, variant, s, a, b, f in loops[:3]:
        used = set()
        for leg, (x, y) in enumerate(((s, a), (a, b), (b, s)), 1):
            want = dijkstra(arcs, x, y, lambda u, v, u0=frozenset(used), f=f: f if f and frozenset((u, v)) in u0 else 1.0)
            got = [(h.u, h.v) for h in sorted((h for h in hops if (h.od_id, h.variant, h.leg) == (od, variant, leg)), key=lambda h: -h.hop)]
            assert got == want and got
            used |= {frozenset(e) for e in want}
    assert not [h for h in hops if h.od_id in (3, 4)]


def test_circuit_report_counts_shared_metres(spark):
    hops = [(1, "v", 1, 0, "a", "b"), (1, "v", 1, 1, "b", "c"), (1, "v", 2, 0, "c", "b"), (1, "v", 3, 0, "b", "a"), (2, "v", 1, 0, "a", "b")]
    h = spark.createDataFrame(hops, "od_id int, variant string, leg int, hop int, u string, v string")
    arcs = spark.createDataFrame([(u, v, m) for a, b, m in (("a", "b", 100.0), ("b", "c", 30.0)) for u, v in ((a, b), (b, a))], "u string, v string, length_m double")
    r = graph.circuit_report(h, arcs, (100.0, 300.0)).collect()
    assert len(r) == 1 and (r[0].distance_m, r[0].overlap_12_m, r[0].overlap_23_m, r[0].overlap_13_m) == (260.0, 30.0, 0.0, 100.0)
    assert r[0].revisit_ratio == 0.5 and r[0].in_band == (100 <= 260 / 1.3 <= 300)
    legs = {x.leg: (x.n_edges, x.distance_m, x.reused_m) for x in graph.leg_report(h, arcs).filter("od_id = 1").collect()}
    assert legs == {1: (2, 130.0, 0.0), 2: (1, 30.0, 30.0), 3: (1, 100.0, 100.0)}


def test_searches_under_several_costs_are_one(spark, net):
    rng = random.Random(9)
    kinds = {k: [(u, v, c * (1 + rng.random())) for u, v, c in net] for k in ("p", "q")}
    edges = spark.createDataFrame([(k, *e) for k, es in kinds.items() for e in es], "kind string, u int, v int, cost double")
    ask = [(i, k, i * 3, 48 - i) for i in range(5) for k in kinds]
    req = spark.createDataFrame(ask, "od_id int, kind string, src int, dst int")
    key = ["od_id", "kind"]
    hops = graph.trace_paths(graph.batch_paths(edges, req, key, ["kind"]), req, key).collect()
    for od, k, s, d in ask:
        got = [(h.u, h.v) for h in sorted((h for h in hops if (h.od_id, h.kind) == (od, k)), key=lambda h: -h.hop)]
        assert got == dijkstra(both(kinds[k]), s, d)


def test_tracing_takes_jobs_by_the_logarithm(spark, monkeypatch):
    n = 70
    req = spark.createDataFrame([(1, 0, n)], "od_id int, src int, dst int")
    labels = spark.createDataFrame([(1, k, float(k), k - 1 if k else None, k) for k in range(n + 1)], "od_id int, node int, g double, prev int, round int")
    made = []
    monkeypatch.setattr(graph, "settle", lambda df, name="step", f=graph.settle: made.append(name) or f(df, name))
    hops = sorted((h.hop, h.u, h.v) for h in graph.trace_paths(labels, req).collect())
    assert hops == [(k, n - 1 - k, n - k) for k in range(n)]
    assert len(made) <= 2 * math.ceil(math.log2(n)) + 4


def test_drawn_route_falls_back_when_the_detour_is_long(spark):
    def arcs(kind, rows):
        return [(kind, a, b, float(c), float(m), hw) for u, v, c, m, hw in rows for a, b in ((u, v), (v, u))]

    road, park, wide = (1, 2, 100, 100, "residential"), (1, 3, 60, 60, "path"), (3, 2, 60, 60, "path")
    dear = lambda e, c: (*e[:2], c, *e[3:])
    rows = arcs("distance", [road, park, wide]) + arcs("quality", [dear(road, 175), park, wide]) + arcs("calm_base", [dear(road, 100), dear(park, 90), dear(wide, 90)]) + arcs("calm", [dear(road, 100), dear(park, 90), dear(wide, 90)]) + arcs("steady", [dear(road, 500), park, wide])
    table = spark.createDataFrame(rows, "kind string, u int, v int, cost double, length_m double, hw string")
    ask = [(1, 1, 2, "steady", None, False, 1.15), (2, 1, 2, "calm", "calm_base", True, 1.6), (3, 1, 2, "calm", "calm_base", True, 1.1), (4, 1, 2, "steady", None, False, 1.05), (5, 1, 9, "steady", None, False, 1.05)]
    req = spark.createDataFrame(ask, "od_id int, src int, dst int, profile string, base string, away boolean, cap double")
    got = {r.od_id: (r.kept, r.distance_m, r.detour, r.pathish_share) for r in graph.drawn_routes(table, req).collect()}
    # 1 and 4: on paths and within 1.2; 2: the base takes the road, the penalty sends it through the park; 3: that is too long, so the base stays
    assert got == {1: ("score", 120.0, 1.2, 1.0), 2: ("score", 120.0, 1.2, 1.0), 3: ("default", 100.0, 1.2, 0.0), 4: ("score", 120.0, 1.2, 1.0)}


def test_rebuilt_graph_keeps_edges_and_lengths(spark):
    pieces = []
    for way, (hw, side, y) in enumerate([("residential", 1, 0.0), ("Primary; x", -1, 500.0), ("footway", 1, 1000.0), ("residential", None, 1500.0), ("residential", 1, 0.0)]):
        for i in range(4):
            pieces.append((way, i, way % 2, f"{i}_{y:.0f}", f"{i + 1}_{y:.0f}", i * 100.0, y, i * 100.0 + 100, y, 100.0 + way, side if i in (1, 2) else None, hw, 50.0 if way else None, 40.0))
    p = spark.createDataFrame(pieces, "way int, i int, street int, u string, v string, x1 double, y1 double, x2 double, y2 double, len double, side int, highway string, day double, night double")
    nodes = p.selectExpr("u AS node", "x1 AS nx", "y1 AS ny").union(p.selectExpr("v", "x2", "y2")).distinct()
    crossings = spark.createDataFrame([("k1", 105.0, 1010.0), ("k2", 5.0, 1510.0), ("k3", 210.0, 5.0), ("2_1000", 200.0, 1000.0)], "node string, px double, py double")
    bands = F.struct(*[F.lit(v).alias(n) for n, v in (("d1", 20.0), ("d9", 80.0), ("n1", 20.0), ("n9", 80.0))])
    g = graph.rebuilt_graph(p, crossings, nodes, "way", "street", ("day", "night"), bands).collect()
    base = [r for r in g if not r.synthetic]
    assert len(base) == 16 and len({(r.u, r.v) for r in g}) == len(g)
    assert {(r.u, r.v) for r in base} == {(min(a, b), max(a, b)) for _, _, _, a, b, *_ in pieces}
    # way 4 repeats the edges of way 0 and is longer, at the same neutral score
    assert {r.way for r in base if r.u.endswith("_0")} == {0}
    assert sum(r.length_m for r in base) == sum(100.0 + r.way for r in base)
    turned = {(r.u, r.v): r for r in base if r.sidewalk_of}
    assert {k for k in turned} == {("1_0", "2_0"), ("2_0", "3_0"), ("1_500", "2_500"), ("2_500", "3_500")}
    assert all(r.highway == "sidewalk" for r in turned.values())
    assert turned["1_0", "2_0"].y1 == pytest.approx(4.5) and turned["1_500", "2_500"].y1 == pytest.approx(500 - 4.5 * 100 / 101)
    assert {r.sidewalk_of for r in turned.values()} == {"residential", "primary"}
    links = {(r.u, r.v): r for r in g if r.synthetic}
    # k1 is near the footway, k3 near a road that became a sidewalk, k2 near a road that stayed one; a crossing on a node links to others only
    assert set(links) == {("1_1000", "k1"), ("2_0", "k3")}
    assert links["1_1000", "k1"].length_m == pytest.approx(math.hypot(5, 10)) and links["1_1000", "k1"].cost_day == pytest.approx(math.hypot(5, 10))
    road = next(r for r in base if r.u == "0_1500")
    assert road.cost_day == pytest.approx(103 * (1 + 0.5 - 0.5) * 1.75) and road.cost_night == pytest.approx(103 * (1 + 0.5 - 20 / 60) * 1.75)


def test_draw_order_like_the_plain_rule(spark):
    rng = random.Random(3)
    rows = [(s, k, rng.randrange(0, 400), None if rng.random() < 0.2 else float(rng.randrange(30))) for s, n in ((1, 40), (2, 3), (3, 200)) for k in range(n)]
    df = spark.createDataFrame(rows, "start int, pair int, bearing int, blend double")
    got = {(r.start, r.pair): r.ord for r in outings.draw_order(df, "start", "pair", "bearing", "blend").collect()}
    for s in (1, 2, 3):
        mine = sorted((r for r in rows if r[0] == s and r[3] is not None), key=lambda r: (-r[3], r[1]))
        order = [r[1] for r in mine]
        if len(mine) >= 4:
            q3 = sorted(r[3] for r in mine)[int(len(mine) * 0.75)]
            lead = [next((r[1] for r in mine if r[3] >= q3 and k * 60 <= r[2] < k * 60 + 60), None) for k in range(6)]
            lead = [x for x in lead if x is not None]
            order = lead + [x for x in order if x not in lead]
        order += sorted(r[1] for r in rows if r[0] == s and r[3] is None)
        assert [k for _, k in sorted((o, p) for (g, p), o in got.items() if g == s)] == order
    assert sorted(got.values()) == sorted([*range(1, 41), 1, 2, 3, *range(1, 201)])


def test_row_numbers_of_one_big_group_are_spread(spark):
    df = spark.range(5000).select(F.lit(None).cast("string").alias("g"), F.pmod(F.xxhash64("id"), F.lit(997)).alias("v"), "id")
    got = ordering.row_numbers(df, ["g"], [F.col("v"), F.col("id")])
    rows = sorted((r.v, r.id, r.ord) for r in got.collect())
    assert [o for _, _, o in rows] == list(range(1, 5001))


def test_shift_of_a_straight_line_needs_agreement(spark):
    raw = [5, 5, 5, -5, 5, 5, None, 3, -3, 3, -3, None, 4, 4, 4, 4]
    smp = spark.createDataFrame([(1, n, 28.0 * n, 0.0, None if s is None else float(s)) for n, s in enumerate(raw)], "route_id int, n long, px double, py double, s double")
    got = [r["shift"] for r in sorted(lines.side_shift(smp, ["route_id"], "s").collect(), key=lambda r: r.n)]
    guarded = [5, 5, 5, 0, 5, 5, 0, 0, 0, 0, 0, 0, 4, 4, 4, 4]
    frame = lambda v, i, k: v[max(0, i - k):i + k + 1]
    med = [sorted(frame(guarded, i, 2))[len(frame(guarded, i, 2)) // 2] for i in range(len(raw))]
    assert got == pytest.approx([sum(frame(med, i, 1)) / len(frame(med, i, 1)) for i in range(len(raw))])
    report = lines.shift_report(lines.side_shift(smp, ["route_id"], "s"), ["route_id"], "s").first()
    assert (report.n, report.look_share) == (16, 14 / 16) and report.moved_share == sum(abs(x) >= 0.75 for x in got) / 16


def test_route_overlap_in_metres_stays_in_its_request(spark):
    pieces = spark.createDataFrame([(1, 7, 0, 0.0, 0.0, 100.0, 0.0), (2, 7, 0, 50.0, 5.0, 80.0, 5.0), (2, 7, 1, 80.0, 5.0, 80.0, 90.0), (3, 8, 0, 0.0, 1.0, 100.0, 1.0)], "route int, req int, i int, x1 double, y1 double, x2 double, y2 double")
    got = {(r.route, r.route_b): r.covered_m for r in corridor.route_overlaps(pieces, "route", "req", 10.0).collect()}
    reach = math.sqrt(100 - 25)
    assert set(got) == {(1, 2), (2, 1)}
    assert got[1, 2] == pytest.approx(30 + 2 * reach)
    assert got[2, 1] == pytest.approx(30 + 5)


def test_bent_buffer_area_equals_sampling():
    way = [(0.0, 0.0), (60.0, 10.0), (70.0, 50.0), (40.0, 60.0), (45.0, 20.0)]
    rng = np.random.default_rng(6)
    p = rng.uniform([-20, -20], [100, 80], (400_000, 2))
    hit = np.zeros(len(p), bool)
    for (ax, ay), (bx, by) in zip(way, way[1:], strict=False):
        hit |= K._segment_point(p[:, 0], p[:, 1], ax, ay, bx, by) <= 12
    xy = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    line = pa.array([[{"x": x, "y": y} for x, y in way]] * 2, xy)
    outlines = [[(-20, -20), (100, -20), (100, 80), (-20, 80)], [(20, 0), (90, 0), (60, 70)]]
    shape = pa.array([[{"x": float(x), "y": float(y)} for x, y in o] for o in outlines], xy)
    got = K.buffered_overlay(line, shape, pa.array([12.0, 12.0]), columns=256)
    inside = ((p[:, 1] > 0) & (p[:, 0] - 20 > p[:, 1] * 40 / 70) & (p[:, 0] < 90 - p[:, 1] * 30 / 70))
    assert got[0] == pytest.approx(hit.mean() * 12_000, rel=0.005) and got[1] == pytest.approx((hit & inside).mean() * 12_000, rel=0.005)
    assert K.buffered_overlay(line, shape, pa.array([12.0, 12.0])) == pytest.approx(got, rel=0.005)


def test_dissolved_areas_are_cut_into_pieces(spark):
    df = spark.range(500).selectExpr("id", "CASE WHEN id % 50 = 0 THEN NULL WHEN id < 450 THEN 'big' ELSE 'small' END AS area").withColumn("parts", F.array(F.array(F.array(F.struct(F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))))))
    got = A.dissolved(df, "area", "parts", "id", per_piece=100).collect()
    assert {r.area for r in got} == {"big", "small"} and len({(r.area, r.piece) for r in got}) == len(got)
    assert max(r.n for r in got) < 160 and sum(r.n for r in got if r.area == "big") == 441
    assert sorted(p[0][0]["x"] for r in got for p in r.parts) == sorted(float(i) for i in range(500) if i % 50)


def test_timing_quantiles_are_within_a_hundredth(spark):
    rng = np.random.default_rng(8)
    values = [0.0, -3.0, *np.exp(rng.normal(3, 2, 2000)).tolist()]
    ev = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "value double").withColumn("at", F.to_timestamp(F.lit("2024-01-01 10:00:00")))
    row = T.timing_quantiles(T.timing_counts(ev), {"p50": 0.5, "p95": 0.95, "p0": 0.0}).first()
    ranked = sorted(values)
    assert row.n == len(values) and row.p0 == 0.0
    for name, q in (("p50", 0.5), ("p95", 0.95)):
        want = ranked[int(q * (len(values) - 1))]
        assert abs(row[name] - want) <= 0.0101 * want


def test_even_points_are_interpolated_like_the_plain_rule():
    rng = np.random.default_rng(11)
    shapes = [rng.uniform([145, -38], [145.1, -37.9], (k, 2)) for k in (2, 5, 1, 9)] + [np.zeros((0, 2)), np.repeat(rng.uniform(0, 1, (1, 2)), 3, axis=0), np.array([[0.0, 0], [0, 0], [1, 0], [1, 0], [1, 1]])]
    xy = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    line = pa.array([[{"x": a, "y": b} for a, b in s] for s in shapes], xy)
    got = routes.even_points.func(line, pa.array([7, 4, 3, 7, 7, 5, 5])).to_pylist()
    assert got[4] is None
    for s, k, g in zip(shapes, [7, 4, 3, 7, 7, 5, 5], got, strict=True):
        if len(s):
            a, b = s.T
            far = np.concatenate([[0], np.cumsum(np.hypot(np.diff(a) * np.cos(np.radians((b[1:] + b[:-1]) / 2)), np.diff(b)))])
            at = np.linspace(0, far[-1], k)
            want = np.stack((np.interp(at, far, a), np.interp(at, far, b)), 1) if far[-1] else np.repeat(s[:1], k, axis=0)
            assert np.allclose([(p["x"], p["y"]) for p in g], want, atol=1e-9)


def test_road_share_of_samples(spark):
    smp = spark.createDataFrame([(r, n, 10.0 * n, float(r)) for r in (1, 2, 3) for n in range(6)], "route_id int, n long, px double, py double")
    probes = spark.createDataFrame([(7, True, 0.0, 2.0, 25.0, 2.0), (5, False, 0.0, 2.0, 60.0, 2.0), (9, True, 38.0, 2.5, 60.0, 2.5)], "pid int, road boolean, x1 double, y1 double, x2 double, y2 double")
    got = {r.route_id: (r.known, r.road_share, r.rejected) for r in lines.sample_class_share(smp, probes, ["route_id"], "pid", "road", 1.0).collect()}
    # a tie between two probes goes to the smaller one; the third route's samples 4 and 5 are nearer to the road beside the path
    assert got == {1: (6, 0.0, False), 2: (6, 0.0, False), 3: (6, 2 / 6, True)}
    assert {r.route_id: r.known for r in lines.sample_class_share(smp, probes.filter("pid = 7"), ["route_id"], "pid", "road", 0.5).collect()} == {1: 0, 2: 3, 3: 0}


def test_engine_report_takes_the_best_of_each_side(spark):
    rows = [(1, 10, False, 7.0, 900.0, 0.5), (1, 11, False, 7.0, 800.0, 0.4), (1, 12, True, 7.3, 1000.0, 0.9), (1, 13, True, None, 700.0, 0.9), (2, 20, False, 5.0, 100.0, 0.1), (3, 30, False, 5.0, 100.0, 0.1), (3, 31, True, 5.01, 110.0, 0.2)]
    df = spark.createDataFrame(rows, "od int, route int, challenger boolean, day double, distance_m double, coverage_ratio double")
    got = {r.od: (r.control_day, r.challenger_day, r.control_cover, r.detour, r.winner) for r in reports.engine_report(df, "od", "route", "day").collect()}
    assert got == {1: (7.0, 7.3, 0.5, round(1000 / 700, 6), "challenger"), 3: (5.0, 5.01, 0.1, 1.1, "tie")}
