"""Distributed operators against brute force on small, skewed data."""

import heapq

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strideframe.functions import geo
from strideframe.operators import aggregates, corridor, graph, grid, layers, lines, ordering, outings, quality, routes, scoring


def box_segments(spark, rows):
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["segment_id", "minx", "miny", "maxx", "maxy"]))
    return df.withColumns({"x": (F.col("minx") + F.col("maxx")) / 2, "y": (F.col("miny") + F.col("maxy")) / 2,
                           "ring": geo.box_ring("minx", "miny", "maxx", "maxy")})


def rect_distance(s, p):
    return np.hypot(max(s[1] - p[0], p[0] - s[3], 0), max(s[2] - p[1], p[1] - s[4], 0))


@pytest.fixture(scope="module")
def scene(spark):
    rng = np.random.default_rng(11)
    lo = rng.uniform(0, 3000, (60, 2))
    segs = [(i, a, b, a + rng.uniform(5, 400), b + rng.uniform(2, 9)) for i, (a, b) in enumerate(lo)]
    pts = np.vstack([rng.uniform(0, 3000, (300, 2)), np.full((200, 2), 777.7), rng.normal(1500, 4, (200, 2))])
    points = pd.DataFrame({"pid": range(len(pts)), "px": pts[:, 0], "py": pts[:, 1]})
    return segs, points, box_segments(spark, segs), spark.createDataFrame(points)


@pytest.mark.parametrize("side", [40.0, 500.0])
def test_counts_do_not_depend_on_cell_size(scene, side):
    segs, points, sdf, pdf = scene
    pos = layers.at_positions(pdf, {"n_": F.count(F.lit(1))})
    got = {r.segment_id: r.n for r in layers.near_pairs(sdf, pos, 60.0, side).groupBy("segment_id").agg(F.sum("n_").alias("n")).collect()}
    want = {s[0]: sum(rect_distance(s, p) <= 60 for p in points[["px", "py"]].to_numpy()) for s in segs}
    assert got == {k: v for k, v in want.items() if v}


def test_hot_cells_are_split_without_loss(scene, monkeypatch):
    segs, points, sdf, pdf = scene
    few = grid.by_cell(sdf.select("segment_id", *grid.BOX), 500.0)
    many = pdf.withColumn("cx", F.floor(F.col("px") / 500)).withColumn("cy", F.floor(F.col("py") / 500))
    a, b, keys = grid.split_hot_cells(many, few, F.col("pid"), F.col("segment_id"), target=20)
    assert a.select("l_share").distinct().count() > 3
    plain = few.join(many, ["cx", "cy"]).count()
    assert b.join(a, keys).count() == plain
    assert a.select("pid").distinct().count() == len(points)


@pytest.mark.parametrize("reach", [150.0, 2500.0])
def test_nearest_point_is_exact(scene, reach):
    segs, points, sdf, pdf = scene
    got = {r.segment_id: r.d for r in layers.nearest_point(sdf, pdf.filter("pid % 9 = 0 OR pid > 499"), "pid", reach, 60.0, "d").collect()}
    live = points[(points.pid % 9 == 0) | (points.pid > 499)][["px", "py"]].to_numpy()
    want = {s[0]: min(rect_distance(s, p) for p in live) for s in segs}
    want = {k: v for k, v in want.items() if v <= reach}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_box_pairs_come_once(spark, scene):
    segs, _, sdf, _ = scene
    right = sdf.select(F.col("segment_id").alias("r"), *[F.col(c).alias("r" + c) for c in grid.BOX])
    pairs = grid.box_box_pairs(sdf.select("segment_id", *grid.BOX), right, 70.0, 20.0).select("segment_id", "r").collect()
    want = {(a[0], b[0]) for a in segs for b in segs if b[1] <= a[3] + 20 and b[3] >= a[1] - 20 and b[2] <= a[4] + 20 and b[4] >= a[2] - 20}
    assert len(pairs) == len(set(pairs)) and {tuple(p) for p in pairs} == want


def test_percentile_rank_with_a_value_that_owns_most_rows(spark):
    rng = np.random.default_rng(2)
    v = np.where(rng.random(3000) < 0.6, 0.0, rng.integers(1, 400, 3000) / 7)
    pdf = pd.DataFrame({"id": range(3000), "v": v, "ok": rng.random(3000) < 0.8})
    pdf.loc[pdf.id % 13 == 0, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v")))
    got = ordering.percentile_rank(df, "v", "pct", F.col("ok")).toPandas().set_index("id").pct.sort_index()
    ref = pdf[pdf.ok & pdf.v.notna()].v.rank(method="average", pct=True)
    want = pd.Series(0.5, index=pdf.index)
    want[ref.index] = ref
    assert len(got) == 3000 and np.allclose(got.to_numpy(), want.to_numpy())


def test_exact_quantiles_and_running_totals(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 2000), "v": np.round(rng.gamma(1, 9, 2000), 1), "pos": range(2000)})
    df = spark.createDataFrame(pdf)
    q = ordering.exact_quantiles(df, "v", {"a": 0.1, "m": 0.5, "z": 0.9}, ["g"]).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert np.allclose(q.loc[g], np.quantile(part.v, [0.1, 0.5, 0.9]))
    t = ordering.chunked_total(df, ["g"], "pos", F.col("v"), "run", chunk=100).toPandas().sort_values("pos")
    assert np.allclose(t.run, pdf.groupby("g").v.cumsum())


def test_halo_windows_match_plain_windows(spark):
    from pyspark.sql import Window
    df = spark.range(500).select(F.lit(1).alias("g"), F.col("id").alias("n"), (F.col("id") * 37 % 101).alias("v"))
    spread, w, home = ordering.with_halo(df, ["g"], "n", 2, 2, chunk=16)
    got = spread.withColumn("s", F.sum("v").over(w.rowsBetween(-2, 2))).filter(home).select("n", "s").collect()
    plain = df.withColumn("s", F.sum("v").over(Window.partitionBy("g").orderBy("n").rowsBetween(-2, 2))).select("n", "s").collect()
    assert sorted(got) == sorted(plain)


def dijkstra(edges, src):
    adj = {}
    for u, v, c in edges:
        adj.setdefault(u, []).append((v, c))
        adj.setdefault(v, []).append((u, c))
    best, todo = {src: 0.0}, [(0.0, src)]
    while todo:
        d, n = heapq.heappop(todo)
        if d > best[n]:
            continue
        for m, c in adj.get(n, []):
            if d + c < best.get(m, 1e18):
                best[m] = d + c
                heapq.heappush(todo, (d + c, m))
    return best


def test_batch_paths_match_a_plain_search(spark):
    rng = np.random.default_rng(8)
    e = [(int(a), int(b), float(c)) for a, b, c in zip(rng.integers(0, 40, 90), rng.integers(0, 40, 90), rng.uniform(1, 50, 90)) if a != b]
    req = [(1, 0, 7), (2, 3, 21), (3, 5, 5), (4, 9, 999)]
    edges = spark.createDataFrame(e, "u long, v long, cost double")
    requests = spark.createDataFrame(req, "od_id long, src long, dst long")
    lab = graph.batch_paths(edges, requests)
    got = {r.od_id: r.g for r in requests.join(lab.withColumnRenamed("node", "dst"), ["od_id", "dst"]).collect()}
    want = {i: dijkstra(e, s)[d] for i, s, d in req if d in dijkstra(e, s)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    hops = graph.trace_paths(lab, requests).toPandas()
    cost = {frozenset((u, v)): min(c for a, b, c in e if {a, b} == {u, v}) for u, v, _ in e}
    for i, _, _ in req[:2]:
        if i in want:
            assert abs(sum(cost[frozenset((r.u, r.v))] for r in hops[hops.od_id == i].itertuples()) - want[i]) < 1e-9


def line_df(spark, coords, rid=1):
    return spark.createDataFrame([(rid, [tuple(map(float, c)) for c in coords])], "route_id long, line array<struct<x:double,y:double>>")


def test_clean_triangle_and_triangle_with_a_spur(spark):
    clean = [(0, 0), (400, 0), (200, 350), (0, 0)]
    spur = [(0, 0), (400, 0), (400, 100), (400, 0), (200, 350), (0, 0)]
    both = line_df(spark, clean, 1).unionByName(line_df(spark, spur, 2))
    smp = lines.samples(both, ["route_id"], 28.0)
    starts = both.select("route_id", F.col("line")[0]["x"].alias("sx"), F.col("line")[0]["y"].alias("sy"))
    m = {r.route_id: r for r in lines.spur_measure(smp, ["route_id"], starts).collect()}
    assert m[1].worst_spur_m < 60 <= 70 <= m[2].worst_spur_m


def test_line_coverage_against_sampling(spark):
    rng = np.random.default_rng(1)
    route = line_df(spark, rng.uniform(0, 500, (6, 2)))
    other = rng.uniform(0, 500, (12, 4))
    odf = spark.createDataFrame(pd.DataFrame(other, columns=["x1", "y1", "x2", "y2"]))
    p = lines.pieces(route, ["route_id"])
    c = lines.covered_metres(p, corridor.cover_intervals(p, odf, "route_id", 30.0), ["route_id"]).first()
    t = (np.arange(4000) + 0.5) / 4000
    total = covered = 0.0
    from strideframe.operators.kernels import _segment_point
    for r in p.collect():
        length = np.hypot(r.x2 - r.x1, r.y2 - r.y1)
        x, y = r.x1 + t * (r.x2 - r.x1), r.y1 + t * (r.y2 - r.y1)
        near = np.zeros(len(t), bool)
        for o in other:
            near |= _segment_point(x, y, *o) <= 30
        total, covered = total + length, covered + length * near.mean()
    assert c.length_m == pytest.approx(total) and c.covered_m == pytest.approx(covered, rel=3e-3)


def test_way_scores_against_sampling(spark):
    segs = box_segments(spark, [(1, 0.0, 0.0, 60.0, 10.0), (2, 40.0, 5.0, 90.0, 30.0), (3, 500.0, 500.0, 510.0, 510.0)])
    segs = segs.withColumn("day", F.when(F.col("segment_id") == 1, 40.0).otherwise(80.0))
    ways = spark.createDataFrame([(7, 5.0, 3.0, 85.0, 18.0), (8, 900.0, 0.0, 950.0, 0.0)], "way_id long, x1 double, y1 double, x2 double, y2 double")
    got = {r.way_id: r for r in layers.way_scores(ways, segs, ("day",)).collect()}
    g = np.arange(-15, 110, 0.1) + 0.05
    x, y = np.meshgrid(g, g)
    from strideframe.operators.kernels import _segment_point
    near = _segment_point(x, y, 5, 3, 85, 18) <= 12
    a1 = (near & (x >= 0) & (x <= 60) & (y >= 0) & (y <= 10)).sum()
    a2 = (near & (x >= 40) & (x <= 90) & (y >= 5) & (y <= 30)).sum()
    assert got[7].day == pytest.approx((40 * a1 + 80 * a2) / (a1 + a2), rel=2e-3)
    assert 0 < got[7].score_coverage <= 1 and got[8].day is None and got[8].score_coverage == 0


def test_projection_known_point(spark):
    r = spark.range(1).select(geo.to_metric(F.lit(147.0), F.lit(-38.0)).alias("m")).first().m
    assert r.x == pytest.approx(500000.0, abs=1e-6)
    # meridian arc of 38 degrees on GRS80 times 0.9996
    assert r.y == pytest.approx(10000000 - 0.9996 * 4207498.019, abs=0.05)


def test_worked_scores(spark):
    one = spark.range(1)
    day = one.select(scoring.index_blend(F.lit(78.0), F.lit(60.0), F.lit(True)).alias("v")).first().v
    assert day == pytest.approx(70.8)
    row = one.select(F.lit(7.5).alias("streetlight_nearest_m"), F.lit(None).cast("double").alias("park_light_nearest_m"), F.lit(1).alias("streetlight_count_30m"), F.lit(0).alias("park_light_count_50m"), F.lit(1606.0).alias("length_m"))
    row = row.withColumns(scoring.combined_lighting())
    r = row.select(F.round("light_density", 2).alias("d"), scoring.lighting_score_by_count().alias("old"), scoring.lighting_score().alias("new")).first()
    assert (r.d, r.old, r.new) == (0.06, 96.0, 35.0)


def test_edge_costs(spark):
    def value(c):
        return spark.range(1).select(c.alias("v")).first().v

    for hw, away, want in (("footway", False, 1.0), ("residential", False, 1.75), ("secondary", False, 2.0), ("service", False, 1.25), ("path", True, 0.75), ("footway", True, 1.45), ("residential", True, 2.5)):
        assert value(graph.class_multiplier(F.lit(hw), away)) == want

    def cost(length, hw):
        return value(graph.edge_cost(F.lit(float(length)), F.lit(70.0), 40, 80, F.lit(hw)))

    assert cost(379, "footway") < cost(335, "residential")
    assert cost(200, "residential") < cost(500, "footway")


def test_min_null_and_duplicate_flag(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, flag string")
    got = {r.flag: r.qa for r in quality.duplicate_key_flag(df, "k", "dup", "flag", "qa").collect()}
    assert got == {"a": "dup", "b": "dup", "c": "c", "d": "d"}


def test_greedy_picks_one_hot_request(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"od": np.where(np.arange(400) < 300, 1, np.arange(400)), "card": range(400), "d": np.round(rng.uniform(0, 1000, 400), 3)})
    got = routes.greedy_picks(spark.createDataFrame(pdf), "od", "card", ["d"], lambda c, p: F.abs(c["d"] - p["d"]) < 50, 3, ["d"]).toPandas()
    hot = pdf[pdf.od == 1].sort_values("d")
    want = []
    for r in hot.itertuples():
        if len(want) < 3 and all(abs(r.d - w.d) >= 50 for w in want):
            want.append(r)
    assert got[got.od == 1].sort_values("pick").card.tolist() == [w.card for w in want]


def test_compass_turns_stay_in_the_box(spark):
    s = spark.createDataFrame([(1, 145.3, -38.1), (2, 145.419, -37.951)], "start_id long, lng double, lat double").withColumn("via_m", F.lit(600.0))
    t = outings.compass_turns(s, "start_id")
    n = {r.start_id: r["count"] for r in t.groupBy("start_id").count().collect()}
    assert n[1] == 72 and n.get(2, 0) < 72
    d = t.select(geo.haversine("lng", "lat", "alng", "alat").alias("d"), "radius").toPandas()
    assert np.allclose(d.d, d.radius, rtol=1e-6)


def test_destination_and_bearing_agree(spark):
    r = spark.range(1).select(geo.destination(F.lit(145.3), F.lit(-38.1), F.lit(1000.0), F.lit(77.0)).alias("d"))
    r = r.select(geo.haversine(F.lit(145.3), F.lit(-38.1), "d.lng", "d.lat").alias("m"), geo.bearing(F.lit(145.3), F.lit(-38.1), "d.lng", "d.lat").alias("b")).first()
    assert r.m == pytest.approx(1000) and r.b == pytest.approx(77, abs=1e-3)


def test_paths_longer_than_any_fixed_number_of_steps(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(64)], "u long, v long, cost double").coalesce(1)
    requests = spark.createDataFrame([(1, 0, 55), (2, 0, 64), (3, 7, 7)], "od_id long, src long, dst long").coalesce(1)
    lab = graph.batch_paths(edges, requests)
    got = {r.od_id: r.g for r in requests.join(lab.withColumnRenamed("node", "dst"), ["od_id", "dst"]).collect()}
    assert got == {1: 55.0, 2: 64.0, 3: 0.0}


def test_traced_paths_of_requests_that_stand_still(spark):
    edges = spark.createDataFrame([(1, 2, 1.0)], "u long, v long, cost double")
    requests = spark.createDataFrame([(1, 1, 1), (2, 1, 9)], "od_id long, src long, dst long")
    hops = graph.trace_paths(graph.batch_paths(edges, requests), requests)
    assert hops.columns == ["od_id", "hop", "u", "v"] and hops.count() == 0


def test_null_is_a_group_of_its_own(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 7.0), (None, None)], "g string, v double")
    assert {r.g: r.m for r in ordering.exact_quantiles(df, "v", {"m": 0.5}, ["g"]).collect()} == {"a": 2.0, None: 6.0}
    s = {r.g: (r.median, r.n, r.null_count) for r in aggregates.score_summary(df, "v", ["g"]).collect()}
    assert s == {"a": (2.0, 2, 0), None: (6.0, 3, 1)}
    assert {(r.g, r.n) for r in ordering.group_min(df, ["g"], [F.count("*").alias("n")]).collect()} == {("a", 2), (None, 3)}


def test_segments_without_a_suburb_count_for_their_ward_and_the_whole(spark):
    df = spark.createDataFrame([("s", "w", 1), (None, "w", 1), (None, None, 1)], "suburb string, ward string, x int")
    rows = {(r.level, r.suburb, r.ward): r.n for r in aggregates.reporting_levels(df, "suburb", "ward", [F.count("*").alias("n")]).collect()}
    assert rows == {("small", "s", None): 1, ("large", None, "w"): 2, ("whole", None, None): 3}


@pytest.mark.parametrize("when, lat, lng, want", [
    # equinox noon on the equator, solstice noon on a tropic, and their midnights
    ("2024-03-20 12:07:00", 0.0, 0.0, 89.6), ("2024-06-20 12:02:00", 23.44, 0.0, 89.9), ("2024-06-20 00:02:00", -23.44, 0.0, -89.9), ("2024-12-21 12:00:00", -66.56, 0.0, 46.9),
])
def test_sun_stands_where_almanacs_say(spark, when, lat, lng, want):
    got = spark.sql(f"SELECT TIMESTAMP '{when}' AS t").select(scoring.solar_elevation(F.col("t"), lat, lng).alias("e")).first().e
    assert abs(got - want) < 0.4


def test_lines_are_measured_without_a_shuffle(spark):
    df = line_df(spark, [(0, 0), (3, 4), (3, 4), (3, 10)])
    plan = lines.samples(df, ["route_id"], 2.0)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    s = {r.n: (r.along, round(r.px, 6), round(r.py, 6)) for r in lines.samples(df, ["route_id"], 2.0).collect()}
    assert s[0] == (0.0, 0.0, 0.0) and s[5] == (10.0, 3.0, 9.0) and s[6] == (11.0, 3.0, 10.0) and len(s) == 7


@pytest.mark.parametrize("hot_side", ["left", "right"])
def test_hot_cells_are_split_on_either_side(spark, hot_side):
    many = spark.range(900).select(F.col("id").alias("a"), F.lit(0).alias("cx"), F.lit(0).alias("cy")).union(spark.range(900, 1000).select("id", F.lit(1), F.lit(1)))
    few = spark.createDataFrame([(k, k % 2, k % 2) for k in range(10)], "b long, cx int, cy int")
    left, right = (many, few) if hot_side == "left" else (few, many)
    keys = [F.col(left.columns[0]), F.col(right.columns[0])]
    l, r, on = grid.split_hot_cells(left, right, *keys, target=50)
    assert l.groupBy(*on).count().agg(F.max("count")).first()[0] <= 120 and r.groupBy(*on).count().agg(F.max("count")).first()[0] <= 120
    got = sorted(tuple(x) for x in l.join(r, on).select("a", "b").collect())
    assert got == sorted((a, b) for a in range(1000) for b in range(10) if (a >= 900) == (b % 2 == 1))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sides_that_grow_are_not_broadcast(scene):
    _, _, segs, pts = scene
    near = layers.nearest_point(segs, pts, "pid", 600.0, 100.0, "d")
    inside = grid.box_point_pairs(segs.select(*layers.SHAPE), pts, 100.0, 25.0, split=False)
    for df in (near, inside):
        assert "BroadcastHashJoin" not in plan_of(df)
    # the short list of hot cells may be
    boxes = segs.select(F.col("segment_id").alias("other"), *[F.col(c).alias("r" + c) for c in grid.BOX])
    both = plan_of(grid.box_box_pairs(segs.select(*layers.SHAPE), boxes, 100.0))
    assert "SortMergeJoin [lvl" in both


def test_near_samples_are_listed_in_few_cells(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k) % 3, n, float(x), float(y)) for n, (k, x, y) in enumerate(zip(rng.integers(0, 9, 400), rng.uniform(-150, 150, 400), rng.uniform(-150, 150, 400), strict=True))]
    a, b = rows[::2], [*rows[1::2], (0, 999, 60.0, 60.0)]
    a += [(0, 1001, 45.0, 60.0), (0, 1002, 75.0, 60.0), (0, 1003, 60.0, 75.5), (0, 1001, 45.0, 60.0)]  # at the rim, beyond it, and twice
    cols = "route_id long, n long, px double, py double"
    left = spark.createDataFrame(a + [(0, 1004, None, 1.0)], cols)
    hit = lines.near_any(left, spark.createDataFrame(b, cols).drop("n"), ["route_id"], 15.0)
    want = {r[1] for r in a if any(r[0] == s[0] and (r[2] - s[2]) ** 2 + (r[3] - s[3]) ** 2 <= 225 for s in b)}
    assert sorted(r["n"] for r in hit.collect()) == sorted(want)
    listed = lines.listed_near(left.filter("px IS NOT NULL"), 15.0).count()
    assert listed < 3 * (len(a))
