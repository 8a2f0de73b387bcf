"""Nearest rows picked in the cell where both sides meet, and shifts of a line in its row: the same results as from all pairs or windows."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strideframe.functions import geo
from strideframe.operators import kernels, layers, lines

BOXED = "minx double, miny double, maxx double, maxy double"


def test_nearest_segment_of_each_line_matches_all_pairs(spark):
    rnd = random.Random(6)
    rings = []
    for k in range(160):
        x, y = rnd.uniform(0, 1500), rnd.uniform(0, 700)
        rings.append((k // 2 if k < 20 else k, [(x, y), (x + rnd.uniform(20, 200), y), (x + rnd.uniform(0, 90), y + rnd.uniform(5, 60))]))
    segs = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in r], *(f(p[i] for p in r) for f, i in ((min, 0), (min, 1), (max, 0), (max, 1)))) for k, r in rings], f"segment_id long, ring array<struct<x:double,y:double>>, {BOXED}")
    ways = [(k, k % 3, *(rnd.uniform(0, 1500), rnd.uniform(0, 700)) * 2) for k in range(60)]
    ways = [(k, i, x, y, x + rnd.uniform(-120, 120), y + rnd.uniform(-120, 120)) for k, i, x, y, _, _ in ways]
    p = spark.createDataFrame(ways, "route_id long, i int, x1 double, y1 double, x2 double, y2 double").select(
        "*", F.least("x1", "x2").alias("rminx"), F.least("y1", "y2").alias("rminy"), F.greatest("x1", "x2").alias("rmaxx"), F.greatest("y1", "y2").alias("rmaxy"))
    got = {(r.route_id, r.i): (r.segment_id, r.metres) for r in layers.nearest_segment(segs, p, ["route_id", "i"], 12.0, ["x1"], ["minx"]).collect()}
    want, ring = {}, pa.array([[{"x": x, "y": y} for x, y in r] for _, r in rings])
    for k, i, *e in ways:
        gaps = np.round(kernels.ring_piece(ring, *(pa.array([v] * len(rings)) for v in e)), 6)
        gap, segment = min((g, s) for g, (s, _) in zip(gaps.tolist(), rings))
        if gap <= 12:
            want[k, i] = (segment, gap)
    assert got == want and {g > 0 for _, g in want.values()} == {True, False} and len(want) < 60


def test_shares_of_samples_take_the_nearest_probe(spark):
    rnd = random.Random(7)
    smp = [(k, n, rnd.uniform(0, 900), rnd.uniform(0, 500)) for k in range(25) for n in range(6)]
    probes = [(k, k % 3 == 0, *(rnd.uniform(-50, 950), rnd.uniform(-50, 550))) for k in range(90)]
    probes = [(k, r, x, y, x + rnd.uniform(-80, 80), y + rnd.uniform(-80, 80)) for k, r, x, y in probes]
    probes += [(k + 100, not r, *e) for k, r, *e in probes[:30]]  # as near as another: the smaller number counts
    out = lines.sample_class_share(spark.createDataFrame(smp, "route_id long, n long, px double, py double"), spark.createDataFrame(probes, "zone_id long, road boolean, x1 double, y1 double, x2 double, y2 double"), ["route_id"], "zone_id", "road", 40.0)
    want = {}
    for k, _n, x, y in smp:
        gaps = kernels._segment_point(x, y, *(np.array(v) for v in zip(*[e for _, _, *e in probes])))
        gap, _, road = min((round(g, 6), z, r) for g, (z, r, *_) in zip(gaps.tolist(), probes))
        known, roads = want.get(k, (0, 0))
        want[k] = (known + (gap <= 40), roads + (gap <= 40 and road))
    assert {r.route_id: (r.known, r.road_share) for r in out.collect()} == {k: (a, b / a if a >= 3 else None) for k, (a, b) in want.items()}
    assert any(a < 3 for a, _ in want.values()) and any(a == 6 for a, _ in want.values())


def test_outlines_that_hold_points_do_not_search_around(spark, monkeypatch):
    rnd = random.Random(3)
    pts = [(k, rnd.uniform(0, 600), rnd.uniform(0, 600)) for k in range(3000)] + [(3000, 2000.0, 300.0)]
    segs = [(k, x, y, x + rnd.uniform(1, 300), y + rnd.uniform(1, 30)) for k, (x, y) in enumerate((rnd.uniform(0, 600), rnd.uniform(0, 600)) for _ in range(80))]
    segs += [(80, 1000.0, 200.0, 1100.0, 210.0), (81, 30.0, 30.0, 30.5, 30.5)]
    s = spark.createDataFrame(segs, f"segment_id long, {BOXED}").withColumns({"x": F.col("minx"), "y": F.col("miny"), "ring": geo.box_ring("minx", "miny", "maxx", "maxy")})
    searched = []
    search = layers.nearest_pairs
    monkeypatch.setattr(layers, "nearest_pairs", lambda left, *a, **k: searched.append(left) or search(left, *a, **k))
    got = {r.segment_id: (r.near, r.light) for r in layers.nearest_point(s, spark.createDataFrame(pts, "light_id long, px double, py double"), "light_id", 2000.0, 50.0, "near", {"light_id": "light"}).collect()}
    want = {}
    for k, x0, y0, x1, y1 in segs:
        want[k] = min((round(math.hypot(max(x0 - x, x - x1, 0), max(y0 - y, y - y1, 0)), 6), i) for i, x, y in pts)
    assert got == want
    left = {r.segment_id for r in searched[0].select("segment_id").collect()}
    assert left == {k for k, (gap, _) in want.items() if gap > 0} and 2 <= len(left) < 40  # all 82 before


def test_shifts_in_the_row_are_those_of_windows(spark):
    rnd, rows = random.Random(11), []
    for k in range(40):
        x, y, turn = 0.0, 0.0, 0.0
        for n in range(rnd.choice([1, 2, 3, 7, 30])):
            rows.append((k, n, x, y, rnd.choice([None, None, 0, 4, 5, 6, 7, -3])))
            turn += rnd.choice([0, 0, 0.1, 0.5, 1.5])
            x, y = x + rnd.choice([28, 0.2]) * math.cos(turn), y + 28 * math.sin(turn)
    smp = spark.createDataFrame(rows, "route_id long, n long, px double, py double, s long")
    nested = smp.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("n", "px", "py", "s"))).alias("samples"))
    flat, row = (lines.side_shift(df, ["route_id"], "s") for df in (smp, nested))
    want = {(r.route_id, r.n): r["shift"] for r in flat.collect()}
    got = {(r.route_id, p.n): p["shift"] for r in row.collect() for p in r.samples}
    assert got == pytest.approx(want, abs=1e-9) and sum(v != 0 for v in want.values()) > 40
    reports = [{r.route_id: tuple(r) for r in lines.shift_report(df, ["route_id"], "s").collect()} for df in (flat, row)]
    assert reports[0] == reports[1]
    assert "Window" not in row._jdf.queryExecution().optimizedPlan().toString()  # windows shuffled every sample
