"""Outlines of several parts with holes: kernels against sampling and plain arithmetic, joins against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strideframe.functions import geo
from strideframe.operators import grid, layers
from strideframe.operators import kernels as K

PARTS = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
RING = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))


def rect(x0, y0, x1, y1, flip=False):
    ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    return ring[::-1] if flip else ring


def as_parts(shapes):
    return pa.array([None if s is None else [[[{"x": x, "y": y} for x, y in r] for r in p] for p in s] for s in shapes], PARTS)


def as_rings(rings):
    return pa.array([[{"x": x, "y": y} for x, y in r] for r in rings], RING)


FRAME = [[rect(0, 0, 10, 10), rect(3, 3, 7, 7)], [rect(20, 0, 30, 10, True), rect(22, 2, 24, 8)]]


def inside(x, y):
    return (0 < x < 10 and 0 < y < 10 and not (3 < x < 7 and 3 < y < 7)) or (20 < x < 30 and 0 < y < 10 and not (22 < x < 24 and 2 < y < 8))


def test_overlay_takes_holes_and_parts_away_whichever_way_rings_turn():
    box = [rect(-5, -5, 50, 50), rect(3, 3, 7, 7), rect(2, 2, 23, 5), rect(11, 0, 19, 10), rect(2, 2, 23, 5, True)]
    got = K.overlay_area(as_parts([FRAME] * 5), as_rings(box))
    assert got == pytest.approx([100 - 16 + 100 - 12, 0, 8 * 3 - 4 * 2 + 3 * 3 - 1 * 3, 0, 8 * 3 - 4 * 2 + 3 * 3 - 1 * 3])
    assert K.overlay_area(as_rings(box), as_parts([FRAME] * 5)) == pytest.approx(got)
    assert K.overlay_area(as_parts([FRAME]), as_parts([FRAME])) == pytest.approx([172])


def test_overlay_of_slanted_frames_equals_sampling():
    rng = np.random.default_rng(4)
    tilt = [[(0, 0), (9, 2), (8, 11), (-2, 8)], [(2, 3), (5, 3), (4, 6)]]
    other = [[[(3, -1), (12, 4), (5, 12)], [(5, 3), (8, 5), (6, 7)]], [[(-4, 2), (0, 3), (-1, 6)]]]
    p = rng.uniform(-6, 14, (200_000, 2))

    def hits(shape):
        side = as_parts([shape] * 1)
        pair, x1, y1, x2, y2, *_ = K._edges(side)
        out = np.zeros(len(p), bool)
        for a, b, c, d in zip(x1, y1, x2, y2, strict=True):
            out ^= ((b > p[:, 1]) != (d > p[:, 1])) & (p[:, 0] < a + (c - a) * (p[:, 1] - b) / (d - b if d != b else 1))
        return out

    want = (hits([tilt]) & hits(other)).mean() * 400
    assert K.overlay_area(as_parts([[tilt]]), as_parts([other]))[0] == pytest.approx(want, rel=0.02)


def test_distance_and_corridor_know_the_hole():
    px, py = [5.0, 5.0, 15.0, 1.0, 23.0], [5.0, 3.5, 5.0, 1.0, 5.0]
    d = K.ring_point(as_parts([FRAME] * 5), pa.array(px), pa.array(py))
    assert d == pytest.approx([2, 0.5, 5, 0, 1])
    ends = [[-5.0, 4.0, 3.5], [5.0, 4.5, 5.0], [35.0, 6.0, 6.5], [5.0, 5.5, 5.0]]
    args = [pa.array(x) for x in ends]
    share = K.corridor_share(as_parts([FRAME] * 3), *args, pa.array([0.0] * 3))
    assert share == pytest.approx([(3 + 3 + 2 + 6) / 40, 0, 0])
    wide = K.corridor_share(as_parts([FRAME] * 3), *args, pa.array([1.0] * 3))
    assert wide == pytest.approx([((10 + 2 - 2) + (10 + 2)) / 40, 0, 1 / 3])
    gap = K.ring_piece(as_parts([FRAME] * 3), *args)
    assert gap == pytest.approx([0, 1, 0.5])


def test_empty_and_missing_outlines():
    shapes = as_parts([None, [], [[]], FRAME])
    assert np.isnan(K.ring_point(shapes, pa.array([1.0] * 4), pa.array([1.0] * 4))[:3]).all()
    assert K.overlay_area(shapes, as_rings([rect(0, 0, 2, 2)] * 4)) == pytest.approx([0, 0, 0, 4])


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame([(1, [[[{"x": float(x), "y": float(y)} for x, y in r] for r in p] for p in FRAME], 1.0, 1.0)], "segment_id int, parts array<array<array<struct<x:double,y:double>>>>, x double, y double").withColumns(geo.parts_bounds(F.col("parts")))


def test_joins_take_parts(spark, frames):
    rng = np.random.default_rng(7)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-2, 32, (400, 2)))]
    points = spark.createDataFrame(pts, "pid int, px double, py double")
    got = layers.points_in_areas(points, frames, "segment_id", {"n": F.sum("n_")}, {"n_": F.count(F.lit(1))}, 5.0).first()["n"]
    assert got == sum(inside(x, y) for _, x, y in pts)
    near = layers.nearest_point(frames, points.filter("px > 3.5 AND px < 6.5 AND py > 3.5 AND py < 6.5"), "pid", 50.0, 5.0, "d").first()["d"]
    assert near == pytest.approx(min(min(x - 3, 7 - x, y - 3, 7 - y) for _, x, y in pts if 3.5 < x < 6.5 and 3.5 < y < 6.5), abs=1e-6)
    assert frames.select(geo.parts_centroid(F.col("parts")).alias("c")).select("c.*").first() == pytest.approx(((84 * 5 + 100 * 25 - 12 * 23) / 172, 5.0))


def test_a_wide_box_lists_few_cells_and_loses_no_pair(spark):
    """A zone of 500 km beside segments of 20 m."""
    rng = np.random.default_rng(2)
    wide = [(1, 0.0, 0.0, 500_000.0, 500_000.0), (2, 100.0, 50.0, 130.0, 90.0), (3, -40_000.0, 10.0, 90_000.0, 11.0)]
    small = [(i, float(x), float(y), float(x + 20), float(y + 4)) for i, (x, y) in enumerate(np.vstack((rng.uniform(0, 500, (60, 2)), rng.uniform(-60_000, 600_000, (60, 2)))))]
    left = spark.createDataFrame(wide, "zone int, minx double, miny double, maxx double, maxy double")
    right = spark.createDataFrame(small, "seg int, rminx double, rminy double, rmaxx double, rmaxy double")
    assert grid.by_cell(left, 200.0).groupBy("zone").count().agg(F.max("count")).first()[0] <= grid.MOST_CELLS < 100
    meet = lambda a, b, pad: a[1] - pad <= b[3] and a[3] + pad >= b[1] and a[2] - pad <= b[4] and a[4] + pad >= b[2]
    for pad in (0.0, 30.0):
        got = [(r.zone, r.seg) for r in grid.box_box_pairs(left, right, 200.0, pad).select("zone", "seg").collect()]
        assert sorted(got) == sorted((a[0], b[0]) for a in wide for b in small if meet(a, b, pad))
        back = right.selectExpr("seg", "rminx AS minx", "rminy AS miny", "rmaxx AS maxx", "rmaxy AS maxy")
        other = left.selectExpr("zone", "minx AS rminx", "miny AS rminy", "maxx AS rmaxx", "maxy AS rmaxy")
        assert sorted((r.zone, r.seg) for r in grid.box_box_pairs(back, other, 200.0, pad).select("zone", "seg").collect()) == sorted(got)
        pts = right.selectExpr("seg", "rminx AS px", "rminy AS py")
        got = sorted((r.zone, r.seg) for r in grid.box_point_pairs(left, pts, 200.0, pad).select("zone", "seg").collect())
        assert got == sorted((a[0], b[0]) for a in wide for b in small if meet(a, (0, b[1], b[2], b[1], b[2]), pad))
