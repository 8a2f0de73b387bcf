"""Pairs of a cell measured where both sides meet: the same measures, and no pair is a row of Spark."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.functions import geo
from strideframe.operators import cellwise as C
from strideframe.operators import kernels as K
from strideframe.operators import layers as L

RND = random.Random(5)
BOXES = [(i if i % 11 else None, x, y, x + RND.uniform(1, 700), y + RND.uniform(1, 40), x, y) for i, (x, y) in enumerate((RND.uniform(0, 2000), RND.uniform(0, 2000)) for _ in range(60))]
BOXES += [BOXES[3], (900, -5000.0, -5000.0, 9000.0, 9000.0, 0.0, 0.0), (901, None, 1.0, 2.0, 3.0, 1.0, 1.0), (902, 100.0, 100.0, 100.0, 100.0, 100.0, 100.0)]


@pytest.fixture(scope="module")
def segs(spark):
    return spark.createDataFrame(BOXES, "segment_id long, minx double, miny double, maxx double, maxy double, x double, y double").withColumn("ring", geo.box_ring("minx", "miny", "maxx", "maxy"))


@pytest.fixture(scope="module")
def pieces(spark):
    rows = [(i, (40, 50, None)[i % 3], x, y, x + RND.uniform(-150, 150), y + RND.uniform(-90, 90)) for i, (x, y) in enumerate((RND.uniform(0, 2000), RND.uniform(0, 2000)) for _ in range(250))]
    rows += [(800, 40, 100.0, 103.0, 100.0, 103.0), (801, 50, 5.0, 5.0, None, 5.0), (802, 50, 5.0, 5.0, float("nan"), 5.0)]
    z = spark.createDataFrame(rows, "zone_id long, v int, x1 double, y1 double, x2 double, y2 double")
    box = [F.least("x1", "x2"), F.least("y1", "y2"), F.greatest("x1", "x2"), F.greatest("y1", "y2")]
    return z.select("*", *[b.alias(c) for b, c in zip(box, C.RBOX)])


def grouped(df):
    return "FlatMapCoGroupsInArrow" in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("target", [50_000, 40])
def test_totals_are_those_of_all_pairs(spark, segs, target, monkeypatch):
    monkeypatch.setattr(L, "GROUP_POINTS", target / 20)
    day = datetime.date(2001, 1, 1)
    rows = [(RND.uniform(0, 2000), RND.uniform(0, 2000), None if i % 5 == 0 else i % 7, None if i % 3 == 0 else day + datetime.timedelta(i)) for i in range(900)]
    rows += [(100.0, 125.0, 3, day), (115.0, 120.0, 4, None), (100.0, 125.0000001, 5, day), (float("nan"), 1.0, 9, day), (None, 1.0, 9, day), (1.0, float("inf"), 9, day)]
    pts = spark.createDataFrame(rows, "px double, py double, d int, last date")
    pre = {"n_": F.count(F.lit(1)), "d_": F.sum("d"), "last_": F.max("last")}
    post = {"n10": F.sum(F.when(F.col("dist") <= 10, F.col("n_")).otherwise(0)), "n": F.sum("n_"), "d": F.sum("d_"), "last": F.max("last_")}
    got = L.corridor_stats(segs, pts, 25.0, pre, post, bands=(10.0,), largest=("last_",))
    assert grouped(got)
    want = L.near_pairs(segs, L.at_positions(pts, pre), 25.0).groupBy("segment_id").agg(*[v.alias(k) for k, v in post.items()])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {r.segment_id: r.n for r in got.collect()}[902] >= 2  # distances of 25 exactly count


def test_outlines_in_parts_are_measured_as_well(spark, segs):
    hole = F.array(F.array(geo.box_ring(F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(100.0)), geo.box_ring(F.lit(20.0), F.lit(20.0), F.lit(80.0), F.lit(80.0))), F.array(geo.box_ring(F.lit(300.0), F.lit(0.0), F.lit(310.0), F.lit(10.0))))
    parts = spark.range(1).select(F.lit(1).alias("segment_id"), F.lit(0.0).alias("minx"), F.lit(0.0).alias("miny"), F.lit(310.0).alias("maxx"), F.lit(100.0).alias("maxy"), hole.alias("parts"))
    pts = spark.createDataFrame([(50.0, 50.0), (25.0, 50.0), (10.0, 10.0), (305.0, 15.0), (200.0, 50.0)], "px double, py double")
    row = L.corridor_stats(parts, pts, 10.0, {"n_": F.count(F.lit(1))}, {"n": F.sum("n_")}).first()
    assert row.n == 3  # near the inner edge, on the ground, near the second part


def test_segments_near_a_line_are_those_of_all_pairs(segs, pieces):
    got = L.with_line_near(segs, pieces, 30.0)
    assert grouped(got)
    want = L.line_pairs(segs, pieces, 30.0).filter(K.ring_piece_distance("ring", "x1", "y1", "x2", "y2") <= 30).select("segment_id").distinct()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 20


@pytest.mark.parametrize("radius", [0.0, 25.0])
def test_metres_per_value_are_those_of_all_pairs(segs, pieces, radius):
    got = L.line_metres(segs, pieces, "v", radius)
    assert grouped(got)
    want = L.line_length_inside(segs, pieces, radius)
    sums = [{(r.segment_id, r.v): r.m for r in df.groupBy("segment_id", "v").agg(F.sum("metres").alias("m")).collect()} for df in (got, want)]
    assert sums[0].keys() == sums[1].keys() and len(sums[0]) > 20
    assert [(k, sums[0][k], sums[1][k]) for k in sums[0] if abs(sums[0][k] - sums[1][k]) > 1e-6] == []


def test_points_near_a_piece_are_those_of_all_pairs(spark, pieces):
    rows = [(i % 40 or None, i, RND.uniform(0, 2000), RND.uniform(0, 2000)) for i in range(800)] + [(1, 900, None, 1.0), (1, 901, float("nan"), 1.0), (1, 902, 100.0, 111.0)]
    pts = spark.createDataFrame(rows, "id long, k long, px double, py double")
    boxed = pieces.select("x1", "y1", "x2", "y2", *[F.col(r).alias(c) for r, c in zip(C.RBOX, C.BOX)])
    got = C.points_near(boxed, pts, ["id", "k"], 8.0, 200.0).distinct()
    want = C.box_point_cells(boxed, pts, 200.0, 8.0)
    pairs = want[0].join(want[1], want[2]).filter(geo.point_piece_distance("px", "py", "x1", "y1", "x2", "y2") <= 8).select("id", "k").distinct()
    assert sorted(map(str, got.collect())) == sorted(map(str, pairs.collect())) and pairs.count() > 20


def test_nearest_line_is_that_of_all_pairs(segs, pieces):
    lines = pieces.filter("zone_id < 800").unionByName(pieces.filter("zone_id = 800").withColumn("zone_id", F.lit(None).cast("long")))
    pairs = L.line_pairs(segs, lines, 300.0).withColumn("d", F.round(K.ring_piece_distance("ring", "x1", "y1", "x2", "y2"), 6)).filter("d <= 300 AND segment_id IS NOT NULL")
    want = pairs.groupBy("segment_id").agg(F.min_by(F.struct("d", "v"), F.struct("d", "zone_id")).alias("b")).select("segment_id", "b.*")
    got = L.nearest_line(segs, lines, "zone_id", "v", 300.0, 120.0)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
    assert 0 < want.filter("d = 0").count() < want.count()
    assert "'LeftAnti" in got._jdf.queryExecution().logical().toString() or "LeftAnti" in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_line_that_starts_on_the_edge_up_to_rounding_enters(spark):
    seg = spark.createDataFrame([(1, 6202.7, 147.0, 7132.7, 149.39999999999998, 6667.7, 148.2)], "segment_id long, minx double, miny double, maxx double, maxy double, x double, y double").withColumn("ring", geo.box_ring("minx", "miny", "maxx", "maxy"))
    lines = spark.createDataFrame([(3, 100, 6957.4, 149.4, 6757.4, 319.4), (4, 80, 6469.2, 236.1, 6299.2, 136.1)], "zone_id long, v int, x1 double, y1 double, x2 double, y2 double")
    assert L.nearest_line(seg, lines, "zone_id", "v", 500.0, 250.0).collect() == [(1, 0.0, 100)]
