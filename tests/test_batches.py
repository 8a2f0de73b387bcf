"""Rows thinned batch by batch before they are shuffled: the same unions and nearest rows, from fewer rows."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from strideframe.functions import geo
from strideframe.operators import corridor, layers, lines


def test_intervals_of_a_batch_become_disjoint_ones():
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None]), rnd.randrange(3), *sorted((rnd.randrange(40) / 40, rnd.randrange(40) / 40))) for _ in range(200)]
    rows += [("c", 0, 0.1, 0.2), ("c", 0, 0.2, 0.3), ("c", 0, 0.5, 0.5), ("c", 0, 0.1, 0.15)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("k", "i", "lo", "hi"), r)) for r in rows])
    got = [tuple(r.values()) for r in lines.union_of_batch(batch, ["k", "i"]).to_pylist()]
    want = []
    for key in {r[:2] for r in rows}:
        spans = []
        for lo, hi in sorted(r[2:] for r in rows if r[:2] == key):
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], hi)
            else:
                spans.append([lo, hi])
        want += [(*key, lo, hi) for lo, hi in spans]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_first_row_of_a_batch_takes_ties_and_nulls_as_spark_does():
    rows = [(1, 2.0, 9, "x"), (1, 2.0, 3, "y"), (1, 5.0, 1, "z"), (None, 1.0, 4, "n"), (None, 1.0, None, "m"), (2, 0.5, 7, None)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("k", "gap", "probe", "v"), r)) for r in rows])
    got = {r["k"]: r["v"] for r in lines.first_of_batch(batch, ["k"], ["gap", "probe"]).to_pylist()}
    assert got == {1: "y", None: "m", 2: None}


def test_lines_over_each_other_leave_one_interval_of_a_piece(spark):
    piece = spark.createDataFrame([(1, 0, 0.0, 0.0, 100.0, 0.0)], "route_id long, i int, x1 double, y1 double, x2 double, y2 double")
    over = spark.range(60).select(*[F.lit(v).alias(c) if c[0] == "x" else (F.col("id") / 10).alias(c) for c, v in (("x1", 20.0), ("y1", 0), ("x2", 80.0), ("y2", 0))]).coalesce(1)
    spans = corridor.cover_intervals(piece, over, "route_id", 10.0).collect()
    assert len(spans) == 1  # one per line before
    assert round(spans[0]["lo"], 6) == 0.1 and round(spans[0]["hi"], 6) == 0.9


def test_a_bent_way_is_measured_once_per_segment(spark):
    at = lambda *p: F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in p])
    ways = spark.range(1).select(F.lit(7).alias("way_id"), at((0.0, 0.0), (100.0, 0.0), (100.0, 50.0), (0.0, 50.0)).alias("line"))
    segs = spark.createDataFrame([(1, -20.0, -5.0, 130.0, 60.0, 10.0), (2, 95.0, 10.0, 105.0, 40.0, 90.0), (3, 500.0, 500.0, 510.0, 510.0, 1.0)], "segment_id int, minx double, miny double, maxx double, maxy double, day_s double")
    segs = segs.withColumn("ring", geo.box_ring("minx", "miny", "maxx", "maxy"))
    row = layers.bent_way_scores(ways, segs, ("day_s",)).first()
    twice = layers.bent_way_scores(ways, segs.unionByName(segs.filter("segment_id = 2")), ("day_s",)).first()
    assert row["day_s"] == twice["day_s"] and row["common_m2"] == twice["common_m2"]  # a segment number counts once
    small = 10.0 * 30.0  # the second segment lies inside the buffer; the first is met by all three pieces and counts once
    assert row["common_m2"] < 2 * 150 * 65 and abs(row["day_s"] - ((row["common_m2"] - small) * 10 + small * 90) / row["common_m2"]) < 1e-6
    assert row["length_m"] == 250 and row["score_coverage"] == 1
    # without repeated numbers no pair is grouped: the only rows that travel by way hold sums
    pairs_met = layers.bent_way_scores(ways, segs, ("day_s",))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in pairs_met


def test_samples_of_a_route_take_the_nearest_probe_and_the_smaller_of_ties(spark):
    smp = spark.createDataFrame([(1, n, 10.0 * n, 0.0) for n in range(4)], "route_id long, n long, px double, py double")
    probes = spark.createDataFrame([(5, True, 0.0, 3.0, 40.0, 3.0), (4, False, 0.0, -3.0, 40.0, -3.0), (9, True, 0.0, 8.0, 40.0, 8.0)], "zone_id long, road boolean, x1 double, y1 double, x2 double, y2 double")
    out = lines.sample_class_share(smp, probes, ["route_id"], "zone_id", "road", 40.0)
    assert "MapInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.select("known", "road_share", "rejected").collect() == [(4, 0.0, False)]
