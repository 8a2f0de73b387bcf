"""Measures between samples of a line are taken in its row: the same results as by all pairs, and no pair is a row."""

import math
import random

from pyspark.sql import functions as F

from strideframe.operators import lines

COLS = "route_id long, n long, along double, px double, py double, total double"


def walks(count=25, seed=4):
    """Samples of random walks that cross their own way, and of one that goes out and back."""
    rnd, rows, starts = random.Random(seed), [], []
    for k in range(count):
        x, y, turn, pts = rnd.uniform(-500, 500), rnd.uniform(-500, 500), 0.0, []
        for n in range(rnd.choice([3, 9, 12, 40, 80])):
            pts.append((x, y))
            turn += rnd.choice([0, 0, 0, math.pi / 2, math.pi])
            x, y = x + 28 * math.cos(turn), y + 28 * math.sin(turn)
        rows += [(k, n, n * 28.0, px, py, (len(pts) - 1) * 28.0) for n, (px, py) in enumerate(pts)]
        starts.append((k, *pts[0]))
    out = [(abs(n - 10) * -28.0 + 280.0, 5.0 if n > 10 else 0.0) for n in range(21)]
    rows += [(count, n, n * 28.0, x, y, 560.0) for n, (x, y) in enumerate(out)]
    return rows, [*starts, (count, 0.0, 0.0)]


def by_route(rows):
    return {k: [r for r in rows if r[0] == k] for k in {r[0] for r in rows}}


def test_revisits_and_spurs_match_all_pairs(spark):
    rows, starts = walks()
    smp, st = spark.createDataFrame(rows, COLS), spark.createDataFrame(starts, "route_id long, sx double, sy double")
    nested = smp.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("n", "along", "px", "py", "total"))).alias("samples")).join(st, "route_id")
    origin = {k: (x, y) for k, x, y in starts}
    revisit, spurs = {}, {}
    for k, s in by_route(rows).items():
        off = [math.dist(r[3:5], origin[k]) for r in s]
        near = lambda p, q: (p[3] - q[3]) ** 2 + (p[4] - q[4]) ** 2 <= 225
        later = [i for i, r in enumerate(s) if r[2] >= r[5] * 0.18]
        hits = [i for i in later if any(s[i][2] - q[2] >= 95 and not (off[i] <= 80 and off[j] <= 80) and near(s[i], q) for j, q in enumerate(s))]
        revisit[k] = 1.0 if len(s) < 8 or s[0][5] < 120 else len(hits) / len(later)
        best = {}
        for i, p in enumerate(s):
            for j, q in enumerate(s):
                sep, tip = p[2] - q[2], s[(i + j) // 2]
                ok = len(s) >= 10 and off[i] > 80 and off[j] > 80 and i >= 2 and 80 <= p[2] <= p[5] - 80 and q[2] >= 40 and 120 <= sep <= 320 and math.dist(p[3:5], q[3:5]) <= 15
                if ok and max(50, sep / 2 * 0.6) <= math.dist(tip[3:5], q[3:5]) <= sep / 2 * 1.35:
                    best[i] = (sep / 2, math.floor(q[2] / 50))
        buckets = {}
        for i in sorted(best):
            buckets.setdefault(best[i][1], []).append(best[i][0])
        spurs[k] = (max([0.0, *[max(v) for v in buckets.values()]]), sum(v[0] for v in buckets.values()))
    assert max(revisit[k] for k in revisit if revisit[k] < 1) > 0.3 and sum(v[0] > 0 for v in spurs.values()) >= 3
    for given in ((smp, ["route_id"], st), (nested, ["route_id"])):
        assert {r.route_id: round(r.revisit, 9) for r in lines.revisit_ratio(*given).collect()} == {k: round(v, 9) for k, v in revisit.items()}
        assert {r.route_id: (round(r.worst_spur_m, 6), round(r.total_spur_m, 6)) for r in lines.spur_measure(*given).collect()} == {k: (round(a, 6), round(b, 6)) for k, (a, b) in spurs.items()}


def test_no_sample_is_broadcast_or_joined(spark):
    rows, starts = walks(3)
    smp = spark.createDataFrame(rows, COLS).groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("n", "along", "px", "py", "total"))).alias("samples"))
    smp = smp.withColumns({"sx": F.col("samples")[0]["px"], "sy": F.col("samples")[0]["py"]})
    for measure in (lines.revisit_ratio, lines.spur_measure):
        assert "Join" not in measure(smp, ["route_id"])._jdf.queryExecution().optimizedPlan().toString()


def test_overlaps_of_a_request_match_all_pairs(spark):
    rows, _ = walks(12, seed=9)
    rows = [(k, n, a, x / 4, y / 4, t) for k, n, a, x, y, t in rows if len(by_route(rows)[k]) > 3]
    smp = spark.createDataFrame(rows, COLS).groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("n", "along", "px", "py", "total"))).alias("samples"))
    smp = smp.withColumn("req", F.col("route_id") % 3)
    a, b = lines.every_kth(smp, ["route_id"], 16), lines.every_kth(smp, ["route_id"], 20)
    got = {(r.route_id, r.route_id_b): round(r.overlap, 9) for r in lines.sample_overlaps(a, b, "route_id", "req", 55.0).collect()}
    want, by = {}, by_route(rows)
    for k, p in by.items():
        for m, q in by.items():
            if k != m and k % 3 == m % 3:
                left, right = (s[::max(1, len(s) // parts)] for s, parts in ((p, 16), (q, 20)))
                share = sum(any(math.dist(i[3:5], j[3:5]) <= 55 for j in right) for i in left) / len(left)
                if share:
                    want[k, m] = round(share, 9)
    assert got == want and len(want) > 4
