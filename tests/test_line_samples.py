"""Even samples of many lines at once, and routes grouped by one exchange."""

import math

from pyspark.sql import functions as F

from strideframe.operators import lines
from strideframe.plans.route_fixtures import routes

LINES = [(1, [(0.0, 0.0), (100.0, 0.0), (100.0, 0.0), (100.0, 41.0)]), (2, []), (3, [(5.0, 5.0)]), (4, None), (5, [(7.0, 7.0), (7.0, 7.0)]), (6, [(0.0, 0.0), (28.0, 0.0)]), (7, [(k * 3.3, (k % 5) * 1.7) for k in range(400)])]


def walked(line, step):
    at, out, n = [0.0], [], 0
    for (a, b), (c, d) in zip(line, line[1:]):
        at.append(at[-1] + math.hypot(c - a, d - b))
    while n <= math.floor(at[-1] / step + 1e-9):
        k = next(k for k in range(1, len(at)) if math.floor(at[k] / step + 1e-9) >= n)
        size = at[k] - at[k - 1]
        f = min(1, max(0, (n * step - at[k - 1]) / size)) if size else 0
        out.append((n, n * step, *(p + f * (q - p) for p, q in zip(line[k - 1], line[k], strict=True))))
        n += 1
    return [*out, (n, at[-1], *line[-1])], at[-1]


def test_samples_of_a_batch_are_those_of_each_line(spark):
    df = spark.createDataFrame(LINES, "id int, line array<struct<x:double,y:double>>").coalesce(1)
    got = {}
    for r in lines.samples(df, ["id"], 28.0).orderBy("id", "n").collect():
        got.setdefault(r.id, []).append(r)
    assert set(got) == {1, 5, 6, 7}
    for k, line in LINES:
        if k in got:
            want, total = walked(line, 28.0)
            assert [r.n for r in got[k]] == [w[0] for w in want]
            assert all(math.isclose(a, b, abs_tol=1e-9) for r, w in zip(got[k], want, strict=True) for a, b in zip((r.along, r.px, r.py), w[1:], strict=True))
            assert {round(r.total, 9) for r in got[k]} == {round(total, 9)}


def test_pieces_of_a_batch_start_where_the_last_one_ends(spark):
    df = spark.createDataFrame(LINES, "id int, line array<struct<x:double,y:double>>").coalesce(1)
    rows = lines.along(df, ["id"]).filter("id = 7").orderBy("i").collect()
    assert [r.i for r in rows] == list(range(399)) and rows[0].start_m == 0
    assert all(math.isclose(a.end_m, b.start_m, abs_tol=1e-9) for a, b in zip(rows, rows[1:]))


def test_routes_travel_once(spark, tmp_path):
    spark.createDataFrame([(o, n) for o in range(20) for n in range(1, 4)] * 2, "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    r = routes(spark, str(tmp_path))
    assert r.count() == 20 and r.filter(F.size("line") == 3).count() == 20
    assert r._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
