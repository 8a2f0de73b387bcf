import numpy as np
from pyspark.sql import functions as F

from strideframe.llm import pivot_search as ps


def _brute(rows, k=5):
    ok = [(i, np.floor(256 * np.array(v, float))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in ok), default=0)
    ok = [(i, np.pad(v, (0, width - len(v)))) for i, v in ok]
    out = []
    for i, q in {i: q for i, q in ok if i % 50 == 0}.items():
        best = sorted((-int(q @ v), j) for j, v in ok if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def _run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return sorted(tuple(r) for r in ps.top_k(df, F.col("vec_id") % 50 == 0, **options).collect())


def test_equals_brute_force_with_ties_and_copies(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 600)]
    want = _brute([(i, np.float32(v).tolist()) for i, v in rows])
    assert _run(spark, rows) == want
    assert _run(spark, rows, block_rows=50, block_queries=3, pivots=4) == want


def test_elimination_evaluates_few_rows_of_clustered_vectors():
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(20, 6)) * 400
    rows = np.floor(np.repeat(centre, 100, axis=0) + rng.normal(size=(2000, 6)) * 5)
    pivots, seen = rows[::100], []

    class Counting(np.ndarray):
        def __getitem__(self, at):
            seen.append(len(at) if isinstance(at, np.ndarray) else 1)
            return np.asarray(self)[at]

    far, norm = ps.pivot_distances(rows, pivots), (rows * rows).sum(1)
    got = ps.block_top(rows[0], far[0], 0, rows.view(Counting), far, norm, np.arange(2000), 5)
    want = sorted((-int(rows[0] @ v), j) for j, v in enumerate(rows) if j)[:5]
    assert got == [(j, -s) for s, j in want] and sum(seen) < 1000


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, []), (None, [1.0, 1.0]), (6, [3.0]), (7, [0.5, 0.5, 9.0]), (7, [0.5, 0.5, 9.0]), (50, [1.0, 1.0]), (50, [1.0, 1.0])]
    assert _run(spark, rows) == _brute(rows)
    assert _run(spark, []) == [] and _run(spark, [(50, [1.0])]) == []


def test_extra_columns_do_not_matter(spark):
    df = spark.createDataFrame([(0, [1.0], 5, "x"), (1, [2.0], 6, "y")], "vec_id long, embedding array<float>, v int, score string")
    assert [tuple(r) for r in ps.top_k(df, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 256 * 512)]


def test_copies_of_query_blocks_are_not_broadcast(spark):
    df = spark.range(400).select(F.col("id").alias("vec_id"), F.array(*[F.rand(k).cast("float") for k in range(4)]).alias("embedding"))
    plan = ps.top_k(df, F.col("vec_id") % 50 == 0, block_rows=8)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan  # the blocks are small as files, but there is a copy for every block of rows


def test_vectors_of_the_pivots_are_the_first_by_hash(spark):
    df = spark.range(4000).select((F.col("id") % 700).alias("vec_id"), F.array((F.col("id") % 900).cast("double")).alias("v"))
    few = df.unionByName(spark.range(5000).select(F.lit(9999).alias("vec_id"), F.array(F.lit(1.0)).alias("v")))
    for rows, n in ((df, 50), (df, 5000), (few, 300), (df.limit(0), 5)):
        want = [r.v for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(n).collect()]
        assert ps._first_by_hash(rows, n) == want
