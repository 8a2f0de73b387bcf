import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.llm import hilbert_clusters as hc


def brute(rows, k=16, rounds=3):
    """Lloyd's rounds over whole numbers, in plain Python."""
    v = [[max(-hc.LARGEST, min(hc.LARGEST, int(np.floor(64 * x)))) for x in e] for _, e in rows]
    order = sorted(range(len(v)), key=lambda i: (hashlib.sha256(f"1:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest(), v[i]))
    cents = [v[i] for i in order[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for step in range(rounds + 1):
        got = [min((dist(x, c), j) for j, c in enumerate(cents)) for x in v]
        if step == rounds:
            return [(i, j, d) for (i, _), (d, j) in zip(rows, got, strict=True)], cents
        for j in range(len(cents)):
            mine = [x for x, (_, at) in zip(v, got, strict=True) if at == j]
            if mine:
                cents[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, v string, key int")


def vectors(n, seed=0, groups=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 64))
    return [(i, [float(x) for x in centres[i % groups] + rng.normal(scale=0.2, size=64)]) for i in range(n)]


@pytest.mark.parametrize("bits,dims", [(2, 2), (4, 2), (3, 3), (2, 5)])
def test_curve_visits_every_cell_by_neighbouring_steps(bits, dims):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
    keys = [k.tobytes() for k in hc.curve_keys(cells, bits)]
    assert len(set(keys)) == len(cells)
    path = cells[sorted(range(len(cells)), key=lambda i: keys[i])]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_box_keeps_every_nearest_centroid():
    rng = np.random.default_rng(3)
    pruned = 0
    for _ in range(200):
        v = rng.integers(-20, 20, (30, 6)) + rng.integers(-60, 60, 6)
        cents = rng.integers(-80, 80, (16, 6))
        left = set(hc.box_candidates(v.min(axis=0), v.max(axis=0), cents))
        got, d = hc.nearest(v, cents, np.arange(16))
        assert set(got) <= left
        again, e = hc.nearest(v, cents, np.array(sorted(left)))
        assert (again == got).all() and (e == d).all()
        pruned += 16 - len(left)
    assert pruned > 200


def test_distances_are_exact_for_large_components():
    v = np.array([[hc.LARGEST, -hc.LARGEST, 3], [1, 2, 3]])
    assert hc.squared_distances(v, -v[:1]).tolist() == [[2 * (2 * hc.LARGEST) ** 2 + 36], [(1 + hc.LARGEST) ** 2 + (2 - hc.LARGEST) ** 2 + 36]]


@pytest.mark.parametrize("block_rows", [1, 7, 512])
def test_clusters_like_brute_force(spark, block_rows):
    rows = vectors(120) + [(500 + i, vectors(120)[0][1]) for i in range(40)] + [(3, vectors(120)[3][1]), (None, [0.0] * 64)]
    got = hc.clusters(table(spark, [(*r, 1, "x", 2) for r in rows]), block_rows=block_rows).collect()
    want, cents = brute(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted([(r["vec_id"], r["cluster"], r["distance"]) for r in got], key=key) == sorted(want, key=key)
    assert all(list(r["centroid"]) == cents[r["cluster"]] for r in got)
    assert {r["inertia"] for r in got} == {sum(d for _, _, d in want)}
    assert all(r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"]) for r in got)


def test_odd_vectors_take_no_part(spark):
    good = vectors(3)
    bad = [(10, None), (11, []), (12, [1.0] * 63), (13, [1.0] * 63 + [None]), (14, [float("nan")] + [1.0] * 63), (15, [float("inf")] * 64), (16, [1.0] * 65)]
    got = hc.clusters(table(spark, [(*r, None, None, None) for r in good + bad])).collect()
    assert {r["vec_id"] for r in got} == {0, 1, 2}
    assert {r["distance"] for r in got} == {0} and len({r["cluster"] for r in got}) == 3
    assert hc.clusters(table(spark, [])).collect() == []


def test_huge_components_are_held(spark):
    rows = [(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.0] * 64)]
    got = {r["vec_id"]: r["distance"] for r in hc.clusters(table(spark, [(*r, 1, "x", 2) for r in rows]), k=1, rounds=0).collect()}
    assert max(got.values()) >= 64 * hc.LARGEST**2 and min(got.values()) == 0


def test_copies_of_one_vector_fill_many_blocks(spark):
    rows = spark.range(4000).select(F.col("id").alias("vec_id"), F.array(*[F.lit(0)] * 64).alias("v"))
    blocks = hc.zone_blocks(rows, block_rows=100)
    got = blocks.select(F.spark_partition_id().alias("p"), F.size("ids").alias("n")).groupBy("p").agg(F.sum("n").alias("n")).collect()
    assert sum(r["n"] for r in got) == 4000 and max(r["n"] for r in got) < 2000
