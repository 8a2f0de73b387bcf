"""Geometry kernels against sampling and plain loops."""

import numpy as np
import pyarrow as pa
import pytest

from strideframe.operators import kernels as K
from strideframe.sources import wkb

L_SHAPE = [(0, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10)]
DENT = [(-3, 2), (8, -2), (6, 5), (12, 9), (1, 7)]


def rings(*items):
    return pa.array([[{"x": float(x), "y": float(y)} for x, y in r] for r in items])


def nums(*v):
    return pa.array([float(x) for x in v])


def inside(ring, x, y):
    hit = np.zeros(np.shape(x), bool)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if y1 != y2:
            hit ^= ((y1 > y) != (y2 > y)) & (x < x1 + (x2 - x1) * (y - y1) / (y2 - y1))
    return hit


def sampled_distance(ring, px, py):
    t = np.linspace(0, 1, 20001)
    best = np.inf
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        best = min(best, np.hypot(px - (x1 + t * (x2 - x1)), py - (y1 + t * (y2 - y1))).min())
    return 0.0 if inside(ring, np.array(px), np.array(py)) else best


def test_overlay_area_of_concave_rings():
    g = np.linspace(-4, 13, 1701)
    x, y = np.meshgrid(g + 0.003, g + 0.004)
    expect = (inside(L_SHAPE, x, y) & inside(DENT, x, y)).mean() * (g[-1] - g[0] + 0.01) ** 2
    got = K.overlay_area(rings(L_SHAPE, L_SHAPE, L_SHAPE[::-1], L_SHAPE), rings(DENT, DENT[::-1], DENT, [(50, 50), (51, 50), (51, 51)]))
    assert got[:3] == pytest.approx([expect] * 3, rel=5e-3)
    assert got[3] == 0
    assert K.overlay_area(rings(L_SHAPE), rings(L_SHAPE)) == pytest.approx([64.0])


def test_point_and_piece_distance():
    rng = np.random.default_rng(3)
    for ring in (L_SHAPE, DENT):
        p = rng.uniform(-8, 16, (40, 2))
        got = K.ring_point(rings(*[ring] * 40), nums(*p[:, 0]), nums(*p[:, 1]))
        assert got == pytest.approx([sampled_distance(ring, *q) for q in p], abs=2e-3)
        e = rng.uniform(-8, 16, (40, 4))
        got = K.ring_piece(rings(*[ring] * 40), *[nums(*e[:, i]) for i in range(4)])
        s = np.linspace(0, 1, 60)
        for k in range(40):
            dense = min(sampled_distance(ring, e[k, 0] + t * (e[k, 2] - e[k, 0]), e[k, 1] + t * (e[k, 3] - e[k, 1])) for t in s)
            assert got[k] <= dense + 2e-3 and got[k] >= dense - 0.35


@pytest.mark.parametrize("radius", [0.0, 1.5])
def test_corridor_share_against_sampling(radius):
    rng = np.random.default_rng(5)
    e = rng.uniform(-10, 18, (30, 4))
    t = (np.arange(1500) + 0.5) / 1500
    for ring in (L_SHAPE, DENT):
        got = K.corridor_share(rings(*[ring] * 30), *[nums(*e[:, i]) for i in range(4)], nums(*[radius] * 30))
        for k in range(30):
            x, y = e[k, 0] + t * (e[k, 2] - e[k, 0]), e[k, 1] + t * (e[k, 3] - e[k, 1])
            near = inside(ring, x, y)
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                near |= K._segment_point(x, y, x1, y1, x2, y2) <= radius if radius else False
            assert got[k] == pytest.approx(near.mean(), abs=4e-3)
            assert 0 <= got[k] <= 1 + 1e-12


def test_simplify_keeps_ends_and_tolerance():
    x = np.linspace(0, 10, 101)
    y = np.where(np.abs(x - 5) < 0.05, 3.0, 0.001 * np.sin(x))
    keep = K.simplify(x, y, 0.1)
    assert keep[0] and keep[-1] and keep[50] and keep.sum() < 10


def test_wkb_round_trip():
    for kind, xy in ((wkb.POINT, [(1.5, -2)]), (wkb.LINE, [(0, 0), (3, 4), (5, 5)]), (wkb.POLYGON, L_SHAPE)):
        xy = np.array(xy, float)
        (ring,), = wkb.decode(wkb.encode([[xy]], kind))
        assert np.array_equal(ring, xy)
    assert wkb.encode([[np.array([(1.0, 2.0)])]], 1).hex() == "0101000000000000000000f03f0000000000000040"


def test_wkb_keeps_holes_and_parts_and_refuses_what_it_does_not_know():
    import pytest
    square, hole = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float), np.array([(1, 1), (2, 1), (2, 2)], float)
    cases = [(wkb.POLYGON, [[square, hole]]), (wkb.MULTIPOLYGON, [[square, hole], [square + 9]]), (wkb.MULTILINE, [[hole], [square]]), (wkb.MULTIPOINT, [[hole[:1]], [hole[1:2]]])]
    for kind, parts in cases:
        back = wkb.decode(wkb.encode(parts, kind))
        assert [[r.tolist() for r in p] for p in back] == [[r.tolist() for r in p] for p in parts]
    big = b"\x00" + (1).to_bytes(4, "big") + np.array([1.5, 2.5], ">f8").tobytes()
    assert wkb.decode(big)[0][0].tolist() == [[1.5, 2.5]]
    for bad in (b"\x01\x07\0\0\0\0\0\0\0", b"\x01" + (1001).to_bytes(4, "little") + bytes(24)):
        with pytest.raises(ValueError):
            wkb.decode(bad)
